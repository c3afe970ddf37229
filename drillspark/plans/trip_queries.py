"""Trips: filters, facets, statistics, rollups and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import codes, formats, times
from ..operators import exact_sums, facets, filters, histograms, lookups, quality, reconcile, rollups, routes, stats, suite
from ..operators.filters import TRIP_FIELDS, Fields, compile_filters
from .registry import avg_of, query, sum_of

T = ("trips",)
PICKUP = "tpep_pickup_datetime"
HOUR = "CAST(hour(tpep_pickup_datetime) AS INTEGER)"
DOW = "CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER)"
MINUTES = "((epoch_us(tpep_dropoff_datetime) - epoch_us(tpep_pickup_datetime)) / 60000000.0::DOUBLE)"
MARKS = "date_diff('minute', tpep_pickup_datetime, tpep_dropoff_datetime)"
ROW = ["trip_order", "trip_line", "PULocationID", "payment_type", "total_amount"]
ROW_SQL = "trip_order, trip_line, PULocationID, payment_type, total_amount"
DRILL = {"pickup_hour": [7, 8, 18], "payment_type": [1, 2], "total_amount": ["[10 TO 200]"]}
DRILL_SQL = {
    "pickup_hour": f"{HOUR} IN (7, 8, 18)",
    "payment_type": "payment_type IN (1, 2)",
    "total_amount": "total_amount BETWEEN 10 AND 200",
}
PLAUSIBLE = (
    "(trip_distance > 0 AND trip_distance < 100 AND fare_amount > 0 AND fare_amount < 500 "
    "AND passenger_count > 0 AND passenger_count <= 6)"
)
CLEAN = f"clean AS (SELECT * FROM trips WHERE {PLAUSIBLE})"


def _filtered(chosen, fields=TRIP_FIELDS):
    return lambda spark, sf: fixtures.trips(spark, sf).where(compile_filters(chosen, fields)).select(*ROW)


query(
    "filter_set",
    f"SELECT {ROW_SQL} FROM trips WHERE payment_type IN (1, 3) AND PULocationID = 9",
    T,
)(_filtered({"payment_type": [1, 3], "PULocationID": [9]}))
query(
    "filter_range",
    f"SELECT {ROW_SQL} FROM trips WHERE (total_amount BETWEEN 10 AND 20 OR total_amount BETWEEN 40 AND 50) "
    "AND trip_distance BETWEEN 1 AND 30",
    T,
)(_filtered({"total_amount": ["[10 TO 20]", "[40 TO 50]"], "trip_distance": ["[1 TO 30]"]}))
query(
    "filter_open_range",
    f"SELECT {ROW_SQL} FROM trips WHERE total_amount >= 250 AND trip_distance <= 21",
    T,
)(_filtered({"total_amount": ["[250 TO *]"], "trip_distance": ["[* TO 21]"]}))
query(
    "filter_time_range",
    f"SELECT {ROW_SQL} FROM trips WHERE tpep_pickup_datetime BETWEEN TIMESTAMP '1998-01-10' AND TIMESTAMP '1998-01-24 06:30:00'",
    T,
)(_filtered({PICKUP: ["[1998-01-10 TO 1998-01-24T06:30:00Z]"]}, Fields(TRIP_FIELDS.allowed | {PICKUP}, TRIP_FIELDS.virtual)))
query("filter_unknown_field", f"SELECT {ROW_SQL} FROM trips WHERE payment_type = 4", T)(
    _filtered({"payment_type": [4], "no_such_field": [1], "trip_order": [1]})
)
query(
    "filter_virtual",
    f"SELECT {ROW_SQL} FROM trips WHERE {HOUR} IN (22, 23) AND {DOW} IN (1, 7)",
    T,
)(_filtered({"pickup_hour": [22, 23], "pickup_dayofweek": [1, 7]}))
query(
    "selection_to_filter",
    f"SELECT {ROW_SQL} FROM trips WHERE payment_type IN (1, 2) AND {HOUR} = 14 AND total_amount BETWEEN 10 AND 20",
    T,
)(_filtered(["payment_type:1", "payment_type:2", "pickup_hour:14", "total_amount:[10 TO 20]", "no colon"]))


@query(
    "weekend_nights",
    f"SELECT {ROW_SQL} FROM trips WHERE {DOW} IN (6, 7) AND ({HOUR} BETWEEN 22 AND 23 OR {HOUR} BETWEEN 0 AND 4)",
    T,
)
def weekend_nights(spark, sf):
    return fixtures.trips(spark, sf).where(filters.weekend_nights(PICKUP)).select(*ROW)


@query(
    "deep_subset",
    "SELECT PULocationID, trip_distance, fare_amount, tip_amount, total_amount FROM trips "
    "WHERE PULocationID = 7 AND trip_distance BETWEEN 1 AND 20",
    T,
)
def deep_subset(spark, sf):
    where = (F.col("PULocationID") == 7) & F.col("trip_distance").between(1, 20)
    shown = ["PULocationID", "trip_distance", "fare_amount", "tip_amount", "total_amount"]
    return filters.subset(fixtures.trips(spark, sf), where, shown)


@query(
    "clean_report",
    f"""n AS (SELECT count(*) AS rows_before, count(*) FILTER (WHERE {PLAUSIBLE}) AS rows_after FROM trips)
    SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
      (rows_before - rows_after) * 100.0::DOUBLE / rows_before AS removed_percent FROM n""",
    T,
)
def clean_report(spark, sf):
    return quality.clean_report(fixtures.trips(spark, sf))


VALID = f"total_amount > 0 AND {MINUTES} > 1 AND {MINUTES} < 120"
VALID_MARKS = f"total_amount > 0 AND {MARKS} BETWEEN 1 AND 120"


@query("valid_trips", f"SELECT {ROW_SQL}, {MINUTES} AS minutes FROM trips WHERE {VALID}", T)
def valid_trips(spark, sf):
    return quality.valid_trips(fixtures.trips(spark, sf)).select(*ROW, quality.duration().alias("minutes"))


@query("valid_trips_boundary", f"SELECT {ROW_SQL}, {MARKS} AS minutes FROM trips WHERE {VALID_MARKS}", T)
def valid_trips_boundary(spark, sf):
    rows = quality.valid_trips(fixtures.trips(spark, sf), "boundary")
    return rows.select(*ROW, quality.duration("boundary").alias("minutes"))


@query(
    "week_filter",
    f"SELECT {ROW_SQL} FROM trips WHERE tpep_pickup_datetime "
    "BETWEEN TIMESTAMP '1997-01-09' AND TIMESTAMP '1997-01-16'",
    T,
)
def week_filter(spark, sf):
    return fixtures.trips(spark, sf).where(filters.time_range(PICKUP, "1997-01-09", "1997-01-16")).select(*ROW)


@query(
    "drill_rows",
    f"""hits AS (SELECT trip_order, trip_line, {HOUR} AS pickup_hour, total_amount, trip_distance FROM trips
      WHERE {' AND '.join(DRILL_SQL.values())})
    SELECT *, (SELECT count(*) FROM hits) AS num_found FROM hits
    ORDER BY total_amount DESC, trip_order, trip_line, trip_distance LIMIT 10""",
    T,
)
def drill_rows(spark, sf):
    shown = ["trip_order", "trip_line", "pickup_hour", "total_amount", "trip_distance"]
    order = [F.desc("total_amount"), F.asc("trip_order"), F.asc("trip_line"), F.asc("trip_distance")]
    return filters.drill_rows(fixtures.trips(spark, sf), DRILL, TRIP_FIELDS, shown, order, 10)


@query("dropna_subset", f"SELECT {ROW_SQL} FROM trips WHERE passenger_count IS NOT NULL", T)
def dropna_subset(spark, sf):
    return fixtures.trips(spark, sf).dropna(subset=["passenger_count", "trip_distance"]).select(*ROW)


@query(
    "count_filtered",
    f"n AS (SELECT count(*) AS count FROM trips WHERE {' AND '.join(DRILL_SQL.values())}) "
    "SELECT count, count > 0 AS can_analyze FROM n",
    T,
)
def count_filtered(spark, sf):
    return filters.count_filtered(fixtures.trips(spark, sf), DRILL, TRIP_FIELDS)


@query(
    "zone_lookup",
    """SELECT t.PULocationID, coalesce(z.name, 'Zone ' || t.PULocationID) AS pu_name,
      coalesce(z.name || ' (' || z.short || ')', 'Zone ' || t.PULocationID) AS pu_label,
      coalesce(z.borough, 'Unknown') AS pu_borough, coalesce(z.short, 'N/A') AS pu_short, count(*) AS trips
    FROM trips t LEFT JOIN zones z ON t.PULocationID = z.zone_id GROUP BY ALL""",
    ("trips", "zones"),
)
def zone_lookup(spark, sf):
    counts = fixtures.trips(spark, sf).groupBy("PULocationID").agg(F.count("*").alias("trips"))
    return lookups.with_zone(counts, fixtures.zones(spark, sf), "PULocationID", "pu")


def _case(column: str, mapping: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


@query(
    "code_labels",
    f"""SELECT payment_type, {_case('payment_type', codes.PAYMENT_TYPES, "'Typ ' || payment_type")} AS payment,
      {_case('payment_type', codes.PAYMENT_TYPES_SHORT)} AS payment_short,
      {_case(DOW, codes.WEEKDAYS)} AS weekday, count(*) AS trips FROM trips GROUP BY ALL""",
    T,
)
def code_labels(spark, sf):
    return (
        fixtures.trips(spark, sf)
        .groupBy("payment_type", times.weekday(PICKUP).alias("d"))
        .agg(F.count("*").alias("trips"))
        .select(
            "payment_type",
            codes.payment_label("payment_type").alias("payment"),
            codes.label_codes("payment_type", codes.PAYMENT_TYPES_SHORT).alias("payment_short"),
            codes.weekday_label("d").alias("weekday"),
            "trips",
        )
    )


FACETS = ["pickup_hour", "pickup_dayofweek", "payment_type", "PULocationID", "DOLocationID"]
FACET_SQL = {"pickup_hour": HOUR, "pickup_dayofweek": DOW}


def _facets_sql(rank: str = "ORDER BY count DESC, value") -> str:
    parts = [f"SELECT '*' AS field, '*' AS value, count(*) AS count FROM trips WHERE {' AND '.join(DRILL_SQL.values())}"]
    for name in FACETS:
        where = " AND ".join(sql for field, sql in DRILL_SQL.items() if field != name)
        value = FACET_SQL.get(name, name)
        parts.append(
            f"SELECT '{name}' AS field, CAST({value} AS VARCHAR) AS value, count(*) AS count FROM trips "
            f"WHERE {where} GROUP BY ALL"
        )
    return f"""counted AS ({' UNION ALL '.join(parts)}),
    top AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS n FROM counted)
    SELECT field, value, count, CAST(row_number() OVER (PARTITION BY field {rank}) AS INTEGER) AS rank
    FROM top WHERE n <= 30"""


@query("facets_multi", _facets_sql(), T)
def facets_multi(spark, sf):
    return facets.facets(fixtures.trips(spark, sf), DRILL, FACETS, TRIP_FIELDS)


@query("facet_sort_value", _facets_sql("ORDER BY TRY_CAST(value AS DOUBLE), value"), T)
def facet_sort_value(spark, sf):
    return facets.facets(fixtures.trips(spark, sf), DRILL, FACETS, TRIP_FIELDS, sort="value")


@query(
    "weekday_order",
    f"""SELECT {DOW} AS day, count(*) AS count, CAST(({DOW} + 5) % 7 + 1 AS INTEGER) AS position
    FROM trips GROUP BY ALL""",
    T,
)
def weekday_order(spark, sf):
    counts = facets.facet(fixtures.trips(spark, sf), times.weekday(PICKUP), limit=None).withColumnRenamed("value", "day")
    return facets.order_weekdays(counts, "day")


def _level(spark, sf, chosen, field):
    where = compile_filters(chosen, TRIP_FIELDS)
    return facets.facet(fixtures.trips(spark, sf), TRIP_FIELDS.column(field), where)


def _level_sql(where: str, value: str) -> str:
    return f"SELECT {value} AS value, count(*) AS count FROM trips WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"


query("ladder_l1", _level_sql("true", HOUR), T)(lambda spark, sf: _level(spark, sf, {}, "pickup_hour"))
query("ladder_l2", _level_sql(f"{HOUR} = 18", "PULocationID"), T)(
    lambda spark, sf: _level(spark, sf, {"pickup_hour": [18]}, "PULocationID")
)
query("ladder_l3", _level_sql(f"{HOUR} = 18 AND PULocationID = 7", "payment_type"), T)(
    lambda spark, sf: _level(spark, sf, {"pickup_hour": [18], "PULocationID": [7]}, "payment_type")
)


@query(
    "stats_by_hour",
    f"""SELECT {HOUR} AS pickup_hour, count(*) AS count, {sum_of('total_amount')} AS sum_total_amount,
      {avg_of('total_amount')} AS avg_total_amount FROM trips WHERE payment_type IN (1, 2) GROUP BY 1""",
    T,
)
def stats_by_hour(spark, sf):
    return stats.stats_by(fixtures.trips(spark, sf), {"payment_type": [1, 2]}, "pickup_hour")


OVERALL_SQL = f"""count(*) AS total_trips, {sum_of('fare_amount')} AS total_fares, {sum_of('tip_amount')} AS total_tips,
  {sum_of('total_amount')} AS total_revenue, {avg_of('trip_distance')} AS avg_distance, {avg_of('fare_amount')} AS avg_fare,
  {avg_of('tip_amount')} AS avg_tip, {avg_of('total_amount')} AS avg_total, {avg_of('passenger_count')} AS avg_passengers,
  {sum_of('trip_distance')} AS total_distance"""


@query("overall_stats", f"{CLEAN} SELECT {OVERALL_SQL} FROM clean", T)
def overall_stats(spark, sf):
    return stats.overall_stats(quality.clean_trips(fixtures.trips(spark, sf)))


@query(
    "by_weekday",
    f"""{CLEAN} SELECT {DOW} AS weekday, count(*) AS trips, {sum_of('total_amount')} AS revenue,
      {avg_of('total_amount')} AS avg_amount, {avg_of('trip_distance')} AS avg_distance, {avg_of('tip_amount')} AS avg_tip
    FROM clean GROUP BY 1""",
    T,
)
def by_weekday(spark, sf):
    return stats.by_weekday(quality.clean_trips(fixtures.trips(spark, sf)))


@query(
    "by_weekday_monday_first",
    f"""SELECT CAST(isodow(tpep_pickup_datetime) AS INTEGER) AS weekday, count(*) AS trips,
      {sum_of('total_amount')} AS revenue, {avg_of('total_amount')} AS avg_amount, {avg_of('trip_distance')} AS avg_distance,
      {avg_of('tip_amount')} AS avg_tip
    FROM trips WHERE trip_distance > 0 AND fare_amount > 0 AND passenger_count > 0 GROUP BY 1""",
    T,
)
def by_weekday_monday_first(spark, sf):
    rows = fixtures.trips(spark, sf).where(quality.moving() & (F.col("passenger_count") > 0))
    return stats.by_weekday(rows, "mon1")


BY_HOUR_SQL = f"""SELECT {HOUR} AS hour, count(*) AS trips, {sum_of('total_amount')} AS revenue,
  {avg_of('total_amount')} AS avg_amount FROM clean GROUP BY 1"""


@query("by_hour", f"{CLEAN} {BY_HOUR_SQL}", T)
def by_hour(spark, sf):
    return stats.by_hour(quality.clean_trips(fixtures.trips(spark, sf)))


@query(
    "by_passengers",
    f"""{CLEAN} SELECT passenger_count, count(*) AS trips, {sum_of('total_amount')} AS revenue,
      {avg_of('total_amount')} AS avg_amount, {avg_of('trip_distance')} AS avg_distance FROM clean GROUP BY 1""",
    T,
)
def by_passengers(spark, sf):
    return stats.by_passengers(quality.clean_trips(fixtures.trips(spark, sf)))


@query(
    "top_zones",
    f"""SELECT PULocationID, count(*) AS trips, {sum_of('total_amount')} AS revenue,
      {avg_of('total_amount')} AS avg_amount, {avg_of('trip_distance')} AS avg_distance
    FROM trips WHERE trip_distance > 0 AND fare_amount > 0 GROUP BY 1 ORDER BY trips DESC, PULocationID LIMIT 10""",
    T,
)
def top_zones(spark, sf):
    return stats.top_zones(fixtures.trips(spark, sf).where(quality.moving()))


def _exact(column: str) -> str:
    """The sum of whole multiples of 2**-70, rounded once."""
    return f"CAST(sum(CAST({column} * 1180591620717411303424.0::DOUBLE AS HUGEINT)) AS DOUBLE) / 1180591620717411303424.0::DOUBLE"


@query(
    "exact_sums_zone",
    f"""SELECT PULocationID, {_exact('total_amount')} AS revenue, {_exact('tip_amount')} AS tips,
      {_exact('trip_distance')} AS distance, count(total_amount) AS trips FROM trips GROUP BY 1""",
    T,
)
def exact_sums_zone(spark, sf):
    """Sums of doubles as they are, in exact arithmetic, per pickup zone."""
    measures = {"revenue": "total_amount", "tips": "tip_amount", "distance": "trip_distance"}
    return exact_sums.exact_sums(fixtures.trips(spark, sf), ["PULocationID"], measures, {"trips": "total_amount"})


@query(
    "hour_share",
    f"""{CLEAN}, g AS ({BY_HOUR_SQL})
    SELECT *, trips * 100 / CAST((SELECT sum(trips) FROM g) AS DOUBLE) AS share_percent,
      CAST(trunc(trips / CAST((SELECT max(trips) FROM g) AS DOUBLE) * 20) AS INTEGER) AS bar FROM g""",
    T,
)
def hour_share(spark, sf):
    return stats.with_share(stats.by_hour(quality.clean_trips(fixtures.trips(spark, sf))), "trips")


@query(
    "hour_money",
    f"""SELECT {HOUR} AS pickup_hour, count(*) AS count, {sum_of('total_amount')} AS sum_total_amount,
      {avg_of('total_amount')} AS avg_total_amount, {avg_of('tip_amount')} AS avg_tip_amount FROM trips GROUP BY 1""",
    T,
)
def hour_money(spark, sf):
    return stats.hour_money(fixtures.trips(spark, sf))


@query(
    "weekend_night_stats",
    f"""SELECT {HOUR} AS pickup_hour, count(*) AS count, {sum_of('total_amount')} AS sum_total_amount,
      {avg_of('total_amount')} AS avg_total_amount, {avg_of('tip_amount')} AS avg_tip_amount,
      {avg_of('trip_distance')} AS avg_trip_distance FROM trips
    WHERE {DOW} IN (6, 7) AND ({HOUR} BETWEEN 22 AND 23 OR {HOUR} BETWEEN 0 AND 4) GROUP BY 1""",
    T,
)
def weekend_night_stats(spark, sf):
    return stats.hour_money(fixtures.trips(spark, sf).where(filters.weekend_nights(PICKUP)), distance=True)


ROUTES_SQL = f"""SELECT PULocationID, DOLocationID, count(*) AS trip_count, {avg_of('total_amount')} AS avg_fare,
  ({sum_of('{minutes}')} / count(*)) AS avg_duration_min, {avg_of('trip_distance')} AS avg_distance,
  {sum_of('total_amount')} AS total_revenue FROM trips WHERE {{where}} GROUP BY 1, 2"""
SCORED_SQL = """SELECT *, avg_fare / avg_duration_min AS fare_per_minute,
  (trip_count * avg_fare) / avg_duration_min AS score"""
ELAPSED_ROUTES = ROUTES_SQL.format(minutes=MINUTES, where=VALID)
MARKS_ROUTES = ROUTES_SQL.format(minutes=MARKS, where=VALID_MARKS)


@query(
    "top_routes",
    f"""r AS ({ELAPSED_ROUTES}) {SCORED_SQL}, CAST((SELECT sum(trip_count) FROM r) AS BIGINT) AS total_trips
    FROM r ORDER BY score DESC, PULocationID, DOLocationID LIMIT 5""",
    T,
)
def top_routes(spark, sf):
    return routes.top_routes(fixtures.trips(spark, sf))


@query(
    "top_routes_filtered",
    f"""r AS ({ROUTES_SQL.format(minutes=MINUTES, where=f"{VALID} AND {' AND '.join(DRILL_SQL.values())}")})
    {SCORED_SQL}, CAST((SELECT sum(trip_count) FROM r) AS BIGINT) AS total_trips
    FROM r ORDER BY score DESC, PULocationID, DOLocationID LIMIT 10""",
    T,
)
def top_routes_filtered(spark, sf):
    return routes.top_routes(fixtures.trips(spark, sf), DRILL, n=10)


@query(
    "top_routes_boundary",
    f"""r AS ({ROUTES_SQL.format(minutes=MARKS, where=f"{VALID_MARKS} AND {HOUR} IN (7, 8, 18)")}) {SCORED_SQL},
      (SELECT count(*) FROM trips WHERE {HOUR} IN (7, 8, 18)) AS total_trips
    FROM r WHERE trip_count >= 3 ORDER BY score DESC, PULocationID, DOLocationID LIMIT 50""",
    T,
)
def top_routes_boundary(spark, sf):
    chosen = {"pickup_hour": [7, 8, 18]}
    return routes.top_routes_boundary(fixtures.trips(spark, sf), chosen, n=50, min_trips=3)


def _decimals(column: str, places: int) -> str:
    """Halves away from zero, on the decimal value of an average."""
    return f"CAST(round(CAST({column} AS DECIMAL(30, 8)), {places}) AS DOUBLE) AS {column}"


@query(
    "top_routes_rounded",
    f"""r AS ({MARKS_ROUTES}), a AS (SELECT PULocationID, DOLocationID, trip_count, {_decimals('avg_fare', 2)},
      {_decimals('avg_duration_min', 1)}, {_decimals('avg_distance', 2)}, total_revenue FROM r WHERE trip_count >= 10)
    {SCORED_SQL}, (SELECT count(*) FROM trips) AS total_trips FROM a ORDER BY score DESC, PULocationID, DOLocationID LIMIT 20""",
    T,
)
def top_routes_rounded(spark, sf):
    """The twenty best routes with ten trips at least, scored by the averages as they are shown."""
    return routes.top_routes_boundary(fixtures.trips(spark, sf), n=20, min_trips=10, rounded=True)


@query(
    "top_routes_all",
    f"""r AS ({ELAPSED_ROUTES}) {SCORED_SQL}, CAST((SELECT sum(trip_count) FROM r) AS BIGINT) AS total_trips FROM r""",
    T,
)
def top_routes_all(spark, sf):
    return routes.top_routes(fixtures.trips(spark, sf), n=None)


@query(
    "top_routes_ranked",
    f"""r AS ({MARKS_ROUTES}), best AS ({SCORED_SQL}, (SELECT count(*) FROM trips) AS total_trips
      FROM r WHERE trip_count >= 10 ORDER BY score DESC, PULocationID, DOLocationID LIMIT 10)
    SELECT *, CAST(row_number() OVER (ORDER BY score DESC, PULocationID, DOLocationID) AS INTEGER) AS rank FROM best""",
    T,
)
def top_routes_ranked(spark, sf):
    best = routes.top_routes_boundary(fixtures.trips(spark, sf), n=10)
    return routes.with_rank(best, [F.desc("score"), "PULocationID", "DOLocationID"])


REVENUE_SQL = f"""SELECT PULocationID, DOLocationID, {sum_of('total_amount')} AS sum_total_amount,
  count(*) AS count_all FROM trips GROUP BY 1, 2"""


@query("revenue_routes", f"{REVENUE_SQL} ORDER BY sum_total_amount DESC, PULocationID, DOLocationID LIMIT 20", T)
def revenue_routes(spark, sf):
    return routes.top_routes_by_revenue(fixtures.trips(spark, sf))


@query(
    "reconcile_routes",
    f"""a AS ({REVENUE_SQL}), b AS (SELECT * FROM a WHERE count_all >= 30)
    SELECT a.PULocationID, a.DOLocationID, CASE WHEN b.count_all IS NULL THEN 'only_a' ELSE 'same' END AS status,
      a.sum_total_amount AS a_sum_total_amount, a.count_all AS a_count_all,
      b.sum_total_amount AS b_sum_total_amount, b.count_all AS b_count_all
    FROM a LEFT JOIN b USING (PULocationID, DOLocationID)""",
    T,
)
def reconcile_routes(spark, sf):
    """Nested-facet revenue against the route rollup, which leaves out small routes."""
    trips = fixtures.trips(spark, sf)
    nested = routes.top_routes_by_revenue(trips, None)
    rolled = rollups.rollup_routes(trips, min_trips=30).select(
        "PULocationID", "DOLocationID", F.col("total_revenue").alias("sum_total_amount"), F.col("trip_count").alias("count_all")
    )
    return reconcile.reconcile(nested, rolled, routes.ROUTE, ["sum_total_amount", "count_all"])


BUCKET = "CAST(floor(total_amount / 10) * 10 AS INTEGER)"
BUCKETS = f"""b AS (SELECT {BUCKET} AS val, count(*) AS count FROM trips
  WHERE total_amount >= 0 AND total_amount < 100 AND payment_type = 1 GROUP BY 1)"""


@query("fare_buckets", f"{BUCKETS} SELECT val, '$' || val || '-' || (val + 10) AS label, count FROM b", T)
def fare_buckets(spark, sf):
    rows = fixtures.trips(spark, sf).where(compile_filters({"payment_type": [1]}, TRIP_FIELDS))
    return histograms.range_facet(rows, "total_amount")


@query(
    "fare_buckets_filled",
    f"""{BUCKETS.replace('payment_type = 1', 'total_amount > 33')}
    SELECT CAST(r.range AS INTEGER) AS val, '$' || r.range || '-' || (r.range + 10) AS label, coalesce(b.count, 0) AS count
    FROM range(0, 100, 10) r LEFT JOIN b ON b.val = r.range""",
    T,
)
def fare_buckets_filled(spark, sf):
    rows = fixtures.trips(spark, sf).where("total_amount > 33")
    return histograms.range_facet(rows, "total_amount", keep_empty=True)


ISO_DAY = "strftime(tpep_pickup_datetime, '%Y-%m-%d')"
HOURLY_SQL = f"""SELECT {ISO_DAY} AS pickup_date, {HOUR} AS pickup_hour, count(*) AS trip_count,
  {sum_of('total_amount')} AS total_revenue, {sum_of('passenger_count')} AS total_passengers,
  {avg_of('total_amount')} AS avg_fare, {avg_of('trip_distance')} AS avg_distance, {avg_of('tip_amount')} AS avg_tip,
  {avg_of(MINUTES)} AS avg_duration_min,
  strftime(tpep_pickup_datetime, '%Y%m%d') || '_' || lpad(CAST(hour(tpep_pickup_datetime) AS VARCHAR), 2, '0') AS id
  FROM trips GROUP BY ALL"""
ROUTE_ROLLUP_SQL = f"""SELECT PULocationID, DOLocationID, count(*) AS trip_count, {sum_of('total_amount')} AS total_revenue,
  {avg_of('total_amount')} AS avg_fare, {avg_of('trip_distance')} AS avg_distance, {avg_of('tip_amount')} AS avg_tip,
  PULocationID || '_' || DOLocationID AS id FROM trips GROUP BY 1, 2 HAVING count(*) >= {{least}}"""
DAILY_SQL = f"""SELECT {ISO_DAY} AS pickup_date, {DOW} AS pickup_dayofweek, count(*) AS trip_count,
  {sum_of('total_amount')} AS total_revenue, {sum_of('passenger_count')} AS total_passengers,
  {avg_of('total_amount')} AS avg_fare, {avg_of('trip_distance')} AS avg_distance, {avg_of('tip_amount')} AS avg_tip,
  max(total_amount) AS max_fare, max(trip_distance) AS max_distance,
  strftime(tpep_pickup_datetime, '%Y%m%d') AS id, strftime(tpep_pickup_datetime, '%A') AS day_name
  FROM trips GROUP BY ALL"""


def _iso_day(df):
    return df.withColumn("pickup_date", times.fmt_ts("pickup_date"))


@query("rollup_hourly", HOURLY_SQL, T)
def rollup_hourly(spark, sf):
    return _iso_day(rollups.rollup_hourly(fixtures.trips(spark, sf)))


@query("rollup_routes", ROUTE_ROLLUP_SQL.format(least=25), T)
def rollup_routes(spark, sf):
    return rollups.rollup_routes(fixtures.trips(spark, sf), min_trips=25)


@query("rollup_daily", DAILY_SQL, T)
def rollup_daily(spark, sf):
    return _iso_day(rollups.rollup_daily(fixtures.trips(spark, sf)))


BY_MONTH_SQL = f"""SELECT strftime(tpep_pickup_datetime, '%Y%m') AS month, count(*) AS trips,
  {sum_of('total_amount')} AS revenue FROM trips GROUP BY 1"""


@query("by_month", BY_MONTH_SQL, T)
def by_month(spark, sf):
    return rollups.by_month(fixtures.trips(spark, sf))


@query(
    "null_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS nulls,
        (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS percent FROM trips"""
        for c in fixtures.TRIPS
    ),
    T,
)
def null_profile(spark, sf):
    return quality.null_profile(fixtures.trips(spark, sf))


@query(
    "value_ranges",
    """SELECT min(trip_distance) AS min_distance, max(trip_distance) AS max_distance, min(fare_amount) AS min_fare,
      max(fare_amount) AS max_fare, strftime(min(tpep_pickup_datetime), '%Y-%m-%d %H:%M:%S') AS first_pickup,
      strftime(max(tpep_pickup_datetime), '%Y-%m-%d %H:%M:%S') AS last_pickup FROM trips""",
    T,
)
def value_ranges(spark, sf):
    ranges = quality.value_ranges(fixtures.trips(spark, sf))
    for c in ("first_pickup", "last_pickup"):
        ranges = ranges.withColumn(c, times.fmt_ts(c, "yyyy-MM-dd HH:mm:ss"))
    return ranges


DEEP = ["trip_distance", "fare_amount", "tip_amount", "total_amount"]


@query(
    "describe_subset",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round({avg_of(c)}, 6) AS mean,
        round(stddev_samp({c}), 6) AS stddev, min({c}) AS min, max({c}) AS max
        FROM trips WHERE PULocationID = 7 AND trip_distance BETWEEN 1 AND 20"""
        for c in DEEP
    ),
    T,
)
def describe_subset(spark, sf):
    described = quality.describe(deep_subset(spark, sf), DEEP)
    return described.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM trips "
        "WHERE passenger_count IS NOT NULL"
        for a in [*DEEP[:3], "passenger_count"]
        for b in [*DEEP[:3], "passenger_count"]
    ),
    T,
)
def corr_matrix(spark, sf):
    cells = quality.corr_matrix(fixtures.trips(spark, sf), [*DEEP[:3], "passenger_count"])
    return cells.withColumn("corr", F.round("corr", 6))


RATE = "CASE WHEN fare_amount > 0 THEN tip_amount / fare_amount * 100 ELSE 0 END"


@query(
    "tip_by_distance",
    f"""SELECT CASE WHEN trip_distance < 2 THEN '0-2 mi' WHEN trip_distance < 5 THEN '2-5 mi'
      WHEN trip_distance < 10 THEN '5-10 mi' ELSE '10+ mi' END AS distance_bucket, count(*) AS trips,
      {avg_of(RATE)} AS avg_tip_rate, {avg_of('tip_amount')} AS avg_tip, {avg_of('total_amount')} AS avg_total
    FROM trips GROUP BY 1""",
    T,
)
def tip_by_distance(spark, sf):
    return quality.tip_by_distance(fixtures.trips(spark, sf))


def _listed(first: str) -> str:
    return f"""SELECT strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M') AS pickup, round(trip_distance, 1) AS distance,
      round(fare_amount, 2) AS fare, round(tip_amount, 2) AS tip, round(total_amount, 2) AS total
    FROM trips ORDER BY {first} DESC, tpep_pickup_datetime, tpep_dropoff_datetime, trip_distance, fare_amount,
      tip_amount, total_amount LIMIT 10"""


@query("longest_trips", _listed("round(trip_distance, 1)"), T)
def longest_trips(spark, sf):
    return quality.longest_trips(fixtures.trips(spark, sf))


@query("priciest_trips", _listed("round(total_amount, 2)"), T)
def priciest_trips(spark, sf):
    return quality.priciest_trips(fixtures.trips(spark, sf))


KPI_SQL = f"""h AS (SELECT {HOUR} AS hour, count(*) AS n, {sum_of('total_amount')} AS s, {avg_of('total_amount')} AS a
    FROM trips GROUP BY 1),
  d AS ({DAILY_SQL})
SELECT CAST(sum(n) AS BIGINT) AS trips, {sum_of('s')} AS total_revenue,
  (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour,
  round({sum_of('a * n')} / sum(n), 6) AS avg_from_averages, {sum_of('s')} / sum(n) AS avg_fare,
  (SELECT {sum_of('avg_fare')} / count(avg_fare) FROM d) AS mean_daily_avg_fare FROM h"""


@query("kpi_cards", KPI_SQL, T)
def kpi_cards(spark, sf):
    trips = fixtures.trips(spark, sf)
    cards = stats.kpi_cards(stats.stats_by(trips, {}, "pickup_hour"), rollups.rollup_daily(trips))
    return cards.withColumn("avg_from_averages", F.round("avg_from_averages", 6))


SUITE_SQL = {
    "count": "SELECT count(*) AS trips FROM trips",
    "sum_avg": f"""SELECT {sum_of('total_amount')} AS revenue, {avg_of('trip_distance')} AS avg_distance,
      {avg_of('tip_amount')} AS avg_tip FROM trips""",
    "weekday": f"SELECT {DOW} AS weekday, count(*) AS trips, {avg_of('total_amount')} AS avg_amount FROM trips GROUP BY 1",
    "hour": f"SELECT {HOUR} AS hour, count(*) AS trips, {sum_of('total_amount')} AS revenue FROM trips GROUP BY 1",
    "top_locations": "SELECT PULocationID AS value, count(*) AS count FROM trips GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "week": f"""SELECT count(*) AS trips, {avg_of('total_amount')} AS avg_amount FROM trips
      WHERE tpep_pickup_datetime BETWEEN TIMESTAMP '1997-01-09' AND TIMESTAMP '1997-01-16'""",
    "month": BY_MONTH_SQL,
}


def _suite_query(name: str):
    @query(f"bench_{name}", SUITE_SQL[name], T)
    def run(spark, sf):
        return suite.SUITE[name](fixtures.trips(spark, sf), ("1997-01-09", "1997-01-16"))


for _name in SUITE_SQL:
    _suite_query(_name)


@query(
    "fn_dates",
    f"""SELECT trip_order, trip_line, {HOUR} AS hour, {DOW} AS sun1,
      CAST(isodow(tpep_pickup_datetime) AS INTEGER) AS mon1, CAST(isodow(tpep_pickup_datetime) - 1 AS INTEGER) AS mon0,
      {ISO_DAY} AS day, strftime(tpep_pickup_datetime, '%Y%m') AS month,
      strftime(date_trunc('hour', tpep_pickup_datetime), '%Y-%m-%d %H:%M') AS hour_start,
      strftime(tpep_pickup_datetime, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(tpep_pickup_datetime, '%A') AS day_name,
      CAST(epoch(tpep_pickup_datetime) AS BIGINT) AS parsed_seconds,
      strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S') AS from_ms FROM trips""",
    T,
)
def fn_dates(spark, sf):
    iso = times.iso_z(PICKUP)
    ms = F.unix_millis(F.col(PICKUP).cast("timestamp"))
    return fixtures.trips(spark, sf).select(
        "trip_order",
        "trip_line",
        times.hour_of(PICKUP).alias("hour"),
        times.weekday(PICKUP).alias("sun1"),
        times.weekday(PICKUP, "mon1").alias("mon1"),
        times.weekday(PICKUP, "mon0").alias("mon0"),
        times.fmt_ts(times.day_of(PICKUP)).alias("day"),
        times.month_key(PICKUP).alias("month"),
        times.fmt_ts(times.hour_start(PICKUP), "yyyy-MM-dd HH:mm").alias("hour_start"),
        iso.alias("iso"),
        times.fmt_ts(PICKUP, "EEEE").alias("day_name"),
        F.unix_seconds(times.parse_iso(iso)).alias("parsed_seconds"),
        times.fmt_ts(times.from_epoch_ms(ms), "yyyy-MM-dd HH:mm:ss").alias("from_ms"),
    )


@query("fn_duration", f"SELECT trip_order, trip_line, {MINUTES} AS elapsed, {MARKS} AS marks FROM trips", T)
def fn_duration(spark, sf):
    return fixtures.trips(spark, sf).select(
        "trip_order", "trip_line", quality.duration().alias("elapsed"), quality.duration("boundary").alias("marks")
    )


def _fixed_sql(x: str, places: int = 2) -> str:
    return f"CAST(CAST(round_even(({x}) * {10**places}, 0) / {10**places} AS DECIMAL(38,{places})) AS VARCHAR)"


def _humanise_sql(v: str) -> str:
    steps = [("1e12", "T"), ("1e9", "G"), ("1e6", "M"), ("1e3", "K")]
    cases = " ".join(
        f"WHEN abs({v}) >= {s} THEN CASE WHEN {v} < 0 THEN '-' ELSE '' END || {_fixed_sql(f'abs({v}) / {s}')} || ' {u}'"
        for s, u in steps
    )
    return f"CASE {cases} WHEN abs({v}) >= 1 OR {v} = 0 THEN {_fixed_sql(v)} ELSE {_fixed_sql(v, 4)} END"


def _bytes_sql(v: str) -> str:
    steps = [(1024**4, "TiB"), (1024**3, "GiB"), (1024**2, "MiB"), (1024, "KiB")]
    cases = " ".join(f"WHEN {v} >= {s} THEN {_fixed_sql(f'{v} / {s}.0::DOUBLE')} || ' {u}'" for s, u in steps)
    return f"CASE {cases} ELSE {_fixed_sql(v)} || ' B' END"


SIZED = {
    "number": "(total_amount - 100) * power(10, trip_order % 14 - 4)",
    "n": "CAST(power(10, trip_order % 9) AS BIGINT) * PULocationID",
}


@query(
    "fn_humanise",
    f"""sized AS (SELECT trip_order, trip_line, total_amount, {SIZED['number']} AS number, {SIZED['n']} AS n FROM trips)
    SELECT trip_order, trip_line, {_humanise_sql('number')} AS number,
      CASE WHEN n >= 1000000 THEN CAST(CAST(floor(n / 1e6 * 10 + 0.5) / 10 AS DECIMAL(38,1)) AS VARCHAR) || 'M'
        WHEN n >= 1000 THEN CAST(CAST(floor(n / 1e3 + 0.5) AS BIGINT) AS VARCHAR) || 'k'
        ELSE CAST(n AS VARCHAR) END AS compact,
      {_bytes_sql('CAST(n AS DOUBLE)')} AS bytes, n * 8 AS bits,
      CASE WHEN total_amount >= 300 THEN 'red' WHEN total_amount >= 100 THEN 'yellow' ELSE 'green' END AS colour
    FROM sized""",
    T,
)
def fn_humanise(spark, sf):
    sized = fixtures.trips(spark, sf).selectExpr(
        "trip_order", "trip_line", "total_amount", f"{SIZED['number']} AS number", f"{SIZED['n']} AS n"
    )
    return sized.select(
        "trip_order",
        "trip_line",
        formats.fmt_num("number").alias("number"),
        formats.compact("n").alias("compact"),
        formats.readable_bytes("n").alias("bytes"),
        formats.to_bits("n").alias("bits"),
        formats.status_band("total_amount", [(None, "green"), (100, "yellow"), (300, "red")]).alias("colour"),
    )


@query(
    "fn_labels",
    """SELECT trip_order, trip_line, '$' || PULocationID || '-' || (PULocationID + 10) AS money,
      PULocationID || '-' || (PULocationID + 200) || 'ms' AS ms,
      lpad(CAST(hour(tpep_pickup_datetime) AS VARCHAR), 2, '0') || ':00' AS hour,
      PULocationID || '_' || DOLocationID AS id,
      CASE WHEN trip_distance < 2 THEN 'near' WHEN trip_distance < 20 THEN 'mid' ELSE 'far' END AS band FROM trips""",
    T,
)
def fn_labels(spark, sf):
    return fixtures.trips(spark, sf).select(
        "trip_order",
        "trip_line",
        formats.bucket_label("PULocationID", 10, "money").alias("money"),
        formats.bucket_label("PULocationID", 200, "ms").alias("ms"),
        formats.bucket_label(times.hour_of(PICKUP), 1, "hour").alias("hour"),
        formats.make_id("PULocationID", "DOLocationID").alias("id"),
        formats.band("trip_distance", [2, 20], ["near", "mid", "far"]).alias("band"),
    )
