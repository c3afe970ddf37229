import datetime as dt
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from drillspark.operators import facets, filters, histograms, lookups, quality, reconcile, rollups, routes, stats, suite
from drillspark.operators.filters import TRIP_FIELDS, compile_filters, selection_to_filters
from trips_data import SCHEMA, as_dicts, make_trips

DATA = make_trips()
TRIPS = as_dicts(DATA)


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(6).cache()


def spark_day(t):
    return t["tpep_pickup_datetime"].isoweekday() % 7 + 1


PREDICATES = {
    "pickup_hour": lambda t: t["tpep_pickup_datetime"].hour in (7, 18, 19),
    "payment_type": lambda t: t["payment_type"] in (1, 2),
    "total_amount": lambda t: 10 <= t["total_amount"] <= 40 or t["total_amount"] >= 80,
}
CHOSEN = {"pickup_hour": [7, 18, 19], "payment_type": [1, 2], "total_amount": ["[10 TO 40]", "[80 TO *]"]}


def test_filters_match_plain_python(trips):
    found = {r.id for r in trips.where(compile_filters(CHOSEN, TRIP_FIELDS)).collect()}
    assert found == {t["id"] for t in TRIPS if all(p(t) for p in PREDICATES.values())}


@pytest.mark.parametrize(
    "chosen",
    [None, {}, {"unknown": [1]}, {"total_amount": []}, {"id": [1]}],
)
def test_filters_that_filter_nothing(trips, chosen):
    assert trips.where(compile_filters(chosen, TRIP_FIELDS)).count() == len(DATA)


def test_values_and_ranges_of_one_field_are_alternatives(trips):
    chosen = {"PULocationID": [3, "[7 TO 8]"]}
    expected = [t for t in TRIPS if t["PULocationID"] in (3, 7, 8)]
    assert trips.where(compile_filters(chosen, TRIP_FIELDS)).count() == len(expected)


@pytest.mark.parametrize("text", ["[a TO b]", "[zero TO 10]", "[1 TO 2", "[1 TO 2 TO 3]", "[nan TO 3]", "[1 TO 2023-01-01]", "[2023-01-01T00:00:00+01:00 TO *]"])
def test_unreadable_ranges_are_refused(trips, text):
    with pytest.raises(ValueError):
        compile_filters({"total_amount": [5, text]}, TRIP_FIELDS)


def test_ranges_of_times(trips):
    ts = "tpep_pickup_datetime"
    fields = filters.Fields(frozenset({ts}))
    times = sorted(t[ts] for t in TRIPS if t[ts] is not None)
    low, high = times[len(times) // 4], times[len(times) // 2]
    chosen = {ts: [f"[{low.isoformat()} TO {high.isoformat()}Z]"]}
    assert trips.where(compile_filters(chosen, fields)).count() == sum(low <= t <= high for t in times)
    day = low.date().isoformat()
    assert trips.where(compile_filters({ts: [f"[* TO {day}]"]}, fields)).count() == sum(t.isoformat() <= f"{day}T00:00:00" for t in times)


def test_exclude_leaves_out_one_field(trips):
    expected = [t for t in TRIPS if PREDICATES["pickup_hour"](t) and PREDICATES["total_amount"](t)]
    assert trips.where(compile_filters(CHOSEN, TRIP_FIELDS, exclude="payment_type")).count() == len(expected)


def test_selection():
    chosen = selection_to_filters(["payment_type:1", "payment_type:2", "total_amount:[0 TO 10]", "x", "flag:Y"])
    assert chosen == {"payment_type": [1, 2], "total_amount": ["[0 TO 10]"], "flag": ["Y"]}


def test_unknown_group_field_is_refused(trips):
    with pytest.raises(ValueError):
        stats.stats_by(trips, {}, "id")


def test_count_filtered(trips):
    n = sum(all(p(t) for p in PREDICATES.values()) for t in TRIPS)
    assert tuple(filters.count_filtered(trips, CHOSEN, TRIP_FIELDS).first()) == (n, True)
    assert tuple(filters.count_filtered(trips, CHOSEN, TRIP_FIELDS, cap=n - 1).first()) == (n, False)
    assert tuple(filters.count_filtered(trips, {"PULocationID": [99]}, TRIP_FIELDS).first()) == (0, False)


def test_drill_rows_show_all_hits_beside_the_first(trips):
    shown = filters.drill_rows(trips, CHOSEN, TRIP_FIELDS, ["id", "pickup_hour"], [F.asc("id")], 3).collect()
    hits = [t for t in TRIPS if all(p(t) for p in PREDICATES.values())]
    assert [r.id for r in shown] == [t["id"] for t in hits[:3]]
    assert {r.num_found for r in shown} == {len(hits)}


def facet_values(field, t):
    return {"pickup_hour": t["tpep_pickup_datetime"].hour, "pickup_dayofweek": spark_day(t)}.get(field, t.get(field))


def test_facets_ignore_their_own_filter(trips):
    names = ["pickup_hour", "pickup_dayofweek", "payment_type", "PULocationID", "nonsense"]
    got = defaultdict(dict)
    for r in facets.facets(trips, CHOSEN, names, TRIP_FIELDS).collect():
        got[r.field][r.value] = r["count"]
    assert set(got) == {"*", *names[:-1]}
    assert got["*"] == {"*": sum(all(p(t) for p in PREDICATES.values()) for t in TRIPS)}
    for name in names[:-1]:
        kept = [t for t in TRIPS if all(p(t) for f, p in PREDICATES.items() if f != name)]
        counts = Counter(str(facet_values(name, t)) for t in kept if facet_values(name, t) is not None)
        assert got[name] == counts


def test_no_hits_are_shown_as_zero(trips):
    got = facets.facets(trips, {"PULocationID": [99]}, ["payment_type"], TRIP_FIELDS).collect()
    assert [tuple(r) for r in got] == [("*", "*", 0, 1)]


def test_facet_limit_and_sort(trips):
    top = facets.facets(trips, {}, ["pickup_hour"], TRIP_FIELDS, limit=4).where("field <> '*'").orderBy("rank").collect()
    counts = Counter(t["tpep_pickup_datetime"].hour for t in TRIPS)
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], str(kv[0])))[:4]
    assert [(r.value, r["count"]) for r in top] == [(str(h), n) for h, n in expected]
    by_value = facets.facets(trips, {}, ["pickup_hour"], TRIP_FIELDS, sort="value").where("field <> '*'").orderBy("rank")
    assert [r.value for r in by_value.collect()] == [str(h) for h in range(24)]


def test_facet_of_one_field_skips_missing_values(trips):
    got = {r.value: r["count"] for r in facets.facet(trips, "PULocationID").collect()}
    assert got == Counter(t["PULocationID"] for t in TRIPS if t["PULocationID"] is not None)


def test_weekdays_run_from_monday_to_sunday(trips):
    counts = facets.facet(trips, F.dayofweek("tpep_pickup_datetime"), limit=None)
    assert [r.value for r in facets.order_weekdays(counts, "value").collect()] == [2, 3, 4, 5, 6, 7, 1]


def plain_routes(valid, minutes):
    groups = defaultdict(list)
    for t in TRIPS:
        if valid(t):
            groups[t["PULocationID"], t["DOLocationID"]].append(t)
    scored = []
    for key, ts in groups.items():
        n, fare = len(ts), sum(t["total_amount"] for t in ts) / len(ts)
        duration = sum(minutes(t) for t in ts) / n
        scored.append((key, n, n * fare / duration if duration > 0 else 0))
    return sorted(scored, key=lambda s: -s[2])


def elapsed(t):
    return (t["tpep_dropoff_datetime"] - t["tpep_pickup_datetime"]).total_seconds() / 60


def marks(t):
    floor = [t[c].replace(second=0) for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")]
    return (floor[1] - floor[0]).total_seconds() / 60


def is_valid(t):
    return t["total_amount"] > 0 and 1 < elapsed(t) < 120 and t["PULocationID"] is not None


def test_top_routes(trips):
    best = routes.top_routes(trips, n=6).orderBy(F.desc("score")).collect()
    expected = plain_routes(is_valid, elapsed)[:6]
    assert [((r.PULocationID, r.DOLocationID), r.trip_count) for r in best] == [e[:2] for e in expected]
    assert [r.score for r in best] == pytest.approx([e[2] for e in expected])
    assert {r.total_trips for r in best} == {sum(map(is_valid, TRIPS))}


def test_top_routes_honour_all_filters(trips):
    best = routes.top_routes(trips, {"payment_type": [2], "pickup_hour": [5]}, n=1).first()
    kept = [t for t in TRIPS if is_valid(t) and t["payment_type"] == 2 and t["tpep_pickup_datetime"].hour == 5]
    assert best.total_trips == len(kept)


def test_top_routes_boundary(trips):
    valid = lambda t: t["total_amount"] > 0 and 1 <= marks(t) <= 120
    expected = [e for e in plain_routes(valid, marks) if e[1] >= 10][:100]
    best = routes.top_routes_boundary(trips, n=100).orderBy(F.desc("score")).collect()
    assert [((r.PULocationID, r.DOLocationID), r.trip_count) for r in best] == [e[:2] for e in expected]
    assert {r.total_trips for r in best} == {len(TRIPS)}
    shown = routes.top_routes_boundary(trips, n=3, rounded=True).first()
    assert shown.avg_fare == round(shown.avg_fare, 2)
    assert shown.score == pytest.approx(shown.trip_count * shown.avg_fare / shown.avg_duration_min)


def test_rank(trips):
    ranked = routes.with_rank(routes.top_routes(trips, n=4), [F.desc("score")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]


def test_revenue_agrees_with_rollup(trips):
    nested = routes.top_routes_by_revenue(trips, None)
    rolled = rollups.rollup_routes(trips, 1).selectExpr(
        "PULocationID", "DOLocationID", "total_revenue AS sum_total_amount", "trip_count AS count_all"
    )
    compared = reconcile.reconcile(nested, rolled, routes.ROUTE, ["sum_total_amount", "count_all"])
    assert {r.status for r in compared.select("status").distinct().collect()} == {"same"}


def test_reconcile_tells_what_differs(spark, rows):
    a = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (3, 6), (None, 8)], "k int, v int")
    got = {r.k: r.status for r in reconcile.reconcile(a, b, ["k"], ["v"]).collect()}
    assert got == {1: "same", 2: "only_a", 3: "only_b", None: "differs"}


def test_clean_report(trips):
    kept = [
        t
        for t in TRIPS
        if 0 < t["trip_distance"] < 100 and 0 < t["fare_amount"] < 500 and t["passenger_count"] and t["passenger_count"] <= 6
    ]
    r = quality.clean_report(trips).first()
    assert (r.rows_before, r.rows_after, r.rows_removed) == (len(TRIPS), len(kept), len(TRIPS) - len(kept))
    assert quality.clean_trips(trips).count() == len(kept)


def test_validity_limits(spark):
    base = dt.datetime(2023, 1, 1, 10, 0, 30)
    ends = [base + dt.timedelta(seconds=s) for s in (60, 61, 7199, 7200, 30, 29)]
    df = spark.createDataFrame(
        [(i, base, e, 5.0, 1, 1) for i, e in enumerate(ends)],
        "id int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, total_amount double, "
        "PULocationID int, DOLocationID int",
    )
    assert [r.id for r in quality.valid_trips(df).orderBy("id").collect()] == [1, 2]
    assert [r.id for r in quality.valid_trips(df, "boundary").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_rollups_add_up(trips):
    hourly, daily = rollups.rollup_hourly(trips), rollups.rollup_daily(trips)
    cents = round(sum(t["total_amount"] for t in TRIPS), 2)
    for rollup in (hourly, daily, rollups.by_month(trips).withColumnsRenamed({"trips": "trip_count", "revenue": "total_revenue"})):
        r = rollup.agg(F.sum("trip_count").alias("n"), F.sum("total_revenue").alias("s")).first()
        assert r.n == len(TRIPS) and r.s == pytest.approx(cents)
    assert hourly.select("id").distinct().count() == hourly.count()
    first = daily.where("pickup_date = date'2023-01-02'").first()
    assert (first.id, first.day_name, first.pickup_dayofweek) == ("20230102", "Monday", 2)


def test_share_and_cards(trips):
    by_hour = stats.with_share(stats.by_hour(trips), "trips").collect()
    assert sum(r.share_percent for r in by_hour) == pytest.approx(100)
    assert max(r.bar for r in by_hour) == 20
    cards = stats.kpi_cards(stats.stats_by(trips, {}, "pickup_hour"), rollups.rollup_daily(trips)).first()
    counts = Counter(t["tpep_pickup_datetime"].hour for t in TRIPS)
    assert cards.peak_hour == min(h for h, n in counts.items() if n == max(counts.values()))
    assert cards.avg_fare == pytest.approx(sum(t["total_amount"] for t in TRIPS) / len(TRIPS))


def test_range_buckets(trips):
    counts = Counter(int(t["total_amount"] // 10) * 10 for t in TRIPS if 0 <= t["total_amount"] < 100)
    got = {r.val: (r.label, r["count"]) for r in histograms.range_facet(trips, "total_amount").collect()}
    assert got == {v: (f"${v}-{v + 10}", n) for v, n in counts.items()}
    few = histograms.range_facet(trips.where("total_amount > 95"), "total_amount", keep_empty=True).collect()
    assert [r.val for r in few] == list(range(0, 100, 10)) and few[0]["count"] == 0


def test_profile(trips):
    nulls = {r.column: r.nulls for r in quality.null_profile(trips).collect()}
    for column in ("passenger_count", "PULocationID", "id"):
        assert nulls[column] == sum(t[column] is None for t in TRIPS)
    cells = {(r.a, r.b): r.corr for r in quality.corr_matrix(trips, ["fare_amount", "tip_amount", "total_amount"]).collect()}
    assert len(cells) == 9 and cells["fare_amount", "fare_amount"] == pytest.approx(1)
    assert cells["tip_amount", "fare_amount"] == cells["fare_amount", "tip_amount"]


def test_zone_names(spark, tmp_path, trips):
    path = tmp_path / "zones.json"
    path.write_text('{"1": {"name": "Alpha", "borough": "North", "short": "N"}, "2": {"name": "Beta", "borough": "South", "short": "S"}}')
    zones = lookups.read_zones(spark, str(path))
    counted = trips.groupBy("PULocationID").count()
    named = {r.PULocationID: r for r in lookups.with_zone(counted, zones, "PULocationID", "pu").collect()}
    assert (named[1].pu_name, named[1].pu_label, named[1].pu_borough) == ("Alpha", "Alpha (N)", "North")
    assert (named[5].pu_name, named[5].pu_label, named[5].pu_borough, named[5].pu_short) == ("Zone 5", "Zone 5", "Unknown", "N/A")
    assert len(named) == counted.count()


def test_suite_is_timed(trips):
    timed = suite.bench_suite(trips).collect()
    assert len(timed) == 7 and all(r.seconds > 0 and r.rows_per_second > 0 for r in timed)
