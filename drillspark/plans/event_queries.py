"""Monitoring events: facets, histograms, alerts, percentiles and word search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import codes, formats, times
from ..functions.text import tokens
from ..operators import alerts, facets, histograms, quantiles, search, stats
from ..operators.filters import EVENT_FIELDS
from .registry import avg_of, query

M = ("monitoring",)
HOUR = "CAST(hour(event_ts) AS INTEGER)"
ALERT = "severity IN ('error', 'critical')"
TS = "strftime(event_ts, '%Y-%m-%d %H:%M:%S')"


def _text_ts(df, *columns):
    for c in columns:
        df = df.withColumn(c, times.fmt_ts(c, "yyyy-MM-dd HH:mm:ss"))
    return df


@query("facet_host", "SELECT host AS value, count(*) AS count FROM monitoring GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", M)
def facet_host(spark, sf):
    return facets.facet(fixtures.monitoring(spark, sf), "host", limit=50)


@query("by_severity", "SELECT severity AS value, count(*) AS count FROM monitoring GROUP BY 1", M)
def by_severity(spark, sf):
    return facets.facet(fixtures.monitoring(spark, sf), "severity")


CHOSEN = {"severity": ["error", "critical"], "event_hour": [1, 2, 13], "response_time_ms": ["[0 TO 600]"]}
CHOSEN_SQL = {
    "severity": ALERT,
    "event_hour": f"{HOUR} IN (1, 2, 13)",
    "response_time_ms": "response_time_ms BETWEEN 0 AND 600",
}
FACETS = ["host", "service", "severity", "event_type", "status_code", "event_hour"]


def _facets_sql() -> str:
    parts = [f"SELECT '*' AS field, '*' AS value, count(*) AS count FROM monitoring WHERE {' AND '.join(CHOSEN_SQL.values())}"]
    for name in FACETS:
        where = " AND ".join(sql for field, sql in CHOSEN_SQL.items() if field != name)
        value = HOUR if name == "event_hour" else name
        parts.append(
            f"SELECT '{name}' AS field, CAST({value} AS VARCHAR) AS value, count(*) AS count FROM monitoring "
            f"WHERE {where} GROUP BY ALL"
        )
    return f"""counted AS ({' UNION ALL '.join(parts)}), top AS (SELECT *,
      CAST(row_number() OVER (PARTITION BY field ORDER BY count DESC, value) AS INTEGER) AS rank FROM counted)
    SELECT * FROM top WHERE rank <= 30"""


@query("facets_events", _facets_sql(), M)
def facets_events(spark, sf):
    return facets.facets(fixtures.monitoring(spark, sf), CHOSEN, FACETS, EVENT_FIELDS)


@query(
    "event_stats_host",
    f"""SELECT host, count(*) AS count, {avg_of('response_time_ms')} AS avg_response_time_ms,
      CAST(sum(bytes_sent) AS DOUBLE) AS sum_bytes_sent FROM monitoring GROUP BY 1 ORDER BY count DESC, host LIMIT 50""",
    M,
)
def event_stats_host(spark, sf):
    return stats.event_stats(fixtures.monitoring(spark, sf), {}, "host", limit=50)


@query(
    "event_stats_hour",
    f"""SELECT {HOUR} AS event_hour, count(*) AS count, {avg_of('response_time_ms')} AS avg_response_time_ms,
      CAST(sum(bytes_sent) AS DOUBLE) AS sum_bytes_sent FROM monitoring WHERE {ALERT} GROUP BY 1""",
    M,
)
def event_stats_hour(spark, sf):
    return stats.event_stats(fixtures.monitoring(spark, sf), {"severity": ["error", "critical"]}, "event_hour")


@query("facet_event_hour", f"SELECT {HOUR} AS event_hour, count(*) AS count FROM monitoring GROUP BY 1", M)
def facet_event_hour(spark, sf):
    return stats.facet_hour(fixtures.monitoring(spark, sf))


HOURS = "strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S')"


@query("events_per_hour", f"SELECT {HOURS} AS hour, count(*) AS count FROM monitoring GROUP BY 1", M)
def events_per_hour(spark, sf):
    return _text_ts(histograms.events_per_hour(fixtures.monitoring(spark, sf)), "hour")


@query(
    "events_per_hour_severity",
    f"SELECT {HOURS} AS hour, severity, count(*) AS count FROM monitoring GROUP BY 1, 2",
    M,
)
def events_per_hour_severity(spark, sf):
    return _text_ts(histograms.events_per_hour(fixtures.monitoring(spark, sf), by="severity"), "hour")


@query(
    "events_per_hour_filled",
    f"""c AS (SELECT date_trunc('hour', event_ts) AS hour, count(*) AS count FROM monitoring
      WHERE severity = 'critical' GROUP BY 1),
    h AS (SELECT unnest(generate_series((SELECT min(hour) FROM c), (SELECT max(hour) FROM c), INTERVAL 1 HOUR)) AS hour)
    SELECT strftime(h.hour, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(c.count, 0) AS count FROM h LEFT JOIN c USING (hour)""",
    M,
)
def events_per_hour_filled(spark, sf):
    rows = fixtures.monitoring(spark, sf).where("severity = 'critical'")
    return _text_ts(histograms.events_per_hour(rows, fill=True), "hour")


def _histogram(name: str, interval: int):
    low = f"CAST(floor(response_time_ms / {interval}) * {interval} AS BIGINT)"

    @query(
        name,
        f"""b AS (SELECT {low} AS val, count(*) AS count FROM monitoring GROUP BY 1)
        SELECT val, val || '-' || (val + {interval}) || 'ms' AS label, count FROM b""",
        M,
    )
    def run(spark, sf):
        return histograms.histogram(fixtures.monitoring(spark, sf), "response_time_ms", interval)


_histogram("response_hist_200", 200)
_histogram("response_hist_100", 100)


@query(
    "top_alerts",
    f"""chosen AS (SELECT * FROM monitoring WHERE {HOUR} BETWEEN 0 AND 12),
    a AS (SELECT host, service, count(*) AS error_count, coalesce({avg_of('cpu_percent')}, 0) AS avg_cpu,
        coalesce({avg_of('memory_percent')}, 0) AS avg_memory, coalesce({avg_of('response_time_ms')}, 0) AS avg_response_ms
      FROM chosen WHERE {ALERT} GROUP BY 1, 2 ORDER BY error_count DESC, host, service LIMIT 50),
    l AS (SELECT *, row_number() OVER (PARTITION BY host, service ORDER BY event_ts DESC, event_id DESC) AS n
      FROM chosen WHERE {ALERT})
    SELECT a.*, l.message AS latest_message, {TS} AS latest_timestamp, l.severity AS latest_severity,
      (SELECT count(*) FROM chosen) AS total_events
    FROM a JOIN l ON a.host = l.host AND a.service = l.service AND l.n = 1""",
    M,
)
def top_alerts(spark, sf):
    found = alerts.top_alerts(fixtures.monitoring(spark, sf), {"event_hour": list(range(13))}, n=50)
    return _text_ts(found, "latest_timestamp")


@query(
    "host_overview",
    f"""SELECT host, count(*) AS events, count(*) FILTER (WHERE {ALERT}) AS errors, {avg_of('cpu_percent')} AS avg_cpu,
      {avg_of('memory_percent')} AS avg_memory,
      count(*) FILTER (WHERE {ALERT}) * 100.0::DOUBLE / count(*) AS error_percent
    FROM monitoring GROUP BY 1 ORDER BY events DESC, host LIMIT 10""",
    M,
)
def host_overview(spark, sf):
    return alerts.host_overview(fixtures.monitoring(spark, sf))


@query(
    "response_percentiles",
    " UNION ALL ".join(
        f"SELECT {p}.0::DOUBLE AS percent, quantile_disc(response_time_ms, {p / 100}) AS value FROM monitoring"
        for p in (50, 75, 90, 95, 99)
    ),
    M,
)
def response_percentiles(spark, sf):
    return quantiles.percentiles(fixtures.monitoring(spark, sf), "response_time_ms")


#: Latin words: letters with single marks between them, numbers likewise, both joined by underscores.
LATIN = r"_*(?:\pL(?:[\pL\pM]|[.:''’·]\pL)*|\p{Nd}(?:\p{Nd}|[.,;''’]\p{Nd})*)(?:_*(?:\pL(?:[\pL\pM]|[.:''’·]\pL)*|\p{Nd}(?:\p{Nd}|[.,;''’]\p{Nd})*))*_*"


def _words(column: str, *words: str) -> str:
    return f"list_has_any(regexp_extract_all(lower({column}), '{LATIN}'), {list(words)})"


SHOWN = "event_id, host, service, severity, event_type, message, cpu_percent, memory_percent, response_time_ms, status_code"


@query(
    "text_match",
    f"""SELECT {SHOWN}, {TS} AS event_ts FROM monitoring WHERE severity IN ('error', 'warning')
      AND {_words('message', 'timeout', 'query')} ORDER BY monitoring.event_ts DESC, event_id LIMIT 500""",
    M,
)
def text_match(spark, sf):
    hits = search.search(fixtures.monitoring(spark, sf), "Timeout QUERY", {"severity": ["error", "warning"]}, size=500)
    return _text_ts(hits, "event_ts")


@query(
    "text_match_page",
    """h AS (SELECT event_id, message, event_ts, count(*) OVER () AS total FROM monitoring
      WHERE list_has_any(string_split(lower(message), ' '), ['192.168.7.9', 'access_log', 'can’t']))
    SELECT event_id, message, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, total FROM h
    ORDER BY h.event_ts DESC, event_id LIMIT 50""",
    M,
)
def text_match_page(spark, sf):
    """Addresses, names with underscores and words with apostrophes are words; hits come with their total."""
    found = search.search_page(fixtures.monitoring(spark, sf), "192.168.7.9 access_log can’t 168", size=50, columns=["message", "event_ts"])
    return _text_ts(found, "event_ts")


@query("text_match_total", f"SELECT count(*) AS total FROM monitoring WHERE {_words('message', 'connection', 'slow')}", M)
def text_match_total(spark, sf):
    return search.total_hits(fixtures.monitoring(spark, sf), "connection, slow!")


@query(
    "text_match_documents",
    f"SELECT lang, count(*) AS documents FROM documents WHERE {_words('text', 'license', 'data', 'les')} GROUP BY 1",
)
def text_match_documents(spark, sf):
    """Word search over whole texts in four languages."""
    hits = search.match(fixtures.table(spark, sf, "documents"), "text", "license data les")
    return hits.groupBy("lang").agg(F.count("*").alias("documents"))


@query("text_prefix", f"SELECT doc_id, source, lang FROM documents WHERE len(list_filter(regexp_extract_all(lower(text), '{LATIN}'), lambda w: starts_with(w, 'lic'))) > 0")
def text_prefix(spark, sf):
    return search.match_prefix(fixtures.table(spark, sf, "documents"), "text", "lic").select("doc_id", "source", "lang")


@query("text_count", "SELECT count(*) AS documents FROM documents")
def text_count(spark, sf):
    return search.count_documents(fixtures.table(spark, sf, "documents"))


@query(
    "text_tokens",
    f"""w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{LATIN}')) AS word FROM documents)
    SELECT lang, count(*) AS words, count(DISTINCT word) AS vocabulary FROM w WHERE word <> '' GROUP BY 1""",
)
def text_tokens(spark, sf):
    """Words and different words per language, over whole texts."""
    words = fixtures.table(spark, sf, "documents").select("lang", F.explode(tokens("text")).alias("word"))
    per_word = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return per_word.groupBy("lang").agg(F.sum("n").alias("words"), F.count("*").alias("vocabulary"))


@query(
    "fn_strings",
    """SELECT doc_id, CASE WHEN length(source) > 6 THEN substr(source, 1, 3) || '...' ELSE source END AS short,
      sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS id FROM documents""",
)
def fn_strings(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", formats.shorten("source", 6).alias("short"), formats.row_id("doc_id", "lang").alias("id")
    )


@query(
    "fn_status",
    f"""s AS (SELECT host, CASE severity WHEN 'info' THEN 'green' WHEN 'warning' THEN 'yellow' ELSE 'red' END AS colour,
        status_code, severity FROM monitoring)
    SELECT host, status_code, CASE status_code WHEN 200 THEN '200 OK' WHEN 404 THEN '404 Not Found'
        ELSE '500 Internal Error' END AS status,
      CASE severity WHEN 'info' THEN 'Info' WHEN 'warning' THEN 'Warning' WHEN 'error' THEN 'Error'
        ELSE 'Critical' END AS severity,
      CAST(sum(CASE colour WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END) AS BIGINT) AS code,
      CASE min(CASE colour WHEN 'green' THEN 1 WHEN 'yellow' THEN 2 ELSE 3 END)
        WHEN 1 THEN 'GREEN' WHEN 2 THEN 'YELLOW' ELSE 'RED' END AS text
    FROM s GROUP BY host, status_code, s.severity""",
    M,
)
def fn_status(spark, sf):
    colour = F.when(F.col("severity") == "info", "green").when(F.col("severity") == "warning", "yellow").otherwise("red")
    single = F.when(F.col("colour") == "green", 1).when(F.col("colour") == "yellow", 2).otherwise(3)
    grouped = fixtures.monitoring(spark, sf).withColumn("colour", colour).groupBy("host", "status_code", "severity")
    coded = grouped.agg(formats.encode_status("colour", F.lit(1)).alias("code"), F.min(single).alias("worst"))
    return coded.select(
        "host",
        "status_code",
        codes.http_label("status_code").alias("status"),
        codes.severity_label("severity").alias("severity"),
        "code",
        codes.status_text("worst").alias("text"),
    )


@query(
    "status_band",
    """SELECT host, strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M:%S') AS hour,
      CASE WHEN avg(memory_percent) / 100 >= 0.9 THEN 'red' WHEN avg(memory_percent) / 100 >= 0.7 THEN 'yellow'
        ELSE 'green' END AS memory,
      CASE WHEN count(*) >= 4 THEN 'green' WHEN count(*) >= 3 THEN 'yellow' ELSE 'red' END AS reporting
    FROM monitoring GROUP BY ALL""",
    M,
)
def status_band(spark, sf):
    per_hour = fixtures.monitoring(spark, sf).groupBy("host", times.hour_start("event_ts").alias("hour"))
    loads = per_hour.agg((F.avg("memory_percent") / 100).alias("memory"), F.count("*").alias("n"))
    return _text_ts(loads, "hour").select(
        "host",
        "hour",
        formats.status_band("memory", [(None, "green"), (0.7, "yellow"), (0.9, "red")]).alias("memory"),
        formats.status_band("n", [(None, "red"), (3, "yellow"), (4, "green")]).alias("reporting"),
    )
