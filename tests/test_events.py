import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from drillspark.operators import alerts, histograms, quantiles, search, stats

SCHEMA = (
    "event_id int, event_ts timestamp_ntz, host string, service string, event_type string, severity string, "
    "message string, cpu_percent double, memory_percent double, response_time_ms int, status_code int, bytes_sent bigint"
)


def make_events(n=2000):
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 3 * 1440, 7))
        rows.append(
            (
                i,
                ts,
                "hot" if rnd.random() < 0.4 else f"h{rnd.randrange(4)}",
                rnd.choice(["web", "db"]),
                "log",
                rnd.choices(["info", "warning", "error", "critical"], [70, 20, 8, 2])[0],
                rnd.choice(["Connection timeout", "All well", "Slow query: timeout"]),
                rnd.choice([None, 10.0, 55.5]),
                float(rnd.randrange(100)),
                rnd.randrange(2000),
                200,
                rnd.randrange(10**6),
            )
        )
    return rows


DATA = make_events()
ROWS = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r)) for r in DATA]


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(5).cache()


def test_top_alerts(ev):
    got = alerts.top_alerts(ev, {"event_hour": [1, 2, 3, 4, 5, 6, 7, 8]}, n=4).collect()
    chosen = [e for e in ROWS if 1 <= e["event_ts"].hour <= 8]
    groups = defaultdict(list)
    for e in chosen:
        if e["severity"] in ("error", "critical"):
            groups[e["host"], e["service"]].append(e)
    expected = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))[:4]
    assert {(r.host, r.service): r.error_count for r in got} == {k: len(v) for k, v in expected}
    for r in got:
        latest = max(groups[r.host, r.service], key=lambda e: (e["event_ts"], e["event_id"]))
        assert (r.latest_message, r.latest_timestamp, r.latest_severity) == (
            latest["message"],
            latest["event_ts"],
            latest["severity"],
        )
        cpu = [e["cpu_percent"] for e in groups[r.host, r.service] if e["cpu_percent"] is not None]
        assert r.avg_cpu == pytest.approx(sum(cpu) / len(cpu) if cpu else 0)
        assert r.total_events == len(chosen)


def test_alerts_come_whole(ev):
    pairs = {(e["host"], e["service"]) for e in ROWS if e["severity"] in ("error", "critical")}
    assert alerts.top_alerts(ev, n=500).count() == alerts.top_alerts(ev, n=None).count() == len(pairs)


def test_host_overview(ev):
    got = {r.host: r for r in alerts.host_overview(ev).collect()}
    for host, r in got.items():
        mine = [e for e in ROWS if e["host"] == host]
        bad = sum(e["severity"] in ("error", "critical") for e in mine)
        assert (r.events, r.errors) == (len(mine), bad)
        assert r.error_percent == pytest.approx(100 * bad / len(mine))


def test_filled_hours(ev):
    few = ev.where("event_id % 97 = 0")
    got = [(r.hour, r["count"]) for r in histograms.events_per_hour(few, fill=True).collect()]
    counts = Counter(e["event_ts"].replace(minute=0) for e in ROWS if e["event_id"] % 97 == 0)
    first, last = min(counts), max(counts)
    hours = [first + dt.timedelta(hours=h) for h in range(int((last - first).total_seconds() // 3600) + 1)]
    assert got == [(h, counts.get(h, 0)) for h in hours] and len(hours) > len(counts)


def test_histogram(ev):
    got = {r.label: r["count"] for r in histograms.histogram(ev, "response_time_ms", 200).collect()}
    counts = Counter(e["response_time_ms"] // 200 * 200 for e in ROWS)
    assert got == {f"{v}-{v + 200}ms": n for v, n in counts.items()}


def test_search(ev):
    hits = search.search(ev, "Timeout nothing", {"severity": ["error"]}, size=7).collect()
    matching = [e for e in ROWS if e["severity"] == "error" and "timeout" in e["message"].lower()]
    newest = sorted(matching, key=lambda e: (-e["event_ts"].timestamp(), e["event_id"]))[:7]
    assert [r.event_id for r in hits] == [e["event_id"] for e in newest]
    assert search.total_hits(ev, "timeout", {"severity": ["error"]}).first().total == len(matching)
    assert search.search(ev, "", size=10**6).count() == search.search(ev, "", size=None).count() == len(ROWS)


def test_hourly_average_counts_present_values_only(ev):
    got = {r.event_hour: r for r in stats.event_stats(ev, {}, "event_hour").collect()}
    for hour, r in got.items():
        mine = [e for e in ROWS if e["event_ts"].hour == hour]
        assert r["count"] == len(mine)
        assert r.avg_response_time_ms == pytest.approx(sum(e["response_time_ms"] for e in mine) / len(mine))
        assert r.sum_bytes_sent == sum(e["bytes_sent"] for e in mine)


def smallest_reaching(values, p):
    values = sorted(values)
    rank = max(1, -(-int(round(p * 100)) * len(values) // 100))
    return values[rank - 1]


@pytest.mark.parametrize("column", ["response_time_ms", "memory_percent"])
def test_quantiles_of_groups_of_very_different_size(ev, column):
    got = {(r.host, r.p): r.value for r in quantiles.quantiles(ev, column, [0.01, 0.5, 0.95, 1.0], ["host"]).collect()}
    assert len(got) == 5 * 4
    for (host, p), value in got.items():
        assert value == smallest_reaching([e[column] for e in ROWS if e["host"] == host], p)


def test_quantiles_of_one_value_and_of_missing_values(spark):
    df = spark.createDataFrame([(1, 5.0)] * 300 + [(1, None), (2, None), (None, 7.0)], "k int, v double")
    got = quantiles.quantiles(df, "v", [0.5], ["k"]).collect()
    assert {tuple(r) for r in got} == {(1, 0.5, 5.0), (None, 0.5, 7.0)}
