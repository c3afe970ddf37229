import datetime as dt

import pytest
from pyspark.sql import functions as F

from drillspark.functions import codes, exact, formats, labels, text, times


def one(spark, value, kind, function):
    return spark.createDataFrame([(value,)], f"x {kind}").select(function("x").alias("y")).first().y


@pytest.mark.parametrize(
    "value, shown",
    [
        (20542120681.0, "20.54 G"),
        (1.5e12, "1.50 T"),
        (-2_340_000.0, "-2.34 M"),
        (1234.0, "1.23 K"),
        (0.0, "0.00"),
        (1.0, "1.00"),
        (999.999, "1000.00"),
        (0.12346, "0.1235"),
        (-0.5, "-0.5000"),
    ],
)
def test_fmt_num(spark, value, shown):
    assert one(spark, value, "double", formats.fmt_num) == shown


@pytest.mark.parametrize("value, shown", [(999, "999"), (1000, "1k"), (12_345, "12k"), (1_250_000, "1.3M"), (0, "0")])
def test_compact(spark, value, shown):
    assert one(spark, value, "bigint", formats.compact) == shown


@pytest.mark.parametrize("value, shown", [(12, "12.00 B"), (1536, "1.50 KiB"), (5 * 1024**3, "5.00 GiB")])
def test_readable_bytes(spark, value, shown):
    assert one(spark, value, "bigint", formats.readable_bytes) == shown


def test_shorten_and_domain(spark):
    assert one(spark, "node1.cloud.local:9100", "string", formats.shorten) == "node1.cloud...."
    assert one(spark, "exactly15chars_", "string", formats.shorten) == "exactly15chars_"
    assert one(spark, "node1.nodes.example", "string", lambda c: formats.strip_domain(c, ".nodes.example")) == "node1"


def test_status_band_and_codes(spark):
    steps = [(None, "green"), (0.7, "yellow"), (0.9, "red")]
    for value, colour in [(0.0, "green"), (0.7, "yellow"), (0.9, "red"), (2.0, "red")]:
        assert one(spark, value, "double", lambda c: formats.status_band(c, steps)) == colour
    assert one(spark, 9, "int", codes.payment_label) == "Typ 9"
    assert one(spark, 2, "int", codes.payment_label) == "Bargeld"
    assert one(spark, 418, "int", codes.http_label) == "418"
    assert one(spark, 1, "int", lambda c: codes.status_text(c, codes.UP_STATUS)) == "UP"


def test_weekday_conventions(spark):
    monday, sunday = dt.datetime(2023, 1, 9, 5), dt.datetime(2023, 1, 15, 5)
    for convention, first, last in [("sun1", 2, 1), ("mon1", 1, 7), ("mon0", 0, 6)]:
        assert one(spark, monday, "timestamp_ntz", lambda c: times.weekday(c, convention)) == first
        assert one(spark, sunday, "timestamp_ntz", lambda c: times.weekday(c, convention)) == last


def test_durations(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2023, 1, 1, 10, 0, 59), dt.datetime(2023, 1, 1, 10, 1, 1))], "a timestamp_ntz, b timestamp_ntz"
    )
    row = df.select(times.minutes_elapsed("a", "b").alias("e"), times.minute_boundaries("a", "b").alias("m")).first()
    assert row.e == pytest.approx(2 / 60) and row.m == 1


def test_parse_iso(spark):
    parse = lambda c: F.date_format(times.parse_iso(c), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "2024-01-15T14:32:00Z", "string", parse) == "2024-01-15 14:32:00"
    assert one(spark, "2024-01-15", "string", parse) is None
    assert one(spark, "not a time at all...", "string", parse) is None


def test_text(spark):
    assert one(spark, "TCP-connection  Timeout, 42!", "string", text.tokens) == ["tcp", "connection", "timeout", "42"]
    find = lambda query: lambda c: text.has_any_word(c, query)
    assert one(spark, "Connection reset", "string", find("timeout connection"))
    assert not one(spark, "Connections reset", "string", find("connection"))
    assert one(spark, "anything", "string", find(""))
    assert not one(spark, "anything", "string", find("!?"))
    assert one(spark, "Größe überschritten", "string", find("GRÖSSE größe"))
    assert one(spark, "a testing word", "string", lambda c: text.has_word_prefix(c, "Test"))
    assert not one(spark, "a contest", "string", lambda c: text.has_word_prefix(c, "test"))
    assert not one(spark, None, "string", find("x"))


def test_label_functions(spark):
    assert one(spark, "node1.cloud.local:9100", "string", labels.host_of) == "node1"
    assert one(spark, "localhost:9100", "string", labels.host_of) == "localhost"
    assert one(spark, ".odd", "string", labels.host_of) == ""
    assert one(spark, None, "string", labels.host_of) == ""
    assert one(spark, "a_b_c", "string", labels.name_prefixes) == ["a", "a_b", "a_b_c"]
    assert one(spark, "a_", "string", labels.name_prefixes) == ["a", "a_"]
    for quantile, suffix in [("0.5", "_p50"), ("0.999", "_p999"), ("1", "_p100"), ("0.25", "_p025"), (None, "")]:
        assert one(spark, quantile, "string", labels.quantile_suffix) == suffix
    many = {"__name__": "x", "job": "j", "le": "5", "handler": "/select all", "cpu": "0", "core": "c"}
    assert one(spark, many, "map<string,string>", labels.label_suffix) == "cpu_0_handler__select_all"


def test_exact_sums_do_not_depend_on_order(spark):
    values = [0.1, 1e9 + 0.2, -3.7, 2e12, 0.000001, float("nan"), None] * 50
    results = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)
        results.add(tuple(df.agg(exact.exact_sum("x"), exact.exact_avg("x")).first()))
    assert len(results) == 1
    total = 50 * (0.1 + 1e9 + 0.2 - 3.7 + 2e12 + 0.000001)
    assert next(iter(results))[0] == pytest.approx(total, rel=1e-15)
    assert next(iter(results))[1] == pytest.approx(total / 250, rel=1e-15)


def test_exact_sum_beyond_one_long(spark):
    """The sum of units exceeds 64 bits."""
    df = spark.range(4).select(F.lit(9e12).alias("x"))
    assert df.agg(exact.exact_sum("x").alias("s")).first().s == 3.6e13


@pytest.mark.parametrize("places", [0, 1, 2, 6])
def test_places(spark, places):
    df = spark.createDataFrame([(1.25,), (2.5,), (-0.125,)], "x double")
    total = df.agg(exact.decimal_sum("x", places).alias("s")).first().s
    assert float(total) == sum(round(v * 10**places) for v in (1.25, 2.5, -0.125)) / 10**places


def test_exact_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert tuple(df.agg(exact.exact_sum("x"), exact.exact_avg("x")).first()) == (None, None)


def test_row_id_is_stable(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "k int, v string").select(formats.row_id("k", "v").alias("i"))
    ids = [r.i for r in df.collect()]
    assert ids[0] == ids[1] != ids[2]


def test_minutes_do_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # whose clocks change on both days
    try:
        for day in ("2023-03-26", "2023-10-29"):
            start, end = (F.lit(f"{day} {t}").cast("timestamp_ntz") for t in ("01:50:30", "03:10:10"))
            row = spark.range(1).select(times.minutes_elapsed(start, end).alias("a"), times.minute_boundaries(start, end).alias("b")).first()
            assert (round(row.a, 6), row.b) == (round(80 - 20 / 60, 6), 80)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "given, words",
    [
        ("GET 192.168.7.9 access_log", ["get", "192.168.7.9", "access_log"]),
        ("I can't, he won’t: 'quoted'", ["i", "can't", "he", "won’t", "quoted"]),
        ("1,204 rows; 3.5s; v2.0.1-rc1 a:b x/y", ["1,204", "rows", "3.5s", "v2.0.1", "rc1", "a:b", "x", "y"]),
        ("end. next, e.g. U.S.A.", ["end", "next", "e.g", "u.s.a"]),
        ("__init__ _ __ a__b", ["__init__", "a__b"]),
        ("Größe été naïve cafe\u0301s", ["größe", "été", "naïve", "cafe\u0301s"]),
        ("漢字 ひら カタカナ한국어", ["漢", "字", "ひ", "ら", "カタカナ", "한국어"]),
        ("a@b.example 50% #tag", ["a", "b.example", "50", "tag"]),
        ("x" * 600, ["x" * 255, "x" * 255, "x" * 90]),
        ("", []),
        ("?! --", []),
    ],
)
def test_words(spark, given, words):
    assert one(spark, given, "string", text.tokens) == words


def test_long_words_are_read_in_one_go(spark):
    """A word of any length takes no stack, and the words of a text are searched once."""
    assert one(spark, "x" * 300_000 + ", end", "string", text.tokens)[-3:] == ["x" * 255, "x" * (300_000 % 255), "end"]
    frame = spark.range(1).select(F.col("id").cast("string").alias("t")).select(text.tokens("t"))
    plan = frame._jdf.queryExecution().analyzed().toString().split("\n")[0]
    assert plan.count("regexp_extract_all") <= 2, plan  # in the expression and in its name


@pytest.mark.parametrize(
    "given, words",
    [
        ("a,b 1,2 a'b a' 'b a.b. x: y:z x;y 1;2", ["a", "b", "1,2", "a'b", "a", "b", "a.b", "x", "y:z", "x", "y", "1;2"]),
        ("abc123é4 e\u0301\u00ad_x ab\u0301c 9\u066b1", ["abc123é4", "e\u0301\u00ad_x", "ab\u0301c", "9\u066b1"]),
        ("dé.ja d\u0301.\u0301a mot\u200bsuite", ["dé.ja", "d\u0301.\u0301a", "mot", "suite"]),
        ("слово, Ünïon-größe λόγος", ["слово", "ünïon", "größe", "λόγος"]),
    ],
)
def test_ends_of_words(spark, given, words):
    assert one(spark, given, "string", text.tokens) == words


def test_words_are_found_whole(spark):
    find = lambda query: lambda c: text.has_any_word(c, query)
    assert not one(spark, "from 192.168.7.9", "string", find("192"))
    assert one(spark, "from 192.168.7.9", "string", find("192.168.7.9, 10.0.0.1"))
    assert not one(spark, "the access_log", "string", find("access"))
    assert one(spark, "the access_log", "string", lambda c: text.has_word_prefix(c, "acc"))
    assert not one(spark, "the access_log", "string", lambda c: text.has_word_prefix(c, "log"))
    assert one(spark, "I CAN'T", "string", find("can't"))
