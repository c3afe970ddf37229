"""Growth of counters that may start again at zero, over any ranges of time, overlapping ones too.

Readings are summed up by *panes*, short spans that divide every range: first and last reading and the growth between
them. Neighbouring panes combine by adding the step from one's last reading to the other's first, so running sums over the
panes of a block of time, and over the blocks of a series, give the growth between any two panes as a difference. A range
then needs only its first and last pane that has readings. A task sorts the readings of one pane, the panes of one block
or the blocks of one series, never all readings of a series or of a range.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_on

#: Seconds of a block, and of the longest pane.
BLOCK, LONGEST_PANE = 86_400, 300


def _step(previous: Column, value: Column) -> Column:
    """Growth between two readings; a fall means the counter began again at zero."""
    return F.when(previous.isNull(), F.lit(0)).when(value < previous, value).otherwise(value - previous)


def counter_panes(
    df: DataFrame, series: list[str], pane_seconds: int, ts: str = "ts", value: str = "value", ties: tuple[str, ...] = ()
) -> DataFrame:
    """A row per series and pane that has readings: pane (its start), first, last, growth between them, readings.

    Missing values are no readings. ``ties`` order readings of the same time.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    start = (seconds - F.pmod(seconds, F.lit(int(pane_seconds)))).alias("pane")
    rows = df.where(F.col(value).isNotNull()).select(*series, start, F.struct(ts, *ties).alias("_order"), F.col(value).alias("_value"))
    in_pane = Window.partitionBy(*series, "pane").orderBy("_order")
    steps = rows.withColumn("_step", _step(F.lag("_value").over(in_pane), F.col("_value")))
    return steps.groupBy(*series, "pane").agg(
        F.sum("_step").alias("growth"),
        F.min_by("_value", "_order").alias("first"),
        F.max_by("_value", "_order").alias("last"),
        F.count("*").alias("readings"),
    )


def _running(panes: DataFrame, series: list[str]) -> DataFrame:
    """Panes with running growth since the start of their block, and of the blocks before as ``base``.

    ``before`` is the growth up to the last reading before the pane, ``start`` up to its first, ``upto`` up to its last.
    """
    panes = panes.withColumn("_block", F.floor(F.col("pane") / BLOCK))
    in_block = Window.partitionBy(*series, "_block").orderBy("pane")
    entering = _step(F.lag("last").over(in_block), F.col("first"))
    panes = panes.withColumn("_entering", entering).withColumn("_grown", F.col("_entering") + F.col("growth"))
    so_far = F.sum("_grown").over(in_block.rowsBetween(Window.unboundedPreceding, -1))
    panes = panes.withColumn("_so_far", so_far)
    blocks = panes.groupBy(*series, "_block").agg(
        F.min_by("first", "pane").alias("_first"), F.max_by("last", "pane").alias("_last"), F.sum("_grown").alias("_total")
    )
    by_block = Window.partitionBy(*series).orderBy("_block")
    blocks = blocks.withColumn("_cross", _step(F.lag("_last").over(by_block), F.col("_first")))
    all_before = F.sum(F.col("_cross") + F.col("_total")).over(by_block.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*series, "_block", "_cross", (F.coalesce(all_before, F.lit(0)) + F.col("_cross")).alias("base"))
    met = join_on(panes, blocks, [*series, "_block"])
    start = F.coalesce("_so_far", F.lit(0)) + F.col("_entering")
    return met.select(
        *series,
        "pane",
        "readings",
        "base",
        F.coalesce("_so_far", -F.col("_cross")).alias("before"),
        start.alias("start"),
        (start + F.col("growth")).alias("upto"),
    )


def counter_ranges(
    df: DataFrame,
    series: list[str],
    range_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    value: str = "value",
    ties: tuple[str, ...] = (),
    entering: bool = False,
) -> DataFrame:
    """Growth over the ``range_seconds`` before each multiple of ``step_seconds``: (series.., range_end, increase).

    A range holds its start and not its end. Only ranges with two readings have a row, and only steps between readings
    of the range count; with ``entering`` the step from the reading before the range counts too, and one reading will do.
    """
    if range_seconds < 1 or step_seconds < 1:
        raise ValueError("a range and a step have one second at least")
    pane_seconds = gcd(range_seconds, step_seconds, LONGEST_PANE)
    panes = _running(counter_panes(df, series, pane_seconds, ts, value, ties), series)
    first = F.col("pane") - F.pmod("pane", F.lit(step_seconds)) + F.lit(step_seconds)
    last = F.col("pane") + F.lit(range_seconds)
    ends = panes.where(first <= last).withColumn("range_end", F.explode(F.sequence(first, last, F.lit(step_seconds).cast("long"))))
    grown = ends.groupBy(*series, "range_end").agg(
        F.min_by(F.struct("base", F.col("before" if entering else "start").alias("growth")), "pane").alias("_from"),
        F.max_by(F.struct("base", F.col("upto").alias("growth")), "pane").alias("_to"),
        F.sum("readings").alias("_readings"),
    )
    # bases cancel before anything is added, so that ranges inside a block lose no digits to a long history
    increase = (F.col("_to.growth") - F.col("_from.growth")) + (F.col("_to.base") - F.col("_from.base"))
    return grown.where("_readings > 1" if not entering else "true").select(*series, "range_end", increase.alias("increase"))


def counter_range_rates(
    df: DataFrame,
    series: list[str],
    range_seconds: int,
    step_seconds: int,
    ts: str = "ts",
    value: str = "value",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """Growth per second of each range, not extrapolated to its edges: (series.., range_end, rate)."""
    grown = counter_ranges(df, series, range_seconds, step_seconds, ts, value, ties)
    return grown.select(*series, "range_end", (F.col("increase") / float(range_seconds)).alias("rate"))


def counter_increase(
    df: DataFrame, series: list[str], window_seconds: int, ts: str = "ts", value: str = "value", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Growth per series and time window: (series.., window_start, increase); windows start at whole multiples.

    The step into a window, from the last reading before it, counts for the window.
    """
    grown = counter_ranges(df, series, window_seconds, window_seconds, ts, value, ties, entering=True)
    return grown.select(*series, (F.col("range_end") - window_seconds).alias("window_start"), "increase")


def counter_rate(
    df: DataFrame, series: list[str], window_seconds: int, ts: str = "ts", value: str = "value", ties: tuple[str, ...] = ()
) -> DataFrame:
    """Growth per second in each window, not extrapolated to the edges of the window."""
    grown = counter_increase(df, series, window_seconds, ts, value, ties)
    return grown.select(*series, "window_start", (F.col("increase") / float(window_seconds)).alias("rate"))


def cpu_utilisation(
    df: DataFrame, instance: str, series: list[str], window_seconds: int, ts: str = "ts", value: str = "value",
    ties: tuple[str, ...] = (),
) -> DataFrame:
    """1 - average idle rate of the series of an instance, per window."""
    rates = counter_rate(df, [instance, *series], window_seconds, ts, value, ties)
    return rates.groupBy(instance, "window_start").agg((1 - F.avg("rate")).alias("utilisation"))


def cpu_utilisation_ranges(
    df: DataFrame, instance: str, series: list[str], range_seconds: int, step_seconds: int, ts: str = "ts",
    value: str = "value", ties: tuple[str, ...] = (),
) -> DataFrame:
    """1 - average idle rate of the series of an instance over the range before each step: (instance, range_end, utilisation)."""
    rates = counter_range_rates(df, [instance, *series], range_seconds, step_seconds, ts, value, ties)
    return rates.groupBy(instance, "range_end").agg((1 - F.avg("rate")).alias("utilisation"))
