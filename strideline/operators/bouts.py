"""Bouts: maximal runs of values in a range, and the algebra of their intervals.

Bout tables have subject_id, start_ts and end_ts (and more columns where said). Bouts that only touch don't overlap.
Overlap joins meet on the subject and a coarse interval of time, so that they stay hash joins: each bout is listed in all
intervals that it reaches, and a pair counts only in the interval where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DAY, KEYS, MINUTE, SECOND, instant, micros

INTERVAL = ["subject_id", "start_ts", "end_ts"]


def in_us(bouts: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """subject_id with start and end in microseconds; other columns stay."""
    rest = [c for c in bouts.columns if c not in INTERVAL]
    return bouts.select("subject_id", micros("start_ts").alias(a), micros("end_ts").alias(b), *rest)


def in_ts(rows: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    rest = [c for c in rows.columns if c not in ("subject_id", a, b)]
    return rows.select("subject_id", instant(a).alias("start_ts"), instant(b).alias("end_ts"), *rest)


def bouts(samples: DataFrame, low: float, high: float, respect_missing: bool = False) -> DataFrame:
    """Runs of samples with low <= value <= high: subject_id, channel, start_ts, end_ts.

    A bout ends at the first sample after it, at the end of a record one last sampling interval after the last sample
    (at once if there is only one). Masked samples keep their value and count unless respect_missing is set.
    """
    order = Window.partitionBy(*KEYS).orderBy("us")
    inside = F.coalesce(F.col("value").between(float(low), float(high)), F.lit(False))
    inside = inside & ~F.col("missing") if respect_missing else inside
    gap = F.coalesce(F.col("us") - F.lag("us").over(order), F.lit(0))
    rows = samples.select(*KEYS, micros("ts").alias("us"), inside.alias("inside"))
    rows = rows.select(*KEYS, "us", "inside", F.coalesce(F.lead("us").over(order), F.col("us") + gap).alias("next"), (F.col("inside") & ~F.coalesce(F.lag("inside").over(order), F.lit(False))).cast("int").alias("first"))
    rows = rows.withColumn("run", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.where("inside").groupBy(*KEYS, "run").agg(F.min("us").alias("a"), F.max("next").alias("b"))
    return runs.select(*KEYS, instant("a").alias("start_ts"), instant("b").alias("end_ts"))


def length(unit: int = SECOND) -> Column:
    """Length of a bout in units of so many microseconds."""
    return (micros("end_ts") - micros("start_ts")) / unit


def limit_lengths(rows: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    """Bouts of least to most microseconds, both included."""
    us = micros("end_ts") - micros("start_ts")
    rows = rows if least is None else rows.where(us >= least)
    return rows if most is None else rows.where(us <= most)


def total_time(rows: DataFrame, *keys: str, unit: int = SECOND) -> DataFrame:
    """Sum of lengths for each subject; negative lengths count as such."""
    return rows.groupBy("subject_id", *keys).agg((F.sum(micros("end_ts") - micros("start_ts")) / unit).alias("total"), F.count("*").alias("n"))


def _overlaps(left: DataFrame, right: DataFrame, coarse: int) -> DataFrame:
    """Pairs of rows a..b and c..d of one subject with a strictly positive overlap."""
    parts = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / coarse), F.floor((F.col(y) - 1) / coarse)))
    left = left.where("a < b").withColumn("part", parts("a", "b"))
    right = right.where("c < d").withColumn("part", parts("c", "d"))
    pairs = left.join(right, ["subject_id", "part"])
    start = F.greatest("a", "c")
    return pairs.where((start < F.least("b", "d")) & (F.col("part") == F.floor(start / coarse))).drop("part")


def intersection(left: DataFrame, right: DataFrame, coarse: int = DAY) -> DataFrame:
    """The overlap of every pair of bouts of a subject, not merged."""
    pairs = _overlaps(in_us(left.select(*INTERVAL)), in_us(right.select(*INTERVAL), "c", "d"), coarse)
    return pairs.select("subject_id", instant(F.greatest("a", "c")).alias("start_ts"), instant(F.least("b", "d")).alias("end_ts"))


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """All time in either, as bouts that neither overlap nor touch."""
    order = Window.partitionBy("subject_id").orderBy("a", "b")
    rows = in_us(left.select(*INTERVAL).union(right.select(*INTERVAL))).where("a < b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("subject_id", "a", "b", (F.col("a") > F.coalesce(before, F.col("a") - 1)).cast("int").alias("first"))
    rows = rows.withColumn("run", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return in_ts(rows.groupBy("subject_id", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run"))


def complement(rows: DataFrame, periods: DataFrame, keep_empty: bool = True) -> DataFrame:
    """A period without its bouts, which are sorted and don't overlap.

    periods: subject_id, period_start, period_end. Pieces of no or negative length are kept unless keep_empty is False;
    they make totals add up. A subject without bouts has the whole period.
    """
    ends = periods.select("subject_id", micros("period_start").alias("lo"), micros("period_end").alias("hi"))
    own = ends.join(in_us(rows.select(*INTERVAL)), "subject_id", "left")
    order = Window.partitionBy("subject_id").orderBy("a")
    before = own.where("a IS NOT NULL").select("subject_id", F.coalesce(F.lag("b").over(order), F.col("lo")).alias("x"), F.col("a").alias("y"))
    tail = own.groupBy("subject_id", "lo", "hi").agg(F.max("b").alias("b")).select("subject_id", F.coalesce("b", "lo").alias("x"), F.col("hi").alias("y"))
    pieces = before.unionByName(tail)
    return in_ts(pieces if keep_empty else pieces.where("x < y"), "x", "y")


def confusion(left: DataFrame, right: DataFrame, periods: DataFrame) -> DataFrame:
    """Seconds and number of overlaps of a0b0, a1b0, a0b1 and a1b1 (in a bout of left or right, or not) for each subject.

    Neither list's bouts overlap each other. Time outside of all bouts counts within the period only. One sweep over the
    sorted starts and ends of both lists; a stretch between two of them is one overlap of a bout or gap of either list.
    """
    edge = lambda rows, name, a, b: rows.select("subject_id", F.explode(F.array(F.struct(F.col(a).alias("us"), F.lit(1).alias(name)), F.struct(F.col(b).alias("us"), F.lit(-1).alias(name)))).alias("e")).select("subject_id", "e.*")
    ends = periods.select("subject_id", micros("period_start").alias("lo"), micros("period_end").alias("hi"))
    found = edge(in_us(left.select(*INTERVAL)).where("a < b"), "a", "a", "b")
    found = found.unionByName(edge(in_us(right.select(*INTERVAL)).where("a < b"), "b", "a", "b"), allowMissingColumns=True)
    found = found.unionByName(edge(ends.where("lo < hi"), "p", "lo", "hi"), allowMissingColumns=True)
    at = found.groupBy("subject_id", "us").agg(*(F.sum(F.coalesce(k, F.lit(0))).alias(k) for k in "abp"), (F.count("a") + F.count("b") > 0).alias("own"))
    order = Window.partitionBy("subject_id").orderBy("us")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    swept = at.select("subject_id", (F.lead("us").over(order) - F.col("us")).alias("us"), "own", (F.col("p") > 0).alias("opens"), *((F.sum(k).over(up) > 0).alias(k) for k in "abp"))
    cell = F.concat(F.lit("a"), F.col("a").cast("int"), F.lit("b"), F.col("b").cast("int"))
    counted = swept.where(F.col("us").isNotNull() & (F.col("p") | (F.col("a") & F.col("b")))).withColumn("cell", cell)
    fresh = F.col("own") | (F.col("opens") & (F.col("cell") != "a1b1"))
    total = counted.groupBy("subject_id", "cell").agg((F.sum("us") / SECOND).alias("seconds"), F.count_if(fresh).alias("n"))
    grid = periods.select("subject_id").distinct().withColumn("cell", F.explode(F.array(*map(F.lit, ("a0b0", "a1b0", "a0b1", "a1b1")))))
    return grid.join(total, ["subject_id", "cell"], "left").na.fill({"seconds": 0.0, "n": 0})


def involved(rows: DataFrame, windows: DataFrame, coarse: int = DAY) -> DataFrame:
    """The bouts that overlap any window (subject_id, start_ts, end_ts) of their subject, each once; other columns stay."""
    keyed = in_us(rows).withColumn("row", F.monotonically_increasing_id())
    hit = _overlaps(keyed.select("subject_id", "a", "b"), in_us(windows.select(*INTERVAL), "c", "d"), coarse).select("subject_id", "a", "b").distinct()
    return in_ts(keyed.drop("row").join(hit, ["subject_id", "a", "b"], "left_semi")).select(rows.columns)


def frame(rows: DataFrame) -> DataFrame:
    """First start and last end of each subject's bouts: period_start, period_end."""
    return rows.groupBy("subject_id").agg(F.min("start_ts").alias("period_start"), F.max("end_ts").alias("period_end"))


def piecewise_statistics(rows: DataFrame, width: int, percentages: list[int] | None = None, period: tuple[Column, Column] | None = None) -> DataFrame:
    """window_statistics of windows of width microseconds, by default from the start of the day of a subject's first bout
    to the end of the day of its last."""
    ends = frame(rows)
    if period is None:
        day = lambda c: F.floor(micros(c) / DAY) * DAY
        lo, hi = day("period_start"), day("period_end") + DAY - 1
    else:
        lo, hi = micros(period[0]), micros(period[1])
    starts = ends.select("subject_id", F.explode(F.sequence(lo.cast("long"), hi.cast("long") - 1, F.lit(width).cast("long"))).alias("a"))
    return window_statistics(rows, starts.select("subject_id", instant("a").alias("start_ts"), instant(F.col("a") + width).alias("end_ts")), percentages)


def summary_statistics(rows: DataFrame, percentages: list[int] | None = None, period: tuple[Column, Column] | None = None) -> DataFrame:
    """window_statistics of one window a subject: all its bouts, or a period."""
    ends = frame(rows)
    ends = ends if period is None else ends.select("subject_id", period[0].alias("period_start"), period[1].alias("period_end"))
    return window_statistics(rows, ends.select("subject_id", F.col("period_start").alias("start_ts"), F.col("period_end").alias("end_ts")), percentages)


def sdx(rows: DataFrame, percentages: list[int], keys: tuple[str, ...] = ("subject_id",), lengths: Column | None = None) -> DataFrame:
    """sd<p>: the least whole number of minutes L >= 1 so that bouts of up to L make floor(p % of all bout time) or more.

    L goes no further than the whole minutes of the longest bout; null where the target isn't reached by then.
    """
    rows = rows.select(*keys, (lengths if lengths is not None else length(MINUTE)).alias("m"))
    rows = rows.groupBy(*keys, F.ceil("m").alias("l")).agg(F.sum("m").alias("m"), F.max("m").alias("most"))
    whole, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("l")
    rows = rows.select(*keys, F.col("l").cast("long").alias("l"), F.sum("m").over(up).alias("cum"), F.sum("m").over(whole).alias("total"), F.floor(F.max("most").over(whole)).alias("limit"))
    target = lambda p: F.floor(F.col("total") / 100 * p)
    level = lambda p: F.when((target(p) <= 0) & (F.col("limit") >= 1), F.lit(1).cast("long")).when((F.col("cum") >= target(p)) & (F.greatest("l", F.lit(1)) <= F.col("limit")), F.greatest("l", F.lit(1)))
    return rows.groupBy(*keys).agg(*(F.min(level(p)).alias(f"sd{p}") for p in percentages))


def window_statistics(rows: DataFrame, windows: DataFrame, percentages: list[int] | None = None, coarse: int = DAY) -> DataFrame:
    """Per window (subject_id, start_ts, end_ts): seconds of bouts inside it, their number, their mean (seconds by number).

    With percentages also sd<p> of the bouts that reach into it, at their full length. -1 stands for no bout, 0 in n.
    """
    listed = in_us(windows.select(*INTERVAL).distinct())
    pairs = _overlaps(listed, in_us(rows.select(*INTERVAL), "c", "d"), coarse)
    inside = F.sum(F.least("b", "d") - F.greatest("a", "c"))
    done = pairs.groupBy("subject_id", "a", "b").agg((inside / SECOND).alias("bout_sum"), (inside / F.count("*") / SECOND).alias("bout_mean"), F.count("*").alias("bout_n"))
    shown = [F.coalesce("bout_sum", F.lit(-1.0)).alias("bout_sum"), F.coalesce("bout_mean", F.lit(-1.0)).alias("bout_mean"), F.coalesce("bout_n", F.lit(0)).alias("bout_n")]
    if percentages:
        done = done.join(sdx(pairs, percentages, ("subject_id", "a", "b"), (F.col("d") - F.col("c")) / MINUTE), ["subject_id", "a", "b"])
        shown += [F.coalesce(f"sd{p}", F.lit(-1)).alias(f"sd{p}") for p in percentages]
    return in_ts(listed.join(done, ["subject_id", "a", "b"], "left").select("subject_id", "a", "b", *shown))


def channel_bouts(samples: DataFrame, windows: DataFrame, ranges: list[tuple[float, ...]], signal: str = "value") -> DataFrame:
    """The bouts statistic: seconds and number of bouts of each value range (and least seconds) in each window; 0 for none."""
    from ..spec import Bouts, names

    out = windows.select(*INTERVAL).distinct()
    for spec in ranges:
        found = limit_lengths(bouts(samples, *spec[:2]), *(int(s * SECOND) for s in spec[2:3]))
        total, n = names(signal, [Bouts((tuple(spec),))])
        own = window_statistics(found, windows).select(*INTERVAL, F.greatest("bout_sum", F.lit(0.0)).alias(total), F.col("bout_n").alias(n))
        out = out.join(own, INTERVAL)
    return out


def raster(rows: DataFrame, periods: DataFrame, step: int, inside: float = 1, outside: float = 0) -> DataFrame:
    """Samples of inside or outside every step microseconds of a period, by whether a bout contains the time (ends included)."""
    ends = periods.select("subject_id", micros("period_start").alias("lo"), micros("period_end").alias("hi"))
    count = F.floor((F.col("hi") - F.col("lo")) / step)
    grid = ends.where(count > 0).select("subject_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i")).select("subject_id", (F.col("lo") + F.col("i") * step).alias("us"))
    own = ends.join(in_us(rows.select(*INTERVAL)), "subject_id")
    first = F.greatest(F.ceil((F.col("a") - F.col("lo")) / step), F.lit(0))
    last = F.least(F.floor((F.col("b") - F.col("lo")) / step), count - 1)
    hit = own.where(first <= last).select("subject_id", "lo", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("i")).select("subject_id", (F.col("lo") + F.col("i") * step).alias("us")).distinct()
    marked = grid.join(hit.withColumn("hit", F.lit(True)), ["subject_id", "us"], "left")
    return marked.select("subject_id", instant("us").alias("ts"), F.when(F.col("hit"), float(inside)).otherwise(float(outside)).alias("value"))
