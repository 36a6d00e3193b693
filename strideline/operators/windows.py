"""Statistics over tumbling, whole-record, given and sliding windows.

A window is half-open. Windows without samples stay. With last_sample=True a window that begins exactly at a record's last
timestamp is empty unless the record has one timestamp only, as users of such results expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DAY, KEYS, instant, micros
from ..spec import Bigrams, Percentiles, aggregates, names, rendered

#: A summary's window goes this far beyond the last sample.
BEYOND = 1111 * DAY


def _ready(samples: DataFrame) -> DataFrame:
    return samples.select(*KEYS, "value", "missing", micros("ts").alias("us"))


def _ends(rows: DataFrame) -> DataFrame:
    """First and last microsecond of each record."""
    return rows.groupBy(*KEYS).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def _aggregated(rows: DataFrame, statistics: list, signal: str, *keys: str, more: tuple[Column, ...] = ()) -> DataFrame:
    """The statistics of each group of keys. Order-dependent requests sort a group, which can spill, and hold no values."""
    # Valid and missing samples are apart, so that a gap neither ends a transition nor has a rank.
    apart = Window.partitionBy(*keys, "missing")
    if any(isinstance(s, Bigrams) for s in statistics):
        rows = rows.withColumn("previous", F.lag("value").over(apart.orderBy("us")))
    if any(isinstance(s, Percentiles) for s in statistics):
        sizes = rows.where(~F.col("missing")).groupBy(*keys).agg(F.count("*").alias("ranks"))
        rows = rows.withColumn("rank", F.row_number().over(apart.orderBy("value"))).join(sizes, list(keys), "left")
    return rows.groupBy(*keys).agg(*more, *aggregates(signal, statistics, ranked=True))


def per_channel(samples: DataFrame, requests: dict[str, list], compute: Callable[[DataFrame, list, str], DataFrame]) -> DataFrame:
    """One wide table from requests by channel: compute(samples of a channel, its statistics, its name) for each.

    Results meet on the subject and the window; columns have their channel's name, and stay null where a channel has no
    such window. A channel without samples has no columns' values.
    """
    out = None
    for channel, statistics in requests.items():
        own = compute(samples.where(F.col("channel") == channel), statistics, channel).drop("channel")
        keys = [c for c in ("subject_id", "ts", "end_ts") if c in own.columns]
        out = own if out is None else out.join(own, keys, "full")
    if out is None:
        raise ValueError("no channel is asked for")
    return out


def tumbling(samples: DataFrame, width: int, statistics: list, period: tuple[Column, Column] | None = None, signal: str = "value", last_sample: bool = True) -> DataFrame:
    """Windows of width microseconds from the period's start while they begin before its end.

    The default period is from the start of the day of a record's first sample to the end of the day of its last; a
    given one is two TIMESTAMP_NTZ literals. Samples are aggregated by window first, map-side partly; only the small
    result meets the spine of all windows. Raw samples are joined with their record's start only where a default period
    is cut into windows that don't divide a day.
    """
    rows = _ready(samples)
    ends = _ends(rows)
    if period is None:
        lo, hi = F.floor(F.col("first_us") / DAY) * DAY, F.floor(F.col("last_us") / DAY) * DAY + DAY - 1
    else:
        lo, hi = micros(period[0]), micros(period[1])
    ends = ends.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")})
    if period is not None:
        rows = rows.where(F.col("us") >= lo).withColumn("lo", lo)
    elif DAY % width == 0:
        rows = rows.withColumn("lo", F.lit(0).cast("long"))
    else:
        rows = rows.join(ends.select(*KEYS, "lo"), KEYS)
    placed = rows.withColumn("window_us", F.col("lo") + (F.floor((F.col("us") - F.col("lo")) / width) * width).cast("long"))
    done = _aggregated(placed, statistics, signal, *KEYS, "window_us")
    spine = ends.where("lo < hi").select(*KEYS, "first_us", "last_us", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(width).cast("long"))).alias("window_us"))
    # A window that begins at the last sample has no other sample.
    at_last = (F.col("window_us") == F.col("last_us")) & (F.col("first_us") < F.col("last_us")) if last_sample else F.lit(False)
    spine = spine.select(*KEYS, "window_us", F.when(~at_last, F.col("window_us")).alias("from_us"))
    joined = spine.join(done.withColumnRenamed("window_us", "from_us"), [*KEYS, "from_us"], "left")
    return joined.select(*KEYS, instant("window_us").alias("ts"), *rendered(signal, statistics))


def summary(samples: DataFrame, statistics: list, signal: str = "value", period: tuple[Column, Column] | None = None) -> DataFrame:
    """One window over each whole record, its last sample included, or over a period (two TIMESTAMP_NTZ literals).

    A period's end is excluded; a record without samples in it is an empty window at the period's start.
    """
    rows = _ready(samples)
    if period is None:
        done = _aggregated(rows, statistics, signal, *KEYS, more=(F.min("us").alias("first_us"),))
        return done.select(*KEYS, instant("first_us").alias("ts"), *rendered(signal, statistics))
    lo, hi = micros(period[0]), micros(period[1])
    inside = rows.where((F.col("us") >= lo) & (F.col("us") < hi))
    done = _aggregated(inside, statistics, signal, *KEYS)
    return rows.select(*KEYS).distinct().join(done, KEYS, "left").select(*KEYS, period[0].alias("ts"), *rendered(signal, statistics))


def given(samples: DataFrame, windows: DataFrame, statistics: list, signal: str = "value", last_sample: bool = True, coarse: int = DAY) -> DataFrame:
    """Windows (subject_id, start_ts, end_ts), which may overlap; a row for each, at its start.

    Windows are cut into coarse intervals, which with the subject are the key of the join with samples; a sample lies in
    one interval, so no pair comes twice.
    """
    rows = _ready(samples)
    listed = windows.select("subject_id", micros("start_ts").alias("a"), micros("end_ts").alias("b")).distinct()
    cut = listed.where("a < b").withColumn("part", F.explode(F.sequence(F.floor(F.col("a") / coarse), F.floor((F.col("b") - 1) / coarse))))
    placed = rows.withColumn("part", F.floor(F.col("us") / coarse)).join(cut, ["subject_id", "part"]).where((F.col("us") >= F.col("a")) & (F.col("us") < F.col("b")))
    done = _aggregated(placed.select(*KEYS, "us", "value", "missing", "a", "b"), statistics, signal, *KEYS, "a", "b")
    # A window that begins at a record's last sample has no other one, and is left empty.
    spine = listed.join(_ends(rows), "subject_id")
    at_last = (F.col("a") == F.col("last_us")) & (F.col("first_us") < F.col("last_us")) if last_sample else F.lit(False)
    spine = spine.select(*KEYS, "a", "b", F.when(~at_last, F.col("a")).alias("from_us"))
    joined = spine.join(done.withColumnRenamed("a", "from_us"), [*KEYS, "from_us", "b"], "left")
    return joined.select(*KEYS, instant("a").alias("ts"), instant("b").alias("end_ts"), *rendered(signal, statistics))


def by_index(samples: DataFrame, first: int, last: int, statistics: list, signal: str = "value") -> DataFrame:
    """One window of samples number first to last - 1 of each record, from 0."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy("us")) - 1
    rows = _ready(samples).withColumn("i", rank).where(F.col("i").between(first, last - 1))
    done = _aggregated(rows.drop("i"), statistics, signal, *KEYS, more=(F.min("us").alias("first_us"),))
    return done.select(*KEYS, instant("first_us").alias("ts"), *rendered(signal, statistics))


def sliding(samples: DataFrame, width: int, statistics: list, signal: str = "value") -> DataFrame:
    """A window from half the width before each sample to half of it after, the end excluded."""
    half = width // 2
    frame = Window.partitionBy(*KEYS).orderBy("us").rangeBetween(-half, half - 1)
    if any(isinstance(s, Bigrams) for s in statistics):
        raise ValueError("transitions aren't defined in sliding windows")
    columns = [c.over(frame).alias(n) for c, n in zip(aggregates(signal, statistics, named=False), names(signal, statistics), strict=True)]
    rows = _ready(samples).select(*KEYS, "us", "value", "missing", *columns)
    return rows.select(*KEYS, instant("us").alias("ts"), *rendered(signal, statistics))

