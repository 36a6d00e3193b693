"""Value transforms and masking. Masking keeps rows and values and sets missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DAY, KEYS, instant, micros
from .bouts import in_us, union

#: What masked samples show in files.
MASKED = -111.0


def _with_range(samples: DataFrame) -> DataFrame:
    """samples with lo and hi, their record's least and greatest value: aggregated first, so that no record is gathered."""
    ends = samples.groupBy(*(F.col(k).alias(f"record_{k}") for k in KEYS)).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"record_{k}")) for k in KEYS))
    return samples.join(ends, same, "left").drop(*(f"record_{k}" for k in KEYS))


def normalise(samples: DataFrame, floor: float = 0.0, ceiling: float = 1.0) -> DataFrame:
    """Values of each record scaled linearly to floor..ceiling; null where a record is constant."""
    lo, hi = F.col("lo"), F.col("hi")
    value = (F.col("value") - lo) / F.nullif(hi - lo, F.lit(0.0)) * (ceiling - floor) + floor
    return _with_range(samples).withColumn("value", value).select(samples.columns)


def collapse(samples: DataFrame, ranges: list[tuple[float, float, float]]) -> DataFrame:
    """(low, high, new): values of closed ranges replaced; where ranges overlap, the later one holds."""
    value = F.col("value")
    return samples.withColumn("value", reduce(lambda rest, r: F.when(value.between(float(r[0]), float(r[1])), float(r[2])).otherwise(rest), ranges, value))


def collapse_auto(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Values replaced by the number, from 0, of their bin of equal width over a record's range."""
    lo, hi = F.col("lo"), F.col("hi")
    bin_ = F.floor((F.col("value") - lo) / F.nullif((hi - lo) / bins, F.lit(0.0)))
    value = F.coalesce(F.least(bin_, F.lit(bins - 1)), F.lit(0)).cast("double")
    return _with_range(samples).withColumn("value", value).select(samples.columns)


def _inside(samples: DataFrame, windows: DataFrame, coarse: int) -> DataFrame:
    """samples with inside: whether a window (subject_id, start_ts, end_ts) has them.

    Windows are merged and cut at coarse intervals of time. In each interval of a subject samples and window starts are
    sorted together, and the last start before a sample says whether it is inside: no sample meets more than one window.
    """
    merged = in_us(union(windows, windows))
    cut = merged.withColumn("part", F.explode(F.sequence(F.floor(F.col("a") / coarse), F.floor((F.col("b") - 1) / coarse))))
    starts = cut.select("subject_id", "part", F.greatest(F.col("a"), F.col("part") * coarse).alias("us"), F.lit(0).alias("order"), F.col("b").alias("until"))
    rows = samples.select(F.struct(*samples.columns).alias("row"), "subject_id", micros("ts").alias("us"), F.lit(1).alias("order"))
    rows = rows.withColumn("part", F.floor(F.col("us") / coarse))
    sweep = Window.partitionBy("subject_id", "part").orderBy("us", "order").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("open", F.last("until", ignorenulls=True).over(sweep))
    return both.where("order = 1").select("row.*", F.coalesce(F.col("us") < F.col("open"), F.lit(False)).alias("inside"))


def fill_windows(samples: DataFrame, windows: DataFrame, value: float, coarse: int = DAY) -> DataFrame:
    """Overwrites values inside windows."""
    rows = _inside(samples, windows, coarse)
    return rows.withColumn("value", F.when(F.col("inside"), float(value)).otherwise(F.col("value"))).select(samples.columns)


def delete_windows(samples: DataFrame, windows: DataFrame, coarse: int = DAY) -> DataFrame:
    """Marks samples inside windows as missing."""
    rows = _inside(samples, windows, coarse)
    return rows.withColumn("missing", F.col("missing") | F.col("inside")).select(samples.columns)


def restrict_timeframe(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Marks samples before start and after end as missing; those at start and end stay valid."""
    us = micros("ts")
    return samples.withColumn("missing", F.col("missing") | (us < micros(start)) | (us > micros(end)))


def shown(samples: DataFrame, masked: float = MASKED) -> DataFrame:
    """Values as files show them: masked for missing ones."""
    return samples.withColumn("value", F.when(F.col("missing"), masked).otherwise(F.col("value")))


def sampling_gaps(samples: DataFrame) -> DataFrame:
    """Mean, greatest and least seconds between neighbouring samples of each record."""
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*KEYS).orderBy("us"))) / 1_000_000
    rows = samples.select(*KEYS, micros("ts").alias("us")).select(*KEYS, gap.alias("gap"))
    return rows.groupBy(*KEYS).agg(F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"), F.min("gap").alias("min_gap"))


def resample(samples: DataFrame, step: int) -> DataFrame:
    """Linear interpolation on a grid of step microseconds from each record's first sample, the last one excluded.

    Each pair of neighbours gives the grid points from the first of them to before the second: one sort, no join.
    """
    order = Window.partitionBy(*KEYS).orderBy("us")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    rows = rows.select(*KEYS, "us", "value", F.min("us").over(so_far).alias("zero"), F.lead("us").over(order).alias("us2"), F.lead("value").over(order).alias("value2")).where("us2 > us")
    first, last = F.ceil((F.col("us") - F.col("zero")) / step), F.ceil((F.col("us2") - F.col("zero")) / step) - 1
    rows = rows.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k"))
    at = F.col("zero") + F.col("k") * step
    value = F.col("value") + (F.col("value2") - F.col("value")) * ((at - F.col("us")) / (F.col("us2") - F.col("us")))
    return rows.select(*KEYS, instant(at).alias("ts"), value.alias("value"), F.lit(False).alias("missing"))
