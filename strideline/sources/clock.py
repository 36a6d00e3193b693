"""Times of samples from the clocks that recordings use: pages with a timestamp each, and offsets from a start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import instant, micros


def from_offsets(start: Column, milliseconds: Column) -> Column:
    """The TIMESTAMP_NTZ so many milliseconds after a start."""
    return instant(micros(start) + milliseconds.cast("long") * 1000)


def to_offsets(start: Column, ts: Column) -> Column:
    """Whole milliseconds from a start."""
    return F.floor((micros(ts) - micros(start)) / 1000)


def from_pages(pages: DataFrame, frequency: float, count: int | None = None) -> DataFrame:
    """subject_id, i, ts of every sample from pages (subject_id, i, ts), whose ts is that of sample number i.

    Between two pages times are even; beyond the last page they go on at the frequency, up to sample count - 1 if given.
    Each page expands by itself after one look at the next.
    """
    order = Window.partitionBy("subject_id").orderBy("i")
    rows = pages.select("subject_id", "i", micros("ts").alias("us")).withColumns({"i2": F.lead("i").over(order), "us2": F.lead("us").over(order)})
    last = F.coalesce(F.col("i2"), F.greatest(F.col("i") + 1, F.lit(count)) if count else F.col("i") + 1)
    step = F.when(F.col("i2").isNull(), F.lit(1e6 / frequency)).otherwise((F.col("us2") - F.col("us")) / (F.col("i2") - F.col("i")))
    rows = rows.where(F.col("i2").isNull() | (F.col("i2") > F.col("i"))).select("subject_id", "us", "i", step.alias("step"), F.explode(F.sequence(F.col("i"), last - 1)).alias("k"))
    return rows.select("subject_id", F.col("k").alias("i"), instant(F.round(F.col("us") + (F.col("k") - F.col("i")) * F.col("step")).cast("long")).alias("ts"))
