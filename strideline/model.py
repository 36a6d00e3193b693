"""The data model: samples, bouts and time in microseconds.

samples: subject_id, channel, ts (TIMESTAMP_NTZ), value (DOUBLE), missing (BOOLEAN).
bouts: subject_id, label, start_ts, end_ts (TIMESTAMP_NTZ), half-open.

Arithmetic on time uses microseconds since 1970 as LONG, which needs the session's time zone to be UTC (see pin_utc).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = T.StructType(
    [T.StructField("subject_id", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()), T.StructField("missing", T.BooleanType())]
)
SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000
#: Keys that all operators keep apart.
KEYS = ["subject_id", "channel"]


def pin_utc(spark: SparkSession) -> None:
    """Sets the session's time zone to UTC, so that TIMESTAMP_NTZ and microseconds convert without shifts."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def instant(us: Column | str) -> Column:
    """The TIMESTAMP_NTZ at so many microseconds since 1970."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def samples_from(df: DataFrame, subject: Column | str, ts: str, **channels: Column | str) -> DataFrame:
    """Long samples from a wide table: a channel for each keyword. Null and NaN values are missing."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    columns = [F.struct(F.lit(name).alias("channel"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for name, c in channels.items()]
    long = df.select(subject.alias("subject_id"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.explode(F.array(*columns)).alias("x"))
    value = F.when(~F.isnan("x.value"), F.col("x.value"))
    return long.select("subject_id", F.col("x.channel").alias("channel"), "ts", value.alias("value"), value.isNull().alias("missing"))


def select_channels(samples: DataFrame, *names: str) -> DataFrame:
    """Samples of the named channels."""
    return samples.where(F.col("channel").isin(*names))


def rename_channel(samples: DataFrame, old: str, new: str) -> DataFrame:
    return samples.withColumn("channel", F.when(F.col("channel") == old, F.lit(new)).otherwise(F.col("channel")))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    """All samples of both, neither sorted nor without duplicates."""
    return a.unionByName(b)


def timeframe(samples: DataFrame) -> DataFrame:
    """First and last timestamp of each subject and channel."""
    return samples.groupBy(*KEYS).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def wide(samples: DataFrame, *names: str) -> DataFrame:
    """One row for each subject and timestamp with a column for each named channel; one shuffle for all channels."""
    value = lambda n: F.max(F.when(F.col("channel") == n, F.col("value"))).alias(n)
    return select_channels(samples, *names).groupBy("subject_id", "ts").agg(*map(value, names))
