"""What plots and sounds are made of: small tables and files from long records."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, instant, micros
from ..operators.bouts import INTERVAL

#: Tones for the smallest and the largest value, in hertz. Fixed values.
LOWEST, HIGHEST = 83.0, 880.0


def envelope(samples: DataFrame, points: int = 1000) -> DataFrame:
    """Least, mean and greatest value of each record in points equal parts of its time: all that a plot can show."""
    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    ends = rows.groupBy(*KEYS).agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    part = F.least(F.floor((F.col("us") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * points), F.lit(points - 1))
    done = rows.join(ends, KEYS)
    found = done.groupBy(*KEYS, part.alias("part")).agg(F.min("us").alias("us"), F.min("value").alias("low"), F.avg("value").alias("mean"), F.max("value").alias("high"))
    return found.select(*KEYS, instant("us").alias("ts"), "low", "mean", "high")


def shaded(bouts: DataFrame, labels: str = "bout") -> DataFrame:
    """Intervals to shade in a plot: subject_id, label, start_ts, end_ts."""
    return bouts.select("subject_id", F.lit(labels).alias("label"), *INTERVAL[1:])


def annotated(annotations: DataFrame, points: DataFrame) -> DataFrame:
    """Annotations (subject_id, ts, text) with the height to draw them at: the mean of the envelope's part they fall in.

    points: an envelope. An annotation before a record's first part has no height.
    """
    marks = annotations.select("subject_id", "ts", "text", F.lit(1).alias("order"))
    both = points.select("subject_id", "ts", "mean", F.lit(0).alias("order")).unionByName(marks, allowMissingColumns=True)
    sweep = Window.partitionBy("subject_id").orderBy("ts", "order").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("height", F.last("mean", ignorenulls=True).over(sweep)).where("order = 1").select("subject_id", "ts", "text", "height")


def tone(values: np.ndarray, seconds_each: float = 0.02, rate: int = 22050) -> bytes:
    """A WAV file in which each value sounds for a while, its pitch between the two limits by its size."""
    values = np.asarray(values, float)
    span = np.ptp(values) if len(values) else 0
    pitch = LOWEST + (values - values.min()) / (span or 1) * (HIGHEST - LOWEST) if len(values) else values
    phase = np.cumsum(np.repeat(pitch, max(1, round(seconds_each * rate))) / rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.sin(2 * np.pi * phase) * 30000).astype("<i2").tobytes())
    return out.getvalue()


def tones(samples: DataFrame, seconds_each: float = 0.02, rate: int = 22050) -> DataFrame:
    """subject_id, channel and the WAV file (wav) of each record's values in order of time. A record is one task's work."""
    kind = samples.schema["subject_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        sound = tone(pdf.sort_values("us", kind="stable")["value"].to_numpy(float), seconds_each, rate)
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[:1], "channel": pdf["channel"].iloc[:1], "wav": [sound]})

    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    return rows.groupBy(*KEYS).applyInPandas(one, f"subject_id {kind}, channel string, wav binary")
