"""The same statistics over streams of samples: event-time windows with a watermark, sessions, and posture with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import KEYS, micros
from ..operators.inference import Posture
from ..spec import Bigrams, aggregates, rendered


def tumbling(samples: DataFrame, width: str, late: str, statistics: list, signal: str = "value") -> DataFrame:
    """Windows of a width like '6 hours' that end once the watermark, late behind the newest sample, has passed them.

    Windows without samples don't come, as a stream has no end to fill up to.
    """
    if any(isinstance(s, Bigrams) for s in statistics):
        raise ValueError("transitions need the order of samples, which a stream's windows don't keep")
    windowed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(*KEYS, F.window("ts", width).alias("w")).agg(*aggregates(signal, statistics))
    return windowed.select(*KEYS, F.col("w.start").cast("timestamp_ntz").alias("ts"), *rendered(signal, statistics))


def sessions(samples: DataFrame, gap: str, late: str) -> DataFrame:
    """Bouts of activity: samples of a subject with pauses of less than gap between them."""
    found = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("subject_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("subject_id", F.col("w.start").cast("timestamp_ntz").alias("start_ts"), F.col("w.end").cast("timestamp_ntz").alias("end_ts"), "n")


def posture_changes(samples: DataFrame, hold: float = 10.0, stand: float = 32.0, sit: float = 22.0) -> DataFrame:
    """subject_id, us, posture for each change of posture in a stream of pitch samples that come in order.

    The state of a subject is its posture and when the run that may change it began: a few numbers.
    """
    rule = Posture(stand, sit, hold)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, run = state.get if state.exists else (0, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        for us, value in zip(rows["us"].tolist(), rows["value"].tolist(), strict=True):
            turning = value >= rule.stand if now == 0 else value <= rule.sit
            run = (us if run < 0 else run) if turning else -1
            if turning and us - run >= rule.hold * 1_000_000:
                now = 1 - now
                out.append((key[0], run, now))
                run = -1
        state.update((now, run))
        yield pd.DataFrame(out, columns=["subject_id", "us", "posture"]).astype({"us": np.int64, "posture": np.int32})

    rows = samples.where(~F.col("missing")).select("subject_id", micros("ts").alias("us"), "value")
    kind = samples.schema["subject_id"].dataType.simpleString()
    return rows.groupBy("subject_id").applyInPandasWithState(step, f"subject_id {kind}, us long, posture int", "posture int, run long", "append", GroupStateTimeout.NoTimeout)
