"""Nonwear, still periods, valid days, posture and calibration, from samples and bouts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import calibrated
from ..model import DAY, HOUR, KEYS, MINUTE, SECOND, instant, micros, samples_from
from ..spec import Generic
from .bouts import INTERVAL, bouts, complement, in_us, intersection, limit_lengths, window_statistics
from .spectral import along_records
from .windows import tumbling

#: Below this standard deviation (g) over ten seconds an axis is still. Fixed value.
STILL_G = 0.013
OCTANTS = [(x, y, z) for x in (1, -1) for y in (1, -1) for z in (1, -1)]


def day_period(samples: DataFrame) -> DataFrame:
    """Start of the first day and last microsecond of the last day of each subject."""
    us = micros("ts")
    ends = samples.groupBy("subject_id").agg(F.min(us).alias("a"), F.max(us).alias("b"))
    return ends.select("subject_id", instant(F.floor(F.col("a") / DAY) * DAY).alias("period_start"), instant(F.floor(F.col("b") / DAY) * DAY + DAY - 1).alias("period_end"))


def record_period(samples: DataFrame) -> DataFrame:
    """First and last timestamp of each subject."""
    return samples.groupBy("subject_id").agg(F.min("ts").alias("period_start"), F.max("ts").alias("period_end"))


def nonwear_counts(samples: DataFrame, least: int = 60 * MINUTE) -> tuple[DataFrame, DataFrame]:
    """Nonwear (runs of counts of 0 or less of at least so long) and wear (the rest of the record) of count signals."""
    off = limit_lengths(bouts(samples, -999999, 0).select(*INTERVAL), least)
    return off, complement(off, record_period(samples))


def valid_days(samples: DataFrame, wear: DataFrame, criterion: int = 10 * HOUR) -> tuple[DataFrame, DataFrame]:
    """Days with less wear than the criterion, and days with that or more."""
    us = micros("ts")
    ends = samples.groupBy("subject_id").agg(F.floor(F.min(us) / DAY).alias("a"), F.floor(F.max(us) / DAY).alias("b"))
    day = ends.select("subject_id", F.explode(F.sequence("a", "b")).alias("d")).select("subject_id", instant(F.col("d") * DAY).alias("start_ts"), instant((F.col("d") + 1) * DAY).alias("end_ts"))
    worn = window_statistics(wear, day)
    enough = F.greatest("bout_sum", F.lit(0.0)) >= criterion / SECOND
    return worn.where(~enough).select(*INTERVAL), worn.where(enough).select(*INTERVAL)


def still_bouts(samples: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z"), window: int = 10 * SECOND, limit: float = STILL_G, least: int = MINUTE) -> DataFrame:
    """Times at which all three axes are still: runs of windows whose standard deviation is 0..limit, of at least so long."""
    deviation = tumbling(samples.where(F.col("channel").isin(*axes)), window, [Generic(("std",))])
    level = deviation.select(*KEYS, "ts", F.col("value_std").alias("value"), (F.col("value_std") < 0).alias("missing"))
    runs = limit_lengths(bouts(level, 0, limit), least)
    found = [runs.where(F.col("channel") == a).select(*INTERVAL) for a in axes]
    return intersection(intersection(found[0], found[1]), found[2])


def nonwear_triaxial(samples: DataFrame, axes: tuple[str, str, str] = ("x", "y", "z"), least: int = HOUR) -> tuple[DataFrame, DataFrame]:
    """Nonwear (still for at least so long, each axis and all together) and wear of triaxial signals."""
    off = limit_lengths(still_bouts(samples, axes, least=least), least)
    return off, complement(off, record_period(samples))


def still_points(xyz: DataFrame, still: DataFrame, window: int = 10 * SECOND, low: float = 0.5, high: float = 1.5, coarse: int = HOUR) -> DataFrame:
    """Mean x, y, z and number of samples of each still bout of ten seconds or more where the magnitude is reasonable.

    xyz: subject_id, ts, x, y, z. The magnitude's ten-second means must be low..high.
    """
    vm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    level = tumbling(xyz.select("subject_id", F.lit("vm").alias("channel"), "ts", vm.alias("value"), vm.isNull().alias("missing")), window, [Generic(("mean",))])
    level = level.select(*KEYS, "ts", F.col("value_mean").alias("value"), (F.col("value_mean") < 0).alias("missing"))
    usable = limit_lengths(intersection(still, bouts(level, low, high).select(*INTERVAL)), 10 * SECOND)
    cut = in_us(usable).withColumn("part", F.explode(F.sequence(F.floor(F.col("a") / coarse), F.floor((F.col("b") - 1) / coarse))))
    rows = xyz.withColumns({"us": micros("ts"), "part": F.floor(micros("ts") / coarse)})
    inside = rows.join(cut, ["subject_id", "part"]).where((F.col("us") >= F.col("a")) & (F.col("us") < F.col("b")))
    return inside.groupBy("subject_id", "a", "b").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n")).drop("a", "b")


def octants(points: DataFrame) -> DataFrame:
    """How many points lie in each octant of space; points on a border in none."""
    sign = lambda c, s: F.col(c) > 0 if s > 0 else F.col(c) < 0
    name = lambda o: "octant_" + "".join("p" if s > 0 else "m" for s in o)
    return points.groupBy("subject_id").agg(*(F.count_if(sign("x", o[0]) & sign("y", o[1]) & sign("z", o[2])).alias(name(o)) for o in OCTANTS))


def calibration_error(points: DataFrame) -> DataFrame:
    """Root of the sum of n (1 - magnitude)^2 over the number of points, as such errors are reported."""
    vm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return points.groupBy("subject_id").agg(F.sqrt(F.sum(F.col("n") * (1 - vm) * (1 - vm)) / F.count("*")).alias("rmse"), F.count("*").alias("points"))


def solve(points: np.ndarray, offset_only: bool = False, iterations: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and scales that bring points (k x 3) closest to the unit sphere.

    Repeats: project to the sphere, regress each axis on its targets, apply. Stops early when nothing moves any more.
    """
    now, target = points.copy(), points
    for _ in range(iterations):
        target = now / np.maximum(np.linalg.norm(now, axis=1, keepdims=True), 1e-12)
        if offset_only:
            step = now + (target - now).mean(0)
        else:
            centre, aim = now.mean(0), target.mean(0)
            spread = ((now - centre) ** 2).sum(0)
            slope = np.where(spread > 0, ((now - centre) * (target - aim)).sum(0) / np.where(spread > 0, spread, 1), 1)
            step = aim + (now - centre) * slope
        moved = np.abs(step - now).max()
        now = step
        if moved < 1e-12:
            break
    if offset_only:
        return (now - points).mean(0), np.ones(3)
    centre, aim = points.mean(0), now.mean(0)
    spread = ((points - centre) ** 2).sum(0)
    scale = np.where(spread > 0, ((points - centre) * (now - aim)).sum(0) / np.where(spread > 0, spread, 1), 1)
    return aim - centre * scale, scale


def calibrate(points: DataFrame, enough: int = 500, empty_octants: int = 2) -> DataFrame:
    """Offset and scale of each axis and the error before and after for each subject, from its still points.

    With fewer than enough points or more than so many empty octants only offsets are fitted. One small group a subject.
    """
    columns = [f"{a}_{k}" for a in "xyz" for k in ("offset", "scale")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p, n = pdf[["x", "y", "z"]].to_numpy(float), pdf["n"].to_numpy(float)
        empty = sum(not ((np.sign(p) == o).all(1)).any() for o in OCTANTS)
        offset, scale = solve(p, len(p) < enough or empty > empty_octants)
        error = lambda q: float(np.sqrt((n * (1 - np.linalg.norm(q, axis=1)) ** 2).sum() / len(q)))
        row = {"subject_id": pdf["subject_id"].iloc[0], "points": len(p), "empty_octants": empty, "error_before": error(p), "error_after": error(offset + p * scale)}
        return pd.DataFrame([row | {f"{a}_offset": offset[i] for i, a in enumerate("xyz")} | {f"{a}_scale": scale[i] for i, a in enumerate("xyz")}])

    schema = f"subject_id {points.schema['subject_id'].dataType.simpleString()}, points long, empty_octants long, error_before double, error_after double, " + ", ".join(f"{c} double" for c in columns)
    return points.select("subject_id", "x", "y", "z", "n").groupBy("subject_id").applyInPandas(one, schema)


def auto_calibrated(xyz: DataFrame, limit: float = STILL_G, cache=None) -> tuple[DataFrame, DataFrame]:
    """x, y, z calibrated by their own still, reasonable periods, and the parameters with both errors.

    xyz: subject_id, ts, x, y, z. Still bouts, their mean points, the solution and its application in one call. With a
    ResultCache the parameters are computed once for a limit, stored, and taken from there later.
    """
    if is_calibrated(xyz):
        raise ValueError("these samples are calibrated already")

    def parameters(limit: float) -> DataFrame:
        long = samples_from(xyz, "subject_id", "ts", x="x", y="y", z="z")
        return calibrate(still_points(xyz, still_bouts(long, limit=limit)))

    found = cache.get(parameters, "calibrate", {"limit": limit}) if cache else parameters(limit)
    return apply_calibration(xyz, found), found


def is_calibrated(xyz: DataFrame) -> bool:
    """Whether x, y and z carry the mark of apply_calibration, which their schema keeps, in files too."""
    return all(xyz.schema[a].metadata.get("calibrated", False) for a in "xyz")


def apply_calibration(xyz: DataFrame, parameters: DataFrame) -> DataFrame:
    """x, y, z with their subjects' offsets and scales applied, and marked as calibrated."""
    rows = xyz.join(parameters.select("subject_id", *(f"{a}_{k}" for a in "xyz" for k in ("offset", "scale"))), "subject_id", "left")
    new = {a: calibrated(a, F.coalesce(f"{a}_offset", F.lit(0.0)), F.coalesce(f"{a}_scale", F.lit(1.0))) for a in "xyz"}
    return rows.withColumns(new).select(*(F.col(c).alias(c, metadata={"calibrated": True}) if c in ("x", "y", "z") else c for c in xyz.columns))


class Posture:
    """Sitting (0) or standing (1) from pitch with hysteresis; state passes from one batch of a record to the next.

    Pitch of stand or more for hold seconds makes standing, of sit or less for as long makes sitting; the samples of that
    run get the new state, too.
    """

    def __init__(self, stand: float = 32.0, sit: float = 22.0, hold: float = 10.0):
        self.stand, self.sit, self.hold = stand, sit, hold

    def classify(self, us: np.ndarray, pitch: np.ndarray, state: int = 0) -> tuple[np.ndarray, int, int]:
        """The posture of each sample after a state; also the last state, and the place where a run begins that the next
        samples may still turn into a change (their number if there is none)."""
        out, at, n = np.zeros(len(pitch), np.int8), 0, len(pitch)
        runs = [self._runs(us, pitch >= self.stand), self._runs(us, pitch <= self.sit)]
        while True:
            begin, turn = runs[state]
            k = int(np.searchsorted(begin, at))
            while k < len(turn) and turn[k] < 0:
                k += 1
            if k == len(turn):
                break
            out[at : begin[k]] = state
            state, at = 1 - state, int(begin[k])
        out[at:] = state
        begin, turn = runs[state]
        turning = (pitch >= self.stand if state == 0 else pitch <= self.sit)[-1:].any()
        return out, state, int(begin[-1]) if turning and len(begin) and turn[-1] < 0 and begin[-1] >= at else n

    def _runs(self, us: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of flags begin, and the sample at which each has lasted long enough (-1: it doesn't)."""
        edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        turn = np.searchsorted(us, us[begin] + self.hold * SECOND) if len(begin) else begin
        return begin, np.where(turn < end, turn, -1)


def posture(samples: DataFrame, **limits: float) -> DataFrame:
    """Posture of each sample of pitch records, in order of time: sequential, so one task a record, in bounded batches."""
    rule = Posture(**limits)
    kind = samples.schema["subject_id"].dataType.simpleString()

    def start():
        state = 0

        def step(pdf: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
            nonlocal state
            found, after, open_ = rule.classify(pdf["us"].to_numpy(), pdf["value"].to_numpy(float), state)
            cut = len(pdf) if last else open_
            state = after
            return pdf.iloc[:cut].assign(posture=found[:cut].astype("int32"))[["subject_id", "channel", "us", "posture"]], pdf.iloc[cut:]

        return step

    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    return along_records(rows, start, f"subject_id {kind}, channel string, us long, posture int").select(*KEYS, instant("us").alias("ts"), "posture")


def running_gap(samples: DataFrame) -> DataFrame:
    """Seconds since the sample before."""
    order = Window.partitionBy(*KEYS).orderBy("us")
    return samples.withColumn("us", micros("ts")).withColumn("gap", (F.col("us") - F.lag("us").over(order)) / SECOND).drop("us")
