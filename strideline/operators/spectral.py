"""Spectra and recursive filters: grouped numpy over Arrow, where a computation runs along a whole window or record."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DAY, KEYS, instant, micros
from ..spec import EMPTY, FrequencyRanges, TopFrequencies, names


def magnitudes(values: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies in hertz and magnitudes of a window's spectrum, that of frequency 0 set to 0."""
    size = np.abs(np.fft.rfft(values))
    if len(size):
        size[0] = 0
    return np.fft.rfftfreq(len(values), 1 / rate) if len(values) else np.zeros(0), size


def spectral_values(values: np.ndarray, rate: float, statistics: list, last_bin: bool = False) -> list[float]:
    """One number for each result column; -1 for an empty window or a missing component.

    A range sums the bins from its lower to its upper frequency; its last bin only with last_bin.
    """
    frequency, size = magnitudes(values, rate)
    out: list[float] = []
    for s in statistics:
        if isinstance(s, FrequencyRanges):
            for lo, hi in s.ranges:
                a, b = np.searchsorted(frequency, [lo, hi])
                out.append(float(size[a : (b + 1 if last_bin else b - 1)].sum()) if len(values) and b > a else (0.0 if len(values) else float(EMPTY)))
        else:
            order = np.argsort(-size, kind="stable")[: s.count] if len(values) else []
            for i in range(s.count):
                out += [float(frequency[order[i]]), float(size[order[i]])] if i < len(order) else [float(EMPTY)] * 2
    return out


def tumbling_spectra(samples: DataFrame, width: int, rate: float, statistics: list, signal: str = "value", last_bin: bool = False) -> DataFrame:
    """Spectral statistics of windows of width microseconds from the start of each record's first day.

    One grouped call gives all columns of a window from one transform; a group is one window, however long the record.
    """
    if bad := [s for s in statistics if not isinstance(s, (FrequencyRanges, TopFrequencies))]:
        raise ValueError(f"no spectral statistics: {bad}")
    kind, columns = samples.schema["subject_id"].dataType.simpleString(), names(signal, statistics)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("us", kind="stable")["value"].to_numpy(float)
        head = {c: pdf[c].iloc[0] for c in (*KEYS, "window_us")}
        return pd.DataFrame([head | dict(zip(columns, spectral_values(values, rate, statistics, last_bin), strict=True))])

    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    first = rows.groupBy(*KEYS).agg((F.floor(F.min("us") / DAY) * DAY).alias("lo"), F.max("us").alias("last"))
    based = rows.withColumn("lo", F.lit(0).cast("long")) if DAY % width == 0 else rows.join(first.select(*KEYS, "lo"), KEYS)
    placed = based.withColumn("window_us", (F.col("lo") + F.floor((F.col("us") - F.col("lo")) / width) * width).cast("long"))
    schema = f"subject_id {kind}, channel string, window_us long, " + ", ".join(f"`{c}` double" for c in columns)
    done = placed.select(*KEYS, "window_us", "us", "value").groupBy(*KEYS, "window_us").applyInPandas(one, schema)
    end = F.floor(F.col("last") / DAY) * DAY + DAY - 1
    spine = first.select(*KEYS, F.explode(F.sequence("lo", end - 1, F.lit(width).cast("long"))).alias("window_us"))
    return spine.join(done, [*KEYS, "window_us"], "left").select(*KEYS, instant("window_us").alias("ts"), *(F.coalesce(f"`{c}`", F.lit(float(EMPTY))).alias(c) for c in columns))


def butterworth(order: int, cutoff: float, rate: float, high: bool) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients b, a of a digital Butterworth filter: analogue poles, warped and mapped by the bilinear transform."""
    warped = 2 * np.tan(np.pi * cutoff / rate)
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    poles = warped / poles if high else warped * poles
    z = (2 + poles) / (2 - poles)
    a = np.real(np.poly(z))
    b = np.poly(np.full(order, 1.0 if high else -1.0))
    at = -1.0 if high else 1.0  # where the filter passes everything
    gain = np.polyval(a, at) / np.polyval(b, at)
    return b * gain, a


class Filter:
    """A causal recursive filter (direct form II, transposed) that keeps its state from one call to the next.

    Values go in blocks: within one, the output is a product with the impulse response plus what the state lets ring on.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, block: int = 128):
        order = len(b) - 1
        step, drive = np.zeros((order, order)), b[1:] - a[1:] * b[0]
        step[:, 0] -= a[1:]
        step[: order - 1, 1:] += np.eye(order - 1)
        powers = [np.eye(order)]
        for _ in range(block):
            powers.append(step @ powers[-1])
        ring = np.array([p[0] for p in powers[:block]])
        response = np.concatenate([[b[0]], ring[: block - 1] @ drive])
        lag = np.arange(block)[:, None] - np.arange(block)
        self.block, self.ring, self.last = block, ring, powers[block]
        self.response = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        self.enter = np.array([powers[block - 1 - j] @ drive for j in range(block)]).T
        self.step, self.drive, self.gain, self.state = step, drive, b[0], np.zeros(order)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        n, size = len(values) // self.block, self.block
        whole = values[: n * size].reshape(n, size)
        out, entering = whole @ self.response.T, whole @ self.enter.T
        states = np.empty((n, len(self.state)))
        for i in range(n):
            states[i] = self.state
            self.state = self.last @ self.state + entering[i]
        out = (out + states @ self.ring.T).ravel()
        tail = np.empty(len(values) - n * size)
        for i, x in enumerate(values[n * size :].tolist()):
            tail[i] = self.gain * x + self.state[0]
            self.state = self.step @ self.state + self.drive * x
        return np.concatenate([out, tail])


def filtered(values: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter with nothing before the first value."""
    return Filter(b, a)(np.asarray(values, float))


def _filter(samples: DataFrame, b: np.ndarray, a: np.ndarray) -> DataFrame:
    kind = samples.schema["subject_id"].dataType.simpleString()

    def start():
        rule = Filter(b, a)
        return lambda pdf, last: (pdf.assign(value=rule(pdf["value"].to_numpy(float))), None)

    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    done = along_records(rows, start, f"subject_id {kind}, channel string, us long, value double")
    return done.select(*KEYS, instant("us").alias("ts"), "value", F.lit(False).alias("missing"))


def along_records(rows: DataFrame, start: Callable, schema: str) -> DataFrame:
    """Each record's rows in order of us through a function with state, batch by batch, so that no record is held whole.

    start() gives a record's function of (rows, whether they are its last): the rows to hand on, and those to see again
    at the front of the next batch. rows: subject_id, channel, us and more. A record is one task's work.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rule, held = None, None, None
        for batch in batches:
            key = batch["subject_id"].astype("string").fillna("\0") + "\1" + batch["channel"].astype("string").fillna("\0")
            edges = [0, *(np.flatnonzero((key.to_numpy()[1:] != key.to_numpy()[:-1])) + 1).tolist(), len(batch)] if len(batch) else [0]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if key.iloc[x] != now:
                    if held is not None and len(held):
                        yield rule(held, True)[0]
                    now, rule, held = key.iloc[x], start(), None
                part = batch.iloc[x:y]
                done, held = rule(part if held is None or not len(held) else pd.concat([held, part]), False)
                if len(done):
                    yield done
        if held is not None and len(held):
            yield rule(held, True)[0]

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "us").mapInPandas(run, schema)


def low_pass(samples: DataFrame, cutoff: float, rate: float, order: int = 1) -> DataFrame:
    """Butterworth low-pass filter along each record."""
    return _filter(samples, *butterworth(order, cutoff, rate, False))


def high_pass(samples: DataFrame, cutoff: float, rate: float, order: int = 1) -> DataFrame:
    return _filter(samples, *butterworth(order, cutoff, rate, True))


def magnitude_high_pass(samples: DataFrame, rate: float) -> DataFrame:
    """High-pass (0.2 Hz, 4th order) of vector magnitude, as absolute mg."""
    return high_pass(samples, 0.2, rate, 4).withColumn("value", F.abs("value") * 1000)


def transform(samples: DataFrame) -> DataFrame:
    """Fourier coefficients of each record: k, re, im."""
    kind = samples.schema["subject_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.fft.fft(pdf.sort_values("us", kind="stable")["value"].to_numpy(float))
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[0], "channel": pdf["channel"].iloc[0], "k": np.arange(len(c)), "re": c.real, "im": c.imag})

    rows = samples.where(~F.col("missing")).select(*KEYS, micros("ts").alias("us"), "value")
    return rows.groupBy(*KEYS).applyInPandas(one, f"subject_id {kind}, channel string, k long, re double, im double")


def inverse(coefficients: DataFrame) -> DataFrame:
    """Values i = 0, 1, ... of each record from its Fourier coefficients."""
    kind = coefficients.schema["subject_id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        v = np.fft.ifft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).real
        return pd.DataFrame({"subject_id": pdf["subject_id"].iloc[0], "channel": pdf["channel"].iloc[0], "i": np.arange(len(v)), "value": v})

    return coefficients.groupBy(*KEYS).applyInPandas(one, f"subject_id {kind}, channel string, i long, value double")
