"""Language identification by a convolutional network over bytes, trained and applied with numpy.

Bytes are embedded; filters of several widths run over fixed-length windows; the maximum of each filter over a window
feeds a softmax. A text's windows cover all its bytes; their log-probabilities, weighted by length, are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_text, read, utf8, with_columns

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4, 5), 10
#: Labelled passages of one language that the network is fitted to at most, and their characters.
PER_LANGUAGE, PASSAGE = 600, 240
#: Windows in a batch of matrix products.
BATCH = 128


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 5) -> Network:
        rng, n = np.random.default_rng(seed), len(WIDTHS) * FILTERS
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        filters = [draw(w * EMBED, FILTERS, scale=1 / np.sqrt(w * EMBED)) for w in WIDTHS]
        return cls(languages, draw(256, EMBED, scale=1.0), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(n, len(languages), scale=1 / np.sqrt(n)), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list, np.ndarray]:
        """Maximum of each filter over each window (0 at least), the places of the maxima, and the embedded bytes."""
        x = self.embed[windows]
        n, size, e = x.shape
        flat, maxima, places = x.reshape(n, size * e), [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            count = size - w + 1
            view = np.lib.stride_tricks.as_strided(flat, (n, count, w * e), (flat.strides[0], e * flat.strides[1], flat.strides[1]))
            y = view.reshape(n * count, w * e) @ f
            y = y.reshape(n, count, FILTERS)
            maxima.append(np.maximum(y.max(1) + b, 0))
            if where:
                places.append(y.argmax(1))
        return np.concatenate(maxima, 1), places, x

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.pooled(windows[i : i + BATCH])[0] for i in range(0, len(windows), BATCH)]) @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        m, places, x = self.pooled(windows, True)
        z = m @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        back = (p @ self.out.T) * (m > 0)
        embed, rows = np.zeros_like(self.embed), np.arange(len(windows))[:, None]
        filters, biases = [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = places[k][:, :, None] + np.arange(w)
            seen = windows[rows[:, :, None], at]
            parts = self.embed[seen].reshape(len(windows), FILTERS, w * EMBED)
            filters.append(np.einsum("nf,nfd->df", g, parts))
            biases.append(g.sum(0))
            np.add.at(embed, seen, (g[:, :, None] * f.T).reshape(len(windows), FILTERS, w, EMBED))
        return [embed, *filters, *biases, m.T @ p, p.sum(0)]


def cut(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover all bytes of all rows (the last of a row padded with zero bytes), their row and bytes."""
    length = np.diff(offsets)
    n = -(-length // size)
    row = np.repeat(np.arange(len(length)), n)
    begin = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * size
    own = np.minimum(size, offsets[1:][row] - begin)
    at = begin[:, None] + np.arange(size)
    padded = np.append(data, np.zeros(size, np.uint8))
    return np.where(np.arange(size) < own[:, None], padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8), row, own


def fit(texts: list[str], labels: list[str], steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 6) -> Network:
    """Adam on random windows; some are cut short, some in capitals, so that short and shouted texts are known too."""
    languages, rng = sorted(set(labels)), np.random.default_rng(seed)
    net = Network.fresh(languages)
    if len(languages) < 2:
        return net
    target, raw = np.array([languages.index(x) for x in labels]), [x.encode() for x in texts]
    loud = [x.upper().encode() for x in texts]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    by = [np.flatnonzero(target == i) for i in range(len(languages))]
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(by[int(i)]) for i in rng.integers(0, len(by), batch)])
        windows = np.zeros((batch, WINDOW), np.uint8)
        for k, i in enumerate(rows):
            source = loud[i] if rng.random() < 0.15 else raw[i]
            size = WINDOW if rng.random() < 0.5 else int(rng.integers(8, WINDOW))
            a = int(rng.integers(0, max(1, len(source) - size + 1)))
            piece = np.frombuffer(source[a : a + size], np.uint8)
            windows[k, : len(piece)] = piece
        now = rate * min(1, 2 * (1 - step / (steps + 1)))
        for w, g, (m, v) in zip(net.weights(), net.gradients(windows, target[rows]), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(docs: DataFrame, allowed=None, text: str = "text", label: str = "lang") -> Network:
    """Fits a network to a sample of labelled passages, PER_LANGUAGE of each language at most, taken by a hash of the text.

    A passage starts at a place that the hash gives, anywhere in its text. Null labels and texts aren't learnt from.
    """
    rows = docs.where(F.col(label).isNotNull() & (F.length(text) > 0))
    rows = rows if allowed is None else rows.where(allowed)
    h = F.xxhash64(text)
    at = (F.lit(1) + F.pmod(h, F.greatest(F.lit(1), F.length(text) - PASSAGE + 1).cast("long"))).cast("int")
    piece = F.col(text).substr(at, F.lit(PASSAGE))
    rows = rows.select(F.col(label).cast("string").alias("label"), h.alias("h"), piece.alias("piece"))
    # Of many texts only those with small hashes can be picked, so that no task gets more than a few times the sample.
    # Copies have one hash and count once.
    enough = F.lit(False)
    for r in rows.select("label", "h").distinct().groupBy("label").count().collect():
        share = min(1.0, 4 * PER_LANGUAGE / r["count"])
        enough = enough | ((F.col("label") == r["label"]) & (F.col("h") <= int(share * ((1 << 64) - 1025)) - (1 << 63)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    picked = rows.where(enough).dropDuplicates(["label", "h"]).withColumn("n", rank).where(F.col("n") <= PER_LANGUAGE)
    found = sorted((r["label"], r["piece"]) for r in picked.collect())
    return fit([x for _, x in found], [x for x, _ in found])


def predicted(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the language's probability); `und` and 0 for null texts and texts without a letter."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        net: Network = sent.value

        def run(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(text))
            lettered = np.array([bool(x) and any(map(str.isalpha, x)) for x in column.to_pylist()], bool)
            data, offsets = utf8(column)
            windows, row, own = cut(data, offsets)
            total = np.zeros((len(column), len(net.languages)))
            if len(windows) and net.languages:
                scores = net.log_probabilities(windows) * own[:, None]
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                total[row[head]] = np.add.reduceat(scores, head)
            total /= np.maximum(1, np.diff(offsets))[:, None]
            if not net.languages:
                return [["und"] * len(column), np.zeros(len(column))]
            p = np.exp(total - total.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            return [[net.languages[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)], np.where(lettered, p[np.arange(len(best)), best], 0.0)]

        return run

    return with_columns(docs, {"lang_pred": (T.StringType(), pa.string()), "score": (T.DoubleType(), pa.float64())}, start, text)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), crc_text() % 5 == 0
    network = learn(docs, ~held_out)
    return predicted(docs.select("doc_id", held_out.alias("held_out"), "text"), network).select("doc_id", "held_out", "lang_pred", "score")
