"""Quality classification: random-indexing word vectors, pooled per document, and a two-layer network.

Every word hash bucket has a sparse random index vector. A word's context vector sums the index vectors of the words
around it over the whole corpus; buckets are BUCKETS in number whatever the corpus, so the table has a fixed size. A
document is the mean and spread of its words' vectors and how alike neighbours are. The network is trained with numpy;
a temperature fitted on labelled rows that it didn't see makes its outputs probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, byte_lengths, crc_text, read, slices, span_hashes, utf8, with_columns

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 15, 32, 2, 2
HIDDEN = 24
#: Labelled rows that the network is fitted to at most.
SAMPLE = 12_000
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    table = np.full(256, 2, np.uint8)
    table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = table[0x80:] = 1
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and punctuation runs of a text column, case kept, and each row's first one (with an end)."""
    data, offsets = utf8(column)
    kind = _classes()[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = kind[1:] != kind[:-1]
    fresh[offsets] = True
    edges = np.flatnonzero(fresh)
    solid = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][solid], edges[1:][solid]
    return (span_hashes(data, starts, ends) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64) & (BUCKETS - 1), np.searchsorted(starts, offsets)


def index_places(seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the dimensions of its index vector that aren't zero, and their signs."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def contexts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Context vectors of all buckets over all texts: BUCKETS x DIMENSIONS, centred and of length 1 (or 0)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_places()
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(0))):
                at, first = tokens(part.column(0))
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                bins, signs = [], []
                for d in range(1, min(REACH, len(row) - 1) + 1):
                    same = row[d:] == row[:-d]
                    a, b = at[:-d][same], at[d:][same]
                    for x, y in ((a, b), (b, a)):
                        bins.append((x[:, None] * DIMENSIONS + place[y]).ravel())
                        signs.append(sign[y].ravel())
                if bins:
                    total += np.bincount(np.concatenate(bins), np.concatenate(signs), BUCKETS * DIMENSIONS)
        table = total.reshape(BUCKETS, DIMENSIONS)
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, i].astype(np.int64)) for i in range(DIMENSIONS))], names=["bucket", *(f"v{i}" for i in range(DIMENSIONS))])

    names = [f"v{i}" for i in range(DIMENSIONS)]
    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, ", ".join(["bucket int", *(f"{x} long" for x in names)]))
    found = parts.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # BUCKETS rows at most
    table = np.zeros((BUCKETS, DIMENSIONS))
    table[np.asarray(found.column(0))] = np.stack([np.asarray(found.column(i + 1)) for i in range(DIMENSIONS)], 1)
    table = np.sign(table) * np.log1p(np.abs(table))
    used = table.any(1)
    if used.any():
        table[used] -= table[used].mean(0)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9) * used[:, None]).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its words' vectors, likeness of neighbours, and the words' number (log)."""
    at, first = tokens(column)
    n, out = np.diff(first), np.zeros((len(first) - 1, 2 * DIMENSIONS + 2), np.float32)
    if len(at):
        v, full = table[at], np.flatnonzero(n)
        head = first[:-1][full]
        size = n[full][:, None].astype(np.float32)
        mean = np.add.reduceat(v, head, axis=0) / size
        out[full, :DIMENSIONS] = mean
        out[full, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, head, axis=0) / size - mean**2))
        near = np.append((v[1:] * v[:-1]).sum(1), 0)
        near[first[1:][full] - 1] = 0
        out[full, -2] = np.add.reduceat(near, head) / np.maximum(1, n[full] - 1)
        out[full, -1] = np.log1p(n[full])
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return (np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d)[:, 0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 3) -> Classifier:
    """Fits the network to four fifths of the rows and its temperature to the rest. Without rows of both labels, a constant."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    net = Classifier(x.mean(0) if len(x) else np.zeros(x.shape[1]), x.std(0) + 1e-6 if len(x) else np.ones(x.shape[1]), [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)])
    if len(np.unique(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.weights = [np.zeros_like(w) for w in net.weights]
        net.weights[3] += np.log(share / (1 - share))
        return net
    order = rng.permutation(len(y))
    rest, own = order[: len(y) // 5], order[len(y) // 5 :]
    z, t, state, step = (x[own] - net.mean) / net.scale, y[own].astype(float), [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights], 0
    for epoch in range(epochs):
        now = rate * (1 - epoch / epochs)
        shuffled = rng.permutation(len(own))
        for i in range(0, len(own), batch):
            rows, step = shuffled[i : i + batch], step + 1
            a, b, c, d = net.weights
            h = np.maximum(z[rows] @ a + b, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ c + d, -40, 40))) - t[rows, None]) / len(rows)
            gh = (g @ c.T) * (h > 0)
            for w, gw, (m, v) in zip(net.weights, (z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), state, strict=True):
                gw = gw + decay * w
                m += 0.1 * (gw - m)
                v += 0.001 * (gw * gw - v)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    if len(rest):
        q, s = net.logits(x[rest]), np.where(y[rest] > 0, 1, -1)
        options = np.geomspace(0.25, 8, 61)
        net.temperature = float(options[np.argmin([np.logaddexp(0, -s * q / k).mean() for k in options])])
    return net


def learn(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "quality") -> tuple[np.ndarray, Classifier]:
    """Word vectors from all texts, and a classifier from SAMPLE labelled rows at most, taken by a hash of the id.

    docs: doc_id, text. labels: doc_id and a label of 0 or 1; rows with nulls aren't learnt from. allowed: a condition on labels.
    """
    table = contexts(docs)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = (rows if allowed is None else rows.where(allowed)).select("doc_id", F.col(label).cast("int").alias("label"))
    picked = rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id")).limit(SAMPLE)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def start():
        return lambda batch: [[x.astype("<f4").tobytes() for x in pooled(batch.column(batch.schema.get_field_index("text")), sent.value)]]

    near = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # SAMPLE rows at most
    found = with_columns(near, {"features": (T.BinaryType(), pa.binary())}, start).select("doc_id", "label", "features").collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    x = np.stack([np.frombuffer(r.features, "<f4") for r in found]) if found else np.zeros((0, 2 * DIMENSIONS + 2), np.float32)
    return table, train(x, np.array([r.label for r in found], int))


def scored(docs: DataFrame, model: tuple[np.ndarray, Classifier], text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1 (null and empty texts have one too), and predicted (1 from THRESHOLD on)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        table, net = sent.value

        def run(batch: pa.RecordBatch) -> list:
            p = net.probabilities(pooled(batch.column(batch.schema.get_field_index(text)), table).astype(np.float64))
            return [p, (p >= THRESHOLD).astype(np.int32)]

        return run

    return with_columns(docs, {"score": (T.DoubleType(), pa.float64()), "predicted": (T.IntegerType(), pa.int32())}, start, text)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents").select("doc_id", "text"), crc_text() % 5 == 0
    model = learn(docs, read(spark, sf_dir, "labels"), ~held_out)
    return scored(docs.withColumn("held_out", held_out), model).select("doc_id", "held_out", "score", "predicted")
