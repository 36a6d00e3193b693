"""Bottom-k sketches of word shingles: the k smallest distinct 64-bit hashes of a text's five-word shingles.

Sketches of parts merge into the sketch of the whole set, and two of them estimate resemblance, containment and the
number of distinct shingles; below k distinct shingles all these are exact. Texts of one to four words have one shingle,
the whole sequence; texts without words have none, and two such texts are alike (1).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, bounded_batches, lower_table, mixed, read, span_hashes, utf8, with_columns, words

SHINGLE, SIZE = 5, 128
ODD = np.uint64(0xBF58476D1CE4E5B9)


def sketches(texts: pa.Array, k: int = SIZE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """A sorted array of at most k hashes for each text."""
    data, offsets = utf8(texts)
    data = lower_table()[data]
    starts, ends, first = words(data, offsets, "solid")
    hashes = span_hashes(data, starts, ends)
    rolled = np.zeros(max(0, len(hashes) - shingle + 1), np.uint64)
    for i in range(shingle):
        rolled = rolled * ODD + hashes[i : i + len(rolled)]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            got = rolled[a : b - shingle + 1]
            if len(got) > 8 * k:
                got = got[got <= np.partition(got, 4 * k)[4 * k]] if len(np.unique(got[: 8 * k])) > 2 * k else got
            kept = np.unique(got)[:k]
            out.append(kept if len(kept) == k or len(got) == b - a - shingle + 1 else np.unique(rolled[a : b - shingle + 1])[:k])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for i in range(a, b):
                x = x * ODD + hashes[i : i + 1]
            out.append(mixed(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of common shingles among all of both sets."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return np.intersect1d(np.intersect1d(a, b, True), both, True).size / len(both)


def distinct(a: np.ndarray, k: int = SIZE) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = SIZE) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def dumped(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def loaded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def fingerprints(docs: DataFrame, k: int = SIZE, text: str = "text") -> DataFrame:
    """docs with fingerprint string, the sketch of the whole text in base64 (null and empty texts: the empty string)."""

    def start():
        return lambda batch: [[dumped(x) for x in sketches(batch.column(batch.schema.get_field_index(text)), k)]]

    return with_columns(docs, {"fingerprint": (T.StringType(), pa.string())}, start, text)


def _chained(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, tail: buckets of neighbours in descending order, each with the next bucket's first row as tail.

    Rows with the same id are ordered by a hash of their texts; rows without an id come last. Only ids and hashes are
    counted beforehand; the texts go through one shuffle.
    """
    spark = docs.sparkSession
    low = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(low).cast("long")), "h": F.xxhash64("text")})
    key, parts = F.struct("k", "h"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("k", "h").repartitionByRange(parts, F.desc("k"), F.desc("h"))
    ends = [(x.most, x.least) for x in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.max(key).alias("most"), F.min(key).alias("least")).collect()]
    ends.sort(reverse=True)
    n = max(1, len(ends))
    least = spark.sparkContext.broadcast([tuple(x[1]) for x in reversed(ends)])
    most = spark.sparkContext.broadcast({tuple(x[0]): i for i, x in enumerate(ends)})

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def buckets(k: pd.Series, h: pd.Series) -> pd.Series:
        low_k = np.array([x[0] for x in least.value], np.int64)
        out = []
        for x in zip(k.tolist(), h.tolist(), strict=True):
            i = int(np.searchsorted(low_k, x[0], "right")) - 1
            while least.value[i] > x:
                i -= 1
            own = n - 1 - i
            out.append([own * 2, (own - 1) % n * 2 + 1] if most.value.get(x) == own else [own * 2])
        return pd.Series(out)

    placed = rows.withColumn("code", F.explode(buckets("k", "h"))).withColumns({"bucket": F.floor(F.col("code") / 2).cast("int"), "tail": F.col("code") % 2})
    return placed.repartitionById(max(n, parts), F.col("bucket")).sortWithinPartitions("bucket", "tail", F.desc("k"), F.desc("h")).select("doc_id", "text", "bucket", "tail")


def against_next(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """One row a document: doc_id, n_chars, the SHA-256 of its edited text, the sketches of both, and their likeness.

    The edited text has instead of its last half as many first characters of the next document in descending order of
    doc_id (of the first one after the last). Repeated ids are ordered by a hash of the text; null ids come last.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[1])
                if size > CHUNK_BYTES and len(held) > 1:
                    yield from made(held)
                    held, size = held[-1:], len(held[-1][1])
        if held:
            yield from made(held)

    def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        own = sketches(pa.array([r[1] for r in rows], pa.large_string()), k)
        at = [i for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][2] and not rows[i][3]]
        edited = []
        for i in at:
            text, half = rows[i][1], len(rows[i][1]) // 2
            edited.append(text[: len(text) - half] + rows[i + 1][1][:half])
        other = sketches(pa.array(edited, pa.large_string()), k)
        columns = [
            pa.array([rows[i][0] for i in at], pa.int64()),
            pa.array([len(rows[i][1]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([dumped(own[i]) for i in at], pa.string()),
            pa.array([dumped(x) for x in other], pa.string()),
            pa.array([resemblance(own[i], x, k) for i, x in zip(at, other, strict=True)], pa.float64()),
            pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _chained(docs).mapInArrow(run, schema)


def op3_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(read(spark, sf_dir, "documents"))
