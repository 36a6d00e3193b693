"""Shared pieces of the corpus operators: scratch tables, Arrow batches and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker handles at once.
CHUNK_BYTES = 1 << 20
#: Rows that Spark puts into one Arrow batch at most; very long rows make batches large.
BATCH_ROWS = 2048
#: Bytes after which Spark closes an Arrow batch, which one row can still exceed.
BATCH_BYTES = 16 << 20

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one of this machine on a local master, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        done = spark.sparkContext.getCheckpointDir()
        if not done and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = done.rsplit("/", 1)[0] if done else "file://" + tempfile.mkdtemp(prefix="strideline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet, under this application's id, so that what it leaves can go as one."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """df as a written Parquet table of the shared folder: cuts the lineage, so a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bitmaps (4 KiB each, for 32,768 numbers) that are broadcast at most: 16 MiB.
BITMAPS = 4096


def picked(rows: DataFrame, ids: DataFrame, inside: bool = True, bitmaps: int = BITMAPS) -> DataFrame:
    """The rows whose number n is (or with inside=False isn't) among ids.n, without a shuffle of rows.

    ids become bitmaps, which are broadcast; if there are more than so many, rows are joined by a shuffle. n comes from
    monotonically_increasing_id, is never null, and the same in every run. ids must be a written table.
    """
    blocks = ids.select(F.bitmap_bucket_number("n").alias("_block"), F.bitmap_bit_position("n").alias("at")).repartition("_block")
    maps = saved(blocks.groupBy("_block").agg(F.bitmap_construct_agg("at").alias("_bits")), "bitmaps")
    if maps.count() > bitmaps:
        return rows.join(ids, "n", "left_semi" if inside else "left_anti")
    at = "cast(bitmap_bit_position(n) as int)"
    byte = f"ascii(decode(substring(_bits, {at} div 8 + 1, 1), 'ISO-8859-1'))"
    bit = F.expr(f"coalesce(shiftright({byte}, {at} % 8) & 1, 0)")
    joined = rows.join(F.broadcast(maps), F.bitmap_bucket_number("n") == maps["_block"], "left")
    return joined.where(bit != 0 if inside else bit == 0).drop("_block", "_bits")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in rows and bytes, for long texts and packed arrays; smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        given = spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or "0"
        if not given.isdigit() or not 0 < int(given) <= most:  # not all digits: with a unit, or below 0 for no limit
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch of at most limit bytes each, or of one row if that alone is longer."""
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_lengths(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)


def with_columns(docs: DataFrame, added: dict[str, tuple[T.DataType, pa.DataType]], fn: Callable[[], Callable[[pa.RecordBatch], list]], source: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """docs with new columns that fn's function makes from slices of a batch of at most limit bytes, row for row.

    fn runs once in each task, so it may build tables. Columns of docs with the new names are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v[0]) for k, v in added.items())])
    kinds = [v[1] for v in added.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = fn()
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(batch.schema.get_field_index(source))), limit):
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(make(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    base = 0x9E3779B97F4A7C15
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@cache
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x reaches every bit of the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX1
    x ^= x >> np.uint64(33)
    x = x * MIX2
    return x ^ (x >> np.uint64(33))


#: Bytes that span_hashes sums up at once; its table of powers has 16 bytes for each.
HASH_BYTES = 1 << 20


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of sorted byte spans that don't overlap; equal bytes have equal hashes wherever they are."""
    out, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + HASH_BYTES, "right")))
        size = int(ends[to - 1] - base)
        up, down = _powers(HASH_BYTES) if size <= HASH_BYTES else _powers.__wrapped__(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(_byte_values()[data[base : base + size]] * up[:size], out=total[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out


@cache
def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


@cache
def word_bytes(kind: str) -> np.ndarray:
    """Which bytes are part of words. alnum: 0-9, a-z and all beyond ASCII; solid: all but white space."""
    table = np.zeros(256, bool)
    if kind == "alnum":
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    else:
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased data, and the index of the first word of each row (with a last entry)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = word_bytes(kind)[data]
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1]] = True
    starts = np.flatnonzero(inside & fresh)
    last = np.ones(len(data) + 1, bool)
    last[:-1] = ~inside[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def crc_text(column: str = "doc_id") -> Column:
    """The unsigned CRC-32 of a column as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
