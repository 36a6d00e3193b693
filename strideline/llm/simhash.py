"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint has three segments of 21, 21 and 22 bits. The binary Golay code (23 bits, 12 of them data) is
perfect: every 23-bit word is within 3 bits of exactly one codeword. The codewords next to a segment and next to its
one-bit changes, six at most, are its keys; two segments that differ by up to 2 bits have one in common (that of a
word halfway). Four errors in three segments leave

* a segment without an error and another with 2 at most: the bits of the one and a key of the other are a join key, or
* two segments with exactly one error each. Such segments have different parity, so one of each pair gives only its own
  codeword and the other those of its one-bit changes; both segments' keys are a join key.

Rows that share a join key are verified. The join is over distinct fingerprints, so copies cost nothing. A worker sorts
its share of keys and hands on only a spanning forest of the links it finds, never all pairs of a group. Keys with more
than WIDE fingerprints go another exact way: fingerprints within 4 bits share a word within 2 bits of either, and all that
share such a word are within 4 bits of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, saved, with_columns
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of one join key that are compared pair by pair.
WIDE = 8192
#: Keys that a worker holds at once, but for twice WIDE.
HELD = 1 << 20
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Generator polynomial of the binary Golay code. Fixed value.
GENERATOR = 0xC75


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of the upper 12 bits, and the error of up to 3 bits for each of the 2048 remainders."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    upper = np.array([remainder(i << 11) for i in range(4096)], np.int64)
    single = [remainder(1 << i) for i in range(23)]
    error = np.zeros(2048, np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return upper, error


def decode(words: np.ndarray) -> np.ndarray:
    """The 12 data bits of the codeword next to each 23-bit word."""
    upper, error = _tables()
    return (words ^ error[upper[words >> 11] ^ (words & 2047)]) >> 11


def _near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of the words' one-bit changes: a matrix, and which entries are the first of their value in a row."""
    keys = decode(words[:, None] ^ (1 << np.arange(bits)))
    keys.sort(axis=1)
    first = np.ones(keys.shape, bool)
    first[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return keys, first


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of fingerprints (uint64) with the index of the fingerprint that each belongs to."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows = np.arange(len(prints))
    odd = [np.bitwise_count(x).astype(np.int64) & 1 for x in parts]
    changed, own = [], []
    for x, (_, n) in zip(parts, SEGMENTS, strict=True):
        keys, first = _near(x, n)
        r, c = np.nonzero(first)
        changed.append((r, keys[r, c]))
        own.append(decode(x))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(3):
        for t in range(3):
            if s != t:
                r, k = changed[t]
                fresh = np.concatenate([r, rows]), np.concatenate([k, own[t]])
                pair = np.unique(fresh[0] << 12 | fresh[1])
                r, k = pair >> 12, pair & 4095
                out.append(((s * 3 + t) << 36 | parts[s][r] << 12 | k, r))
    for s in range(3):
        for t in range(s):
            by = []
            for x in (s, t):
                r, k = changed[x]
                keep, even = odd[x][r] == 1, rows[odd[x] == 0]
                r, k = np.concatenate([r[keep], even]), np.concatenate([k[keep], own[x][even]])
                sort = np.argsort(r, kind="stable")
                by.append((r[sort], k[sort]))
            (r, k), (q, m) = by
            n, begin = np.bincount(q, minlength=len(prints)), np.searchsorted(q, rows)
            times = n[r]
            at = np.repeat(begin[r] - np.cumsum(times) + times, times) + np.arange(times.sum())
            r, k = np.repeat(r, times), np.repeat(k, times)
            out.append(((9 + s * 3 + t) << 36 | (odd[s] ^ odd[t])[r] << 24 | k << 12 | m[at], r))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the shingles' XXH64, repeats included; 0 without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(size + 1) - size - 1
    n = max(1, len(found) - shingle + 1)
    ends = starts[-n:] + size[-n:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """docs with fingerprint long (the bits as a signed number); a null or empty text has 0."""

    def start():
        def make(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            return [np.array([fingerprint((x or "").encode(), shingle) for x in texts], np.uint64).view(np.int64)]

        return make

    return with_columns(docs, {"fingerprint": (T.LongType(), pa.int64())}, start, text)


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The smallest index that each of n nodes is joined to by edges a, b (and an earlier result)."""
    parent = np.arange(n) if parent is None else parent
    while len(a):
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _links(wide: int, distance: int):
    """From batches of one partition, sorted by key, to edges; fingerprints of wide keys come with themselves."""

    def flush(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(prints, return_inverse=True)
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(head, len(keys)))
        large = np.repeat(size > wide, size)
        parent, step, left = np.arange(len(nodes)), 1, np.flatnonzero(~large)
        while len(left):
            left = left[left + step < len(keys)]
            left = left[keys[left] == keys[left + step]]
            near = left[np.bitwise_count((prints[left] ^ prints[left + step]).view(np.uint64)) <= distance]
            parent = forest(len(nodes), at[near], at[near + step], parent)
            step += 1
        child = np.flatnonzero(parent != np.arange(len(nodes)))
        whole = np.unique(prints[large])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([nodes[child], whole])), pa.array(np.concatenate([nodes[parent[child]], whole]))], names=["a", "b"])

    def themselves(prints: np.ndarray) -> pa.RecordBatch:
        whole = pa.array(np.unique(prints))
        return pa.RecordBatch.from_arrays([whole, whole], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n, passing = 0, None
        for batch in batches:
            keys, prints = (np.asarray(batch.column(i)) for i in range(2))
            if passing is not None:  # a wide key that goes on: its fingerprints are handed on as they come
                same = int(np.searchsorted(keys, passing, "right"))
                if same:
                    yield themselves(prints[:same])
                keys, prints = keys[same:], prints[same:]
                passing = passing if not len(keys) else None
            if not len(keys):
                continue
            held.append((keys, prints))
            n += len(keys)
            if n > max(HELD, 2 * wide):  # all but the last key, which may go on
                keys, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield flush(keys[:cut], prints[:cut])
                held, n = [(keys[cut:], prints[cut:])], len(keys) - cut
                if n > wide:
                    yield themselves(prints[cut:])
                    held, n, passing = [], 0, keys[-1]
        if n:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    for batch in batches:
        prints = np.asarray(batch.column(0)).view(np.uint64)
        for k in range(0, len(prints), 256):
            some = prints[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ masks).ravel().view(np.int64)), pa.array(np.repeat(some, len(masks)).view(np.int64))], names=["v", "a"])


def links(prints: DataFrame, wide: int = WIDE) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fingerprint) whose components are those of all links of 4 bits or fewer."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column(0)).view(np.uint64)
            for i in range(0, len(found), 2048):
                key, row = join_keys(found[i : i + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(found[i : i + 2048][row].view(np.int64))], names=["key", "fingerprint"])

    keyed = prints.select("fingerprint").mapInArrow(keys, "key long, fingerprint long").repartition("key").sortWithinPartitions("key")
    found = saved(keyed.mapInArrow(_links(wide, DISTANCE), "a long, b long"), "links")
    pairs = found.where("a <> b")
    large = found.where("a = b").select("a").distinct()
    if large.isEmpty():
        return pairs
    shared = saved(large.mapInArrow(_variants, "v long, a long"), "variants")
    least = saved(shared.groupBy("v").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "variants")
    return pairs.union(shared.join(least, "v").where("a <> b").select("a", "b").distinct())


def hexadecimal(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """One row a document: its id, fingerprint (long) and component_id, the smallest id that links of 4 or fewer bits reach.

    Copies and texts without words share a fingerprint and so a component. Null ids are never the smallest unless there
    is no other; repeated rows and ids stay. Other columns of docs aren't needed and don't matter.
    """
    marked = saved(fingerprints(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))).select("id", "fingerprint"), "fingerprints")
    prints = saved(marked.groupBy("fingerprint").agg(F.min("id").alias("first")), "prints")
    roots = saved(components(links(prints, wide)), "roots").withColumnRenamed("node", "fingerprint")
    rooted = saved(prints.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")), "rooted")
    least = saved(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    found = saved(rooted.join(least, "root").select("fingerprint", "component_id"), "found")
    return marked.join(found, "fingerprint").select(F.col("id").alias(id_column), "fingerprint", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("fingerprint").alias("fingerprint"), "component_id")
