"""A content-addressed store of token ids.

Whole texts are encoded with the tokenizers library. A rolling hash over the last ids cuts each document's id stream into
chunks wherever its low bits are zero, so equal passages give equal chunks. Each unique chunk is stored once, under the
BLAKE2b digest of its ids as little-endian unsigned integers: of 16 bits where the tokenizer has at most 65,536 ids, else
of 32. A document's recipe is the list of its chunks' digests; their Merkle root verifies it. The manifest holds the
recipes in ascending order of document ids; a Merkle tree over its entries, with nodes of up to FAN entries, gives the
root that verifies the whole store.

Encoding looks up pre-tokens: the pattern that splits text is evaluated over whole batches of code points, each distinct
pre-token is encoded once by the library's model (to which the library gives pre-tokens separately, too), and a bounded
table by hash keeps those that come again. Texts with a special token's string go through the library whole.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, byte_lengths, mixed, read, saved, scratch, slices

END_ID = 2
#: Ids in a chunk on average (a power of 2) and at most; ids that the rolling hash sees.
MEAN, MOST, ROLL = 512, 8192, 8
#: Places for pre-tokens that a worker remembers (a power of 2), with up to four times as many ids.
SLOTS = 1 << 21
#: Entries under one node of the manifest's tree.
FAN = 4096
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def load(tokenizer_file: str, special_as_text: bool = False) -> Tokenizer:
    """The library's tokenizer; special_as_text: strings of special tokens in a text are ordinary text."""
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@cache
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte (as Latin-1) in byte-level vocabularies: itself where it prints, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def classes(tokenizer: Tokenizer) -> np.ndarray:
    """For each code point its class as the library's own pre-tokenizer sees it: what it stays together with.

    All code points that Python's Unicode tables put into one class are split at once; what the library keeps together
    has the class of its first character, which is measured.
    """
    split, table = tokenizer.pre_tokenizer.pre_tokenize_str, np.full(0x110000, SPACE, np.uint8)

    def measured(c: str) -> int:
        kept = (kind for mark, kind in (("a", LETTER), ("0", NUMBER), ("!", OTHER)) if len(split(f"{mark}{c}{mark}")) == 1)
        return next(kept, SPACE)

    groups: dict[int, list[int]] = {}
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            c = chr(i)
            groups.setdefault(SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER), []).append(i)
    for points in groups.values():
        for _, (begin, end) in split("".join(map(chr, points))):
            table[points[begin:end]] = measured(chr(points[begin]))
    return table


def pre_tokens(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts that lie one after the other in points; first: where each text starts, and the end."""
    n = len(points)
    kind = table[points]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    fresh = edge.copy()
    fresh[1:n] |= kind[1:] != kind[:-1]
    start, blank, space = fresh[:n].copy(), points == 32, kind == SPACE
    # A run of white space before something else leaves its last character, which is taken along if it is a blank.
    last = np.flatnonzero(space & fresh[1:] & ~edge[1:])
    start[last] = True
    joined = last[blank[last]] + 1
    start[joined] = False
    # Contractions begin where a pre-token begins with an apostrophe.
    at = np.flatnonzero((points == 39) & start)
    padded = np.concatenate([points, [0, 0, 0]])
    texts = np.searchsorted(first, at, "right")
    room = first[np.minimum(texts, len(first) - 1)] - at
    one, two = padded[at + 1], padded[at + 2]
    short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
    long = (room > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    for where, size in ((at[short], 2), (at[long & ~short], 3)):
        start[where + 1] = False
        after = where + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Known:
    """Ids of pre-tokens by hash, in arrays of fixed size.

    A hash has two places; a new one takes the first if it is free, else it drives out what the second has. The ids
    themselves lie in a pool, and all is forgotten once that is full.
    """

    def __init__(self, slots: int = SLOTS):
        self.keys, self.begin, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.used, self.most = np.zeros(1 << 16, np.uint32), 0, 4 * slots

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.keys) - 1)
        return (keys & mask).astype(np.int64), (keys >> np.uint64(32) & mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each key's ids begin in the pool, how many there are, and whether it is known."""
        first, second = self.places(keys)
        at = np.where(self.keys[first] == keys, first, second)
        return self.begin[at].astype(np.int64), self.size[at].astype(np.int64), self.keys[at] == keys

    def room(self) -> None:
        """Forgets everything if the pool is full."""
        if self.used > self.most:
            self.keys[:], self.used = 0, 0

    def add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Puts the ids of distinct new keys into the pool; where each begins there."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(size) - size
        first, second = self.places(keys)
        at = np.where(self.keys[first] == 0, first, second)
        self.keys[at], self.begin[at], self.size[at] = keys, begin, size
        self.used += len(ids)
        return begin


class Encoder:
    """Ids of whole texts, as the library gives them without special tokens."""

    def __init__(self, tokenizer: Tokenizer, table: np.ndarray, slots: int = SLOTS):
        self.tokenizer, self.table, self.known = tokenizer, table, Known(slots)
        self.letters = np.array([ord(byte_letters().get(b, chr(b))) for b in range(256)], np.uint32)
        self.mixed = mixed(np.arange(1, len(table) + 1, dtype=np.uint64))
        self.special = [] if tokenizer.encode_special_tokens else [x.content for x in tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (with a last entry)."""
        whole = "".join(texts)
        if not any(x in whole for x in self.special):
            return self._plain(texts, whole)
        marked = [any(x in text for x in self.special) for text in texts]
        ids, first = self._plain(rest := ["" if m else x for x, m in zip(texts, marked, strict=True)], "".join(rest))
        own = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) if m else ids[a:b] for x, m, a, b in zip(texts, marked, first[:-1], first[1:], strict=True)]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])

    def _tokenized(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and how many each has."""
        raw = [x.encode() for x in names]
        letters = self.letters[np.frombuffer(b"".join(raw), np.uint8)].astype("<u4").tobytes().decode("utf-32-le")
        end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))).tolist()
        tokenize = self.tokenizer.model.tokenize
        found = [[x.id for x in tokenize(letters[a:b])] for a, b in zip([0, *end], end, strict=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _plain(self, texts: list[str], whole: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts = pre_tokens(points, first, self.table)
        ends = np.append(starts[1:], len(points))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        weights = _weights(len(points))
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.mixed[points] * weights[0][: len(points)], out=total[1:])
        keys = np.maximum(mixed((total[ends] - total[starts]) * weights[1][starts] + (ends - starts).astype(np.uint64)), np.uint64(1))
        self.known.room()
        begin, n, found = self.known.find(keys)
        missing = np.flatnonzero(~found)
        if len(missing):
            some, at, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[at]
            ids, size = self._tokenized([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            begin[missing], n[missing] = self.known.add(some, ids, size)[back], size[back]
        end = np.cumsum(n)
        out = self.known.pool[np.repeat(begin - end + n, n) + np.arange(end[-1])]
        return out, np.concatenate([[0], end])[np.searchsorted(starts, first)]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(tokenizer_file: str, special_as_text: bool, table: np.ndarray) -> Encoder:
    """This worker's encoder, which later tasks use again."""
    key = tokenizer_file, special_as_text
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(load(*key), table)
    return _ENCODERS[key]


@cache
def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size != n:
        return _weights(size)
    base = 0xD6E8FEB86659FD93
    up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def cuts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that lie one after the other; first: where each starts, and the end."""
    values, roll = mixed(ids.astype(np.uint64) + np.uint64(7)), np.zeros(len(ids), np.uint64)
    for i in range(min(ROLL, len(ids))):  # each value moves up one bit with every id that follows
        roll[i:] += values[: len(ids) - i] << np.uint64(i)
    cut = np.flatnonzero((mixed(roll) & np.uint64(MEAN - 1)) == 0) + 1
    all_cuts = np.union1d(cut, first[1:])
    all_cuts = all_cuts[all_cuts > 0]
    gap = np.diff(np.concatenate([[0], all_cuts]))
    if len(gap) and gap.max() > MOST:
        more = [np.arange(e - g + MOST, e, MOST) for e, g in zip(all_cuts[gap > MOST], gap[gap > MOST], strict=True)]
        all_cuts = np.union1d(all_cuts, np.concatenate(more))
    return all_cuts


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=20).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the hash tree over the leaves; an odd node moves up as it is."""
    while len(leaves) > 1:
        leaves = [digest(b"\1" + b"".join(leaves[i : i + 2])) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0]


@cache
def _shift(n: int) -> int:
    """x to the power 8 n modulo the CRC-32 polynomial, bits reversed."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def _times(a: int, b: int) -> int:
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(a: int, b: int, size: int) -> int:
    """The CRC-32 of two byte strings one after the other, from theirs and the second one's size."""
    return _times(_shift(size), a) ^ b


def width(tokenizer: Tokenizer, end_id: int | None = None) -> np.dtype:
    """The type of stored ids."""
    return np.dtype("<u2" if max(tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4")


CHUNK_SCHEMA = "digest binary, doc_id long, n long, data binary"


def write_store(docs: DataFrame, tokenizer_file: str, folder: str, end_id: int | None = END_ID, text: str = "text", special_as_text: bool = False) -> tuple[DataFrame, DataFrame, bytes]:
    """Encodes docs (doc_id, text) and writes chunks and manifest under a folder of the shared store; returns both tables
    and the manifest's root.

    chunks: digest, n (ids), data. manifest: doc_id, row (its place, from 0), n (ids), leaves (digests one after the
    other), root (empty without ids), start (ids of all documents before it), in ascending order of doc_id; null ids come
    first, rows with one id by their leaves. A null or empty text has only the end id, without one nothing. Both come
    from one encoding and one shuffle of the ids. Repeated rows each have an entry; an empty table has an empty manifest.
    Columns of docs but these two don't matter. special_as_text: as in load.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = load(tokenizer_file, special_as_text)
    tables, kind = spark.sparkContext.broadcast(classes(tokenizer)), width(tokenizer, end_id)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = _encoder(tokenizer_file, special_as_text, tables.value), set()
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(1))):
                ids, first = encode(pc.fill_null(part.column(1), "").to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, first[1:], end_id)
                    first = first + np.arange(len(first))
                data, edge = ids.astype(kind).tobytes(), cuts(ids, first).tolist()
                rows, at, k, names = [], 0, 0, part.column(0).to_pylist()
                for doc, end in zip(names, first[1:].tolist(), strict=True):
                    leaves, size = [], end - at
                    while at < end:
                        piece = data[kind.itemsize * at : kind.itemsize * edge[k]]
                        key = digest(piece)
                        leaves.append(key)
                        if key not in seen:
                            if len(seen) < 1 << 18:
                                seen.add(key)
                            rows.append((key, None, edge[k] - at, piece))
                        at, k = edge[k], k + 1
                    rows.append((None, doc, size, b"".join(leaves)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["digest", "doc_id", "n", "data"])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            keep = [x is None or x != y for x, y in zip(keys, [last, *keys], strict=False)]
            last = keys[-1] if keys else last
            yield batch.filter(pa.array(keep))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(chunk, CHUNK_SCHEMA)
    dealt = rows.repartition(F.coalesce("digest", F.encode(F.concat_ws(":", "doc_id", F.xxhash64("data")), "utf-8"))).sortWithinPartitions("digest")
    dealt.mapInArrow(unique, CHUNK_SCHEMA).withColumn("recipe", F.col("digest").isNull()).write.partitionBy("recipe").parquet(f"{folder}/parts")
    parts = spark.read.schema(f"{CHUNK_SCHEMA}, recipe boolean").parquet(f"{folder}/parts")
    chunks = parts.where("NOT recipe").select("digest", "n", "data")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, rows = 0, 0
        for batch in batches:
            n = np.asarray(batch.column(1))
            roots = [merkle([x[i : i + 20] for i in range(0, len(x), 20)]) if x else b"" for x in batch.column(2).to_pylist()]
            made = [pa.array(roots, pa.binary()), pa.array(before + np.cumsum(n) - n), pa.array(rows + np.arange(len(n)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["doc_id", "n", "leaves", "part", "root", "start", "row"])
            before, rows = before + int(n.sum()), rows + len(n)

    ranged = parts.where("recipe").select("doc_id", "n", F.col("data").alias("leaves"))
    ranged = ranged.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.xxhash64("leaves")).sortWithinPartitions("doc_id", "leaves")
    recipes = saved(ranged.withColumn("part", F.spark_partition_id()).mapInArrow(placed, "doc_id long, n long, leaves binary, part int, root binary, start long, row long"), "recipes")
    bases, ids, rows_before = [], 0, 0  # a row for each partition
    for r in sorted(recipes.groupBy("part").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()):
        bases.append((r.part, ids, rows_before))
        ids, rows_before = ids + r.n, rows_before + r.rows
    base = spark.createDataFrame(bases or [(0, 0, 0)], "part int, ids_before long, rows_before long")
    manifest = recipes.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("row") + F.col("rows_before")).alias("row"), "n", "leaves", "root", (F.col("start") + F.col("ids_before")).alias("start")
    )
    return chunks, manifest, manifest_root(manifest)


def manifest_root(manifest: DataFrame) -> bytes:
    """The root of the tree over a manifest's entries (id, place, number of ids and root of each); empty without entries.

    A node has FAN entries at most, so none gathers more, and each level is a FAN-th of the one below.
    """

    @F.udf("binary")
    def node(children: list) -> bytes:
        return merkle([bytes(x.hash) for x in children])

    entry = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "row", "n", "start", F.hex("root"))
    level = manifest.select("row", F.unhex(F.sha2(entry.cast("binary"), 256)).alias("hash"))
    while True:
        level = level.groupBy(F.floor(F.col("row") / FAN).alias("row")).agg(F.array_sort(F.collect_list(F.struct("row", "hash"))).alias("children"))
        level = saved(level.select("row", node("children").alias("hash")), "manifest-tree")
        top = level.limit(2).collect()
        if len(top) < 2:
            return bytes(top[0]["hash"]) if top else b""


def _explode(manifest: DataFrame) -> DataFrame:
    places = F.sequence(F.lit(0), (F.length("leaves") / 20).cast("int") - 1)
    return manifest.where("length(leaves) > 0").select("row", F.posexplode(F.transform(places, lambda i: F.substring("leaves", i * 20 + F.lit(1), F.lit(20)))).alias("at", "digest"))


def _ids(data: bytes, n: int) -> np.ndarray:
    """Ids of a chunk of n of them."""
    return np.frombuffer(data, f"<u{len(data) // n}")


def read_back(chunks: DataFrame, manifest: DataFrame, root: bytes | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of 32-bit ids) of all documents, from the stored chunks.

    Every chunk is read once, hashed anew and checked against its digest; each document's root is computed from what was
    read, and with root the manifest's, and an error raised where one differs. The CRC of a document is joined from those
    of its chunks, so that chunks needn't be copied for every document that has them.
    """
    if root is not None and manifest_root(manifest) != root:
        raise ValueError("the manifest differs from its root")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, sizes = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            if [digest(x) for x in data] != batch.column(0).to_pylist():
                raise ValueError("a chunk differs from its digest")
            crcs = [zlib.crc32(_ids(x, n).astype("<u4").tobytes()) for x, n in zip(data, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "size", "crc"])

    # Written, so that the join deals both sides anew and Spark can split the rows of a chunk that is everywhere.
    sums = saved(chunks.select("digest", "n", "data").mapInArrow(hashed, "digest binary, size long, crc long"), "chunk-sums")
    found = _explode(manifest).join(sums, "digest", "left").groupBy("row").agg(F.collect_list(F.struct("at", "digest", "size", "crc")).alias("parts"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(4)
            counts = np.asarray(pc.fill_null(pc.list_value_length(parts), 0), np.int64)
            flat = pc.list_flatten(parts)
            if flat.field("size").null_count:
                raise ValueError("a chunk is missing")
            order = np.lexsort((np.asarray(flat.field("at")), np.repeat(np.arange(len(counts)), counts)))
            digests, sizes, sums_ = (flat.field(k).take(pa.array(order)).to_pylist() for k in ("digest", "size", "crc"))
            crcs, at = [], 0
            for n, want, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), counts.tolist(), strict=True):
                end = at + m
                if (merkle(digests[at:end]) if m else b"") != want or sum(sizes[at:end]) != n:
                    raise ValueError("a document differs from its manifest")
                crc = 0
                for i in range(at, end):
                    crc = joined_crc(crc, sums_[i], 4 * sizes[i])
                crcs.append(crc)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    both = manifest.join(found, "row", "left").select("doc_id", "start", "n", "root", "parts")
    return both.mapInArrow(combined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, row, start and ids (array) of all documents of the manifest, put together from their chunks."""
    pieces = _explode(manifest).join(chunks, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "n", "data"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(x["data"], x["n"]) for x in row]).tolist() if row else [] for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "row", "start", "ids"])

    joined = manifest.select("doc_id", "row", "start").join(pieces, "row", "left").select("doc_id", "row", "start", "parts")
    return joined.mapInArrow(whole, "doc_id long, row long, start long, ids array<long>")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(*write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens")))
