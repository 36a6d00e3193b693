"""Benchmark decontamination with suffix arrays over the words of training documents.

Documents are cut into shards (slices of a batch, in whole documents). For each shard a worker sorts the suffixes of
its word sequence, binary-searches every suffix of the benchmark items in it, and so gets the longest verbatim match
of each suffix and, for each window of an item, the range of all its occurrences. Words are 64-bit hashes of their
bytes. Words that no item has separate: no match goes across them, so their suffixes are left out.

The items are held in blocks of at most BLOCK_WORDS words. Each block is a broadcast of bounded size and one more pass
over the documents' batches, so a benchmark of any size works; no shuffle is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_table, read, saved, span_hashes, utf8, with_columns, words

#: Consecutive words of an item that make a window, and words of items in one broadcast.
WINDOW, BLOCK_WORDS = 10, 1_000_000
#: Bytes of documents in a shard.
SHARD_BYTES = 4 << 20
#: Benchmark suffixes that are searched at once.
SEARCH_ROWS = 4096

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.IntegerType()), T.StructField("doc_word", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
ARROW_MATCH = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))


@dataclass
class Items:
    """A block of distinct items: the ids of each, the sorted word hashes, and all words as ranks (0 after each item)."""

    ids: list[list[str]]
    vocabulary: np.ndarray
    ranks: np.ndarray
    item: np.ndarray  #: of each place in ranks
    start: np.ndarray  #: of each item in ranks
    length: np.ndarray  #: words of each item

    @classmethod
    def build(cls, ids: list[str | None], texts: list[str | None]) -> Items:
        data, offsets = utf8(pa.array(texts, pa.large_string()))
        data = lower_table()[data]
        starts, ends, first = words(data, offsets, "alnum")
        hashes = span_hashes(data, starts, ends)
        distinct: dict[bytes, tuple[int, list[str]]] = {}
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            own = distinct.setdefault(hashes[a:b].tobytes(), (i, []))[1]
            if ids[i] is not None:
                own.append(ids[i])
        kept = [i for i, _ in distinct.values()]
        length = np.diff(first)[kept]
        hashes = np.concatenate([hashes[first[i] : first[i + 1]] for i in kept]) if kept else hashes
        ids = [sorted(set(own)) for _, own in distinct.values()]
        vocabulary = np.unique(hashes)
        item = np.repeat(np.arange(len(kept)), length + 1)
        ranks = np.zeros(len(item), np.int64)
        ranks[np.arange(len(hashes)) + np.repeat(np.arange(len(kept)), length)] = np.searchsorted(vocabulary, hashes) + 1
        return cls(ids, vocabulary, ranks, item, np.cumsum(length + 1) - length - 1, length)


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Places with a rank over 0, sorted by the depth words from there (0 sorts first), by prefix doubling."""
    places = np.flatnonzero(ranks)
    if not len(places):
        return places
    padded = np.zeros(len(ranks) + 2 * depth, np.int64)
    padded[: len(ranks)] = ranks
    order, reach = np.argsort(padded[places], kind="stable"), 1
    while reach < depth:
        key = padded[places] * (int(padded.max()) + 1) + padded[places + reach]
        order = np.argsort(key)
        key = key[order]
        fresh = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        padded[places[order]] = fresh
        reach *= 2
        if fresh[-1] == len(places):
            break
    return places[order]


def _common(ranks: np.ndarray, a: np.ndarray, words_: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that the suffixes a of ranks and b of words_ share at their start, most at most."""
    n, live = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
    while len(live):
        step = np.arange(8)
        x, y = a[live, None] + n[live, None] + step, b[live, None] + n[live, None] + step
        left = np.where(x < len(ranks), ranks[np.minimum(x, len(ranks) - 1)], 0)
        right = np.where(y < len(words_), words_[np.minimum(y, len(words_) - 1)], 0)
        same = (left == right) & (right > 0)
        got = np.where(same.all(1), 8, same.argmin(1))
        n[live] = np.minimum(n[live] + got, most[live])
        live = live[(got == 8) & (n[live] < most[live])]
    return n


def _bound(order: np.ndarray, ranks: np.ndarray, words_: np.ndarray, at: np.ndarray, most: np.ndarray, upper: bool) -> np.ndarray:
    """By binary search, where the first suffix stands that isn't less than the most words from at (upper: that is greater)."""
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(order), np.int64)
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        a, b, m = order[mid], at[live], most[live]
        n = _common(ranks, a, words_, b, m)
        left, right = a + n, b + n
        x = np.where(left < len(ranks), ranks[np.minimum(left, len(ranks) - 1)], 0)
        y = np.where(right < len(words_), words_[np.minimum(right, len(words_) - 1)], 0)
        less = np.where(n == m, upper, x < y)
        lo[live] = np.where(less, mid + 1, lo[live])
        hi[live] = np.where(less, hi[live], mid)
    return lo


def longest(order: np.ndarray, ranks: np.ndarray, items: Items, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix at of the items the words of its longest match in the shard, and a place of it (-1: none)."""
    rest = items.start[items.item[at]] + items.length[items.item[at]] - at
    here = _bound(order, ranks, items.ranks, at, rest, False)
    most, place = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
    for near in (here - 1, here):
        ok = np.flatnonzero((near >= 0) & (near < len(order)))
        n = _common(ranks, order[near[ok]], items.ranks, at[ok], rest[ok])
        better = n > most[ok]
        place[ok[better]] = order[near[ok[better]]]
        most[ok[better]] = n[better]
    return most, place


def shard_matches(ranks: np.ndarray, items: Items, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal runs of hit windows in a shard: item, place in the items, place in the shard, words."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4))
    size = np.minimum(items.length, window)
    last = items.length - size
    at = np.flatnonzero((items.ranks > 0) & (np.arange(len(items.ranks)) <= (items.start + last)[items.item]))
    if not len(at) or not ranks.any():
        return empty
    order, found = suffix_array(ranks, int(items.length.max())), []
    for i in range(0, len(at), SEARCH_ROWS):
        some = at[i : i + SEARCH_ROWS]
        need = size[items.item[some]]
        some = some[longest(order, ranks, items, some)[0] >= need]
        need = size[items.item[some]]
        lo, hi = (_bound(order, ranks, items.ranks, some, need, upper) for upper in (False, True))
        n = hi - lo
        places = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        found.append((np.repeat(some, n), places))
    j, p = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(j):
        return empty
    item = items.item[j]
    sort = np.lexsort((j, p - j, item))
    j, p, item = j[sort], p[sort], item[sort]
    fresh = np.concatenate([[True], (np.diff(j) != 1) | (np.diff(p) != 1) | (np.diff(item) != 0)])
    head = np.flatnonzero(fresh)
    run = np.diff(np.append(head, len(j)))
    return item[head], j[head], p[head], run + size[item[head]] - 1


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks; the driver holds one block of them at a time."""
    ids, texts, n = [], [], 0
    for row in benchmark.select(F.col(item_id).cast("string"), F.col(text).cast("string")).toLocalIterator():
        if row[1]:
            ids.append(row[0])
            texts.append(row[1])
            n += len(row[1]) // 4 + 1
        if n >= BLOCK_WORDS:
            yield Items.build(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield Items.build(ids, texts)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of an item's window), item_ids (distinct, sorted as
    strings) and matches, the maximal verbatim matches with their places in item and document, counted in words.

    Null and empty texts have no words and no matches; so have items with null or empty texts. An item with a null id
    hits, but isn't listed. Items with the same words are searched once: their matches have the first of their ids, item_ids
    all of them. Rows stay as they are, repeated ones too; columns of docs with these names are replaced.

    Blocks go one after the other, each result written, so that one block's items are in memory at a time.
    """
    docs = docs.drop("n_hit", "item_ids", "matches", *_NEW)
    last, found = None, False
    for block in blocks(benchmark):
        if last is not None:
            docs = _with_block(saved(docs, "matches") if found else docs, last, window, text)
            found = True
        last = block
    docs = with_columns(docs, {"n_words": (T.LongType(), pa.int64())}, _counter(text), text) if last is None else _with_block(saved(docs, "matches") if found else docs, last, window, text)
    docs = docs.withColumnsRenamed({"__matches": "matches", "__ids": "item_ids"}) if last is not None else docs.withColumns({"matches": F.array().cast(MATCH), "item_ids": F.array().cast("array<string>")})
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m.doc_word.cast("long").alias("a"), (m.doc_word + m.n_words).cast("long").alias("b")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(x.a, s.end))).alias("n"), F.greatest(s.end, x.b).alias("end")),
        lambda s: s.n,
    )
    order = [c for c in docs.columns if c not in ("item_ids", "matches")]
    return docs.select(*order, "matches", covered.alias("n_hit"), F.array_sort(F.array_distinct("item_ids")).alias("item_ids"))


_NEW = ("__matches", "__ids", "__new_matches", "__new_ids")


def _with_block(docs: DataFrame, block: Items, window: int, text: str) -> DataFrame:
    """docs with what one more block of items gives added to __matches and __ids."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    ids = T.ArrayType(T.StringType())
    added = {"n_words": (T.LongType(), pa.int64()), "__new_matches": (MATCH, ARROW_MATCH), "__new_ids": (ids, pa.list_(pa.string()))}
    both = with_columns(docs, added, _searcher(sent, window, text), text, SHARD_BYTES)
    for old, new in (("__matches", "__new_matches"), ("__ids", "__new_ids")):
        both = both.withColumn(old, F.concat(old, new) if old in both.columns else F.col(new)).drop(new)
    return both


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """docs without those that hold an occurrence of a benchmark window."""
    marked = contamination(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")), benchmark, window)
    return marked.where("n_hit = 0").select("row.*")


def _word_ranks(batch: pa.RecordBatch, text: str, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's first word (with a last entry), and the shard: ranks with a 0 after each row."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    data = lower_table()[data]
    starts, ends, first = words(data, offsets, "alnum")
    if vocabulary is None:
        return first, starts
    hashes = span_hashes(data, starts, ends)
    near = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(hashes), np.int64)
    known = np.where(vocabulary[near] == hashes, near + 1, 0) if len(vocabulary) else near
    ranks = np.zeros(len(starts) + len(first), np.int64)
    ranks[np.arange(len(starts)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = known
    return first, ranks


def _counter(text: str):
    return lambda: lambda batch: [np.diff(_word_ranks(batch, text, None)[0])]


def _searcher(sent, window: int, text: str):
    def start():
        items: Items = sent.value
        ids = pa.array([x[0] if x else None for x in items.ids], pa.string())
        every, begin = pa.array([y for x in items.ids for y in x], pa.string()), np.concatenate([[0], np.cumsum([len(x) for x in items.ids])])

        def search(batch: pa.RecordBatch) -> list:
            first, ranks = _word_ranks(batch, text, items.vocabulary)
            item, j, p, n = shard_matches(ranks, items, window)
            row = np.searchsorted(first + np.arange(len(first)), p, "right") - 1
            sort = np.lexsort((j, p, row))
            item, j, p, n, row = item[sort], j[sort], p[sort], n[sort], row[sort]
            struct = pa.StructArray.from_arrays([ids.take(pa.array(item)), pa.array((j - items.start[item]).astype(np.int32)), pa.array((p - first[row] - row).astype(np.int32)), pa.array(n.astype(np.int32))], names=["item_id", "item_word", "doc_word", "n_words"])
            ends = np.searchsorted(row, np.arange(len(first)))
            # The ids of the distinct items of each row.
            hit = np.unique(row * len(items.ids) + item)
            row, item = hit // max(1, len(items.ids)), hit % max(1, len(items.ids))
            size = begin[item + 1] - begin[item]
            listed = every.take(pa.array(np.repeat(begin[item] - np.cumsum(size) + size, size) + np.arange(size.sum())))
            edges = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(row, np.arange(len(first)))]
            return [np.diff(first), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), listed)]

        return search

    return start


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS k FROM i)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.k, dw.m, iw.item_id FROM dw JOIN iw ON dw.s = iw.s AND dw.m = iw.m),
covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS x FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (r) LEFT JOIN ids USING (r)
"""
