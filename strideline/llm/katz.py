"""Katz backoff language model: Good-Turing discounted bigrams over Good-Turing discounted unigrams.

p(w | h) = d c(h, w) / D(h) where the pair was seen in training, and alpha(h) p(w) where it wasn't. alpha(h) gives the
rest of h's mass exactly to the words not seen after h. p(w) = d c(w) / N; words never seen share what discounting leaves.

The model's tables lie in the shared folder: unigrams by word, bigrams by bucket, backoff weights by history.

* Every word of training has an id of its own. The VOCABULARY most frequent ones of at least two occurrences are numbered
  in a broadcast of fixed size; the id of any other is its hash, below 0. A bucket gets the counts of such words that its
  pairs end with by a join on the word, and has all pairs of a history (but see the last point), so it knows the history's
  count, mass and backoff weight by itself.
* With a limit (most), words beyond it are one class, UNK, in bigrams; p(w | h) = p(UNK | h) p(w) / p(UNK) for them, with
  their exact counts, which a join brings.
* Texts are read in chunks. A chunk sends each bucket its distinct pairs, how often training documents have them, and
  which documents do how often, packed. A bucket therefore counts a pair over the whole corpus, and later gives each of
  those documents the sum of its pairs' log probabilities, without the texts.
* Words with a thousandth of all tokens are at most a thousand. Pairs of two such words are counted in a table of at most
  a million rows, broadcast; their requests are dealt out by chunk.
* A history of so many tokens, or of as many as a bucket should have, is split: its pairs are dealt out by pair. The
  weights of these histories, one for BUCKET_TOKENS tokens or a thousand at most, are summed up over the buckets and broadcast.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, byte_lengths, crc_text, lower_table, mixed, read, saved, slices, span_hashes, utf8, words

VOCABULARY, BUCKET_TOKENS, HOT_SHARE = 1 << 20, 1_000_000, 1000
#: Counts up to here are discounted.
DISCOUNTED = 5
END = 0  #: the hash of the empty word, which no word has
#: The bit that ids of words outside the broadcast table have, and no others.
OUTSIDE = -(1 << 63)
CHUNK = 4 << 20


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, each row's words followed by END, and where each row starts (with an end)."""
    data, offsets = utf8(column)
    data = lower_table()[data]
    starts, ends, first = words(data, offsets, "solid")
    out = np.full(len(starts) + len(first) - 1, END, np.int64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(first) - 1), np.diff(first))] = span_hashes(data, starts, ends).view(np.int64)
    return out, first + np.arange(len(first))


def discounts(of: dict[int, int]) -> np.ndarray:
    """Good-Turing factors for counts 0 to DISCOUNTED from how many things have each count; (c - 1/2) / c where those give none."""
    k, n = DISCOUNTED, [of.get(r, 0) for r in range(DISCOUNTED + 2)]
    out = np.ones(k + 1)
    if n[1]:
        high = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0
            d = (ratio - high) / (1 - high) if high < 1 else 0
            out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * factors[np.where(counts > DISCOUNTED, 0, counts)]


@dataclass
class Vocabulary:
    """Ids: 0 for UNK, then words in the order of their hashes, then the beginning of a text; below 0 hashes of other words."""

    words: np.ndarray
    counts: np.ndarray  #: of each id in training, the beginning's (documents) included
    p: np.ndarray  #: unigram probability of each id
    factors: np.ndarray
    tokens: int
    types: int
    unseen: float  #: probability of all unseen words together
    hot: np.ndarray  #: words with a thousandth of all tokens
    split: np.ndarray  #: histories whose pairs are too many for one bucket
    whole: bool = False  #: no UNK: words outside have ids of their own

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        some, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, some), max(0, len(self.words) - 1))
        return (np.where(self.words[at] == some, at + 1, 0) if len(self.words) else np.zeros(len(some), np.int64))[back]

    def dealt(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The ids that pairs are made of."""
        return np.where(ids > 0, ids, hashes | np.int64(OUTSIDE)) if self.whole else ids

    def is_hot(self, ids: np.ndarray) -> np.ndarray:
        return self.hot[np.maximum(ids, 0)] & (ids >= 0)

    def is_split(self, ids: np.ndarray) -> np.ndarray:
        return self.split[np.maximum(ids, 0)] & (ids >= 0)

    def share(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unigram probabilities; counts: those of the words outside."""
        other = np.where(counts > 0, discounted(counts, self.factors) / max(1, self.tokens), self.unseen)
        return np.where(ids >= 0, self.p[np.maximum(ids, 0)], other)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
    some, back = np.unique(keys, return_inverse=True)
    return some, np.bincount(back, counts, len(some)).astype(np.int64)


def unigrams(texts: DataFrame) -> DataFrame:
    """word (hash), n over all texts, END included; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(0)), CHUNK):
                some, n = np.unique(hashed(part.column(0))[0], return_counts=True)
                held.append((some, n))
                size += len(some)
                if size > 2_000_000:
                    held = [_merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["word", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], names=["word", "n"])

    return saved(texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


def vocabulary(counts: DataFrame, most: int | None = None, bucket_tokens: int = BUCKET_TOKENS) -> tuple[Vocabulary, int]:
    """The vocabulary, and the least count of a word in its table."""
    cap, whole, most = 100_000, most is None, VOCABULARY if most is None else most
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    of = dict(counts.groupBy(F.least("n", F.lit(cap)).alias("n")).count().collect())  # cap rows at most
    least, kept = cap, 0
    for n in sorted(of, reverse=True):
        if n < 2 or kept + of[n] > most:
            break
        least, kept = n, kept + of[n]
    picked = counts.where((F.col("n") >= least) & (F.col("word") != END))
    picked = (picked.orderBy(F.desc("n"), "word").limit(most) if of.get(cap, 0) > most else picked).toArrow()
    found, n = np.asarray(picked.column(0)), np.asarray(picked.column(1))
    documents = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found, n = np.append(found, END), np.append(n, documents)
    order = np.argsort(found)
    found, n = found[order], n[order]
    factors = discounts(of)
    all_mass = float(sum(discounted(np.array([k]), factors)[0] * v for k, v in of.items() if k < cap)) + (tokens - sum(k * v for k, v in of.items() if k < cap))
    unseen = 1 - all_mass / tokens if tokens and all_mass < tokens else 1 / (tokens + 1)
    scale = (1 - unseen) / (all_mass / tokens) if tokens else 0.0
    p = discounted(n, factors) * scale / max(1, tokens)
    inside = np.append(np.concatenate([[tokens - n.sum()], n]), documents)
    share = np.concatenate([[max(1 - p.sum(), 1e-12)], p, [0.0]])
    hot = inside * HOT_SHARE >= max(1, tokens)
    return Vocabulary(found, inside, share, factors * scale, int(tokens), int(types), unseen, hot, hot | (inside >= bucket_tokens), whole), least


def _pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays, bytes of equal weight together, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        data = zstandard.compress(raw, 1)
        out.append(struct.pack("<cQQ", a.dtype.char.encode(), len(a), len(data)) + data)
    return b"".join(out)


def _unpack(data: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(data):
        kind, n, size = struct.unpack_from("<cQQ", data, at)
        at += 17
        kind = np.dtype(kind.decode())
        raw = zstandard.decompress(data[at : at + size]) if n else b""
        out.append(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind))
        at += size
    return out


def _grouped(pair: np.ndarray, doc: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct pairs in order; each one's training count; how many documents ask for it; these and their counts."""
    order = np.argsort(pair, kind="stable")
    pair, doc = pair[order], doc[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(fresh)
    times = np.diff(np.append(head, len(pair)))
    pair, doc = pair[head], doc[head]
    top = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    asked = np.diff(np.append(top, len(pair)))
    learnt = np.add.reduceat(np.where(train[doc], times, 0), top) if len(top) else top
    return pair[top], learnt, asked, doc, times


PARTS = "kind int, bucket long, chunk long, doc int, data binary, word long, n long, doc_id long, held_out boolean, known long, base double"
WORDS, PAIRS, HOT, COUNT, TAIL, DOC = range(-1, 5)


def _before(ids: np.ndarray, first: np.ndarray, beginning: int) -> np.ndarray:
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[first[:-1]] = beginning
    return before


def _bucket(before: np.ndarray, ids: np.ndarray, v: Vocabulary, buckets: int) -> np.ndarray:
    """The bucket of each pair that isn't hot: that of its history, or of the pair if its history is split."""
    by = np.where(v.is_split(before), mixed((before * np.int64(1000003)).view(np.uint64)) ^ mixed(ids.view(np.uint64)), before.view(np.uint64))
    return (mixed(by) % np.uint64(buckets)).astype(np.int64)


def asked_words(docs: DataFrame, counts: DataFrame, vocab, buckets: int) -> DataFrame:
    """For each bucket the words outside the table that its pairs end with: kind, bucket, word (id), n (0: not in training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(0)), CHUNK):
                hashes, first = hashed(part.column(0))
                ids = v.dealt(hashes, v.ids(hashes))
                rare = np.flatnonzero(ids < 0)
                before = _before(ids, first, len(v.words) + 1)[rare]
                ids = ids[rare]
                to = _bucket(before, ids, v, buckets)
                order = np.lexsort((to, ids))
                ids, to = ids[order], to[order]
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (to[1:] != to[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(to[fresh]), pa.array(ids[fresh])], names=["bucket", "word"])

    known = counts.select(F.col("word").bitwiseOR(F.lit(OUTSIDE)).alias("word"), F.col("n").alias("c"))
    found = docs.select("text").mapInArrow(run, "bucket long, word long").join(known, "word", "left")
    found = found.groupBy("word", "bucket").agg(F.coalesce(F.max("c"), F.lit(0)).alias("n"))
    empty = [F.lit(None).cast(t).alias(name) for name, t in (x.split() for x in PARTS.split(", ")) if name not in ("kind", "bucket", "word", "n")]
    return found.select(F.lit(WORDS).alias("kind"), "bucket", "word", "n", *empty).select(*(x.split()[0] for x in PARTS.split(", ")))


def parts(docs: DataFrame, vocab, buckets: int) -> DataFrame:
    """What the chunks of docs (doc_id, text, held_out) send: packed pairs for buckets, counts of hot pairs, words
    outside the vocabulary, and documents with the share of the base score that the vocabulary's words have."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]

    def rows(many: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(many, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocab.value
        chunk, size = (TaskContext.get().partitionId() << 24) - 1, len(v.words) + 2
        logs = np.log10((v.counts + 1) / (v.tokens + v.types + 1))
        for batch in batches:
            for part in slices(batch, byte_lengths(batch.column(1)), CHUNK):
                chunk += 1
                held = np.asarray(part.column(2)).astype(bool)
                hashes, first = hashed(part.column(1))
                ids, doc = v.ids(hashes), np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
                inside = ids > 0
                n = len(first) - 1
                known = np.bincount(doc[inside & (v.counts[ids] > 0)], minlength=n)
                base = np.bincount(doc[inside], logs[ids[inside]], n)
                yield rows(n, kind=np.full(n, DOC), bucket=np.arange(n), chunk=np.full(n, chunk), doc=np.arange(n), n=np.diff(first), doc_id=part.column(0), held_out=held, known=known, base=base)
                tail, back = np.unique(np.stack([hashes[~inside], doc[~inside]]), axis=1, return_counts=True) if (~inside).any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                yield rows(len(back), kind=np.full(len(back), TAIL), bucket=tail[0], chunk=np.full(len(back), chunk), doc=tail[1], word=tail[0], n=back)
                # Places of the ids among the chunk's own keep pairs in one number.
                own, place = np.unique(np.append(v.dealt(hashes, ids), size - 1), return_inverse=True)
                pair = _before(place[:-1], first, place[-1]) * len(own) + place[:-1]
                hot = v.is_hot(own)[pair // len(own)] & v.is_hot(own)[pair % len(own)]
                for which, kind in ((~hot, PAIRS), (hot, HOT)):
                    some, learnt, asked, who, times = _grouped(pair[which], doc[which], ~held)
                    if not len(some):
                        continue
                    h, w = own[some // len(own)], own[some % len(own)]
                    if kind == HOT:
                        code = h * size + w
                        yield rows(len(code), kind=np.full(len(code), COUNT), bucket=code, word=code, n=learnt)
                        to = (mixed((code + np.int64(chunk) * 1000003).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                    else:
                        to = _bucket(h, w, v, buckets)
                    order = np.argsort(to, kind="stable")
                    begin = np.cumsum(asked) - asked
                    at, m = begin[order], asked[order]
                    pick = np.repeat(at - np.cumsum(m) + m, m) + np.arange(m.sum())
                    h, w, learnt, asked, who, times, to = h[order], w[order], learnt[order], m, who[pick], times[pick], to[order]
                    edge = np.concatenate([[0], np.cumsum(asked)])
                    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                    blobs = []
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        c, d = edge[a], edge[b]
                        blobs.append(_pack(np.diff(h[a:b], prepend=0), w[a:b], learnt[a:b].astype(np.int32), asked[a:b].astype(np.int32), who[c:d].astype(np.int32), times[c:d].astype(np.int32)))
                    yield rows(len(blobs), kind=np.full(len(blobs), kind), bucket=to[cut[:-1]], chunk=np.full(len(blobs), chunk), data=blobs)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, PARTS)


def merged(dealt: DataFrame) -> DataFrame:
    """One row for each bucket from all packed pairs of its chunks and the counts of words outside; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        outside: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        now, schema = None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for _, chunk, data in held:
                delta, w, learnt, asked, who, times = _unpack(data)
                for to, x in zip(columns, (np.cumsum(delta), w, learnt, asked, who, times, np.full(len(who), chunk)), strict=True):
                    to.append(x)
            h, w, learnt, asked, who, times, chunk = (np.concatenate(x) for x in columns)
            columns.clear()
            order = np.lexsort((w, h))
            fresh = np.ones(len(h), bool)
            fresh[1:] = (np.diff(h[order]) != 0) | (np.diff(w[order]) != 0)
            back = np.empty(len(h), np.int32)
            back[order] = np.cumsum(fresh) - 1
            h, w = h[order[fresh]], w[order[fresh]]
            total = np.bincount(back, learnt, len(h)).astype(np.int64)
            asking = np.repeat(back, asked)
            order = np.lexsort((asking, who, chunk))
            counts, rare = np.zeros(len(w), np.int64), w < 0
            if rare.any():
                words, n = (np.concatenate(x) for x in zip(*outside[now[1]], strict=True))
                sort = np.argsort(words)
                counts[rare] = n[sort][np.searchsorted(words[sort], w[rare])]
            data = _pack(np.diff(h, prepend=0), w, total, counts, np.diff(chunk[order], prepend=0), who[order], times[order], asking[order].astype(np.int32))
            values = {"kind": now[0], "bucket": now[1], "data": data}
            yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

        for batch in batches:
            schema = batch.schema
            kind = np.asarray(batch.column(0))
            packed = (kind == PAIRS) | (kind == HOT)
            if (kind > HOT).any():
                yield batch.filter(pa.array(kind > HOT))
            if (kind == WORDS).any():
                some = batch.filter(pa.array(kind == WORDS))
                to, word, n = (np.asarray(some.column(i)) for i in (1, 5, 6))
                cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    outside.setdefault(int(to[a]), []).append((word[a:b], n[a:b]))
            if packed.any():
                some = batch.filter(pa.array(packed))
                for key in zip(*(some.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                    if key[:2] != now:
                        yield from flush()
                        held, now = [], key[:2]
                        for old in [x for x in outside if x < now[1]]:
                            del outside[old]
                    held.append(key[1:])
        yield from flush()

    return dealt.mapInArrow(run, PARTS)


def weights_of(count: np.ndarray, mass: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and log10 backoff weights of histories from their counts, and what the pairs seen have of discounted
    counts and of unigram probability."""
    denominator = count.astype(float)
    denominator[mass >= denominator - 1e-9] += 1  # nothing was discounted: the words not seen get the mass of one
    rest = 1 - p
    full = rest < 1e-9
    denominator[full] = np.maximum(mass[full], 1e-300)
    left = 1 - mass / np.maximum(denominator, 1e-300)
    return denominator, np.where(count > 0, np.log10(np.maximum(left, 1e-300) / np.where(full, 1, rest)), 0.0)


@dataclass
class Backoff:
    """Discount factors of pairs, denominators and log10 weights of the split histories, and the hot pairs with their counts."""

    factors: np.ndarray
    histories: np.ndarray
    denominator: np.ndarray
    alpha: np.ndarray
    hot_pairs: np.ndarray
    hot_counts: np.ndarray

    def log10(self, h: np.ndarray, w: np.ndarray, count: np.ndarray, outside: np.ndarray, v: Vocabulary) -> np.ndarray:
        """Log10 p(w | h) of pairs in order: of the pair where it was seen, else by one step back to the unigram."""
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        of, some, p, seen = np.cumsum(fresh) - 1, h[fresh], v.share(w, outside), count > 0
        n = len(some)
        denominator, alpha = weights_of(np.bincount(of, count, n), np.bincount(of, discounted(count, self.factors), n), np.bincount(of, np.where(seen, p, 0), n))
        split = np.flatnonzero(v.is_split(some))
        at = np.searchsorted(self.histories, some[split])
        denominator[split], alpha[split] = self.denominator[at], self.alpha[at]
        out = alpha[of] + np.log10(np.maximum(p, 1e-300))
        out[seen] = np.log10(discounted(count[seen], self.factors) / denominator[of[seen]])
        return out


def backoff(table: DataFrame, vocab, hot: tuple[np.ndarray, np.ndarray]) -> Backoff:
    """Discount factors, and the weights of the histories that no bucket has whole, from the bucket rows."""
    v: Vocabulary = vocab.value
    size = len(v.words) + 2

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total = _unpack(data)[2]
                n = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["c", "n"])

    of = {r.c: r.n for r in table.select("data").mapInArrow(numbers, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()}
    for c in hot[1]:
        of[int(c)] = of.get(int(c), 0) + 1
    factors = discounts(of)

    def sums(h: np.ndarray, w: np.ndarray, total: np.ndarray, outside: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        pick = (total > 0) & v.is_split(h)
        h, w, total, outside = h[pick], w[pick], total[pick], outside[pick]
        h, back = np.unique(h, return_inverse=True)
        return h, np.bincount(back, discounted(total, factors), len(h)), np.bincount(back, v.share(w, outside), len(h))

    def histories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                delta, w, total, outside = _unpack(data)[:4]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums(np.cumsum(delta), w, total, outside, vocab.value)], names=["h", "mass", "p"])

    weights = saved(table.select("data").mapInArrow(histories, "h long, mass double, p double").groupBy("h").agg(F.sum("mass").alias("mass"), F.sum("p").alias("p")), "backoff").toArrow()
    some = np.flatnonzero(v.split)
    mass, p = np.zeros(len(some)), np.zeros(len(some))
    for h, m, q in ((np.asarray(weights.column(0)), np.asarray(weights.column(1)), np.asarray(weights.column(2))), sums(hot[0] // size, hot[0] % size, hot[1], np.zeros_like(hot[1]), v)):
        at = np.searchsorted(some, h)
        np.add.at(mass, at, m)
        np.add.at(p, at, q)
    return Backoff(factors, some, *weights_of(v.counts[some], mass, p), *hot)


def scores(docs: DataFrame, training: Column, most: int | None = None, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    docs: doc_id, text. training: which rows the model learns from; the others are held out. A null or empty text is its
    end alone. most: words that aren't UNK in bigrams at most; without it there is no UNK. Repeated rows and ids count and are returned as often as they are there; null ids stay null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (~training).alias("held_out"))
    counts = unigrams(docs.where(~F.col("held_out")).select("text"))
    model, least = vocabulary(counts, most, bucket_tokens)
    vocab = spark.sparkContext.broadcast(model)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffles, -(-model.tokens // bucket_tokens))
    key = F.when(F.col("kind") <= HOT, F.col("bucket") * 2 + F.col("kind")).otherwise(F.xxhash64("kind", "bucket", "chunk"))
    # Buckets go to partitions in turn; what is no bucket is spread by hash.
    to = F.when(F.col("kind") <= HOT, F.pmod(F.col("bucket"), F.lit(shuffles))).otherwise(F.pmod(key, F.lit(shuffles))).cast("int")
    sent = parts(docs, vocab, buckets)
    sent = sent.union(asked_words(docs, counts, vocab, buckets)) if model.whole else sent
    dealt = sent.repartitionById(shuffles, to).sortWithinPartitions("bucket", "kind", "chunk")
    table = saved(merged(dealt), "bigrams", ["kind"])
    pairs, rows = table.where(F.col("kind") <= HOT), table.where(F.col("kind") >= TAIL)
    hot = table.where(F.col("kind") == COUNT).groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a million rows at most
    order = np.argsort(np.asarray(hot.column(0)))
    hot = np.asarray(hot.column(0))[order], np.asarray(hot.column(1))[order]
    weights = spark.sparkContext.broadcast(backoff(table.where(F.col("kind") == PAIRS), vocab, hot))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, v = weights.value, vocab.value
        for batch in batches:
            for kind, data in zip(np.asarray(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                delta, w, total, outside, chunk, who, times, asking = _unpack(data)
                h = np.cumsum(delta)
                if kind == HOT:
                    total = b.hot_counts[np.searchsorted(b.hot_pairs, h * (len(v.words) + 2) + w)]
                value = times * b.log10(h, w, total, outside, v)[asking]
                chunk = np.cumsum(chunk)
                head = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (who[1:] != who[:-1])]))
                value, chunk, who = np.add.reduceat(value, head), chunk[head], who[head]
                cut = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]]))
                out = [_pack(np.diff(who[x:y], prepend=0).astype(np.int32), value[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]]), pa.array(out, pa.binary())], names=["chunk", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(0)

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(total), now)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["chunk", "doc", "score"])

        for batch in batches:
            for chunk, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if chunk != now:
                    if now is not None:
                        yield flush()
                    now, total = chunk, np.zeros(0)
                delta, value = _unpack(data)
                who = np.cumsum(delta)
                if len(who):
                    total = np.append(total, np.zeros(max(0, int(who[-1]) + 1 - len(total))))
                    total[who] += value
        if now is not None:
            yield flush()

    sums = pairs.select("kind", "data").mapInArrow(given, "chunk long, data binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk long, doc int, score double")
    n, c = F.col("n"), F.coalesce(F.col("c"), F.lit(0))
    factor = F.lit(float(model.factors[0]))
    for r in range(1, DISCOUNTED + 1):
        factor = F.when(c == r, F.lit(float(model.factors[r]))).otherwise(factor)
    own = F.when(c > 0, c * factor / float(max(1, model.tokens))).otherwise(F.lit(float(model.unseen)))
    tail = rows.where(F.col("kind") == TAIL).select("word", "chunk", "doc", "n").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    within = F.lit(0.0) if model.whole else n * (F.log10(own) - float(np.log10(model.p[0])))
    tail = tail.select("chunk", "doc", within.alias("score"), F.when(c > 0, n).otherwise(0).alias("known"), (n * F.log10((c + 1) / float(model.tokens + model.types + 1))).alias("base"))
    heads = rows.where(F.col("kind") == DOC).select("chunk", "doc", "doc_id", "held_out", F.col("n").alias("n_tokens"), "known", "base")
    both = heads.unionByName(tail, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    total = both.groupBy("chunk", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read(spark, sf_dir, "documents"), crc_text() % 7 != 2)
