"""Near duplicates by resemblance: wide SimHash fingerprints, Golay keys with room for many errors, exact verification.

Two texts with a Jaccard index of 0.8 of their five-word shingles differ in some 15 % of the bits of their SimHash, ten of
64, beyond any exact scheme with few keys. The same code finds them another way. A fingerprint of 92 bits is four words of
the 23-bit Golay code. The codewords next to a word and to its one-bit changes are its keys, as in simhash.py: words that
differ in up to 2 bits always share one, in 3 or 4 bits mostly. A join key is a key of one segment together with eight
error-free bits from either end of another: 24 choices, 127 join keys a text. At a Jaccard index of 0.8 some 86 % of pairs
share one, 94 % at 0.85, 98 % at 0.9, over 99 % at 0.95 (independent bits; README has measured figures).

Rows that share a join key are compared by 64 more bits of SimHash, which no key has, so that rows which met by chance
pass as seldom as any others. A worker hands on all candidates of a key that form no cycle, else a spanning forest, the
nearest first. Their shingle sets are then compared exactly, and links below the similarity go. A near pair that fails may
hide a wider one that holds, so what the forests left out follows: rows that candidates of such keys connect are a heap,
and in a heap that the links found leave in pieces all pairs across pieces are compared exactly, in blocks. Thus every
candidate is compared, or joined by links already.

Rows much alike share most of their keys, so keys go in two rounds. The first has four of the 24 choices, whose candidates
give the heaps so far. Pairs within one are compared anyway, so the other keys hand on pairs of different heaps only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, mixed, picked, saved, with_columns
from .components import components
from .simhash import decode, forest
from .sketches import sketches

SHINGLE, SIMILARITY = 5, 0.8
#: Segments of a fingerprint and their bits; error-free bits of a join key.
SEGMENTS, BITS, EXACT = 4, 23, 8
#: Join keys of the first round: segment, the other segment and its end.
FIRST = frozenset((s, (s + 1) % SEGMENTS, 0) for s in range(SEGMENTS))
#: Bits of 64 in which candidates differ at most: all but one in a hundred pairs at 0.8.
APART = 16
#: Rows of a join key that are compared pair by pair; beyond, rows within CLOSE bits of an earlier one meet others by it first.
WIDE, CLOSE = 8192, 4
#: Rows of a key with candidates left out, from which on its middle row is a candidate of all others near it.
STAR = 32
#: Hashes of a block of a heap; two blocks are compared in one task.
BLOCK = 1 << 20
#: Links whose components one task finds; more go by rounds of stars.
FEW = 1 << 20
#: Rows that a worker holds before it compares them.
HELD = 1 << 19
SECOND, THIRD = np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words the whole sequence is one shingle."""
    return sketches(texts, 1 << 40, shingle)


def wide_prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of sets of hashes: 64 bits and 28 more for keys, and 64 others to compare."""
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of, ones = np.repeat(np.arange(len(sets)), size), np.zeros((len(sets), 160), np.int64)
    for i in range(0, len(flat), 1 << 14):
        some = flat[i : i + (1 << 14)]
        words = np.stack([some, mixed(some ^ THIRD), mixed(some ^ SECOND)], 1).view(np.uint8).reshape(len(some), 24)[:, :20]
        row = of[i : i + len(some)]
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        ones[row[head]] += np.add.reduceat(np.unpackbits(np.ascontiguousarray(words), axis=1, bitorder="little"), head, axis=0, dtype=np.int32)
    packed = np.zeros((len(sets), 24), np.uint8)
    packed[:, :20] = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little")
    low, compared, high = packed.view(np.uint64).T
    return low.copy(), high & np.uint64((1 << 28) - 1), compared.copy()


def join_keys(low: np.ndarray, high: np.ndarray, first: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of fingerprints, or those of one round, with the index of the fingerprint that each belongs to."""
    mask, rows = np.uint64((1 << BITS) - 1), np.arange(len(low))
    parts = [low & mask, low >> np.uint64(BITS) & mask, (low >> np.uint64(2 * BITS) | high << np.uint64(64 - 2 * BITS)) & mask, high >> np.uint64(3 * BITS - 64) & mask]
    words, out = [x.astype(np.int64) for x in parts], []
    ends = [(x & ((1 << EXACT) - 1), x >> (BITS - EXACT)) for x in words]
    for s, word in enumerate(words):
        near = np.concatenate([decode(word)[:, None], decode(word[:, None] ^ (1 << np.arange(BITS)))], axis=1)
        near.sort(axis=1)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        for t in range(SEGMENTS):
            for end in range(2 if t != s else 0):
                if first is not None and first != ((s, t, end) in FIRST):
                    continue
                out.append((((s * SEGMENTS + t) * 2 + end) << (12 + EXACT) | ends[t][end][r] << 12 | near[r, c], rows[r]))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def nearest_first(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which edges of n nodes form a spanning forest of least total distance (each round joins components by their nearest edge)."""
    order = np.lexsort((b, a, distance))
    parent, kept = np.arange(n), []
    live = order
    while len(live):
        x, y = parent[a[live]], parent[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            break
        first = np.full(n, len(live))
        np.minimum.at(first, x, np.arange(len(live)))
        np.minimum.at(first, y, np.arange(len(live)))
        picked = live[np.unique(first[first < len(live)])]
        kept.append(picked)
        parent = forest(n, a[picked], b[picked], parent)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _bridges(x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs form a spanning forest of the labels x and y of their ends, the nearest first."""
    cross = np.flatnonzero(x != y)
    names, at = np.unique(np.concatenate([x[cross], y[cross]]), return_inverse=True)
    return cross[nearest_first(len(names), at[: len(cross)], at[len(cross) :], apart[cross])]


def _pairs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the places i < j with equal keys whose fingerprints differ in APART bits or fewer, and in how many; which places it left pairs of out."""
    found, step, left, cut = [], 1, np.arange(len(keys)), np.zeros(len(keys), bool)

    def kept() -> tuple[np.ndarray, ...]:
        a, b, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        keep = nearest_first(len(keys), a, b, d)
        out = np.ones(len(a), bool)
        out[keep] = False
        cut[a[out]] = True
        return a[keep], b[keep], d[keep]

    while len(left):
        left = left[left + step < len(keys)]
        left = left[keys[left] == keys[left + step]]
        apart = np.bitwise_count(prints[left] ^ prints[left + step])
        near = apart <= APART
        found.append((left[near], left[near] + step, apart[near]))
        if sum(len(x[0]) for x in found) > 1 << 22:
            found = [kept()]
        step += 1
    return *kept(), cut


def _star(nodes: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the row nearest to the majority in each bit and the rows within APART bits of it."""
    ones = sum(np.unpackbits(prints[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(prints), 1 << 16))
    hub = np.bitwise_count(prints ^ np.packbits(ones * 2 > len(prints), bitorder="little").view(np.uint64)[0]).argmin()
    near = np.bitwise_count(prints ^ prints[hub]) <= APART
    near[hub] = False
    return np.full(near.sum(), nodes[hub]), nodes[near]


class _Wide:
    """Rows of a join key with very many: pairs within APART bits that connect all that such pairs connect.

    A row within CLOSE bits of an earlier hub is its member, others are hubs. A row meets all hubs, the rows that come with
    it, and members of hubs that are too far by CLOSE bits or fewer, as long as they aren't connected. Where rows (by number)
    have labels, only pairs that connect labels go out.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.hubs, self.prints, self.label = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.members: list[list[tuple[int, int]]] = []

    def __call__(self, nodes: np.ndarray, prints: np.ndarray, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        self.rows.append((nodes, prints) if labels is None else (nodes, prints, labels))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(nodes), 256):
            found += self._block(nodes[i : i + 256], prints[i : i + 256])
        return self._between(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 2

    def _between(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, _, *labels = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        if not labels:
            return a, b
        keep = _bridges(*(labels[0][np.searchsorted(nodes, x)] for x in (a, b)), np.zeros(len(a)))
        return a[keep], b[keep]

    def _block(self, own: np.ndarray, some: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        old, found = len(self.hubs), []
        best, by = np.full(len(own), 255, np.uint8), np.zeros(len(own), np.int64)
        for k in range(0, old, 1 << 14):
            outer = np.bitwise_count(some[:, None] ^ self.prints[k : k + (1 << 14)])
            least, at = outer.min(1), outer.argmin(1)
            better = least < best
            best, by = np.where(better, least, best), np.where(better, k + at, by)
        fresh = best > CLOSE
        hub = by.copy()
        hub[fresh] = old + np.arange(fresh.sum())
        self.hubs, self.prints = np.append(self.hubs, own[fresh]), np.append(self.prints, some[fresh])
        self.label = np.append(self.label, hub[fresh])
        self.members += [[] for _ in range(int(fresh.sum()))]
        found.append((own[~fresh], self.hubs[by[~fresh]]))

        def join(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray, apart: np.ndarray) -> None:
            x, y = self.label[ha], self.label[hb]
            low, high = np.minimum(x, y), np.maximum(x, y)
            order = np.lexsort((apart, high, low))
            first = order[np.unique(low[order] * len(self.label) + high[order], return_index=True)[1]]
            keep = first[nearest_first(len(self.label), low[first], high[first], apart[first])]
            found.append((a[keep], b[keep]))
            self.label = forest(len(self.label), x[keep], y[keep])[self.label]

        near = np.flatnonzero(fresh & (best <= APART))
        if len(near):
            join(own[near], self.hubs[by[near]], hub[near], by[near], best[near])
        inner = np.bitwise_count(some[:, None] ^ some)
        r, c = np.nonzero((inner <= APART) & (self.label[hub][:, None] != self.label[hub]))
        if len(r):
            join(own[r], own[c], hub[r], hub[c], inner[r, c])
        for k in range(0, old, 1 << 14):
            outer = np.bitwise_count(some[:, None] ^ self.prints[k : min(k + (1 << 14), old)])
            other = lambda: self.label[hub][:, None] != self.label[k : min(k + (1 << 14), old)]  # noqa: B023, E731
            r, c = np.nonzero((outer <= APART) & other())
            if len(r):
                join(own[r], self.hubs[k + c], hub[r], k + c, outer[r, c])
            r, c = np.nonzero((outer > APART) & (outer <= APART + CLOSE) & other())
            for h in np.unique(c).tolist():
                if not self.members[k + h]:
                    continue
                mine = r[c == h]
                theirs, bits = (np.array(x, kind) for x, kind in zip(zip(*self.members[k + h], strict=True), (np.int64, np.uint64), strict=True))
                apart = np.bitwise_count(some[mine][:, None] ^ bits)
                x, y = np.nonzero((apart <= APART) & (self.label[hub[mine]] != self.label[k + h])[:, None])
                if len(x):
                    join(own[mine[x]], theirs[y], hub[mine[x]], np.full(len(x), k + h), apart[x, y])
        for j in np.flatnonzero(~fresh).tolist():
            self.members[by[j]].append((int(own[j]), int(some[j])))
        return found

    def star(self) -> tuple[np.ndarray, np.ndarray]:
        return self._between(*_star(*(np.concatenate(x) for x in list(zip(*self.rows, strict=True))[:2])))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, node, print, sorted by key and node, to pairs of nodes, and whether they are of a key with more pairs than these.

    With a fourth column, label, pairs within a label are known to others: of those between labels all go out, or of a key
    with more pairs a spanning forest of its labels.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n, wide, wide_key = 0, _Wide(), None

    def out(a: np.ndarray, b: np.ndarray, cut: bool) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(np.full(pairs.shape[1], cut))], names=["a", "b", "cut"])

    def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return head, np.diff(np.append(head, len(keys)))

    def flush(*rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = runs(rows[0])[1]
        rows = [x[np.repeat(size > 1, size)] for x in rows]
        if not len(rows[0]):
            return
        name = np.arange(len(rows[0]))  # of a label in a key
        if len(rows) > 3:
            head, size = runs(rows[0])
            name = np.unique(np.repeat(np.arange(len(head)), size) * len(name) + np.unique(rows[3], return_inverse=True)[1], return_inverse=True)[1]
            several = np.repeat(np.maximum.reduceat(name, head) > np.minimum.reduceat(name, head), size)
            name, rows = name[several], [x[several] for x in rows]
            if not len(name):
                return
        head, size = runs(rows[0])
        for h, m in zip(head[size > WIDE].tolist(), size[size > WIDE].tolist(), strict=True):
            one = _Wide()
            yield out(*one(*(x[h : h + m] for x in rows[1:])), True)
            yield out(*one.star(), True)
        few = np.repeat(size <= WIDE, size)
        keys, nodes, prints, name = (x[few] for x in (*rows[:3], name))
        if not len(keys):
            return
        a, b, apart, cut = _pairs(keys, prints)
        head, size = runs(keys)
        some = np.logical_or.reduceat(cut, head)
        cut = np.repeat(some, size)[a]
        whole = ~cut & (name[a] != name[b])
        yield out(nodes[a[whole]], nodes[b[whole]], False)
        a, b, apart = a[cut], b[cut], apart[cut]
        found = [(a, b)] + [_star(np.arange(h, h + m), prints[h : h + m]) for h, m in zip(head[some & (size >= STAR)].tolist(), size[some & (size >= STAR)].tolist(), strict=True)]
        if len(rows) > 3:
            stars = [np.concatenate(x) for x in zip(*found[1:], strict=True)] if found[1:] else [np.zeros(0, np.int64)] * 2
            keep, more = _bridges(name[a], name[b], apart), _bridges(name[stars[0]], name[stars[1]], np.zeros(len(stars[0])))
            found = [(a[keep], b[keep]), (stars[0][more], stars[1][more])]
        yield out(*(nodes[np.concatenate(x)] for x in zip(*found, strict=True)), True)

    for batch in batches:
        rows = [np.asarray(x) for x in batch.columns]
        rows[2] = rows[2].view(np.uint64)
        if wide_key is not None:  # the key that fills whole batches goes on
            same = int(np.searchsorted(rows[0], wide_key, "right"))
            if same:
                yield out(*wide(*(x[:same] for x in rows[1:])), True)
                rows = [x[same:] for x in rows]
            if len(rows[0]):
                yield out(*wide.star(), True)
                wide_key = None
        if not len(rows[0]):
            continue
        held.append(tuple(rows))
        n += len(rows[0])
        if n > HELD:
            whole, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
            cut = int(np.searchsorted(whole[0], whole[0][-1]))
            if cut:
                yield from flush(*(x[:cut] for x in whole))
            held, n = [tuple(x[cut:] for x in whole)], n - cut
            if n > HELD // 2:
                wide, wide_key = _Wide(), held[0][0][0]
                yield out(*wide(*held[0][1:]), True)
                held, n = [], 0
    if wide_key is not None:
        yield out(*wide.star(), True)
    if n:
        whole, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
        yield from flush(*whole)


def _sets(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """n, size and hashes (sorted, packed) of the rows that are in pairs."""
    touched = saved(pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct(), "touched")

    def start():
        def make(batch: pa.RecordBatch) -> list:
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle)
            return [pa.array([np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in sets], pa.binary())]

        return make

    sets = with_columns(picked(rows.select("n", "text"), touched), {"hashes": (T.BinaryType(), pa.binary())}, start)
    return saved(sets.select("n", (F.octet_length("hashes") / 4).cast("long").alias("size"), "hashes"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of nodes (numbers of rows) whose shingle sets have at least the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["a", "b"])

    sets = sets.select("n", "hashes")
    joined = pairs.join(sets.withColumnsRenamed({"n": "a", "hashes": "x"}), "a").join(sets.withColumnsRenamed({"n": "b", "hashes": "y"}), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _across(table: pa.Table, similarity: float) -> pa.Table:
    """The labels that links join, of all pairs of one block or of two (columns i, j, block, label, hashes)."""
    block, names = (table.column(c).to_numpy() for c in ("block", "label"))
    label = np.unique(names, return_inverse=True)[1]
    sets = [np.frombuffer(x, "<u4") for x in table.column("hashes").to_pylist()]
    size, found = np.array([len(x) for x in sets], np.int64), []
    odd = label != np.bincount(label).argmax()  # a pair of different labels has one of these

    def sweep(ones: np.ndarray, others: np.ndarray) -> None:
        if not len(ones) or not len(others):
            return
        flat, owner = np.concatenate([sets[k] for k in others]), np.repeat(np.arange(len(others)), size[others])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for k in ones.tolist():
            if (label[others] == label[k]).all():
                continue
            start, many = np.searchsorted(flat, sets[k]), np.searchsorted(flat, sets[k], "right")
            many -= start
            at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(others))
            linked = others[(both >= similarity * (size[k] + size[others] - both)) & (label[others] != label[k])]
            for x, first in zip(*np.unique(label[linked], return_index=True), strict=True):
                found.append((names[k], names[linked[first]]))
                label[label == x] = label[k]

    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    low, high = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if i == j:
        sweep(low[odd[low]], low)
    else:
        sweep(low[odd[low]], high)
        sweep(high[odd[high]], low[~odd[low]])
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.min(1, initial=1 << 62), "b": pairs.max(1, initial=-1)})


def _roots(edges: DataFrame) -> DataFrame:
    """components() of a written table, if small without its rounds."""
    if edges.count() > FEW:
        return saved(components(edges), "roots")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.stack([np.asarray(x) for x in batch.columns], 1) for batch in batches)])
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(len(nodes), at[:, 0], at[:, 1])])], names=["node", "root"])

    return saved(edges.select("a", "b").coalesce(1).mapInArrow(find, "node long, root long"), "roots")


def _left_out(pairs: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Pairs of roots that links join between rows which cut pairs connect, enough to join all that such links join; None without such rows.

    Blocks follow the sizes of sets, so that blocks whose sizes differ too much for the similarity never meet.
    """
    cut = pairs.where("cut").select("a", "b")
    for side, label in (("a", "x"), ("b", "y")):
        cut = cut.join(roots.select(F.col("node").alias(side), F.col("root").alias(label)), side, "left").withColumn(label, F.coalesce(label, side))
    crossing = saved(cut.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "crossing")
    if crossing.isEmpty():
        return None
    heaps = _roots(crossing).select(F.col("node").alias("label"), F.col("root").alias("heap"))
    labelled = sets.select(F.col("n").alias("node"), "size").join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("label"))
    parted = labelled.join(heaps, "label")
    before = F.sum(F.col("size") + 64).over(Window.partitionBy("heap").orderBy("size", "node").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") - 64
    blocked = saved(parted.withColumn("block", F.floor(before / BLOCK)), "blocked")
    blocks = saved(blocked.groupBy("heap", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("label").alias("least"), F.max("label").alias("most")), "blocks")
    one, other = (blocks.select("heap", *(F.col(c).alias(c + side) for c in blocks.columns[1:])) for side in "ij")
    tasks = one.join(other, "heap").where("blocki <= blockj").where(F.col("highi") >= F.lit(similarity - 1e-9) * F.col("lowj"))
    tasks = tasks.where("least(leasti, leastj) <> greatest(mosti, mostj)").select("heap", F.col("blocki").alias("i"), F.col("blockj").alias("j"))
    sides = tasks.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    dealt = sides.join(blocked.drop("size"), ["heap", "block"]).join(sets.select(F.col("n").alias("node"), "hashes"), "node")
    return dealt.select("heap", "i", "j", "block", "label", "hashes").groupBy("heap", "i", "j").applyInArrow(lambda table: _across(table, similarity), "a long, b long")


def groups(rows: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """n and group (the n that stands for a group) of rows n (unique), text, order (a struct; the least of a group stands for it).

    Texts with the same shingle sets are one from the start, texts without words among themselves; links are between
    different sets. rows must be the same in every run, as a written table's are.
    """
    bounded_batches(rows.sparkSession)

    def start():
        def make(batch: pa.RecordBatch) -> list:
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")), shingle)
            low, high, compared = wide_prints(sets)
            return [pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()), *(x.view(np.int64) for x in (low, high, compared))]

        return make

    made = {"digest": (T.BinaryType(), pa.binary()), "low": (T.LongType(), pa.int64()), "high": (T.LongType(), pa.int64()), "compared": (T.LongType(), pa.int64())}
    marked = saved(with_columns(rows.select("n", "order", "text"), made, start).drop("text"), "marked")
    nodes = saved(marked.groupBy("digest").agg(F.min(F.struct("order", "n")).alias("least"), *(F.first(c).alias(c) for c in ("low", "high", "compared"))), "nodes")

    def met(prints: DataFrame, first: bool) -> DataFrame:
        names = ["key", "node", "print", "label"][: len(prints.columns) - 1]

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    low, high, *others = (np.asarray(x)[i : i + 1024] for x in batch.columns)
                    key, row = join_keys(low.view(np.uint64), high.view(np.uint64), first)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(x[row]) for x in others)], names=names)

        keyed = prints.mapInArrow(keys, ", ".join(f"{x} long" for x in names))
        return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_candidates, "a long, b long, cut boolean")

    def once(pairs: DataFrame) -> DataFrame:
        return saved(pairs.groupBy("a", "b").agg(F.max("cut").alias("cut")), "candidates")

    prints = nodes.select("low", "high", F.col("least.n").alias("node"), "compared")
    pairs = once(met(prints, True))
    heaps = _roots(pairs.where("cut"))
    labelled = prints.join(heaps, "node", "left").select(*prints.columns, F.coalesce("root", "node").alias("label"))
    pairs = once(pairs.union(met(labelled, False)))
    sets = _sets(pairs, rows, shingle)
    linked = saved(_verified(pairs, sets, similarity), "links")
    roots = _roots(linked)
    more = _left_out(pairs, roots, sets, similarity)
    if more is not None:
        roots = _roots(linked.union(saved(more, "links")))
    rooted = nodes.select("digest", "least", F.col("least.n").alias("node")).join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    rooted = saved(rooted, "rooted")
    best = saved(rooted.groupBy("root").agg(F.min("least").alias("best")).select("root", F.col("best.n").alias("group")), "best")
    return marked.select("n", "digest").join(rooted.join(best, "root").select("digest", "group"), "digest").select("n", "group")


def without_similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group that links of at least the similarity connect: that with the smallest id.

    Similarity is the Jaccard index of the sets of shingles (words between white space, A-Z lower-cased). Null ids come
    last, of rows with one id any one stays. Null and empty texts are one group. Other columns stay as they are, whatever
    their names; an empty table gives one. docs must be the same in every run, as a written table is.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("n"))
    order = F.struct(F.col(f"row.{id_column}").isNull().alias("none"), F.col(f"row.{id_column}").alias("id"))
    found = groups(rows.select("n", order.alias("order"), F.col(f"row.{text}").cast("string").alias("text")), similarity, shingle)
    dropped = saved(found.where("n <> group").select("n"), "dropped")
    return picked(rows, dropped, inside=False).select("row.*")
