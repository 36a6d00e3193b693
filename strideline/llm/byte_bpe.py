"""Byte-level BPE as a reduction over a tree of text halves.

An element of the monoid is a piece of text with its token ids. Two neighbours are joined by encoding a window
around their border anew. The window ends at places where the splitting pattern must split whatever stands around
them (a Latin letter before a character of ASCII that is none: a run of letters always ends there, and no part of the
pattern looks back), so ids outside it can't change. Where there is no such place near by, the window grows, at the
end to the whole of both texts. Decoding joins the bytes of the tokens up the same kind of tree.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, with_columns

#: Characters that are encoded at once, and of the first window on either side of a border.
LEAF, WINDOW = 2048, 24


def _letter(c: str) -> bool:
    return c < "ɐ" and c.isalpha()


def _splits(a: str, b: str) -> bool:
    """Whether every segmentation splits between these neighbours."""
    return b < "\x80" and not b.isalpha() and _letter(a)


class ByteBpe:
    """Encodes and decodes with the ranks of a tiktoken file."""

    def __init__(self, rank_file: str, pattern: str = public_tokenizers.PATTERN, leaf: int = LEAF, window: int = WINDOW):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str | None) -> list[int]:
        return self._encode(text or "", 0, len(text or ""))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.encoding.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        start, reach = lo, self.window
        while reach < mid - lo:
            if found := next((i for i in range(mid - 1, mid - reach, -1) if _splits(text[i - 1], text[i])), 0):
                start = found
                break
            reach *= 4
        end, reach = hi, self.window
        while reach < hi - mid:
            if found := next((i for i in range(mid + 1, mid + reach) if _splits(text[i - 1], text[i])), 0):
                end = found
                break
            reach *= 4
        window = self.encoding.encode_ordinary(text[start:end])
        return left[: len(left) - self._count(reversed(left), text[start:mid])] + window + right[self._count(right, text[mid:end]) :]

    def _count(self, ids, text: str) -> int:
        """How many of the ids make up text."""
        left, n, ids = len(text.encode()), 0, iter(ids)
        while left > 0:
            left -= len(self.tokens[next(ids)])
            n += 1
        return n

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.tokens.__getitem__, ids))
        return self.decode(ids[: len(ids) // 2]) + self.decode(ids[len(ids) // 2 :])


@cache
def _codec(rank_file: str) -> ByteBpe:
    return ByteBpe(rank_file)


def encode(docs: DataFrame, rank_file: str, text: str = "text") -> DataFrame:
    """docs with token_ids binary: the ids of the whole text as little-endian unsigned 32-bit integers.

    A null or empty text has no ids (empty binary). Rows stay as they are, repeated ones too; a column of docs named
    token_ids is replaced. No shuffle: memory is bounded by one slice of a batch and its ids.
    """

    def start():
        codec = _codec(rank_file)
        return lambda batch: [[np.array(codec.encode(x), "<u4").tobytes() for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]]

    return with_columns(docs, {"token_ids": (T.BinaryType(), pa.binary())}, start, text)


def decode(docs: DataFrame, rank_file: str, ids: str = "token_ids") -> DataFrame:
    """docs with decoded binary, the bytes that the ids stand for; null ids give empty bytes."""

    def start():
        codec = _codec(rank_file)
        return lambda batch: [[codec.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

    return with_columns(docs, {"decoded": (T.BinaryType(), pa.binary())}, start, ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ranks), ranks)
    return both.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
