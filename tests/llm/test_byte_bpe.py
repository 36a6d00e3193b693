import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strideline.llm.byte_bpe import ByteBpe, decode, encode

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = ByteBpe(RANKS, leaf=5, window=2)
WHOLE = ByteBpe(RANKS, leaf=10**9)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=120), st.text(alphabet="ab's \n\t'relvdm1½é你.,!", max_size=120)))
def test_any_text_as_the_library_would(text):
    assert SMALL.encode(text) == WHOLE.encoding.encode_ordinary(text)
    assert SMALL.decode(SMALL.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 9000, " " * 7000 + "x", "don't we'll 'tis " * 700, "你好" * 4000, "", "\n" * 5000, "1 " * 4000])
def test_long_texts(text):
    codec = ByteBpe(RANKS)
    assert codec.encode(text) == WHOLE.encoding.encode_ordinary(text)


def test_frames_keep_rows_nulls_and_extra_columns(spark):
    rows = [(1, "It's here", "x"), (None, None, "y"), (3, "", None), (1, "It's here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string")
    out = decode(encode(docs, RANKS), RANKS).collect()
    assert len(out) == 4 and sorted(bytes(r.decoded).decode() for r in out) == ["", "", "It's here", "It's here"]
    want = np.array(WHOLE.encode("It's here"), "<u4").tobytes()
    assert {hashlib.sha256(bytes(r.token_ids)).digest() for r in out if r.text} == {hashlib.sha256(want).digest()}
    assert encode(docs.limit(0), RANKS).count() == 0
