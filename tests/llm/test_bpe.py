import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

TEXTS = [None, "", " ", "a", "it's they'll I'd  two  spaces \n\n\n x", "é ñandú größer 漢字かな 🙂🙂 ẍ", "   x\x1c y\x85z", "a" * 3000, "ab1 " * 2000, "x" * 700 + "'" + "ll " * 9, " " * 500, "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def whole():
    c = bpe.codec()
    ranks = {t: i for i, t in enumerate(c.table)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("leaf", [1, 2, 7, 64])
def test_tree_equals_the_library(whole, leaf):
    c = bpe.codec(bpe.RANKS, leaf)
    for t in TEXTS:
        assert c.encode(t or "") == whole(t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'lsrve \n\t é漢1.\x1c(²٣\u0301Ⅷ\u200d")), max_size=60), st.integers(1, 9))
def test_any_text_any_leaf(t, leaf):
    c = bpe.codec(bpe.RANKS, leaf)
    full = bpe.codec()
    assert c.encode(t) == full._leaf(t)
    assert c.decode(c.encode(t), leaf) == t.encode()


def test_query_columns(spark, whole):
    df = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(TEXTS)] + [(None, "null id", True)], "doc_id long, text string, ids boolean")
    got = {r.doc_id: r for r in bpe.digests(df).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = whole(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0
