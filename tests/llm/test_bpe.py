"""The encoding tree against the library on whole texts."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe

CODEC = bpe.Codec.load(*bpe.default_paths())
HARD = "ab é1'st ll \n\t .,中　\xa0🙂"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=HARD, max_size=80), st.sampled_from([1, 3, 8]))
def test_tree_equals_library(text, leaf):
    ids = bpe.encode(CODEC, text, leaf)
    assert ids.tolist() == CODEC.encoding.encode_ordinary(text)
    assert bpe.decode(CODEC, ids, leaf) == text.encode()


def test_long_runs():
    rng = random.Random(1)
    for _ in range(20):
        text = "".join(rng.choice(["a" * 300, " " * 200, "\n" * 90, "don't ", "1" * 150, " x"]) for _ in range(30))
        assert bpe.encode(CODEC, text, 64).tolist() == CODEC.encoding.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x" * 40000), (1, "a b"), (4, " é\n" * 9000)]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, ids string")
    got = bpe.bpe_round_trip(df, *bpe.default_paths()).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == want
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == CODEC.encoding.encode_ordinary(bytes(r.decoded).decode())
    assert bpe.bpe_round_trip(df.limit(0), *bpe.default_paths()).count() == 0
