import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.bpe import Vocabulary, encode_decode

from .brute import documents

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")
OWN = Vocabulary(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


def ids(text):
    return np.array(REFERENCE.encode_ordinary(text), dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    got = OWN.encode(texts)
    assert got == [ids(t) for t in texts]
    assert [OWN.decode(x) for x in got] == [t.encode() for t in texts]


def test_repeats_and_long_words(monkeypatch):
    rng = random.Random(1)
    texts = ["a" * 5000, "ab" * 4000, "中" * 3000, "".join(rng.choice("abcdeé ") for _ in range(20000)), " " * 900 + "x", "<|endoftext|>"]
    monkeypatch.setattr("loomwork.llm.bpe.BLOCK_BYTES", 6000)
    monkeypatch.setattr("loomwork.llm.bpe.SYMBOLS", 500)
    monkeypatch.setattr("loomwork.llm.bpe.KEPT_WORDS", 10)
    assert OWN.encode(texts) == [ids(t) for t in texts]


def test_frame(spark):
    rows = documents(4)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = encode_decode(df, PATH)
    want = sorted(((r[0] is None, r[0], ids(r[1] or "").hex(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)
    assert sorted(((r.doc_id is None, r.doc_id, bytes(r.ids).hex(), r.decoded_sha256) for r in got.collect()), key=str) == want
    assert all(r.n_tokens * 4 == len(r.ids) and r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() for r in got.collect())
    assert encode_decode(df.limit(0), PATH).count() == 0


def test_next_task_knows_frequent_words(monkeypatch):
    """What a task leaves to the next one is bounded, is not replayed again, and gives the same ids."""
    monkeypatch.setattr("loomwork.llm.bpe.LEFT_WORDS", 3)
    own = Vocabulary(PATH)
    assert own.encode(["zqxjv"]) == [ids("zqxjv")]
    own.encode(["wkfpz qqzzx xvvkq jjwqz"])
    own.forget()
    assert len(own.known) == 3
    monkeypatch.setattr(own, "replay", None)
    assert own.encode(["zqxjv"]) == [ids("zqxjv")]
