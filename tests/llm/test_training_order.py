import uuid

import numpy as np
import public_tokenizers as tokenizers
import pytest

from loomwork.llm.common import work_dir
from loomwork.llm.training_order import Permutation, encoding, read_sequences, write_training_order

from .brute import documents

PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4099])
def test_permutation(n):
    p = Permutation("key", n)
    y = p(np.arange(n))
    assert sorted(y) == list(range(n)) and (p(y, back=True) == np.arange(n)).all()
    if n > 100:
        assert (Permutation("other", n)(np.arange(n)) != y).mean() > 0.9


def test_shards_hold_the_corpus(spark):
    rows = documents(2, 40)
    where = f"{work_dir(spark)}/order-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int")
    source = [t or "" for _, t in rows]  # the stream has the rows as the scan has them
    out = write_training_order(df, where, "k", PATH, length=64, shard_size=10).collect()
    seqs = list(read_sequences(where, 0, 64, 10))
    n = len(seqs)
    assert n == len(out) and sorted(r.slot for r in out) == list(range(n))
    assert all(r.byte_offset == r.slot % 10 * 128 and r.shard == r.slot // 10 for r in out)
    stream = np.concatenate([seqs[s] for s in Permutation("k", n)(np.arange(n))])
    enc = encoding(PATH)
    cuts = np.flatnonzero(stream == enc.n_vocab)
    texts = [enc.decode(stream[a:b].tolist()) for a, b in zip([0, *(cuts + 1)[:-1]], cuts, strict=True)]
    assert texts[: len(source)] == source and not any(texts[len(source) :])
    for start in (7, n - 1, n):
        assert [x.tolist() for x in read_sequences(where, start, 64, 10)] == [x.tolist() for x in seqs[start:]]


def test_again_and_empty(spark):
    where = f"{work_dir(spark)}/order-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "some words to write")], "doc_id long, text string")
    one, two = (write_training_order(df, where, "k", PATH, length=8, shard_size=2).collect() for _ in range(2))
    assert [(r.slot, r.ids_sha256) for r in one] == [(r.slot, r.ids_sha256) for r in two]
    assert write_training_order(df.limit(0), where + "-none", "k", PATH).count() == 0


def _shas(spark, where, rows, key="k", **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.slot: r.ids_sha256 for r in write_training_order(df, where, key, PATH, length=8, shard_size=3, **how).collect()}


def test_another_run_is_refused_or_cleared(spark):
    """Shards of one size, so that sizes alone would not tell two runs apart."""
    new = lambda: f"{work_dir(spark)}/order-{uuid.uuid4().hex}"
    one = [(i, f"text number {i} of the first corpus") for i in range(20)]
    two = [(i, f"text number {i} of the other corpus") for i in range(20)]
    for rows, key in ((one, "other key"), (two, "k"), (one[:7], "k")):
        where = new()
        _shas(spark, where, one)
        with pytest.raises(ValueError, match="another run"):
            _shas(spark, where, rows, key)
        got = _shas(spark, where, rows, key, overwrite=True)
        assert got == _shas(spark, new(), rows, key)
        assert len(list(read_sequences(where, 0, 8, 3))) == len(got)  # no shard of the longer corpus is left


def test_a_stopped_run_goes_on(spark, tmp_path):
    rows = [(i, f"text number {i} of the first corpus") for i in range(20)]
    want = _shas(spark, f"file://{tmp_path}", rows)
    (tmp_path / "shard-00000001.u16").unlink()
    (tmp_path / "shard-00000002.u16.0123").write_bytes(b"left by a lost task")
    assert _shas(spark, f"file://{tmp_path}", rows) == want
    assert not list(tmp_path.glob("*.0123"))


def test_wide_vocabulary_is_refused(spark, monkeypatch):
    class Wide:
        n_vocab = 70_000

    monkeypatch.setattr("loomwork.llm.training_order.encoding", lambda path: Wide)
    with pytest.raises(ValueError, match="16 bits"):
        write_training_order(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "file:///tmp/none", "k", PATH)
