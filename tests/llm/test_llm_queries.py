"""The registered queries, whole: their SQL where there is some, else plain Python; the pipeline; helper names."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, decontaminate, jaccard, lines, media, queries, sharding, surrogates, toxicity, training_order
from loomwork.llm.common import work_dir

from .test_decontaminate import brute as leaks
from .test_jaccard import brute as linked

D = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{D}/documents.parquet")


def query(spark, name):
    return queries.QUERIES[name](spark, D)


def text(v):
    return "null" if v is None or v is pd.NA or (isinstance(v, float) and v != v) else f"{v:.6f}" if isinstance(v, float) else str(v)


def table(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(text, r)) for r in df[names].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert table(query(spark, name).toPandas()) == table(con.sql(queries.ORACLE_SQL[name]).df())


def test_op3(spark, docs):
    enc = training_order.encoding(PATH)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in query(spark, "op3_byte_bpe").collect()}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = enc.encode_ordinary(t or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert got[d] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op4(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in query(spark, "op4_ngram_jaccard").collect()), key=str)
    assert got == linked(list(zip(docs.doc_id, docs.text, strict=True)))


def test_op2(spark, docs):
    rows = query(spark, "op2_training_order").collect()
    n = len(rows)
    enc = training_order.encoding(PATH)
    tokens = sum(len(enc.encode_ordinary(t or "")) + 1 for t in docs.text)
    assert sorted(r.slot for r in rows) == sorted(r.seq for r in rows) == list(range(n)) and n == -(-tokens // training_order.LENGTH)
    assert sum(r.n_tokens for r in rows) == tokens and {d for r in rows for d in r.doc_ids} == set(docs.doc_id)


def test_op6(spark, docs):
    rows = {r.doc_id: r for r in query(spark, "op6_pii").collect()}
    every = re.compile(r"[\w.]+@[\w.]+|\(\d{3}\) \d{3}-\d{4}|(?<!\w)4\d{15}(?!\w)|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w)")
    seen = 0
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        found = every.findall(t or "")
        seen += len(found)
        assert rows[d].n_entities >= len(found) and all(x not in rows[d].text for x in found)
        if not rows[d].n_entities:
            assert rows[d].text == t
    assert seen and len(rows) == len(docs)


def test_op7(spark, docs):
    rows = {r.doc_id: r for r in query(spark, "op7_toxicity").collect()}
    assert set(rows) == set(docs.doc_id)
    by_text = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        r = rows[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert by_text.setdefault(t, r.score) == r.score


def test_op7_does_not_see_held_out_labels(spark):
    """Turning the held-out labels round changes no score."""
    frame = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train_toxicity(frame, x) for x in (labels, turned))
    assert (one is None) == (two is None) and (one is None or ((one.odds == two.odds).all() and one.bias == two.bias))


def test_op8(spark, docs):
    got = {r.doc_id: r for r in query(spark, "op8_media").collect()}
    by_text = {}
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        raw, r = (t or "").encode(), got[d]
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        file = media.avi_bytes(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest()) and r.feature.startswith("shots=")
        assert by_text.setdefault(t, r.feature) == r.feature


def test_op10(spark):
    talks = pd.read_parquet(f"{D}/conversations.parquet")
    got = query(spark, "op10_chat").collect()
    assert {r.conv_id for r in got} == set(talks.conv_id) and all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>\n" for r in got)
    squeeze = lambda s: re.sub(r"\s+", "", s)
    own = Counter()
    for r in sorted(got, key=lambda r: (r.conv_id, r.chat_turn)):
        own[r.conv_id] += len(squeeze(r.text))
    want = talks.groupby("conv_id").text.apply(lambda s: sum(len(squeeze(x or "")) for x in s))
    assert all(own[c] >= n for c, n in want.items())  # no text is lost; what is left of a marker may stand beside it


def test_pipeline(spark, docs):
    got = pipeline.run(spark, D)
    ids = {r.doc_id: r for r in got.collect()}
    kept = spark.read.parquet(f"{D}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in kept.collect()]
        kept = spark.createDataFrame(stage(spark, kept, D).collect(), kept.schema)
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "ngram_jaccard":
            assert set(after) == {c for _, _, c in linked(before)}
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            assert set(after) == {x[0] for x in leaks(before, items) if not x[3]}
    enc = training_order.encoding(PATH)
    assert set(ids) == set(after) and all(ids[d].n_tokens == len(enc.encode_ordinary(t or "")) for d, t in after.items())


EDGE = [(1, None), (2, ""), (3, "\n\n\n"), (None, "a null id"), (4, "x " * 30_000), (5, "same text of a few words"), (5, "same text of a few words"), (6, "same text of a few words"), (7, "9" * 50_000)]
HELPERS = ["__id", "__th", "__s", "__l", "__k", "__n", "__h", "__g", "__y", "__score", "__text", "__key", "id", "th", "h", "key", "n", "component", "part", "kind", "label", "name", "block"]


@pytest.mark.parametrize("rows", [EDGE, []], ids=["edges", "empty"])
def test_stages_of_the_pipeline_with_edges_and_clashing_names(spark, rows):
    """Null, empty, repeated and very long texts, null ids, an empty table, and columns with the names that operators might use themselves."""
    own = ", ".join(f"`{c}` string" for c in HELPERS)
    frame = spark.createDataFrame([(*r, "en", "s", 1, *("kept" for _ in HELPERS)) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {own}")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, D)
        assert out.columns == frame.columns, name
        got = out.collect()
        assert all(r[c] == "kept" for r in got for c in HELPERS), name
        count = Counter((r.doc_id, r.text) for r in got)
        if name in ("toxicity", "decontaminate"):
            assert count == Counter(rows), name
        if name == "ngram_jaccard" and rows:
            assert count[5, rows[5][1]] == 1 and count[6, rows[5][1]] == 0 and {1, 2, 3, None, 4, 7} <= {d for d, _ in count}
    assert pipeline.STAGES[-1][1](spark, frame, D).count() == len(rows)


@pytest.mark.parametrize("rows", [EDGE, []], ids=["edges", "empty"])
def test_operators_with_edges_and_clashing_names(spark, rows):
    own = ", ".join(f"`{c}` string" for c in HELPERS)
    frame = spark.createDataFrame([(*r, *("kept" for _ in HELPERS)) for r in rows], f"doc_id long, text string, {own}")
    bench = spark.createDataFrame([(1, "same text of a few words")], "item_id long, text string")
    for made, new in ((lines.dedup_lines(frame), ["n_lines", "n_removed"]), (surrogates.replace_pii(frame, "k"), ["entities"]), (toxicity.score_toxicity(frame, None), ["score"]), (decontaminate.find_benchmark(frame, bench), ["n_words", "hits", "items", "longest", "longest_item", "longest_at"])):
        assert made.columns == [*frame.columns, *new]
        got = made.collect()
        assert len(got) == len(rows) and all(r[c] == "kept" for r in got for c in HELPERS)
    assert len(jaccard.link_ngrams(frame).collect()) == len(bpe.encode_decode(frame, PATH).collect()) == len(media.media_columns(frame).collect()) == len(sharding.shard_rows(frame, 4).collect()) == len(rows)
    written = training_order.write_training_order(frame, f"{work_dir(spark)}/edges-{len(rows)}", "k", PATH, length=64, shard_size=16, overwrite=True)
    assert {d for r in written.collect() for d in r.doc_ids} == {d for d, _ in rows}
