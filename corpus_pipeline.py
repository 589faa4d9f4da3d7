"""From raw documents to token ids: five stages, each by one operator of the training-data subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.bpe import encode_decode
from loomwork.llm.common import discard, free_names, read, written
from loomwork.llm.decontaminate import remove_benchmark
from loomwork.llm.jaccard import keep_one
from loomwork.llm.lines import dedup_lines
from loomwork.llm.toxicity import THRESHOLD, score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    model = train_toxicity(docs, read(spark, sf_dir, "labels"))
    (score,) = free_names(docs, "__score")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows; a text of which nothing is left goes."""
    cut = dedup_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return kept.select(*(size if c == "n_chars" else c for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return remove_benchmark(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of the decoded bytes."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep=("lang", "source"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontaminate", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: A trained score and byte-pair merges are not for SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
