"""Indexes, weights, spelling and classifiers over texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import HEX, word_bits
from ..scratch import written
from ..shipping import ship
from .relational import top_k


#: Characters of the texts that a task gets; words of queries in documents.
CHARS, WANTED = 1 << 23, 1 << 18


def dealt(docs: DataFrame, by: str) -> DataFrame:
    """docs (by, text, ...) dealt out by a column to tasks of about CHARS characters. Counts by that column and others then need no shuffle: the texts go
    over the network once, not each of their words with its key. Few texts stay as they are."""
    n = (docs.agg(F.sum(F.length("text")).alias("n")).head().n or 0) // CHARS
    return docs.repartition(n, by) if n > 4 else docs


def term_counts(df: DataFrame, key: str, words: Column, *also: str) -> DataFrame:
    """(also, key, word, f): partial counts before the shuffle, and no shuffle of words where df is dealt out by key or one of also, which key decides."""
    return df.select(*also, key, F.explode(words).alias("word")).groupBy(*also, key, "word").agg(F.count(F.lit(1)).alias("f"))


def postings(counts: DataFrame, key: str) -> DataFrame:
    """(word, postings): ``key:f`` in the order of keys. A very common word has a long list: the exploded form is the index to use at scale."""
    one = F.struct(F.col(key).alias("k"), "f")
    listed = counts.groupBy("word").agg(F.array_sort(F.collect_list(one)).alias("l"))
    return listed.select("word", F.array_join(F.transform("l", lambda p: F.concat_ws(":", p.k.cast("string"), p.f.cast("string"))), " ").alias("postings"))


def tfidf(counts: DataFrame, key: str, rare: float = 1e-6) -> DataFrame:
    """(key, word, score): f over the largest f of the key, times log2(N / n). Words under the share rare of all tokens are left out first."""
    # by word, in one pass: all its tokens, and the keys that have it; a word is left out as a whole, so both hold for what stays
    words = counts.groupBy("word").agg(F.sum("f").alias("w"), F.count(F.lit(1)).alias("n"))
    total = words.agg(F.sum("w").alias("total"))
    kept = words.crossJoin(F.broadcast(total)).where(F.col("w") >= rare * F.col("total")).select("word", "n")
    common = counts.join(kept, "word")
    most = common.groupBy(key).agg(F.max("f").alias("most"))
    n_docs = most.agg(F.count(F.lit(1)).alias("docs"))
    joined = common.join(most, key).crossJoin(F.broadcast(n_docs))
    return joined.select(key, "word", (F.col("f") / F.col("most") * F.log2(F.col("docs") / F.col("n"))).alias("score"))


def top_terms(scores: DataFrame, key: str, k: int) -> DataFrame:
    """The k best words of each key; of equal scores the later word."""
    return top_k(scores, [key], [F.desc("score"), F.desc("word")], k)


def search(queries: DataFrame, docs: DataFrame, words: Column, k: int = 10) -> DataFrame:
    """(item_id, doc_id, score, r): the k best documents (doc_id, ...) of each query by sum of (1 + ln tf) * log2(N / df).
    queries: (item_id, word), distinct. Only tokens that a query has are counted and shuffled."""
    tokens = docs.select("doc_id", F.explode(words).alias("word")).join(queries.select("word").distinct(), "word", "left_semi")
    wanted = tokens.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("f"))
    wanted = written(wanted, "wanted")
    n_docs = docs.agg(F.count(F.lit(1)).alias("docs"))
    df = wanted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # The words of the queries are few. Dealt out by document, what a document scores is summed where its words are.
    mine = wanted.repartition(max(1, wanted.count() // WANTED), "doc_id")
    weighed = mine.join(F.broadcast(df), "word").crossJoin(F.broadcast(n_docs)).select("word", "doc_id", ((1 + F.log("f")) * F.log2(F.col("docs") / F.col("df"))).alias("w"))
    scored = weighed.join(F.broadcast(queries), "word").groupBy("item_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(scored, ["item_id"], [F.desc("score"), F.col("doc_id")], k)


def _deletes(word: Column) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def _two_deletes(word: Column) -> Column:
    """Every form with up to two letters deleted."""
    return F.array_distinct(F.flatten(F.transform(_deletes(word), _deletes)))


def swapped(a: Column, b: Column) -> Column:
    """b is a with two neighbouring letters exchanged."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.length(a) == F.length(b)) & (F.length(a) > 1) & (F.size(at) > 0)


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, other) with edit distance 1 at most, or a swap of neighbours; candidates share a form with one letter deleted."""
    a = left.select("word", F.explode(_deletes(F.col("word"))).alias("v"))
    b = right.select(F.col("word").alias("other"), F.explode(_deletes(F.col("word"))).alias("v"))
    met = a.join(b, "v").select("word", "other").distinct()
    return met.where((F.levenshtein("word", "other") <= 1) | swapped(F.col("word"), F.col("other")))


def spell(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, fix): the word if the dictionary (word, n) has it; else the most frequent word at distance 1 (edit or
    swap), else at edit distance 2, else the word itself. Of equal counts the first word. queries is a stated set of distinct words."""
    known = queries.join(dictionary.select("word"), "word", "left_semi").select("word", F.col("word").alias("fix"))
    unknown = queries.join(dictionary.select("word"), "word", "left_anti")
    n = dictionary.select(F.col("word").alias("other"), "n")
    best = F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("fix")
    one = near_words(unknown, dictionary).join(n, "other").groupBy("word").agg(best)
    rest = unknown.join(one, "word", "left_anti")
    # words at distance two share a form with two letters deleted at most
    asked = rest.select("word", F.explode(_two_deletes(F.col("word"))).alias("v"))
    met = asked.join(n.select("other", F.explode(_two_deletes(F.col("other"))).alias("v")), "v").select("word", "other").distinct()
    two = met.where(F.levenshtein("word", "other", 2) >= 0).join(n, "other").groupBy("word").agg(best)
    left = rest.join(two, "word", "left_anti").select("word", F.col("word").alias("fix"))
    return known.unionByName(one).unionByName(two).unionByName(left)


def nb_counts(tokens: DataFrame, *labels: str) -> DataFrame:
    """(word, and c0_<label>, c1_<label> for each of the labels) of tokens (word, labels 0 or 1), in one pass."""
    return tokens.groupBy("word").agg(*(F.count_if(F.col(label) == c).alias(f"c{c}_{label}") for label in labels for c in (0, 1)))


def nb_predict(tokens: DataFrame, counts: DataFrame, priors: DataFrame, key: str, *labels: str) -> DataFrame:
    """(key, a column for each label): class 0 only if its score is strictly greater. tokens (key, word), a row a token; counts as of nb_counts, where a
    word that a label has not seen counts nothing for it; priors one row (n0_<label>, n1_<label>). Unseen words are skipped."""
    seen = lambda label: F.col(f"c0_{label}") + F.col(f"c1_{label}") > 0
    totals = counts.agg(*(x for label in labels for x in (F.sum(f"c0_{label}").alias(f"t0_{label}"), F.sum(f"c1_{label}").alias(f"t1_{label}"), F.count_if(seen(label)).alias(f"v_{label}"))))
    odds = lambda c, label: F.when(seen(label), F.log((F.col(f"c{c}_{label}") + 1) / (F.col(f"t{c}_{label}") + F.col(f"v_{label}")))).otherwise(0.0)
    p = counts.crossJoin(F.broadcast(totals)).select("word", *(odds(c, label).alias(f"l{c}_{label}") for label in labels for c in (0, 1)))
    bag = tokens.groupBy(key, "word").agg(F.count(F.lit(1)).alias("f"))
    # a left join, so that a key of unseen words alone has the class of the priors
    sums = bag.join(p, "word", "left").groupBy(key).agg(*(F.coalesce(F.sum(F.col("f") * F.col(f"l{c}_{label}")), F.lit(0.0)).alias(f"s{c}_{label}") for label in labels for c in (0, 1)))
    zero = lambda label: F.col(f"s0_{label}") + F.log(f"n0_{label}") > F.col(f"s1_{label}") + F.log(f"n1_{label}")
    return sums.crossJoin(F.broadcast(priors)).select(key, *(F.when(zero(label), 0).otherwise(1).alias(label) for label in labels))


def simhash(counts: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint): bit i is set if, weighed by counts (key, word, f), more words have it set than not. Sums by bit are partial before the shuffle."""
    bits = range(4 * HEX)
    word = counts.withColumn("b", word_bits(F.col("word")))
    sums = word.groupBy(key).agg(*(F.sum(F.when(F.getbit("b", F.lit(i)) == 1, F.col("f")).otherwise(-F.col("f"))).alias(f"b{i}") for i in bits))
    fingerprint = F.lit(0).cast("long")
    for i in bits:
        fingerprint = fingerprint + F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(0)
    return sums.select(key, fingerprint.alias("fingerprint"))


def one_letter_apart(words: DataFrame) -> DataFrame:
    """(a, b), a < b: words (word), distinct, that differ in one letter of one length. They share the form with that place left open."""
    place = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")
    open_ = words.where("word <> ''").select("word", place).select("word", "i", F.concat(F.expr("substring(word, 1, i - 1)"), F.lit("\x00"), F.expr("substring(word, i + 1)")).alias("v"))
    return open_.select(F.col("word").alias("a"), "v").join(open_.select(F.col("word").alias("b"), "v"), "v").where("a < b").select("a", "b")


def posting_segments(counts: DataFrame, key: str, width: int) -> DataFrame:
    """(word, segment, postings): as postings, cut by ranges of width keys (numbers), so that no row holds more than width of them. Counts may bring the segment."""
    one = F.struct(F.col(key).alias("k"), "f")
    segment = F.col("segment") if "segment" in counts.columns else F.floor(F.col(key) / width).alias("segment")
    listed = counts.groupBy("word", segment).agg(F.sort_array(F.collect_list(one)).alias("l"))
    return listed.select("word", "segment", F.array_join(F.transform("l", lambda p: F.concat_ws(":", p.k.cast("string"), p.f.cast("string"))), " ").alias("postings"))


def heaps(first: DataFrame, tokens: DataFrame, points: int) -> DataFrame:
    """One row (b, log_k, n) of the line through ln V over ln N, V = k N^b: vocabulary and tokens after each of so many equal ranges of
    the texts' numbers. first (p): the range that each word is first met in; tokens (p, n): tokens by range. Only ranges with tokens are points."""
    new = first.groupBy("p").agg(F.count(F.lit(1)).alias("new"))
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as points
    grown = tokens.join(new, "p", "left").select("p", F.log(F.sum("n").over(w)).alias("x"), F.log(F.sum(F.coalesce("new", F.lit(0))).over(w)).alias("y"))
    return grown.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("log_k"), F.count(F.lit(1)).alias("n"))


def viterbi(tokens: DataFrame, key: str, transition: np.ndarray, n_tags: int, unknown: int = 5) -> DataFrame:
    """(key, pos, tag): best path in log space over tokens (key, pos, emission: array of n_tags probabilities or null for an unknown word).

    transition has n_tags + 1 rows (the last is the start) and n_tags + 1 columns (the last is the end). An unknown word may
    have any of the first unknown tags. A sentence is one group; its length is that of one text."""
    ship(tokens.sparkSession)
    with np.errstate(divide="ignore"):
        move = np.log(transition)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        a, back = None, []
        for e in pdf["emission"]:
            if e is None:
                score = np.where(np.arange(n_tags) < unknown, 0.0, -np.inf)
            else:
                with np.errstate(divide="ignore"):
                    score = np.log(np.asarray(e, dtype=float))
            if not np.isfinite(score).any():
                score = np.zeros(n_tags)
            if a is None:
                a = move[n_tags, :n_tags] + score
            else:
                step = a[:, None] + move[:n_tags, :n_tags]
                back.append(step.argmax(axis=0))
                a = step.max(axis=0) + score
        state = int((a + move[:n_tags, n_tags]).argmax())
        path = [state]
        for b in reversed(back):
            path.append(state := int(b[state]))
        return pd.DataFrame({key: pdf[key], "pos": pdf["pos"], "tag": path[::-1]})

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(key, "pos", "emission").groupBy(key).applyInPandas(best, f"{key} {kind}, pos int, tag int")
