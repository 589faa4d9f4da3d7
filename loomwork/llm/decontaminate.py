"""Operator 5, benchmark decontamination with suffix arrays of the documents.

A shard is a run of whole texts of one task, at most SHARD_WORDS words unless one text is longer. Its suffix array
holds the places where a suffix can match: those followed by as many benchmark words as a window has.
They are sorted to the depth of a window, as packed integers. Every suffix of every benchmark item is
binary-searched in each shard; a match is then followed word by word to its full length.

The benchmark is the query set. It is dealt into blocks of at most BLOCK_BYTES of text (or one longer item), each
broadcast on its own. A task takes every shard through all blocks, one of them in memory at a time, and merges
what they find; the result does not depend on how many there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shipping import ship

from .common import discard, read, texts, trim, written

WINDOW, SHARD_WORDS, BLOCK_BYTES = 10, 1_000_000, 32_000_000
#: A-Z become a-z; all other bytes but digits, a-z and those above 0x7F part words.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Benchmark:
    """Word numbers of the items, and their windows by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        items = sorted(items, key=lambda x: x[0])  # of equal matches the least name wins
        self.names = [name for name, _ in items]
        lists = [words(text) for _, text in items]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in lists for w in ws), 1)}
        flat, windows = [-1], {}
        for item, ws in enumerate(lists):
            size = min(window, len(ws))
            if size:
                windows.setdefault(size, []).extend((item, len(flat) + i) for i in range(len(ws) - size + 1))
            flat += [self.number[w] for w in ws] + [-1]
        self.flat = np.array(flat + [-1] * window, dtype=np.int64)
        self.windows = {size: np.array(pairs, dtype=np.int64) for size, pairs in windows.items()}
        self.most = max(map(len, lists), default=0)

    def packed(self, a: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
        """Keys of the size words from each place: as many words to an integer as fit."""
        base = len(self.number) + 1
        each = max(1, int(62 // np.log2(base + 1)))
        keys = []
        for begin in range(0, size, each):
            key = np.zeros(len(at), dtype=np.int64)
            for k in range(begin, min(begin + each, size)):
                key = key * base + a[at + k]
            keys.append(key)
        return keys

    def occurrences(self, a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a, and the numbers of the windows of this size that stand there."""
        gap = np.flatnonzero(a == 0)
        room = np.repeat(gap, np.diff(gap, prepend=-1)) - np.arange(len(a))  # words up to the next one that no item has
        at = np.flatnonzero(room >= size)
        ask = self.windows[size]
        if not len(at):
            return at, at
        have, want = self.packed(a, at, size), self.packed(self.flat, ask[:, 1], size)
        rank, asked = np.zeros(len(at), dtype=np.int64), np.zeros(len(ask), dtype=np.int64)
        for h, w in zip(have, want, strict=True):
            both = np.unique(np.concatenate((h, w)))
            key, goal = rank * len(both) + np.searchsorted(both, h), asked * len(both) + np.searchsorted(both, w)
            both = np.unique(np.concatenate((key, goal)))
            rank, asked = np.searchsorted(both, key), np.searchsorted(both, goal)
        order = np.argsort(rank, kind="stable")
        suffixes, sorted_rank = at[order], rank[order]
        left, right = np.searchsorted(sorted_rank, asked, "left"), np.searchsorted(sorted_rank, asked, "right")
        n = right - left
        which = np.repeat(np.arange(len(ask)), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return suffixes[left[which] + inside], which

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[list[int]], list[int], tuple[int, int, int] | None]]:
        """For each document: spans of words inside windows, items, and the longest match (words, item, place)."""
        get = self.number.get
        a = np.array([x for ws in docs for x in ([get(w, 0) for w in ws] + [0])] + [0] * WINDOW, dtype=np.int64)
        starts = np.cumsum([0] + [len(ws) + 1 for ws in docs])
        out: list = [([], [], None)] * len(docs)
        found = []
        for size in self.windows:
            place, which = self.occurrences(a, size)
            if len(place):
                found.append((place, np.full(len(place), size), *self.windows[size][which].T))
        if not found:
            return out
        place, size, item, source = (np.concatenate(x) for x in zip(*found, strict=True))
        length, open_ = size.copy(), np.arange(len(place))
        while len(open_):  # an item ends with -1 and a document with 0, so no match runs beyond either
            open_ = open_[a[np.minimum(place[open_] + length[open_], len(a) - 1)] == self.flat[source[open_] + length[open_]]]
            length[open_] += 1
        cover = np.zeros(len(a) + 1, dtype=np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + size, -1)
        edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(starts, place, "right") - 1
        for d, i in np.unique(np.stack((doc, item), axis=1), axis=0).tolist():
            if not out[d][1]:
                out[d] = ([], [], None)
                best = np.flatnonzero(doc == d)
                k = best[np.lexsort((place[best], item[best], -length[best]))[0]]
                out[d] = ([], [], (int(length[k]), int(item[k]), int(place[k] - starts[d])))
            out[d][1].append(i)
        for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(starts, begin, "right") - 1).tolist(), strict=True):
            out[d][0].append([b - int(starts[d]), e - int(starts[d])])
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str | None]]]:
    """The distinct items by block, one block on the driver at a time. Blocks go by hash; their number grows until each keeps to size or is one item."""
    item = F.coalesce(F.col(item_col).cast("string"), F.lit(""))
    items = benchmark.select(item.alias("name"), F.col(text_col).alias("text")).distinct().withColumn("n", F.coalesce(F.octet_length("text"), F.lit(0)))
    items = written(items.withColumn("h", F.xxhash64("name", "text")), "benchmark")
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // size))
    block = lambda: F.pmod(F.col("h"), F.lit(n))
    while not items.groupBy(block().alias("b")).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("m")).where((F.col("s") > size) & (F.col("m") > 1)).isEmpty():
        n *= 2
    own = written(items.withColumn("block", block()).repartitionByRange("block").sortWithinPartitions("block"), "blocks")
    discard(items)
    for b in sorted(r.block for r in own.select("block").distinct().collect()) or [0]:  # a row a block
        yield [(r.name, r.text) for r in own.where(F.col("block") == b).select("name", "text").collect()]
    discard(own)


Found = tuple[list[list[int]], set[str], tuple[int, str, int] | None]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans, those that touch or overlap made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search_blocks(docs: list[list[bytes]], blocks: Iterable[Benchmark]) -> list[Found]:
    """Spans, item names and the longest match (words, name, place) of each document over all blocks; of equal matches the least name, then place."""
    out: list[Found] = [([], set(), None) for _ in docs]
    for bench in blocks:
        for i, (spans, items, best) in enumerate(bench.search(docs)):
            if best:
                own = best[0], bench.names[best[1]], best[2]
                held = out[i]
                held[1].update(bench.names[k] for k in items)
                out[i] = (held[0] + spans, held[1], min((x for x in (held[2], own) if x), key=lambda x: (-x[0], x[1], x[2])))
    return [(merged(spans), names, best) for spans, names, best in out]


def find_benchmark(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """df's columns, then n_words, hits (spans of word positions inside windows), items (sorted strings),
    longest (words of the longest verbatim match, 0 if none), longest_item (of equal matches the least item as a string), longest_at (first word).

    A window is WINDOW consecutive words of an item, or the whole of a shorter one that has words. Null
    and empty texts have no words; repeated rows each have their result; with an empty benchmark nothing
    is hit. Columns of df with the new names are replaced. Null item ids count as the item ''; items that agree in id and text are one.
    """
    ship(df.sparkSession)
    spark = df.sparkSession
    new = "n_words long, hits array<array<long>>, items array<string>, longest long, longest_item string, longest_at long"
    added = [x.split()[0] for x in new.split(", ")]
    names = [c for c in df.columns if c not in added]
    kind = pa.list_(pa.list_(pa.int64()))

    blocks = [spark.sparkContext.broadcast(Benchmark(items)) for items in _blocks(benchmark, item_col, item_text, block_bytes)]

    def loaded() -> Iterator[Benchmark]:
        for shared in blocks:
            yield shared.value
            if len(blocks) > 1:
                shared.__dict__.pop("_value", None)  # read again from the executor's disk when its turn comes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, source = 0, texts(batch.column(text_col))
            while begin < len(batch):
                docs, held = [], 0
                while begin + len(docs) < len(batch) and (not docs or held < SHARD_WORDS):
                    docs.append(words(next(source)))
                    held += len(docs[-1])
                rows = [(len(ws), spans, sorted(own), *(best or (0, None, None))) for ws, (spans, own, best) in zip(docs, search_blocks(docs, loaded()), strict=True)]
                kinds = [pa.int64(), kind, pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
                extra = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                part = batch.slice(begin, len(docs))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *extra], [*names, *added])
                begin += len(docs)
        trim()

    source = df.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{schema}, {new}")


def n_hit() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def remove_benchmark(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df in which no benchmark window occurs, with df's columns."""
    number = {c: f"__{i}" for i, c in enumerate(df.columns)}  # so that no name can clash
    found = find_benchmark(df.toDF(*number.values()), benchmark, number[text_col])
    return found.where(F.size("items") == 0).select(*(F.col(n).alias(c) for c, n in number.items()))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


SQL = r"""
WITH raw AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
word AS (
  SELECT kind, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM raw),
bench AS (
  SELECT id AS item_id, least(10, len(w)) AS size, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM word WHERE kind = 'b' AND len(w) > 0),
ask AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM bench),
place AS (
  SELECT id AS doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM word, (SELECT DISTINCT size FROM ask) AS s WHERE kind = 'd'),
hit AS (
  SELECT p.doc_id, p.i, p.size, a.item_id FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM place) p JOIN ask a USING (size, g)),
spot AS (
  SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(spot.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(item.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(item.names, '')) AS items_sha256, coalesce(spot.n, 0) > 0 AS contaminated
FROM word w LEFT JOIN spot ON spot.doc_id = w.id LEFT JOIN item ON item.doc_id = w.id WHERE w.kind = 'd'
"""
