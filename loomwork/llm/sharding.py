"""Operator 9, sharding: contiguous shards of ordered atomic groups with the least largest size.

Rows with equal texts form one atomic group. Groups stand in the order of their key, the MD5 of the
text (a null text counts as empty). The smallest capacity with which a greedy pass
needs no more than ``n_shards`` shards is found by binary search; the cuts then lie as near to equal
sizes as that capacity allows.

No pass holds all groups. Sizes are first summed by key prefix; a prefix in which a cut can fall is
divided by two more hex digits, again and again, until every cut stands between two whole groups. The driver sees the first 65,536 sums and then only the divided prefixes, however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, read, written

#: Hex digits of the first sums and of each further division.
FIRST_DIGITS, MORE_DIGITS = 4, 2


class Cells:
    """Sizes by key range, in key order. A cell is (end key or None if it holds several groups, prefix, size)."""

    def __init__(self, cells: list[tuple[str, str | None, int]]):
        self.cells = sorted(cells, key=lambda c: c[0])
        self.ends = [0, *accumulate(c[2] for c in self.cells)]
        self.total = self.ends[-1]

    def whole(self, i: int) -> bool:
        return self.cells[i][1] is not None

    def at(self, x: int) -> tuple[int, int | None]:
        """The last known border up to x, and the divisible cell that holds x, if one does."""
        i = bisect_right(self.ends, x) - 1
        inside = i < len(self.cells) and x > self.ends[i] and not self.whole(i)
        return self.ends[i], i if inside else None

    def reach(self, start: int, capacity: int, bold: bool) -> int:
        """How far one shard gets from start; bold: as if divisible cells could be cut anywhere."""
        x = min(start + capacity, self.total)
        border, inside = self.at(x)
        return x if bold and inside is not None else border

    def greedy(self, capacity: int, shards: int, bold: bool) -> list[int]:
        out, x = [], 0
        for _ in range(shards):
            x = self.reach(x, capacity, bold)
            out.append(x)
        return out

    def least(self, shards: int, bold: bool) -> int:
        low, high = -(-self.total // shards), max(self.total, 1)
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, bold)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def cuts(self, shards: int) -> tuple[list[int], set[int], int]:
        """Cut positions, the cells to divide first (then the cuts are not final), and the capacity."""
        low, high = self.least(shards, True), self.least(shards, False)
        if low < high:
            hit: set[int] = set()
            for a, b in zip(self.greedy(low, shards, False), self.greedy(high, shards, True), strict=True):
                i, j = bisect_right(self.ends, a) - 1, bisect_left(self.ends, b)
                hit.update(k for k in range(i, min(j + 1, len(self.cells))) if not self.whole(k))
            return [], hit, high
        hit = set()

        def border(x: int, up: bool) -> int:
            got, inside = self.at(x)
            if inside is not None:
                hit.add(inside)
            return got if not up or got == x else self.ends[bisect_left(self.ends, x)]

        # latest[i]: where shard i must have begun at the earliest, so that the rest fits
        latest, x = [self.total], self.total
        for _ in range(shards - 1):
            x = border(max(0, x - low), True)
            latest.append(x)
        latest.reverse()
        out, x = [], 0
        for i in range(shards - 1):
            share = x + -(-(self.total - x) // (shards - i))
            below, above = border(share, False), border(share, True)
            want = below if share - below <= above - share else above
            x = max(x, latest[i], min(want, border(min(x + low, self.total), False)))
            out.append(x)
        return out, hit, low


def _sums(rows: DataFrame, digits: int) -> list[tuple[str, str | None, int]]:
    """Sizes by key prefix; a prefix with one group has that group's key."""
    got = rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("s")).collect()
    return [(r.p, r.a if r.a == r.b else None, r.s) for r in got]


def minimax_cuts(rows: DataFrame, shards: int) -> tuple[list[str | None], int]:
    """Last keys of the shards but the last one (None: nothing comes before that cut), and the capacity. rows: key, size."""
    cells = _sums(rows, FIRST_DIGITS)
    depth = {c[0]: FIRST_DIGITS for c in cells}
    while True:
        state = Cells(cells)
        cuts, hit, capacity = state.cuts(shards)
        if not hit:
            break
        divide = [state.cells[i][0] for i in hit]
        kept = [c for i, c in enumerate(state.cells) if i not in hit]
        for d in {depth[p] for p in divide}:
            own = [p for p in divide if depth[p] == d]
            some = rows.where(F.substring("key", 1, d).isin(own))
            new = _sums(some, d + MORE_DIGITS)
            depth |= {c[0]: d + MORE_DIGITS for c in new}
            kept += new
        cells = kept
    last = {end: c for end, c in zip(state.ends[1:], state.cells, strict=True)}
    # the biggest key of what lies before the cut; a whole prefix is bounded by its last possible key
    keys = [(last[x][0].ljust(32, "f") if last[x][1] is None else last[x][1]) if x else None for x in cuts]
    return keys, capacity


def shard_rows(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard and a slot for every row; ``bytes`` law: sizes near equal, equal texts together.

    Size: UTF-8 bytes of the text (null: none) plus 8. Slots count each shard's rows from 0 in the
    order (key, id). Null and empty texts are equal. Repeated rows have slots of their own; a null id sorts first; an empty table
    gives no rows. Other columns are not read, so their names cannot clash.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    light = df.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"),
        F.monotonically_increasing_id().alias("tie"),
    )
    ordered = light.repartitionByRange(parts(spark), "key", "id", "tie").sortWithinPartitions("key", "id", "tie")
    place = F.monotonically_increasing_id()
    ranked = written(
        ordered.select("id", "size", "crc", "key", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at")), "shards"
    )
    cuts, capacity = minimax_cuts(ranked, n_shards)
    shard = F.lit(0)
    for key in cuts:
        shard = shard + (F.lit(1) if key is None else (F.col("key") > key).cast("int"))
    placed = ranked.withColumn("shard", shard)
    # rows by partition and shard: as many as partitions plus shards, each partition being a key range
    counts = sorted((r.part, r.shard, r["count"]) for r in placed.groupBy("part", "shard").count().collect())
    done: dict[int, int] = {}
    seen: dict[int, int] = {}
    base = []
    for part, s, n in counts:
        first = done.get(part, 0)
        base.append((part, s, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + n
        done[part] = first + n
    bases = spark.createDataFrame(base, "part long, shard int, base long")
    return placed.join(F.broadcast(bases), ["part", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.col("at")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(read(spark, sf_dir, "documents"), n_shards=24)


#: The same in SQL: greedy by list_reduce, binary search and cuts by recursion, CRC-32 by its bytewise rule (polynomial 0xEDB88320).
SQL = """
WITH RECURSIVE poly AS (SELECT list(t ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b] || list_transform(range(8), lambda k: CAST(0 AS BIGINT)), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS t FROM range(256) x(b))),
d AS MATERIALIZED (
  SELECT doc_id, md5(coalesce(text, '')) AS key, coalesce(strlen(text), 0) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS MATERIALIZED (
  SELECT doc_id, key, size, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
    lambda a, b: xor(poly.t[(xor(a, b) & 255) + 1], a >> 8)), CAST(4294967295 AS BIGINT)) AS crc FROM d, poly),
g AS MATERIALIZED (SELECT key, s, sum(s) OVER (ORDER BY key) AS e FROM (SELECT key, CAST(sum(size) AS BIGINT) AS s FROM c GROUP BY 1)),
l AS MATERIALIZED (SELECT list({'u': CAST(1 AS BIGINT), 'h': s} ORDER BY key) AS s, [CAST(0 AS BIGINT)] || list(CAST(e AS BIGINT) ORDER BY key) AS e, CAST(sum(s) AS BIGINT) AS total, max(s) AS most FROM g),
search AS (
  SELECT greatest((total + 23) // 24, most) AS lo, total AS hi FROM l
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, (lo + hi) // 2 AS mid, list_reduce(l.s, lambda a, x: CASE WHEN a.h + x.h > (lo + hi) // 2 THEN {'u': a.u + 1, 'h': x.h} ELSE {'u': a.u, 'h': a.h + x.h} END).u <= 24 AS ok
    FROM search, l WHERE lo < hi)),
cap AS MATERIALIZED (SELECT lo AS c FROM search WHERE lo = hi),
late AS (
  SELECT 0 AS k, total AS x FROM l
  UNION ALL
  SELECT k + 1, (SELECT list_min(list_filter(l.e, lambda b: b >= greatest(0, late.x - cap.c))) FROM l, cap) FROM late WHERE k < 23),
lates AS MATERIALIZED (SELECT list(x ORDER BY k) AS y FROM late),
cut AS (
  SELECT -1 AS i, CAST(0 AS BIGINT) AS x
  UNION ALL
  SELECT i + 1, greatest(x, lates.y[23 - i], least(CASE WHEN share - below <= above - share THEN below ELSE above END, top)) FROM (
    SELECT i, q.x, share, list_max(list_filter(l.e, lambda b: b <= share)) AS below, list_min(list_filter(l.e, lambda b: b >= share)) AS above, list_max(list_filter(l.e, lambda b: b <= least(q.x + cap.c, l.total))) AS top
    FROM (SELECT i, cut.x, cut.x + (l.total - cut.x + 23 - i - 1) // (23 - i) AS share FROM cut, l WHERE i < 22) q, l, cap), lates),
cuts AS (SELECT list(x) AS y FROM cut WHERE i >= 0),
p AS (SELECT c.*, CAST(len(list_filter(cuts.y, lambda b: b < g.e)) AS INTEGER) AS shard FROM c JOIN g USING (key), cuts)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, (SELECT c FROM cap) AS capacity FROM p
"""
