"""Clusters of vectors: nearest centre, k-means, and the one-pass method over rounds. Points: (id, v array<double>)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Clusters of the first sample with fewer points than this are outliers; rounds of k-means on it at most.
SMALL, LLOYD = 10, 30


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, z: acc + z))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, z: acc + z)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def mahalanobis(v: Column, mean: Column, sd: Column) -> Column:
    """Diagonal form; a dimension without spread is not scaled."""
    z = F.zip_with(F.zip_with(v, mean, lambda x, m: x - m), sd, lambda x, s: F.when(s > 0, x / s).otherwise(x))
    return F.sqrt(F.aggregate(F.transform(z, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def vector_sums(points: DataFrame, by: str, squares: bool = True, length: int | None = None) -> DataFrame:
    """(by, n, s, ss): count and sums, with squares also of squares, by dimension; vectors of a group have one length. Sums of each
    dimension are columns of one aggregate, so a vector is no more than a row. Without length, it is that of a first vector."""
    if length is None:
        first = points.select(F.size("v").alias("n")).first()
        length = first.n if first else 0
    dims = range(length)
    columns = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in dims] + [F.sum(F.col("v")[i] * F.col("v")[i]).alias(f"q{i}") for i in dims if squares]
    wide = points.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *columns)
    whole = lambda c: F.array(*(F.col(f"{c}{i}") for i in dims)).cast("array<double>")
    return wide.select(by, "n", whole("s").alias("s"), *[whole("q").alias("ss")] * squares)


def summaries(points: DataFrame, by: str) -> DataFrame:
    """(by, n, mean, sd) of each group, from sums and sums of squares by dimension."""
    mean = F.transform("s", lambda x: x / F.col("n"))
    sd = F.transform(F.arrays_zip("s", "ss"), lambda p: F.sqrt(F.greatest(F.lit(0.0), p["ss"] / F.col("n") - (p["s"] / F.col("n")) * (p["s"] / F.col("n")))))
    return vector_sums(points, by).select(by, "n", mean.alias("mean"), sd.alias("sd"))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster, d): the centre (cluster, mean) at the least distance, the lower number of equals. Centres are k rows, k being a parameter."""
    near = F.array_min(F.transform("__c", lambda c: F.struct(distance(F.col("v"), c["mean"]).alias("d"), c["cluster"].alias("cluster"))))
    one = centres.agg(F.collect_list(F.struct("cluster", "mean")).alias("__c"))  # all centres in one row: no shuffle of points
    return points.crossJoin(F.broadcast(one)).select("id", near.alias("m")).where("m is not null").select("id", F.col("m.cluster").alias("cluster"), F.col("m.d").alias("d"))


def _constant(rows: list[dict], fields: str) -> Column:
    """A few rows as one constant array, whatever their number."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<cluster:int,{fields}>>")


def nearest_wide(points: DataFrame, centres: list[tuple[int, list[float]]]) -> DataFrame:
    """As nearest, with the points' columns and no shuffle: the centres are a constant of the expression."""
    table = _constant([{"cluster": c, "mean": m} for c, m in centres], "mean:array<double>")
    choice = F.array_min(F.transform(table, lambda c: F.struct(distance(F.col("v"), c["mean"]).alias("d"), c["cluster"].alias("cluster"))))
    return points.withColumn("__m", choice).select(*points.columns, F.col("__m.cluster").alias("cluster"), F.col("__m.d").alias("d"))


def kmeans(points: DataFrame, seeds: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(assignment (id, cluster), centres (cluster, mean)) after so many rounds from seeds (cluster, mean), or fewer if no centre moves any
    more. A cluster that loses its points keeps its centre; the assignment is one last pass over the final centres.

    A round is one pass over the points and one aggregate; the k centres, k being a parameter, pass through the driver, so the plan does
    not grow with the rounds."""
    centres = sorted((r.cluster, list(r["mean"])) for r in seeds.select("cluster", "mean").collect())
    for _ in range(rounds if centres else 0):
        sums = vector_sums(nearest_wide(points, centres), "cluster", squares=False, length=len(centres[0][1]))
        moved = {r.cluster: [x / r.n for x in r.s] for r in sums.collect()}
        last, centres = centres, [(c, moved.get(c, m)) for c, m in centres]
        if last == centres:
            break
    table = points.sparkSession.createDataFrame(centres, "cluster int, mean array<double>")
    return (nearest_wide(points, centres).select("id", "cluster") if centres else points.select("id", F.lit(None).cast("int").alias("cluster"))), table


class Bfr:
    """One-pass clustering: discard set, compressed set and retained set over rounds of points.

    A cluster is (n, sums, sums of squares); the k clusters of the discard set and the few of the compressed set live on
    the driver. Points stay in DataFrames; a round is one pass that deals its points to the nearest cluster within
    alpha * sqrt(dimensions) by Mahalanobis distance, or to the retained set."""

    def __init__(self, k: int, alpha: float = 2.5, seed_rounds: int = 5):
        self.k, self.alpha, self.seed_rounds = k, alpha, seed_rounds
        self.discard: dict[int, list] = {}
        self.compressed: dict[int, list] = {}
        self.retained: DataFrame | None = None
        self.placed: list[DataFrame] = []
        self.rounds: list[tuple] = []
        self._next = k

    @staticmethod
    def _sums(points: DataFrame, length: int | None = None) -> dict[int, list]:
        return {r.cluster: [r.n, list(r.s), list(r.ss)] for r in vector_sums(points, "cluster", length=length).collect()}  # clusters

    def _add(self, into: dict[int, list], new: dict[int, list]) -> None:
        for c, (n, s, ss) in new.items():
            if c in into:
                o = into[c]
                into[c] = [o[0] + n, [a + b for a, b in zip(o[1], s, strict=True)], [a + b for a, b in zip(o[2], ss, strict=True)]]
            else:
                into[c] = [n, s, ss]

    @staticmethod
    def _shape(c: list) -> tuple[list[float], list[float]]:
        n, s, ss = c
        mean = [a / n for a in s]
        return mean, [max(0.0, q / n - m * m) ** 0.5 for q, m in zip(ss, mean, strict=True)]

    def _seeded(self, points: DataFrame, k: int, rounds: int | None = None) -> DataFrame:
        """points with cluster, by k-means from the k points of lowest id, until no centre moves or so many rounds."""
        start = [(i, list(r.v)) for i, r in enumerate(points.orderBy("id").limit(k).collect())]
        if not start:
            return points.withColumn("cluster", F.lit(0)).limit(0)
        for _ in range(rounds or self.seed_rounds):
            sums = self._sums(nearest_wide(points, start), len(start[0][1]))
            last, start = start, [(c, self._shape(sums[c])[0] if c in sums else m) for c, m in start]
            if start == last:
                break
        return nearest_wide(points, start).drop("d")

    def _split(self, points: DataFrame, sets: dict[int, list]) -> DataFrame:
        """points with cluster, null where no cluster of the set is near enough."""
        if not sets:
            return points.withColumn("cluster", F.lit(None).cast("int"))
        shapes = [dict(zip(("cluster", "mean", "sd"), (i, *self._shape(c)), strict=True)) for i, c in sets.items()]
        table = _constant(shapes, "mean:array<double>,sd:array<double>")
        near = F.array_min(F.transform(table, lambda c: F.struct(mahalanobis(F.col("v"), c["mean"], c["sd"]).alias("d"), c["cluster"].alias("cluster"))))
        limit = F.lit(self.alpha) * F.sqrt(F.size("v"))
        return points.withColumn("__m", near).withColumn("cluster", F.when(F.col("__m.d") < limit, F.col("__m.cluster"))).drop("__m")

    def _keep(self, points: DataFrame) -> DataFrame:
        return written(points, "bfr")

    def _compress(self) -> None:
        if self.retained is not None and self.retained.count() >= 3 * self.k:
            self.retained = self._minis(self.retained)

    def _minis(self, points: DataFrame) -> DataFrame:
        """Adds the clusters of 3k-means of points to the compressed set and returns the points that are alone in theirs."""
        grouped = self._keep(self._seeded(points, 3 * self.k))
        many = grouped.groupBy("cluster").count().where("count > 1").select("cluster")
        tight = self._keep(grouped.join(F.broadcast(many), "cluster"))
        number = {c: self._next + i for i, c in enumerate(sorted(r.cluster for r in many.collect()))}
        self._next += len(number)
        if number:
            named = tight.withColumn("cluster", F.element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), F.col("cluster")))
            self._add(self.compressed, self._sums(named))
            self.placed.append(self._keep(named.select("id", "cluster")))
        return self._keep(grouped.join(F.broadcast(many), "cluster", "left_anti").select("id", "v"))

    def _first(self, points: DataFrame) -> None:
        """First round. Of a sample of half the points, those in clusters of fewer than SMALL points by 5k-means are retained;
        the rest gives the discard set by k-means. The other half gives the compressed set and more retained points by 3k-means.
        A sample without k points in larger clusters is taken whole, and points without k in the sample are all the sample."""
        half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
        sample, rest = points.where(half), points.where(~half)
        if sample.count() < self.k:
            sample, rest = points, points.limit(0)
        grouped = self._keep(self._seeded(sample, 5 * self.k, LLOYD))
        small = grouped.groupBy("cluster").count().where(F.col("count") < SMALL).select("cluster")
        interior = self._keep(grouped.join(F.broadcast(small), "cluster", "left_anti").select("id", "v"))
        self.retained = self._keep(grouped.join(F.broadcast(small), "cluster", "left_semi").select("id", "v"))
        if interior.count() < self.k:
            interior, self.retained = sample, points.limit(0)
        placed = self._keep(self._seeded(interior, self.k, LLOYD))
        self._add(self.discard, self._sums(placed))
        self.placed.append(self._keep(placed.select("id", "cluster")))
        self.retained = self._keep(self.retained.unionByName(self._minis(rest)))

    def _merge(self) -> dict[int, int]:
        """Compressed clusters that lie within the limit of one another become one, each merged once."""
        into: dict[int, int] = {}
        names = sorted(self.compressed)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if a in into or b in into:
                    continue
                (ma, sa), (mb, sb) = self._shape(self.compressed[a]), self._shape(self.compressed[b])
                gap = lambda s: sum(((x - y) / d if d > 0 else x - y) ** 2 for x, y, d in zip(ma, mb, s, strict=True)) ** 0.5  # noqa: B023, E731
                if max(gap(sa), gap(sb)) < self.alpha * len(ma) ** 0.5:
                    into[b] = a
        for b, a in into.items():
            self._add(self.compressed, {a: self.compressed.pop(b)})
        if into:
            self._rename(into)
        return into

    def _rename(self, into: dict[int, int]) -> None:
        m = F.create_map(*(F.lit(x) for kv in into.items() for x in kv))
        self.placed = [p.withColumn("cluster", F.coalesce(F.try_element_at(m, F.col("cluster")), F.col("cluster"))) for p in self.placed]

    def add(self, points: DataFrame) -> None:
        """One round of points (id, v)."""
        points = self._keep(points.select("id", "v"))
        if not self.discard:
            self._first(points)
        else:
            first = self._keep(self._split(points, self.discard))
            second = self._keep(self._split(first.where("cluster IS NULL").drop("cluster"), self.compressed))
            for sets, rows in ((self.discard, first), (self.compressed, second)):
                taken = rows.where("cluster IS NOT NULL")
                self._add(sets, self._sums(taken))
                self.placed.append(taken.select("id", "cluster"))
            self.retained = self._keep(self.retained.unionByName(second.where("cluster IS NULL").drop("cluster")))
            self._compress()
            self._merge()
        self.rounds.append((len(self.rounds) + 1, len(self.discard), sum(c[0] for c in self.discard.values()), len(self.compressed), sum(c[0] for c in self.compressed.values()), self.retained.count()))

    def result(self) -> DataFrame:
        """(id, cluster) in the order of ids: compressed clusters go to their nearest cluster of the discard set, retained points are -1."""
        into = {}
        for b, c in self.compressed.items():
            m = self._shape(c)[0]
            into[b] = min(self.discard, key=lambda a: sum((x - y) ** 2 for x, y in zip(m, self._shape(self.discard[a])[0], strict=True)))  # noqa: B023
        if into:
            self._rename(into)
        out = self.retained.select("id", F.lit(-1).alias("cluster"))
        for p in self.placed:
            out = out.unionByName(p)
        return out.orderBy("id")

    def counts(self) -> list[tuple]:
        """(round, clusters and points of the discard set, clusters and points of the compressed set, retained points) of each round."""
        return list(self.rounds)
