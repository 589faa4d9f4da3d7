"""Operator 4, n-gram Jaccard join by vertical partitioning.

Every text is a set of word n-grams, known by 64-bit hashes; texts with one set are one class, known
by a 64-bit key. The global order puts n-grams by document frequency, then hash.

1. A first pass finds the n-grams of very many classes, with a summary of bounded size for each task. They go
   with their classes and need no part; their summed count stands for their frequency, the same for all.
   The other sets are cut by hash range into parts and shuffled packed, one block of bytes for each task
   and part. A part knows the exact frequency of each of its n-grams; an n-gram of one class alone
   cannot be in any overlap and is dropped with its count.
2. Blocks go back by class. A class is out unless it shares enough n-grams with others at all. The
   rest have a prefix: the rarest n-grams, of which a linked pair must share one. n-grams of one class fill
   the prefix first, so what is left of it is short.
3. The global order is cut into fragments by powers of two of the frequency. Overlaps of a candidate pair
   are counted fragment by fragment and summed; the pair links if the sum reaches the threshold.

Candidates come in rounds. First every class in a posting list meets one leader of the list only; lists whose
classes are then all in one component are done, so a large group of near copies costs as many pairs as
it has members. In what is left, the members of short lists meet in pairs. In a long list, those outside its
largest component meet all others in blocks: a task holds two blocks of sets, counts their overlaps as
matrices, again fragment by fragment, and returns no pairs but links between components.
No link between components can be missed; links inside a component are not needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shipping import ship

from .common import LOWER, discard, free_names, read, release, texts, trim, written
from .components import components

SHINGLE, PERCENT = 5, 75
#: Bytes of text for each part of the hash range, least number of parts, and n-grams of a block.
PART_BYTES, LEAST_PARTS, BLOCK = 16 << 20, 64, 300_000
#: Classes that make an n-gram heavy, n-grams that a summary holds, and what a task must count of one to tell: so many, and a share (one in so many) of its
#: classes. Of T n-grams in N classes and K tasks, one of HEAVY + T / SUMMARY + N / SHARE + FEW * K classes is found for certain.
HEAVY, SUMMARY, FEW, SHARE = 4096, 1 << 18, 4, 1024
#: Words that a worker keeps, rounds with leaders, longest list whose members meet in pairs, classes and n-grams of a matrix, salts of a component,
#: rows of open lists for which a round has a task that writes.
KEPT_WORDS, ROUNDS, SHORT, SIDE, COLUMNS, SALTS, TASK_ROWS = 100_000, 3, 48, 512, 4096, 16, 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)

_known: dict[bytes, int] = {}


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of fewer words, one for the whole sequence."""
    ws = (text or "").encode().translate(LOWER).split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(_known) > KEPT_WORDS:
        _known.clear()
    get, digest = _known.get, xxhash.xxh64_intdigest
    numbers = []
    for w in ws:
        x = get(w)
        if x is None:
            x = _known[w] = digest(w)
        numbers.append(x)
    a = np.array(numbers, dtype=np.uint64)
    size = min(n, len(a))
    h = np.full(len(a) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ a[k : len(a) - size + 1 + k]) * MIX
        h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_key(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def pack(h: np.ndarray, size: int) -> bytes:
    """The low bytes of each hash; the high ones are the part's number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def unpack(data: bytes, size: int, part: int, bits: int) -> np.ndarray:
    low = np.zeros((len(data) // size, 8), dtype=np.uint8)
    low[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(-1, size)
    h = low.view("<u8").ravel()
    return (h & np.uint64((1 << (64 - bits)) - 1)) | np.uint64(part << (64 - bits)) if bits else h


def part_bits(df: DataFrame, text_col: str, part_bytes: int = PART_BYTES) -> int:
    """log2 of the number of parts, from the bytes of text."""
    size = df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return min(24, (max(LEAST_PARTS, size // part_bytes) - 1).bit_length())


BLOB = "kind int, part int, key long, n int, keys binary, counts binary, hashes binary, dfs binary"
NAMES = [x.split()[0] for x in BLOB.split(", ")]


def _table(rows: list[tuple], ids: pa.Array, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", *NAMES])


_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]


def _summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by n-gram; beyond SUMMARY n-grams all lose the first count that has no room."""
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    h, c = h[head], np.add.reduceat(c, head) if len(head) else c
    if len(h) > SUMMARY:
        c = c - np.partition(c, len(c) - SUMMARY - 1)[len(c) - SUMMARY - 1]
        h, c = h[c > 0], c[c > 0]
    return h, c


def heavy_ngrams(df: DataFrame, text_col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the n-grams of very many classes, and their counts, at most SUMMARY of them. A text that a task meets again does not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        seen: set[int] = set()
        held, size = [], 0
        for batch in batches:
            for text in texts(batch.column("text")):
                own = shingles(text, n)
                if len(own) and (key := set_key(own)) not in seen:
                    seen.add(key)
                    held.append(own)
                    size += len(own)
                if size >= BLOCK:
                    h, c = _summed(np.concatenate([h, *held]), np.concatenate((c, np.ones(size, dtype=np.int64))))
                    held, size = [], 0
        h, c = _summed(np.concatenate([h, *held]), np.concatenate((c, np.ones(size, dtype=np.int64))))
        keep = c >= max(FEW, len(seen) // SHARE)
        h, c, held = h[keep], c[keep], []
        seen.clear()
        _known.clear()
        trim()
        for at in range(0, len(h), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 10_000].astype(np.int64)) for x in (h, c)], ["h", "c"])

    summed = df.select(F.col(text_col).alias("text")).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    heavy = summed.where(F.col("c") >= HEAVY).orderBy(F.desc("c"), "h").limit(SUMMARY).toPandas()  # SUMMARY rows at most
    h, c = heavy["h"].to_numpy(dtype=np.int64).view(np.uint64), heavy["c"].to_numpy(dtype=np.int64)
    order = np.argsort(h)
    return h[order], np.minimum(c[order], (1 << 32) - 1).astype(np.uint32)


def _cut_sets(df: DataFrame, id_col: str, text_col: str, n: int, bits: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows of kind 0: id, key and size of each text. Of kind 1: for each block and part, keys, counts and packed hashes. Of kind 2: for each
    block and bucket of classes, keys, counts, hashes and frequencies of heavy n-grams."""
    shared = df.sparkSession.sparkContext.broadcast(heavy)  # SUMMARY entries at most
    schema = f"id {df.schema[id_col].dataType.simpleString()}, {BLOB}"
    size, parts_ = 8 - bits // 8, 1 << bits

    def flush(keys: list[int], sets: list[np.ndarray]) -> list[tuple]:
        if not sets:
            return []
        h = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        key = np.array(keys, dtype=np.int64)
        rows = []
        many, often = shared.value
        if len(many):
            at = np.minimum(np.searchsorted(many, h), len(many) - 1)
            hot = many[at] == h
            rows = _by_bucket(2, key[owner[hot]], h[hot], often[at[hot]], parts_)
            h, owner = h[~hot], owner[~hot]
        part = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, owner, part = h[order], owner[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts_ + 1))
        for p in np.unique(part).tolist():
            a, b = cuts[p], cuts[p + 1]
            head = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            count = np.diff(head, append=b - a).astype(np.uint32)
            rows.append((1, p, None, None, key[owner[a:b][head]].tobytes(), count.tobytes(), pack(h[a:b], size), None))
        return rows

    def sent(blocks: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(blocks), 64):
            some = blocks[i : i + 64]
            yield _table(some, pa.nulls(len(some), kind), _KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("id")
            rows, keys, sets, held = [], [], [], 0
            for text in texts(batch.column("__text")):
                h = shingles(text, n)
                if not len(h):
                    rows.append((0, 0, None, 0, None, None, None, None))
                    continue
                key = set_key(h)
                rows.append((0, key % parts_, key, len(h), None, None, None, None))
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(h)
                    held += len(h)
                    if held >= BLOCK:
                        yield from sent(flush(keys, sets), ids.type)
                        keys, sets, held = [], [], 0
            yield from sent(flush(keys, sets), ids.type)
            yield _table(rows, ids, _KINDS)
        _known.clear()
        trim()

    return df.select(df[id_col].alias("id"), df[text_col].alias("__text")).mapInArrow(run, schema)


def _by_bucket(kind: int, owner: np.ndarray, h: np.ndarray, df: np.ndarray, parts_: int) -> list[tuple]:
    """For each bucket of classes: their keys, how many n-grams each has, these and their frequencies."""
    bucket = owner % parts_
    order = np.lexsort((owner, bucket))
    h, owner, df, bucket = h[order], owner[order], df[order], bucket[order]
    rows = []
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(edges, [*edges[1:], len(h)], strict=False):
        first = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
        rows.append((kind, int(bucket[a]), None, None, owner[a:b][first].tobytes(), np.diff(first, append=b - a).astype(np.uint32).tobytes(), h[a:b].astype("<u8").tobytes(), df[a:b].tobytes()))
    return rows


def _of_part(table: pa.Table, bits: int) -> pa.Table:
    """Rows of kind 0 and 2 as they are; of kind 1, the n-grams that two classes or more have, by class."""
    size, parts_ = 8 - bits // 8, 1 << bits
    kind = np.array(table.column("kind"))
    light = table.filter(pa.array(kind != 1))
    packed = table.filter(pa.array(kind == 1))
    if not len(packed):
        return light
    part = packed.column("part")[0].as_py()
    join = lambda c: b"".join(packed.column(c).to_pylist())
    keys, counts = np.frombuffer(join("keys"), dtype=np.int64), np.frombuffer(join("counts"), dtype=np.uint32)
    h = unpack(join("hashes"), size, part, bits)
    keep = np.zeros(len(keys), dtype=bool)  # a class that several tasks have met stands here once
    keep[np.unique(keys, return_index=True)[1]] = True
    h, owner = h[np.repeat(keep, counts)], np.repeat(keys[keep], counts[keep])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    df = np.repeat(np.diff(head, append=len(h)), np.diff(head, append=len(h)))
    shared = df > 1
    rows = _by_bucket(1, owner[shared], h[shared], df[shared].astype(np.uint32), parts_)
    new = _table(rows, pa.nulls(len(rows), table.schema.field("id").type), _KINDS)
    return pa.concat_tables([light.cast(new.schema), pa.Table.from_batches([new])])


CLASS = "key long, n int, fragment int, hashes array<long>, prefix array<long>, depths array<int>"


def _of_bucket(table: pa.Table, percent: int) -> pa.Table:
    """The classes that share enough n-grams to have a link: their hashes by fragment, and their prefixes (in one of the rows)."""
    kind = np.array(table.column("kind"))
    light, packed = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind != 0))
    out: list[tuple] = []
    if len(packed):
        sizes = dict(zip(light.column("key").to_pylist(), light.column("n").to_pylist(), strict=True))
        join = lambda c: b"".join(packed.column(c).to_pylist())
        counts = np.frombuffer(join("counts"), dtype=np.uint32)
        owner = np.repeat(np.frombuffer(join("keys"), dtype=np.int64), counts)
        h, df = np.frombuffer(join("hashes"), dtype="<u8"), np.frombuffer(join("dfs"), dtype=np.uint32)
        order = np.lexsort((h, df, owner))
        h, df, owner = h[order], df[order], owner[order]
        if len(owner):  # a heavy n-gram comes once from each task that has met its class
            once = np.concatenate(([True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])))
            h, df, owner = h[once], df[once], owner[once]
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))).tolist() if len(owner) else []
        for a, b in zip(head, [*head[1:], len(h)], strict=False):
            n, shared = sizes[int(owner[a])], b - a
            if 100 * shared < percent * n:
                continue
            key, alone = int(owner[a]), n - shared
            first = n - -(-percent * n // 100) + 1 - alone  # of the prefix, what others have too
            fragment = np.log2(df[a:b]).astype(np.int32)
            edges = [*np.flatnonzero(np.diff(fragment, prepend=-1)).tolist(), shared]
            hashes = h[a:b].astype(np.int64)
            for i, (c, d) in enumerate(zip(edges, edges[1:], strict=False)):
                lead = i == 0
                out.append((key, n, int(fragment[c]), np.sort(hashes[c:d]), hashes[:first] if lead else None, np.arange(alone, alone + first, dtype=np.int32) if lead else None))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in CLASS.split(", ")])


def _links(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, na, b, nb) that link. Overlaps are counted in each fragment of the order, then summed."""
    left = classes.select(F.col("key").alias("a"), "fragment", F.col("hashes").alias("ha"))
    right = classes.select(F.col("key").alias("b"), "fragment", F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            la, lb = batch.column("ha"), batch.column("hb")
            va, vb = la.values.to_numpy(), lb.values.to_numpy()
            oa, ob = la.offsets.to_numpy(), lb.offsets.to_numpy()
            for i in range(len(batch)):
                x = np.concatenate((va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]))
                x.sort()
                n.append(int((x[1:] == x[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "na", "b", "nb")), pa.array(n, pa.int64())], ["a", "na", "b", "nb", "i"])

    counted = both.select("a", "na", "b", "nb", "ha", "hb").mapInArrow(run, "a long, na int, b long, nb int, i long")
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("i").alias("i"))
    return total.where(F.col("i") * 100 >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _fits(percent: int) -> F.Column:
    """Sizes and places allow the threshold: what is common lies at or after either place. Overlap o needs 100 o >= percent (na + nb - o)."""
    most = F.least(F.col("na") - F.col("da"), F.col("nb") - F.col("db"))
    return (F.lit(100 + percent) * most >= percent * (F.col("na") + F.col("nb"))) & (F.col("a") != F.col("b"))


def _cell_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between components among two blocks of a list (or one with itself)."""
    block = np.array(table.column("block"))
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    keys, n, c = (np.array(table.column(x)) for x in ("key", "n", "c"))
    sets = table.column("hashes").combine_chunks()
    offsets, values = np.array(sets.offsets), np.array(sets.values)
    owner = np.repeat(np.arange(len(keys)), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    order, number = np.unique(values, return_inverse=True)
    overlap = np.zeros((len(a), len(b)), dtype=np.int64)
    at_a, at_b = np.full(len(keys), -1), np.full(len(keys), -1)
    at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
    for begin in range(0, len(order), COLUMNS):  # a fragment of the n-grams
        own = (number >= begin) & (number < begin + COLUMNS)
        x, y = np.zeros((len(a), COLUMNS), dtype=np.float32), np.zeros((len(b), COLUMNS), dtype=np.float32)
        who, what = owner[own], number[own] - begin
        for m, at in ((x, at_a), (y, at_b)):
            inside = at[who] >= 0
            m[at[who][inside], what[inside]] = 1
        overlap += (x @ y.T).astype(np.int64)
    total = n[a].astype(np.int64)[:, None] + n[b].astype(np.int64)[None]
    good = (100 * overlap >= percent * (total - overlap)) & (c[a][:, None] != c[b][None])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for p, q in zip(*(v.tolist() for v in np.nonzero(good)), strict=True):
        u, v = root(int(c[a[p]])), root(int(c[b[q]]))
        if u != v:
            parent[u] = v
            out.append((int(keys[a[p]]), int(keys[b[q]])))
    return pa.table([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _long_lists(rest: DataFrame, classes: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Links (a, b) between the components of each list in rest (h, key, n, c), found by blocks."""
    largest = rest.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(F.max(F.struct("m", "c")).alias("g"), F.sum("m").alias("all"))
    blocks = largest.select("h", F.col("g.c").alias("g"), F.ceil((F.col("all") - F.col("g.m")) / SIDE).cast("int").alias("ko"), F.ceil(F.col("g.m") / SIDE).cast("int").alias("kg"))
    member = rest.join(written(blocks.coalesce(tasks), "blocks"), "h").withColumn("out", F.col("c") != F.col("g"))
    member = member.withColumn("block", F.when(F.col("out"), F.pmod(F.xxhash64("key"), F.col("ko"))).otherwise(F.col("ko") + F.pmod(F.xxhash64("key"), F.col("kg"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("ko") + F.col("kg")).otherwise(F.col("ko")) - 1)).alias("o")
    cells = member.select("h", "key", "n", "c", "block", other).select("h", "key", "n", "c", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    whole = classes.join(rest.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.flatten(F.collect_list("hashes")).alias("hashes"))
    return cells.join(whole, "key").groupBy("h", "i", "j").applyInArrow(lambda t: _cell_links(t, percent), "a long, b long")


def ngram_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, key, n) of each row, and (key, component) of each class that links with another class."""
    ship(df.sparkSession)
    spark = df.sparkSession
    bits = part_bits(df, text_col)
    blobs = f"id {df.schema[id_col].dataType.simpleString()}, {BLOB}"
    sets = _cut_sets(df, id_col, text_col, n, bits, heavy_ngrams(df, text_col, n))
    shared = written(sets.groupBy("part").applyInArrow(lambda t: _of_part(t, bits), blobs), "ngrams")
    release(spark)
    rows = shared.where("kind = 0").select("id", "key", "n")
    sized = rows.where("key is not null").select("key", "n").distinct()
    light = sized.select(F.lit(0).alias("kind"), F.pmod("key", F.lit(1 << bits)).cast("int").alias("part"), "key", "n", *(F.lit(None).cast("binary").alias(c) for c in NAMES[4:]))
    found = light.unionByName(shared.where("kind > 0").select(*NAMES)).groupBy("part").applyInArrow(lambda t: _of_bucket(t, percent), CLASS)
    classes = written(found, "classes")
    release(spark)
    prefix = classes.where("prefix is not null").select("key", "n", F.explode(F.arrays_zip("prefix", "depths")).alias("p")).select(F.col("p.prefix").alias("h"), "key", "n", F.col("p.depths").alias("d"))
    prefix = written(prefix, "prefixes")
    label, before = spark.createDataFrame([], "key long, component long"), None
    for turn in range(ROUNDS + 2):
        open_ = prefix.join(label, "key", "left").select("h", "key", "n", "d", F.coalesce("component", "key").alias("c"))
        # sums over what little is left go to few tasks; of much, coalesce leaves all partitions as they are
        tasks = max(spark.sparkContext.defaultParallelism, -(-prefix.count() // TASK_ROWS))
        leader = F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("x"), "key", "n", "d", "c")).alias("l")
        lists = open_.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("m"), leader).where("lo <> hi")
        # written, so that the join has two plain sides: Spark splits the list that a large share of all classes stands in
        lists = written(lists.select("h", "m", "l").coalesce(tasks), "lists")
        if lists.isEmpty():
            discard(lists)
            break
        held = written(open_.join(lists, "h"), "open")
        discard(prefix, lists)
        prefix, rest = held.select("h", "key", "n", "d"), None  # a list within one component stays so
        if turn < ROUNDS:
            met = held.where("c <> l.c").select(F.col("l.key").alias("a"), F.col("l.n").alias("na"), F.col("l.d").alias("da"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("d").alias("db"))
        else:
            rest = held.where(F.col("m") <= SHORT if turn == ROUNDS else F.col("m") > SHORT).select("h", "key", "n", "d", "c")
            one, two = (rest.select("h", *(F.col(c).alias(f"{c}{s}") for c in ("key", "n", "d", "c"))) for s in ("1", "2"))
            met = one.join(two, "h").where("key1 < key2 and c1 <> c2").select(F.col("key1").alias("a"), F.col("n1").alias("na"), F.col("d1").alias("da"), F.col("key2").alias("b"), F.col("n2").alias("nb"), F.col("d2").alias("db"))
        if turn <= ROUNDS:
            pairs = written(met.where(_fits(percent)).select("a", "na", "b", "nb").distinct().coalesce(tasks), "pairs")
            new = written(_links(pairs, classes, percent).coalesce(tasks), "links")
            discard(pairs)
        else:
            new = written(_long_lists(rest, classes, percent, tasks), "links")
        last, label = label, components(label.select(F.col("key").alias("a"), F.col("component").alias("b")).unionByName(new))
        discard(last, new, before)
        before = held
        release(spark)
    discard(classes, prefix, before)
    release(spark)
    return rows, label


def link_ngrams(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles and component_id of every row.

    A-Z are lower-cased; words are parted by blanks, tabs and line ends. Rows link if the intersection of their
    n-gram sets is at least percent of the union; component_id is the least id reachable. Fewer than n
    words are one n-gram; empty and null texts have none and are alone. Repeated rows each have a row;
    null ids are no component's name unless all ids of a component are null. Other columns are not read.
    """
    rows, label = ngram_classes(df, id_col, text_col, n, percent)
    least = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("m"))
    named = least.join(label, "key", "left")
    # a component may hold a third of all classes: its classes are salted, and its name stands once for each salt
    linked = named.where("component is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    names = linked.groupBy("component").agg(F.min("m").alias("component_id"))
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = linked.join(names, ["component", "salt"]).select(F.col("key").alias("k"), "component_id")
    classes = classes.unionByName(named.where("component is null").select(F.col("key").alias("k"), F.col("m").alias("component_id")))
    whole = rows.join(classes, F.col("key") == F.col("k"), "left")
    return whole.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """df with one row of each component: the one of least id (then least hash of id and text). Rows that agree in
    both are one; texts without words are alone and stay."""
    spot = [F.xxhash64(id_col, text_col), F.hash(id_col, text_col)]
    names = df.columns
    slim = df.select(F.struct(F.col(id_col).alias("id"), spot[0].alias("h"), spot[1].alias("g")).alias("id"), F.col(text_col).alias("text"))
    linked = link_ngrams(slim, "id", "text", n, percent)
    h, g = free_names(df, "__h", "__g")
    stay = linked.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id.h").alias(h), F.col("id.g").alias(g)).distinct()
    marked = df.withColumn(h, spot[0]).withColumn(g, spot[1])
    return marked.join(stay, [h, g], "left_semi").dropDuplicates([h, g]).select(*names)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_ngrams(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM gram x JOIN gram y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * i >= 75 * (s.n + t.n - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT r.a AS doc_id, CAST(coalesce(any_value(s.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM reach r LEFT JOIN size s ON s.doc_id = r.a GROUP BY r.a
"""
