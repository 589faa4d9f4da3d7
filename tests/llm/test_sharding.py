import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from loomwork.llm import sharding

from .brute import documents


def capacity(sizes, shards):
    low, high = max(1, -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if s > mid:
                used = shards + 1
                break
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def check(spark, rows, shards):
    got = sharding.shard_rows(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int"), shards).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows), key=str)
    groups = defaultdict(int)
    for _, t in rows:
        groups[md5((t or "").encode()).hexdigest()] += size(t)
    held, slots, crcs = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r.shard < shards
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        crcs[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in crcs.values())
    if rows:
        want = capacity([groups[k] for k in sorted(groups)], shards)
        assert max(held.values()) <= want and got[0].capacity == want


@pytest.mark.parametrize("first", [1, 4])
def test_minimax(spark, monkeypatch, first):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", first)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    check(spark, documents(5, 120), 7)
    check(spark, documents(6, 40), 24)


def test_hot_group_and_few_rows(spark):
    check(spark, [(i, "same text " * 20) for i in range(50)] + [(100 + i, f"text {i}" * (i % 7 + 1)) for i in range(60)], 6)
    check(spark, [(1, "a"), (2, None), (3, "")], 24)
    check(spark, [], 24)
