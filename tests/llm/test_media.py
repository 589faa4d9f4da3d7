import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import media

from .brute import documents


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
    back, planes, ms = media.avi_parsed(media.avi_bytes(payload))
    assert back == payload and ms == 40 and planes.shape[2] == 64


def test_extremes():
    for payload in (b"\xff" * 12800, bytes(range(256)) * 64, b"\0\xff" * 3200, b"\0" * 64):
        assert media.avi_parsed(media.avi_bytes(payload))[0] == payload


def test_shots():
    planes = np.concatenate([np.full((6, 64, 64), 20), np.full((9, 64, 64), 200), np.full((3, 64, 64), 90)]).astype(np.uint8)
    assert [(a, b, n) for a, b, n, _ in media.shots(planes, 40)] == [(0, 240, 6), (240, 600, 9), (600, 720, 3)]


def test_only_the_known_form_is_read():
    with pytest.raises(ValueError):
        media.avi_parsed(b"RIFF....WAVE")
    with pytest.raises(ValueError):
        media.code_table(bytes([0, 2] + [0] * 14), bytes([0, 1]))


def test_frame(spark):
    rows = documents(3, 30)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, clips int")
    got = media.media_columns(df).collect()
    assert len(got) == len(rows)
    want = {hashlib.sha256((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 64)) * 64, b"\0")).hexdigest() for _, t in rows}
    assert {r.payload_sha256 for r in got} == want
    for r in got:
        payload = media.avi_parsed(bytes(r.media))[0]
        assert (len(payload), zlib.crc32(payload[-64:]), hashlib.sha256(r.media).hexdigest()) == (r.payload_bytes, r.tail_crc32, r.media_sha256)
        assert r.clips[0].begin_ms == 0 and all(a.end_ms == b.begin_ms for a, b in zip(r.clips, r.clips[1:]))
    assert media.clip_rows(media.media_columns(df, keep_media=False)).count() == sum(len(r.clips) for r in got)
    assert media.media_columns(df.limit(0)).count() == 0
