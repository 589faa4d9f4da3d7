"""Operator 3, byte-level BPE by merge replay.

A block is a run of whole texts of one task. The distinct words of a block (the matches of the split
pattern) that are not yet known stand in one flat array of symbols. An inverted index leads from the
rank of a token pair to the positions where that pair stands; the pairs are applied in rank order
over the whole block, and each merge touches its two neighbours only. Merges of one word depend on
no other word, so the replay over blocks gives what one replay over the corpus gives, without a
shuffle and in memory bounded by the block.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from loomwork.shipping import ship

from .common import read, texts, trim

#: Characters of text in a block, words whose ids a task keeps at most, those of them that a worker's next task still knows, and symbols in one replay.
BLOCK_BYTES, KEPT_WORDS, LEFT_WORDS, SYMBOLS = 2_000_000, 350_000, 50_000, 250_000


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: base64 token and rank on each line. A token's id is its rank."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.split = regex.compile(pattern).findall
        # every pair of tokens that makes a token: left << 32 | right -> rank
        get = self.ranks.get
        self.pairs = {
            a << 32 | b: rank for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None
        }
        self.pair_keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        follow: dict[int, dict[int, int]] = {}
        for key, rank in self.pairs.items():
            follow.setdefault(key >> 32, {})[key & 0xFFFFFFFF] = rank
        none: dict[int, int] = {}
        #: by left token: right token -> rank; the last entry, index -1, is that of a gap and has nothing
        self.follow = [follow.get(t, none).get for t in range(max(self.tokens) + 1)] + [none.get]
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))  # a gap of -1 before and after every word
        flat = np.full(int(starts[-1]), -1, dtype=np.int64)
        at = np.ones(len(flat), dtype=bool)
        at[starts - 1] = False
        flat[at] = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        keys = flat[:-1] << 32 | flat[1:]
        keys[(flat[:-1] < 0) | (flat[1:] < 0)] = -1
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        where = np.flatnonzero(self.pair_keys[found] == keys)
        rank = self.pair_ranks[found[where]]
        order = np.argsort(rank, kind="stable")
        where, rank = where[order], rank[order]
        heads = np.flatnonzero(np.diff(rank, prepend=-1))
        index = {int(rank[i]): w.tolist() for i, w in zip(heads, np.split(where, heads[1:]), strict=True)} if len(where) else {}
        heap = list(index)
        heapify(heap)
        symbol, begin = flat.tolist(), starts.tolist()
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        follow = self.follow
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            held, till, mine = [], -1, follow[r]
            for i in places:
                left = symbol[i]
                if left < 0:
                    continue
                j = after[i]
                if follow[left](symbol[j]) != r:
                    continue
                if i < till:  # a pair of lower rank has come up in this word: it goes first
                    held.append(i)
                    continue
                symbol[i], symbol[j] = r, -1
                k = after[j]
                h = before[i]
                after[i], before[k] = k, i
                for place, new in ((h, follow[symbol[h]](r)), (i, mine(symbol[k]))):
                    if new is not None:
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heappush(heap, new)
                        if new <= r:
                            till = begin[bisect_right(begin, i)]
            if held:
                if r in index:
                    index[r] += held
                else:
                    index[r] = held
                    heappush(heap, r)
        ids = np.array(symbol, dtype=np.int64)
        live = ids >= 0
        ends = np.concatenate(([0], np.cumsum(live)))[starts - 1].tolist()
        packed = ids[live].astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of words into ``known``; a word that is itself a token has that one id."""
        rest, get = [], self.ranks.get
        for word in words:
            raw = word.encode()
            rank = get(raw)
            if rank is None:
                rest.append((word, raw))
            else:
                self.known[word] = rank.to_bytes(4, "little")
        some, size = [], 0
        for pair in rest:
            some.append(pair)
            size += len(pair[1]) + 1
            if size >= SYMBOLS:
                self._replayed(some)
                some, size = [], 0
        self._replayed(some)

    def forget(self) -> None:
        """Keep the words met first, among them most of the frequent ones."""
        self.known = dict(islice(self.known.items(), LEFT_WORDS))

    def _replayed(self, some: list[tuple[str, bytes]]) -> None:
        if some:
            self.known.update(zip((w for w, _ in some), self.replay([raw for _, raw in some]), strict=True))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                out += self._block(block)
                block, size = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [self.split(text) for text in texts]
        new: set[str] = set()
        known = self.known
        for words in split:
            new.update(words)
        self.learn({w for w in new if w not in known})
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256, with keep_ids also ids (binary, unsigned 32-bit
    little-endian) and the columns named in keep. A null text counts as empty: no ids. The id may be
    null; repeated rows give repeated rows; an empty table gives none. Other columns are not read.
    """
    names = list(dict.fromkeys((id_col, *keep)))
    ship(df.sparkSession)
    source = df.select(*names, df[text_col].alias("__text"))
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    schema = f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            gc.disable()  # millions of live words and positions, none of them in cycles
            ids = own.encode(texts(batch.column("__text")))
            gc.enable()
            columns = [batch.column(c) for c in names]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64())]
            columns += [pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())]
            columns += [pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string())]
            if keep_ids:
                columns += [pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])
        own.forget()
        trim()

    return source.mapInArrow(run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)
