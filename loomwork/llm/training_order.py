"""Operator 2, token-id output: all sequences in a keyed training order, in shards of fixed stride.

Texts are encoded once; the table of their ids fixes the stream (the tasks of the scan in order, rows
as they come, an end-of-text id after each). The stream is cut into sequences of one length, the
last one filled up with end-of-text. A keyed Feistel network over the least even power of two that holds all sequence
numbers, walked until it falls among them again, is a permutation: it gives every sequence its global
slot without a table. Slots are range-partitioned, the ranges being known beforehand; each range writes its shards, files of unsigned
16-bit little-endian ids in which slot s of a shard begins at (s mod shard size) * stride. A file is written aside,
then moved in place, so a task that is run again leaves the same bytes. The shards are written in WAVES,
so that only a part of the ids stands in shuffle files at a time.

A manifest beside the shards states what they hold: digests of key and tokenizer, lengths and a digest of the token
table. Only under the same manifest do shards that stand already count as written; a folder of another
manifest, or of shards without one, is refused or, if so asked, cleared.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.shipping import ship

from .common import discard, parts, read, release, work_dir, written

LENGTH, SHARD, ROUNDS, WAVES = 1024, 2048, 6, 3


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    def __init__(self, key: str, size: int):
        self.size = size
        self.half = max(1, -(-max(1, (size - 1).bit_length()) // 2))
        self.keys = [int.from_bytes(hashlib.blake2b(f"{key}|{r}".encode(), digest_size=8).digest(), "little") for r in range(ROUNDS)]

    def _round(self, x: np.ndarray, r: int) -> np.ndarray:
        h = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(self.keys[r])
        h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ h >> np.uint64(29)) & np.uint64((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ self._round(left, r), left) if back else (right, left ^ self._round(right, r))
        return left << np.uint64(self.half) | right

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        y = self._pass(np.asarray(x, dtype=np.uint64), back)
        while len(out := np.flatnonzero(y >= self.size)):
            y[out] = self._pass(y[out], back)
        return y.astype(np.int64)


def _encoded(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """part, at (ids before this text in its part), id, ids (with the end-of-text id)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoding(path), TaskContext.get().partitionId(), 0
        end = enc.n_vocab
        for batch in batches:
            ids, place = [], []
            for text in batch.column("__text").to_pylist():
                ids.append(np.array([*enc.encode_ordinary(text or ""), end], dtype="<u2").tobytes())
                place.append(at)
                at += len(ids[-1]) // 2
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(place, pa.int64()), batch.column("id"), pa.array(ids, pa.binary())], ["part", "at", "id", "ids"])

    return df.select(df[id_col].alias("id"), df[text_col].alias("__text")).mapInArrow(run, f"part long, at long, id {kind}, ids binary")


def _pieces(tokens: DataFrame, bases: dict[int, int], order: Permutation, length: int, low: int, high: int) -> DataFrame:
    """slot, seq, start (in the sequence), ids, docs of each stretch of a sequence that stands in one batch; slots from low to below high."""
    kind = tokens.schema["id"].dataType.simpleString()
    base = tokens.sparkSession.sparkContext.broadcast(bases)  # a number for each task of the scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs, starts, data, docs = [], [], [], []
            end = -1
            for part, at, doc, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "id", "ids")), strict=True):
                place, done = base.value[part] + at, 0
                n = len(ids) // 2
                while done < n:
                    take = min(n - done, length - place % length)
                    if place != end or place % length == 0:
                        seqs.append(place // length)
                        starts.append(place % length)
                        data.append([])
                        docs.append([])
                    data[-1].append(ids[2 * done : 2 * (done + take)])
                    docs[-1].append(doc)
                    done += take
                    place += take
                    end = place
            seq = np.array(seqs, dtype=np.int64)
            slot = order(seq)
            own = np.flatnonzero((slot >= low) & (slot < high)).tolist()
            columns = [pa.array(slot[own]), pa.array(seq[own]), pa.array([starts[i] for i in own], pa.int32()), pa.array([b"".join(data[i]) for i in own], pa.binary()), pa.array([docs[i] for i in own], pa.list_(batch.column("id").type))]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "seq", "start", "ids", "docs"])

    return tokens.mapInArrow(run, f"slot long, seq long, start int, ids binary, docs array<{kind}>")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.u16"


def _write(rows: Iterator[pa.RecordBatch], where: str, length: int, shard_size: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows come by slot, then start. Writes whole shards; yields a row for each sequence, of what is read back."""
    store, root = fs.FileSystem.from_uri(where)
    stride = 2 * length
    shard, sequences = None, []

    def flush() -> pa.RecordBatch:
        path = f"{root}/{shard_name(shard)}"
        plain = [b"".join(ids) for _, _, ids, _ in sequences]
        body = b"".join(x + end.to_bytes(2, "little") * ((stride - len(x)) // 2) for x in plain)
        if store.get_file_info(path).size != len(body):
            aside = f"{path}.{uuid.uuid4().hex}"
            with store.open_output_stream(aside) as out:
                out.write(body)
            store.move(aside, path)
        with store.open_input_file(path) as back:
            body = back.read()
        out = []
        for slot, seq, ids, docs in sequences:
            at = slot % shard_size * stride
            out.append((slot, seq, shard, at, sum(map(len, ids)) // 2, hashlib.sha256(body[at : at + stride]).hexdigest(), list(dict.fromkeys(docs))))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(doc_kind)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["slot", "seq", "shard", "byte_offset", "n_tokens", "ids_sha256", "doc_ids"])

    doc_kind = pa.int64()
    for batch in rows:
        doc_kind = batch.column("docs").type.value_type
        for slot, seq, ids, docs in zip(*(batch.column(c).to_pylist() for c in ("slot", "seq", "ids", "docs")), strict=True):
            if slot // shard_size != shard:
                if sequences:
                    yield flush()
                shard, sequences = slot // shard_size, []
            if not sequences or sequences[-1][0] != slot:
                sequences.append((slot, seq, [], []))
            sequences[-1][2].append(ids)
            sequences[-1][3].extend(docs)
    if sequences:
        yield flush()


MANIFEST = "manifest.json"


def _claim(where: str, manifest: dict, overwrite: bool) -> None:
    """Make the folder hold nothing but what the manifest states, or raise. Shards of the same manifest stay; what a lost task left aside goes."""
    store, root = fs.FileSystem.from_uri(where)
    store.create_dir(root, recursive=True)
    names = {f.base_name: f for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
    own = None
    if MANIFEST in names:
        with store.open_input_stream(names[MANIFEST].path) as stream:
            own = json.loads(stream.read())
    shards = {n for n in names if n.startswith("shard-")}
    if own != manifest:
        if (own is not None or shards) and not overwrite:
            raise ValueError(f"{where} holds shards of another run; choose another folder or pass overwrite=True")
        for name in shards:
            store.delete_file(names[name].path)
        with store.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=1).encode())
    else:
        for name in shards - {shard_name(i) for i in range(manifest["shards"])}:
            store.delete_file(names[name].path)


def write_training_order(
    df: DataFrame, where: str, key: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_size: int = SHARD, overwrite: bool = False
) -> DataFrame:
    """Write the shards below the URI where (a folder that all executors share) and return a row for each sequence:
    slot, seq, shard, byte_offset, n_tokens (without filling), ids_sha256 (of the bytes read back), doc_ids.

    Null and empty texts are one end-of-text id. Null ids and repeated rows stay. An empty table has no
    sequence and no shard. Other columns are not read. A folder that holds another run's shards raises ValueError
    or, with overwrite, is cleared; the same run again goes on where it stopped. A vocabulary whose ids and end-of-text
    do not fit 16 bits raises ValueError.
    """
    spark = df.sparkSession
    end = encoding(tokenizer).n_vocab
    if end > 0xFFFF:
        raise ValueError(f"the ids of a vocabulary of {end} do not fit 16 bits")
    ship(spark)
    tokens = written(_encoded(df, id_col, text_col, tokenizer), "ids", "zstd")
    digest = F.sum(F.xxhash64("part", "at", "ids").cast("decimal(38,0)")).alias("h")
    last = tokens.groupBy("part").agg(F.sum(F.octet_length("ids") / 2).cast("long").alias("n"), digest).orderBy("part").collect()
    bases, total = {}, 0
    for r in last:  # a row for each task of the scan
        bases[r.part] = total
        total += r.n
    size = -(-total // length)
    order = Permutation(key, max(1, size))
    with open(tokenizer, "rb") as ranks:
        vocabulary = hashlib.file_digest(ranks, "sha256").hexdigest()
    content = hashlib.sha256(json.dumps([(r.part, r.n, str(r.h)) for r in last]).encode()).hexdigest()
    _claim(where, {"key_sha256": hashlib.sha256(key.encode()).hexdigest(), "tokenizer": vocabulary, "length": length, "shard_size": shard_size, "sequences": size, "shards": -(-size // shard_size), "tokens": content}, overwrite)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"slot long, seq long, shard long, byte_offset long, n_tokens long, ids_sha256 string, doc_ids array<{kind}>"
    shards, out = -(-size // shard_size), []
    for wave in range(WAVES):
        low, high = shards * wave // WAVES, shards * (wave + 1) // WAVES
        if low == high and (shards or wave):
            continue
        n = max(1, min(high - low, 4 * parts(spark)))
        pieces = _pieces(tokens, bases, order, length, low * shard_size, high * shard_size)
        place = F.floor((F.floor(F.col("slot") / shard_size) - low) * n / max(1, high - low)).cast("int")
        ranged = pieces.repartitionById(n, place).sortWithinPartitions("slot", "start")
        out.append(written(ranged.mapInArrow(lambda rows: _write(rows, where, length, shard_size, end), schema), "sequences"))
        release(spark)
    discard(tokens)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every


def read_sequences(where: str, slot: int, length: int = LENGTH, shard_size: int = SHARD) -> Iterator[np.ndarray]:
    """Sequences from a slot on, in training order: one seek, then sequential reads."""
    store, root = fs.FileSystem.from_uri(where)
    while store.get_file_info(path := f"{root}/{shard_name(slot // shard_size)}").type == fs.FileType.File:
        with store.open_input_file(path) as shard:
            shard.seek(slot % shard_size * 2 * length)
            while len(data := shard.read(2 * length)) == 2 * length:
                yield np.frombuffer(data, dtype="<u2")
                slot += 1
        if slot % shard_size:
            return


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{work_dir(spark)}/training-order-{uuid.uuid4().hex}"
    return write_training_order(read(spark, sf_dir, "documents"), where, "order of the registered query", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
