"""Token-id output: framed binary shards with a separate offset index.

A shard is a file of frames. A frame: payload length (u64), masked CRC-32 of these 8 bytes (u32),
payload, masked CRC-32 of the payload (u32), all little-endian. A payload: doc_id (i64), whether
doc_id is null (u8), bytes of an id (u8), then the ids. Beside each shard stands its index: per
frame doc_id (i64), offset of the frame (i64) and number of ids (i64), so a reader can shuffle
records without reading the shard through. The mask turns the checksum by 15 bits and adds a
constant, so a payload that itself holds frames doesn't weaken it.

Shards get about SHARD bytes of text each. The manifest has a row per segment of a shard, so a shard
of any size is read by many tasks; neither writer nor reader holds more than a record and a buffer.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

_MASK = 0xA282EAD8
_HEAD = struct.Struct("<qBB")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n", "<i8")])
_MANIFEST = "shard int, path string, record long, offset long, n_docs long, n_tokens long"
_BUFFER = 8 << 20
#: Bytes of text of a shard at most, about, and of frames of a segment.
SHARD, SEGMENT = 128 << 20, 64 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at `at`, and where the next starts; ValueError if a checksum fails."""
    size = bytes(data[at : at + 8])
    if struct.unpack_from("<I", data, at + 8)[0] != masked(size):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + struct.unpack("<Q", size)[0]
    payload = memoryview(data)[at + 12 : end]
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload, end + 4


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer:
    """A shard and its index, both written as they come; segments() are the manifest's rows that are complete."""

    def __init__(self, store, root: str):
        self.part = TaskContext.get().partitionId()
        self.path = f"{root}/shard-{self.part:06d}-{uuid.uuid4().hex}"
        self.sink = store.open_output_stream(f"{self.path}.bin", buffer_size=_BUFFER)
        self.index = store.open_output_stream(f"{self.path}.idx", buffer_size=1 << 20)
        self.record = self.offset = 0
        self.begin, self.docs, self.tokens, self.rows = (0, 0), 0, 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        rec = frame(_HEAD.pack(doc or 0, doc is None, ids.itemsize) + ids.tobytes())
        self.sink.write(rec)
        self.index.write(np.array((doc or 0, self.offset, len(ids)), INDEX).tobytes())
        self.record, self.offset = self.record + 1, self.offset + len(rec)
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        if self.offset - self.begin[1] >= SEGMENT:
            self.cut()

    def cut(self) -> None:
        if self.docs:
            self.rows.append((self.part, self.path, *self.begin, self.docs, self.tokens))
        self.begin, self.docs, self.tokens = (self.record, self.offset), 0, 0

    def close(self) -> list[tuple]:
        self.cut()
        self.sink.close()
        self.index.close()
        return self.rows


def _write(path: str, tokenizer: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, out = tokens.encoder(tokenizer), None
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    for batch in batches:
        for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
            out = out or _Writer(store, root)
            out.add(doc, np.concatenate((ids, enc.end)))
    if out:
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out.close()), kinds)], names=[x.split()[0] for x in _MANIFEST.split(", ")])


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None) -> DataFrame:
    """Encode `text` of every row, append id 0, and write shards in ascending doc_id order under `path`.

    Returns the manifest, one row per segment, in the order of `shard` and `offset`. A task that is
    run again writes files of new names; only those in the manifest count. Null text is empty (one
    id), null doc_id sorts first, rows of one doc_id are ordered by their texts' hash and dealt to
    as many shards as they need; repeated rows are written once each. A text of any length is one
    record. An empty table gives an empty manifest. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(common.width(spark), spark.sparkContext.defaultParallelism, -(-size // SHARD))
    dealt = rows.repartitionByRange(parts, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    return common.staged(dealt.mapInArrow(partial(_write, path, tokenizer), _MANIFEST), "manifest")


def read_record(path: str, shard: str, k: int) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids) of the k-th record of a shard, found by its index alone: a shuffled read."""
    store, _ = _store(path)
    with store.open_input_file(f"{shard}.idx") as f:
        f.seek(k * INDEX.itemsize)
        entry = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]  # IndexError past the end
    with store.open_input_file(f"{shard}.bin") as f:
        f.seek(int(entry["offset"]))
        head = f.read(12)
        payload, _ = unframe(head + f.read(struct.unpack_from("<Q", head)[0] + 4), 0)
    doc, null, width = _HEAD.unpack_from(payload)
    return None if null else doc, np.frombuffer(payload[_HEAD.size :], f"<u{width}")


def _read(path: str, schema: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, _ = _store(path)
    for batch in batches:
        for shard, offset, n_docs, start in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "n_docs", "base"))):
            out, size = [], 0
            with store.open_input_file(f"{shard}.bin") as f:
                f.seek(offset)
                stream = pa.BufferedInputStream(f, _BUFFER)
                for _ in range(n_docs):
                    head = stream.read(12)
                    if len(head) < 12:
                        raise ValueError(f"{shard} ends within a frame")
                    payload, _ = unframe(head + stream.read(struct.unpack_from("<Q", head)[0] + 4), 0)
                    doc, null, width = _HEAD.unpack_from(payload)
                    ids = np.frombuffer(payload[_HEAD.size :], f"<u{width}").astype("<u4")
                    out.append((None if null else doc, start, len(ids), zlib.crc32(ids), *([ids.astype("<i4")] * with_ids)))
                    start, size = start + len(ids), size + with_ids * len(ids)
                    if len(out) >= 4096 or size >= 1 << 20:
                        yield _rows(out, schema, with_ids)
                        out, size = [], 0
            if out:
                yield _rows(out, schema, with_ids)


def read_shards(manifest: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32 and on demand ids, from the files.

    The manifest has a row per SEGMENT bytes, so its running sums are made on the driver. Every frame's
    checksums are held against its bytes; a damaged one raises ValueError.
    """
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in manifest.orderBy("shard", "offset").toLocalIterator():
        rows.append((r.path, r.offset, r.n_docs, base))
        base += r.n_tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not rows:
        return spark.createDataFrame([], schema)
    segments = spark.createDataFrame(rows, "path string, offset long, n_docs long, base long").repartition(len(rows))
    return segments.mapInArrow(partial(_read, path, schema, with_ids), schema)


def _rows(out: list, schema: str, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*out))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(list(cols[4]), pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    """Token files of the whole `documents`, written and read back."""
    path = common.new_path(spark, "tokens")
    return read_shards(write_shards(common.table(spark, sf_dir, "documents"), path), path)
