"""Token ids in files of transposed, compressed planes.

A file: MAGIC; the blocks; the index as zstandard-compressed JSON; the index's size as 8 little-endian bytes; MAGIC.
A block holds up to BLOCK ids. Its little-endian 32-bit ids are transposed into 4 byte planes (all lowest bytes, then all
second bytes, ...) or 32 bit planes (all lowest bits, ..., padded to whole bytes), each compressed on its own. The index
has, per block, its place, its number of ids and its planes' sizes, and, per document, its id and its number of ids.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.llm.shared import arrow_type, handing_back, held, new_folder, open_fs, put_file, table
from cadastra.llm.tokens import END_ID, encoder, gathered, slices, with_end

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    bytewise = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(bytewise.T)]
    bits = np.unpackbits(bytewise, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


class PlaneWriter:
    """Yields a file's bytes as ids come in; holds no more than a block of ids and the index."""

    def __init__(self, kind: str = "byte", block: int = BLOCK, level: int = LEVEL):
        if kind not in ("byte", "bit"):
            raise ValueError("kind must be byte or bit")
        self.kind, self.block, self.packer = kind, block, zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.at, self.n_ids = 0, len(MAGIC), 0
        self.blocks: list[list] = []
        self.docs: list[tuple] = []

    def _flush(self, everything: bool) -> Iterator[bytes]:
        if self.n_waiting < self.block and not (everything and self.n_waiting):
            return
        ids = np.concatenate(self.waiting)
        stop = len(ids) if everything else len(ids) - len(ids) % self.block
        for k in range(0, stop, self.block):
            some = ids[k : min(k + self.block, stop)]
            packed = [self.packer.compress(p) for p in to_planes(some, self.kind)]
            self.blocks.append([self.at, len(some), [len(p) for p in packed]])
            self.at += sum(map(len, packed))
            yield from packed
        self.waiting, self.n_waiting = [ids[stop:]], len(ids) - stop

    def add(self, doc_ids: list, flat: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        self.docs += zip(map(plain, doc_ids), counts.tolist(), strict=True)
        self.waiting.append(flat)
        self.n_waiting += len(flat)
        self.n_ids += len(flat)
        yield from self._flush(False)

    def end(self) -> Iterator[bytes]:
        yield from self._flush(True)
        index = self.packer.compress(json.dumps({"kind": self.kind, "block": self.block, "n_ids": self.n_ids, "blocks": self.blocks, "docs": self.docs}).encode())
        yield index + struct.pack("<Q", len(index)) + MAGIC


def plain(doc_id):
    """A document's id as JSON can hold it: whole numbers and null as they are, all else as text."""
    return doc_id if doc_id is None or isinstance(doc_id, int) else str(doc_id)


def read_index(source) -> dict:
    """The index of an open random-access file."""
    size = source.size()
    source.seek(size - len(MAGIC) - 8)
    tail = source.read(len(MAGIC) + 8)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of id planes, or cut short")
    (length,) = struct.unpack("<Q", tail[:8])
    source.seek(size - len(MAGIC) - 8 - length)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))


def read_blocks(source, index: dict) -> Iterator[np.ndarray]:
    unpacker = zstandard.ZstdDecompressor()
    for at, n, sizes in index["blocks"]:
        source.seek(at)
        raw, planes, k = source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(unpacker.decompress(raw[k : k + s]))
            k += s
        yield from_planes(planes, n, index["kind"])[:n]


def read_documents(source) -> Iterator[tuple]:
    """(doc id, its ids), block by block."""
    index = read_index(source)
    blocks, held_ids = read_blocks(source, index), np.zeros(0, "<u4")
    for doc_id, n in index["docs"]:
        parts, missing = [held_ids[:n]], n - min(n, len(held_ids))
        held_ids = held_ids[n:]
        while missing:
            block = next(blocks)
            parts.append(block[:missing])
            missing, held_ids = missing - len(parts[-1]), block[missing:]
        yield doc_id, np.concatenate(parts)


def write_planes(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = END_ID) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order, a file per range of ids; returns its file list.

    (part, path, n_docs, n_ids, n_bytes), in the order of part. A null id comes first. Documents of equal id follow one
    another in the order of their texts. A null text has only end_id. A task that runs again replaces its file.
    """
    schema = "part int, path string, n_docs long, n_ids long, n_bytes long"

    @handing_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        writer, path, own = PlaneWriter(kind), f"{folder}/ids-{part:06d}.planes", encoder(tokenizer)

        def content():
            yield MAGIC
            for batch in gathered(batches):
                texts = batch.column("text")
                for a, b in slices(texts):
                    flat, counts = with_end(*own.encode(texts.slice(a, b - a)), end_id)
                    yield from writer.add(batch.column("doc_id").slice(a, b - a).to_pylist(), flat, counts)
            yield from writer.end()

        size = put_file(path, content(), attempt)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "n_bytes": [size]})

    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return held(ordered.mapInArrow(write, schema))


def read_planes(files: DataFrame, id_type: str = "bigint", keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and ids if asked for."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    based = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema, ids_type = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids, arrow_type(id_type)
    # the rows are a path each: deal them out, else one task would read all files
    based = based.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, local = open_fs(path)
                with system.open_input_file(local) as source:
                    rows: list[tuple] = []
                    for doc_id, ids in read_documents(source):
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), *([ids.astype(np.int32)] * keep_ids)))
                        base += len(ids)
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                    if rows:
                        yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        own = pa.array(columns[0], pa.int64() if any(isinstance(i, int) for i in columns[0]) else pa.string()).cast(ids_type)
        arrays = [own, *(pa.array(c, pa.int64()) for c in columns[1:4]), *([pa.array(columns[4], pa.list_(pa.int32()))] if keep_ids else [])]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])])

    return based.mapInArrow(read, schema)


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = write_planes(docs, new_folder(spark, "planes"), public_tokenizers.path("word_bpe_49k.json"))
    return read_planes(files, docs.schema["doc_id"].dataType.simpleString())
