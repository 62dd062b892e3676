"""Best-fit packing of whole documents' token ids, planned on a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.llm.shared import handing_back, table, written
from cadastra.llm.tokens import END_ID, encoder, gathered, slices, with_end

CAPACITY = 1024


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank within the length.

    slots[length] has, ordered by first rank: (first rank, first sequence, pieces a sequence takes, offset of the
    first). It has fewer than capacity ** 2 entries in all, however many documents there are.
    """

    slots: dict[int, list[tuple[int, int, int, int]]]
    sequences: int

    def columns(self) -> np.ndarray:
        """Rows of keys, first ranks, first sequences, pieces a sequence takes, and offsets, in the order of the keys."""
        rows = [(length, *slot) for length in sorted(self.slots) for slot in self.slots[length]]
        length, rank, sequence, each, offset = np.array(rows, np.int64).reshape(-1, 5).T
        return np.stack([key_of(length, rank), rank, sequence, each, offset])


def key_of(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """One number by which slots are ordered and looked up; a length has under 2 ** 44 pieces."""
    return (length << 44) | rank


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best fit, longest first, over counts of lengths.

    A length goes to the fullest sequences that still take it, else to new ones. Sequences of equal free room are
    kept as ranges, so a step moves a whole range at a time.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many) by free room
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, slots.setdefault(length, [])
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        free = length
        while left:
            while free < capacity and not room[free]:
                free += 1
            if not room[free]:  # free == capacity: open as many new sequences as the rest needs
                need = -(-left // (capacity // length))
                room[capacity].append((used, need))
                used += need
            first, many = room[free].pop()
            each = free // length
            full = min(many, left // each)
            if full:
                room[free - each * length].append((first, full))
                own.append((rank, first, each, capacity - free))
                rank, left, first, many = rank + full * each, left - full * each, first + full, many - full
            if many and left and left < each:
                room[free - left * length].append((first, 1))
                own.append((rank, first, each, capacity - free))
                rank, left, first, many = rank + left, 0, first + 1, many - 1
            if many:
                room[free].append((first, many))
    return Plan(slots, used)


def pieces_of(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, start, length) of the pieces of texts of so many ids: one where they fit, else capacity each but for a shorter first."""
    many = -(-counts // capacity)
    text = np.repeat(np.arange(len(counts)), many)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = (counts - (many - 1) * capacity)[text]
    return text, piece, np.where(piece == 0, 0, first + (piece - 1) * capacity), np.where(piece == 0, first, capacity)


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    @handing_back
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in gathered(batches):
            texts = batch.column("text")
            for a, b in slices(texts):
                flat, counts = with_end(*own.encode(texts.slice(a, b - a)), end_id)
                text, piece, start, length = pieces_of(counts, capacity)
                ends = np.cumsum(length)
                raw = memoryview(flat.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((ends - length).tolist(), ends.tolist(), strict=True)]
                arrays = [batch.column("doc_id").slice(a, b - a).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), flat.astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """pieces with _rank, 0 to n - 1 within their length.

    A length may hold a third of all pieces, so ranks are counted within parts of a length and the parts' counts are
    summed up: one small row per length and part.
    """
    split = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    own = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start")
    counts = split.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = split.withColumn("_row", F.row_number().over(own))
    return numbered.join(bases, ["length", "_part"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1).drop("_part", "_row", "_base")


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Packs every document's ids, each followed by end_id, into sequences of at most capacity ids.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if keep_ids. A null
    text is an empty one and has only end_id. Rows with equal or null doc_id are documents of their own. Only documents
    over capacity are cut. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    pieces = written(piece_rows(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    plan = plan_best_fit(counts, capacity)
    shared = spark.sparkContext.broadcast(plan.columns())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    @handing_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, firsts, sequences, each, offsets = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, key_of(length, rank), "right") - 1
            past = rank - firsts[at]
            kept = [n for n in batch.schema.names if n != "_rank"]
            places = [pa.array(sequences[at] + past // each[at]), pa.array(offsets[at] + past % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *places], [*kept, "sequence_id", "offset"])

    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(pieces, parts).select(*pieces.columns, "_rank").mapInArrow(place, schema)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
