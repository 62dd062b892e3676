"""Exact dedup of texts by an extendible-hash index in shared files."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import handing_back, spread_join, table, written

WHITE = b" \t\n\x0b\x0c\r"
#: A bucket with more different keys is split.
CAPACITY = 512
#: The directory that the driver holds doubles up to 2 ** MAX_DEPTH entries. A bucket that is still overfull at that depth
#: is split on by as many more bits as its count asks for, so there is no bound on the number of buckets.
MAX_DEPTH = 16
KEY_BITS = 60
#: A task sends on the texts it has met once they have this size together, each counting ENTRY_BYTES beside its own.
HELD_BYTES = 32 << 20
ENTRY_BYTES = 400


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE)


def key_of(sha: str, bits: int) -> int:
    """The first bits of the hash; fewer than 60 make collisions likelier, which tests use."""
    return int(sha[:15], 16) >> (KEY_BITS - bits)


def headers(docs: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """(doc_id, _key, text_sha256, _points) per row of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @handing_back
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            shas = [hashlib.sha256(normalised(t)).hexdigest() for t in texts.to_pylist()]
            keys = pa.array([key_of(s, bits) for s in shas], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, pa.array(shas, pa.string()), pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())], ["doc_id", "_key", "text_sha256", "_points"])

    return docs.select("doc_id", "text").mapInArrow(head, f"doc_id {id_type}, _key long, text_sha256 string, _points long")


def directory(cells: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[int]:
    """The bucket of each prefix of the keys, from the number of different keys per prefix of max_depth bits.

    Starts with one bucket. A bucket with more than capacity keys is split by its next bit; where its depth is the
    directory's, the directory doubles. The result has 2 ** (the directory's depth) entries; a bucket of less depth
    stands in several neighbouring ones.
    """
    sums = [0] * (1 << max_depth)
    for prefix, n in cells.items():
        sums[prefix] = n
    before = np.concatenate([[0], np.cumsum(sums)])
    depth, entries, buckets = 0, [0], [(0, 0)]  # (prefix, depth) of each bucket
    waiting = [0]
    while waiting:
        b = waiting.pop()
        prefix, own = buckets[b]
        low, high = prefix << (max_depth - own), (prefix + 1) << (max_depth - own)
        if before[high] - before[low] <= capacity or own == max_depth:
            continue
        if own == depth:
            entries, depth = [e for e in entries for _ in (0, 1)], depth + 1
        buckets[b] = (prefix << 1, own + 1)
        buckets.append(((prefix << 1) + 1, own + 1))
        new, span = len(buckets) - 1, 1 << (depth - own - 1)
        start = buckets[new][0] << (depth - own - 1)
        entries[start : start + span] = [new] * span
        waiting += [b, new]
    return entries


def bucket_depths(cells: dict[int, int], capacity: int, max_depth: int, bits: int) -> np.ndarray:
    """How many bits of a key name its bucket, by the first max_depth bits of the key.

    Where a bucket of the directory is as deep as the directory can be, its keys are split on evenly: they are hashes.
    """
    places = np.array(directory(cells, capacity, max_depth))
    depth = len(places).bit_length() - 1
    spans = np.bincount(places)[places]  # a bucket of less depth stands in 2 ** (depth - its own) places
    own = (depth - np.log2(spans).round().astype(np.int64)).repeat(1 << (max_depth - depth))
    for prefix, n in cells.items():
        if n > capacity:
            own[prefix] = min(bits, max_depth + math.ceil(math.log2(n / capacity)))
    return own.astype(np.int8)


def entries(docs: DataFrame, depths: np.ndarray, bits: int) -> DataFrame:
    """What the owners get: each task's different texts with their bucket, count and best row.

    The best of equal texts is the row with the most code points, then the smallest doc_id; a null id counts as the
    largest. As a task sends a text once, a text that fills a third of the table reaches its owner once a task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    cell = len(depths).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(depths)  # 2 ** MAX_DEPTH bytes at most
    schema = f"_bucket long, _key long, text_sha256 string, _bytes binary, _n long, _points long, _best {id_type}"

    @handing_back
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, list] = {}
        size = 0

        def pack() -> pa.RecordBatch:
            shas = [hashlib.sha256(t).hexdigest() for t in met]
            keys = [key_of(s, bits) for s in shas]
            first = np.array(keys, np.int64)
            own = shared.value[first >> (bits - cell)].astype(np.int64)
            buckets = (first >> (bits - own)) | (np.int64(1) << own)  # the bits that name it, after a leading 1
            values = list(met.values())
            best = pa.array([v[2] for v in values], batch.column("doc_id").type)
            return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(keys, pa.int64()), pa.array(shas, pa.string()), pa.array(list(met), pa.binary()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.int64()), best], ["_bucket", "_key", "text_sha256", "_bytes", "_n", "_points", "_best"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = normalised(text)
                points = len(text or "")
                if (known := met.get(own)) is None:
                    met[own] = [1, points, doc_id]
                    size += len(own) + ENTRY_BYTES
                else:
                    known[0] += 1
                    if better(points, doc_id, known[1], known[2]):
                        known[1:] = [points, doc_id]
                if size > HELD_BYTES:
                    yield pack()
                    met, size = {}, 0
        if met:
            yield pack()

    return docs.select("doc_id", "text").mapInArrow(gather, schema)


def better(points: int, doc_id, other_points: int, other_id) -> bool:
    if points != other_points:
        return points > other_points
    return doc_id is not None and (other_id is None or doc_id < other_id)


def index(found: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """(_bucket, _key, _chain, text_sha256, keep_id, group_size) of every different text, as the buckets' owners see them.

    A task owns whole buckets, which are ranges of keys. It reads its entries in the order of the keys and holds one
    key's chain: an entry joins the chain's text that has the same bytes, or else extends the chain.
    """
    id_type = found.schema["_best"].dataType.simpleString()
    schema = f"_bucket long, _key long, _chain int, text_sha256 string, keep_id {id_type}, group_size long"

    @handing_back
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, chain, kind = None, [], None

        def rows() -> list[tuple]:
            return [(*place, i, sha, best, n) for i, (_, sha, n, _, best) in enumerate(chain)]

        def pack(done: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), kind, pa.int64()]
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_bucket", "_key", "_chain", "text_sha256", "keep_id", "group_size"])

        for batch in batches:
            kind, done = batch.column("_best").type, []
            for bucket, key, sha, text, n, points, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != (bucket, key):
                    done += rows() if chain else []
                    place, chain = (bucket, key), []
                for link in chain:
                    if link[0] == text:
                        link[2] += n
                        if better(points, best, link[3], link[4]):
                            link[3:] = [points, best]
                        break
                else:
                    chain.append([text, sha, n, points, best])
            if done:
                yield pack(done)
        if chain:
            yield pack(rows())

    # owners are numbered by where a bucket's range of keys begins; keys are hashes, so ranges of equal width are fair
    owners = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = "(length(bin(_bucket)) - 1)"
    begins = F.expr(f"shiftleft(_bucket - shiftleft(1L, {depth}), {bits} - {depth})")
    owner = F.least(F.floor(begins.cast("double") / float(1 << bits) * owners), F.lit(owners - 1)).cast("int")
    owned = found.repartitionById(owners, owner).sortWithinPartitions("_bucket", "_key")
    return owned.mapInArrow(own, schema)


def dedup_exact(docs: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256, _points.

    Texts are equal when they are after deleting ASCII white space; null is empty. Of equal texts the row with the most
    code points, then the smallest doc_id, is kept. Rows that tie in both, that is equal ids of equal length, all have
    kept true: keep_rows() keeps one of them.
    """
    docs = docs.select("doc_id", "text")
    max_depth = min(max_depth, bits)
    heads = written(headers(docs, bits), "exact-headers")
    prefix = F.shiftright("_key", bits - max_depth).cast("int").alias("prefix")
    counts = heads.select("_key").distinct().groupBy(prefix).agg(F.count(F.lit(1)).alias("n"))
    depths = bucket_depths({r["prefix"]: r["n"] for r in counts.collect()}, capacity, max_depth, bits)  # 2 ** max_depth rows at most
    groups = written(index(entries(docs, depths, bits), bits), "exact-index")
    found = spread_join(heads, groups.select("_key", "text_sha256", "keep_id", "group_size", F.lit(True).alias("_found")), ["_key", "text_sha256"], ["doc_id"], "left")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return found.select("doc_id", "keep_id", F.assert_true(F.col("_found").isNotNull()).alias("_none"), "group_size", kept.alias("kept"), "text_sha256", "_points").drop("_none")


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, with docs' columns; of rows that tie in id, length and text, one.

    A row's hash and length are computed anew beside it and joined to the kept ones by one shuffle of the rows, on
    keys that no two rows of different content share. Columns of docs may have any names.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00null")).alias("_name")
    kept = dedup_exact(docs).where("kept").select(name("doc_id"), F.col("text_sha256").alias("_sha"), "_points").distinct()
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), WHITE.decode(), "").cast("binary"), 256).alias("_sha")
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), name("doc_id"), sha, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_points"))
    keys = ["_name", "_sha", "_points"]
    return own.join(kept, keys).dropDuplicates(keys).select(*(F.col("_in")[c].alias(c) for c in docs.columns))


def op8_extendible_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
     g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
