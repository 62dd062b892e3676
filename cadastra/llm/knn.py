"""Exact top-k by integer inner product: a Voronoi join of queries and data."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.llm.shared import spread_join, table, written

SCALE = 256
#: The fewest and the most pivots (the driver has them all); between them their number grows with the root of that of the vectors.
PIVOTS, MOST_PIVOTS = 64, 4096
#: A cell of more rows is solved in blocks of about this many, each with a radius of its own.
BLOCK = 2048
#: Queries are dealt by their nearest pivots into chunks of about this many; each chunk gets its own copy of a block that it needs.
QUERIES = 4096
#: So many of the groups' smallest distances are known at most, the same number of each; a query that needs more goes everywhere.
SUMMARIES = 65_536
#: Bounds of queries and blocks are worked out so many at a time.
BOUNDS = 1 << 21
#: Queries are sent in batches of so many components.
SENT = 1 << 22
#: Below this the sums of products are whole numbers that double precision holds exactly.
EXACT = float(1 << 53)


def quantised(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; an error where that is no longer a whole number in double precision."""
    fine = lambda x: F.abs(x) < EXACT
    own = lambda x: F.when(fine(x), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit(f"a component times {scale} is 2 ** 53 or more")).cast("long"))
    return F.transform(column, lambda x: own(x.cast("double") * scale))


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and has only finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(column).isNotNull() & (F.size(column) > 0) & fine)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as doubles, shorter ones filled with 0, which adds nothing to an inner product."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat, sizes = column.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat[offsets[0] : offsets[-1]])) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b; an error where one might pass 64 bits."""
    largest = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    if largest >= 2.0**63:
        raise OverflowError("inner products may pass 64 bits")
    return a.astype(np.int64) @ b.astype(np.int64).T


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query's row with the other rows' vectors.

    vectors' components are floor(scale * x). Ties go to the smaller id. Rows with a null id, or whose vector is null,
    empty, or has null or non-finite components, take no part. Vectors of unequal length are compared on their common
    components. Rows of the query's own id are never its candidates; queries of equal id and vector are answered once.
    A component of 2 ** 53 or more, scaled, or an inner product that might pass 64 bits, is an error.

    Equal vectors are first cut to the rows that any query can take: of the k + 1 smallest ids, k rows each. The
    different vectors are grouped by their nearest pivot (a bounded sample: those of smallest hash, as many as pivots or
    pivots_for says), and a group into blocks. A block's pivot product plus radius bounds what it can offer a query. What
    a query needs is bounded by the groups' summaries, their smallest distances from the pivot: a vector so near offers
    the pivot's product less the query's length times that distance at least. A query needs k vectors and as many as its
    own id has, which may all come before them; what one id has changes nothing for the queries of others. A query is
    sent to just those blocks whose bound reaches its need, and a block is copied to just those chunks of queries that
    sent it one.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = usable(vectors.where(F.col(id_col).isNotNull()), vector_col).select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"), queries.alias("_query"))
    rows = written(rows, "knn-rows")
    asked = rows.where("_query").select(F.col("vec_id").alias("query_id"), "v").distinct()
    per_id = written(asked.groupBy("query_id").agg((F.count(F.lit(1)) + k).alias("takes")), "knn-takes")  # its own vectors may come before k others
    most = per_id.agg(F.max("takes")).first()[0] or k
    asked = spread_join(asked, per_id, ["query_id"], ["v"])
    few = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.groupBy("v", "vec_id").agg(F.count(F.lit(1)).alias("n")).withColumn("_n", F.row_number().over(few)).where(F.col("_n") <= k + 1)
    repeated = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], F.least(x["n"], F.lit(k)).cast("int"))))
    distinct = written(distinct.groupBy("v").agg(F.slice(repeated, 1, 2 * k).alias("ids")), "knn-distinct")
    pivots = pivots or pivots_for(distinct.count(), block)
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    width = distinct.agg(F.max(F.size("v"))).first()[0] or 0
    points = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        points[i, : len(r["v"])] = r["v"]
    if not chosen:
        return spark.createDataFrame([], f"query_id {id_type}, rank int, vec_id {id_type}, score long")

    half = (points**2).sum(1) / 2

    def nearest(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = m @ points.T - half
        cell = near.argmax(1)
        return cell, np.sqrt(((m - points[cell]) ** 2).sum(1))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, distance = nearest(matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(distance), batch.column("v"), batch.column("ids")], ["cell", "distance", "v", "ids"])

    data = written(distinct.select("v", "ids").mapInArrow(cells, f"cell int, distance double, v array<bigint>, ids array<{id_type}>"), "knn-cells")
    sizes = {r["cell"]: (r["n"], r["low"], r["high"]) for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}  # a row a pivot
    # a cell's rings of equal width, and in a ring as many parts by hash as keep blocks small
    ring = F.least(F.floor((F.col("distance") - F.col("low")) / F.greatest((F.col("high") - F.col("low")) / 4, F.lit(1e-9))), F.lit(3)).cast("int")
    known = spark.createDataFrame([(c, lo, hi) for c, (_, lo, hi) in sizes.items()], "cell int, low double, high double")
    ringed = data.join(F.broadcast(known), "cell").withColumn("ring", ring).drop("low", "high")
    bounds = [(r["cell"], r["ring"], -(-r["n"] // block), r["radius"]) for r in ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()]
    parts = spark.createDataFrame([b[:3] for b in bounds], "cell int, ring int, parts long")
    blocked = ringed.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).drop("parts", "distance")

    nearest_of = Window.partitionBy("cell").orderBy("distance")
    closest = data.select("cell", "distance", F.row_number().over(nearest_of).alias("n")).where(F.col("n") <= min(most, max(1, SUMMARIES // len(chosen)))).collect()  # SUMMARIES rows at most
    summary_cells, summaries = np.array([r["cell"] for r in closest]), np.array([r["distance"] for r in closest])
    block_cells, block_rings = np.array([b[0] for b in bounds]), np.array([b[1] for b in bounds])
    radii = np.array([b[3] for b in bounds])

    def with_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(matrix(batch.column("v"), width))[0], pa.int32())], [*batch.schema.names, "cell"])

    asked = written(asked.select("query_id", "v", "takes", F.xxhash64("query_id", "v").alias("hash")).mapInArrow(with_cell, f"query_id {id_type}, v array<bigint>, takes long, hash long, cell int"), "knn-asked")
    chunk_of, chunks_of = query_chunks({r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}, points, QUERIES)  # a row a pivot

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query and the rings that it needs, a bounded number at a time."""
        step, most_sent = max(1, BOUNDS // (len(bounds) + len(summaries))), max(1, SENT // max(width, 1))
        for some in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            m, own_cell, takes = matrix(some.column("v"), width), some.column("cell").to_numpy(), some.column("takes").to_numpy()
            chunk = chunk_of[own_cell] + some.column("hash").to_numpy() % chunks_of[own_cell]
            with_pivots, length = products(m, points).astype(float), np.sqrt((m**2).sum(1))[:, None]
            offers = with_pivots[:, block_cells] + length * radii[None, :]
            least = with_pivots[:, summary_cells] - length * summaries[None, :]
            need = np.where(takes <= least.shape[1], nth_largest(least, takes), -np.inf)
            margin = 1e-9 * (np.abs(offers) + np.abs(np.where(np.isfinite(need), need, 0.0))[:, None]) + 1e-6
            queries_sent, rings_sent = np.nonzero(offers + margin >= need[:, None])
            for at in range(0, len(queries_sent), most_sent):
                query, ring_no = queries_sent[at : at + most_sent], rings_sent[at : at + most_sent]
                places = (block_cells[ring_no], block_rings[ring_no], chunk[query])
                own = [some.column(c).take(pa.array(query)) for c in ("query_id", "v", "takes")]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in places), *own], ["cell", "ring", "chunk", "query_id", "v", "takes"])

    sent = asked.mapInArrow(send, f"cell int, ring int, chunk int, query_id {id_type}, v array<bigint>, takes long")
    sent = sent.join(F.broadcast(parts), ["cell", "ring"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")  # four rows a pivot

    keys = ["cell", "ring", "part", "chunk"]
    copied = copies_of(blocked, sent)

    def solve(key: tuple, own: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if own.empty or theirs.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        b, ids = _padded(theirs["v"], width), [x.tolist() for x in theirs["ids"]]
        out = []
        for at in range(0, len(own), 256):
            some = own.iloc[at : at + 256]
            scores = products(_padded(some["v"], width), b)
            for q, line, least in zip(some["query_id"], scores, nth_largest(scores, some["takes"].to_numpy()), strict=True):
                # all vectors that tie with the last one stay: ids decide between them
                best = [(-int(line[j]), x) for j in np.flatnonzero(line >= least) for x in ids[j] if x != q]
                out += [(q, x, -s) for s, x in sorted(best)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    solved = sent.groupBy(*keys).cogroup(copied.groupBy(*keys)).applyInPandas(solve, f"query_id {id_type}, vec_id {id_type}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def pivots_for(vectors: int, block: int) -> int:
    """The root of the number of vectors, but no more than leave a block to each, and PIVOTS to MOST_PIVOTS."""
    return max(PIVOTS, min(math.isqrt(vectors), vectors // block, MOST_PIVOTS))


def nth_largest(m: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Of each row of m the value of its rank from the largest, 1; its smallest where it has no more."""
    ranks, out = np.minimum(ranks, m.shape[1]), np.empty(len(m), m.dtype)
    for n in np.unique(ranks):
        out[ranks == n] = np.partition(m[ranks == n], -n, axis=1)[:, -n]
    return out


def query_chunks(counts: dict[int, int], points: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, chunks) by cell, from the number of queries in each.

    A cell of more than limit queries has chunks of its own. Smaller ones that are neighbours on a chain from pivot to
    nearest pivot share one, so that a chunk's queries need much the same blocks.
    """
    first, many = np.zeros(len(points), np.int64), np.ones(len(points), np.int64)
    left, at, number, fill = np.ones(len(points), bool), 0, 0, 0
    while left.any():
        at = int(np.where(left, ((points - points[at]) ** 2).sum(1), np.inf).argmin())
        left[at] = False
        n = counts.get(at, 0)
        if fill and fill + n > limit:
            number, fill = number + 1, 0
        first[at], many[at] = number, max(1, -(-n // limit))
        fill += n
        if many[at] > 1:
            number, fill = number + int(many[at]), 0
    return first, many


def copies_of(blocked: DataFrame, sent: DataFrame) -> DataFrame:
    """The blocks' rows, a copy for each chunk that sent their block a query."""
    wanted = sent.select(F.col("cell").alias("_cell"), F.col("ring").alias("_ring"), F.col("part").alias("_part"), F.col("chunk").alias("_chunk")).distinct()
    same = (F.col("cell") == F.col("_cell")) & (F.col("ring") == F.col("_ring")) & (F.col("part") == F.col("_part"))
    return blocked.join(wanted, same).select("cell", "ring", "part", F.col("_chunk").alias("chunk"), "v", "ids")


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def op10_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP10_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
