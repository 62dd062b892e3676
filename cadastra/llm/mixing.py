"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadastra.llm.shared import held, spread_join, table

#: Weights follow the sources' document counts to this power where no weights are given: it lifts the small sources.
ALPHA = 0.7
SEED = 7
#: A larger mean is drawn as the sum of equal independent Poisson draws, as exp(-mean) must not vanish.
MAX_MEAN = 64.0
#: P(X > 200) is below 2**-53 for a mean of 64, so the distribution function is 1 in double precision from there on.
TOP = 200
#: Up to so many sources the rates are broadcast (some 2 KB each); beyond, a source's documents are dealt over parts.
BROADCAST_SOURCES = 2000
NO_SOURCE = "\x00null"


def uniform(key: Column) -> Column:
    """52 bits of md5 as a number from 0 up to 1."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def row_key(id_col: str, text_col: str, seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, alpha: float = ALPHA, source_col: str = "source") -> DataFrame:
    """(_source, n, mean, draws, cdf) per source of docs.

    mean is the expected number of copies of one document: weight * total / n, where weights are scaled to the sum 1
    over the sources that occur. A source without a weight, or with a null or negative one, has the mean 0.
    """
    key = F.coalesce(F.col(source_col), F.lit(NO_SOURCE))
    counts = docs.groupBy(key.alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        given = weights.select(F.coalesce(F.col("source"), F.lit(NO_SOURCE)).alias("_source"), F.col("weight").cast("double").alias("w"))
        given = given.groupBy("_source").agg(F.sum("w").alias("w"))
        counts = counts.join(given, "_source", "left").withColumn("w", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)))
    everything = Window.partitionBy(F.lit(0))  # one row a source
    size = F.sum("n").over(everything).cast("double") if total is None else F.lit(float(total))
    counts = counts.select("_source", "n", F.coalesce(F.try_divide(F.col("w") * size, F.sum("w").over(everything) * F.col("n")), F.lit(0.0)).alias("mean"))
    counts = counts.withColumn("draws", F.greatest(F.ceil(F.col("mean") / MAX_MEAN), F.lit(1)).cast("int"))
    each = F.col("mean") / F.col("draws")
    start = F.struct(F.exp(-each).alias("p"), F.array(F.exp(-each)).alias("cdf"))
    step = lambda a, k: F.struct((a["p"] * each / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * each / k)).alias("cdf"))
    # only as many terms as can matter for this mean
    terms = F.least(F.lit(TOP), F.ceil(each + 12 * F.sqrt(each) + 24)).cast("int")
    return counts.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda a: a["cdf"]))


def copies(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, alpha: float = ALPHA, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each row repeated by its Poisson count, and the columns _copy (from 1) and _shuffle.

    A row's count inverts the Poisson distribution function of its source's mean at a number hashed from the seed,
    its id and its text; equal rows get equal counts. A null source is a source of its own.
    """
    means = held(rates(docs, weights, total, alpha, source_col))
    small = means.count() <= BROADCAST_SOURCES
    means = means.select("_source", "draws", "cdf")
    keyed = docs.withColumn("_source", F.coalesce(F.col(source_col), F.lit(NO_SOURCE))).withColumn("_key", row_key(id_col, text_col, seed))
    joined = keyed.join(F.broadcast(means), "_source") if small else spread_join(keyed, means, ["_source"], ["_key"])
    # md5 is drawn once a draw and kept in an array: in a filter over the terms it would be drawn for each
    numbers = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda d: uniform(F.concat_ws("|", F.col("_key"), d.cast("string"))))
    count = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    joined = joined.select(*docs.columns, "_key", F.posexplode(F.array_repeat(F.lit(True), count)).alias("_copy", "_one"))
    joined = joined.withColumn("_copy", F.col("_copy") + 1).drop("_one")
    return joined.withColumn("_shuffle", F.md5(F.concat_ws("|", F.lit("order"), F.col("_key"), F.col("_copy").cast("string")))).drop("_key")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, **more) -> DataFrame:
    """docs mixed to target weights and globally shuffled, with docs' own columns.

    weights: (source, weight); None: the sources' counts to the power alpha. total: expected rows, None: as many as
    docs has. Every row goes to a partition and to a place in it by hash, so the order is random as a whole and the
    same on every run. Rows equal in id and text get equal counts. Columns of docs may have any names.
    """
    source, id_col, text = (more.pop(k, k.removesuffix("_col") if k != "id_col" else "doc_id") for k in ("source_col", "id_col", "text_col"))
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), F.col(source).alias("source"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return shuffled(copies(inner, weights, total, **more)).select(*(F.col("_in")[c].alias(c) for c in docs.columns))


def shuffled(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("_shuffle")).sortWithinPartitions("_shuffle")


def op3_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that the mix of documents holds: doc_id, source, copy (from 1) and its key in the global order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = copies(docs).select("doc_id", "source", "_copy", "_shuffle")
    return shuffled(mixed).select("doc_id", "source", F.col("_copy").cast(T.LongType()).alias("copy"), F.col("_shuffle").alias("shuffle_key"))


OP3_SQL = f"""
WITH s AS (SELECT coalesce(source, chr(0) || 'null') AS src, count(*) AS n FROM documents GROUP BY 1),
     r AS (SELECT src, pow(n::DOUBLE, {ALPHA}) * sum(n) OVER () / (sum(pow(n::DOUBLE, {ALPHA})) OVER () * n) AS mean FROM s),
     m AS (SELECT src, greatest(ceil(mean / {MAX_MEAN}), 1)::INT AS draws, mean / greatest(ceil(mean / {MAX_MEAN}), 1) AS each FROM r),
     c AS (SELECT src, draws, k, sum(exp(k * ln(each) - each - lgamma(k + 1))) OVER (PARTITION BY src ORDER BY k) AS cdf
           FROM m, (SELECT unnest(range(0, {TOP + 1})) AS k)),
     d AS (SELECT doc_id, source, src, d, ('0x' || substr(md5(key || '|' || d), 1, 13))::BIGINT / {float(1 << 52)!r} AS u, key
           FROM (SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS src,
                        '{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key FROM documents)
           JOIN (SELECT src, unnest(range(1, draws + 1)) AS d FROM m) USING (src)),
     x AS (SELECT doc_id, source, key, count(c.k) AS copies FROM d LEFT JOIN c ON c.src = d.src AND c.cdf <= d.u GROUP BY 1, 2, 3),
     y AS (SELECT doc_id, source, key, unnest(range(1, copies + 1)) AS copy FROM x)
SELECT doc_id, source, copy, md5('order|' || key || '|' || copy) AS shuffle_key FROM y
"""

assert math.exp(-MAX_MEAN) > 0
