"""Queries over areas. Nations stand in for areas, regions for regions, customers, suppliers and orders for records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions.numbers import exact, rounded
from cadastra.operators import aggregates as ag
from cadastra.operators import joins as jn
from cadastra.operators import ranking as rk
from cadastra.plans.queries import Queries
from cadastra.session import load

Q = Queries()
CONCERN = {"mean_balance": "low", "customers": "high", "suppliers": "low", "orders": "high"}


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per area with the counters of three sources; a source without rows for it counts 0."""
    customers = load(spark, sf_dir, "customer")
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(exact("o_totalprice")).alias("s"), F.max("o_orderdate").alias("t"))
    own = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    by_area = own.groupBy(F.col("c_nationkey").alias("area")).agg(
        F.count(F.lit(1)).alias("customers"), F.count("n").alias("ordering_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"),
        rounded(F.sum("s"), 2).alias("revenue"), rounded(F.avg(exact("c_acctbal")), 6).alias("mean_balance"), F.max("t").alias("latest_order"),
    )
    suppliers = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("suppliers"))
    return jn.with_dimensions(nations(spark, sf_dir), "area", [by_area, suppliers], {"customers": 0, "ordering_customers": 0, "orders": 0, "suppliers": 0})


PROFILES = """
WITH o AS (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(28,10))) AS s, max(o_orderdate) AS t FROM orders GROUP BY 1),
     c AS (SELECT c_nationkey AS area, count(*) AS customers, count(n) AS ordering_customers, CAST(coalesce(sum(n), 0) AS BIGINT) AS orders,
                  CAST(round(CAST(sum(s) AS DECIMAL(28,10)), 2) AS DOUBLE) AS revenue,
                  CAST(round(CAST(sum(CAST(c_acctbal AS DECIMAL(28,10))) / count(c_acctbal) AS DECIMAL(28,10)), 6) AS DOUBLE) AS mean_balance, max(t) AS latest_order
           FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1),
     s AS (SELECT s_nationkey AS area, count(*) AS suppliers FROM supplier GROUP BY 1),
     p AS (SELECT n_nationkey AS area, n_name AS name, n_regionkey AS region, coalesce(customers, 0) AS customers, coalesce(ordering_customers, 0) AS ordering_customers,
                  coalesce(orders, 0) AS orders, revenue, mean_balance, latest_order, coalesce(suppliers, 0) AS suppliers
           FROM nation LEFT JOIN c ON c.area = n_nationkey LEFT JOIN s ON s.area = n_nationkey)"""
LONG = PROFILES + """,
     v AS (SELECT name AS area, metric, value FROM (SELECT name, mean_balance, CAST(customers AS DOUBLE) AS customers, CAST(suppliers AS DOUBLE) AS suppliers, CAST(orders AS DOUBLE) AS orders FROM p)
           UNPIVOT INCLUDE NULLS (value FOR metric IN (mean_balance, customers, suppliers, orders))),
     b AS (SELECT metric, min(value) AS minimum, median(value) AS median, max(value) AS maximum, count(*) AS areas FROM v WHERE value IS NOT NULL GROUP BY 1)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, metric, value) of every area and metric, null where it has none."""
    wide = profiles(spark, sf_dir).select(F.col("name").alias("area"), *(F.col(c).cast("double").alias(c) for c in CONCERN))
    return wide.unpivot("area", list(CONCERN), "metric", "value")


@Q.add(PROFILES + " SELECT * FROM p")
def area_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@Q.add("SELECT n_name AS name, count(s_suppkey) AS records FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def records_by_area(spark, sf_dir):
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("area"))
    return jn.with_counts(nations(spark, sf_dir), suppliers, "area").select("name", "records")


@Q.add("SELECT r_name AS region, count(*) AS records FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY 1")
def approved_records(spark, sf_dir):
    """Records of approved areas by region: an inner join and a policy filter, both before the count."""
    customers = load(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("n"))
    regions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name"))
    joined = customers.join(jn.small(nations(spark, sf_dir)), "area").join(jn.small(regions), "region")
    return joined.groupBy(F.col("r_name").alias("region")).agg(F.sum("n").alias("records"))


@Q.add(LONG + " SELECT * FROM b")
def metric_benchmarks(spark, sf_dir):
    return ag.benchmark(metrics(spark, sf_dir))


@Q.add(LONG + """,
 r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, area) AS low, row_number() OVER (PARTITION BY metric ORDER BY value DESC, area DESC) AS high FROM v WHERE value IS NOT NULL)
SELECT metric, 'lowest' AS side, CAST(low AS INT) AS rank, area, value FROM r WHERE low <= 2 UNION ALL SELECT metric, 'highest', CAST(high AS INT), area, value FROM r WHERE high <= 2""")
def metric_extremes(spark, sf_dir):
    return ag.extremes(metrics(spark, sf_dir), "metric", "area", "value")


COMPARED = LONG + """,
 g AS (SELECT v.area, metric, value, minimum, median, maximum, areas, CASE WHEN median = 0 THEN abs(value - median) ELSE abs(value - median) / abs(median) END AS gap
       FROM v JOIN b USING (metric) WHERE value IS NOT NULL),
 rel AS (SELECT *, CASE WHEN gap <= 0.10 THEN 'near' WHEN value > median THEN 'above' ELSE 'below' END AS relation,
              CASE metric WHEN 'mean_balance' THEN 'low' WHEN 'suppliers' THEN 'low' ELSE 'high' END AS side FROM g),
 a AS (SELECT *, (side = 'high' AND relation = 'above') OR (side = 'low' AND relation = 'below') AS attention FROM rel)"""


@Q.add(COMPARED + """
SELECT metric, area, value, minimum, median, maximum, areas, relation,
       CAST(round(CAST(CASE WHEN maximum = minimum THEN 50 ELSE greatest(0, least(100, (value - minimum) / (maximum - minimum) * 100)) END AS DECIMAL(28,10)), 1) AS DOUBLE) AS position_pct,
       attention, CASE WHEN attention THEN CAST(round(CAST(gap AS DECIMAL(28,10)), 4) AS DOUBLE) ELSE 0.0 END AS attention_strength FROM a""")
def median_comparison(spark, sf_dir):
    values = metrics(spark, sf_dir)
    concern = F.create_map(*(F.lit(x) for kv in CONCERN.items() for x in kv))[F.col("metric")]
    return ag.against_median(values, ag.benchmark(values), concern=concern)


@Q.add(LONG + """,
 g AS (SELECT area, metric, value, median, (value - median) / abs(median) AS gap, CASE metric WHEN 'mean_balance' THEN 'low' WHEN 'suppliers' THEN 'low' ELSE 'high' END AS side
       FROM v JOIN b USING (metric) WHERE value IS NOT NULL AND median <> 0)
SELECT area, metric, value, median, CASE WHEN gap > 0 THEN 'above' ELSE 'below' END AS comparison, CAST(round(CAST(abs(gap) AS DECIMAL(28,10)), 4) AS DOUBLE) AS gap_strength
FROM g WHERE (side = 'high' AND gap > 0.10) OR (side = 'low' AND gap < -0.10) ORDER BY gap_strength DESC, area, metric LIMIT 24""")
def concern_signals(spark, sf_dir):
    values = metrics(spark, sf_dir)
    return ag.concern_signals(values, ag.benchmark(values), CONCERN)


@Q.add(PROFILES + """
SELECT name, CAST(round(CAST(CAST(customers AS DOUBLE) / CASE WHEN max(customers) OVER () = 0 THEN 1 ELSE max(customers) OVER () END AS DECIMAL(28,10)), 6) AS DOUBLE) AS customers_index,
       CAST(round(CAST(coalesce(revenue, 0) / CASE WHEN coalesce(max(revenue) OVER (), 0) = 0 THEN 1 ELSE max(revenue) OVER () END AS DECIMAL(28,10)), 6) AS DOUBLE) AS revenue_index FROM p""")
def area_index(spark, sf_dir):
    return ag.to_index(profiles(spark, sf_dir), ["customers", "revenue"]).select("name", "customers_index", "revenue_index")


@Q.add(PROFILES + """
SELECT r_name AS region, count(*) AS areas, count(revenue) AS with_value, min(revenue) AS least, arg_min(name, (revenue, name)) FILTER (revenue IS NOT NULL) AS least_area,
       CAST(round(CAST(sum(CAST(area AS DECIMAL(28,10))) / count(*) AS DECIMAL(28,10)), 6) AS DOUBLE) AS center, min(area) AS low, max(area) AS high
FROM p JOIN region ON r_regionkey = region GROUP BY 1""")
def region_rollup(spark, sf_dir):
    regions = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), F.col("r_name"))
    areas = profiles(spark, sf_dir).join(jn.small(regions), "region")
    out = ag.region_rollup(areas, "r_name", "name", "revenue", "area", "area")
    return out.select(F.col("r_name").alias("region"), "areas", "with_value", "least", "least_area", F.col("center_lon").alias("center"), F.col("min_lon").alias("low"), F.col("max_lon").alias("high"))


@Q.add(PROFILES + " SELECT name, mean_balance, CAST(row_number() OVER (ORDER BY mean_balance, name) AS INT) AS rank FROM p WHERE mean_balance IS NOT NULL")
def area_rank(spark, sf_dir):
    rows = profiles(spark, sf_dir).where("mean_balance IS NOT NULL").withColumn("_all", F.lit(0))  # a row an area
    return rk.ranked(rows, ["_all"], "mean_balance", "name").select("name", "mean_balance", "rank")


@Q.add("""
WITH s AS (SELECT c_mktsegment AS segment, sum(CAST(o_totalprice AS DECIMAL(28,10))) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT segment, CAST(round(CAST(s AS DECIMAL(28,10)), 2) AS DOUBLE) AS amount, CAST(round(CAST(CAST(s AS DOUBLE) / sum(s) OVER () AS DECIMAL(28,10)), 6) AS DOUBLE) AS share FROM s""")
def budget_shares(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    joined = orders.join(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    return ag.shares(joined, "segment", "o_totalprice")


@Q.add(PROFILES + """
SELECT name, CASE WHEN region = 2 AND revenue IS NOT NULL THEN 'in scope with value' WHEN region = 2 THEN 'in scope without value' ELSE 'out of scope' END AS state FROM p""")
def scope_states(spark, sf_dir):
    """An area is in scope or not, and in scope with a value or without."""
    inside = F.col("region") == 2
    state = F.when(inside & F.col("revenue").isNotNull(), "in scope with value").when(inside, "in scope without value").otherwise("out of scope")
    return profiles(spark, sf_dir).select("name", state.alias("state"))


@Q.add(PROFILES + """
SELECT region, count(*) AS total, count(*) FILTER (customers > 0) AS with_customers, count(*) FILTER (suppliers > 0) AS with_suppliers,
       CASE WHEN count(*) FILTER (customers > 0 AND suppliers > 0) = count(*) THEN 'complete' WHEN count(*) FILTER (customers > 0 OR suppliers > 0) > 0 THEN 'partial' ELSE 'none' END AS coverage
FROM p GROUP BY 1""")
def coverage_by_region(spark, sf_dir):
    has, gives = F.col("customers") > 0, F.col("suppliers") > 0
    counts = ag.conditional_counts(profiles(spark, sf_dir), ["region"], with_customers=has, with_suppliers=gives, _both=has & gives, _any=has | gives)
    return counts.withColumn("coverage", F.when(F.col("_both") == F.col("total"), "complete").when(F.col("_any") > 0, "partial").otherwise("none")).drop("_both", "_any")


@Q.add("""
WITH a AS (SELECT c_nationkey AS area, count(*) AS c FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS area, count(*) AS s FROM supplier GROUP BY 1)
SELECT coalesce(a.area, b.area) AS area, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM a FULL JOIN b ON a.area = b.area""")
def measures_by_key_union(spark, sf_dir):
    a = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("customers"))
    b = load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("suppliers"))
    return jn.outer_by_key([a, b], "area", ["customers", "suppliers"])


@Q.add("SELECT c_custkey, n_name AS area_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def mandatory_area(spark, sf_dir):
    return jn.mandatory(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("area")), jn.small(nations(spark, sf_dir).select("area", F.col("name").alias("area_name"))), "area").select("c_custkey", "area_name")


RESOLVED = """
WITH r AS (SELECT c_custkey, c_acctbal, c_nationkey, n_name, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '99' ELSE CAST(c_nationkey AS VARCHAR) END AS code,
                  CASE WHEN c_custkey % 14 = 0 THEN NULL WHEN c_custkey % 21 = 0 THEN 'nowhere' ELSE '  ' || n_name || ' ' END AS given
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
     k AS (SELECT *, lpad(code, 2, '0') AS c2 FROM r),
     m AS (SELECT k.*, CASE WHEN c2 IS NOT NULL THEN CASE WHEN CAST(c2 AS INT) < 25 THEN c2 END
                            WHEN given IS NOT NULL AND given <> 'nowhere' THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS area_code FROM k),
     u AS (SELECT *, CASE WHEN area_code IS NOT NULL THEN NULL WHEN c2 IS NOT NULL THEN 'unknown_code' WHEN given IS NOT NULL THEN 'unknown_name' ELSE 'no_area' END AS unmapped_reason FROM m)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose code or name of the area is now and then missing or unknown."""
    areas = nations(spark, sf_dir)
    key = F.col("c_custkey")
    records = load(spark, sf_dir, "customer").join(jn.small(areas.select(F.col("area").alias("c_nationkey"), "name")), "c_nationkey")
    code = F.when(key % 7 == 0, None).when(key % 11 == 0, "99").otherwise(F.col("c_nationkey").cast("string"))
    given = F.when(key % 14 == 0, None).when(key % 21 == 0, "nowhere").otherwise(F.concat(F.lit("  "), F.col("name"), F.lit(" ")))
    lookup = areas.select(F.lpad(F.col("area").cast("string"), 2, "0").alias("area_code"), F.col("name").alias("area_name"))
    return jn.resolve_area(records.select("c_custkey", code.alias("code"), given.alias("given")), lookup, ["code"], ["given"])


@Q.add(RESOLVED + " SELECT c_custkey, area_code, unmapped_reason FROM u")
def resolved_areas(spark, sf_dir):
    return resolved(spark, sf_dir).select("c_custkey", "area_code", "unmapped_reason")


@Q.add(RESOLVED + " SELECT unmapped_reason AS reason, count(*) AS records FROM u WHERE unmapped_reason IS NOT NULL GROUP BY 1")
def unmapped_reasons(spark, sf_dir):
    return resolved(spark, sf_dir).where("unmapped_reason IS NOT NULL").groupBy(F.col("unmapped_reason").alias("reason")).agg(F.count(F.lit(1)).alias("records"))


@Q.add("""
SELECT area_code, count(DISTINCT o) AS orders FROM (
  SELECT l_orderkey AS o, s_nationkey AS area_code FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def orders_once_per_area(spark, sf_dir):
    """An order counts once for each area among its suppliers' and its customer's."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lists = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("s_nationkey").alias("areas"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.join(lists, "o_orderkey", "full")
    return jn.once_per_area(rows, "o_orderkey", "areas", "c_nationkey").groupBy("area_code").agg(F.count(F.lit(1)).alias("orders"))


@Q.add("""
WITH t AS (SELECT n_name AS area, max(o_orderdate) AS latest FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT area, strftime(latest, '%Y-%m-%d') AS latest FROM t""")
def latest_by_area(spark, sf_dir):
    own = profiles(spark, sf_dir).where("latest_order IS NOT NULL")
    return own.select(F.col("name").alias("area"), F.date_format("latest_order", "yyyy-MM-dd").alias("latest"))


QUERIES, ORACLE_SQL = Q.found, Q.sql
