"""Queries over record versions, distributions, gates and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.functions import ids
from cadastra.functions.numbers import rounded
from cadastra.operators import aggregates as ag
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn
from cadastra.operators import ranking as rk
from cadastra.operators import sync as sy
from cadastra.plans.queries import Queries
from cadastra.session import load

Q = Queries()
CUT = "1997-01-01"


@Q.add("""
WITH c AS (SELECT source, lang AS label, count(*) AS value, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1, 2)
SELECT source, label, value, CAST(row_number() OVER (PARTITION BY source ORDER BY value DESC, f) AS INT) AS rank,
       CAST(round(CAST(value * 100.0 / sum(value) OVER (PARTITION BY source) AS DECIMAL(28,10)), 1) AS DOUBLE) AS share_pct FROM c QUALIFY rank <= 4""")
def languages_by_source(spark, sf_dir):
    return ag.distribution(load(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "lang", "doc_id", 4, ["source"])


@Q.add("SELECT event_type AS label, count(*) AS value FROM events WHERE event_type <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def commonest_events(spark, sf_dir):
    return ag.commonest(load(spark, sf_dir, "events").select("event_type"), "event_type")


@Q.add("SELECT coalesce(nullif(role, ''), 'not stated') AS label, count(*) AS value FROM conversations GROUP BY 1")
def role_tally(spark, sf_dir):
    return ag.tally(load(spark, sf_dir, "conversations").select("role"), "role", "not stated")


@Q.add("SELECT p_name AS name, p_retailprice AS value FROM part ORDER BY 2 DESC, p_partkey LIMIT 5")
def top_values(spark, sf_dir):
    return load(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("value"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_partkey")
    record = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return lines.select(F.col("l_returnflag").alias("dataset_key"), record.alias("record_id"), ids.stable_hash(F.col("l_partkey"), F.col("l_linestatus")).alias("record_hash"), "l_shipdate")


VERSIONS = f"""
WITH v AS (SELECT l_returnflag AS dataset_key, l_orderkey || ':' || l_linenumber AS record_id, sha256(l_partkey || '|' || l_linestatus) AS record_hash, l_shipdate FROM lineitem),
     k AS (SELECT DISTINCT dataset_key, record_id, record_hash FROM v WHERE l_shipdate < TIMESTAMP '{CUT}'),
     n AS (SELECT dataset_key, record_id, record_hash, min(l_shipdate) AS l_shipdate FROM v ANTI JOIN k USING (dataset_key, record_id, record_hash) GROUP BY 1, 2, 3)"""


@Q.add(VERSIONS + " SELECT dataset_key, count(*) AS loaded FROM n GROUP BY 1")
def versions_loaded(spark, sf_dir):
    """What an idempotent load of all versions adds to those that are known."""
    rows = versions(spark, sf_dir)
    keys = ["dataset_key", "record_id", "record_hash"]
    return sy.unseen(rows, rows.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")), keys, "l_shipdate").groupBy("dataset_key").agg(F.count(F.lit(1)).alias("loaded"))


@Q.add(VERSIONS + " SELECT (SELECT count(*) FROM n) AS loaded, (SELECT count(*) FROM v) - (SELECT count(*) FROM n) AS skipped")
def load_counts(spark, sf_dir):
    rows = versions(spark, sf_dir)
    return sy.load_counts(rows, rows.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")), ["dataset_key", "record_id", "record_hash"], "l_shipdate")


@Q.add("SELECT l_returnflag AS source, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN max(l_linestatus) END AS as_of, count(*) AS records FROM lineitem GROUP BY 1")
def run_as_of(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("as_of"))
    return ag.single_as_of(rows, ["source"])


def releases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders of two releases: the base has those before a date, the head all but the cancelled-like P ones, some changed."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority", "o_orderdate")
    base = orders.where(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select("key", F.col("o_orderpriority").alias("value"), "o_orderstatus", "o_orderdate")
    changed = F.when(F.col("key") % 10 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(F.col("o_orderpriority"))
    return base, orders.where("o_orderstatus <> 'P'").select("key", changed.alias("value"), "o_orderstatus", "o_orderdate")


RELEASES = """
WITH b AS (SELECT o_orderkey AS key, o_orderpriority AS value, o_orderstatus, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
     h AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN o_orderpriority || '!' ELSE o_orderpriority END AS value, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus <> 'P')"""


@Q.add(RELEASES + """
SELECT coalesce(b.key, h.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN h.key IS NULL THEN 'removed' WHEN b.value IS NOT DISTINCT FROM h.value THEN 'unchanged' ELSE 'changed' END AS change
FROM b FULL JOIN h ON b.key = h.key""")
def release_changes(spark, sf_dir):
    return jn.compare_releases(*releases(spark, sf_dir), "key", "value")


@Q.add(RELEASES + """, j AS (SELECT b.key AS x, h.key AS y FROM b FULL JOIN h ON b.key = h.key)
SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) AS either,
       CAST(round(CAST(1 - count(*) FILTER (x IS NOT NULL AND y IS NOT NULL)::DOUBLE / count(*) AS DECIMAL(28,10)), 6) AS DOUBLE) AS churn FROM j""")
def release_churn(spark, sf_dir):
    return jn.churn(*releases(spark, sf_dir), "key")


@Q.add(RELEASES + """
SELECT coalesce(b.key, h.key) AS key, CASE WHEN b.key IS NULL THEN 'inserted' WHEN h.key IS NULL THEN 'deleted' WHEN b.value = h.value AND b.o_orderstatus = h.o_orderstatus THEN 'unchanged' ELSE 'updated' END AS action
FROM b FULL JOIN h ON b.key = h.key""")
def artifact_sync(spark, sf_dir):
    base, head = releases(spark, sf_dir)
    return sy.classify(base, head, "key", ["value", "o_orderstatus"])


@Q.add(RELEASES + """,
 x AS (SELECT o_orderstatus AS dataset, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS a FROM b GROUP BY 1),
 y AS (SELECT o_orderstatus AS dataset, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d') AS a FROM h GROUP BY 1),
 j AS (SELECT coalesce(x.dataset, y.dataset) AS dataset, x.n AS xn, y.n AS yn, x.a AS xa, y.a AS ya FROM x FULL JOIN y ON x.dataset = y.dataset)
SELECT dataset, 'dataset is gone' AS problem FROM j WHERE yn IS NULL UNION ALL SELECT dataset, 'rows fell' FROM j WHERE yn < xn
UNION ALL SELECT dataset, 'rows rose' FROM j WHERE xn > 0 AND yn > xn * 1.2 UNION ALL SELECT dataset, 'as_of went back' FROM j WHERE ya < xa""")
def release_drift(spark, sf_dir):
    shape = lambda df: df.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("as_of"))
    base, head = releases(spark, sf_dir)
    return gt.drift(shape(base), shape(head), "dataset", "as_of", 0.0, 0.2)


@Q.add("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_run(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return rk.latest(orders, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@Q.add("""
WITH r AS (SELECT event_type AS metric, user_id AS station, ts, event_id, value, count(*) OVER w AS points, row_number() OVER (w ORDER BY ts DESC, event_id DESC) AS n
           FROM events WHERE value IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY event_type, user_id))
SELECT metric, station, points, max(value) FILTER (n = 1) AS latest, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS shown, points >= 2 AS is_series FROM r WHERE n <= 12 GROUP BY metric, station, points""")
def station_series(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("user_id").alias("station"), "ts", "event_id", "value")
    out = rk.last_points(rows, ["metric", "station"], "ts", "event_id", "value")
    return out.select("metric", "station", "points", "latest", F.date_format(F.element_at("last", 1)["t"], "yyyy-MM-dd HH:mm:ss").alias("since"), F.size("last").cast("long").alias("shown"), "is_series")


@Q.add("""
WITH r AS (SELECT event_type AS metric, user_id AS station, ts, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE value IS NOT NULL)
SELECT metric, station, CAST(n AS INT) AS rank, event_id, value FROM r WHERE n <= 100""")
def last_hundred(spark, sf_dir):
    rows = load(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_type").alias("metric"), F.col("user_id").alias("station"), "ts", "event_id", "value")
    return rk.ranked(rows, ["metric", "station"], F.desc("ts"), F.desc("event_id"), k=100).drop("ts")


@Q.add("SELECT p_name, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) = 1")
def first_seen_name(spark, sf_dir):
    return rk.first_seen(load(spark, sf_dir, "part").select("p_name", "p_partkey", "p_size"), "p_name", F.desc("p_size"), "p_partkey")


@Q.add("SELECT event_type AS metric, max(value) AS highest, CAST(round(CAST(sum(CAST(value AS DECIMAL(28,10))) AS DECIMAL(28,10)), 2) AS DOUBLE) AS total, count(value) AS readings FROM events GROUP BY 1")
def sensor_totals(spark, sf_dir):
    from cadastra.functions.numbers import exact

    rows = load(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return rows.groupBy("metric").agg(F.max("value").alias("highest"), rounded(F.sum(exact("value")), 2).alias("total"), F.count("value").alias("readings"))


GROUPS = """
WITH g AS (SELECT coalesce(nullif(trim(p_brand), ''), 'not stated') AS p_brand, coalesce(nullif(trim(p_type), ''), 'not stated') AS p_type, CAST(p_size AS VARCHAR) AS size, p_partkey, p_name, lpad(CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR), 8, '0') AS price FROM part)"""


@Q.add(GROUPS + """
SELECT substr(sha256(p_brand || chr(31) || p_type || chr(31) || size), 1, 16) AS group_id, p_brand, p_type, size, count(*) AS participants, count(DISTINCT p_name) AS businesses, max(price) AS latest_update,
       array_to_string(list_sort(list(DISTINCT p_name)), ',') AS subdistricts FROM g GROUP BY p_brand, p_type, size""")
def provisional_groups(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").cast("string").alias("size"), "p_partkey", "p_name", F.lit("all").alias("district"), F.lpad(F.rint("p_retailprice").cast("long").cast("string"), 8, "0").alias("updated"))
    out = ag.provisional_groups(parts, ["p_brand", "p_type", "size"], "not stated", "p_partkey", "p_name", "district", "p_name", "updated")
    return out.select("group_id", "p_brand", "p_type", "size", "participants", "businesses", "latest_update", F.array_join(F.col("districts")[0]["subdistricts"], ",").alias("subdistricts"))


@Q.add("""
WITH o AS (SELECT p_brand AS district, count(DISTINCT p_partkey) AS outer_projects FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12),
     i AS (SELECT p_brand AS district, outer_projects, p_type AS subdistrict, count(DISTINCT p_partkey) AS inner_projects FROM part JOIN o ON p_brand = district GROUP BY 1, 2, 3)
SELECT district, outer_projects, subdistrict, inner_projects, CAST(row_number() OVER (PARTITION BY district ORDER BY inner_projects DESC, subdistrict) AS INT) AS rank FROM i QUALIFY rank <= 6""")
def two_level_rollup(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select(F.col("p_brand").alias("district"), F.col("p_type").alias("subdistrict"), "p_partkey")
    return ag.two_level_rollup(parts, "district", "subdistrict", "p_partkey")


@Q.add("""
SELECT count(DISTINCT l_orderkey) AS records, count(*) AS entries, count(l_extendedprice) AS known, CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(28,10))) AS DECIMAL(28,10)), 2) AS DOUBLE) AS amount
FROM lineitem WHERE contains(l_returnflag, 'R')""")
def funding_totals(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", F.array(F.struct(F.col("l_returnflag").alias("funder"), F.col("l_extendedprice").alias("amount"))).alias("funders"))
    return ag.funding(lines, "funders", "R", "l_orderkey")


@Q.add("SELECT count(*) AS projects, count(p_name) AS with_name, count(*) FILTER (p_size > 25) AS large, count(*) FILTER (p_retailprice > 1000) AS priced FROM part")
def known_fields(spark, sf_dir):
    return load(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("projects"), F.count("p_name").alias("with_name"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.col("p_retailprice") > 1000).alias("priced"))


@Q.add("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def gate_duplicates(spark, sf_dir):
    return gt.duplicates(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@Q.add("SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS ids, count(*) AS reported FROM lineitem HAVING count(*) <> count(DISTINCT l_orderkey)")
def gate_complete(spark, sf_dir):
    return gt.complete(load(spark, sf_dir, "lineitem"), "l_orderkey")


@Q.add("""
WITH h AS (SELECT DISTINCT c_nationkey AS city, o_orderpriority AS metric FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 499000)
SELECT city, metric FROM (SELECT * FROM (SELECT DISTINCT c_nationkey AS city FROM customer), (SELECT DISTINCT o_orderpriority AS metric FROM orders)) ANTI JOIN h USING (city, metric)""")
def gate_missing_pairs(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("city"), F.col("o_orderpriority").alias("metric"), "o_totalprice")
    return gt.missing_pairs(orders.where("o_totalprice > 499000"), load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city")), "city", orders, "metric")


@Q.add("""
WITH a AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_orderpriority AS label, count(*) AS t FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT label, n AS rows, t AS published FROM a FULL JOIN p USING (label) WHERE coalesce(n, 0) <> coalesce(t, 0)""")
def gate_unreconciled(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("label"), "o_orderstatus")
    published = orders.where("o_orderstatus <> 'P' OR label <> '5-LOW'").groupBy("label").agg(F.count(F.lit(1)).alias("t"))
    return gt.unreconciled(orders, "label", published, "t")


@Q.add("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) WHERE doc_id IS NOT NULL")
def gate_unlabelled(spark, sf_dir):
    return gt.unknown_references(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


@Q.add("""
WITH s AS (SELECT DISTINCT c_nationkey AS area FROM customer WHERE c_acctbal > 9900 UNION ALL SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000), c AS (SELECT area, count(*) AS n FROM s GROUP BY 1)
SELECT n_nationkey AS area, coalesce(n, 0) AS sets FROM nation LEFT JOIN c ON area = n_nationkey WHERE coalesce(n, 0) <> 1""")
def gate_partition(spark, sf_dir):
    areas = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"))
    rich = load(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("area"))
    good = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("area"))
    return jn.partition_of(areas, [rich, good], "area")


@Q.add("""
WITH c AS (SELECT CASE WHEN event_id % 11 = 0 THEN '=' || event_type WHEN event_id % 13 = 0 THEN ' @x' WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS cell, CAST(-value AS VARCHAR) AS number FROM events WHERE value IS NOT NULL)
SELECT 'cell' AS "column", 'formula' AS problem, count(*) FILTER (starts_with(cell, '=') OR starts_with(cell, ' @')) AS cells FROM c UNION ALL SELECT 'cell', 'missing', count(*) FILTER (cell IS NULL) FROM c""")
def gate_unsafe_cells(spark, sf_dir):
    """Cells of a table that a spreadsheet would calculate, or that are missing; numbers below 0 are neither."""
    number = F.col("event_id")
    cell = F.when(number % 11 == 0, F.concat(F.lit("="), "event_type")).when(number % 13 == 0, " @x").when(number % 17 != 0, F.col("value").cast("string"))
    return gt.unsafe_cells(load(spark, sf_dir, "events").where("value IS NOT NULL").select(cell.alias("cell"), (-F.col("value")).cast("string").alias("number")), ["cell", "number"])


@Q.add("""
WITH f AS (SELECT vec_id, embedding[1]::DOUBLE * 180 AS lon, embedding[2]::DOUBLE * 90 AS lat FROM embeddings)
SELECT vec_id FROM f WHERE lon + 4 >= -10 AND lon <= 20 AND lat + 2 >= -5 AND lat <= 15""")
def features_in_box(spark, sf_dir):
    return jn.overlaps(features(spark, sf_dir), (-10.0, -5.0, 20.0, 15.0)).select("vec_id")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("embedding")[0].cast("double") * 180, F.col("embedding")[1].cast("double") * 90
    return load(spark, sf_dir, "embeddings").select("vec_id", lon.alias("min_lon"), lat.alias("min_lat"), (lon + 4).alias("max_lon"), (lat + 2).alias("max_lat"))


@Q.add("""
WITH f AS (SELECT vec_id, embedding[1]::DOUBLE * 900 AS lon, embedding[2]::DOUBLE * 450 AS lat FROM embeddings)
SELECT vec_id FROM f WHERE lon IS NULL OR lat IS NULL OR abs(lon) > 180 OR abs(lat) > 90""")
def gate_invalid_places(spark, sf_dir):
    places = load(spark, sf_dir, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * 900).alias("lon"), (F.col("embedding")[1].cast("double") * 450).alias("lat"))
    return gt.invalid_boxes(places, "vec_id", ["lon"], ["lat"])


@Q.add("""
WITH g(key_pattern) AS (VALUES ('si.*'), ('purchase|view'), ('v.*'))
SELECT event_id, (SELECT count(*) FROM g WHERE regexp_full_match(event_type, key_pattern)) AS matches, (SELECT max(key_pattern) FROM g WHERE regexp_full_match(event_type, key_pattern)) AS grain FROM events""")
def grain_of_records(spark, sf_dir):
    grains = spark.createDataFrame([("si.*",), ("purchase|view",), ("v.*",)], "key_pattern string")
    out = jn.by_pattern(load(spark, sf_dir, "events").select("event_id", "event_type"), grains, "event_type")
    return out.select("event_id", F.col("_matches").alias("matches"), F.col("key_pattern").alias("grain"))


@Q.add("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'apache license')")
def search_documents(spark, sf_dir):
    return jn.search(load(spark, sf_dir, "documents"), ["source", "lang", "text"], "Apache License").select("doc_id", "source")


@Q.add("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1998-01-01'")
def filtered_records(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    return jn.where_given(orders, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey", "o_orderpriority")


QUERIES, ORACLE_SQL = Q.found, Q.sql
