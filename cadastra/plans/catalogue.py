"""Queries over the catalogue of sources, payload fields, times and sets of keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import ids, times
from cadastra.functions import text as tx
from cadastra.functions.numbers import exact, lenient_double, rounded
from cadastra.operators import aggregates as ag
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn
from cadastra.operators import nested as ns
from cadastra.operators import ranking as rk
from cadastra.plans.queries import Queries
from cadastra.session import load

Q = Queries()


@Q.add("""
WITH c AS (SELECT source AS s, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1),
     l AS (SELECT source AS s, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1),
     n AS (SELECT source AS s, doc_id AS latest, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1)
SELECT c.s AS source, documents, chars, coalesce(labelled, 0) AS labelled, latest, lang FROM c LEFT JOIN l ON l.s = c.s LEFT JOIN n ON n.s = c.s WHERE c.s IS NOT NULL""")
def source_rows(spark, sf_dir):
    """Every source with its counts, defaults, and what its latest record says."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    counts = docs.where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))
    labelled = docs.join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("labelled"))
    latest = rk.latest(docs, ["source"], "doc_id", "doc_id").select("source", F.col("doc_id").alias("latest"), "lang")
    return jn.with_dimensions(counts, "source", [labelled, latest], {"labelled": 0})


@Q.add("""
SELECT count(*) AS sources, count(*) FILTER (n > 40) AS large, count(*) FILTER (langs = 4) AS in_all_languages, max(n) AS most
FROM (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1)""")
def operations_summary(spark, sf_dir):
    per = load(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))
    return per.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("n") > 40).alias("large"), F.count_if(F.col("langs") == 4).alias("in_all_languages"), F.max("n").alias("most"))


@Q.add("SELECT event_id, key, value FROM (SELECT event_id, unnest(map_entries(from_json(props, '{\"k\": \"VARCHAR\"}')::STRUCT(k VARCHAR)::JSON::MAP(VARCHAR, VARCHAR)), recursive := true) FROM events) WHERE value <> ''")
def payload_fields(spark, sf_dir):
    """The payload's fields that have a value, by name without their prefix."""
    events = load(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("fields"))
    return events.select("event_id", F.explode(ns.kept_fields("fields", "source_")).alias("key", "value"))


@Q.add("SELECT event_id, props->>'$.k' AS by_path, props->>'$.k' AS by_pointer, CAST(props->>'$.k' AS DOUBLE) AS number, 1 AS items FROM events")
def payload_paths(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", ids.field("props", "k").alias("by_path"), ids.pointer("props", "/k").alias("by_pointer"), lenient_double(ids.field("props", "k")).alias("number"), ag.item_count(F.col("props")).alias("items"))


@Q.add("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props->>'$.k' WHEN event_id % 3 = 1 THEN event_type ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS observed,
       left('events:' || (props->>'$.k') || ':' || event_type, 200) AS snapshot_id FROM events""")
def observed_times(spark, sf_dir):
    """When a record was observed: its own time, else its as_of, else when it was fetched."""
    events = load(spark, sf_dir, "events")
    own = F.when(F.col("event_id") % 3 == 0, ids.field("props", "k"))
    as_of = F.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")
    payload = F.to_json(F.struct(ids.field("props", "k").alias("k"), F.col("event_type").alias("t")))
    return events.select("event_id", times.observed_at(as_of, F.col("ts"), own).alias("observed"), ids.snapshot_id(F.lit("events"), payload, ["k"], ["x", "t"], F.lit("-")).alias("snapshot_id"))


@Q.add("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 12:30:00') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 05:30:00') WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS parsed,
       CASE WHEN o_orderkey % 4 IN (0, 1) THEN true ELSE false END AS zoned, strftime(o_orderdate, '%G-W%V') AS week FROM orders""")
def parsed_times(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    given = F.when(kind == 0, F.concat(day, F.lit("T12:30:00Z"))).when(kind == 1, F.concat(day, F.lit(" 12:30:00+07:00"))).when(kind == 2, F.substring(day, 1, 4)).otherwise(day)
    return orders.withColumn("given", given).select("o_orderkey", F.date_format(times.iso_time("given"), "yyyy-MM-dd HH:mm:ss").alias("parsed"), times.zoned_iso_time("given").isNotNull().alias("zoned"), times.bucket("o_orderdate", "weekly").alias("week"))


@Q.add("""
WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
SELECT 'union' AS kind, count(*) AS keys FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'difference', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def key_sets(spark, sf_dir):
    a = load(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("keys"))
    return count(a.union(b).distinct(), "union").unionByName(count(a.intersect(b), "intersection")).unionByName(count(a.subtract(b), "difference"))


@Q.add("""
WITH s AS (SELECT lang, list_sort(list(DISTINCT source)) AS l FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY 1)
SELECT lang, array_to_string(list_concat(l, list_filter(['src0', 'added'], lambda x: NOT list_contains(l, x))), ',') AS sources FROM s""")
def ordered_sources(spark, sf_dir):
    """Each language's sources with two that are always named, in order and once each."""
    own = load(spark, sf_dir, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("l"))
    return own.select("lang", F.array_join(F.array_union("l", F.array(F.lit("src0"), F.lit("added"))), ",").alias("sources"))


@Q.add("""
WITH v AS (SELECT s_nationkey AS area, s_name AS city, 'balance' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_nationkey, s_name, 'same', CAST(s_suppkey * 0 AS DOUBLE) FROM supplier),
     b AS (SELECT metric, min(value) AS low, median(value) AS mid, max(value) AS high FROM v GROUP BY 1)
SELECT area, city, metric, CAST(round(CAST(CASE WHEN high = low THEN 50 ELSE (value - low) / (high - low) * 100 END AS DECIMAL(28,10)), 1) AS DOUBLE) AS position,
       CASE WHEN mid = 0 THEN abs(value) > 0.10 AND value > 0 ELSE value > mid AND abs(value - mid) / abs(mid) > 0.10 END AS concern FROM v JOIN b USING (metric)""")
def city_positions(spark, sf_dir):
    """Cities within areas: their position in the range of all, and whether they lie over a tenth above the median. One metric is the same for all."""
    city = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("area"), F.col("s_name").alias("city"), F.col("s_acctbal").alias("balance"), (F.col("s_suppkey") * 0).cast("double").alias("same"))
    values = city.unpivot(["area", "city"], ["balance", "same"], "metric", "value")
    out = ag.against_median(values, ag.benchmark(values), concern=F.lit("high"))
    return out.select("area", "city", "metric", F.col("position_pct").alias("position"), F.col("attention").alias("concern"))


@Q.add("""
WITH m AS (SELECT user_id AS station, max(ts) AS last FROM events GROUP BY 1)
SELECT station, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN 'available' WHEN count(*) > 0 THEN 'snapshot_only' ELSE 'unavailable' END AS status, count(*) AS samples
FROM events JOIN m ON user_id = station WHERE ts >= last - INTERVAL 30 DAY GROUP BY station""")
def station_status(spark, sf_dir):
    from cadastra.operators.history import trailing

    rows = trailing(load(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "ts", "event_type"), 30, ["station"])
    status = F.when(F.count_if(F.col("event_type") == "view") > 0, "available").when(F.count(F.lit(1)) > 0, "snapshot_only").otherwise("unavailable")
    return rows.groupBy("station").agg(status.alias("status"), F.count(F.lit(1)).alias("samples"))


@Q.add("""
SELECT o_orderkey, count(*) AS declared, count(*) FILTER (l_quantity > 0) AS counted, CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(28,10))) AS DECIMAL(28,10)), 2) AS DOUBLE) AS quantity
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1""")
def declared_counts(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    orders = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    per = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey")
    return per.agg(F.count(F.lit(1)).alias("declared"), F.count_if(F.col("l_quantity") > 0).alias("counted"), rounded(F.sum(exact("l_quantity")), 2).alias("quantity"))


@Q.add("""
WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1), e AS (SELECT l_returnflag AS k, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(a.k, e.k) AS k, a.n AS actual, e.n AS expected FROM a FULL JOIN e ON a.k = e.k WHERE a.n IS DISTINCT FROM e.n""")
def gate_wrong_counts(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), "l_orderkey")
    return gt.wrong_counts(lines.groupBy("k").agg(F.count(F.lit(1)).alias("n")), lines.where("k <> 'R'").groupBy("k").agg(F.countDistinct("l_orderkey").alias("n")), "k", "n")


@Q.add("SELECT c_custkey, contains(lower(replace(c_mktsegment, ' ', '')), 'build') AS named FROM customer")
def named_areas(spark, sf_dir):
    """Whether a record's text names an area."""
    return load(spark, sf_dir, "customer").select("c_custkey", tx.names_area("c_mktsegment", F.lit("Build")).alias("named"))


@Q.add(r"""
WITH q AS (SELECT page_id, url, CASE WHEN contains(url, '?') THEN substr(url, instr(url, '?') + 1) WHEN url IS NOT NULL THEN '' END AS a FROM pages),
     d AS (SELECT *, url_decode(a) AS b, url_decode(url_decode(a)) AS c, url_decode(url_decode(url_decode(a))) AS d, url_decode(url_decode(url_decode(url_decode(a)))) AS e FROM q),
     k AS (SELECT *, list_transform(string_split(concat_ws('&', a, b, c, d), '&'), lambda x: url_decode(replace(split_part(x, '=', 1), '+', ' '))) AS keys FROM d),
     s AS (SELECT *, list_transform(keys, lambda x: trim(regexp_replace(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9ก-๙]+', '_', 'g'), '_')) AS names FROM k)
SELECT page_id, url, CASE WHEN a IS NOT NULL THEN d <> e OR len(list_filter(names, lambda x: regexp_matches(x, '(?:^|_)(?:password|secret|token|cookie|authorization|api_?key)(?:_|$)'))) > 0 END AS has_credentials FROM s""")
def url_credentials(spark, sf_dir):
    from pyspark.sql.types import BooleanType

    return ns.map_column(load(spark, sf_dir, "pages").select("page_id", "url"), "url", "has_credentials", ns.has_credentials, BooleanType())


QUERIES, ORACLE_SQL = Q.found, Q.sql
