"""Queries that compose what is published of each area and source."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions.codes import restricted_endpoint
from cadastra.functions.numbers import exact, rounded
from cadastra.operators import aggregates as ag
from cadastra.operators import briefings as br
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn
from cadastra.operators import nodes as nd
from cadastra.operators import ranking as rk
from cadastra.plans.areas import COMPARED, CONCERN, metrics, nations
from cadastra.plans.queries import Queries
from cadastra.session import load

Q = Queries()
ROUND = "CAST(round(CAST({} AS DECIMAL(28,10)), {}) AS DOUBLE)"


def placed_orders(spark, sf_dir):
    """Orders with the area of their customer."""
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area"))
    return load(spark, sf_dir, "orders").join(customers, "o_custkey")


@Q.add(f"""
WITH o AS (SELECT orders.*, c_nationkey AS area FROM orders JOIN customer ON c_custkey = o_custkey),
     y AS (SELECT area, year(o_orderdate) AS y, count(*) AS n FROM o GROUP BY 1, 2),
     l AS (SELECT area, CAST(arg_max(n, y) AS DOUBLE) AS population_latest FROM y GROUP BY 1),
     s AS (SELECT area, {ROUND.format("count(*) FILTER (o_orderstatus = 'F') * 100.0 / count(*)", 4)} AS finished_share,
                  CAST(sum(CASE WHEN o_totalprice > 490000 AND o_orderpriority = '1-URGENT' THEN 1 END) AS DOUBLE) AS l4, CAST(sum(CASE WHEN o_totalprice > 490000 AND o_orderpriority = '5-LOW' THEN 1 END) AS DOUBLE) AS l5 FROM o GROUP BY 1),
     w AS (SELECT area, population_latest, finished_share, l4 + l5 AS level_4_and_5 FROM l JOIN s USING (area))
SELECT area, indicator, value FROM w UNPIVOT (value FOR indicator IN (population_latest, finished_share, level_4_and_5))""")
def headline_indicators(spark, sf_dir):
    """The value of the latest year, a share in per cent, and a sum that needs both of its parts."""
    orders = placed_orders(spark, sf_dir)
    years = orders.groupBy("area", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    high = lambda p: F.sum(F.when((F.col("o_totalprice") > 490000) & (F.col("o_orderpriority") == p), 1))
    sums = orders.groupBy("area").agg(rounded(F.count_if(F.col("o_orderstatus") == "F") * 100.0 / F.count(F.lit(1)), 4).alias("finished_share"), (high("1-URGENT") + high("5-LOW")).alias("level_4_and_5"))
    wide = br.latest_by_number(years, "area", "year", "n", "population_latest").join(sums, "area")
    return br.indicators(wide, "area", ["population_latest", "finished_share", "level_4_and_5"])


SECTIONS = """
WITH r AS (SELECT c_nationkey AS area, 'customers' AS section, 0 AS ordinal FROM customer WHERE c_acctbal > 9700 UNION ALL SELECT s_nationkey, 'suppliers', 1 FROM supplier WHERE s_acctbal > 5000
           UNION ALL SELECT c_nationkey, 'orders', 2 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 498000),
     t AS (SELECT n_nationkey AS area, s.section, s.ordinal, count(r.section) AS records FROM nation CROSS JOIN (VALUES ('customers', 0), ('suppliers', 1), ('orders', 2)) s(section, ordinal)
           LEFT JOIN r ON r.area = n_nationkey AND r.section = s.section GROUP BY 1, 2, 3)"""


def sections(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").where("c_acctbal > 9700").select(F.col("c_nationkey").alias("area"))
    suppliers = load(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("area"))
    orders = placed_orders(spark, sf_dir).where("o_totalprice > 498000").select("area")
    return br.section_totals(nations(spark, sf_dir), {"customers": customers, "suppliers": suppliers, "orders": orders}, "area")


@Q.add(SECTIONS + " SELECT area, section, CAST(ordinal AS INT) AS ordinal, records, CASE WHEN records > 0 THEN 'available' ELSE 'source_has_no_record_for_area' END AS status FROM t")
def section_totals(spark, sf_dir):
    return sections(spark, sf_dir)


@Q.add(SECTIONS + """
SELECT area, CAST(sum(records) AS BIGINT) AS records, coalesce(string_agg(section, ',' ORDER BY ordinal) FILTER (records > 0), '') AS available, count(*) FILTER (records = 0) AS without FROM t GROUP BY 1""")
def source_coverage_by_area(spark, sf_dir):
    return br.coverage(sections(spark, sf_dir), "area")


DIMENSIONS = COMPARED + f""",
 k AS (SELECT *, CASE WHEN attention THEN {ROUND.format("gap", 4)} ELSE 0.0 END AS strength, CASE WHEN metric IN ('customers', 'mean_balance') THEN 'people' ELSE 'trade' END AS dimension FROM a),
 d AS (SELECT area, dimension, count(*) AS metrics, count(*) FILTER (attention) AS attention, arg_max(metric, (strength, metric)) FILTER (attention) AS strongest FROM k GROUP BY 1, 2)"""


def compared(spark, sf_dir):
    values = metrics(spark, sf_dir)
    concern = F.create_map(*(F.lit(x) for kv in CONCERN.items() for x in kv))[F.col("metric")]
    return ag.against_median(values, ag.benchmark(values), concern=concern)


def dimensions(spark, sf_dir):
    return br.dimension_summaries(compared(spark, sf_dir), F.when(F.col("metric").isin("customers", "mean_balance"), "people").otherwise("trade"))


@Q.add(DIMENSIONS + " SELECT * FROM d")
def dimension_summaries(spark, sf_dir):
    return dimensions(spark, sf_dir)


@Q.add(DIMENSIONS + """,
 u AS (SELECT area, CAST(row_number() OVER (PARTITION BY area ORDER BY strength DESC, metric) AS INT) AS rank, 'comparison' AS kind, metric AS label FROM k WHERE attention QUALIFY rank <= 3)
SELECT * FROM u UNION ALL SELECT area, CAST(row_number() OVER (PARTITION BY area ORDER BY dimension) AS INT) AS rank, 'coverage', dimension FROM d WHERE area NOT IN (SELECT area FROM u) QUALIFY rank <= 2""")
def observations(spark, sf_dir):
    return br.observations(compared(spark, sf_dir), dimensions(spark, sf_dir))


@Q.add(f"""
WITH l AS (SELECT s_nationkey AS area, l_orderkey, l_partkey, l_extendedprice, l_discount, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT area, count(DISTINCT l_partkey) AS projects, count(*) AS participants, count(*) FILTER (l_returnflag = 'R') AS funded, count(CASE WHEN l_returnflag = 'R' AND l_discount > 0 THEN l_discount END) AS funded_known,
       {ROUND.format("coalesce(sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(28,10)) END), 0)", 2)} AS amount, CASE WHEN count(*) FILTER (l_discount > 0.09) > 0 THEN 'available' ELSE 'not_stated' END AS outcome_status FROM l GROUP BY 1""")
def area_portfolios(spark, sf_dir):
    """Projects, participants, funding that is known, and whether any outcome is stated."""
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("area"))
    lines = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag").join(suppliers, "l_suppkey")
    funded = F.col("l_returnflag") == "R"
    known = funded & (F.col("l_discount") > 0)
    return lines.groupBy("area").agg(
        F.countDistinct("l_partkey").alias("projects"), F.count(F.lit(1)).alias("participants"), F.count_if(funded).alias("funded"), F.count_if(known).alias("funded_known"),
        rounded(F.coalesce(F.sum(F.when(known, exact("l_extendedprice"))), F.lit(0)), 2).alias("amount"), F.when(F.count_if(F.col("l_discount") > 0.09) > 0, "available").otherwise("not_stated").alias("outcome_status"),
    )


@Q.add("""
WITH o AS (SELECT orders.*, c_nationkey AS area, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey),
     w AS (SELECT area, CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) AS need, CAST(count(*) FILTER (o_totalprice > 490000) AS DOUBLE) AS input, CAST(count(*) AS DOUBLE) AS activity,
                  CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS output, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 499000) AS DOUBLE) AS outcome FROM o GROUP BY 1),
     v AS (SELECT area, stage, value FROM w UNPIVOT (value FOR stage IN (need, input, activity, output, outcome)))
SELECT area, CAST(list_position(['need', 'input', 'activity', 'output', 'outcome'], stage) - 1 AS INT) AS ordinal, stage, value, CASE WHEN value > 0 THEN 'evidence' ELSE 'no_evidence' END AS status FROM v""")
def decision_chain(spark, sf_dir):
    customers = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("area"), "c_acctbal")
    orders = load(spark, sf_dir, "orders").join(customers, "o_custkey")
    done = F.col("o_orderstatus") == "F"
    wide = orders.groupBy("area").agg(
        F.count_if(F.col("c_acctbal") < 0).alias("need"), F.count_if(F.col("o_totalprice") > 490000).alias("input"), F.count(F.lit(1)).alias("activity"),
        F.count_if(done).alias("output"), F.count_if(done & (F.col("o_totalprice") > 499000)).alias("outcome"),
    )
    return br.decision_chain(wide, "area", {s: s for s in ("need", "input", "activity", "output", "outcome")})


@Q.add("""
WITH d AS (SELECT source, lang, doc_id, n_chars, try_cast(right(source, 1) AS INT) % 3 AS k FROM documents WHERE source IS NOT NULL)
SELECT source, 'languages' AS kind, lang AS label, CAST(count(*) AS BIGINT) AS value FROM d WHERE k = 0 AND lang IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT source, 'latest', CAST(max(doc_id) AS VARCHAR), arg_max(n_chars, doc_id) FROM d WHERE k = 1 GROUP BY 1
UNION ALL SELECT source, 'quality', coalesce(CAST(quality AS VARCHAR), 'not labelled'), count(*) FROM d LEFT JOIN labels USING (doc_id) WHERE k = 2 GROUP BY 1, 3""")
def source_insights(spark, sf_dir):
    """Each source is told of in the way of its kind: by languages, by its latest record, or by its labels."""
    docs = load(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "lang", "doc_id", "n_chars", (F.expr("try_cast(right(source, 1) AS INT)") % 3).alias("k"))
    languages = docs.where("k = 0 AND lang IS NOT NULL").groupBy("source", F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("value"))
    latest = rk.latest(docs.where("k = 1"), ["source"], "doc_id", "doc_id").select("source", F.col("doc_id").cast("string").alias("label"), F.col("n_chars").alias("value"))
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    quality = docs.where("k = 2").join(labels, "doc_id", "left").groupBy("source", F.coalesce("label", F.lit("not labelled")).alias("label")).agg(F.count(F.lit(1)).alias("value"))
    told = [df.select("source", F.lit(kind).alias("kind"), "label", "value") for kind, df in (("languages", languages), ("latest", latest), ("quality", quality))]
    return told[0].unionByName(told[1]).unionByName(told[2])


@Q.add("""
WITH e AS (SELECT CAST(user_id % 25 AS INT) AS area, event_type AS source FROM events WHERE event_type IN ('error', 'purchase', 'signup'))
SELECT n_name AS area, s.source, count(e.area) AS records FROM nation CROSS JOIN (SELECT DISTINCT source FROM e) s LEFT JOIN e ON e.area = n_nationkey AND e.source = s.source GROUP BY 1, 2""")
def area_counts_by_source(spark, sf_dir):
    """Records of each area in each of a few sources, 0 where it has none."""
    events = load(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase", "signup")).select((F.col("user_id") % 25).cast("int").alias("area"), F.col("event_type").alias("source"))
    counts = events.groupBy("area", "source").agg(F.count(F.lit(1)).alias("records"))
    every = nations(spark, sf_dir).select("area", "name").join(jn.small(counts.select("source").distinct()))
    return every.join(counts, ["area", "source"], "left").select(F.col("name").alias("area"), "source", F.coalesce("records", F.lit(0)).alias("records"))


@Q.add("""
SELECT source, count(*) AS records, count(lang) AS mapped, count(*) FILTER (lang IS NULL) AS unmapped, count(DISTINCT lang) AS areas,
       CASE WHEN count(quality) = count(*) THEN 'complete' WHEN count(quality) > 0 THEN 'partial' ELSE 'missing' END AS status FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1""")
def executive_portfolio(spark, sf_dir):
    """Across sources: records, mapped and unmapped, areas reached, and whether their review is complete."""
    docs = load(spark, sf_dir, "documents").where("source IS NOT NULL").select("doc_id", "source", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.count("quality") == F.count(F.lit(1)), "complete").when(F.count("quality") > 0, "partial").otherwise("missing")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.count("lang").alias("mapped"), F.count_if(F.col("lang").isNull()).alias("unmapped"), F.countDistinct("lang").alias("areas"), status.alias("status"))


@Q.add("""
WITH s AS (SELECT source, try_cast(right(source, 1) AS INT) AS k, count(*) AS n, count(DISTINCT lang) AS l FROM documents WHERE source IS NOT NULL GROUP BY 1, 2),
     c AS (SELECT source, CASE k WHEN 0 THEN 'join_allowed' WHEN 1 THEN 'do_not_join' END AS decision, k < 4 AS expected, l AS linked, CASE WHEN k IN (2, 5) THEN n ELSE 0 END AS projected FROM s)
SELECT *, CASE decision WHEN 'join_allowed' THEN 'area_aggregate' WHEN 'do_not_join' THEN 'national_catalog' ELSE CASE WHEN projected > 0 THEN 'projection_candidate' ELSE 'unverified' END END AS grain,
       CASE decision WHEN 'join_allowed' THEN 'area_candidate' WHEN 'do_not_join' THEN 'not_area_scoped' ELSE CASE WHEN projected > 0 THEN 'candidate_unreviewed' WHEN expected THEN 'unverified' ELSE 'not_expected' END END AS linkability,
       CASE decision WHEN 'join_allowed' THEN linked WHEN 'do_not_join' THEN 0 ELSE CASE WHEN projected > 0 THEN projected END END AS linked_areas FROM c""")
def geography_decisions(spark, sf_dir):
    """What each source's records may be joined to, by its reviewed decision or else by what it projects."""
    k = F.expr("try_cast(right(source, 1) AS INT)")
    per = load(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("linked")).withColumn("k", k)
    cards = per.select("source", F.when(F.col("k") == 0, "join_allowed").when(F.col("k") == 1, "do_not_join").alias("decision"), (F.col("k") < 4).alias("expected"), "linked", F.when(F.col("k").isin(2, 5), F.col("n")).otherwise(0).alias("projected"))
    return br.geography_decisions(cards, [("join_allowed", "area_aggregate", "area_candidate"), ("do_not_join", "national_catalog", "not_area_scoped")])


@Q.add("""
WITH i AS (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 4 THEN 'elsewhere' WHEN c_nationkey % 5 = 3 THEN NULL ELSE 'NATION_' || c_nationkey END AS name FROM customer)
SELECT c_custkey, name, n_nationkey AS area, CASE WHEN n_nationkey IS NOT NULL THEN 'matched' WHEN name IS NULL THEN 'no_name' ELSE 'unmatched' END AS match FROM i LEFT JOIN nation ON name = n_name""")
def learning_projection(spark, sf_dir):
    """Records placed by the names they give; those without a known one stay and say so."""
    given = F.when(F.col("c_nationkey") % 5 == 4, "elsewhere").when(F.col("c_nationkey") % 5 != 3, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    items = load(spark, sf_dir, "customer").select("c_custkey", given.alias("name"))
    return br.lossless(items, nations(spark, sf_dir).select("name", "area"), "name", "area").select("c_custkey", "name", "area", "match")


@Q.add("""
WITH p AS (SELECT DISTINCT 'data/' || source || '/' || lang || '.json' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
     o(selector, pat, expected_files) AS (VALUES ('data/src0/*.json', '^data/src0/.*\\.json$', 4), ('data/src[12]/e?.json', '^data/src[12]/e.\\.json$', 3), ('data/src1/es.json', '^data/src1/es\\.json$', NULL), ('data/none/*', '^data/none/.*$', NULL)),
     m AS (SELECT path, selector FROM p JOIN o ON regexp_matches(path, pat)), c AS (SELECT path, count(*) AS n FROM m GROUP BY 1), f AS (SELECT selector, expected_files, (SELECT count(*) FROM m WHERE m.selector = o.selector) AS n FROM o)
SELECT p.path, m.selector, CASE WHEN c.n IS NULL THEN 'no contract' WHEN c.n > 1 THEN 'several contracts' END AS problem FROM p LEFT JOIN m ON m.path = p.path LEFT JOIN c ON c.path = p.path
UNION ALL SELECT NULL, selector, CASE WHEN n = 0 THEN 'fits no file' ELSE 'fits another number of files' END FROM f WHERE n = 0 OR n <> expected_files""")
def gate_bound_files(spark, sf_dir):
    """Files and the one contract each should have, by exact paths and shell patterns."""
    paths = load(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit(".json")).alias("path")).distinct()
    outputs = spark.createDataFrame([("data/src0/*.json", False, 4), ("data/src[12]/e?.json", False, 3), ("data/src1/es.json", True, None), ("data/none/*", False, None)], "selector string, exact boolean, expected_files int")
    return jn.bind_globs(paths, outputs)


@Q.add("""
SELECT o_orderkey, '$/part/held[]' AS path, 'row_count is not the size of rows' AS problem FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, '$', 'total_records is not the size of items' FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE o_orderkey % 15 = 0""")
def gate_declared_counts(spark, sf_dir):
    """Documents whose declared counts are wrong, at their top or within a part."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    per = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("rows"))  # an order has some seven lines
    part = F.struct("rows", (F.size("rows") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("row_count"))
    payload = F.to_json(F.struct(F.col("rows").alias("items"), (F.size("rows") - F.when(F.col("o_orderkey") % 15 == 0, 1).otherwise(0)).alias("total_records"), F.struct(F.array(part).alias("held")).alias("part")))
    return gt.wrong_declared_counts(per.select("o_orderkey", payload.alias("payload")), "o_orderkey", "payload")


@Q.add("""
WITH g AS (SELECT vec_id, vec_id % 3 AS k, round(embedding[1]::DOUBLE * 900, 6) AS x, round(embedding[2]::DOUBLE * 450, 6) AS y FROM embeddings)
SELECT vec_id, CASE k WHEN 0 THEN 'bad Point' ELSE 'bad Polygon' END AS problem FROM g WHERE abs(x) > 180 OR abs(y) > 90 OR k = 2 OR (k = 1 AND (abs(x + 1) > 180 OR abs(y + 1) > 90))""")
def gate_invalid_geometries(spark, sf_dir):
    """GeoJSON whose positions are out of range or whose rings are not closed."""
    places = load(spark, sf_dir, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double") * 900, 6).alias("x"), F.round(F.col("embedding")[1].cast("double") * 450, 6).alias("y"))
    at = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    ring = F.when(F.col("vec_id") % 3 == 1, F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 0))).otherwise(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)))
    point, polygon = F.struct(F.lit("Point").alias("type"), at(0, 0).alias("coordinates")), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    geometry = F.when(F.col("vec_id") % 3 == 0, F.to_json(point)).otherwise(F.to_json(polygon))
    return gt.invalid_geometries(places.select("vec_id", geometry.alias("geometry")), "vec_id", "geometry")


@Q.add("""
WITH c AS (SELECT lang AS dataset, count(*) AS n, count(*) FILTER (source IS NULL) AS x, count(DISTINCT source) AS i, count(source) AS w FROM documents WHERE lang IS NOT NULL GROUP BY 1),
     e(dataset, wanted) AS (VALUES ('en', 250), ('es', 1), ('xx', 7)), b AS (SELECT dataset, n, wanted, x, i, w FROM c FULL JOIN e USING (dataset))
SELECT dataset, 'another number of records' AS problem, coalesce(n, 0) AS n FROM b WHERE n IS DISTINCT FROM wanted UNION ALL SELECT dataset, 'records without an id', x FROM b WHERE x > 0 UNION ALL SELECT dataset, 'repeated ids', w - i FROM b WHERE i < w""")
def gate_content(spark, sf_dir):
    """Datasets with a fixed number of records and ids of their own."""
    docs = load(spark, sf_dir, "documents").where("lang IS NOT NULL").select("lang", "source")
    return gt.wrong_content(docs, "lang", "source", {"en": 250, "es": 1, "xx": 7})


@Q.add("""
SELECT conv_id, turn, '$/status' AS path, '[["metric_key","m' || conv_id % 3 || '"]]' AS context, '"' || role || '"' AS value FROM conversations WHERE role IS NOT NULL
UNION ALL SELECT conv_id, turn, '$/rows[]/unit_th', '[["metric_key","m' || conv_id % 3 || '"]]', '"turns"' FROM conversations WHERE turn % 2 = 0""")
def payload_meanings(spark, sf_dir):
    """What the payloads say of units and states, and of what, but not what they observe."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    row = F.struct(F.when(F.col("turn") % 2 == 0, "turns").alias("unitTh"), F.col("turn").alias("value"))
    payload = F.to_json(F.struct(F.col("role").alias("status"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")).alias("metricKey"), F.array(row, row).alias("rows")))
    return nd.meanings(nd.tree(turns.select("conv_id", "turn", payload.alias("payload")), "payload", ["conv_id", "turn"])).drop("rule")


@Q.add("""
WITH b AS (SELECT event_type AS dataset, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS a, max(CAST(value > 50 AS INT)) AS shape FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
     h AS (SELECT event_type AS dataset, count(*) AS n, strftime(max(ts), '%Y-%m-%d') AS a, max(CASE WHEN event_type = 'view' THEN 2 ELSE CAST(value > 50 AS INT) END) AS shape FROM events WHERE event_type <> 'error' AND event_id % 2 = 0 GROUP BY 1),
     j AS (SELECT dataset, b.n AS bn, h.n AS hn, b.a AS ba, h.a AS ha, b.shape AS bs, h.shape AS hs FROM b FULL JOIN h USING (dataset))
SELECT dataset, 'dataset is gone' AS problem FROM j WHERE hn IS NULL UNION ALL SELECT dataset, 'dataset is new' FROM j WHERE bn IS NULL UNION ALL SELECT dataset, 'rows fell' FROM j WHERE hn < bn * 0.9
UNION ALL SELECT dataset, 'rows rose' FROM j WHERE bn > 0 AND hn > bn * 2 UNION ALL SELECT dataset, 'as_of went back' FROM j WHERE ha < ba UNION ALL SELECT dataset, 'shape changed' FROM j WHERE bn IS NOT NULL AND hn IS NOT NULL AND bs IS DISTINCT FROM hs""")
def gate_release(spark, sf_dir):
    """Counts, dates and shapes of two releases of the events."""
    events = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("dataset"), "ts", (F.col("value") > 50).cast("int").alias("shape"))
    shape = lambda df: df.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("as_of"), F.max("shape").alias("shape"))
    head = events.where("dataset <> 'error' AND event_id % 2 = 0").withColumn("shape", F.when(F.col("dataset") == "view", 2).otherwise(F.col("shape")))
    return gt.drift(shape(events.where("event_id % 3 <> 0")), shape(head), "dataset", "as_of", 0.1, 1.0, ["shape"], True)


@Q.add("""
SELECT o_orderkey, o_orderstatus = 'P' OR starts_with(lower(o_orderpriority), 'do_not_call') OR (o_orderkey % 7 = 0) AS restricted FROM orders""")
def restricted_endpoints(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    policy = F.when(F.col("o_orderstatus") == "P", "restricted_local_only").otherwise("public")
    access = F.when(F.col("o_orderkey") % 7 == 0, "GET HTTP_403 last week")
    return orders.select("o_orderkey", restricted_endpoint(policy, access, F.col("o_orderpriority")).alias("restricted"))


@Q.add("""
WITH t AS (SELECT p_partkey, '[' || p_brand || '] ' || p_name AS label, p_size FROM part)
SELECT p_partkey, label, CAST(p_size AS VARCHAR) AS size, 'composite:' || sha256('["' || label || '",' || p_size || ']') AS record_id, NULL::VARCHAR AS nested FROM t""")
def typed_identities(spark, sf_dir):
    """Ids of payloads with numbers, and with texts that begin with a bracket."""
    from cadastra.functions import ids

    parts = load(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.concat(F.lit("["), "p_brand", F.lit("] "), "p_name").alias("label"), F.col("p_size").alias("size"), F.array("p_size").alias("nested"))).alias("payload"))
    return parts.select("p_partkey", ids.field("payload", "label").alias("label"), ids.field("payload", "size").alias("size"), ids.contract_id("payload", [["label", "size"]], F.lit("none")).alias("record_id"), ids.field("payload", "nested").alias("nested"))


def nation_documents(spark, sf_dir):
    """A document for each nation: its customers, three levels deep, and their orders."""
    orders = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    customers = load(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    placed = F.transform("keys", lambda k: F.struct(k.alias("id"), F.when(k % 50 == 0, F.lit("late")).alias("orderStatus")))
    one = F.struct(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("m"), F.col("c_custkey"))).alias("metricKey"), placed.alias("orders"))
    per = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(one)).alias("customers"))  # a row a nation
    payload = F.to_json(F.struct(F.concat(F.lit("n"), F.col("c_nationkey")).alias("source_id"), F.size("customers").alias("n"), "customers"))
    return per.select(F.col("c_nationkey").alias("nation"), payload.alias("payload"))


NATION_ORDERS = "c AS (SELECT c_nationkey AS nation, c_custkey AS key FROM customer), o AS (SELECT nation, key, o_orderkey AS id FROM c JOIN orders ON o_custkey = key)"


@Q.add(f"""
WITH {NATION_ORDERS}, l AS (SELECT nation, '$/customers[]/key' AS path, key AS v FROM c UNION ALL SELECT nation, '$/customers[]/orders[]/id', id FROM o UNION ALL SELECT nation, '$/n', count(*) FROM c GROUP BY 1)
SELECT nation, path, count(*) AS leaves, CAST(sum(v) AS BIGINT) AS total FROM l GROUP BY 1, 2
UNION ALL SELECT nation, '$/source_id', 1, NULL FROM c GROUP BY 1 UNION ALL SELECT nation, '$/customers[]/metricKey', count(*), NULL FROM c WHERE key % 9 = 0 GROUP BY 1
UNION ALL SELECT nation, '$/customers[]/orders[]/orderStatus', count(*), NULL FROM o WHERE id % 50 = 0 GROUP BY 1""")
def nested_leaves(spark, sf_dir):
    """The scalars of documents three levels deep, counted and summed by path."""
    leaves = nd.leaves(nd.tree(nation_documents(spark, sf_dir), "payload", ["nation"], context=False))
    return leaves.groupBy("nation", "path").agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.col("value").try_cast("long")).alias("total"))


@Q.add(f"""
WITH {NATION_ORDERS}, l AS (
 SELECT nation, unnest(['$:object', '$/source_id:string', '$/n:integer', '$/customers:array', '$/customers[]:object', '$/customers[]/key:integer']) AS line FROM c
 UNION ALL SELECT nation, '$/customers[]/metricKey:string' FROM c WHERE key % 9 = 0 UNION ALL SELECT nation, '$/customers[]/orders[]/orderStatus:string' FROM o WHERE id % 50 = 0
 UNION ALL SELECT nation, unnest(['$/customers[]/orders:array', '$/customers[]/orders[]:object', '$/customers[]/orders[]/id:integer']) FROM o)
SELECT nation, sha256(string_agg(line, chr(10) ORDER BY line)) AS shape FROM (SELECT DISTINCT * FROM l) GROUP BY 1""")
def nested_shapes(spark, sf_dir):
    return nd.shapes(nd.tree(nation_documents(spark, sf_dir), "payload", ["nation"], context=False)).drop("problem")


@Q.add("SELECT c_nationkey AS nation, 'root.customers' AS path, count(*) AS records, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1")
def nested_records(spark, sf_dir):
    """Customers are the nearest list of objects; their orders stay within them."""
    found = nd.records(nd.tree(nation_documents(spark, sf_dir), "payload", ["nation"], context=False))
    return found.groupBy("nation", "path").agg(F.count(F.lit(1)).alias("records"), F.sum(F.get_json_object("record", "$.key").cast("long")).alias("keys"))


@Q.add(f"""
WITH {NATION_ORDERS}
SELECT DISTINCT nation, '$/customers[]/orders[]/order_status' AS path, '[["' || CASE WHEN key % 9 = 0 THEN 'metric_key","m' || key ELSE 'source_id","n' || nation END || '"]]' AS context, '"late"' AS value FROM o WHERE id % 50 = 0""")
def nested_meanings(spark, sf_dir):
    """States of orders, which speak of their customer's metric or else of the whole document's source."""
    return nd.meanings(nd.tree(nation_documents(spark, sf_dir), "payload", ["nation"])).drop("rule")


@Q.add("""
SELECT page_id, '$/groups[]/pages[]/' || CASE page_id % 2 WHEN 0 THEN 'url' ELSE 'links[]' END AS path, CASE page_id % 3 WHEN 0 THEN 's0' WHEN 1 THEN 'inner' ELSE 'named,twice' END AS sources, url FROM pages WHERE url IS NOT NULL
UNION ALL SELECT page_id, '$/sources/declared/home_url', 'declared', url FROM pages WHERE url IS NOT NULL""")
def nested_sources(spark, sf_dir):
    """Addresses within documents with the sources that the nearest object around names, up to two levels above."""
    pages = load(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", "url")
    page = F.struct(F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 2 == 1, F.array("url")).alias("links"))
    group = F.struct(F.when(F.col("page_id") % 3 == 1, "inner").alias("sourceId"), F.when(F.col("page_id") % 3 == 2, F.array(F.lit("twice"), F.lit("named"), F.lit("twice"))).alias("source_ids"), F.array(page).alias("pages"))
    home = F.struct(F.struct(F.col("url").alias("home_url")).alias("declared"))
    payload = F.to_json(F.struct(F.lit("s0").alias("source_id"), F.array(group).alias("groups"), home.alias("sources")))
    found = nd.sourced_urls(nd.tree(pages.select("page_id", payload.alias("payload")), "payload", ["page_id"]), ["declared"])
    return found.withColumn("sources", F.array_join("sources", ","))


@Q.add("""
WITH g AS (SELECT vec_id, round(embedding[1]::DOUBLE * 900, 6) AS x, round(embedding[2]::DOUBLE * 450, 6) AS y FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'not JSON' WHEN vec_id % 5 = 0 THEN 'unknown type' ELSE 'bad MultiPoint' END AS problem FROM g WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR abs(x) > 180 OR abs(y) > 90""")
def gate_nested_geometries(spark, sf_dir):
    """Collections within collections: what is wrong is two levels down, or the text is cut off."""
    points = load(spark, sf_dir, "embeddings").select("vec_id", F.array(F.round(F.col("embedding")[0].cast("double") * 900, 6), F.round(F.col("embedding")[1].cast("double") * 450, 6)).alias("at"))
    inner = F.struct(F.when(F.col("vec_id") % 5 == 0, "Cloud").otherwise("MultiPoint").alias("type"), F.array("at").alias("coordinates"))
    within = F.struct(F.lit("GeometryCollection").alias("type"), F.array(inner).alias("geometries"))
    text = F.to_json(F.struct(F.lit("GeometryCollection").alias("type"), F.array(within).alias("geometries")))
    text = F.when(F.col("vec_id") % 7 == 0, F.left(text, F.length(text) - 1)).otherwise(text)
    return gt.invalid_geometries(points.select("vec_id", text.alias("geometry")), "vec_id", "geometry")


QUERIES, ORACLE_SQL = Q.found, Q.sql
