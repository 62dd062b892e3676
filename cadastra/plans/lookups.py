"""Queries that look things up: pointers, times of records, identities, files by pattern, rules of addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import ids
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn
from cadastra.operators import nodes as nd
from cadastra.plans.queries import Queries
from cadastra.session import load

Q = Queries()


@Q.add("SELECT p_partkey, CAST(p_size AS VARCHAR) AS by_key, p_brand AS within_list, CAST(p_size + 1 AS VARCHAR) AS by_place, NULL::VARCHAR AS beyond FROM part")
def pointed_values(spark, sf_dir):
    """Pointers whose numbers are keys of objects in one step and places in lists in another."""
    items = F.concat(F.lit("["), F.col("p_size") + 1, F.lit(","), F.to_json(F.struct(F.col("p_brand").alias("0"))), F.lit("]"))
    payload = F.concat(F.lit('{"2024":'), F.to_json(F.struct(F.col("p_size").alias("a"))), F.lit(',"list":'), items, F.lit("}"))
    found = {"by_key": "/2024/a", "within_list": "/list/1/0", "by_place": "/list/0", "beyond": "/list/2"}
    return load(spark, sf_dir, "part").select("p_partkey", payload.alias("payload")).select("p_partkey", *(ids.pointer("payload", p).alias(n) for n, p in found.items()))


@Q.add("SELECT o_orderkey, '$/parts[1]/observed_as_of' AS path, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders UNION ALL SELECT o_orderkey, '$/as_of', '2569' FROM orders WHERE o_orderkey % 4 = 0")
def nested_times(spark, sf_dir):
    """As of when records hold, at any depth; times of fetching are none."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    part = lambda seen: F.struct(F.when(F.lit(seen), day).alias("observedAsOf"), day.alias("fetched_at"), day.alias("updated_at"))
    payload = F.to_json(F.struct(F.when(F.col("o_orderkey") % 4 == 0, "2569").alias("as_of"), F.array(part(False), part(True)).alias("parts")))
    return nd.times(nd.tree(load(spark, sf_dir, "orders").select("o_orderkey", payload.alias("payload")), "payload", ["o_orderkey"], context=False))


@Q.add("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no identity' ELSE 'identity too long' END AS problem FROM part WHERE p_size % 5 = 0 OR length(p_brand) * p_size > 200""")
def gate_identities(spark, sf_dir):
    """Records to which their contract gives no id, or one of over 200 characters."""
    code = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.repeat("p_brand", F.col("p_size")))
    parts = load(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.struct(code.alias("code")).alias("own"))).alias("payload"))
    return gt.unidentified(parts, "p_partkey", "payload", [["missing", "own.code"], ["own.code"]], F.lit("none"))


@Q.add(r"""
WITH p AS (SELECT DISTINCT 'data/' || source || '/' || lang || '.json' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
     o(selector, pat) AS (VALUES ('data/src[!0-1]/[d-f]*.json', '^data/src[^0-1]/[d-f].*\.json$'), ('data/src[0-1]/[!e]?.json', '^data/src[0-1]/[^e].\.json$'), ('data/src1/e[sn].json', '^data/src1/e[sn]\.json$'), ('data/[?]/[*]', '^data/\?/\*$'), ('[', '^\[$')),
     m AS (SELECT path, selector FROM p JOIN o ON regexp_matches(path, pat)), c AS (SELECT path, count(*) AS n FROM m GROUP BY 1)
SELECT p.path, m.selector, CASE WHEN c.n IS NULL THEN 'no contract' WHEN c.n > 1 THEN 'several contracts' END AS problem FROM p LEFT JOIN m ON m.path = p.path LEFT JOIN c ON c.path = p.path
UNION ALL SELECT NULL, selector, 'fits no file' FROM o WHERE selector NOT IN (SELECT selector FROM m)""")
def gate_files_by_sets(spark, sf_dir):
    """Files by patterns with sets, ranges, and brackets that nothing closes."""
    paths = load(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat(F.lit("data/"), "source", F.lit("/"), "lang", F.lit(".json")).alias("path")).distinct()
    selectors = ["data/src[!0-1]/[d-f]*.json", "data/src[0-1]/[!e]?.json", "data/src1/e[sn].json", "data/[?]/[*]", "["]
    return jn.bind_globs(paths, spark.createDataFrame([(s, False, None) for s in selectors], "selector string, exact boolean, expected_files int"))


@Q.add("""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, 'v=' || page_id % 3 AS query FROM pages WHERE url IS NOT NULL),
     r AS (SELECT origin AS o, '/' AS rp, '' AS rq, FALSE AS exact, 'root' AS source_id FROM p WHERE origin LIKE '%.org' GROUP BY 1 UNION ALL SELECT origin, '/en', 'v=1', FALSE, 'queried' FROM p GROUP BY 1
           UNION ALL SELECT origin, '/en', '', FALSE, 'plain' FROM p WHERE origin LIKE '%.net' GROUP BY 1 UNION ALL SELECT DISTINCT origin, path, query, TRUE, 'exact' FROM p WHERE page_id % 5 = 0),
     b AS (SELECT origin, path, query, rp, source_id FROM (SELECT DISTINCT origin, path, query FROM p) JOIN r ON origin = o
             AND CASE WHEN exact THEN path = rp AND query = rq ELSE (rp = '/' OR path = rp OR starts_with(path, rp || '/')) AND (rq = '' OR rq = query) END
           QUALIFY row_number() OVER (PARTITION BY origin, path, query ORDER BY exact DESC, length(rp) DESC, length(rq) DESC, source_id) = 1)
SELECT page_id, rp AS rule_path, source_id FROM p LEFT JOIN b USING (origin, path, query)""")
def url_rules_by_query(spark, sf_dir):
    """Rules for whole origins, for paths with one query alone, and for exact addresses."""
    pages = load(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1)).alias("origin"), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.concat(F.lit("v="), F.col("page_id") % 3).alias("query"))

    def rules(where, path, query, exact, source):
        return pages.where(where).select(F.col("origin").alias("rule_origin"), path.alias("rule_path"), query.alias("rule_query"), F.lit(exact).alias("exact"), F.lit(source).alias("source_id"), F.lit(False).alias("denied")).distinct()

    of_host = rules("origin LIKE '%.org'", F.lit("/"), F.lit(""), False, "root").unionByName(rules("origin LIKE '%.net'", F.lit("/en"), F.lit(""), False, "plain"))
    every = of_host.unionByName(rules("true", F.lit("/en"), F.lit("v=1"), False, "queried")).unionByName(rules("page_id % 5 = 0", F.col("path"), F.col("query"), True, "exact"))
    return jn.by_prefix(pages, every, query="query").select("page_id", "rule_path", "source_id")


QUERIES, ORACLE_SQL = Q.found, Q.sql
