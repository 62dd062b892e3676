"""Queries over texts, JSON payloads, pages and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastra.functions import ids
from cadastra.functions import text as tx
from cadastra.functions.codes import area_code
from cadastra.functions.numbers import shown, strict_double
from cadastra.operators import joins as jn
from cadastra.operators import nested as ns
from cadastra.operators import nodes as nd
from cadastra.plans.queries import Queries
from cadastra.session import load
from cadastra.sources import readers as rd

Q = Queries()
# A fixed value: the e-mail pattern of the published rules.
EMAIL_SQL = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"

# The survey rule for phone numbers as a test of whether there is one: what may not stand beside it is matched instead of looked at.
PHONE_SQL = r"(?:^|[^0-9A-Za-z])(?:\+?66|0)[\s\x0B]*\d(?:[\s\x0B().-]*\d){7,9}(?:[^0-9]|$)"


@Q.add(f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL_SQL}', '[redacted-email]', 'g')) AS digest, regexp_matches(text, '{EMAIL_SQL}') AS had_email FROM documents")
def redacted_emails(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    clean = F.when(F.contains("text", F.lit("@")), tx.redact_emails("text")).otherwise(F.col("text"))  # most texts need no pattern
    return docs.withColumn("clean", clean).select("doc_id", F.sha2("clean", 256).alias("digest"), (F.col("clean") != F.col("text")).alias("had_email"))


@Q.add()
def redacted_phones(spark, sf_dir):
    """Numbers of each of the three phone rules in every document; the rules use look-around, which the oracle lacks."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return docs.select("doc_id", count(tx.PHONE_RECORDS).alias("records"), count(tx.PHONE_SURVEY).alias("survey"), count(tx.PHONE_RELEASE).alias("release"), F.sha2(tx.redact("text"), 256).alias("digest"))


@Q.add(f"SELECT doc_id, 'text' AS column FROM documents WHERE regexp_matches(text, '{EMAIL_SQL}') OR regexp_matches(text, '{PHONE_SQL}')")
def gate_contact_documents(spark, sf_dir):
    from cadastra.operators.gates import contact_values

    return contact_values(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"])


@Q.add(f"SELECT conv_id, turn, 'text' AS column FROM conversations WHERE regexp_matches(text, '{EMAIL_SQL}') OR regexp_matches(text, '{PHONE_SQL}')")
def gate_contact_values(spark, sf_dir):
    from cadastra.operators.gates import contact_values

    turns = load(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text")
    return contact_values(turns, "key", ["text"]).select("key.conv_id", "key.turn", "column")


@Q.add()
def public_descriptions(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.sha2(F.coalesce(tx.without_contact_clauses("text"), F.lit("")), 256).alias("digest"))


@Q.add("SELECT doc_id, CASE WHEN length(c) > 180 THEN rtrim(substr(c, 1, 179)) || '…' ELSE c END AS label FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS c FROM documents)")
def shortened_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", tx.shortened("text").alias("label"))


@Q.add("""
SELECT p_partkey, trim(regexp_replace(lower(regexp_replace(p_name || p_type, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^a-z0-9ก-๙]+', '_', 'g'), '_') AS key,
       upper(p_name) || '|' || p_size AS label, format('{:,.2f}', p_retailprice) || ' THB' AS price FROM part""")
def keys_and_labels(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return parts.select("p_partkey", tx.snake_key(F.concat("p_name", "p_type")).alias("key"), F.concat_ws("|", F.upper("p_name"), F.col("p_size").cast("string")).alias("label"), shown("p_retailprice", 2, " THB").alias("price"))


@Q.add("""
SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS stable, 'composite:' || sha256('[' || o_custkey || ',"' || o_orderpriority || '"]') AS composite,
       lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS code FROM orders""")
def record_identities(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", ids.stable_hash(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("stable"), ids.composite_id(F.col("o_custkey"), F.col("o_orderpriority")).alias("composite"), area_code(F.col("o_custkey") % 100).alias("code"))


@Q.add("SELECT event_id, CASE WHEN try_cast(props->>'$.k' AS BIGINT) IS NULL THEN 'none' ELSE props->>'$.k' END AS record_id, sha256(props->>'$.k') AS digest, try_cast(props->>'$.k' AS DOUBLE) AS k FROM events")
def payload_identities(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", ids.contract_id("props", [["missing"], ["k"]], F.lit("none")).alias("record_id"), F.sha2(ids.field("props", "k"), 256).alias("digest"), strict_double(ids.field("props", "k")).alias("k"))


@Q.add("SELECT event_id, '$/' || key AS path, props->>('$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def payload_leaves(spark, sf_dir):
    return nd.leaves(nd.tree(load(spark, sf_dir, "events"), "props", ["event_id"], context=False))


@Q.add("""
WITH e AS (SELECT event_id, event_type, props, unnest(json_keys(props)) AS k FROM events),
     l AS (SELECT event_id, '$:object' AS line FROM events UNION ALL
           SELECT event_id, '$/' || k || ':' || CASE json_type(props, '$."' || k || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number'
                  WHEN 'NULL' THEN 'null' ELSE 'integer' END FROM e),
     h AS (SELECT event_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS shape FROM (SELECT DISTINCT * FROM l) GROUP BY 1)
SELECT event_type, shape, count(*) AS payloads FROM events JOIN h USING (event_id) GROUP BY 1, 2""")
def payload_shapes(spark, sf_dir):
    """How many payloads have each shape: the hash of all paths and kinds."""
    shapes = nd.shapes(nd.tree(load(spark, sf_dir, "events"), "props", ["event_type"], context=False)).where("shape IS NOT NULL")
    return shapes.groupBy("event_type", "shape").agg(F.count(F.lit(1)).alias("payloads"))


@Q.add("SELECT event_id, 'root' AS path, regexp_replace(props, '\\s', '', 'g') AS record FROM events")
def payload_records(spark, sf_dir):
    return nd.records(nd.tree(load(spark, sf_dir, "events"), "props", ["event_id"], context=False))


@Q.add()
def payload_sanitised(spark, sf_dir):
    """Payloads that carry a text each, sanitised."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text", F.col("conv_id").alias("contactName"))).alias("payload"))
    return nd.sanitised(turns, "payload", ["conv_id", "turn"]).withColumnRenamed("json", "clean")


@Q.add(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']?[^"''\s>]+["'']?[^>]*>.*?</a>') AS found FROM pages),
     l AS (SELECT page_id, unnest(found) AS a, generate_subscripts(found, 1) - 1 AS pos FROM a)
SELECT page_id, pos::INTEGER AS pos, regexp_extract(a, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href,
       substr(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')), 1, 200) AS link_text FROM l""")
def page_links(spark, sf_dir):
    return rd.links(load(spark, sf_dir, "pages").select("page_id", "html"))


@Q.add("""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
     r AS (SELECT o AS rule_origin, '/' || l AS rule_path, o || l AS source_id, l = 'fr' AS denied FROM (SELECT DISTINCT origin AS o FROM p WHERE origin LIKE '%.org'), (VALUES ('en'), ('fr'), ('en/6')) v(l)),
     b AS (SELECT origin, path, rule_path, source_id, denied FROM (SELECT DISTINCT origin, path FROM p) JOIN r ON origin = rule_origin AND (rtrim(path, '/') = rule_path OR starts_with(path, rule_path || '/'))
           QUALIFY row_number() OVER (PARTITION BY origin, path ORDER BY rtrim(path, '/') = rule_path DESC, length(rule_path) DESC, source_id) = 1)
SELECT page_id, url, rule_path, source_id, denied FROM p LEFT JOIN b USING (origin, path)""")
def url_rules(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "url", F.lower(F.regexp_extract("url", "^([a-zA-Z]+://[^/?#]*)", 1)).alias("origin"), F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    kinds = spark.createDataFrame([("en",), ("fr",), ("en/6",)], "l string")
    rules = pages.where(F.col("origin").endswith(".org")).select(F.col("origin").alias("rule_origin")).distinct().join(F.broadcast(kinds))
    rules = rules.select("rule_origin", F.concat(F.lit("/"), "l").alias("rule_path"), F.concat("rule_origin", "l").alias("source_id"), (F.col("l") == "fr").alias("denied"))
    return jn.by_prefix(pages, rules).select("page_id", "url", "rule_path", "source_id", "denied")


@Q.add(r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:@]*)', 1)) AS host,
                  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query FROM pages)
SELECT page_id, url, scheme || '://' || host || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END AS canonical FROM p""")
def canonical_urls(spark, sf_dir):
    """Addresses in one form; the oracle's SQL is for those without escapes, ports and user names, as the given pages have."""
    return ns.map_column(load(spark, sf_dir, "pages").select("page_id", "url"), "url", "canonical", ns.canonical_url)


@Q.add("SELECT lang, count(*) AS rows, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def database_coverage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"))


QUERIES, ORACLE_SQL = Q.found, Q.sql
