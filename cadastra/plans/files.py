"""Queries over files that Spark writes from the given tables and reads back: each file with its own header, rows in their order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cadastra.operators import gates as gt
from cadastra.operators import versions as vs
from cadastra.operators.ranking import ranked
from cadastra.operators.releases import release_problems
from cadastra.operators.sync import sync_layers, unseen
from cadastra.plans.queries import Queries
from cadastra.scratch import shared_folder
from cadastra.session import load
from cadastra.sources import delimited as dl
from cadastra.sources.readers import read_json_lines

Q = Queries()

PLAIN = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": ""}


#: Whole lines as one column: nothing in them is quoted.
LINES = PLAIN | {"sep": "\u0001"}


def _folder(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@Q.add("""
SELECT CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS part, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text,
       CASE WHEN lang = 'en' THEN NULL ELSE coalesce(source, '') END AS source, CASE WHEN lang = 'en' THEN CAST(n_chars AS VARCHAR) END AS n_chars
FROM documents""")
def csv_files_by_name(spark, sf_dir):
    """Files of two orders and sets of columns, with line breaks and quotes in their cells, as one table by name."""
    docs, folder = load(spark, sf_dir, "documents"), _folder(spark, "by-name")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    docs.where(english).select("doc_id", "text", "n_chars").write.options(**PLAIN).csv(f"{folder}/first")
    docs.where(~english).select("source", "text", "doc_id").write.options(**PLAIN).csv(f"{folder}/second")
    rows = dl.read_by_name(spark, [f"{folder}/first", f"{folder}/second"], ["doc_id", "text", "source", "n_chars"])
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("part"), "doc_id", "text", "source", "n_chars")


@Q.add("""
SELECT 'loose' AS part, CAST(doc_id AS VARCHAR) AS id, 'extra cells' AS problem FROM documents WHERE contains(text, ',')
UNION ALL SELECT 'short', CAST(event_id AS VARCHAR), 'missing cells' FROM events WHERE value < 50""")
def gate_csv_rows(spark, sf_dir):
    """Rows with more or fewer cells than their own file's header: texts that were written without quotes, and rows cut short."""
    folder = _folder(spark, "ragged")
    text = F.regexp_replace("text", r"[\r\n\"]", " ")
    load(spark, sf_dir, "documents").select(F.concat_ws(",", "doc_id", text).alias("doc_id,text")).write.options(**LINES).csv(f"{folder}/loose")
    row = F.concat_ws(",", "event_id", F.when(F.col("value") < 50, None).otherwise(F.col("event_type")))
    load(spark, sf_dir, "events").select(row.alias("event_id,event_type")).write.options(**LINES).csv(f"{folder}/short")
    rows = dl.read_cells(spark, [f"{folder}/loose", f"{folder}/short"]).select("*", F.element_at(F.split("path", "/"), -2).alias("part"), F.get("cells", F.lit(0)).alias("id"))
    return gt.ragged_files(rows, ["part", "id"]).select("part", "id", "problem")


@Q.add("""
SELECT 'other' AS part, 'other names' AS problem, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' HAVING count(*) > 0
UNION ALL SELECT 'twice', 'repeated name', count(*) FROM customer HAVING count(*) > 0""")
def gate_csv_headers(spark, sf_dir):
    """Rows in files whose own header repeats a name or is not the expected one."""
    orders, folder = load(spark, sf_dir, "orders"), _folder(spark, "headers")
    orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").write.options(**PLAIN).csv(f"{folder}/fine")
    orders.where("o_orderstatus <> 'F'").select("o_orderdate", "o_orderkey").write.options(**PLAIN).csv(f"{folder}/other")
    load(spark, sf_dir, "customer").select(F.concat_ws(",", "c_custkey", "c_name").alias("name,name")).write.options(**LINES).csv(f"{folder}/twice")
    rows = dl.read_cells(spark, [f"{folder}/{p}" for p in ("fine", "other", "twice")])
    files = rows.groupBy("path", "header").agg(F.count(F.lit(1)).alias("n"))
    found = gt.wrong_headers(files, ["o_orderkey", "o_orderdate"]).join(files.select("path", "n"), "path")
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("part"), "problem").agg(F.sum("n").alias("n"))


@Q.add("""
SELECT event_type, user_id, n, place FROM (
  SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, CAST(count(*) AS BIGINT) AS n,
         CAST(row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min(event_id)) AS INTEGER) AS place
  FROM events GROUP BY event_type, user_id) WHERE place <= 5""")
def first_appearances(spark, sf_dir):
    """The five users with most rows of each type in files of events; of equal counts, those that appear first in the files."""
    folder = _folder(spark, "ordered")
    load(spark, sf_dir, "events").orderBy("event_id").select("user_id", "event_type").write.options(**PLAIN).csv(folder)
    rows = dl.read_by_name(spark, folder, ["user_id", "event_type"])
    counts = rows.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "_ordinal")).alias("_first"))
    return ranked(counts, ["event_type"], F.desc("n"), "_first", k=5, name="place").drop("_first")


@Q.add("""
WITH old AS (SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events WHERE length(event_type) % 2 = 0 OR (value < 100 AND event_type <> (SELECT max(event_type) FROM events)) GROUP BY event_type),
new AS (SELECT event_type, count(*) AS n, sum(event_id) AS ids FROM events WHERE event_type IS NOT NULL GROUP BY event_type),
log AS (SELECT new.event_type, CASE WHEN old.event_type IS NULL THEN 'inserted' WHEN old.n = new.n AND old.ids = new.ids THEN 'unchanged' ELSE 'replaced' END AS action, CAST(new.n AS BIGINT) AS expected FROM new LEFT JOIN old USING (event_type))
SELECT event_type, action, expected, CASE WHEN action = 'unchanged' THEN 0 ELSE expected END AS loaded, expected AS stored FROM log""")
def layers_replaced(spark, sf_dir):
    """Kinds of events as layers of a table, loaded in part and then whole: what became of each, and the rows it has then."""
    events, path = load(spark, sf_dir, "events").where("event_type IS NOT NULL").select("event_type", "event_id", "value"), _folder(spark, "layers")
    last = events.agg(F.max("event_type").alias("_last"))
    before = events.join(F.broadcast(last)).where("length(event_type) % 2 = 0 OR (value < 100 AND event_type <> _last)").drop("_last")  # one row
    snapshot = lambda df: df.groupBy("event_type").agg(F.sum("event_id").cast("string").alias("content_hash"), F.count(F.lit(1)).alias("feature_count"))
    sync_layers(None, snapshot(before), before, path, "event_type", "event_id")
    log = sync_layers(snapshot(before), snapshot(events), events, path, "event_type", "event_id")
    stored = spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("stored"))
    return log.join(stored, "event_type")


@Q.add("""
WITH o AS (SELECT o_orderpriority AS artifact, left(o_orderpriority, 1) AS k, * FROM orders),
per AS (SELECT artifact, max(k) AS k, count(*) AS n, count(*) FILTER (o_orderkey % 4 = 0) AS gone, count(*) FILTER (o_orderstatus = 'P') AS reworded,
               count(*) FILTER (o_totalprice > 100000) AS back, count(*) FILTER (o_custkey % 10 = 0) AS reshaped FROM o GROUP BY artifact)
SELECT artifact, 'meaning changed' AS problem FROM per WHERE k = '2' AND reworded > 0
UNION ALL SELECT artifact, 'a record''s time went back' FROM per WHERE k = '3' AND back > 0
UNION ALL SELECT artifact, CASE WHEN gone = n THEN 'artifact is gone' ELSE 'rows fell' END FROM per WHERE k = '4' AND gone / n > 0.1
UNION ALL SELECT artifact, 'identities churned' FROM per WHERE k = '4' AND gone < n AND gone / n > 0.2
UNION ALL SELECT artifact, 'shape changed' FROM per WHERE k = '5' AND reshaped > 0""")
def release_records(spark, sf_dir):
    """Two releases of orders, an artifact a priority, written as JSON lines, read back and compared record by record."""
    orders, folder = load(spark, sf_dir, "orders").withColumn("k", F.substring("o_orderpriority", 1, 1)), _folder(spark, "releases")

    def release(name, rows, status, day, note):
        payload = F.to_json(F.struct(status.alias("status"), F.struct(F.date_format(day, "yyyy-MM-dd").alias("asOf"), F.col("o_totalprice").alias("price")).alias("terms"), note.alias("note")))
        record = F.struct(F.col("o_orderpriority").alias("artifact"), F.col("o_orderkey").alias("record"), payload.alias("payload"))
        rows.select(F.to_json(record).alias("value")).write.text(f"{folder}/{name}")
        return read_json_lines(spark, f"{folder}/{name}").select(F.from_json("payload", "artifact string, record string, payload string").alias("r")).select("r.*")

    status, day, none = F.col("o_orderstatus"), F.col("o_orderdate"), F.lit(None).cast("string")
    base = release("base", orders, status, day, none)
    head = release(
        "head", orders.where("NOT (k = '4' AND o_orderkey % 4 = 0)"), F.when((F.col("k") == "2") & (status == "P"), "X").otherwise(status),
        F.when((F.col("k") == "3") & (F.col("o_totalprice") > 100000), F.date_sub(day, 1)).otherwise(F.to_date(day)), F.when((F.col("k") == "5") & (F.col("o_custkey") % 10 == 0), "new"),
    )
    contracts = orders.select(F.col("o_orderpriority").alias("artifact"), F.lit(0.1).alias("fall"), F.lit(1.0).alias("rise"), F.lit(0.2).alias("churn")).distinct()
    return release_problems(base, head, contracts)


@Q.add("""
WITH v AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS since FROM orders),
n AS (SELECT CAST(1 AS BIGINT) AS version UNION ALL SELECT 2 UNION ALL SELECT 3)
SELECT version, status, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN since = version THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(min(k) AS BIGINT) AS first_key
FROM n JOIN v ON since <= version AND (version < 3 OR status <> 'P') GROUP BY version, status""")
def versioned_orders(spark, sf_dir):
    """Orders in versions of a table: some, all (twice, which adds none), then without those pending; what each version has and what it added."""
    table, schema = _folder(spark, "versions"), "k long, status string"
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderstatus").alias("status"))
    for batch in (orders.where("status = 'F'"), orders, orders):
        vs.update(spark, table, schema, lambda old, batch=batch: unseen(batch, old, ["k"], "status"), keep=True)
    vs.update(spark, table, schema, lambda old: old.where("status <> 'P'"))
    each = [vs.read(spark, table, schema, v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2, 3)]
    seen = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("k", "status").agg(F.min("version").alias("since"), F.collect_list("version").alias("versions"))
    rows = seen.select("k", "status", "since", F.explode("versions").alias("version"))
    return rows.groupBy("version", "status").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("since") == F.col("version")).cast("long")).alias("added"), F.min("k").alias("first_key"))


QUERIES, ORACLE_SQL = Q.found, Q.sql
