"""Operators on golden inputs, and gates on inputs with one thing wrong."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from cadastra.operators import aggregates as ag
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn
from cadastra.operators import nested as ns
from cadastra.operators import ranking as rk
from cadastra.operators import sync as sy
from cadastra.operators.history import station_history
from cadastra.sources import readers as rd
from cadastra.sources import writers as wr
from cadastra.streaming.history import new_versions, windowed_history


def day(text):
    return dt.datetime.fromisoformat(text)


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def readings(spark):
    data = [("Y.15", "water", "2026-06-01", 10.0), ("Y.15", "water", "2026-06-02", 12.0), ("Y.15", "water", "2026-07-01", 14.0), ("R", "rain", "2026-06-01", 2.0), ("R", "rain", "2026-06-02", 3.0), ("R", "rain", "2026-06-09", 5.0), ("Y.16", "water", "2026-06-01", None)]
    return spark.createDataFrame([(s, m, day(t), v) for s, m, t, v in data], "station string, metric string, ts timestamp_ntz, value double")


def test_history(readings):
    assert rows(station_history(readings, "water", "monthly")) == {("Y.15", "2026-06", 11.0, 2), ("Y.15", "2026-07", 14.0, 1)}
    assert {r[2] for r in rows(station_history(readings, "water", "daily"))} == {10.0, 12.0, 14.0}
    assert sorted(r[2] for r in rows(station_history(readings, "rain", "weekly", additive=True))) == [5.0, 5.0]
    assert rows(station_history(readings, "none", "daily")) == set()
    with pytest.raises(ValueError):
        station_history(readings, "water", "daily", days=10)


def test_history_window_edge(spark):
    data = [("a", "m", day("2026-01-31T12:00"), 1.0), ("a", "m", day("2026-01-01T12:00"), 2.0), ("a", "m", day("2026-01-01T11:59"), 9.0)]
    df = spark.createDataFrame(data, "station string, metric string, ts timestamp_ntz, value double")
    assert sum(r[3] for r in rows(station_history(df, "m", "daily", 30))) == 2


def test_median_comparison(spark):
    values = spark.createDataFrame([("a", "x", 90.0), ("b", "x", 100.0), ("c", "x", 150.0), ("d", "x", None), ("a", "y", 0.0), ("b", "y", 0.0)], "area string, metric string, value double")
    got = {(r["area"], r["metric"]): r for r in ag.against_median(values, ag.benchmark(values), concern=F.lit("high")).collect()}
    assert got["a", "x"]["relation"] == "near" and got["a", "x"]["position_pct"] == 0.0 and not got["a", "x"]["attention"]
    assert got["c", "x"]["relation"] == "above" and got["c", "x"]["attention_strength"] == 0.5 and got["c", "x"]["position_pct"] == 100.0
    assert got["a", "y"]["position_pct"] == 50.0 and ("d", "x") not in got


def test_distribution_ties_by_first_appearance(spark):
    items = spark.createDataFrame([(1, "b"), (2, "a"), (3, " a "), (4, "b"), (5, ""), (6, None), (7, r"\N"), (8, "c")], "id int, label string")
    assert [(r["label"], r["value"], r["share_pct"]) for r in ag.distribution(items, "label", "id", 2).orderBy("rank").collect()] == [("b", 2, 40.0), ("a", 2, 40.0)]
    assert [tuple(r) for r in ag.commonest(items, "label", 2).collect()] == [("b", 2), (" a ", 1)]
    assert rows(ag.tally(items, "label", "?")) == {("b", 2), ("a", 1), (" a ", 1), ("?", 2), (r"\N", 1), ("c", 1)}


def test_index_and_shares(spark):
    df = spark.createDataFrame([("a", 4.0), ("b", 1.0), ("c", None)], "n string, v double")
    assert {(r["n"], r["v_index"]) for r in ag.to_index(df, ["v"]).collect()} == {("a", 1.0), ("b", 0.25), ("c", 0.0)}
    assert {(r["n"], r["share"]) for r in ag.shares(df, "n", "v").where("share IS NOT NULL").collect()} == {("a", 0.8), ("b", 0.2)}
    zero = spark.createDataFrame([("a", 0.0)], "n string, v double")
    assert ag.shares(zero, "n", "v").first()["share"] == 0.0 and ag.to_index(zero, ["v"]).first()["v_index"] == 0.0


def test_region_rollup(spark):
    df = spark.createDataFrame([("r", "a", 3.0, 1.0, 2.0), ("r", "b", 1.0, 3.0, 4.0), ("r", "c", None, 5.0, 0.0), ("s", "d", None, 1.0, 1.0)], "region string, name string, v double, lon double, lat double")
    got = {r["region"]: r for r in ag.region_rollup(df, "region", "name", "v", "lon", "lat").collect()}
    assert (got["r"]["areas"], got["r"]["with_value"], got["r"]["least_area"], got["r"]["center_lon"], got["r"]["min_lat"]) == (3, 2, "b", 3.0, 0.0)
    assert got["s"]["least"] is None and got["s"]["least_area"] is None


def test_provisional_groups(spark):
    df = spark.createDataFrame([("p", "2569", None, "b1", "d1", "s2", "2026-01-01"), (" p ", "2569", "", "b1", "d1", "s1", "2026-02-01"), ("p", "2570", "u", "b2", "d2", None, None)], "project string, year string, unit string, business string, district string, subdistrict string, updated string")
    got = {r["year"]: r for r in ag.provisional_groups(df, ["project", "year", "unit"], "?", "x", "business", "district", "subdistrict", "updated").collect()}
    assert got["2569"]["participants"] == 2 and got["2569"]["businesses"] == 1 and got["2569"]["unit"] == "?" and got["2569"]["latest_update"] == "2026-02-01"
    assert [(d["district"], d["subdistricts"]) for d in got["2569"]["districts"]] == [("d1", ["s1", "s2"])]


def test_area_resolution(spark):
    areas = spark.createDataFrame([("53", "North"), ("60", "South")], "area_code string, area_name string")
    records = spark.createDataFrame([(1, "53", None), (2, "99", "North"), (3, None, " South "), (4, r"\N", "?"), (5, None, None)], "id int, code string, name string")
    assert {(r["id"], r["area_code"], r["unmapped_reason"]) for r in jn.resolve_area(records, areas, ["code"], ["name"]).collect()} == {(1, "53", None), (2, None, "unknown_code"), (3, "60", None), (4, None, "unknown_name"), (5, None, "no_area")}


def test_joins(spark):
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    records = spark.createDataFrame([("a",), ("a",), ("c",)], "source_id string")
    assert rows(jn.with_counts(sources, records, "source_id")) == {("a", 2), ("b", 0)}
    with pytest.raises(Exception, match="no source_id c"):
        jn.mandatory(records, sources, "source_id").collect()
    lists = spark.createDataFrame([(1, ["x", "y", "x"], "y"), (2, None, "z"), (3, None, None)], "id int, l array<string>, own string")
    assert rows(jn.once_per_area(lists, "id", "l", "own")) == {(1, "x"), (1, "y"), (2, "z")}
    grains = spark.createDataFrame([("a.*",), ("ab",)], "key_pattern string")
    keys = spark.createDataFrame([("ab",), ("ac",), ("xab",)], "k string")
    assert {(r["k"], r["_matches"]) for r in jn.by_pattern(keys, grains, "k").collect()} == {("ab", 2), ("ac", 1), ("xab", 0)}
    base, head = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k int, v string")
    assert rows(jn.compare_releases(base, head, "k", "v")) == {(1, "removed"), (2, "changed"), (3, "unchanged"), (4, "added")}
    assert rows(jn.churn(base, head, "k")) == {(2, 4, 0.5)} and rows(jn.churn(base.limit(0), head.limit(0), "k")) == {(0, 0, 0.0)}
    assert rows(jn.partition_of(sources, [sources, records], "source_id")) == {("a", 2)}
    with pytest.raises(ValueError):
        jn.overlaps(base, (1, 0, 0, 1))


def test_ranking(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(20)] + [("b", 1, 5.0)], "g string, t int, v double").withColumn("k", F.col("t"))
    got = {r["g"]: r for r in rk.last_points(df, ["g"], "t", "k", "v").collect()}
    assert got["a"]["points"] == 20 and len(got["a"]["last"]) == 12 and got["a"]["latest"] == 19.0 and got["a"]["is_series"] and not got["b"]["is_series"]
    assert rk.preview(df, 99, "g", "t").count() == 10 and rk.preview(df, -1, "g", "t").count() == 1
    assert [r["t"] for r in rk.page(df, 5, 1, "g", "t").collect()] == [5, 6, 7, 8, 9]


def test_urls():
    assert ns.canonical_url("HTTPS://Bücher.example:443/%7Eb/?b=2&a=1#f") == "https://xn--bcher-kva.example/~b/?a=1&b=2"
    assert ns.canonical_url("ftp://x/y") is None and ns.canonical_url("https://u:p@x/") is None and ns.canonical_url("https://x/%2e%2e/etc") is None
    assert ns.has_credentials("https://x/?api_key=1") and ns.has_credentials("https://x/?a=1%26token%3D2") and not ns.has_credentials("https://x/?q=1")


def test_gates(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id int, label string")
    twice = good.unionByName(good.limit(1))
    assert gt.duplicates(good, ["id"]).count() == 0 and gt.duplicates(twice, ["id"]).count() == 1
    assert gt.complete(good, "id", 2).count() == 0 and gt.complete(good, "id", 3).count() == 1 and gt.complete(twice, "id").count() == 1
    assert gt.missing_pairs(good, good, "id", good, "label").count() == 2
    assert gt.unknown_references(good, good.limit(1), "id").count() == 1
    published = spark.createDataFrame([("a", 1), ("b", 2)], "label string, n int")
    assert rows(gt.unreconciled(good, "label", published, "n")) == {("b", 1, 2)}
    assert gt.not_partitioned(twice, good, good.limit(1)).count() == 0 and gt.not_partitioned(twice, good).count() == 1
    assert rows(gt.wrong_counts(published, published.limit(1), "label", "n")) == {("b", 2, None)}
    cells = spark.createDataFrame([("-1", "=1+1"), ("+1.25", "x"), ("-.5", "@y"), ("-1e3", None)], "a string, b string")
    assert rows(gt.unsafe_cells(cells, ["a", "b"])) == {("b", "formula", 2), ("b", "missing", 1)}
    with pytest.raises(gt.GateError, match="twice"):
        gt.enforce("twice", gt.duplicates(twice, ["id"]))
    base, head = spark.createDataFrame([("a", 10, "2026-01"), ("b", 1, "x"), ("d", 5, None)], "d string, rows int, as_of string"), spark.createDataFrame([("a", 9, "2025-12"), ("c", 3, "y"), ("d", 50, None)], "d string, rows int, as_of string")
    assert rows(gt.drift(base, head, "d", "as_of")) == {("a", "rows fell"), ("a", "as_of went back"), ("b", "dataset is gone"), ("d", "rows rose")}
    boxes = spark.createDataFrame([(1, 0.0, 1.0), (2, 181.0, 0.0), (3, None, 0.0), (4, float("nan"), 0.0)], "id int, lon double, lat double")
    assert rows(gt.invalid_boxes(boxes, "id", ["lon"], ["lat"])) == {(2,), (3,), (4,)}


def test_more_gates(spark):
    rows_of = spark.range(5)
    assert gt.capped(rows_of, 5).count() == 5
    with pytest.raises(gt.GateError):
        gt.capped(rows_of, 4)
    sources = spark.createDataFrame([("a", "public", True, False), ("b", "restricted", True, False), ("c", "public", None, False), ("d", "public", True, True)], "source_id string, policy string, approved boolean, pending boolean")
    assert rows(gt.not_ready(sources)) == {("b", "restricted"), ("c", "not approved"), ("d", "pending")}
    documents = spark.createDataFrame([(1, "{}"), (2, "["), (3, "[" * 50 + "]" * 50), (4, None)], "id int, p string")
    assert rows(gt.unreadable_documents(documents, "id", "p")) == {(2, "not JSON"), (3, "too deep")}


def test_sync(spark, tmp_path):
    keys, path = ["source_id", "id", "hash"], f"{tmp_path}/versions"
    batch = spark.createDataFrame([("s", 1, "h", 1), ("s", 1, "h", 2), ("s", 2, "h", 3), ("r", 1, "h", 4)], "source_id string, id int, hash string, n int")
    assert sy.append_versions(batch, path, keys, "n") == 3 and sy.append_versions(batch, path, keys, "n") == 0
    assert sy.append_versions(batch.withColumn("hash", F.lit("g")), path, keys, "n") == 3
    assert rows(sy.load_counts(batch, batch.limit(0), keys, "n")) == {(3, 1)}
    stored, wanted = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, h int"), spark.createDataFrame([("a", 1), ("b", 9), ("d", 4)], "k string, h int")
    assert rows(sy.classify(stored, wanted, "k", ["h"])) == {("a", "unchanged"), ("b", "updated"), ("c", "deleted"), ("d", "inserted")}
    assert rows(sy.merged(stored, wanted, "k")) == {("a", 1), ("b", 9), ("c", 3), ("d", 4)}
    layers = f"{tmp_path}/layers"
    spark.createDataFrame([("x", 1), ("y", 2)], "layer string, v int").write.partitionBy("layer").parquet(layers)
    sy.swap_partitions(spark.createDataFrame([("x", 7)], "layer string, v int"), layers, "layer")
    assert rows(spark.read.parquet(layers).select("layer", "v")) == {("x", 7), ("y", 2)}
    target = f"{tmp_path}/published"
    sy.publish(stored, target)
    with pytest.raises(gt.GateError):
        sy.publish(wanted, target, {"no rows": wanted})
    assert rows(spark.read.parquet(target)) == rows(stored)
    sy.publish(wanted, target, {"fine": wanted.limit(0)})
    assert rows(spark.read.parquet(target)) == rows(wanted)


def left_over(folder):
    return [p.name for p in folder.iterdir() if "_staged_" in p.name or "_replaced_" in p.name]


def test_gates_of_rows_as_written(spark, tmp_path):
    target, calls = f"{tmp_path}/t", spark.sparkContext.accumulator(0)
    first = spark.createDataFrame([("a", 1), ("b", None)], "k string, h int")
    few = lambda v: f"{v['n']} rows" if v["n"] < 2 else None
    counts = lambda: sy.Measured(few, n=F.count(F.lit(1)), nulls=F.count_if(F.col("h").isNull()))
    sy.publish(first, target, measured=(m := counts()))
    assert m.values == {"n": 2, "nulls": 1}
    with pytest.raises(gt.GateError, match="1 rows"):
        sy.publish(first.limit(1), target, measured=counts())
    with pytest.raises(gt.GateError, match="nulls"):
        sy.publish(first, target, {"nulls": lambda written: written.where("h IS NULL")})
    assert rows(spark.read.parquet(target)) == rows(first) and not left_over(tmp_path)

    def one(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    sy.publish(first.mapInArrow(one, first.schema), target, {"copies": lambda written: gt.duplicates(written, ["k"])}, counts())
    assert calls.value == 2
    with pytest.raises(gt.GateError):
        sy.swap_partitions(first, f"{tmp_path}/p", "k", measured=sy.Measured(lambda v: "no"))
    assert not left_over(tmp_path)


def test_layers_are_replaced_together(spark, tmp_path):
    path, schema = f"{tmp_path}/layers", "layer string, id string"
    snapshot = lambda *rows: spark.createDataFrame(rows, "layer string, content_hash string, feature_count int")
    two, features = snapshot(("x", "1", 2), ("y", "1", 1)), spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], schema)
    assert rows(sy.sync_layers(None, two, features, path, "layer", "id")) == {("x", "inserted", 2, 2), ("y", "inserted", 1, 1)}
    assert rows(sy.sync_layers(two, two, features, path, "layer", "id")) == {("x", "unchanged", 2, 0), ("y", "unchanged", 1, 0)}
    new = snapshot(("x", "2", 1), ("y", "1", 1))
    for bad in ([("x", "c"), ("x", "c")], [("x", None)], [], [("x", "c"), ("z", "c")]):
        with pytest.raises(gt.GateError):
            sy.sync_layers(two, new, spark.createDataFrame(bad, schema), path, "layer", "id")
    assert rows(spark.read.parquet(path).select("layer", "id")) == rows(features)
    assert rows(sy.sync_layers(two, new, spark.createDataFrame([("x", "c")], schema), path, "layer", "id")) == {("x", "replaced", 1, 1), ("y", "unchanged", 1, 0)}
    assert rows(spark.read.parquet(path).select("layer", "id")) == {("x", "c"), ("y", "a")} and not left_over(tmp_path)


def test_readers(spark, tmp_path):
    folder = tmp_path / "snapshot" / "deep"
    folder.mkdir(parents=True)
    (folder / "places.csv").write_text('﻿code,name\n05,"a, b"\n', encoding="utf-8")
    (folder / "rows.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n\n[2]\n{"a": 3}\n'))
    (folder / "doc.json").write_text(json.dumps({"data": {"items": [{"i": 1}, {"i": 2}, 3]}}))
    (folder / "manifest.json").write_text(json.dumps({"datasets": [{"key": "deep/x", "count": 2, "folder": "deep"}]}))
    assert rd.list_snapshot(spark, str(tmp_path / "snapshot")).count() == 3
    assert rows(rd.read_csv(spark, str(folder / "places.csv"))) == {("05", "a, b", "places")}
    lines = str(folder / "rows.jsonl.gz")
    assert rows(rd.read_json_lines(spark, lines)) == {("rows", '{"a": 1}'), ("rows", '{"a": 3}')}
    with pytest.raises(gt.GateError):
        rd.read_json_lines(spark, lines, strict=True)
    assert rows(rd.read_json(spark, str(folder / "doc.json"))) == {("doc", "root.data.items", '{"i":1}'), ("doc", "root.data.items", '{"i":2}')}
    assert rows(rd.manifest_datasets(spark, str(folder / "manifest.json"))) == {("deep/x", 2, "deep")}
    release = rd.read_release(spark, str(tmp_path / "snapshot"))
    assert release.count() == 4 and wr.check_receipt(release, release).count() == 0
    assert wr.release_digest(release).first()["files"] == 4
    assert {r["problem"] for r in wr.check_receipt(release, release.where("path NOT LIKE '%doc.json'")).collect()} == {"not in the receipt"}


def test_page_readers(spark):
    html = '<ul><li><a href="/st/1">One  <b>x</b></a><A class=k HREF=/st/2>Two</A></li><a href="/st/1">Again</a><a name=z>no</a></ul>'
    pages = spark.createDataFrame([(1, html, "1", "3")], "page_id int, html string, number string, last string")
    assert rows(rd.links(pages)) == {(1, 0, "/st/1", "One x"), (1, 1, "/st/2", "Two"), (1, 2, "/st/1", "Again")}
    assert {r["link_text"] for r in rd.station_links(pages, "^/st/").collect()} == {"One x", "Two"}
    assert rows(rd.missing_pages(pages, "number", "last")) == {(2,), (3,)}
    table = spark.createDataFrame([([["h", "k"], ["a", "1"], ["b"]],)], "r array<array<string>>")
    assert rows(rd.header_array(table, "r")) == {(1, "a", "1"), (2, "b", None)}
    months = spark.createDataFrame([("2026-05",)], "m string")
    assert rd.month_envelope(months, "m").count() == 1
    with pytest.raises(gt.GateError):
        rd.month_envelope(months.unionByName(spark.createDataFrame([("2026-06",)], "m string")), "m")
    flat = spark.createDataFrame([("0", "", "7")], "a string, b string, c string")
    assert rows(rd.flat_readings(flat, x=["a", "b", "c"], y=["a"])) == {("7", None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 1), ("a", "x,y", 2)], "k string, v string, n int")
    wr.write_json(df, f"{tmp_path}/j")
    assert {json.dumps(json.loads(r[0])) for r in spark.read.text(f"{tmp_path}/j").collect()} == {'{"k": "b", "v": null, "n": 1}', '{"k": "a", "v": "x,y", "n": 2}'}
    wr.write_csv(df, f"{tmp_path}/c", ["v", "k"])
    assert rd.read_csv(spark, f"{tmp_path}/c").columns[:2] == ["v", "k"]
    assert df.where("k = 'a'").select(wr.document("n", "k").alias("d")).first()["d"] == '{"k":"a","n":2}'


def test_stream(spark, tmp_path, readings):
    source = f"{tmp_path}/in"
    readings.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = windowed_history(stream, "rain", "7 days", additive=True).writeStream.outputMode("complete").format("memory").queryName("history").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["v"] for r in spark.table("history").collect()) == [5.0, 5.0]
    once = new_versions(stream, ["station", "metric"], "ts").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    once.awaitTermination(120)
    assert spark.table("once").count() == 3


def test_prefix_rules_keep_every_page(spark):
    pages = [(1, "http://a/x/y", "http://a", "/x/y"), (2, "http://a/x/y", "http://a", "/x/y"), (3, None, None, None), (4, None, None, None), (5, "http://b/x", "http://b", "/x"), (6, "http://a/xy", "http://a", "/xy"), (7, "http://a/x/?q", "http://a", "/x/")]
    rules = spark.createDataFrame([("http://a", "/x", "s1", False), ("http://a", "/x/y", "s3", True), ("http://a", "/x/y", "s2", False)], "rule_origin string, rule_path string, source_id string, denied boolean")
    found = jn.by_prefix(spark.createDataFrame(pages, "page_id long, url string, origin string, path string"), rules).collect()
    assert {(r["page_id"], r["rule_path"], r["source_id"], r["denied"]) for r in found} == {(1, "/x/y", "s2", False), (2, "/x/y", "s2", False), (3, None, None, None), (4, None, None, None), (5, None, None, None), (6, None, None, None), (7, "/x", "s1", False)}
    assert len(found) == 7


def test_tables_and_content(spark):
    files = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x"]), ("c", ["x", "x"])], "path string, header array<string>")
    assert rows(gt.wrong_headers(files, ["x", "y"])) == {("b", "other names"), ("c", "repeated name")}
    cells = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["a", "b", "c"])], "id int, cells array<string>")
    assert rows(gt.ragged_rows(cells, "id", "cells", 2)) == {(2, "missing cells"), (3, "extra cells")}
    records = spark.createDataFrame([("s", "1"), ("s", "1"), ("s", None), ("t", "2")], "d string, i string")
    assert rows(gt.wrong_content(records, "d", "i", {"s": 3, "t": 1, "u": 2})) == {("s", "records without an id", 1), ("s", "repeated ids", 1), ("u", "another number of records", 0)}
    places = spark.createDataFrame([(1, '{"type":"Point","coordinates":[1,2]}'), (2, "x"), (3, None), (4, '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}')], "id int, g string")
    assert rows(gt.invalid_geometries(places, "id", "g")) == {(2, "not JSON"), (3, "no geometry"), (4, "bad Polygon")}


def test_bound_files(spark):
    paths = spark.createDataFrame([("a/b.json",), ("a/c+d.csv",), ("z",), ("a/e.json",)], "path string")
    outputs = spark.createDataFrame([("a/*.json", False, 2), ("a/c+?.csv", False, 1), ("a/[!b].json", False, None), ("a/b.json", True, 3), ("q*", False, None)], "selector string, exact boolean, expected_files int")
    assert rows(jn.bind_globs(paths, outputs)) == {
        ("a/b.json", "a/*.json", "several contracts"), ("a/b.json", "a/b.json", "several contracts"), ("a/e.json", "a/*.json", "several contracts"), ("a/e.json", "a/[!b].json", "several contracts"),
        ("a/c+d.csv", "a/c+?.csv", None), ("z", None, "no contract"), (None, "a/b.json", "fits another number of files"), (None, "q*", "fits no file"),
    }


def test_patterns_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jn, "SMALL", 2)
    keys, grains = spark.createDataFrame([("k3",), ("k9",)], "k string"), spark.createDataFrame([(f"k{i}",) for i in range(9)], "key_pattern string")
    assert {(r["k"], r["_matches"]) for r in jn.by_pattern(keys, grains, "k").collect()} == {("k3", 1), ("k9", 0)}


def test_rules_for_equal_urls(spark):
    pages = [(1, "u", "o", "/a/b"), (2, "u", "o", "/a/b"), (3, None, None, None), (4, None, None, None)]
    rules = spark.createDataFrame([("o", "/a", "s", True)], "rule_origin string, rule_path string, source_id string, denied boolean")
    found = jn.by_prefix(spark.createDataFrame(pages, "page_id long, url string, origin string, path string"), rules).collect()
    assert {(r["page_id"], r["source_id"]) for r in found} == {(1, "s"), (2, "s"), (3, None), (4, None)} and len(found) == 4


def test_distribution_without_groups(spark):
    df = spark.createDataFrame([(i, label) for i, label in enumerate("bbaacd")] + [(9, None)], "n int, label string")
    assert [(r["label"], r["value"], r["rank"], r["share_pct"]) for r in sorted(ag.distribution(df, "label", "n", 3).collect(), key=lambda r: r["rank"])] == [("b", 2, 1, 33.3), ("a", 2, 2, 33.3), ("c", 1, 3, 16.7)]
