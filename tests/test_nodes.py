"""Documents as tables of nodes."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cadastra.operators import nodes as nd

PAYLOAD = {"a": {"rows": [{"x": 1}, 2, {"x": [{"y": 3}]}]}, "b": [1], "ownerContact": "n", "address_province": "p", "t": "mail a@b.co", "source_id": "s", "deep": {"url": "https://u.v/w", "unit": "m"}}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def of(spark, *documents):
    """A table of documents, which are values or JSON text."""
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)], "id int, p string")


def tree_of(spark, *documents, **kw):
    return nd.tree(of(spark, *documents), "p", ["id"], **kw)


def drawn(rng: random.Random, depth: int):
    kind = rng.choice("ooaasinbz" if depth else "sinbz")
    if kind == "o":
        return {rng.choice("abcdé") + rng.choice(["", "x", "_y", " z"]): drawn(rng, depth - 1) for _ in range(rng.randrange(4))}
    if kind == "a":
        return [drawn(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"s": rng.choice(["", "text", 'q"uote\n', "ü"]), "i": rng.randrange(-9, 99), "n": rng.randrange(99) + 0.5, "b": rng.random() < 0.5, "z": None}[kind]


def plain_walk(value, path="$"):
    yield path, value
    for k, v in value.items() if isinstance(value, dict) else []:
        yield from plain_walk(v, f"{path}/{k}")
    for v in value if isinstance(value, list) else []:
        yield from plain_walk(v, f"{path}[]")


def plain_kind(v):
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}[type(v)]


def plain_records(value, path="root"):
    if isinstance(value, list):
        return [(path, v) for v in value if isinstance(v, dict)]
    nested = [hit for k, v in value.items() if isinstance(v, dict | list) for hit in plain_records(v, f"{path}.{k}")]
    return nested or [(path, value)]


def test_drawn_documents(spark):
    """Leaves, shapes, records and documents put together again, against plain recursion."""
    rng = random.Random(2)
    documents = [d if isinstance(d, dict) else {"a": d} for d in (drawn(rng, 4) for _ in range(150))]
    nodes = tree_of(spark, *documents)
    scalars = [(i, p, None if v is None else v if isinstance(v, str) else json.dumps(v)) for i, d in enumerate(documents) for p, v in plain_walk(d) if not isinstance(v, dict | list)]
    assert rows(nd.leaves(nodes)) == sorted(scalars, key=repr)
    shape = lambda d: hashlib.sha256("\n".join(sorted({f"{p}:{plain_kind(v)}" for p, v in plain_walk(d)})).encode()).hexdigest()
    assert {r[0]: r[1:] for r in rows(nd.shapes(nodes))} == {i: (shape(d), None) for i, d in enumerate(documents)}
    assert [(i, p, json.loads(r)) for i, p, r in rows(nd.records(nodes))] == [(i, p, json.loads(r)) for i, p, r in sorted(((i, p, json.dumps(r, sort_keys=True, ensure_ascii=False, separators=(",", ":"))) for i, d in enumerate(documents) for p, r in plain_records(d)), key=repr)]
    assert {i: json.loads(j) for i, j in rows(nd.rebuilt(nodes))} == dict(enumerate(documents))


def test_one_bad_document_fails_alone(spark):
    deep, deeper, twice = "[" * 60 + "]" * 60, "[" * 100_000 + "]" * 100_000, '{"a": 1, "a": 2}'
    nodes = tree_of(spark, {"a": [1]}, deep, deeper, twice, "no json", None, '{"a": NaN}', "﻿{}", 3)
    assert {r[0]: r[2] for r in rows(nd.shapes(nodes))} == {0: None, 1: "too deep", 2: "not JSON", 3: "not JSON", 4: "not JSON", 6: "not JSON", 7: "not JSON", 8: None}
    assert (0, "$/a[]", "1") in rows(nd.leaves(nodes)) and {r[0] for r in rows(nd.leaves(nodes))} == {0, 8}
    assert tree_of(spark).count() == 0
    assert "Python" not in nodes._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([("x", '{"a": 1}'), ("x", '{"a": 1}'), (None, "{}")], "doc string, value string")
    assert rows(nd.shapes(nd.tree(df, "value", ["doc"])).select("doc", "problem")) == [("x", None), ("x", None), (None, None)]
    assert rows(nd.leaves(nd.tree(df, "value"))) == rows(nd.leaves(nd.tree(df.limit(2), "value")))


def test_what_may_not_be_published(spark):
    df = of(spark, PAYLOAD, {"list": [{"e_mail": "x", "n": "+66 2 123 4567"}]})
    clean = {i: json.loads(j) for i, j in rows(nd.sanitised(df, "p", ["id"]))}
    assert clean[0] == {k: v for k, v in PAYLOAD.items() if k != "ownerContact"} | {"t": "mail [redacted-email]"} and clean[1] == {"list": [{"n": "[redacted-phone]"}]}
    assert rows(nd.forbidden(nd.tree(df, "p", ["id"]))) == [(0, "$/ownerContact", "contact key"), (0, "$/t", "email value"), (1, "$/list/0/e_mail", "contact key"), (1, "$/list/0/n", "phone value")]
    plain = nd.without_keys(of(spark, {"a": {"color": 1, "b": [{"style": {}, "c": []}]}}), "p")
    assert [json.loads(r[0]) for r in rows(plain)] == [{"a": {"b": [{"c": []}]}}]


def test_meaning(spark):
    base = {"metric_key": "m", "unit": "kg", "rows": [{"value": 1, "status": "ok"}, {"value": 2, "status": "ok"}], "geography": {"level": "area"}}
    changes = [{"unit": "t"}, {"metric_key": "n"}, {"rows": [{"value": 1, "status": "late"}]}, {"geography": {"level": "region"}}, {"note": "needs_review"}, {"x_method": "a"}, {"review_by": "b"}]
    same = base | {"rows": [*base["rows"], {"value": 9, "status": "ok"}]}  # another observation means nothing new
    got = [r["meaning"] for r in nd.meaning_hashes(tree_of(spark, base, same, *(base | c for c in changes)).withColumn("doc", F.col("of.id"))).orderBy("doc").collect()]
    assert got[0] == got[1] and len(set(got)) == 1 + len(changes)
    geometry = tree_of(spark, {"geometry": {"type": "Point", "coordinates": [1, 2]}, "type": "row", "review_count": 3})
    assert rows(nd.meanings(geometry)) == [(0, "$/geometry/type", "", '"Point"', "kind of geometry")]
    nested = tree_of(spark, {"sourceId": "s", "parts": [{"rows": [{"unit": "m"}]}, {"metricKey": "k", "source_id": "t", "rows": [{"unit": "m", "odd key": {"unit_th": "x"}}]}]})
    assert {r[1:4] for r in rows(nd.meanings(nested))} == {
        ("$/parts[]/rows[]/unit", '[["source_id","s"]]', '"m"'), ("$/parts[]/rows[]/unit", '[["metric_key","k"],["source_id","t"]]', '"m"'), ("$/parts[]/rows[]/<map-key>/unit_th", '[["metric_key","k"],["source_id","t"]]', '"x"'),
    }


def test_wide_objects_cost_no_square(spark):
    """4,000 keys of meaning in one object: each is looked at once."""
    wide = {f"k{i}_unit": "m" for i in range(4000)} | {"metric_key": "m"}
    assert nd.meanings(tree_of(spark, wide)).count() == 4000


def test_what_is_around_needs_no_join(spark):
    """Each level hands down what it says: there is no table of nodes that could be broadcast."""
    nodes = tree_of(spark, {"source_id": "s", "rows": [{"unit": "m", "url": "u"}]})
    for found in (nd.meanings(nodes), nd.meaning_hashes(nodes), nd.sourced_urls(nodes, ["rows"])):
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert rows(nd.sourced_urls(nodes)) == [(0, "$/rows[]/url", ["s"], "u")] and rows(nd.sourced_urls(nodes, ["rows"])) == [(0, "$/rows[]/url", ["rows"], "u")]


def test_nearest_value_around(spark):
    """At any depth, against going up step by step."""
    rng = random.Random(5)

    def chain(depth):
        own = {"source_id": f"s{rng.randrange(9)}"} if rng.random() < 0.3 else {}
        return own | ({"in": chain(depth - 1)} if rng.random() < 0.6 else {"in": [chain(depth - 1)]}) if depth else {"url": "u"}

    documents = [chain(rng.randrange(1, 20)) for _ in range(40)]

    def nearest(d, around=None):
        if isinstance(d, list):
            return nearest(d[0], around)
        around = d.get("source_id", around)
        return around if "url" in d else nearest(d["in"], around)

    got = {r[0]: r[2] for r in rows(nd.sourced_urls(tree_of(spark, *documents)))}
    assert got == {i: [s] if (s := nearest(d)) else [] for i, d in enumerate(documents)}


def test_sources_of_addresses(spark):
    document = {"sources": {"a": {"url": "1"}, "x": {"url": "2"}}, "rows": [{"source_ids": ["c", "b", "c"], "links": ["3", "4"], "in": {"homeUrl": "5", "curl": "6"}}], "website": "7", "href": None}
    got = {(r[3], tuple(r[2])) for r in rows(nd.sourced_urls(tree_of(spark, document), ["a", "b"]))}
    assert got == {("1", ("a",)), ("2", ("a", "b")), ("3", ("b", "c")), ("4", ("b", "c")), ("5", ("b", "c")), ("7", ("a", "b"))}


def test_times_and_keyed_records(spark):
    nodes = tree_of(spark, {"m": [{"as_of": "2569"}, {"observedAsOf": 1, "fetched_at": "x", "updated_at": "y"}], "z_as_of": None}, {"x": {"v": 1}, "y": 2, "w": {}}, [{"v": 1}, 2])
    assert rows(nd.times(nodes)) == [(0, "$/m[0]/as_of", "2569"), (0, "$/m[1]/observed_as_of", "1"), (0, "$/z_as_of", None)]
    assert [r for r in rows(nd.keyed_records(nodes)) if r[0]] == [(1, "w", '{"$key":"w"}'), (1, "x", '{"$key":"x","v":1}'), (2, None, '{"v":1}')]


def test_declared_counts(spark):
    fine = [{"rows": [1], "row_count": 1}, {"items": [], "total_records": 5, "resource_groups": [{"row_count": 2}, {"row_count": 3}]}, {"items": [1], "total_records": 9, "others": [1]}, {"rows": 1}]
    bad = {"a": {"rows": [1], "row_count": 2}, "b": [{"items": [1, 2], "total_records": 1}], "c": {"rows": {}, "row_count": 0}, "d": {"rows": [], "row_count": True}, "e": {"items": [], "total_records": 4, "resource_groups": [{"row_count": 3}]}, "f": {"rows": [], "row_count": -1}, "g": {"items": [], "total_records": 4, "resource_groups": [{"row_count": "4"}]}}
    got = rows(nd.miscounted(tree_of(spark, fine, bad)))
    assert [r[:2] for r in got] == [(1, "$/a"), (1, "$/b[]"), (1, "$/c"), (1, "$/d"), (1, "$/e"), (1, "$/f"), (1, "$/g")]
    assert {r[2] for r in got if r[1] in ("$/c", "$/d", "$/f")} == {"rows and row_count are not a list and a whole number", "row_count is negative"}


def test_declared_counts_look_at_no_scalars(spark):
    documents = of(spark, {"rows": None, "row_count": 1}, {"a": [{"items": [1, 2], "total_records": 3}, 4]}, {"rows": [], "total_records": 1}, 5, "{")
    nodes = nd.tree(documents, "p", ["id"], context=False, scalars=False)
    assert rows(nodes.groupBy("kind").count()) == [("array", 3), ("object", 4)]
    assert [r[:2] for r in rows(nd.miscounted(nodes))] == [(0, "$"), (1, "$/a[]")] and rows(nd.miscounted(nodes)) == rows(nd.miscounted(nd.tree(documents, "p", ["id"])))


RING = [[0, 0], [1, 0], [1, 1], [0, 0]]


@pytest.mark.parametrize("many", [1])
def test_geometries(spark, many):
    fine = [
        {"type": "Point", "coordinates": [1, 2.5, 9]}, {"type": "MultiPoint", "coordinates": [[1, 2]]}, {"type": "LineString", "coordinates": RING}, {"type": "MultiLineString", "coordinates": [RING]},
        {"type": "Polygon", "coordinates": [RING, RING]}, {"type": "MultiPolygon", "coordinates": [[RING]]}, {"type": "GeometryCollection", "geometries": []},
        {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}]}]},
    ]
    bad = {
        "bad Polygon": {"type": "Polygon", "coordinates": [RING[:3]]}, "bad Point": {"type": "Point", "coordinates": [200, 0]}, "unknown type": {"type": "Blob"}, "no geometry": None, "not JSON": "{", "bad LineString": {"type": "LineString", "coordinates": [[0, 0]]},
        "bad MultiPolygon": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 1]]]]}, "bad MultiPoint": {"type": "MultiPoint", "coordinates": []}, "no geometries": {"type": "GeometryCollection", "coordinates": []},
        "bad MultiLineString": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, {"type": "GeometryCollection", "geometries": [{"type": "MultiLineString", "coordinates": [[["1", 2], [1, 2]]]}]}]},
    }
    got = dict(rows(nd.wrong_geometries(of(spark, *fine, *bad.values()), "p", ["id"])))
    assert got == {i: problem for i, problem in enumerate(bad, len(fine))}
    assert rows(nd.wrong_geometries(of(spark, {"type": "Point", "coordinates": ["1", True]}, 3, {"type": "GeometryCollection", "geometries": [1]}), "p", ["id"])) == [(0, "bad Point"), (1, "no geometry"), (2, "no geometry")]


def test_previews(spark):
    wide = {"a": list(range(30)), "b": {"phone": {"x": 1}, "t": "x" * 900}, "d": [[[[[[[[1]]]]]]]], **{f"k{i:03d}": i for i in range(60)}}
    got = {r[0]: json.loads(r[1]) for r in rows(nd.previews(of(spark, wide, list(range(9)) * 2), "p", ["id"]))}
    assert got[0]["a"] == list(range(12)) and got[0]["b"] == {"phone": nd.HIDDEN, "t": "x" * 800} and len(got[0]) == 40 and got[0]["d"] == [[[[[["…"]]]]]] and got[1] == list(range(9)) + [0, 1, 2]
    few = json.loads(rows(nd.previews(of(spark, wide), "p", ["id"], nodes=5))[0][1])
    assert few["a"][:3] == [0, 1, 2] and few["a"][3] == "…" and few["b"] == "…"


def test_names_in_languages(spark):
    df = spark.createDataFrame([({"th": "ก", "EN": "", "xx": "y", "Cn": "c"},)], "m map<string,string>")
    assert df.select(nd.localised("m").alias("m")).head()["m"] == {"th": "ก", "Cn": "c"}
