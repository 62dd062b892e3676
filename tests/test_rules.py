"""Rules by path, pointers, shell patterns, identities and medians."""

from __future__ import annotations

import fnmatch
import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cadastra.functions import ids
from cadastra.operators import aggregates as ag
from cadastra.operators import gates as gt
from cadastra.operators import joins as jn


def rows(df):
    return {tuple(r) for r in df.collect()}


def plain_rule(origin, path, query, rules):
    fitting = []
    for o, p, q, exact, source, denied in rules:
        below = p == "/" or path == p or path.startswith(p.rstrip("/") + "/")
        if o == origin and ((path == p and query == q) if exact else below and (not q or query == q)):
            fitting.append((not exact, -len(p), -len(q), source, p, q, denied))
    return (lambda r: (r[4], r[3], r[6]))(min(fitting)) if fitting else (None, None, None)


def test_rules_of_all_kinds(spark):
    rng = random.Random(3)
    some = lambda: "/" + "/".join(rng.choices(["a", "b", "ab", ""], k=rng.randrange(4)))
    rules = list({(rng.choice("xy"), some(), rng.choice(["", "", "q=1"]), rng.random() < 0.2, f"s{rng.randrange(5)}", rng.random() < 0.5) for _ in range(40)})
    pages = [(i, rng.choice(["x", "y", "z"]), some(), rng.choice([None, "q=1", "q=2"])) for i in range(200)] + [(900, None, None, None), (900, None, None, None)]
    found = jn.by_prefix(spark.createDataFrame(pages, "id int, origin string, path string, query string"), spark.createDataFrame(rules, "rule_origin string, rule_path string, rule_query string, exact boolean, source_id string, denied boolean"), query="query")
    got = sorted((tuple(r) for r in found.select("id", "rule_path", "source_id", "denied").collect()), key=repr)
    assert got == sorted(((i, *(plain_rule(o, p, q or "", rules) if o else (None,) * 3)) for i, o, p, q in pages), key=repr)


def test_an_origin_of_many_rules(spark):
    """100,000 rules of one origin: each path meets its own ancestors' rules only."""
    rules = spark.range(100_000).select(F.lit("o").alias("rule_origin"), F.concat(F.lit("/r"), "id").alias("rule_path"), F.concat(F.lit("s"), "id").alias("source_id"), F.lit(False).alias("denied"))
    pages = spark.range(20_000).select("id", F.lit("o").alias("origin"), F.concat(F.lit("/r"), F.col("id") * 7, F.lit("/x/"), "id").alias("path"))
    found = jn.by_prefix(pages, rules)
    assert found.where("source_id = concat('s', id * 7)").count() == 14_286 and found.where("source_id IS NULL").count() == 20_000 - 14_286


def test_pointers(spark):
    document = {"2024": {"a": 5, "b": [10, {"0": "x"}]}, "l": [[1, 2], {"k": None}], "a/b": {"~": True}, "": 3}
    df = spark.createDataFrame([(json.dumps(document),), ("[7, 8]",), ("no",), (None,)], "p string")
    at = lambda path: [r[0] for r in df.select(ids.pointer("p", path).alias("v")).collect()]
    assert at("/2024/a") == ["5", None, None, None] and at("/2024/b/1/0")[0] == "x" and at("/2024/b/0")[0] == "10"
    assert at("/l/0/1")[0] == "2" and at("/l/9")[0] is None and at("/l/1/k")[0] is None and at("/a~1b/~0")[0] == "true"
    assert at("/1") == [None, "8", None, None] and at("/l/x")[0] is None and at("/01")[1] == "8"
    assert json.loads(at("")[0]) == document and json.loads(at("/l")[0]) == document["l"]
    with pytest.raises(ValueError, match="pointer"):
        ids.pointer("p", "a/b")


def test_shell_patterns(spark):
    rng = random.Random(4)
    patterns = ["[", "a[", "a[?]", "a[*]", "[!a]", "[]]", "[!]]", "[a-c]x", "[c-a]", "[!c-a]", "[^a]", "a.b", "a\\d", "*", "**?", "[a-]", "[]-a]", "a]b", "{a}|b", "[[]", "[&&a]", "(a+)$", "[\\]", "", "a\nb", "é?"]
    patterns += ["".join(rng.choices("ab[]!?*-^.", k=rng.randrange(1, 7))) for _ in range(150)]
    texts = ["", "a", "b", "a.", "a?", "a*", "[", "a[", "]", "ax", "bx", "c", "^", "a.b", "axb", "a\\d", "a1", "-", "a]b", "{a}|b", "&", "(a+)$", "\\", "a\nb", "ab\n", "éa", "ab-", "!", "b]", "a-b."]
    df = spark.createDataFrame([(p, t) for p in patterns for t in texts], "p string, t string")
    got = {(r["p"], r["t"]) for r in df.where(F.rlike("t", jn.glob_pattern("p"))).collect()}
    assert got == {(p, t) for p in patterns for t in texts if fnmatch.fnmatchcase(t, p)}


def test_records_without_an_id(spark):
    df = spark.createDataFrame([(1, '{"id": "a"}'), (2, '{"id": "%s"}' % ("x" * 201)), (3, '{"id": ""}'), (4, None)], "k int, p string")
    assert rows(gt.unidentified(df, "k", "p", [["id"]], F.lit("h"))) == {(2, "identity too long"), (3, "no identity"), (4, "no identity")}
    assert rows(gt.unidentified(df, "k", "p", [["id"], ["$payload_hash"]], F.lit("h"))) == {(2, "identity too long")}


@pytest.mark.parametrize("in_task", [1, 7, 1_000_000])
def test_medians(spark, monkeypatch, in_task):
    monkeypatch.setattr(ag, "IN_TASK", in_task)
    monkeypatch.setattr(ag, "RANGES", 5)
    rng = random.Random(6)
    groups = {"even": [rng.gauss(0, 1e6) for _ in range(200)], "odd": [rng.expovariate(1) ** 9 for _ in range(101)], "ties": [1.0] * 90 + [2.0] * 90, "one": [4.0], "ends": [-1.7e308, 1.7e308, 0.0, 5.0], "inf": [float("inf")] * 3 + [1.0, float("-inf")], None: [1.0, 2.0, 9.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "metric string, value double").repartition(5)
    got = {r["metric"]: (r["minimum"], r["median"], r["maximum"], r["areas"]) for r in ag.benchmark(df).collect()}
    assert got == {g: (min(vs), statistics.median(vs), max(vs), len(vs)) for g, vs in groups.items()}
    strange = spark.createDataFrame([("n", float("nan"))] * 3 + [("n", 1.0)], "metric string, value double")
    assert str(ag.medians(strange, "metric", "value").head()["median"]) == "nan"


def test_median_of_a_large_group(spark):
    """Ten million values of one group, of which no task holds all."""
    df = spark.range(10_000_000).select(F.lit("m").alias("metric"), ((F.col("id") * 7919) % 10_000_019).cast("double").alias("value"))
    want = df.stat.approxQuantile("value", [0.5], 0.0)[0]
    found = ag.benchmark(df).head()
    assert found["areas"] == 10_000_000 and abs(found["median"] - want) <= 2
    assert df.where(F.col("value") < found["median"]).count() == 5_000_000
