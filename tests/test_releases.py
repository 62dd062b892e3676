"""Two releases of records, compared."""

from __future__ import annotations

import json
import re

from cadastra.operators.releases import record_digests, release_problems


def test_problems_of_releases(spark):
    say = lambda status="ok", day="2026-01-02", **more: json.dumps({"status": status, "parts": [{"as_of": day, "v": 1}], **more})
    release = lambda rows: spark.createDataFrame(rows, "artifact string, record string, payload string")
    same = [(a, r, say()) for a in ("same", "shape", "added", "meaning", "back", "lost", "fell", "rose", "churned", "twice", "nameless", "broken", "free", "gone") for r in "1234"]
    base = release(same)
    changed = {
        ("shape", "2"): say(extra=1), ("meaning", "3"): say("no"), ("back", "1"): say(day="2026-01-01"), ("lost", "1"): say(day="unknown"),
        ("broken", "4"): None, ("free", "1"): say("no"), ("nameless", "4"): say(),
    }
    rows = [(a, None if (a, r) == ("nameless", "4") else r, changed.get((a, r), p)) for a, r, p in same if a != "gone" and (a, r) != ("fell", "4")]
    rows = [(a, "9" if (a, r) == ("churned", "1") else r, p) for a, r, p in rows]
    rows += [("new", "1", say()), ("added", "5", say(other=[])), *(("rose", str(i), say()) for i in range(5, 10)), ("twice", "1", say())]
    names = {a for a, _, _ in same} - {"free"}
    contracts = spark.createDataFrame([(a, 0.1, None, 0.2 if a == "churned" else 0.9) for a in names], "artifact string, fall double, rise double, churn double")
    got = {tuple(r) for r in release_problems(base, release(rows), contracts).collect()}
    assert got == {
        ("shape", "shape changed"), ("added", "shape changed"), ("meaning", "meaning changed"), ("back", "a record's time went back"), ("lost", "a record's time went back"),
        ("fell", "rows fell"), ("rose", "rows rose"), ("churned", "identities churned"), ("twice", "records repeat"), ("nameless", "records without an identity"),
        ("broken", "records that cannot be read"), ("broken", "shape changed"), ("broken", "meaning changed"), ("broken", "a record's time went back"),
        ("free", "no contract"), ("gone", "artifact is gone"), ("new", "artifact is new"),
    }
    assert release_problems(base.limit(0), base.limit(0), contracts).count() == 0
    digests, times = record_digests(release([(None, "1", "[1]"), ("a", "1", say()), ("a", "1", say("no"))]))
    assert {(r.artifact, r.record, r.copies) for r in digests.collect()} == {("", "1", 1), ("a", "1", 2)} and times.count() == 1


def test_records_are_never_broadcast(spark):
    """Files of digests are small against their rows, whatever Spark takes them for."""
    release = spark.createDataFrame([("a", "1", '{"as_of": "2026-01-02", "status": "ok"}')], "artifact string, record string, payload string")
    found = release_problems(release, release, spark.createDataFrame([("a", 0.1, None, 0.9)], "artifact string, fall double, rise double, churn double"))
    assert found.count() == 0 and not re.search(r"BroadcastHashJoin \[artifact#\d+, record#", found._jdf.queryExecution().executedPlan().toString())
