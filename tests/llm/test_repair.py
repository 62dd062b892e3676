"""The repair of conversations against a plain search over states."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadastra.llm import repair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_search(turns: list[tuple[str, str]], faults: list[str]) -> tuple[int, str, list[tuple[str, str]]]:
    """The cheapest, then least edits: every path in order of cost and letters, a state once."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, state, left = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, left
        if (i, state) in done:
            continue
        done.add((i, state))
        ways = after[state]
        for role in ("user", "assistant"):
            if role[0] in ways:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], [*left, (role, "")]))
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, left))
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role[:1] in ways:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], [*left, (role, text)]))
                for other in ("user", "assistant"):
                    if other[0] in ways:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, other[0], [*left, (other, text)]))
    raise AssertionError


def plain_repair(rows: list[tuple], ids) -> set[tuple]:
    of: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        of[conv].append((turn is not None, turn or 0, role, text))
    out = set()
    for conv in ids:
        turns = sorted(of[conv])
        faults, seen = [], set()
        for _, _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for has, t, _, _ in turns if has]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[:1] for _, _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, left = plain_search([(r, t) for _, _, r, t in turns], faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.add((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


def drawn(seed: int, convs: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", " \t", "", "Really?\n", "é ü。", "a. ", "x" * 700 + ".", "x" * 700 + "!", None]
    roles = ["user", "assistant", "system", "tool", "User", "", None, "ally"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.choice([1, 2, 3, 5, 9, 40])):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"Said {rng.randrange(99)}."))
    return rows


@pytest.mark.parametrize("bits", [16, 2, 0])
def test_repair_in_blocks_of_any_size(spark, tmp_path, monkeypatch, bits):
    """Runs of one turn, of four, and whole conversations: the result is that of the plain search."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rows = drawn(1, 60)
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(4).write.parquet(f"{tmp_path}/t/conversations.parquet")
    found = repair.op13_path_ranks(spark, f"{tmp_path}/t")
    assert sorted(found.columns) == sorted(COLUMNS)
    assert {tuple(r) for r in found.select(*COLUMNS).collect()} == plain_repair(plain_damage(rows), {r[0] for r in rows})
    assert found.count() == len({r[0] for r in rows})


def test_op13(spark, small_dir):
    rows = list(pd.read_parquet(f"{small_dir}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert {tuple(r) for r in repair.op13_path_ranks(spark, small_dir).select(*COLUMNS).collect()} == plain_repair(plain_damage(rows), {r[0] for r in rows})


def test_one_conversation_of_many_turns(spark):
    """It lies in several partitions; repeats of one row come apart, too."""
    rows = [(7, i // 3, ("user", "assistant", "system")[i % 3], f"Said {i % 500}." if i % 5 else "the same") for i in range(3000)] + [(7, 5, "user", "Again.")] * 1000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = repair.Repair(df)
        assert done.turns.select(F.shiftright("pos", 33).alias("part")).groupBy("part").count().agg(F.max("count")).head()[0] < 3000
        (want,) = plain_repair(rows, {7})
        assert (done.chain.where("first").head()["cost"], done.audits().head()["audit"], done.texts().head()["repaired_sha256"]) == want[6:9]
        assert done.chain.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_order_whole_audits():
    """Ranks of doubled lengths order the nodes of a random path graph as their whole audits do."""
    rng = np.random.default_rng(3)
    letter, to = rng.integers(1, 5, 400), np.arange(400)
    for i in range(400):
        to[i] = rng.integers(i + 1, min(400, i + 9)) if i < 399 else i
    letter[399] = 0
    audits = []
    for i in range(400):
        said = ""
        while letter[i]:
            said, i = said + repair.LETTERS[letter[i] - 1], to[i]
        audits.append(said)
    _, rank = repair.doubled(letter, to)
    places = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert rank.tolist() == [places[a] for a in audits]


def test_no_rows(spark):
    done = repair.Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.edits().count() == done.texts().count() == done.counts().count() == 0
