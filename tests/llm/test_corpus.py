"""Packing, mixing, dedup, search, archives and url filters against plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadastra.llm import components, exact, knn, mixing, near, packing, registry, superminhash, urls, warc, words
from cadastra.llm.shared import new_folder, written
from tests.llm.conftest import edge_rows

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- packing

def one_by_one(counts, capacity):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [r for r in rooms if r >= length]
            if fitting:
                rooms.remove(min(fitting))
                rooms.append(min(fitting) - length)
            else:
                rooms.append(capacity - length)
    return len(rooms)


def brute_pieces(n, capacity):
    """(start, length) of each piece, cut from the end."""
    out = []
    while n > capacity:
        n -= capacity
        out.insert(0, (n, capacity))
    return [(0, n), *out]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 16, 50])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 80)))
        plan = packing.plan_best_fit(counts, capacity)
        assert plan.sequences == one_by_one(counts, capacity)
        fill = defaultdict(set)
        for length, n in counts.items():
            for rank in range(n):
                first, sequence, each, offset = [s for s in plan.slots[length] if s[0] <= rank][-1]
                place = (sequence + (rank - first) // each, offset + (rank - first) % each * length)
                assert not fill[place[0]] & set(range(place[1], place[1] + length))
                fill[place[0]] |= set(range(place[1], place[1] + length))
        assert all(s == set(range(len(s))) and len(s) <= capacity for s in fill.values())


def test_packed_pieces(spark, edges):
    rows = packing.pack_best_fit(edges, BYTE_BPE, capacity=64, keep_ids=True).collect()
    library = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in edge_rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        for k, (start, length) in enumerate(brute_pieces(len(ids), 64)):
            want[r[0], k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) == one_by_one(Counter(k[3] for k in want.elements()), 64)


def test_pieces_of():
    counts = [5, 20, 1, 23, 10, 11]
    text, piece, start, length = packing.pieces_of(np.array(counts), 10)
    want = [(i, k, *p) for i, n in enumerate(counts) for k, p in enumerate(brute_pieces(n, 10))]
    assert list(zip(text.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == want
    assert brute_pieces(23, 10) == [(0, 3), (3, 10), (13, 10)]


def test_packing_nothing(nothing):
    assert packing.pack_best_fit(nothing, BYTE_BPE).count() == 0


# --- mixing

def test_mix_follows_target_rates(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.col("id").cast("string").alias("text"))
    weights = spark.createDataFrame([("a", 6.0), ("b", 1.0), (None, 3.0), ("gone", 9.0)], "source string, weight double")
    got = {r["source"]: r["count"] for r in mixing.mix_sources(docs, weights, total=20_000).groupBy("source").count().collect()}
    assert abs(got["a"] - 12_000) < 500 and abs(got["b"] - 2_000) < 250 and abs(got[None] - 6_000) < 400
    rows = mixing.copies(docs, weights, total=900_000).groupBy("doc_id", "source").count().toPandas()  # a mean of 270
    a = rows[rows.source == "a"]["count"]
    assert abs(a.mean() - 270) < 3 and abs(a.var() / 270 - 1) < 0.15


def test_mix_of_awkward_rows(spark, edges, nothing):
    mixed = mixing.mix_sources(edges, total=500)
    assert mixed.columns == edges.columns
    counts = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert set(counts) <= {(r[0], r[1]) for r in edge_rows()} and 300 < sum(counts.values()) < 700
    assert counts == Counter((r["doc_id"], r["text"]) for r in mixing.mix_sources(edges.repartition(5), total=500).collect())
    assert mixing.mix_sources(nothing).count() == 0
    nothing_weighs = spark.createDataFrame([("a", -1.0), ("b", None)], "source string, weight double")
    assert mixing.mix_sources(edges, nothing_weighs).count() == 0
    crowded = clashing(edges)
    again = mixing.mix_sources(crowded, total=500)
    assert again.columns == crowded.columns
    assert counts == Counter((r["doc_id"], r["text"]) for r in again.collect())


def test_mix_with_too_many_sources_to_broadcast(edges, monkeypatch):
    want = Counter((r["doc_id"], r["text"]) for r in mixing.mix_sources(edges, total=500).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r["doc_id"], r["text"]) for r in mixing.mix_sources(edges, total=500).collect()) == want


def clashing(docs):
    """docs with columns named as operators name theirs within."""
    names = ["_name", "_sha", "_points", "_in", "_text", "_copy", "_shuffle", "_source", "_key", "_one", "draws", "cdf", "_salt", "component", "set_id", "node", "host", "rule", "_url", "_page", "_score", "_gram"]
    return docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


# --- exact dedup

@pytest.mark.parametrize("bits,capacity", [(60, 512), (5, 2), (1, 1)])
def test_exact_groups(edges, bits, capacity):
    groups = defaultdict(list)
    for r in edge_rows():
        groups[exact.normalised(r[1])].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    want = Counter()
    for r in edge_rows():
        own = groups[exact.normalised(r[1])]
        want[r[0], min(own, key=lambda x: x[:3])[3], len(own)] += 1
    found = exact.dedup_exact(edges, capacity, bits, 16).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in found)


def test_exact_keeps_one_row_of_each_group(edges, nothing):
    kept = exact.keep_rows(edges)
    assert kept.columns == edges.columns
    texts = [exact.normalised(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({exact.normalised(r[1]) for r in edge_rows()})
    assert exact.dedup_exact(nothing).count() == 0 and exact.keep_rows(nothing).count() == 0
    again = exact.keep_rows(clashing(edges))
    assert again.columns == clashing(edges).columns
    assert sorted(exact.normalised(r["text"]) for r in again.collect()) == sorted(texts)


def test_buckets_are_split_beyond_the_directory():
    cells = {0: 4, 1: 100, 2: 0, 3: 5}
    depths = exact.bucket_depths(cells, capacity=5, max_depth=2, bits=60)
    assert depths.tolist() == [2, 2 + 5, 1, 1]  # 100 / 2 ** 5 keys a bucket; the last two cells are one bucket of 5
    assert exact.bucket_depths({}, 5, 2, 60).tolist() == [0] * 4
    assert max(exact.bucket_depths({1: 10**6}, 1, 2, 8)) == 8


def test_exact_with_a_small_directory(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id div 2) AS text").repartition(3)
    for max_depth in (0, 1, 3):
        rows = exact.dedup_exact(docs, capacity=4, max_depth=max_depth).collect()
        assert all(r["keep_id"] == r["doc_id"] // 2 * 2 and r["group_size"] == 2 for r in rows) and len(rows) == 3000


def test_directory_splits_overfull_buckets():
    cells = {p: 1 for p in range(16)} | {3: 100}
    places = exact.directory(cells, capacity=4, max_depth=4)
    assert len(places) == 16 and places[3] not in [*places[:3], *places[4:]]
    sizes = Counter()
    for p in range(16):
        sizes[places[p]] += cells[p]
    assert all(n <= 4 or b == places[3] for b, n in sizes.items())
    assert all(len({i for i, x in enumerate(places) if x == b}) & (len({i for i, x in enumerate(places) if x == b}) - 1) == 0 for b in set(places))
    assert exact.directory({}, 4, 4) == [0]


# --- near dedup

def word_sets(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_components(rows):
    sets = word_sets(rows)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        known = least.get(root(i))
        least[root(i)] = doc_id if known is None or (doc_id is not None and doc_id < known) else known
    return Counter((doc_id, len(s), least[root(i)]) for i, (doc_id, s) in enumerate(sets))


def near_rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([8, 60, 150, 300]))]
        for _ in range(14):  # a chain of edits: ends differ, neighbours are alike
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows += [" ".join([*passage, *(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))]) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_components_are_those_of_all_pairs(spark):
    rows = near_rows()
    found = near.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_with_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 3)
    rows = near_rows()[:90]
    found = near.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)


def test_near_of_awkward_rows(edges, nothing):
    rows = [r for r in edge_rows()]
    found = near.near_components(edges).collect()
    # rows of equal sets share the smallest id; empty sets stand alone, each by its own id
    want = brute_components([(r[0], r[1]) for r in rows if word_sets([(0, r[1])])[0][1]])
    want += Counter((r[0], 0, r[0]) for r in rows if not word_sets([(0, r[1])])[0][1])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want
    assert near.near_components(nothing).count() == 0
    kept = near.keep_first(edges)
    assert kept.columns == edges.columns and near.keep_first(nothing).count() == 0
    stay = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert stay == Counter((r["doc_id"], r["text"]) for r in near.keep_first(clashing(edges)).select("doc_id", "text").collect())
    # one row of each component, and every row without words
    components = {c for _, n, c in want if n}
    assert sum(stay.values()) == len({(n, c) for _, n, c in want if n and c is None} | {c for c in components if c is not None}) + sum(k for (_, n, _), k in want.items() if not n)


def test_near_keeps_rows_not_ids(spark):
    one, two = "the river was calm and the people of the town walked home", "a wholly other text of which no shingle is in the first one"
    rows = [(1, one), (None, one), (1, two), (None, two), (None, "and a third text without any id but with words enough"), (7, one + " again and then again with a good many other words behind")]
    kept = Counter((r["doc_id"], r["text"]) for r in near.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == Counter([(1, one), (1, two), rows[4], rows[5]])


def test_near_at_another_limit(spark):
    rng = random.Random(8)
    rows = []
    for i in range(0, 80, 2):  # 5-word shingles: 96 and 96, of which 86 are common (86 / 106 = 0.811)
        words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        other = words[:-10] + [f"v{rng.randrange(10**9)}" for _ in range(10)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.count() == near.keep_first(docs, percent=85).count() == 80
    assert {r["doc_id"] for r in near.keep_first(docs, percent=80).collect()} == set(range(0, 80, 2))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(0, 80, 2))
    assert near.bands_for(85) == 28 and (1 - 0.8**near.ROWS) ** near.bands_for(80) < 1e-7


def slow_superminhash(values, m):
    h = [None] * m
    for v in values:
        p = list(range(m))
        for j in range(m):
            drawn = int(words.mix(np.array([(v + ((j + 1) * superminhash.GOLDEN)) & (2**64 - 1)], np.uint64))[0])
            k = j + (((drawn & 0xFFFFFFFF) * (m - j)) >> 32)
            p[j], p[k] = p[k], p[j]
            offer = (j << 32) | (drawn >> 32)
            h[p[j]] = offer if h[p[j]] is None else min(h[p[j]], offer)
    return h


def test_signatures_are_those_of_whole_permutations():
    rng = np.random.default_rng(2)
    counts = np.array([1, 0, 3, 40, 200])
    values = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64)
    got = superminhash.signatures(values, counts, 24)
    at = 0
    for n, row in zip(counts, got, strict=True):
        if n:
            assert row.tolist() == slow_superminhash(values[at : at + n].tolist(), 24)
        at += n


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    got = superminhash.signatures(np.concatenate([common, a, common, b]), np.array([800, 800]), 400)
    assert abs((got[0] == got[1]).mean() - 0.6) < 0.08


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, 5001 + i) for i in range(300)]
    rng.shuffle(links)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert found == {x: root(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- search

def test_top_k_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, None), (2001, [0.1, None] + [0.0] * 10), (2050, [float("nan")] * 12), (2100, [float("inf")] * 12), (None, rows[0][1]), (2150, []), (2200, rows[5][1][:6]), (100, rows[100][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    usable = [(i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in usable if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)}
    for block, pivots in ((2048, 64), (16, 5)):
        found = knn.top_k(df, F.col("vec_id") % 50 == 0, 5, block=block, pivots=pivots).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0])] + [(0, [5.0 + i, 0.0]) for i in range(9)] + [(i, [4.0 - i / 100, 0.0]) for i in range(1, 20)] + [(60, [9.0, 0.0])] * 3
    found = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5, block=4, pivots=3).collect()
    queries = {tuple(v) for i, v in rows if i == 0}
    pairs = sorted((-sum(int(256 * a) * int(np.floor(256 * b)) for a, b in zip(q, v, strict=True)), i) for q in queries for i, v in rows if i != 0)[:5]
    assert [(r["vec_id"], -r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(i, s) for s, i in pairs]
    one = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + rows[10:]
    found = knn.top_k(spark.createDataFrame(one, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5, block=4, pivots=3).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == [60, 60, 60, 1, 2]
    same = [(0, [1.0])] * 8 + [(i, [1.0]) for i in range(1, 9)]
    assert [r["vec_id"] for r in sorted(knn.top_k(spark.createDataFrame(same, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect(), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]


def test_top_k_refuses_what_it_cannot_hold(spark):
    for big in (1e30, 2.0**46, 2.0**40):
        with pytest.raises(Exception, match="2 \\*\\* 53|64 bits"):
            knn.top_k(spark.createDataFrame([(0, [big] * 3), (1, [big] * 3)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()


def test_blocks_go_to_those_who_asked(spark):
    blocked = spark.createDataFrame([(c, r, 0, [c], [c * 10 + i]) for c in range(3) for r in range(2) for i in range(4)], "cell int, ring int, part int, v array<long>, ids array<long>")
    sent = spark.createDataFrame([(0, 0, 0, 5, 1), (0, 0, 0, 5, 2), (0, 0, 0, 6, 3), (2, 1, 0, 7, 4)], "cell int, ring int, part int, chunk int, query_id long")
    copied = Counter((r["cell"], r["ring"], r["chunk"]) for r in knn.copies_of(blocked, sent).collect())
    assert copied == {(0, 0, 5): 4, (0, 0, 6): 4, (2, 1, 7): 4}


def test_few_blocks_are_needed(spark, monkeypatch):
    """Queries near their own cluster reach its blocks only."""
    rng, seen = np.random.default_rng(1), []
    centres = 40 * np.eye(16)
    rows = [(i, (centres[i % 16] + rng.normal(size=16)).tolist()) for i in range(1600)]
    own = knn.copies_of
    monkeypatch.setattr(knn, "QUERIES", 4)
    monkeypatch.setattr(knn, "copies_of", lambda blocked, sent: seen.append((blocked.count(), own(blocked, sent).count(), sent.select("chunk").distinct().count())) or own(blocked, sent))
    assert knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5).count() == 160
    all_rows, copied, chunks = seen[0]
    assert chunks > 3 and copied < all_rows * chunks / 2


def test_one_id_of_many_vectors_changes_nothing_for_others(spark, monkeypatch):
    rng, sent = np.random.default_rng(2), []
    centres = 40 * np.eye(16)
    rows = [(i, (centres[i % 16] + rng.normal(size=16)).tolist()) for i in range(1600)]
    more = [(centres[i % 16] + rng.normal(size=16)).tolist() for i in range(800)]
    own = knn.copies_of
    monkeypatch.setattr(knn, "copies_of", lambda blocked, s: sent.append(Counter(r["query_id"] for r in s.collect())) or own(blocked, s))
    for extra in ([(0, v) for v in more], [(10_001 + 50 * i, v) for i, v in enumerate(more)]):
        found = knn.top_k(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 5, block=64)
        assert found.count() == 160
    hot, plain = sent
    assert hot.pop(0) > plain.pop(0)
    assert hot == plain


def test_top_k_sent_in_small_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(400)] + [(400 + i, [0.5] * 12) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 50 == 0, 5, block=16, pivots=5).collect()}
    monkeypatch.setattr(knn, "SENT", 24)
    monkeypatch.setattr(knn, "BOUNDS", 1)
    monkeypatch.setattr(knn, "SUMMARIES", 10)
    assert {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 50 == 0, 5, block=16, pivots=5).collect()} == want and len(want) == 50


def test_pivots_grow_with_the_root_of_vectors():
    assert [knn.pivots_for(n, 2048) for n in (0, 10**4, 10**6, 10**7, 10**9)] == [64, 64, 488, 3162, 4096]


def test_nth_largest():
    m = np.array([[3, 1, 2], [9, 7, 8], [5, 5, 4]])
    assert knn.nth_largest(m, np.array([1, 2, 7])).tolist() == [3, 8, 4]


def test_top_k_of_few(spark):
    two = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in knn.top_k(two, F.col("vec_id") % 50 == 0, 5).collect()} == {(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)}
    assert knn.top_k(two.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# --- archives

def test_archives_round_trip(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (7, None, "same"), (3, "http://a/3\r\nX: y", "other ü"), (4, "u", None), (5, "u", ""), (None, "v", "no id"), (None, "v", "no id"), (9, "w", "x" * 3_000_000), (8, "w", "x" * 3_000_000), (6, "t", "same"), (7, "z", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    found = warc.resolved(warc.read_headers(warc.archive_pages(pages, new_folder(spark, "t")))).collect()
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page is None else page)
    assert Counter((r["page_id"], r["target"], r["payload_bytes"], r["payload_digest"]) for r in found) == Counter((p, u, len((h or "").encode()), warc.digest_of((h or "").encode())) for p, u, h in rows)
    assert sum(r["record_type"] == "response" for r in found) == len(best)
    digests = {warc.digest_of(h.encode()): i for h, i in best.items()}
    for r in found:
        top = digests[r["payload_digest"]]
        if r["record_type"] == "response":
            assert r["refers_to"] is None and (r["page_id"] if r["page_id"] is not None else -1) == top
        else:
            assert r["refers_to"] == (None if top == -1 else top)
    assert warc.resolved(warc.read_headers(warc.archive_pages(pages.limit(0), new_folder(spark, "t")))).count() == 0
    small = warc.resolved(warc.read_headers(warc.archive_pages(pages, new_folder(spark, "t"), min_bytes=5))).collect()
    assert sum(r["record_type"] == "revisit" for r in small) == 2  # the long pair and the two without id


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "string"])
def test_archives_of_other_ids(spark, kind):
    pages = spark.createDataFrame([(1, "same"), (2, "same"), (None, "x"), (3, None)], "n int, html string").select(F.col("n").cast(kind).alias("page_id"), F.lit("u").alias("url"), "html")
    found = warc.resolved(warc.read_headers(warc.archive_pages(pages, new_folder(spark, "t")), kind))
    assert found.schema["page_id"].dataType == pages.schema["page_id"].dataType
    rows = {None if r["page_id"] is None else int(r["page_id"]): None if r["refers_to"] is None else int(r["refers_to"]) for r in found.collect()} if kind != "string" else {r["page_id"] and int(r["page_id"]): r["refers_to"] and int(r["refers_to"]) for r in found.collect()}
    assert rows == {1: 2, 2: None, None: None, 3: None}


def test_damaged_archive():
    whole = warc.record([("WARC-Type", "response")], b"abc")
    import io

    assert [warc.parse(raw)[1] for _, raw in warc.members(io.BytesIO(whole + whole))] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-4])))


# --- urls

def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0] if rest[len(host) :].startswith("/") else ""
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else (None, None)


def test_url_rules_and_ratio(spark, small_dir):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://x.net/es/", "http://net/fr/1", "http://a.com", "http://a.com?q=/en/", "http://b.example.com/en/1", "x://y://z/p#q?r", "http://é.org/ü", "http://a.com/", "http://mycom/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(odd)], "page_id long, url string").unionByName(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url"))
    model_rows = urls.filter_urls(pages).collect()
    assert len(model_rows) == pages.count()
    for r in model_rows:
        host, path = brute_parts(r["url"])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def counted(labelled, order):
    counts = {True: Counter(), False: Counter()}
    for url, good in labelled:
        text = urls.START + url
        for at in range(1, len(text)):
            for n in range(1, min(order + 1, at + 1) + 1):
                counts[good][text[at - n + 1 : at + 1]] += 1
    return counts


def log_ratio(counts, gram):
    """Of the interpolated models, for any last character after any context."""

    def p(good, gram):
        if gram == "":
            return 1 / 128
        total = sum(c for g, c in counts[good].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (counts[good][gram] + urls.STRENGTH * p(good, gram[1:])) / (total + urls.STRENGTH)

    return np.log(p(True, gram) / p(False, gram))


def url_score(counts, url, order):
    text = urls.START + url
    return sum(log_ratio(counts, text[max(0, at - order) : at + 1]) for at in range(1, len(text))) / len(url) if url else 0.0


def test_url_models_against_counting(spark):
    labelled = [("a.com/x", True), ("a.com/y", True), ("b.net/q", False), ("b.net/qq", False), ("b.org/q", False)]
    model = urls.ratio_model(spark.createDataFrame(labelled, "_url string, _accept boolean"), order=2)
    counts = counted(labelled, 2)
    found = {r["_gram"]: r["_value"] for r in model.where("_kind = 'g'").collect()}
    assert set(found) == set(counts[True]) | set(counts[False])
    for gram, value in found.items():
        assert np.isclose(value, log_ratio(counts, gram))
    asked = ["a.com/q", "", "ZZ", "b.net/xx", "a.cz", "qqqq", "\u00fc", "a.\u00fcm/x"]
    scored = {r["_url"]: r["_score"] for r in urls.scored(spark.createDataFrame([(u,) for u in asked], "_url string"), model, order=2).collect()}
    for url in asked:
        assert np.isclose(scored[url], url_score(counts, url, 2)), url


def test_url_verdicts_are_those_of_plain_models(spark):
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(2, 7)))
    rows = [f"http://{word('abcde')}.com/{word('abcxyz')}" for _ in range(60)] + [f"http://{word('vwxyz')}.net/{rng.choice(['es', 'fr'])}/{word('uvwabc')}" for _ in range(60)]
    rows += [f"http://{word('abcdevwxyz')}.org/{word('abcuvw')}" for _ in range(40)] + ["http://q.info", "", None, "no scheme", "http://"]
    pages = clashing(spark.createDataFrame([(i, u) for i, u in enumerate(rows)], "page_id long, url string"))
    result = urls.filter_urls(pages)
    assert set(result.columns) == {*pages.columns, *urls.OWN} and len(result.columns) == len(set(result.columns))
    found = {r["page_id"]: r for r in result.collect()}
    spell = lambda u: re.sub("^[^:]*://", "", u or "").lower()
    judged = [(spell(u), *brute_rule(*brute_parts(u))) for u in rows]
    labelled = [(u, verdict == "allow") for u, rule, verdict in judged if rule]
    apart = lambda u: zlib.crc32(u.encode()) % 5 == 0
    counts = counted([x for x in labelled if not apart(x[0])], urls.ORDER)
    held = [(url_score(counts, u, urls.ORDER), good) for u, good in labelled if apart(u)]
    bins = sorted({int(np.floor(s / urls.BIN)) for s, _ in held})
    good, bad = sum(g for _, g in held), sum(not g for _, g in held)
    assert good and bad
    # every cut between two bins, and one above all: the middle one of the best, each between its bins
    cuts = [(bins[0], bins[0])] + [(a + 1, b) for a, b in zip(bins, bins[1:], strict=False)]
    right = [(sum(g and np.floor(s / urls.BIN) >= c[1] for s, g in held) / good + sum(not g and np.floor(s / urls.BIN) < c[1] for s, g in held) / bad) for c in cuts]
    best = [c for c, r in zip(cuts, right, strict=True) if r > max(right) - 1e-9]
    cut = (bins[-1] + 1) * urls.BIN if max(right) < 1 else sum(best[len(best) // 2]) / 2 * urls.BIN
    for i, (u, rule, verdict) in enumerate(judged):
        r = found[i]
        assert r["rule"] == rule
        if rule:
            assert (r["verdict"], r["score"]) == (verdict, None)
        else:
            score = url_score(counts, u, urls.ORDER)
            assert np.isclose(r["score"], score) and r["verdict"] == ("allow" if score >= cut else "block")


def test_url_filter_learns(spark):
    rows = [(i, f"http://good{i % 7}.com/news/{i}") for i in range(300)] + [(1000 + i, f"http://x{i % 5}.net/es/cheap-pills-{i}") for i in range(300)]
    rows += [(5000, "http://good.org/news/4"), (5001, "http://y.info/es/cheap-pills-5")]
    found = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[5000] == "allow" and found[5001] == "block"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_keeps_every_gram(spark):
    rng = random.Random(5)
    labelled = [("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60)), i % 2 == 0) for i in range(1200)]
    padded = [urls.START + url for url, _ in labelled]
    every = {t[at - n + 1 : at + 1] for t in padded for at in range(1, len(t)) for n in range(1, min(5, at + 1) + 1)}
    assert len(every) > 150_000
    frame = spark.createDataFrame(labelled, "_url string, _accept boolean")
    model = urls.ratio_model(frame)
    assert model.where("_kind = 'g'").count() == len(every)
    value = {r["_gram"]: r["_value"] for r in model.where("_kind = 'g'").collect()}
    for r in urls.scored(frame.limit(50), model).collect():
        t = urls.START + r["_url"]
        assert np.isclose(r["_score"], sum(value[t[max(0, at - 4) : at + 1]] for at in range(1, len(t))) / 60)


# --- all together

def test_queries_are_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_dir)
        assert out.columns == docs.columns
        path = new_folder(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    rows = corpus_pipeline.run(spark, small_dir)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
    library = Tokenizer.from_file(BYTE_BPE)
    want = sum(len(brute_pieces(len(library.encode(r["text"], add_special_tokens=False).ids) + 1, 1024)) for r in docs.collect())
    assert rows.count() == want


def test_pipeline_stages_on_awkward_rows(spark, edges, nothing, small_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edges.select(*columns), nothing.select(*columns)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small_dir).collect()


def test_near_dedup_reads_a_text_once_however_often_its_id_comes(spark):
    """Rows without an id are told apart by their texts: not each text for each set."""
    rows = [(None, " ".join(f"w{i % 500}x{k}" for k in range(30))) for i in range(1000)] + [(5, "the same few words of one row again")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = near.sketches(docs).where("n_shingles > 0").groupBy("set_id").agg(F.min("text_md5").alias("first_md5"), F.first("doc_id").alias("first_id"))
    wanted = written(sets.withColumn("node", F.monotonically_increasing_id()), "t")
    assert near.full_sets(docs, wanted).count() == wanted.count() == 501
    assert near.texts_of(docs, wanted).count() == docs.count()
    assert {r["n_shingles"] for r in near.near_components(docs).collect()} == {26, 4}
