"""The pipeline's rows against a plain version of all of its stages."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from cadastra.llm import mixing, packing, quality
from tests.llm.conftest import edge_rows
from tests.llm.test_corpus import brute_pieces, one_by_one, word_sets
from tests.llm.test_texts import plain_features


def plain_good(text, field):
    """Whether the document's score reaches the cut: sums over labellings, a line at a time."""
    x, sizes = plain_features(text)
    odds = [math.exp(o) for o in np.clip(x @ field.weights, -30, 30)]
    moves = np.exp(field.moves).tolist()
    ahead, back = [(1.0, odds[0])], [(1.0, 1.0)]
    for o in odds[1:]:
        bad, good = ahead[-1]
        new = (bad * moves[0][0] + good * moves[1][0], (bad * moves[0][1] + good * moves[1][1]) * o)
        ahead.append((new[0] / sum(new), new[1] / sum(new)))
    for o in odds[:0:-1]:
        bad, good = back[-1][0], back[-1][1] * o
        new = (moves[0][0] * bad + moves[0][1] * good, moves[1][0] * bad + moves[1][1] * good)
        back.append((new[0] / sum(new), new[1] / sum(new)))
    good = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, reversed(back), strict=True)]
    mean = min(1 - 1e-4, max(1e-4, sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes)))
    return 1 / (1 + math.exp(-max(-40, min(40, field.slope * math.log(mean / (1 - mean)) + field.shift)))) >= quality.CUT


def plain_exact(rows):
    """Of equal texts the one with the most code points, then the smallest id, nulls last."""
    best = {}
    for r in rows:
        text = r["text"] or ""
        name, rank = text.translate({c: None for c in (32, *range(9, 14))}), (-len(text), r["doc_id"] is None, r["doc_id"] or 0)
        if name not in best or rank < best[name][0]:
            best[name] = rank, r
    return [r for _, r in best.values()]


def plain_near(rows, percent):
    """Of each component of linked sets the row of the smallest id, nulls last, then of the smallest MD5; rows without words all stay."""
    sets = [s for _, s in word_sets([(r["doc_id"], r["text"]) for r in rows])]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    groups, out = defaultdict(list), []
    for i, r in enumerate(rows):
        (groups[root(i)] if sets[i] else out).append(r)
    md5 = lambda t: hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest()
    return out + [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, md5(r["text"]))) for g in groups.values()]


def plain_mix(rows):
    """Each row as often as a Poisson draw of its source's mean says."""
    counts = Counter(r["source"] for r in rows)
    weight = {s: n**mixing.ALPHA for s, n in counts.items()}
    out = []
    for r in rows:
        mean = weight[r["source"]] * len(rows) / (sum(weight.values()) * counts[r["source"]])
        assert mean <= mixing.MAX_MEAN  # one draw each
        key = f"{mixing.SEED}|{'' if r['doc_id'] is None else r['doc_id']}|{hashlib.md5((r['text'] or '').encode(), usedforsecurity=False).hexdigest()}"
        u = int(hashlib.md5(f"{key}|1".encode(), usedforsecurity=False).hexdigest()[:13], 16) / (1 << 52)
        n, p, total = 0, math.exp(-mean), math.exp(-mean)
        while total <= u:
            n, p = n + 1, p * mean / (n + 1)
            total += p
        out += [r] * n
    return out


def test_pipeline_rows_are_those_of_plain_stages(spark, small_dir, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    own = spark.read.parquet(f"{small_dir}/documents.parquet").select(*columns)
    extra = spark.createDataFrame([(None if r[0] is None else r[0] + 10_000_000, *r[1:5]) for r in edge_rows()], own.schema)
    again = own.where("doc_id % 9 = 0").selectExpr("doc_id + 20000000 AS doc_id", "concat(text, ' once more') AS text", "lang", "source", "n_chars")
    folder = str(tmp_path / "tables")
    own.unionByName(extra).unionByName(again).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    field = quality.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    rows = docs.collect()
    sizes = [len(rows)]
    for stage in (lambda rs: [r for r in rs if plain_good(r["text"], field)], plain_exact, lambda rs: plain_near(rs, 80), plain_mix):
        rows = stage(rows)
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0 and sizes[4] > 0
    library, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        for piece, (start, length) in enumerate(brute_pieces(len(ids), packing.CAPACITY)):
            want[r["doc_id"], piece, start, length, zlib.crc32(np.array(ids[start : start + length], '<u4').tobytes())] += 1

    found = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) == one_by_one(Counter(r["length"] for r in found), packing.CAPACITY)
