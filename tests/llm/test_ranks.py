"""BPE by ranks, and alignment of two vocabularies, against the libraries and plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import struct
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cadastra.llm import alignment, ranks
from cadastra.llm.shared import written
from tests.llm.conftest import edge_rows

BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MARKS = [*"abzAZéßÿ×÷ñ \n\t\r\x1c\x85\xa0  　​.,!?'<|>-_“—;01²½日кر̸́\x01KİΣ😀", "<|endoftext|>", "<s>", "<0x41>", "'ll", " the", "\n\n", "   ", "ing"]


def drawn(rng: random.Random, n: int, extra: tuple[str, ...] = ()) -> list[str]:
    return ["".join(rng.choices([*MARKS, *extra], k=rng.choice([0, 1, 2, 5, 20, 300]))) for _ in range(n)]


def test_ids_and_texts_are_the_library_s(small_dir):
    own, library = ranks.RankEncoder(BYTE_LEVEL, max_chunks=900, window=997), Tokenizer.from_file(BYTE_LEVEL)
    texts = [r[1] or "" for r in edge_rows()] + drawn(random.Random(5), 600, ("aaaaaaaa" * 20, "=" * 200)) + ["ab" * 30_000, "é" * 5000]
    texts += list(pd.read_parquet(f"{small_dir}/documents.parquet").text[:60])
    flat, counts = own.encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    assert own.decode(flat, counts).to_pylist() == [library.decode(ids, skip_special_tokens=False) for ids in want]


def test_decodes_any_ids():
    """Parts of characters, and ids that the vocabulary lacks."""
    own, library, rng = ranks.rank_encoder(BYTE_LEVEL), Tokenizer.from_file(BYTE_LEVEL), random.Random(6)
    rows = [[rng.randrange(60_000) if rng.random() < 0.7 else rng.randrange(256) for _ in range(rng.randrange(12))] for _ in range(500)]
    got = own.decode(np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows]))
    assert got.to_pylist() == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_merges_of_long_and_short_words_agree():
    merges, rng = ranks.Merges(BYTE_LEVEL), random.Random(7)
    for _ in range(200):
        word = "".join(rng.choices("abtheingoĠ", k=rng.randrange(1, 65)))
        assert merges.merge([word])[0].tolist() == merges.merge_long(merges.letter_ids[list(map(ord, word))].tolist())


def test_encode_and_decode_rows(spark, edges, nothing):
    library = Tokenizer.from_file(BYTE_LEVEL)
    found = ranks.decode(ranks.encode(edges, BYTE_LEVEL), BYTE_LEVEL).collect()
    want = Counter((r[0], struct.pack(f"<{len(ids := library.encode(r[1] or '', add_special_tokens=False).ids)}I", *ids), r[1] or "") for r in edge_rows())
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in found) == want
    assert ranks.decode(ranks.encode(nothing, BYTE_LEVEL), BYTE_LEVEL).count() == 0
    gone = spark.createDataFrame([(1, None), (None, b"")], "doc_id long, ids binary")
    assert [r.decoded for r in ranks.decode(gone, BYTE_LEVEL).collect()] == ["", ""]


def test_op11(spark, small_dir):
    library = Tokenizer.from_file(BYTE_LEVEL)
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")
    want = set()
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    found = ranks.op11_rank_array(spark, small_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert {tuple(r) for r in found.collect()} == want


def test_refuses_other_vocabularies():
    with pytest.raises(ValueError, match="byte-level"):
        ranks.Merges(public_tokenizers.path("word_bpe_49k.json"))


# alignment


def test_pieces_are_the_library_s(small_dir):
    own, library = alignment.PieceEncoder(PIECES, max_chunks=700, window=499), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in [r[1] for r in edge_rows()] + drawn(random.Random(8), 600) + list(pd.read_parquet(f"{small_dir}/documents.parquet").text[:60]) if t]
    flat, counts = own.encode(pa.array([" " + t for t in texts]))
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_galloping(seed):
    rng = random.Random(seed)
    a, b = (np.array(sorted(rng.sample(range(3000), rng.choice([0, 1, 2, 7, 100, 900]))), np.int64) for _ in range(2))
    assert alignment.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
    i, j = alignment.meeting(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_overlaps():
    rng = random.Random(3)
    for _ in range(50):
        a, b = (np.array(sorted({*rng.sample(range(1, 60), rng.randrange(40)), 60})) for _ in range(2))
        spans = [list(itertools.pairwise([0, *x.tolist()])) for x in (a, b)]
        want = [[j for j, (s, e) in enumerate(spans[1]) if s < end and start < e] for start, end in spans[0]]
        first, past = alignment.overlaps(a, b)
        assert [list(range(f, p)) for f, p in zip(first.tolist(), past.tolist(), strict=True)] == want


def plain_alignment(rows: list[tuple]) -> Counter:
    """What op12 returns, by plain loops."""
    a_of, b_of = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    vocab, letters = {i: t for t, i in a_of.get_vocab().items()}, {}
    others = 256
    for byte in range(256):
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255
        letters[chr(byte if plain else others)] = byte
        others += not plain
    linked, counts = [], Counter()
    for doc_id, text in rows:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in vocab[i]) for i in a]
        b_bytes = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", p := b_of.id_to_piece(i))) else p.replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            linked.append((doc_id, 0, 0, [], []))
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes)]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            to_i, to_j = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:to_i], b[j:to_j]))
            i, j = to_i, to_j
        links = [(x[-1], y[-1]) for x, y in groups]
        counts.update(links)
        linked.append((doc_id, len(a), len(b), groups, links))
    most: dict[int, int] = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = Counter()
    for doc_id, n_a, n_b, groups, links in linked:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[(doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else "")] += 1
    return out


def test_op12(spark, tmp_path, small_dir):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(100 + i, t) for i, t in enumerate(drawn(random.Random(9), 80, ("word", " a", "▁")))]
    rows += list(pd.read_parquet(f"{small_dir}/documents.parquet")[["doc_id", "text"]][:80].itertuples(index=False, name=None))
    (tmp_path / "t").mkdir()
    spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, chunk string, pairs int").repartition(5).write.parquet(f"{tmp_path}/t/documents.parquet")
    found = alignment.op12_gallop_align(spark, f"{tmp_path}/t")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == plain_alignment(rows)


@pytest.mark.parametrize("chunk_bytes", [1, 3000])
def test_chunks_change_nothing(spark, small_dir, chunk_bytes):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(60)
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    one, other = (Counter(tuple(r) for r in alignment.link_sums(written(alignment.align(docs, BYTE_LEVEL, PIECES, n), "t")).select(*names).collect()) for n in (1 << 23, chunk_bytes))
    assert one == other


def test_alignment_of_nothing(nothing):
    assert alignment.link_sums(written(alignment.align(nothing, BYTE_LEVEL, PIECES), "t")).count() == 0
