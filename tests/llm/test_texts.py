"""Token ids, quality, languages and id files against plain Python."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadastra.llm import language, planes, quality
from cadastra.llm.shared import new_folder
from cadastra.llm.tokens import Encoder, with_end
from tests.llm.conftest import edge_rows


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name, small_dir):
    own, library = Encoder(public_tokenizers.path(name), max_chunks=500), Tokenizer.from_file(public_tokenizers.path(name))
    texts = [r[1] for r in edge_rows()] + ["a  b", "a\n b", " x", "it's we'll", "x \t y", "a\u3000 b", "tail ", "\u0301a \u0301b"] + list(pd.read_parquet(f"{small_dir}/documents.parquet").text[:60])
    flat, counts = own.encode(pa.array(texts))
    for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
    alphabet = [*"abzAZéßÿ×÷ñ \n\t\r\x1c\x85\xa0\u2003\u2028\u3000\u200b.,!?'<|>-_\u201c\u2014\u037e01²½日кر\u0301\u0338\x01\u212aİΣ", "<|endoftext|>", "'s", "'ll", " the", "\n\n", "  ", " \x01 "]
    rng, narrow = random.Random(4), Encoder(public_tokenizers.path(name), max_chunks=300, window=97)
    for _ in range(20):  # borders of every kind, windows that end anywhere, chunks forgotten and learned again
        texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 5, 20, 300]))) for _ in range(50)]
        for encoder in (own, narrow):
            flat, counts = encoder.encode(pa.array(["before", *texts]).slice(1))
            assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    flat, counts = with_end(*own.encode(pa.array(["", None])))
    assert flat.tolist() == [2, 2] and counts.tolist() == [1, 1]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    packed = planes.to_planes(ids, kind)
    assert len(packed) == (4 if kind == "byte" else 32)
    assert planes.from_planes(packed, n, kind).tolist() == ids.tolist() if n else True


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_id_files(spark, edges, kind):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = planes.write_planes(edges, new_folder(spark, "t"), path, kind)
    found = planes.read_planes(files, keep_ids=True).collect()
    library = Tokenizer.from_file(path)
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in edge_rows())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: -1 if x is None else x)


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,2)", "string", "date"])
def test_id_files_with_other_ids(spark, kind):
    docs = spark.createDataFrame([(1, "a"), (2, "b c"), (None, "d"), (7, None)], "n int, text string")
    own = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    docs = docs.select(own.alias("doc_id"), "text")
    files = planes.write_planes(docs, new_folder(spark, "t"), public_tokenizers.path("word_bpe_49k.json"))
    found = planes.read_planes(files, kind)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(r["doc_id"] for r in docs.collect())


def test_id_files_of_nothing(spark, nothing):
    files = planes.write_planes(nothing, new_folder(spark, "t"), public_tokenizers.path("word_bpe_49k.json"))
    assert planes.read_planes(files).count() == 0


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        scores, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(s for s, v in zip(scores, y, strict=True) if v) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, good = total + w, good + w * np.array(y)
        found, expected = quality.marginals(np.concatenate([scores, scores[:1]]), np.array([n, 1]), moves)
        assert np.allclose(found[:n], good / total)
        assert np.isclose(expected.sum(), n - 1)


def plain_features(text):
    """Each line's features, its neighbours', and whether it is the first or last, from its bytes."""
    own = []
    lines = (text or "").encode().split(b"\n")
    for line in lines:
        n, count = max(1, len(line)), {k: sum(line.count(bytes([b])) for b in members) for k, members in quality.CLASSES.items()}
        letters, words, spaced = count["upper"] + count["lower"], count["blank"] + 1, line.split()
        upper, noise = count["upper"] / max(1, letters), count["noise"] / n
        own.append([
            not line, np.log1p(len(line)) / 8, upper, upper > 0.6, min(1, 5 * noise), noise > 0.04, min(1, count["pipe"] / words), count["pipe"] / words > 0.2,
            min(1, count["bang"] / words), count["bang"] / words > 0.2, count["digit"] / n, min(1, 4 * count["stop"] / n), letters / n, min(2, n / words / 10),
            line.endswith((b"|", b">")), len(line) > 400, sum(a == b for a, b in zip(spaced, spaced[1:], strict=False)) / words,
        ])
    none = [0.0] * quality.OWN
    rows = [[*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), i == 0, i == len(own) - 1, 1] for i in range(len(own))]
    return np.array(rows, float), [max(1, len(line)) for line in lines]


def plain_score(text, field):
    """The document's score from all labellings of its lines."""
    x, sizes = plain_features(text)
    odds = np.clip(x @ field.weights, -30, 30)
    total, good = 0.0, np.zeros(len(odds))
    for y in itertools.product((0, 1), repeat=len(odds)):
        w = np.exp(sum(o for o, v in zip(odds, y, strict=True) if v) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False)))
        total, good = total + w, good + w * np.array(y)
    mean = min(1 - 1e-4, max(1e-4, float(np.dot(good / total, sizes) / sum(sizes))))
    return 1 / (1 + np.exp(-np.clip(field.slope * np.log(mean / (1 - mean)) + field.shift, -40, 40)))


def test_quality_scores_are_those_of_all_labellings(spark):
    rng = np.random.default_rng(6)
    lines = ["The river was calm, and the people went home.", "BUY NOW!!! | $$$ | CLICK HERE | 100% |", "", "a a a a b", "Ünïcode líne, 12:30 ...", "x" * 450, "> quoted <b>", "the the end\t|"]
    rows = [(i, "\n".join(rng.choice(lines, rng.integers(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (None, "no id\nat all"), (102, "\n\n"), (102, "same id")]
    field = quality.Field(rng.normal(size=3 * quality.OWN + 3) / 3, rng.normal(size=(2, 2)), 0.8, 0.1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r["doc_id"] is None, r["doc_id"], r["score"], r["predicted"], r["held_out"], r["n_lines"]) for r in quality.score_documents(docs, field).collect()), key=repr)
    want = sorted(((i is None, i, plain_score(t, field), 0, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0, (t or "").count("\n") + 1) for i, t in rows), key=repr)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert (f[0], f[1], f[4], f[5]) == (w[0], w[1], w[4], w[5]) and np.isclose(f[2], w[2]) and f[3] == (f[2] >= 0.3)


def test_fit_goes_up_the_likelihood():
    """The gradient that the field learns by is that of the weighed log likelihood of the labelled lines."""
    rng = np.random.default_rng(8)
    per_text, share = np.array([3, 1, 4]), np.array([1.0, 0.5, 0.25])
    scores, moves, y = rng.normal(size=8), rng.normal(size=(2, 2)), rng.integers(0, 2, 8)

    def likelihood(scores, moves):
        out, at = 0.0, 0
        for n, w in zip(per_text, share, strict=True):
            value = lambda y, s: sum(a for a, v in zip(s, y, strict=True) if v) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
            own = scores[at : at + n]
            out += w * (value(y[at : at + n], own) - np.log(sum(np.exp(value(z, own)) for z in itertools.product((0, 1), repeat=int(n)))))
            at += n
        return out

    good, expected = quality.marginals(scores, per_text, moves, share)
    owner = np.repeat(np.arange(3), per_text)
    joined = owner[1:] == owner[:-1]
    step = 1e-6
    for i in range(8):
        moved = scores.copy()
        moved[i] += step
        assert np.isclose((likelihood(moved, moves) - likelihood(scores, moves)) / step, (y[i] - good[i]) * share[owner[i]], atol=1e-4)
    for a, b in itertools.product((0, 1), repeat=2):
        moved = moves.copy()
        moved[a, b] += step
        seen = (share[owner[1:]] * ((y[:-1] == a) & (y[1:] == b) & joined)).sum()
        assert np.isclose((likelihood(scores, moved) - likelihood(scores, moves)) / step, seen - expected[a, b], atol=1e-4)


def test_lines_of_texts():
    data, starts, ends, per_text = quality.lines_of(pa.array(["a\nbc\n", None, "", "é"]))
    assert per_text.tolist() == [3, 1, 1, 1]
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bc", "", "", "", "é"]


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    field = quality.learn(docs, labels)
    rows = quality.score_documents(docs, field).join(labels, "doc_id").toPandas()
    assert (rows.quality == rows.predicted)[rows.held_out].mean() > 0.95
    good = rows[rows.held_out & (rows.quality == 1)]
    assert (good.predicted == 1).mean() > 0.97
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= set(good[good.predicted == 1].doc_id)


def test_quality_of_awkward_rows(spark, edges, nothing):
    field = quality.learn(edges, spark.createDataFrame([(1, 1, 0), (2, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    rows = quality.score_documents(edges, field).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert quality.score_documents(nothing, field).count() == 0
    lines = quality.label_lines(edges, field).toPandas()
    assert len(lines) == sum((r[1] or "").count("\n") + 1 for r in edge_rows())
    assert quality.learn(nothing, spark.createDataFrame([], "doc_id long, quality int")).weights.sum() == 0


def test_quality_learns_from_long_documents(spark):
    good, bad = "The river was calm, and the people of the town walked home.\n", "BUY NOW!!! | $$$ | CLICK | HERE | 100%\n"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * 1200) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, 0) for i in range(1000, 3000)], "doc_id long, quality int")
    field = quality.learn(docs, labels, sample=100)  # most labels are of documents that are not there
    low, high = field.score(pa.array([bad * 20, good * 20]))
    assert low < 0.2 and high > 0.8


def test_repeated_words_end_with_their_text():
    alone, pair = quality.features(pa.array(["a b b"]))[0], quality.features(pa.array(["a b b", "b b c", "", None, "c c\nd"]))[0]
    assert np.array_equal(alone[0, : quality.OWN], pair[0, : quality.OWN])
    assert (pair[:, 16] * (np.array([2, 2, 0, 0, 1, 0]) + 1)).round(6).tolist() == [1, 1, 0, 0, 1, 0]


def test_automaton_has_all_substrings():
    text = [0, 1, 0, 2, 1, 0, 1, 0, 0]
    automaton = language.SuffixAutomaton(text)

    def has(word):
        state = 0
        for s in word:
            if s not in automaton.next[state]:
                return False
            state = automaton.next[state][s]
        return True

    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
    for n in range(1, 5):
        for word in itertools.product(range(3), repeat=n):
            assert has(word) == (word in subs)


def longest_matches(text, learned):
    """Phrases of the greedy parse: each the longest match from its start on, one character at least."""
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in learned:
            n += 1
        at, phrases = at + n, phrases + 1
    return phrases


def test_phrases_go_on_across_blocks():
    rng = np.random.default_rng(9)
    samples = (("a", "".join(rng.choice(list("ab "), 900))), ("b", "ab" * 600), ("c", "".join(rng.choice(list("abcd"), 300))))
    parser = language.Parser(samples)
    texts = ["".join(rng.choice(list("abc "), n)) for n in (1, 511, 512, 513, 2000, 5000)] + ["ab" * 1500, samples[0][1][:700] * 3, "b" + samples[1][1] + "ba" * 900, ""]
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array(list(map(len, texts)))
    got = parser.phrases(parser.codes[points], np.cumsum(lengths) - lengths, lengths)
    assert got.tolist() == [[longest_matches(t, learned) for t in texts] for _, learned in samples]
    few = language.Parser(samples, table_bytes=1)  # the fewest columns: most symbols are searched for
    assert few.phrases(few.codes[points], np.cumsum(lengths) - lengths, lengths).tolist() == got.tolist()


def test_languages_and_scores_are_those_of_plain_parsing(spark):
    rng = np.random.default_rng(5)
    scripts = {"am": 0x1200, "ar": 0x0627, "el": 0x03B1, "en": 0x61, "he": 0x05D0, "hi": 0x0905, "hy": 0x0561, "ja": 0x3042, "ka": 0x10D0, "ko": 0xAC00, "ru": 0x0430, "th": 0x0E01, "zh": 0x4E00}
    letters = {lang: [c for i in range(400 if lang in ("zh", "ko") else 24) if (c := chr(first + i)).isalpha()] for lang, first in scripts.items()}
    words = {lang: ["".join(rng.choice(own, rng.integers(1, 6))) for _ in range(150)] for lang, own in letters.items()}
    rows = [(i * 20 + k, " ".join(rng.choice(words[lang], rng.choice([3, 20, 60]))), lang) for k, lang in enumerate(scripts) for i in range(20)]
    rows += [(9000, "12 !? 3", "en"), (9001, None, "en"), (9002, "\u16a0\u16a1\u16a2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = {lang: "".join(language.folded(ord(c)) for c in text) for lang, text in language.learned_texts(docs)}
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    right = Counter()
    for doc_id, text, lang in rows:
        r = found[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        folded = "".join(language.folded(ord(c)) for c in text)
        needs = sorted((longest_matches(folded, learned) * np.log2(max(2, len(learned))), name) for name, learned in samples.items())
        assert r["lang_pred"] == needs[0][1] and np.isclose(r["score"], 1 - needs[0][0] / needs[1][0])
        right[lang] += r["lang_pred"] == lang
    assert all(right[lang] >= 19 for lang in scripts)


def test_phrases_are_greedy_longest_matches():
    samples = (("en", "the cat sat on the mat and the dog"), ("fr", "le chat est sur la table et le chien"))
    parser = language.Parser(samples)
    for text in ("the dog sat", "xyz", "le Chat!", "on the table", "a" * 1500):
        folded = "".join(language.folded(ord(c)) for c in text)
        got = parser.phrases(parser.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int32), np.array([0]), np.array([len(text)]))
        for k, (_, learned) in enumerate(samples):
            assert got[k, 0] == longest_matches(folded, learned)


def test_languages_on_held_out_rows(spark, small_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang_pred == rows.lang)[rows.held_out].mean() > 0.98


def test_languages_of_awkward_rows(edges, nothing):
    rows = language.identify(edges).collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de", "es", "und")
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {4, 5, 6, 11}
    assert language.identify(nothing).count() == 0
    unlabelled = edges.withColumn("lang", edges["score"])
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_each_automaton_has_all_characters_of_its_text():
    rng = np.random.default_rng(3)
    han, kana, latin = ([chr(first + i) for i in range(n)] for first, n in ((0x4E00, 500), (0x3042, 60), (0x61, 26)))
    samples = tuple((lang, "".join(rng.choice(letters, 2000))) for lang, letters in (("a", han), ("b", [*kana, *han[:200]]), ("c", latin)))
    parser = language.Parser(samples)
    for text in (samples[0][1][100:900], samples[1][1][5:400] + samples[0][1][:50], "abc" + samples[1][1][:9] + "\u00df\u0436", samples[2][1][:700]):
        got = parser.phrases(parser.codes[np.frombuffer(text.encode("utf-32-le"), np.uint32)], np.array([0]), np.array([len(text)]))
        for k, (_, learned) in enumerate(samples):
            assert got[k, 0] == longest_matches(text, learned)
    assert parser.judge([text[300:700] for _, text in samples])[0] == ["a", "b", "c"]


def test_languages_of_long_documents(spark):
    rows = [(i, text * 900, lang) for i in range(12) for lang, text in (("en", "the dog and the cat "), ("fr", "le chien et le chat "))]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    learned = dict(language.learned_texts(docs))
    assert {lang: len(text) >= language.SAMPLE_CHARS for lang, text in learned.items()} == {"en": True, "fr": True}
    assert {r["lang_pred"] for r in language.identify(docs.where("lang = 'fr'"), docs).collect()} == {"fr"}


def test_quality_takes_one_text_of_an_id(spark):
    good, bad = "The river was calm, and the people of the town walked home.\n", "BUY NOW!!! | $$$ | CLICK | HERE | 100%\n"
    rows = [(0, bad * 3 + f"{i}") for i in range(20_000)] + [(i, (good if i % 2 else bad) * 4) for i in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    low, high = quality.learn(docs, labels, sample=12).score(pa.array([bad * 20, good * 20]))
    assert low < 0.3 and high > 0.7


def test_parts_are_drawn_from_whole_texts(spark):
    docs = spark.createDataFrame([(i, "".join(f"{i:02d}-{k:06d}\n" for k in range(3000))) for i in range(30)], "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    parts = [r["t"] for r in docs.select(quality.some_parts(9000).alias("t")).collect()]
    firsts = [int(line[3:]) for t in parts for line in t.split("\n") if len(line) == 9]
    assert all(9000 <= len(t) <= 9002 for t in parts)
    assert min(firsts) < 300 and max(firsts) > 2700 and len({n // 300 for n in firsts}) == 10
    assert quality.some_parts(40_000) is not None and docs.select(quality.some_parts(40_000).alias("t")).where("t = text").count() == 30


def test_languages_are_learned_beyond_the_start(spark):
    rows = [(i, f"{i} " + "the dog and the cat " * 2100 + text * 20_000, lang) for i in range(12) for lang, text in (("fr", "le chien et le chat "), ("de", "der Hund und die Katze "))]
    docs = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    learned = dict(language.learned_texts(docs))
    assert learned["fr"].count("chien") > learned["fr"].count("dog") and learned["de"].count("Hund") > learned["de"].count("dog")
    asked = spark.createDataFrame([(1, "le chat et le chien"), (2, "die Katze und der Hund")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(asked, docs).collect()} == {1: "fr", 2: "de"}


def test_too_many_languages_are_refused(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "'some text' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="languages"):
        language.learned_texts(docs)
