"""Language identification by cross-parsing texts against suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadastra.llm.shared import held_out, table

#: Per language the learned text is whole documents of smallest hash, at most SAMPLE_DOCS, until SAMPLE_CHARS are reached.
SAMPLE_DOCS = 200
SAMPLE_CHARS = 40_000
#: Longer documents are learned from only where a language's others are too few, in pieces of this length drawn by hash over the
#: whole text, a piece of each before a second one of any, so that no single one makes a language's text.
LONGEST = 8_000
#: More languages than this are refused: some hundred rows of each come to the driver.
MOST_LANGS = 1000
#: Columns of an automaton's table: its commonest characters, and one for those that its text lacks. Rarer characters of
#: its text are looked up in a sorted list of their transitions.
SYMBOLS = 96
#: Bytes that the automata's tables may take together: with many languages they have fewer columns.
TABLE_BYTES = 256 << 20
#: A text is parsed in blocks of this many characters at once; phrases go on across blocks.
BLOCK = 512
UNKNOWN = "und"
SLICE_CHARS = 4 << 20


def folded(cp: int) -> str:
    """The one character that stands for a code point: letters in lower case, all else a blank."""
    c = chr(cp).lower()
    return c if len(c) == 1 and c.isalpha() else chr(cp) if chr(cp).isalpha() else " "


class SuffixAutomaton:
    """All substrings of one text of symbols: from state 0, a path for each."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, last = [-1], [0], 0
        for s in symbols:
            own = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and s not in self.next[p]:
                self.next[p][s] = own
                p = self.link[p]
            if p >= 0:
                q = self.next[p][s]
                if self.length[p] + 1 == self.length[q]:
                    self.link[own] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p >= 0 and self.next[p].get(s) == q:
                        self.next[p][s] = copy
                        p = self.link[p]
                    self.link[q] = self.link[own] = copy
            last = own


class Parser:
    """Greedy parses of many texts at once against every language's automaton.

    Each automaton has the alphabet of its own learned text. A step is one look-up: table[state + symbol] is the next
    state's place in the table, times two, plus one where the phrase could not go on and a new one began. A character that
    the learned text lacks is a phrase of its own. A symbol beyond the table's columns is searched for among the
    transitions by such symbols; where there is none, a new phrase begins with it.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...], symbols: int = SYMBOLS, table_bytes: int = TABLE_BYTES):
        texts = {lang: "".join(map(folded, map(ord, text))) for lang, text in samples}
        every = sorted(set().union(*texts.values()))
        code = {c: i for i, c in enumerate(every)}
        self.langs = list(texts)
        self.codes = np.full(0x110000, len(every), np.int32)  # the last one is every character that no text has
        for cp in range(0x110000):
            if (i := code.get(folded(cp) if cp < 0x3000 or chr(cp).isalpha() else " ")) is not None:
                self.codes[cp] = i
        parts, self.roots, self.bits, self.own, self.widths, self.rare = [], [], [], [], [], []
        # an automaton has at most twice as many states as its text has characters
        symbols = max(4, min(symbols, table_bytes // (8 * max(1, sum(map(len, texts.values()))))))
        base = 0
        for text in texts.values():
            found: dict[str, int] = {}
            for c in text:
                found[c] = found.get(c, 0) + 1
            alphabet = sorted(found, key=lambda c: (-found[c], c))
            width = min(len(alphabet) + 1, symbols)
            # the last column is for characters that the text lacks; symbols from width on have none
            number = {c: i if i < width - 1 else i + 1 for i, c in enumerate(alphabet)}
            own = np.full(len(every) + 1, width - 1, np.int32)
            own[[code[c] for c in alphabet]] = list(number.values())
            automaton = SuffixAutomaton([number[c] for c in text])
            dense = np.full((len(automaton.next), width), -1, np.int64)
            keys, ends = [], []  # state and rare symbol, next state
            rares = len(alphabet) + 1 - width
            for i, ways in enumerate(automaton.next):
                for symbol, end in ways.items():
                    if symbol < width:
                        dense[i, symbol] = end
                    else:
                        keys.append(i * rares + symbol - width)
                        ends.append(end)
            root = np.where(dense[0] < 0, 0, dense[0])
            new = dense < 0
            new[0] = True  # the root is where a text starts and where an unknown character leads
            parts.append(((np.where(dense < 0, root[None, :], dense) * width + base) * 2 + new).reshape(-1))
            order = np.argsort(np.array(keys, np.int64), kind="stable")
            keys, ends = np.array(keys, np.int64)[order], np.array(ends, np.int64)[order]
            # the root's transitions, one per rare symbol, come first
            self.rare.append((base, rares, keys, (ends * width + base) * 2 + (keys < rares)))
            self.roots.append(base * 2)
            self.widths.append(width)
            self.own.append(own)
            self.bits.append(math.log2(max(2, len(text))))
            base += dense.size
        self.table = np.concatenate(parts).astype(np.int32 if base * 2 < 1 << 31 else np.int64) if parts else np.zeros(0, np.int32)

    def step(self, lang: int, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states of the lang-th automaton by the symbols, which are codes."""
        width, own = self.widths[lang], self.own[lang][symbols]
        base, rares, keys, ends = self.rare[lang]
        if not rares or not len(far := np.flatnonzero(own >= width)):
            return self.table[(state >> 1) + own]
        rare = own[far].astype(np.int64) - width
        own[far] = width - 1
        got = self.table[(state >> 1) + own]
        wanted = ((state[far].astype(np.int64) >> 1) - base) // width * rares + rare
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        got[far] = np.where(keys[at] == wanted, ends[at], ends[rare])
        return got

    def phrases(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases per language (rows) and text (columns); text has the codes of all texts, one after another.

        All blocks of all texts are parsed at once, each as if a phrase began there. Then each parse is carried on from the
        end of the block before, side by side with the other, until both are in the same state, from where on they are one.
        """
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        first = starts[owner] + number * BLOCK
        size = np.minimum(BLOCK, lengths[owner] - number * BLOCK)
        order = np.argsort(-size, kind="stable")
        sorted_first, sorted_size = first[order], size[order]
        many = np.searchsorted(-sorted_size, -np.arange(1, BLOCK + 1), "right")  # blocks that have a character at each step
        counts = np.zeros((len(self.langs), len(first)), np.int64)
        ends = np.zeros((len(self.langs), len(first)), self.table.dtype)
        states = [np.full(len(first), r, self.table.dtype) for r in self.roots]
        for step in range(int(sorted_size[0]) if len(size) else 0):
            n = many[step]
            symbols = text[sorted_first[:n] + step]
            for lang, state in enumerate(states):
                got = self.step(lang, state[:n], symbols)
                counts[lang, order[:n]] += got & 1
                state[:n] = got
        out = np.zeros((len(self.langs), len(lengths)), np.int64)
        for lang, state in enumerate(states):
            ends[lang, order] = state
            counts[lang] += self._carried_on(lang, text, first, size, number > 0, ends[lang])
            out[lang] = np.bincount(owner, counts[lang], len(lengths))
        return out

    def _carried_on(self, lang: int, text: np.ndarray, first: np.ndarray, size: np.ndarray, follows: np.ndarray, alone: np.ndarray) -> np.ndarray:
        """How many more phrases each block has when its parse goes on from the block before; alone: the ends of the others."""
        more, ends = np.zeros(len(first), np.int64), alone.copy()
        waiting = np.flatnonzero(follows)
        while len(waiting):  # a second time only for blocks after one that never met its other parse
            own, other = ends[waiting - 1], np.full(len(waiting), self.roots[lang], alone.dtype)
            live, found, at_end = np.arange(len(waiting)), np.zeros(len(waiting), np.int64), alone[waiting]
            step = 0
            while len(live):
                over = size[waiting[live]] <= step
                at_end[live[over]] = own[over]
                live, own, other = live[~over], own[~over], other[~over]
                symbols = text[first[waiting[live]] + step]
                own, other = self.step(lang, own, symbols), self.step(lang, other, symbols)
                found[live] += (own & 1).astype(np.int64) - (other & 1)
                apart = own >> 1 != other >> 1
                live, own, other = live[apart], own[apart], other[apart]
                step += 1
            more[waiting] = found
            changed = waiting[ends[waiting] >> 1 != at_end >> 1]
            ends[waiting] = at_end
            following = changed + 1
            following = following[following < len(first)]
            waiting = following[follows[following]]
        return more

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of non-empty texts: the fewest phrases, each weighed by the bits that point to one."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        need = self.phrases(self.codes[points], np.cumsum(lengths) - lengths, lengths) * np.array(self.bits)[:, None]
        best = need.argmin(0)
        least = need.min(0)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(texts), np.ones(len(texts))
        second = np.partition(need, 1, axis=0)[1]
        return [self.langs[i] for i in best], 1 - least / second


@lru_cache(maxsize=1)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per Python worker."""
    return Parser(samples)


def learned_texts(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """(lang, text) per language in alphabetical order, from a bounded sample of whole documents.

    Where those of at most LONGEST characters are too few, pieces of longer ones follow, as many as one alone would need, drawn by
    hash over the whole text. Pieces are ranked by their hashes and lengths; only the texts of those chosen are sent anywhere.
    Over MOST_LANGS languages are refused.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    if labelled.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages")
    rows = labelled.where(F.length("text") > 0)
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / LONGEST).cast("int"))
    by_hash = F.array_sort(F.transform(numbers, lambda i: F.struct(F.xxhash64("own", i).alias("by"), i.alias("i"))))
    drawn = F.transform(F.slice(by_hash, 1, -(-SAMPLE_CHARS // LONGEST)), lambda d: d["i"])
    pieces = F.when(F.length("text") <= LONGEST, F.array(F.lit(0))).otherwise(drawn)

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.select("doc_id", "lang", "text", (F.length("text") > LONGEST).alias("long"), F.when(F.length("text") > LONGEST, F.xxhash64("text")).alias("own"))
        rows = rows.select("doc_id", "lang", "text", "long", F.posexplode(pieces).alias("turn", "piece"))
        rows = rows.select("doc_id", "lang", F.substring("text", F.col("piece") * LONGEST + 1, F.lit(LONGEST)).alias("text"), "long", "turn", "piece")
        return rows.withColumns({"hash": F.xxhash64("text"), "size": F.length("text")})

    rank = Window.partitionBy("lang", "long").orderBy("turn", "hash", "size")
    ranked = cut(rows).select("lang", "long", "turn", "piece", "hash", "size", "doc_id").withColumn("n", F.row_number().over(rank)).where(F.col("n") <= SAMPLE_DOCS)
    before = Window.partitionBy("lang").orderBy("long", "n").rowsBetween(Window.unboundedPreceding, -1)  # some hundred rows a language
    few = ranked.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") < SAMPLE_CHARS).drop("before", "turn").collect()
    if not few:
        return ()
    piece = ["lang", "long", "piece", "hash", "size"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(few, f"lang string, long boolean, piece int, hash long, size int, doc_id {id_type}, n int").drop("n").distinct()
    owners = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")  # at most 2 * SAMPLE_DOCS a language
    found = cut(owners).join(F.broadcast(chosen), [*piece, "doc_id"])
    text_of = {tuple(r[c] for c in piece): r["text"] for r in found.groupBy(*piece).agg(F.min("text").alias("text")).collect()}
    texts: dict[str, list[str]] = {}
    for row in sorted(few, key=lambda r: (r["lang"], r["long"], r["n"])):
        texts.setdefault(row["lang"], []).append(text_of[tuple(row[c] for c in piece)])
    return tuple((lang, " ".join(own)) for lang, own in texts.items())


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """docs' doc_id with held_out, lang_pred and score.

    lang_pred is the language whose automaton parses the whole text into the fewest phrases, a phrase being the longest
    match from its start on and weighing log2 of the learned text's length; score is one minus the ratio to the second
    best. Ties go to the language first in alphabetical order. A null text, or one without a letter, is und with score 0, as is
    every text if no row has a language. learn_from: where the labelled rows are, docs itself if None.
    """
    samples = learned_texts(docs if learn_from is None else learn_from)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(samples) if samples else None
        for batch in batches:
            texts = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            where = np.flatnonzero(lettered) if own else []
            some: list[int] = []
            size = 0
            for i, length in zip(where, pc.utf8_length(texts).take(pa.array(where, pa.int64())).to_pylist() if len(where) else [], strict=True):
                some.append(i)
                size += length
                if size > SLICE_CHARS or i == where[-1]:
                    found, scores[some] = own.judge(texts.take(pa.array(some, pa.int64())).to_pylist())
                    for j, lang in zip(some, found, strict=True):
                        langs[j] = lang
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", held_out("doc_id").alias("held_out")).select("doc_id", "held_out", "text").mapInArrow(judge, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op7_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
