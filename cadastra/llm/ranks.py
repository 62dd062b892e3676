"""BPE encoding and decoding with one's own merges: contiguous arrays of ranks.

A text is cut into words as the vocabulary says. The parts of a word and the ranks of neighbouring parts lie in two contiguous
rows; the least rank is looked for again and again, the border at it goes, and the ranks beside it are made anew. Many words
are gone through together, a row of a matrix each. Words of over LONGEST bytes, for which looking through the row again and
again would take the square of their length, keep the ranks in a heap instead.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import table
from cadastra.llm.spelling import LETTERS, Spelling, byte_level_vocabulary
from cadastra.llm.tokens import MAX_CHUNKS, WINDOW, Encoder, gathered, slices

VOCABULARY = "byte_bpe_50k.json"
NONE = np.int32(2**31 - 1)
#: Widths of the matrices that hold words of so many bytes at most.
WIDTHS = (4, 8, 16, 32, 64)
LONGEST = WIDTHS[-1]
#: Words that are gone through together.
ROWS = 4096


class Merges:
    """The merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False, "byte_fallback": False}
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or spec["normalizer"] or any(model.get(k) not in (v, "", None) for k, v in plain.items()):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.letter_ids = np.zeros(max(map(ord, LETTERS)) + 1, np.int32)
        for letter in LETTERS:
            self.letter_ids[ord(letter)] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.many = max(ids.values()) + 1
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        keys = np.array([ids[a] * self.many + ids[b] for a, b in pairs], np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours; NONE where there is no merge, or no neighbour (-1)."""
        keys = left.astype(np.int64) * self.many + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.order[at], NONE)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Merges every row of parts, which -1 fills up, as far as it goes; in place."""
        if parts.shape[1] < 2:
            return parts
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        columns = np.arange(parts.shape[1])
        live = np.arange(len(parts))
        while len(live):
            at = ranks[live].argmin(1)  # the leftmost of the least
            least = ranks[live, at]
            more = least < NONE
            live, at, least = live[more], at[more], least[more]
            if not len(live):
                break
            beyond = columns[None, :] > at[:, None]
            from_ = np.minimum(columns + beyond, len(columns) - 1)
            rows = np.take_along_axis(parts[live], from_, 1)  # the border after ``at`` goes
            rows[:, -1] = -1
            k = np.arange(len(live))
            rows[k, at] = self.made[least]
            parts[live] = rows
            near = np.take_along_axis(ranks[live], np.minimum(from_[:, :-1], len(columns) - 2), 1)
            near[:, -1] = NONE
            right = np.minimum(at + 1, len(columns) - 1)
            inner = at < len(columns) - 1
            near[k[inner], at[inner]] = self.ranks(rows[k, at], rows[k, right])[inner]
            has = at > 0
            near[k[has], at[has] - 1] = self.ranks(rows[k, at - 1], rows[k, at])[has]
            ranks[live] = near
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """Merges one long word: ranks in a heap, parts in a linked list."""
        n, many, rank_of = len(parts), self.many, self.rank_of
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of.get(parts[i] * many + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two is another part by now
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank_of.get(parts[a] * many + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, which is written in the vocabulary's letters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        least = 0
        for width in WIDTHS:
            inside = np.flatnonzero((lengths > least) & (lengths <= width))
            least = width
            for at in range(0, len(inside), ROWS):
                some = inside[at : at + ROWS]
                letters = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32)
                parts = np.full((len(some), width), -1, np.int32)
                parts[np.arange(width) < lengths[some][:, None]] = self.letter_ids[letters]
                parts = self.merge_rows(parts)
                own = np.split(parts[parts >= 0].astype(np.uint32), np.cumsum((parts >= 0).sum(1))[:-1])
                for i, ids in zip(some, own, strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > LONGEST):
            out[i] = np.array(self.merge_long(self.letter_ids[list(map(ord, words[i]))].tolist()), np.uint32)
        return out


class RankEncoder(Encoder):
    """Cuts texts at certain borders as Encoder does, but merges by its own ranks."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, window: int = WINDOW):
        self.merges, self.spelling = Merges(path), Spelling(byte_level_vocabulary(path))
        with open(path, encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in what is beside them")
        self.added = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        super().__init__(path, max_chunks, window)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        word_of: dict[str, int] = {}
        words: list[list[int]] = []  # a text's words; added tokens as -1 and less
        marks = list(self.added)
        for text in texts:
            own: list[int] = []
            for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
                if i % 2:
                    own.append(-1 - marks.index(part))
                else:
                    own += [word_of.setdefault(w, len(word_of)) for w, _ in cut(part)] if part else []
            words.append(own)
        ids = self.merges.merge(list(word_of))
        given = [self.added[m] for m in marks]
        none = np.zeros(0, np.uint32)
        return [np.concatenate([ids[w] if w >= 0 else given[-1 - w] for w in own]) if own else none for own in words]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        return self._batch(words)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each row of ids; bytes that are not UTF-8 become U+FFFD, ids that the vocabulary lacks nothing."""
        data, before = self.spelling.spelled(flat), np.concatenate([[0], np.cumsum(self.spelling.sizes(flat))])
        bounds = before[np.concatenate([[0], np.cumsum(counts)])]
        out = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole = data.tobytes()
            out = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.large_string())
        return out


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """One encoder per vocabulary and Python worker."""
    return RankEncoder(path)


def packed(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each row's ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))]).cast(pa.binary())


def unpacked(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids a row) of what packed() made; a null row has none."""
    return np.frombuffer(b"".join(rows.drop_null().to_pylist()), "<u4"), pa.compute.fill_null(pa.compute.binary_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id and ids: the token ids of the whole text, little-endian unsigned 32-bit integers in a binary.

    A null or empty text has no ids. One row comes of each row, repeated ids and null ids too; other columns are not looked
    at. A vocabulary that is not plain byte-level BPE is refused.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(path)
        for batch in gathered(batches):
            for low, high in slices(batch.column("text")):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed(*own.encode(part.column("text")))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded's doc_id and ids (as encode() gives them) with decoded, the text that they stand for.

    Null or no ids are the empty text; special tokens are written out, ids that the vocabulary lacks stand for nothing, and bytes
    that are not UTF-8 for U+FFFD.
    """
    id_type = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = rank_encoder(path)
        for batch in batches:
            for low, high in slices(batch.column("ids")):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), own.decode(*unpacked(part.column("ids"))).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids binary, decoded string")


def op11_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    texts = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return texts.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
