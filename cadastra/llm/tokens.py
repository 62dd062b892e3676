"""Exact, fast whole-text token ids.

The ids are those of the tokenizers library for the whole text. Its BPE vocabularies first cut a text into words, runs of
marks and white space, so a text can be cut where such a border is certain, whatever stands around it, and its chunks can
be encoded apart. A chunk is encoded by the library when a Python worker meets it first, and looked up after that.

Certain borders are: before white space that follows anything else, so a run of white space stays with what comes after it;
between an ASCII or Latin-1 letter and a plain ASCII mark; and between a single line feed and such a letter. Apostrophes, which
make contractions, and the marks of special tokens make no border, nor do characters of which it is unsure whether they
are white space.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: What parts the chunks of one library call: the first of these that is a single token and leaves its neighbours alone.
PARTINGS = ("\n", " \x01 ", "<|endoftext|>")
#: A chunk that may stand between such partings.
PLAIN = re.compile(r" ?[^\s\x01]+")
#: Chunks in one text for the library, and such texts in one call.
JOINED, TEXTS = 64, 64
MAX_CHUNKS = 400_000
WINDOW = 4 << 20
SLICE_BYTES = 8 << 20


#: What a byte may be, a bit each. Latin-1 letters have 0xC3 and one more byte, which is not that of the signs for times and
#: divided by; 0xC2 and 0xE1 to 0xE3 are the first bytes of the characters beyond ASCII that are white space.
LETTER, MARK, WHITE, SOLID, SPACING = (np.uint8(1 << i) for i in range(5))


def _classes() -> np.ndarray:
    out = np.full(256, SOLID, np.uint8)
    out[:0x20] = 0
    for kind, members in ((LETTER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3"), (MARK, b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'), (SPACING, b"\xc2\xe1\xe2\xe3")):
        out[list(members)] |= kind
    out[list(b" \t\n\x0b\x0c\r")] = WHITE
    return out


CLASSES = _classes()


def borders(data: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each byte of the UTF-8 text data; never at the first."""
    out = np.zeros(len(data), bool)
    if len(data) < 2:
        return out
    kind = CLASSES[data]
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    kind[1:][(data[:-1] == 0xC3) & ~sign] |= LETTER
    kind[:-1][sign] = SOLID
    if (first := np.flatnonzero(kind & SPACING)).size:  # a character that begins so may be white space
        for k in range(3):
            at = first + k
            at = at[at < len(data)]
            kind[at[(k == 0) | (data[at] >= 0x80)]] &= ~SOLID
    letter, mark, solid = (kind & k != 0 for k in (LETTER, MARK, SOLID))
    out[1:] = solid[:-1] & (kind[1:] == WHITE)
    out[1:] |= letter[:-1] & mark[1:]
    out[1:] |= mark[:-1] & letter[1:]
    out[2:] |= solid[:-2] & (data[1:-1] == 10) & letter[2:]
    return out


def chunks(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The chunks of data that begin at starts."""
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))


class Encoder:
    """Encodes arrow string arrays with one vocabulary file; remembers about ``max_chunks`` chunks.

    plain: the strings of special tokens are ordinary text.
    """

    #: Where a chunk begins in UTF-8 text.
    borders = staticmethod(borders)

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, window: int = WINDOW, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.parting = next((p for p in PARTINGS if self._parts(p)), None)
        special = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = not any(borders(np.frombuffer(t, np.uint8)).any() for t in special)
        self._empty(max_chunks, window)

    def _empty(self, max_chunks: int, window: int) -> None:
        self.max_chunks, self.window = max_chunks, window
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.met = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, parting: str) -> bool:
        probe = ["a", " b", ",", " ...", "c1", "é"]
        alone, (all_ids,) = self._batch(probe), self._batch([parting.join(probe)])
        own = self._batch([f"a{parting}a"])[0][len(alone[0]) : -len(alone[0])]
        return len(own) == 1 and all_ids.tolist() == sum(([*own, *ids] for ids in alone), [])[1:]

    def whole(self, text: str) -> np.ndarray:
        return self._batch([text])[0]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, many to a text where they may be joined."""
        plain = [bool(PLAIN.fullmatch(w)) for w in words] if self.parting else [False] * len(words)
        good, rest = [w for w, p in zip(words, plain, strict=True) if p], [w for w, p in zip(words, plain, strict=True) if not p]
        own: list[np.ndarray] = []
        parting = self._batch([f"a{self.parting}a"])[0][len(self._batch(["a"])[0])] if self.parting else 0
        for at in range(0, len(good), JOINED * TEXTS):
            groups = [good[k : k + JOINED] for k in range(at, min(at + JOINED * TEXTS, len(good)), JOINED)]
            for group, ids in zip(groups, self._batch([self.parting.join(g) for g in groups]), strict=True):
                cuts = np.flatnonzero(ids == parting)
                if len(cuts) == len(group) - 1:
                    own += np.split(np.delete(ids, cuts), cuts - np.arange(len(cuts)))
                else:  # a special token may be the same as the parting
                    own += self._batch(group)
        rest_ids = iter([ids for at in range(0, len(rest), 1000) for ids in self._batch(rest[at : at + 1000])])
        own_ids = iter(own)
        return [next(own_ids if p else rest_ids) for p in plain]

    def _learn(self, words: list[str]) -> None:
        parts = self._encoded(words)
        first, lengths = len(self.known), np.fromiter(map(len, parts), np.int32, len(parts))
        last, size = first + len(parts), int(lengths.sum())
        self.known.update(zip(words, range(first, last), strict=True))
        self.flat = self._room(self.flat, self.used + size)
        self.starts, self.lengths, self.met = (self._room(a, last) for a in (self.starts, self.lengths, self.met))
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.met[first:last] = 0
        if size:
            self.flat[self.used : self.used + size] = np.concatenate(parts)
        self.used += size

    def _forget(self) -> None:
        """Keeps the half of the chunks that the most windows had."""
        n, half = len(self.known), self.max_chunks // 2
        limit = np.partition(self.met[:n], n - half)[n - half] if half < n else 0
        stays = self.met[:n] > limit
        self.known = {w: i for i, w in enumerate(w for w, s in zip(self.known, stays.tolist(), strict=True) if s)}
        starts, lengths = self.starts[:n][stays], self.lengths[:n][stays]
        self.flat, self.used = self._taken(starts, lengths), int(lengths.sum())
        self.lengths, self.met = lengths, self.met[:n][stays] // 2  # old use counts less and less
        self.starts = (np.cumsum(lengths) - lengths).astype(np.int32)

    def _taken(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ids at those places, one after another."""
        ends = np.cumsum(lengths, dtype=np.int32)
        where = np.repeat(starts - (ends - lengths), lengths)
        where += np.arange(len(where), dtype=np.int32)
        return self.flat[where]

    def _places(self, words: list[str]) -> np.ndarray:
        known = self.known
        if fresh := [w for w in words if w not in known]:
            if len(known) + len(fresh) > self.max_chunks and known:
                self._forget()
                known = self.known
                fresh = [w for w in words if w not in known]
            self._learn(fresh)
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.met[places] += 1
        return places

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a) // 2), a.dtype)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids per text); a null text has none.

        The texts' bytes are gone through in windows that end at a border, so a very long text costs no more room than
        short ones, beside itself and its ids.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.cuts:  # a special token has a border inside
            parts = self._batch(texts.to_pylist())
            return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)
        places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
        places = places - places[0]
        bounds = np.zeros(len(places), np.int64)  # ids before each text
        parts: list[np.ndarray] = []
        at = total = 0
        size = self.window
        while at < len(data):
            some = data[at : at + size]
            low, high = np.searchsorted(places, at), np.searchsorted(places, at + len(some))  # texts that begin here
            cut = self.borders(some)
            cut[places[low:high] - at] = True
            if at + len(some) < len(data):
                cut[-4:] = False  # the last character may be cut short
            cut[0] = True
            starts = np.flatnonzero(cut)
            if at + len(some) < len(data):
                if len(starts) == 1:  # one chunk is longer than the window
                    size *= 2
                    continue
                some, starts = some[: starts[-1]], starts[:-1]
                high = np.searchsorted(places, at + len(some))
            coded = chunks(some, starts).dictionary_encode()
            where = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
            lengths = self.lengths[where]
            ids = self._taken(self.starts[where], lengths)
            before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            bounds[low:high] = total + before[np.searchsorted(starts, places[low:high] - at)]
            parts.append(ids)
            total, at, size = total + len(ids), at + len(some), self.window
        bounds[np.searchsorted(places, len(data)) :] = total
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.diff(bounds)


@lru_cache(maxsize=2)
def encoder(path: str, max_chunks: int = MAX_CHUNKS) -> Encoder:
    """One encoder per vocabulary and Python worker."""
    return Encoder(path, max_chunks)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one of about ``limit`` bytes: the more text at once, the fewer different words a byte."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
            waiting, size = [], 0
    if waiting:
        yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Ranges of rows that hold about ``limit`` bytes at most, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(texts):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield at, to
        at = to


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to every text's ids."""
    return np.insert(flat, np.cumsum(counts), end_id).astype(np.uint32), counts + 1
