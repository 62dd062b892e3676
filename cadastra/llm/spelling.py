"""The bytes that token ids stand for."""

from __future__ import annotations

import json
import re

import numpy as np

BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the other
    bytes, in their order, by the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


LETTERS = byte_letters()


def byte_level(token: str) -> bytes:
    """A byte-level token's bytes; one with other characters, as added tokens may have, stands for itself."""
    return bytes(LETTERS[c] for c in token) if all(c in LETTERS for c in token) else token.encode()


def byte_level_vocabulary(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file; ids that it lacks have none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out = [b""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = byte_level(token)
    return out


def piece_vocabulary(processor) -> list[bytes]:
    """The bytes of every piece of a sentencepiece model: U+2581 is a space, <0xHH> the byte HH."""
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]


class Spelling:
    """Spells many ids at once."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([*map(len, tokens), 0], np.int64)  # the last is for ids that the vocabulary lacks
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def places(self, ids: np.ndarray) -> np.ndarray:
        return np.minimum(ids, len(self.size) - 1)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """How many bytes each id has."""
        return self.size[self.places(ids)]

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after another."""
        places = self.places(ids)
        size = self.size[places]
        ends = np.cumsum(size)
        where = np.repeat(self.start[places] - (ends - size), size)
        where += np.arange(len(where))
        return self.bytes[where]
