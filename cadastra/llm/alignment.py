"""Token alignment of two tokenizers over the same texts: where tokens of both end together.

Both tokenizers spell every text in bytes. Where a token of one ends is looked for among the ends of the other by galloping; the
ends that both have cut the tokens into groups, and the last two tokens of each group are linked. How often an id pair is
linked in all texts is summed from each chunk's counts, and goes back only to the chunks that have the pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import handing_back, spread_join, table, written
from cadastra.llm.spelling import Spelling, byte_level_vocabulary, piece_vocabulary
from cadastra.llm.tokens import MAX_CHUNKS, WINDOW, Encoder, gathered, slices

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = 0x20
#: Bytes of text in a chunk; the temporary arrays take some 60 times as much.
CHUNK_BYTES = 3 << 20
#: Chunks of words that each of the two encoders remembers, and the bytes that it goes through at once.
REMEMBERED, OWN_WINDOW = 300_000, 2 << 20


def before_spaces(data: np.ndarray) -> np.ndarray:
    """Whether a space after anything else stands at each byte."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[1:] == SPACE) & (data[:-1] != SPACE)
    return out


class PieceEncoder(Encoder):
    """Encodes with a sentencepiece BPE model texts that begin with the space that it would add.

    No piece has a space after anything else, so none goes across a border before such a space, and the chunks between can be
    encoded apart. Models of other kinds, or that change texts, are refused.
    """

    borders = staticmethod(before_spaces)

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, window: int = WINDOW):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces) or self.processor.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"]:
            raise ValueError(f"{path}: pieces go across the borders of words, or white space is changed")
        self.space, self.cuts = self.processor.piece_to_id("▁"), True
        self._empty(max_chunks, window)

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """A chunk begins with a space, which the model adds; it encodes the rest."""
        coded = self.processor.encode([w[1:] for w in words], num_threads=1)
        return [np.array(ids if len(w) > 1 else [self.space], np.uint32) for w, ids in zip(words, coded, strict=True)]


@lru_cache(maxsize=1)
def encoders(byte_level: str, pieces: str) -> tuple[Encoder, Spelling, Encoder, Spelling]:
    """Both tokenizers and the bytes of their ids, once per Python worker."""
    b = PieceEncoder(pieces, REMEMBERED, OWN_WINDOW)
    return Encoder(byte_level, REMEMBERED, OWN_WINDOW, plain=True), Spelling(byte_level_vocabulary(byte_level)), b, Spelling(piece_vocabulary(b.processor))


def reached(longer: np.ndarray, keys: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place in longer, from each start on, whose value is at least the key: by steps that double, then by halving."""
    low, high = start.copy(), start.copy()
    last = len(longer) - 1
    live, step = np.arange(len(keys)), 1
    while len(live):
        probe = high[live]
        under = (probe <= last) & (longer[np.minimum(probe, last)] < keys[live])
        live = live[under]
        low[live] = high[live] + 1
        high[live] += step
        step *= 2
    high = np.minimum(high, last + 1)
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        under = longer[middle] < keys[live]
        low[live[under]] = middle[under] + 1
        high[live[~under]] = middle[~under]
        live = live[low[live] < high[live]]
    return low


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each value of shorter, how many of longer are less; both are sorted.

    Each value gallops from the place that another one, a power of two before it, has reached: first few far apart, then those
    halfway between, until all have theirs. So no value goes farther than the values between them in longer.
    """
    found = np.zeros(len(shorter), np.int64)
    if not len(shorter) or not len(longer):
        return found
    found[:1] = reached(longer, shorter[:1], found[:1])
    stride = 1 << max(0, (len(shorter) - 1).bit_length() - 1)
    while stride:
        turn = np.arange(stride, len(shorter), 2 * stride)
        found[turn] = reached(longer, shorter[turn], found[turn - stride])
        stride >>= 1
    return found


def meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both have; the shorter list goes through the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    same = np.flatnonzero((at < len(long)) & (long[np.minimum(at, len(long) - 1)] == short)) if len(long) else np.zeros(0, np.int64)
    return (same, at[same]) if len(a) <= len(b) else (at[same], same)


def overlaps(ends: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, one past the last) of the other list's tokens that share bytes with each token: the ranks of its two ends.

    ends, other: where the tokens of the two lists end, in one text that both cover whole.
    """
    rank = gallop(ends, other)
    whole = other[np.minimum(rank, len(other) - 1)] == ends
    return np.concatenate([[0], (rank + whole)[:-1]])[: len(rank)], np.minimum(rank + 1, len(other))


def listed(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each group and the end) of groups written as ``a1,a2|b1;``, one after another."""
    groups = np.arange(len(a_sizes))
    order = np.empty(len(a) + len(b), np.int32)
    mark = np.full(len(order), ord(","), np.uint8)
    a_through, b_before = np.cumsum(a_sizes), np.cumsum(b_sizes) - b_sizes
    at_a = np.arange(len(a)) + b_before[np.repeat(groups, a_sizes)]
    at_b = np.arange(len(b)) + a_through[np.repeat(groups, b_sizes)]
    order[at_a], order[at_b] = a, b
    last = a_through + np.cumsum(b_sizes) - 1
    mark[last], mark[last - b_sizes] = ord(";"), ord("|")
    width = len(str(int(order.max()))) if len(order) else 1
    tens = 10 ** np.arange(width - 1, -1, -1)
    cells = np.empty((len(order), width + 1), np.uint8)
    kept = np.ones(cells.shape, bool)
    for k, ten in enumerate(tens[:-1]):
        cells[:, k], kept[:, k] = order // ten % 10 + ord("0"), order >= ten
    cells[:, -2], cells[:, -1] = order % 10 + ord("0"), mark
    bounds = np.concatenate([[0], np.cumsum(kept.sum(1))])
    return cells[kept], np.concatenate([[0], bounds[last + 1]])


class Aligned:
    """Texts of one batch: tokens of both kinds, groups and links."""

    def __init__(self, texts: pa.Array, byte_level: str, pieces: str):
        a_encoder, a_spelling, b_encoder, b_spelling = encoders(byte_level, pieces)
        full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        lines = pc.binary_join_element_wise("", texts.filter(full), " ")
        a, n_a = a_encoder.encode(lines)
        b, n_b = b_encoder.encode(lines)
        good = self.same(lines, a, n_a, a_spelling) & self.same(lines, b, n_b, b_spelling)
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good]
        where = np.flatnonzero(full.to_numpy(zero_copy_only=False))[good]
        self.n_a, self.n_b, self.n_groups = (np.zeros(len(texts), np.int64) for _ in range(3))
        self.n_a[where], self.n_b[where] = n_a, n_b
        a_ends, b_ends = np.cumsum(a_spelling.sizes(a)), np.cumsum(b_spelling.sizes(b))
        a_first, b_first = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at_a, at_b = [], []  # texts in which A's list is the shorter one, then the others
        for some in (n_a <= n_b, n_a > n_b):
            own_a, own_b = np.flatnonzero(np.repeat(some, n_a)), np.flatnonzero(np.repeat(some, n_b))
            i, j = meeting(a_ends[own_a], b_ends[own_b])
            at_a.append(own_a[i])
            at_b.append(own_b[j])
        last_a, last_b = np.sort(np.concatenate(at_a)), np.sort(np.concatenate(at_b))  # in both lists' order
        per_text = np.diff(np.searchsorted(last_a, np.append(a_first, len(a))))
        self.n_groups[where] = per_text
        data, bounds = listed(a, b, np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1))
        ends = np.zeros(len(texts), np.int64)
        ends[where] = bounds[np.cumsum(per_text)] - bounds[np.cumsum(per_text) - per_text]
        self.groups = (data, np.concatenate([[0], np.cumsum(ends)]))
        self.pairs = a[last_a].astype(np.int64) << 32 | b[last_b]

    @staticmethod
    def same(lines: pa.Array, ids: np.ndarray, counts: np.ndarray, spelling: Spelling) -> np.ndarray:
        """Whether each line's ids spell it."""
        places = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64) if len(lines) else np.zeros(1, np.int64)
        given = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
        sizes = np.concatenate([[0], np.cumsum(spelling.sizes(ids))])[np.concatenate([[0], np.cumsum(counts)])]
        spelled = spelling.spelled(ids)
        if len(spelled) == len(given) and np.array_equal(sizes, places - places[0]) and np.array_equal(spelled, given):
            return np.ones(len(lines), bool)
        places = places - places[0]
        return np.array([np.array_equal(given[places[k] : places[k + 1]], spelled[sizes[k] : sizes[k + 1]]) for k in range(len(lines))], bool)

    def texts(self) -> pa.Array:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        data, bounds = self.groups
        whole = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        return pc.utf8_slice_codeunits(whole, 0, -1).cast(pa.string())

    def links(self) -> tuple[np.ndarray, np.ndarray, list, list]:
        """(distinct id pairs, links of each, then for each text the places of its pairs among them, and how often it has each)."""
        distinct, coded, counts = np.unique(self.pairs, return_inverse=True, return_counts=True)
        size = max(1, len(distinct))
        own = np.repeat(np.arange(len(self.n_groups)), self.n_groups) * size + coded.astype(np.int64)
        each, times = np.unique(own, return_counts=True)
        cuts = np.searchsorted(each, np.arange(1, len(self.n_groups)) * size)
        return distinct, counts, np.split((each % size).astype(np.int32), cuts), np.split(times.astype(np.int32), cuts)


LINKED = "n_a long, n_b long, n_groups long, groups string, chunk long, link array<int>, times array<int>, pairs array<struct<a: int, b: int, n: long>>"


def align(docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Aligns the tokens of each text, with a space before it, by both vocabularies; special tokens are plain text.

    doc_id; n_a, n_b: tokens of either kind; n_groups; groups: the ids of each group as ``a1,a2|b1;a3|b2,b3``. Rows come in chunks
    of some ``chunk_bytes`` of text: link has the places of a text's linked id pairs (of the last tokens of each group) among those
    of its chunk, times how often it has each; pairs, which only a chunk's first row has, are the chunk's pairs and counts.

    One row comes of each row, repeated and null ids too. A null or empty text, or one that either vocabulary does not spell as it is,
    has no tokens and empty groups. Other columns are not looked at.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    of_pair = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, chunk_bytes):
            for low, high in slices(batch.column("text"), chunk_bytes):
                part = batch.slice(low, high - low)
                own = Aligned(part.column("text"), byte_level, pieces)
                pairs, counts, link, times = own.links()
                flat = pa.StructArray.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(counts.astype(np.int64))], fields=list(of_pair))
                first = pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), flat)
                rest = pa.nulls(len(part) - 1, pa.list_(of_pair))
                columns = [part.column("doc_id"), pa.array(own.n_a), pa.array(own.n_b), pa.array(own.n_groups), own.texts(), pa.array([chunk] * len(part), pa.int64())]
                columns += [pa.array(link, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.concat_arrays([first.cast(pa.list_(of_pair)), rest])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(c.split(" ")[0] for c in LINKED.split(", ")[:7]), "pairs"])
                chunk += 1

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {LINKED}")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, place, a, b, n of each chunk's pairs; a, b, count over all chunks and best: whether no pair of b has more)."""
    pairs = aligned.where(F.col("pairs").isNotNull()).select("chunk", F.posexplode("pairs").alias("place", "pair")).select("chunk", "place", "pair.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return pairs, counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame) -> DataFrame:
    """aligned's rows with n_links, n_best (links whose pair is a commonest one of its b) and count_sum (the counts of all links).

    aligned: a written table of what align() gives, as chunks are numbered by the tasks that make them.
    """
    pairs, counts = pair_counts(aligned)
    known = spread_join(pairs.drop("n"), counts, ["a", "b"], ["chunk"]).select(F.col("chunk").alias("of_chunk"), "place", "count", "best")
    rows = aligned.drop("pairs")
    kept = [f for f in rows.schema.fields if f.name not in ("chunk", "link", "times")]
    names = [f.name for f in kept]

    def sums(texts: pa.Table, found: pa.Table) -> pa.Table:
        place = found["place"].to_numpy()
        count, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        count[place], best[place] = found["count"].to_numpy(), found["best"].to_numpy().astype(np.int64)
        link, times = (texts[c].combine_chunks() for c in ("link", "times"))
        sizes = pc.fill_null(pc.list_value_length(link), 0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        each, often = link.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        summed = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (often, often * best[each], often * count[each])]
        return texts.select(names).append_column("n_links", pa.array(np.diff(summed[0]))).append_column("n_best", pa.array(np.diff(summed[1]))).append_column("count_sum", pa.array(np.diff(summed[2])))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_links long", "n_best long", "count_sum long"])
    return rows.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(sums, schema)


def op12_gallop_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    sums = link_sums(written(aligned.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"), "aligned"))
    return sums.select(F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
