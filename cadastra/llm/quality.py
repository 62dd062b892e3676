"""Line and document quality by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import hand_back, handing_back, held_out, table
from cadastra.llm.tokens import slices
from cadastra.llm.words import word_hashes

#: The field learns from so many labelled documents at most, those of smallest hash of the id.
SAMPLE = 6000
#: Of a longer document the field learns from WINDOWS parts of it, together so many characters, drawn by hash over its whole text; it
#: is scored whole like all others.
LONGEST, WINDOWS = 30_000, 3
CUT = 0.3
#: Bytes of text at a time: the temporary arrays take some 60 times as much.
SLICE = 1 << 20
#: Byte classes, counted two at a time.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100)),
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "stop": b".,;:'\"()-",
    "bang": b"!?",
    "pipe": b"|",
    "noise": b"#$%&*+/<=>@[\\]^_`{}~",
}
PAIRS = [(a, b) for a, b in zip(list(CLASSES)[::2], list(CLASSES)[1::2], strict=True)]
OWN = 17


def _tables() -> list[np.ndarray]:
    out = []
    for low, high in PAIRS:
        t = np.zeros(256, np.int64)
        t[list(CLASSES[low])] += 1
        t[list(CLASSES[high])] += 1 << 32
        out.append(t)
    return out


TABLES = _tables()


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte and end of each line, lines per text). A null or empty text is one empty line."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(texts.to_pylist()).encode() if len(texts) else b""
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(sizes)
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(ends, breaks, "right")
    per_text = 1 + np.bincount(owner, minlength=len(sizes))
    line_ends = np.sort(np.concatenate([breaks, ends]), kind="stable")
    # a text's end and a break just before it in the order: both are kept, as the last line may be empty
    line_starts = np.zeros(len(line_ends), np.int64)
    first = np.cumsum(per_text) - per_text
    after = line_ends[:-1] + 1
    line_starts[1:] = after
    line_starts[first] = ends - sizes
    return data, line_starts, line_ends, per_text


def repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """How many words of each line are the word before them again. No word goes on from one text into the next."""
    parted = np.insert(data, ends[np.cumsum(per_text) - 1], np.uint8(10))  # a line feed after each text
    first, _, hashes = word_hashes(parted)
    line = np.searchsorted(starts + np.repeat(np.arange(len(per_text)), per_text), first, "right") - 1
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])) + 1
    return np.bincount(line[again], minlength=len(starts)).astype(np.float64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', bytes of each line, lines per text)."""
    data, starts, ends, per_text = lines_of(texts)
    size = (ends - starts).astype(np.float64)
    count: dict[str, np.ndarray] = {}
    for t, (low, high) in zip(TABLES, PAIRS, strict=True):
        sums = np.concatenate([[0], np.cumsum(t[data])])
        both = sums[ends] - sums[starts]
        count[low], count[high] = (both & 0xFFFFFFFF).astype(np.float64), (both >> 32).astype(np.float64)
    letters, words = count["upper"] + count["lower"], count["blank"] + 1
    n = np.maximum(size, 1)
    last = np.where(size > 0, data[np.maximum(ends - 1, 0)] if len(data) else 0, 0)
    own = np.zeros((len(size), OWN))
    own[:, 0] = size == 0
    own[:, 1] = np.log1p(size) / 8
    own[:, 2] = count["upper"] / np.maximum(letters, 1)
    own[:, 3] = own[:, 2] > 0.6
    own[:, 4] = np.minimum(1, 5 * count["noise"] / n)
    own[:, 5] = count["noise"] / n > 0.04
    own[:, 6] = np.minimum(1, count["pipe"] / words)
    own[:, 7] = count["pipe"] / words > 0.2
    own[:, 8] = np.minimum(1, count["bang"] / words)
    own[:, 9] = count["bang"] / words > 0.2
    own[:, 10] = count["digit"] / n
    own[:, 11] = np.minimum(1, 4 * count["stop"] / n)
    own[:, 12] = letters / n
    own[:, 13] = np.minimum(2, n / words / 10)
    own[:, 14] = (last == ord("|")) | (last == ord(">"))
    own[:, 15] = size > 400
    own[:, 16] = repeats(data, starts, ends, per_text) / words
    width = 3 * OWN + 3
    out = np.zeros((len(size), width))
    out[:, :OWN] = own
    first = np.cumsum(per_text) - per_text
    lasts = first + per_text - 1
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[first, OWN : 2 * OWN] = 0
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[lasts, 2 * OWN : 3 * OWN] = 0
    out[first, 3 * OWN] = 1
    out[lasts, 3 * OWN + 1] = 1
    out[:, 3 * OWN + 2] = 1
    return out, np.maximum(size, 1), per_text


def marginals(scores: np.ndarray, per_text: np.ndarray, moves: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line by forward-backward, and the expected number of moves between states, each text's by its weight.

    scores: log-odds of good from the features; moves: 2 x 2 log-weights from state to state (1 is good). The texts
    advance together, line by line, those with most lines first, so each step is a few array operations.
    """
    weight = np.exp(moves)
    odds = np.exp(np.clip(scores, -30, 30))
    order = np.argsort(-per_text, kind="stable")
    first = (np.cumsum(per_text) - per_text)[order]
    lengths = per_text[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), "right")
    ahead, back = np.zeros(len(scores)), np.full(len(scores), 0.5)
    p = None
    for t in range(steps):
        at = first[: active[t]] + t
        good, bad = odds[at], 1.0
        if t:
            q = p[: active[t]]
            good, bad = good * (q * weight[1, 1] + (1 - q) * weight[0, 1]), q * weight[1, 0] + (1 - q) * weight[0, 0]
        p = good / (good + bad)
        ahead[at] = p
    expected, share = np.zeros((2, 2)), np.ones(len(order)) if weights is None else weights[order]
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        at = first[:n] + t
        good, bad = back[at + 1] * odds[at + 1], 1 - back[at + 1]
        to_good, to_bad = weight[1, 1] * good + weight[1, 0] * bad, weight[0, 1] * good + weight[0, 0] * bad
        q = ahead[at]
        joint = [[(1 - q) * weight[0, 0] * bad, (1 - q) * weight[0, 1] * good], [q * weight[1, 0] * bad, q * weight[1, 1] * good]]
        total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        for i in (0, 1):
            for j in (0, 1):
                expected[i, j] += (joint[i][j] / total * share[:n]).sum()
        back[at] = to_good / (to_good + to_bad)
    both = ahead * back
    return both / (both + (1 - ahead) * (1 - back)), expected


@dataclass
class Field:
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, bytes of each line, lines per text)."""
        x, size, per_text = features(texts)
        return marginals(x @ self.weights, per_text, self.moves)[0], size, per_text

    def score(self, texts: pa.Array) -> np.ndarray:
        return self.scaled(*self.lines(texts)) if len(texts) else np.zeros(0)

    def scaled(self, good: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean_odds(good, size, per_text) + self.shift, -40, 40)))


def mean_odds(good: np.ndarray, size: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Log-odds of each text's mean marginal, a line weighing its bytes."""
    first = np.cumsum(per_text) - per_text
    mean = np.clip(np.add.reduceat(good * size, first) / np.add.reduceat(size, first), 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 2, steps: int = 120, decay: float = 1e-4, rate: float = 0.1) -> Field:
    """A field from documents' labels.

    A line first has its document's label. As a bad document may hold good lines, a second round takes those of its lines
    for good that the first one's features call good, unless that were all of them. Then score is fitted to the labels.
    """
    parts = [features(texts.slice(a, b - a)) for a, b in slices(texts, SLICE)]  # a part's temporary arrays are many times its text
    x, size, per_text = (np.concatenate(p) for p in zip(*parts, strict=True))
    owner = np.repeat(np.arange(len(per_text)), per_text)
    y = labels.astype(float)[owner]
    field = Field(np.zeros(x.shape[1]), np.zeros((2, 2)))
    joined = owner[1:] == owner[:-1]
    per_doc = np.minimum(1.0, 8.0 / per_text)  # a long document counts as eight lines
    per_line = per_doc[owner]
    for k in range(rounds):
        if k:
            called = (x @ field.weights > 2.0) & (y == 0)
            bad_bytes = np.bincount(owner, np.where(called, 0, size) * (y == 0), len(per_text))
            y = np.where(called & (bad_bytes[owner] > 0), 1.0, y)
        seen = np.array([[(per_line[1:] * ((y[:-1] == i) & (y[1:] == j) & joined)).sum() for j in (0, 1)] for i in (0, 1)])
        first, second = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for step in range(1, steps + 1):
            good, expected = marginals(x @ field.weights, per_text, field.moves, per_doc)
            slope = np.concatenate([x.T @ ((y - good) * per_line) / per_line.sum() - decay * field.weights, (seen - expected).ravel() / per_line.sum()])
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            field.weights = field.weights + move[:-4]
            field.moves = field.moves + move[-4:].reshape(2, 2)
    at, target = mean_odds(marginals(x @ field.weights, per_text, field.moves)[0], size, per_text), labels.astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number, held back a little
        p = 1 / (1 + np.exp(-np.clip(a * at + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((target - p) * at).sum() - 0.1 * a, (target - p).sum()])
        h = np.array([[(w * at * at).sum() + 0.1, (w * at).sum()], [(w * at).sum(), w.sum() + 1e-3]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-8:
            break
    field.slope, field.shift = max(float(a), 1e-3), float(b)
    return field


def some_parts(longest: int) -> Column:
    """text, or of a longer one than that WINDOWS parts drawn by hash, in their order and on lines of their own."""
    size = max(1, longest // WINDOWS)
    numbers = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    drawn = F.slice(F.array_sort(F.transform(numbers, lambda i: F.struct(F.xxhash64("hash", i).alias("by"), i.alias("i")))), 1, WINDOWS)
    parts = F.transform(F.array_sort(F.transform(drawn, lambda d: d["i"])), lambda i: F.substring("text", i * size + 1, F.lit(size)))
    return F.when(F.length("text") > longest, F.concat_ws("\n", parts)).otherwise(F.col("text"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Field:
    """A field from a bounded sample of labelled documents that are not held out.

    The sample is drawn from the labels of documents that are there, of any length, so only its documents' texts are
    moved. Null labels and ids are left out; of several labels of an id the largest holds, and of several texts of an id the one
    of smallest hash. Of texts over ``longest`` characters some parts are learned from, drawn by hash over the whole text. Without a
    label of each kind every line is as good as bad.
    """
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), "doc_id")  # sample rows of two numbers
    least = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("hash").alias("hash"))
    found = rows.select("doc_id", "hash", some_parts(longest).alias("text")).join(F.broadcast(least), ["doc_id", "hash"]).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    found = found.orderBy("doc_id").toArrow()  # a row for each of the sample
    quality = found["quality"].to_numpy()
    if not len(quality) or quality.min() == quality.max():
        return Field(np.zeros(3 * OWN + 3), np.zeros((2, 2)))
    field = fit(found["text"].combine_chunks(), quality > 0)
    del found
    hand_back()
    return field


def score_documents(docs: DataFrame, field: Field, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, good_lines) of every row of docs, from its whole text alone.

    A null or empty text is one empty line and has the score of that. Rows of equal or null doc_id each have a row. Other
    columns of docs are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @handing_back
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE):
                yield scored(batch.slice(a, b - a), field, cut)

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(judge, f"doc_id {id_type}, held_out boolean, score double, predicted int, n_lines long, good_lines long")


def scored(batch: pa.RecordBatch, field: Field, cut: float) -> pa.RecordBatch:
    good, size, per_text = field.lines(batch.column("text"))
    score, first = field.scaled(good, size, per_text), np.cumsum(per_text) - per_text
    fine = np.add.reduceat((good >= 0.5).astype(np.int64), first)
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= cut).astype(np.int32)), pa.array(per_text.astype(np.int64)), pa.array(fine)], ["doc_id", "held_out", "score", "predicted", "n_lines", "good_lines"])


def keep_good(docs: DataFrame, field: Field, cut: float = CUT) -> DataFrame:
    """The rows of docs whose score reaches cut, with docs' columns. Rows are judged where they are: nothing is shuffled.

    A null or empty text is one empty line. Equal rows stay or go together. Columns of docs may have any names.
    """
    schema = docs.schema

    @handing_back
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(field.score(part.column("text")) >= cut))

    return docs.mapInArrow(keep, schema)


def label_lines(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, line, start, length, p_good, good): every line of every text, start and length in bytes of UTF-8.

    A null or empty text is one empty line. Rows of equal or null doc_id each have their lines.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    @handing_back
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                _, starts, ends, per_text = lines_of(part.column("text"))
                good = field.lines(part.column("text"))[0]
                first = np.cumsum(per_text) - per_text
                number, base = np.arange(len(good)) - np.repeat(first, per_text), np.repeat(starts[first], per_text)
                ids = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(per_text)), per_text)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int64)), pa.array(starts - base), pa.array(ends - starts), pa.array(good), pa.array(good >= 0.5)], ["doc_id", "line", "start", "length", "p_good", "good"])

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {id_type}, line long, start long, length long, p_good double, good boolean")


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
