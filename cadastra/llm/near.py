"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification and grouping."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.components import components
from cadastra.llm.shared import handing_back, spread_join, table, written
from cadastra.llm.superminhash import band_keys, packed_codes, signatures
from cadastra.llm.tokens import slices
from cadastra.llm.words import mix, shingle_sets

WORDS = 5
#: Linked from 100 * intersection >= percent * union on; this is the default.
PERCENT = 85
#: Places of a signature that make a band.
ROWS = 5
#: Texts that share a bucket get a second signature of so many places, 2 bits a place, so that a quarter of the places in
#: which two differ agree by chance. Pairs that agree in too few are not verified: 5.5 standard deviations below what a
#: pair at the limit expects.
WIDE = 1024
#: In how many of the first 256 places, and of all, they may differ: the first count spares most of the second.
FIRST = 256
ODD_BITS = np.uint64(0x5555555555555555)
#: Members of a bucket are compared in chunks of about this many.
CHUNK = 1024
SLICE = 2 << 20


def bands_for(percent: int) -> int:
    """So many bands that a pair at the limit shares none with probability (1 - (percent / 100) ** ROWS) ** bands < 1e-7."""
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    return 1 if percent == 100 else math.ceil(math.log(1e-7) / math.log1p(-((percent / 100) ** ROWS)))


def differ_for(percent: int) -> dict[int, int]:
    """In how many of the first so many places of the second signature two texts at the limit may differ."""
    p = (1 - percent / 100) * 0.75
    return {n: math.ceil(n * p + 5.5 * math.sqrt(n * (1 - p) * p)) for n in (FIRST, WIDE)}


def set_ids(values: np.ndarray, counts: np.ndarray) -> list[str | None]:
    """A 128-bit name of each set, None for empty ones."""
    first = np.cumsum(counts) - counts
    full = np.flatnonzero(counts)
    names: list[str | None] = [None] * len(counts)
    if len(full):
        sums = [np.add.reduceat(mix(values ^ np.uint64(seed)), first[full]) for seed in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)]
        for i, n, a, b in zip(full.tolist(), counts[full].tolist(), *(s.tolist() for s in sums), strict=True):
            names[i] = f"{a ^ n:016x}{b:016x}"
    return names


def sketches(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, text_md5) of every row; set_id and bands are null for an empty set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    bands = bands_for(percent)

    @handing_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts, SLICE):
                values, counts = shingle_sets(texts.slice(a, b - a), words)
                places = signatures(values, counts, bands * ROWS)
                empty = counts == 0
                keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(places, ROWS).astype(np.int64).reshape(-1)), bands).cast(pa.list_(pa.int64()))
                keys = pa.array([None if e else k for e, k in zip(empty, keys.to_pylist(), strict=True)], pa.list_(pa.int64())) if empty.any() else keys
                md5s = [hashlib.md5((t or "").encode(), usedforsecurity=False).hexdigest() for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(counts.astype(np.int64)), pa.array(set_ids(values, counts), pa.string()), keys, pa.array(md5s, pa.string())], ["doc_id", "n_shingles", "set_id", "bands", "text_md5"])

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {id_type}, n_shingles long, set_id string, bands array<long>, text_md5 string")


def name_of(column: str):
    """An id as a join key that matches null ids too."""
    return F.coalesce(F.col(column).cast("string"), F.lit("\x00null"))


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set_id, text) of the rows of docs that have the id and the text of a wanted set."""
    named = wanted.select("node", "set_id", name_of("first_id").alias("_name"), F.col("first_md5").alias("_text"))
    return docs.select(name_of("doc_id").alias("_name"), F.md5("text").alias("_text"), "text").join(named, ["_name", "_text"]).select("node", "set_id", "text")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles, codes) of the wanted (node, first_id, first_md5, set_id): the sets of those documents' whole texts.

    Ids and texts are joined together, so however many rows have an id, or none, a text comes once for each row that is the same.
    """

    @handing_back
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            fresh = np.diff(nodes, prepend=nodes[0] - 1 if last is None else last) != 0 if len(nodes) else np.zeros(0, bool)  # rows that are the same mostly come together
            last = nodes[-1] if len(nodes) else last
            batch = batch.filter(pa.array(fresh))
            texts = batch.column("text")
            for a, b in slices(texts, SLICE):
                values, counts = shingle_sets(texts.slice(a, b - a), words)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                sets = pa.ListArray.from_arrays(ends, values.view(np.int64))
                same = pa.array([x == y for x, y in zip(set_ids(values, counts), batch.column("set_id").slice(a, b - a).to_pylist(), strict=True)], pa.bool_())
                codes = pa.array([c.tobytes() for c in packed_codes(signatures(values, counts, WIDE))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), sets, codes], ["node", "shingles", "codes"]).filter(same)

    return texts_of(docs, wanted).mapInArrow(build, "node long, shingles array<long>, codes binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b")).cast("long")
    alike = both * 100 >= (F.size("_a") + F.size("_b") - both) * percent
    return pairs.select("a", "b").distinct().join(one, "a").join(two, "b").where(alike).select("a", "b")


def codes_of(codes: pa.Array) -> np.ndarray:
    """Packed codes as rows of 64-bit numbers, 32 places each."""
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(-1, WIDE // 32)


def agreeing(one: np.ndarray, two: np.ndarray, limits: dict[int, int]) -> np.ndarray:
    """Whether each row of one differs from two's in few enough places."""

    def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits = a ^ b
        return np.bitwise_count((bits | (bits >> np.uint64(1))) & ODD_BITS).sum(axis=1)

    enough = differences(one[:, : FIRST // 32], two[..., : FIRST // 32]) <= limits[FIRST]
    where = np.flatnonzero(enough)
    enough[where] = differences(one[where], two if two.ndim == 1 else two[where]) <= limits[WIDE]
    return enough


def star_pairs(members: DataFrame, full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the members of each bucket with its pivot, the smallest node, where they agree in enough places."""
    pivots = members.groupBy("key").agg(F.min("node").alias("pivot"))
    pairs = spread_join(members, pivots, ["key"], ["node"]).where("node <> pivot").select("node", "pivot").distinct()
    mine = full.select("node", "codes", F.size("shingles").alias("n"))
    theirs = full.select(F.col("node").alias("pivot"), F.col("codes").alias("_codes"), F.size("shingles").alias("_n"))
    sized = pairs.join(mine, "node").join(theirs, "pivot").where(F.least("n", "_n") * 100 >= F.greatest("n", "_n") * percent)
    limits = differ_for(percent)

    @handing_back
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = codes_of(batch.column("codes")), codes_of(batch.column("_codes"))
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("node")], ["a", "b"]).filter(pa.array(agreeing(one, two, limits)))

    return sized.select("node", "pivot", "codes", "_codes").mapInArrow(rate, "a long, b long")


def open_pairs(members: DataFrame, sets: DataFrame, full: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All pairs within a bucket that are similar enough but not yet in one component: (a, b).

    labels: (node, component) so far. Only buckets with several components are gone through. In each, the members
    outside its smallest component are compared with one another and with that component's, a chunk against a chunk, so
    that a group of near copies that is already joined is not paired up within itself. A pair is looked at in the
    first of the buckets that it shares.
    """
    rows = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where("_least < _most").select("key", "_least")
    rows = written(spread_join(rows, mixed, ["key"], ["node"]).select("key", "node", "component", (F.col("component") == F.col("_least")).alias("joined")), "near-open")
    counts = rows.groupBy("key").agg(F.count_if(~F.col("joined")).alias("_r"), F.count_if("joined").alias("_d"))
    chunks = counts.select("key", F.ceil(F.col("_r") / CHUNK).cast("int").alias("_cr"), F.ceil(F.col("_d") / CHUNK).cast("int").alias("_cd"))
    rows = spread_join(rows, chunks, ["key"], ["node"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("joined"), F.col("_cd")).otherwise(F.col("_cr"))).cast("int")
    rows = rows.withColumn("_own", own)
    # (left chunk, right chunk, right chunk is of the joined): the left ones are never of the joined
    cell = lambda x, y, d: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), d.alias("d"))
    others = F.sequence(F.lit(0), F.col("_cr") - 1)
    for_joined = F.transform(others, lambda x: cell(x, F.col("_own"), F.lit(True)))
    for_open = F.concat(
        F.transform(others, lambda x: cell(F.least(x, F.col("_own")), F.greatest(x, F.col("_own")), F.lit(False))),
        F.transform(F.sequence(F.lit(0), F.col("_cd") - 1), lambda y: cell(F.col("_own"), y, F.lit(True))),
    )
    dealt = rows.select("key", "node", "component", "joined", "_own", F.explode(F.when(F.col("joined"), for_joined).otherwise(for_open)).alias("c"))
    dealt = dealt.select("key", "c.x", "c.y", "c.d", "node", "component", "joined", "_own").join(sets.select("node", "bands", "n_shingles").join(full.select("node", "codes"), "node"), "node")

    limits, width = differ_for(percent), bands_for(percent)

    def compare(batch: pa.RecordBatch) -> set[tuple[int, int]]:
        """The pairs of one chunk against another, which is what the batch holds."""
        key, x, y, d = (batch.column(c)[0].as_py() for c in ("key", "x", "y", "d"))
        node, component, joined, own, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "joined", "_own", "n_shingles"))
        left = np.flatnonzero(~joined & (own == x))
        right = np.flatnonzero(joined if d else ~joined & (own == y))
        found: set[tuple[int, int]] = set()
        if not len(left) or not len(right):
            return found
        codes = codes_of(batch.column("codes"))
        bands = batch.column("bands").flatten().to_numpy().reshape(-1, width)
        before = bands[:, : int(np.argmax(bands[0] == key))].astype(np.uint32)  # enough to tell them apart
        twice = not d and x == y
        for i in left:
            fits = right[right > i] if twice else right
            fits = fits[component[fits] != component[i]]
            fits = fits[(n[fits] * 100 >= n[i] * percent) & (n[i] * 100 >= n[fits] * percent)]
            if len(fits):
                fits = fits[~(before[fits] == before[i]).any(axis=1)]
            if len(fits):
                found.update((int(min(node[i], node[j])), int(max(node[i], node[j]))) for j in fits[agreeing(codes[fits], codes[i], limits)])
        return found

    @handing_back
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None  # the last group so far, which may go on in the next batch

        def pack(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*sorted(pairs), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "x", "y", "d")])
            cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
            pairs: set[tuple[int, int]] = set()
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                pairs |= compare(batch.slice(a, b - a))
            rest = batch.slice(int(cuts[-1]) if len(cuts) else 0)
            if pairs:
                yield pack(pairs)
        if rest is not None and rest.num_rows and (pairs := compare(rest)):
            yield pack(pairs)

    cell_of = ["key", "x", "y", "d"]
    return dealt.repartition(*cell_of).sortWithinPartitions(*cell_of).mapInArrow(stream, "a long, b long")


class JoinedSets(NamedTuple):
    rows: DataFrame  # doc_id, n_shingles, set_id, text_md5 of every row of the documents
    tops: DataFrame  # set_id, first_id, component of every set that is not empty


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Sets are linked from 100 * intersection >= percent * union on. Rows of equal shingle sets are one node. Nodes meet in the buckets of their bands. First each node is held against
    its buckets' pivots; what the full sets confirm is joined. Then, in every bucket, each pair that is
    not yet in one component and agrees in enough places is held against the full sets as well. So a link between
    components is missed only if its pair meets in no band or falls short by chance: under 1e-6 at the limit.

    component_id is the smallest doc_id of the component (null only if all are null); kept: doc_id is component_id. A
    text without words, or null, has the set size 0 and is a component of its own. Rows of equal doc_id each have a row.
    """
    sets = joined_sets(docs, words, percent)
    ids = sets.tops.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_set = written(spread_join(sets.tops, ids, ["component"], ["set_id"]).select("set_id", "component_id", F.lit(True).alias("_found")), "near-components")
    out = spread_join(sets.rows.select("doc_id", "n_shingles", "set_id"), by_set, ["set_id"], ["doc_id"], "left")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def joined_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> JoinedSets:
    """The rows' sets and the sets' components, as near_components() describes them."""
    docs = docs.select("doc_id", "text")
    rows = written(sketches(docs, words, percent), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5")).alias("first")
    grouped = rows.where("n_shingles > 0").groupBy("set_id").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    grouped = grouped.select("set_id", F.col("first.doc_id").alias("first_id"), F.col("first.text_md5").alias("first_md5"), "n_shingles", "bands")
    sets = written(grouped.withColumn("node", F.monotonically_increasing_id()), "near-sets")
    keys = sets.select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key"), "near-keys")
    members = written(keys.join(shared, "key"), "near-members")
    wanted = written(members.select("node").distinct().join(sets.select("node", "first_id", "first_md5", "set_id"), "node"), "near-wanted")
    full = written(full_sets(docs, wanted, words), "near-full")
    first = written(components(verified(star_pairs(members, full, percent), full, percent)), "near-first")
    links = verified(open_pairs(members, sets, full, first, percent), full, percent)
    # the second round's links, between the components of the first
    one = first.select(F.col("node").alias("a"), F.col("component").alias("_a"))
    two = first.select(F.col("node").alias("b"), F.col("component").alias("_b"))
    contracted = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    second = components(contracted).select(F.col("node").alias("component"), F.col("component").alias("_top"))
    everything = sets.select("set_id", "node", "first_id").join(first, "node", "left").select("set_id", "first_id", F.coalesce("component", "node").alias("component"))
    everything = everything.join(second, "component", "left").select("set_id", "first_id", F.coalesce("_top", "component").alias("component"))
    return JoinedSets(rows, written(everything, "near-tops"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near dedup keeps, with docs' columns: one of every component.

    That is the row of the smallest doc_id, a null id counting as the largest, and of rows of that id the one whose text
    has the smallest MD5; of rows equal in both, any one. Rows without words, or with a null text, are linked with nothing
    and all stay. Columns of docs may have any names.
    """
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), "doc_id", "text", name_of("doc_id").alias("_name"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    sets = joined_sets(docs, words, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5"))
    rows = spread_join(sets.rows.where("n_shingles > 0").select("doc_id", "text_md5", "set_id"), sets.tops, ["set_id"], ["doc_id", "text_md5"])
    kept = rows.groupBy("component").agg(best.alias("b")).select(name_of("b.doc_id").alias("_name"), F.col("b.text_md5").alias("_text")).distinct()
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    chosen = own.where(wordy).join(kept, ["_name", "_text"]).dropDuplicates(["_name", "_text"])
    both = own.where(~wordy).select("_in").unionByName(chosen.select("_in"))
    return both.select(*(F.col("_in")[c].alias(c) for c in docs.columns))


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), percent=85)


OP6_SQL = r"""
WITH RECURSIVE
 t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
 f AS (SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 e AS (SELECT DISTINCT doc_id, hash(x) AS x FROM f WHERE i <= greatest(1, n - 4)),
 n AS (SELECT t.doc_id, count(x) AS n_shingles FROM t LEFT JOIN e ON e.doc_id = t.doc_id GROUP BY 1),
 c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n_shingles + q.n_shingles - k)),
 r(doc_id, top) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.doc_id WHERE r.top < l.b),
 m AS (SELECT doc_id, min(top) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""
