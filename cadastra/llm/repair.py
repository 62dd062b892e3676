"""Repair of the structure of conversations: the cheapest edits, and among those the edits whose initials are least.

Turns are sorted by conversation in a range-partitioned shuffle, so that a conversation may lie in any number of partitions, and
are gone through in blocks of at most 65,536. What lies between two of a conversation's cuts is summed up by the least costs from
each state to each (a 4 by 4 matrix under min and plus), so a conversation's costs come from its summaries alone. With the costs
that follow a block, each block has its own optimal arcs. The nodes (a place between turns and a state) are ranked by the letters of
their least audits of lengths 1, 2, 4 and so on: a rank of twice the length comes of the ranks of a node and of the one that its
pointer reaches, and pointers double with them. The letters at a node's arcs all differ, so one pointer a node is enough.

States: 0 nothing yet, 1 after a leading system turn, 2 after a user's turn, 3 after an assistant's. A conversation may end in 0 or 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.shared import spread_join, table, written

WHITE = " \t\n\x0b\x0c\r"
#: Of a conversation's rows in one partition, those with the same number above these bits of their place are a block.
BLOCK_BITS = 16
NEVER = np.int64(1) << 40
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
#: The state after a turn that begins with s, u, a or anything else, by the state before; 4 is none.
NEXT = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4], [4, 4, 4, 4]])
#: The state after the only turn of a user or an assistant that may follow.
TURNED = np.array([2, 2, 3, 2])
#: The cost from each state to the end with no turn left, and the letters of it.
AT_END, LAST_LETTERS = np.array([0, 2 * INSERT, INSERT, 0], np.int64), ("", "II", "I", "")
LETTERS = "DIKR"
NO_TEXT = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """rows' conv_id, turn, role and text as crc32 of ``conv_id:turn`` mod 20 damages them; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20).alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(F.col("code") != 0).select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def conv_key(conv_id: Column) -> Column:
    """A string that is never null, and another one for each id."""
    return F.when(conv_id.isNull(), "-").otherwise(F.concat(F.lit("+"), conv_id.cast("string")))


def sorted_turns(rows: DataFrame) -> DataFrame:
    """The rows in order, as a written table: pos is a number that rises with conversation and turn."""
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring("role", 1, 1)).cast("int"), F.lit(0))
    end = F.rtrim("text", F.lit(WHITE))
    rows = rows.select(conv_key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"initial": F.when(initial == 0, 3).otherwise(initial - 1), "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?"), "digest": F.unhex(F.sha2(F.concat(F.sha2("role", 256), "text"), 256)), "head": F.substring("text", 1, 256), "row": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "head", "digest", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("head", "row")
    return written(rows.withColumn("pos", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """pos, block, conv, turn, initial and the first fault of each turn, as a written table."""
    again = turns.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    found = spread_join(turns.select("pos", "conv", "turn", "initial", "blank", "cut", "digest"), again, ["conv", "digest"], ["pos"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    return written(found.select("pos", F.shiftright("pos", BLOCK_BITS).alias("block"), "conv", "turn", "initial", fault.alias("fault")), "faults")


class Block:
    """The turns of a block, in order, and its runs of turns of one conversation."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("pos").combine_chunks()
        self.pos, self.initial, self.fault = (rows[c].to_numpy() for c in ("pos", "initial", "fault"))
        conv = rows["conv"].combine_chunks().dictionary_encode()
        codes = conv.indices.to_numpy()
        self.starts = np.flatnonzero(np.diff(codes, prepend=-1))
        self.lengths = np.diff(np.append(self.starts, len(codes)))
        self.convs = conv.dictionary.take(pa.array(codes[self.starts])).to_pylist()
        self.block = rows["block"][0].as_py()
        self.keep = np.where((self.fault == BLANK) | (self.fault == DUPLICATE), NEVER, np.where(self.fault == CUT, TRUNCATED, 0))

    def turns_backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(runs, their turns): each run's last turn, then the one before and so on, many runs at once."""
        longest = np.argsort(-self.lengths, kind="stable")
        many = np.searchsorted(-self.lengths[longest], -np.arange(self.lengths.max()), "left")  # runs longer than t
        for t in range(int(self.lengths.max()) - 1, -1, -1):
            runs = longest[: many[t]]
            yield runs, self.starts[runs] + t

    def before(self, turns: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Costs at the places before turns from those after them: (turns, states and none, ...)."""
        k, keep = np.arange(len(turns)), self.keep[turns].reshape(-1, *[1] * (after.ndim - 2))
        own = np.stack([np.minimum(after[:, s] + DELETE, keep + np.minimum(after[k, NEXT[s, self.initial[turns]]], after[:, TURNED[s]] + REROLE)) for s in range(4)], 1)
        user, assistant = own[:, 2].copy(), own[:, 3].copy()
        for s in (0, 1):
            own[:, s] = np.minimum(own[:, s], np.minimum(user + INSERT, assistant + 2 * INSERT))
        own[:, 2], own[:, 3] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
        return np.minimum(own, NEVER)

    def matrices(self) -> np.ndarray:
        """The least cost of each run from each state to each."""
        costs = np.full((len(self.starts), 5, 4), NEVER)
        costs[:, range(4), range(4)] = 0
        for runs, turns in self.turns_backward():
            costs[runs, :4] = self.before(turns, costs[runs])
        return costs[:, :4]

    def illegal(self) -> np.ndarray:
        """Of each run, the turns whose initial may not follow the one before."""
        a, b = self.initial[:-1], self.initial[1:]
        bad = np.concatenate([[0], ~(((a == 0) | (a == 2)) & (b == 1) | (a == 1) & (b == 2))]).astype(np.int64)
        bad[self.starts] = 0
        return np.add.reduceat(bad, self.starts)

    def optimal(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first letter of the least audit, node that it leads to) by node; nodes at a run's end have letter 0 and lead to themselves.

        after: the costs from each state at each run's end. The node of the place before turn i of run r, in state s, is 4 * (i + r) + s.
        """
        places = len(self.pos) + len(self.starts)
        costs = np.full((places, 5), NEVER)
        ends = self.starts + self.lengths + np.arange(len(self.starts))
        costs[ends, :4] = after
        for runs, turns in self.turns_backward():
            costs[turns + runs, :4] = self.before(turns, costs[turns + runs + 1])
        letter, to = np.zeros((places, 4), np.int64), np.arange(4 * places).reshape(places, 4)
        run = np.repeat(np.arange(len(self.starts)), self.lengths)
        here = np.arange(len(self.pos)) + run
        for s in range(4):
            own = costs[here, s]
            kept = NEXT[s, self.initial]
            arcs = (  # from the greatest letter to the least
                (self.keep + REROLE + costs[here + 1, TURNED[s]], here + 1, TURNED[s]),
                (self.keep + costs[here + 1, kept], here + 1, kept),
                (INSERT + costs[here, TURNED[s]], here, TURNED[s]),
                (DELETE + costs[here + 1, s], here + 1, s),
            )
            for code, (cost, place, state) in zip((4, 3, 2, 1), arcs, strict=True):
                best = (cost == own) & (own < NEVER)
                letter[here[best], s] = code
                to[here[best], s] = (4 * place + state)[best]
        return letter.ravel(), to.ravel()


def doubled(letter: np.ndarray, to: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(pointers over 1, 2, 4, ... letters, ranks by whole audits): both double until every pointer is at its end."""
    pointers, rank = [to], letter
    while True:
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointers[-1]], return_inverse=True)[1]
        further = pointers[-1][pointers[-1]]
        if np.array_equal(further, pointers[-1]):
            return pointers, rank
        pointers.append(further)


def summaries(rows: pa.Table) -> pa.Table:
    """A row for each run of a block: its costs and its illegal neighbours."""
    own = Block(rows)
    last = own.starts + own.lengths - 1
    return pa.table({"conv": own.convs, "block": [own.block] * len(own.convs), "costs": pa.array(list(own.matrices().reshape(-1, 16)), pa.list_(pa.int64())), "illegal": own.illegal(), "head": own.initial[own.starts].astype(np.int32), "tail": own.initial[last].astype(np.int32)})


SUMMARY = "conv string, block long, costs array<long>, illegal long, head int, tail int"


def by_conv(answer, names: list[str], types: list[pa.DataType]):
    """A function over the batches of a table that is sorted by conversation and block: answer() gives columns for each one's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        groups = (answer(list(own)) for _, own in groupby(rows, key=lambda r: r["conv"]))
        while some := list(islice(groups, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array(list(chain.from_iterable(x)), t) for x, t in zip(zip(*some, strict=True), types, strict=True)], names)

    return run


def in_order(df: DataFrame) -> DataFrame:
    """A conversation's rows, of which there is one a block, together and in order."""
    return df.repartition("conv").sortWithinPartitions("conv", "block")


def chained(parts: list[dict]) -> tuple[list, ...]:
    """A conversation's summaries with the costs that follow each, whether it is the first or last, and the whole cost."""
    after, follow = AT_END, []
    for part in reversed(parts):
        follow.append(after)
        after = (np.array(part["costs"]).reshape(4, 4) + after).min(1)
    legal = {(0, 1), (1, 2), (2, 1)}
    illegal = sum(p["illegal"] for p in parts) + sum((p["tail"], q["head"]) not in legal for p, q in zip(parts[:-1], parts[1:], strict=True))
    n = len(parts)
    return [p["conv"] for p in parts], [p["block"] for p in parts], follow[::-1], [i == 0 for i in range(n)], [i == n - 1 for i in range(n)], [int(after[0])] * n, [illegal] * n


CHAIN = "conv string, of_block long, after array<long>, first boolean, last boolean, cost long, illegal long"
CHAIN_TYPES = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]


def least_audits(rows: pa.Table, follow: pa.Table) -> pa.Table:
    """For each run of a block, from each state in which it may begin: the least audit, the roles that it gives, the state at its end.

    roles: a letter for each of the audit's: u or a for turns that are inserted or get another role, else a blank.
    """
    own = Block(rows)
    follows = {c: (a, f, last) for c, a, f, last in zip(*(follow[k].to_pylist() for k in ("conv", "after", "first", "last")), strict=True)}
    pointers, _ = doubled(*(found := own.optimal(np.array([follows[c][0] for c in own.convs], np.int64))))
    letter = found[0]
    entries = np.array([(r, s) for r, c in enumerate(own.convs) for s in range(1 if follows[c][1] else 4)])
    nodes = 4 * (own.starts + np.arange(len(own.starts)))[entries[:, 0]] + entries[:, 1]
    audits, roles, exits = ([""] * len(nodes) for _ in range(3))
    level = np.ceil(np.log2(2 * own.lengths[entries[:, 0]] + 2)).astype(int)  # at most one insertion before each turn, and two at first
    for k in np.unique(level):
        some = np.flatnonzero(level == k)
        path = nodes[some][:, None]
        for p in pointers[: k + 1]:
            path = np.concatenate([path, p[path]], 1)
        said = letter[path]
        length = (said > 0).sum(1)
        text = np.frombuffer(b" DIKR", np.uint8)[said]
        given = np.where((said[:, :-1] == 2) | (said[:, :-1] == 4), np.where(path[:, 1:] % 4 == 2, ord("u"), ord("a")), ord(" ")).astype(np.uint8)
        for i, n, t, g, end in zip(some, length, text, given, path[np.arange(len(some)), length] % 4, strict=True):
            audits[i], roles[i], exits[i] = t[:n].tobytes().decode(), g[:n].tobytes().decode(), int(end)
    cuts = np.searchsorted(entries[:, 0], np.arange(1, len(own.starts)))
    by_run = lambda values: [x.tolist() for x in np.split(np.array(values, object), cuts)]
    n = len(own.convs)
    return pa.table({"conv": own.convs, "block": [own.block] * n, "pos": own.pos[own.starts], "audits": pa.array(by_run(audits), pa.list_(pa.string())), "roles": pa.array(by_run(roles), pa.list_(pa.string())), "exits": pa.array(by_run(exits), pa.list_(pa.int32())), "last": [follows[c][2] for c in own.convs]})


AUDITS = "conv string, block long, pos long, audits array<string>, roles array<string>, exits array<int>, last boolean"


def joined_audits(parts: list[dict]) -> tuple[list, ...]:
    """A conversation's runs with the audit and roles from the state in which each begins; turns after the last are added to it."""
    state, out = 0, []
    for part in parts:
        audit, roles = part["audits"][state], part["roles"][state]
        state = part["exits"][state]
        more = LAST_LETTERS[state] if part["last"] else ""
        out.append((part["conv"], part["block"], part["pos"], audit + more, roles + ("ua" if len(more) == 2 else "a" if more else "")))
    return tuple(map(list, zip(*out, strict=True)))


EDITED = "conv string, block long, pos long, audit string, roles string"
EDITED_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def names_of(ddl: str) -> list[str]:
    return [column.split(" ")[0] for column in ddl.split(", ")]


def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each letter of an audit: the place of its turn (the next one's, if it is inserted), its number and its role."""
    for batch in batches:
        audits = batch.column("audit").to_pylist()
        size = np.array([len(a) for a in audits], np.int64)
        if not size.sum():
            continue
        letters = np.frombuffer("".join(audits).encode(), np.uint8)
        run, first = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size) - size, size)
        turn = (letters != ord("I")).astype(np.int64)
        before = np.cumsum(turn) - turn
        pos = batch.column("pos").to_numpy()[run] + before - before[first]
        given = pa.array(list("".join(batch.column("roles").to_pylist())), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("conv").take(pa.array(run)), pa.array(pos), pa.array(np.arange(len(run)) - first), pa.array(list("".join(audits)), pa.string()), given], ["conv", "pos", "letter", "op", "given"])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each conversation's ``role:text`` lines, of rows sorted by conversation; only one hash is open at a time."""
    conv, digest = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv", "role", "text")), strict=True):
            if c == conv:
                digest.update(b"\n")
            else:
                if digest:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["conv", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])


class Repair:
    """The repair of a table of conversations: conv_id, turn, role, text.

    Turns are in order of turn, nulls first; turns of one number in order of role, the text's first 256 characters and a digest. Null
    roles and texts are empty; null ids are one conversation. A turn whose role begins with neither s, u nor a cannot be kept as it is.
    Repeated rows are duplicates. Two texts count as the same when SHA-256 of role and text is. Other columns are not looked at.
    """

    def __init__(self, rows: DataFrame):
        self.turns = sorted_turns(rows)
        self.faults = with_faults(self.turns)
        runs = self.faults.groupBy("block").applyInArrow(summaries, SUMMARY)
        self.chain = written(in_order(runs).mapInArrow(by_conv(chained, names_of(CHAIN), CHAIN_TYPES), CHAIN), "chain")
        audits = self.faults.groupBy("block").cogroup(self.chain.groupBy("of_block")).applyInArrow(least_audits, AUDITS)
        self.edited = written(in_order(audits).mapInArrow(by_conv(joined_audits, names_of(EDITED), EDITED_TYPES), EDITED), "edited")

    def edits(self) -> DataFrame:
        """A row for each edit, in order of conv, pos and letter: op (an initial), role and text after it (null if deleted), turn."""
        steps = self.edited.mapInArrow(unrolled, "conv string, pos long, letter long, op string, given string")
        given = F.when(F.col("given") == "u", "user").when(F.col("given") == "a", "assistant")
        rows = steps.join(self.turns.select("pos", "turn", "role", "text").withColumn("op", F.explode(F.array(*map(F.lit, "DKR")))), ["pos", "op"], "left")
        stays = F.col("op") != "D"
        return rows.select("conv", "pos", "letter", "op", "turn", F.when(stays, F.coalesce(given, "role")).alias("role"), F.when(stays, F.coalesce("text", F.lit(""))).alias("text"))

    def texts(self) -> DataFrame:
        """conv and repaired_sha256 of conversations with a turn left. A conversation is one hash, so its turns go through one task, a batch at a time."""
        left = self.edits().where(F.col("op") != "D")
        return left.repartition("conv").sortWithinPartitions("conv", "pos", "letter").select("conv", "role", "text").mapInArrow(hashed, "conv string, repaired_sha256 string")

    def counts(self) -> DataFrame:
        """conv, gaps, blank, duplicate and truncated."""
        missing = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
        return self.faults.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).alias("gaps"), *(F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))))

    def audits(self) -> DataFrame:
        """conv and its whole audit."""
        parts = self.edited.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "audit"))).alias("parts"))
        return parts.select("conv", F.concat_ws("", F.col("parts.audit")).alias("audit"))


def op13_path_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = Repair(damaged(rows))
    ids = rows.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id"))).withColumn("own", F.lit(True))
    parts = [ids, done.counts(), done.chain.where("first").select("conv", "illegal", "cost"), done.audits(), done.texts()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    long = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = whole.groupBy("conv").agg(F.max("conv_id").alias("conv_id"), *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in long), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(NO_TEXT)).alias("repaired_sha256"))
    return found.drop("conv")
