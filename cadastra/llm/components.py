"""Connected components of a graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.shared import held, spread_join

FOREST_ROWS = 200_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to as few that connect the same nodes: union-find over so many links at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def pack() -> pa.RecordBatch:
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        a, b = (np.array(c, np.int64) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(a)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > FOREST_ROWS:
            yield pack()
            parent.clear()
    if parent:
        yield pack()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link: the smallest node that it is connected with.

    links has whole numbers a and b. Links are thinned by union-find within partitions; then large-star and small-star
    steps alternate until nothing changes, as many as the logarithm of the nodes squared at most. Each step's links
    are held in the shared folder. A hub's links are dealt over several tasks.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    edges = held(pairs.mapInArrow(forest, "a long, b long"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both, least, ["a"], ["b"]).where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # b's smaller neighbours, among them a: all of them and b go to the least
        own = large.groupBy("b").agg(F.min("a").alias("m"))
        small = spread_join(large, own, ["b"], ["a"])
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = held(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    node = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return node.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
