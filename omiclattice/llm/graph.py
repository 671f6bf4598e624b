"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm.storage import settle


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links at hand."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def forest(links: DataFrame) -> DataFrame:
    """Replace the links (a, b) of each partition by the stars that they span."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            node, root = local_components(*(np.concatenate(x) for x in zip(*got)))
            keep = node != root
            yield pa.RecordBatch.from_pydict({"a": root[keep], "b": node[keep]})

    return links.select("a", "b").mapInArrow(span, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable by links (a, b), for every node of a link.

    Alternates large-star and small-star steps until a round changes nothing.
    A node with very many links is only ever a join key against its minimum.
    """
    at, seen = settle(forest(links)), None
    while True:
        for large in (True, False):
            both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
            met = both.join(low, "a")
            if large:
                new = met.where("b > a").select(F.col("low").alias("a"), "b")
            else:
                down = met.where("b < a")
                new = down.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
            at = settle(new.where("a <> b").distinct())
        now = at.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == seen:
            break
        seen = now
    roots = at.select(F.col("a").alias("node")).distinct()
    return at.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("node", F.col("node").alias("component")))
