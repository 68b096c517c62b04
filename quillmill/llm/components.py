"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import met, written


def forest(edges: np.ndarray) -> np.ndarray:
    """Edges (n x 2) as a spanning forest: each node that is not its tree's smallest one, with that smallest one."""
    nodes, flat = np.unique(edges, return_inverse=True)
    ends = flat.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:  # hook each root to the least root that it meets, then shorten the paths
        a, b = root[ends[:, 0]], root[ends[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != (up := root[root])).any():
            root = up
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[away], nodes[root[away]]], axis=1)


def _forest_of_task(batches, most: int = 1 << 20):
    """A task holds the edges of a forest and at most about `most` new ones."""
    parts, n = [], 0
    for b in batches:
        parts.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
        n += b.num_rows
        if n > most:
            parts, n = [forest(np.concatenate(parts))], 0
    if parts:
        held = forest(np.concatenate(parts))
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], ["a", "b"])


def components(edges: DataFrame, one_task: int = 1 << 20) -> DataFrame:
    """edges (a long, b long) -> node, component (its smallest node) of every node but those smallest ones.

    Every task first reduces its edges to a forest. Where at most `one_task` edges are left, one task joins these forests.
    Beyond that large-star and small-star rounds (each node's neighbours are
    linked to the least of them) run as joins until no edge changes; what is left are stars around the smallest nodes.
    A node with very many neighbours is no task of its own: each node's least neighbour is found by a pre-aggregated
    groupBy and written, so that edges meet it in a join whose skewed partitions Spark splits. No edge comes to the
    driver, only counts do. Defined results: no edges give no rows; loops and repeated edges don't count; a null end is
    no edge."""
    reduced = edges.select("a", "b").where("a <> b").mapInArrow(_forest_of_task, "a long, b long")
    now = written(reduced.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= one_task:  # counted from the written table; 16 bytes an edge
        return written(now.repartition(1).mapInArrow(_forest_of_task, "a long, b long"), "roots").select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        # large star: neighbours above a node go to the least node around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = met(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: a node and its lower neighbours go to the least of these
        down = written(large.distinct(), "down")
        lowest = written(down.groupBy("a").agg(F.min("b").alias("m")), "lowest")
        small = met(down, lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
        now = written(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state


def first_of_each(items: DataFrame, roots: DataFrame) -> DataFrame:
    """items (node, least: a struct to compare), roots (of components) -> node, first: the least of the node's component.
    A component's least is found by a pre-aggregated groupBy and written, so a big component is joined by skew splits."""
    component = F.coalesce("component", "node").alias("component")
    classes = written(met(items, roots, "node", "left").select("node", "least", component), "classes")
    first = written(classes.groupBy("component").agg(F.min("least").alias("first")), "first")
    return met(classes, first, "component").select("node", "first")
