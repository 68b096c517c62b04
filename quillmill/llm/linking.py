"""From cells of similar sketches to exactly verified components, without a row for each pair.

1. `cell_edges`: rows (cell, item, sketch words) -> links within cells: of each cell a spanning forest of the pairs whose
   sketches are within a Hamming radius. A large cell is worked from pivots: what is farther than twice the radius from a
   pivot can't be near the pivot's neighbours, so a tight group costs about its size.
2. Components of these links are clusters: every pair of a cell within the radius lies in one cluster.
3. `verified_components`: within a cluster all pairs are held against the exact similarity of their sets, so what the
   sketches missed inside of a cluster is found, too. Small clusters are one group each. Those of more than `_MEMBERS`
   members or `_SHINGLES` shingles go to blocks twice, by two hashes; then what is not connected to its cluster's largest
   component meets all members of the cluster, block by block. Links leave a block as a spanning forest.

So no key's rows meet in one task beyond a block, and rows written are in proportion to the items, but for a big cluster
whose members are nearly but not quite similar enough: its blocks meet pairwise, in arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, met, rows_that_stay, text_key, written
from quillmill.llm.components import components, forest
from quillmill.llm.tokens import text_slices

#: A block's members and their shingles.
_MEMBERS, _SHINGLES = 1024, 1 << 19
#: Cells up to the first size are compared pair by pair, up to the second one if they are no tight group, larger ones from
#: pivots; rows of a task that are worked on at once.
_SMALL, _WIDE, _ROWS = 32, 1024, 1 << 18
#: Shingles of up to so many members are counted pair by pair, others in bit sets.
_FEW = 8


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _large_cell(item: np.ndarray, sketch: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links that connect a cell as all its pairs within the radius would."""
    out = []
    while len(item) > 1:
        away = _far(sketch, sketch[:1])
        star, shell = np.flatnonzero(away <= radius), np.flatnonzero((away > radius) & (away <= 2 * radius))
        out.append(np.stack([item[star[1:]], np.full(len(star) - 1, item[0])], axis=1))
        step = max(1, (1 << 21) // (len(star) * sketch.shape[1]))
        for k in range(0, len(shell), step):
            block = shell[k : k + step]
            hit = _far(sketch[block][:, None, :], sketch[star][None, :, :]) <= radius
            met = hit.any(axis=1)
            out.append(np.stack([item[block[met]], item[star[hit[met].argmax(axis=1)]]], axis=1))
        item, sketch = item[away > radius], sketch[away > radius]
    return out


def cell_forest(cell: np.ndarray, item: np.ndarray, sketch: np.ndarray, radius: int) -> np.ndarray:
    """Spanning links of cells that lie one after another. sketch: a row of words for each item."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    out, held = [np.zeros((0, 2), np.int64)], 0
    tight = np.zeros(len(size), bool)
    for k in np.flatnonzero(size > _SMALL).tolist():
        at, n = begin[k], size[k]
        tight[k] = n > _WIDE or (_far(sketch[at : at + n], sketch[at : at + 1]) <= radius).sum() > n // 16
        if tight[k]:
            out += _large_cell(item[at : at + n], sketch[at : at + n], radius)
    keep = np.repeat((size > 1) & ~tight, size)
    cell, item, words = cell[keep], item[keep], [np.ascontiguousarray(w) for w in sketch[keep].T.view(np.uint64)]
    left, step = np.arange(len(cell)), 0
    while True:  # members of a cell that are `step` apart; those of a step are among those of the one before
        step += 1
        left = left[: np.searchsorted(left, len(cell) - step)]
        left = left[cell[left] == cell[left + step]]
        if not len(left):
            break
        near, far = left, np.zeros(len(left), np.uint16)
        for w in words:
            far = far + np.bitwise_count(w[near] ^ w[near + step])
            near, far = near[far <= radius], far[far <= radius]
        out.append(np.stack([item[near], item[near + step]], axis=1))
        held += len(near)
        if held > _ROWS:  # so that many near members don't make a link for each pair
            out, held = [forest(np.concatenate(out))], 0
    return forest(np.concatenate(out))


def cell_edges(rows: DataFrame, radius: int) -> DataFrame:
    """rows (cell, item, words of the sketch: longs) -> a, b: links as all pairs of a cell within the radius connect it."""

    def run(batches):
        held, n = [], 0
        for b in batches:  # sorted by cell; the last cell of what is held may go on in the next batch
            held.append(np.stack([c.to_numpy() for c in b.columns]))
            n += b.num_rows
            if n >= _ROWS:
                every = np.concatenate(held, axis=1)
                end = int(np.searchsorted(every[0], every[0, -1]))
                if end:
                    yield _pairs(cell_forest(every[0, :end], every[1, :end], np.ascontiguousarray(every[2:, :end].T), radius))
                held, n = [every[:, end:]], every.shape[1] - end
        if n:
            every = np.concatenate(held, axis=1)
            yield _pairs(cell_forest(every[0], every[1], np.ascontiguousarray(every[2:].T), radius))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def similar_pairs(sets: list[np.ndarray], per_cent: int) -> np.ndarray:
    """Places (n x 2) of the pairs of these sorted sets with 100 * intersection >= per_cent * union."""
    size = np.array([len(s) for s in sets], np.int64)
    enough = lambda i, j, both: 100 * both >= per_cent * (size[i] + size[j] - both)
    m = len(sets)
    if m == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True)
        return np.array([[0, 1]] if len(both) and enough(0, 1, len(both)) else np.zeros((0, 2)), np.int64).reshape(-1, 2)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(flat, kind="stable")  # so owners of a shingle ascend
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    df = np.diff(np.append(begin, len(flat)))
    both = np.zeros((m, m), np.int32)
    for d in range(2, _FEW + 1):
        held = owner[begin[df == d][:, None] + np.arange(d)]
        for x in range(d):
            for y in range(x + 1, d):
                np.add.at(both, (held[:, x], held[:, y]), 1)
    often = np.flatnonzero(df > _FEW)
    if len(often):
        bit = np.repeat(np.arange(len(often)), df[often])
        who = owner[np.repeat(begin[often] - np.cumsum(df[often]) + df[often], df[often]) + np.arange(df[often].sum())]
        bits = np.zeros((m, len(often) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (who, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        step = max(1, (1 << 21) // bits.size)
        for k in range(0, m, step):
            both[k : k + step] += np.bitwise_count(bits[k : k + step, None, :] & bits[None, :, :]).sum(axis=2, dtype=np.int32)
    i, j = np.nonzero(np.triu(both, 1))
    good = enough(i, j, both[i, j].astype(np.int64))
    return np.stack([i[good], j[good]], axis=1)


def _link_groups(per_cent: int):
    """Sorted rows (group, item, shingles) -> a, b: a forest of each group's similar pairs."""

    def work(items, sets):
        if len(items) < 2:
            return np.zeros((0, 2), np.int64)
        return forest(np.array(items, np.int64)[similar_pairs(sets, per_cent)])

    def run(batches):
        group, items, sets, out, n = None, [], [], [], 0
        for b in batches:
            for g, i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != group:
                    out.append(work(items, sets))
                    n += len(out[-1])
                    group, items, sets = g, [], []
                    if n >= 1 << 16:
                        yield _pairs(np.concatenate(out))
                        out, n = [], 0
                if i not in items[-1:]:  # the same item by both sides of a pair of blocks
                    items.append(i)
                    sets.append(s.values.to_numpy())
        out.append(work(items, sets))
        yield _pairs(np.concatenate(out))

    return run


def _linked(placed: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """placed (group: a struct, item), sets (item, shingles) -> links within groups."""
    rows = met(placed, sets, "item").select(F.xxhash64("group").alias("group"), "item", "shingles")
    return rows.repartition("group").sortWithinPartitions("group", "item").mapInArrow(_link_groups(per_cent), "a long, b long")


def shingle_sets(docs: DataFrame, items: DataFrame, make, digest) -> DataFrame:
    """The sets of these items (id, key: the first row that has it) -> item, shingles, made from the texts anew."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b)):
            for t in part.column(1):
                held = make(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([digest(held)], pa.int64()), pa.array([held.view(np.int64)], pa.list_(pa.int64()))], ["item", "shingles"])

    texts = doc_texts(rows_that_stay(docs, items, text_key(docs), False))
    return texts.mapInArrow(run, "item long, shingles array<long>").groupBy("item").agg(F.first("shingles").alias("shingles"))


def verified_components(edges: DataFrame, items: DataFrame, sets_of, per_cent: int) -> DataFrame:
    """edges (a, b), items (node, n: size of the set, ...), sets_of: rows of items -> their sets (item, shingles).
    Gives node, component of all but each component's smallest node, as pairs of a cluster with
    100 * intersection >= per_cent * union connect them."""
    roots = components(edges)
    cluster = roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("component", "cluster")
    members = written(met(items, cluster, "node"), "members")
    sets = written(sets_of(members), "shingle_sets")
    of_size = members.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("m") / _MEMBERS, F.col("shingles") / _SHINGLES)).cast("long")
    wide = written(of_size.select("cluster", "m", blocks.alias("blocks")), "cluster_sizes")
    placed = met(members.select("cluster", F.col("node").alias("item")), wide, "cluster")
    block = lambda seed: F.pmod(F.xxhash64("item", F.lit(seed)), "blocks")
    twice = F.when(F.col("blocks") > 1, F.array(block(1), F.col("blocks") + block(2))).otherwise(F.array(F.lit(0).cast("long")))
    found = written(_linked(placed.select(F.explode(twice).alias("block"), "cluster", "item").select(F.struct("cluster", "block").alias("group"), "item"), sets, per_cent), "links")
    joined = components(found)
    big = wide.where("blocks > 1")
    if big.isEmpty():
        return joined
    now = met(met(members, big, "cluster"), joined, "node", "left").select("cluster", "m", "blocks", F.col("node").alias("item"), F.coalesce("component", "node").alias("component"))
    now = written(now, "big_clusters")
    most = now.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max(F.struct("count", "component"))["component"].alias("main"))
    now = written(met(now, most, "cluster"), "big_clusters")
    apart = F.col("component") != F.col("main")
    left = now.where(apart).groupBy("cluster").agg(F.count("*").alias("left"))
    # the others of a cluster in few blocks, each of which meets each block of its members
    now = met(now, left, "cluster").withColumn("sides", F.ceil(F.col("blocks") * F.col("left") / F.col("m")).cast("long"))
    range_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    one_side = now.where(apart).select("cluster", "item", F.pmod(F.xxhash64("item", F.lit(3)), "sides").alias("side"), F.explode(range_to("blocks")).alias("block"))
    other = now.select("cluster", "item", block(4).alias("block"), F.explode(range_to("sides")).alias("side"))
    pairs = one_side.unionByName(other).select(F.struct("cluster", "side", "block").alias("group"), "item")
    more = written(_linked(pairs, sets, per_cent), "links")
    return components(found.unionByName(more))
