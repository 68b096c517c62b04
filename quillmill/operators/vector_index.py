"""An approximate vector index: coarse cells, probes of the nearest ones, exact scores within them.

`fit` finds cell centres by k-means over unit vectors of a bounded sample (`sample` rows of least id hash), and how many
cells a query must probe: the fewest for which queries from the sample find `recall` of their true neighbours among the
sample. `build` puts every row into its nearest cell, in a table sorted by cell, so that a probe reads row groups of its
cell only. `search` sends each query to its probes, meets each cell's rows in blocks, as matrix products, and keeps each
block's best k; a big cell (a third of all vectors may be one vector) is many blocks. Scores are exact cosines, rounded to
six digits as in `vector.top_k_batch`; only rows outside of the probed cells can be missed.

Vectors that are null or of another length than the centres are no rows of the index; a vector without length scores 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators.vector import best_of, unit

#: Rows of a block.
BLOCK = 8192


@dataclass
class Cells:
    centres: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        near = unit(vectors) @ self.centres.T
        if n >= near.shape[1]:
            return np.argsort(-near, axis=1, kind="stable")
        some = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)


def _k_means(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of unit vectors by cosine; a cell that loses all members begins anew at a member of the largest one."""
    draw = np.random.default_rng(42)
    centres = vectors[draw.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        cell = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, vectors)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        if len(empty):
            largest = np.flatnonzero(cell == np.bincount(cell, minlength=k).argmax())
            sums[empty] = vectors[draw.choice(largest, len(empty))]
        centres = unit(sums)
    return centres


def fit(vectors: DataFrame, k: int = 10, recall: float = 0.95, sample: int = 20_000, cells: int | None = None, key: str = "vec_id", column: str = "embedding") -> Cells | None:
    """At most `sample` rows come to the driver. cells: about the square root of the sample if not given."""
    rows = vectors.where(F.col(column).isNotNull() & (F.size(column) > 0)).select(F.col(column).alias("v"), F.xxhash64(key).alias("h"))
    held = rows.orderBy("h").limit(sample).select("v").toArrow().column(0).to_pylist()
    if not held:
        return None
    width = max(set(map(len, held)), key=lambda n: (sum(len(v) == n for v in held), n)) if len({*map(len, held)}) > 1 else len(held[0])
    points = unit(np.array([[x or 0.0 for x in v] for v in held if len(v) == width], float))
    n = min(len(points), cells or max(1, int(len(points) ** 0.5)))
    found = Cells(_k_means(points, n), n)
    found.probes = _probes(points, found, k, recall)
    return found


def _probes(points: np.ndarray, cells: Cells, k: int, recall: float, queries: int = 256) -> int:
    """The fewest probes with which sampled queries find this share of their k nearest in the sample."""
    asked = points[np.random.default_rng(7).choice(len(points), min(queries, len(points)), replace=False)]
    k = min(k, len(points))
    true = np.argpartition(-(asked @ points.T), k - 1, axis=1)[:, :k]
    of = cells.nearest(points)[:, 0]
    order = cells.nearest(asked, len(cells.centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, of[true], axis=1).reshape(-1)) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _vectors(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have this length, and their values; null entries are 0."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = pc.fill_null(pc.cast(column.filter(fits).flatten(), pa.float64()), 0.0)
    return np.flatnonzero(fits.to_numpy(zero_copy_only=False)), values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _celled(rows: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """rows (id, v) -> id, v, cell: a row for each of the nearest `probes` cells."""
    width = cells.centres.shape[1]

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                part = b.slice(k, 4096)
                at, values = _vectors(part.column(1), width)
                near = cells.nearest(values, probes)
                row = pa.array(np.repeat(at, near.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(near.reshape(-1).astype(np.int32))], ["id", "v", "cell"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>, cell int")


def build(vectors: DataFrame, cells: Cells, path: str, key: str = "vec_id", column: str = "embedding") -> None:
    """Every row with its cell, in files sorted by cell; a cell's rows go to files by id, so a big cell is no single task."""
    rows = _celled(vectors.select(F.col(key).alias("id"), F.col(column).alias("v")), cells, 1)
    rows.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(path)


def search(spark: SparkSession, path: str, cells: Cells, queries: DataFrame, k: int = 10, skip_self: bool = False, probes: int | None = None) -> DataFrame:
    """queries (query_id, embedding) -> query_id, vec_id, score, rank."""
    width = cells.centres.shape[1]
    index = spark.read.schema("id long, v array<double>, cell int").parquet(path)
    sizes = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each cell
    held = index.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(1).alias("side"), "id", "v")
    asked = _celled(queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v")), cells, probes or cells.probes)
    asked = asked.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "id", "v")
    met = asked.unionByName(held).repartition("cell", "block").sortWithinPartitions("cell", "block", "side")

    def run(batches):
        group, q_ids, q = None, [], []
        for b in batches:
            place = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            side = b.column(2).to_numpy()
            begin = 0
            for end in range(1, len(place) + 1):
                if end < len(place) and place[end] == place[begin] and side[end] == side[begin]:
                    continue
                if place[begin] != group:
                    group, q_ids, q = place[begin], [], []
                part = b.slice(begin, end - begin)
                values = part.column(4).flatten().to_numpy().reshape(-1, width)
                if side[begin] == 0:
                    q_ids.append(part.column(3).to_numpy())
                    q.append(values)
                elif q:
                    yield from _best(np.concatenate(q_ids), np.concatenate(q), part.column(3).to_numpy(), values, k, skip_self)
                begin = end

    best = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, skip_self: bool, step: int = 1024):
    for j in range(0, len(q_ids), step):
        asked, vec_id, score = best_of(q_ids[j : j + step], q[j : j + step], ids, v, k, skip_self)
        yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(vec_id), pa.array(score)], ["query_id", "vec_id", "score"])
