"""Vector retrieval: exact cosine top-k with filters, similar items, and diversity selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """key, score of the k nearest; filters put on `vectors` before are pushed to its scan. Each task keeps k rows."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(column), literal), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Of length 1; a vector without length stays 0."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of each query's k nearest of these vectors, by score then id."""
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    scores = np.round(np.divide(q @ v.T, norms, out=np.zeros(norms.shape), where=norms > 0), 6)
    if skip_self:
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if k < len(ids):  # all that tie with the k-th stay in, then ids decide
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    else:
        least = np.full((len(q), 1), -2.0)
    row, at = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    first = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - first[row] < k
    return query_ids[row[keep]], ids[at[keep]], scores[row[keep], at[keep]]


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, block: int = 32_768) -> DataFrame:
    """queries (query_id, embedding) x vectors (vec_id, embedding) -> query_id, vec_id, score, rank.

    A stated query set against all rows, exactly: queries come in blocks of about `block` vectors, each of which travels to the
    tasks of one scan over the vectors, so no vector is shuffled and nothing is joined. A task meets its batches as matrix
    products and passes on its own k best for a query. For many queries see `vector_index`."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    n_blocks = max(1, -(-asked.count() // block))
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    found = [held.mapInArrow(_nearest(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).toArrow(), k, skip_self), "query_id long, vec_id long, score double") for b in range(n_blocks)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(asked: pa.Table, k: int, skip_self: bool, rows: int = 1024):
    """The function of a scan: each query's k best of a task's vectors."""
    q_ids = asked.column(0).to_numpy()
    q = np.array(asked.column(1).to_pylist(), float).reshape(len(q_ids), -1 if len(q_ids) else 0)

    def run(batches):
        best = None
        for b in batches:
            for at in range(0, b.num_rows if len(q_ids) else 0, rows):
                part = b.slice(at, rows)
                v = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, -1)
                for j in range(0, len(q_ids), rows):
                    now = best_of(q_ids[j : j + rows], q[j : j + rows], part.column(0).to_numpy(), v, k, skip_self)
                    best = now if best is None else tuple(np.concatenate(x) for x in zip(best, now, strict=True))
                if best is not None and len(best[0]) > 4 * k * len(q_ids):
                    best = best_rows(best, k)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best_rows(best, k)], ["query_id", "vec_id", "score"])

    return run


def best_rows(best: tuple, k: int) -> tuple:
    """Each query's k best of rows (query, id, score), by score then id."""
    query_id, vec_id, score = best
    order = np.lexsort((vec_id, -score, query_id))
    query_id = query_id[order]
    keep = np.arange(len(order)) - np.searchsorted(query_id, query_id) < k
    return query_id[keep], vec_id[order][keep], score[order][keep]


def mmr(results: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """results (query_id, doc_id, score, words) -> query_id, doc_id, mmr_rank: greedy choice of the item with the
    greatest weight * score + (1 - weight) * (1 - greatest Jaccard similarity with those chosen); ties go to the better
    ranked. Candidate lists are bounded (min(3k, 150) of a query), so a query's choice is one small group."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True])
        sets = [set(w) for w in pdf["words"]]
        scores, ids = pdf["score"].tolist(), pdf["doc_id"].tolist()
        alike = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
        left, chosen = list(range(len(ids))), []
        closest = [0.0] * len(ids)
        while left and len(chosen) < k:
            value = [round(weight * scores[i] + (1 - weight) * (1 - closest[i]) if chosen else scores[i], 9) for i in left]
            pick = left.pop(value.index(max(value)))
            chosen.append(pick)
            for i in left:
                closest[i] = max(closest[i], alike(sets[i], sets[pick]))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": [ids[i] for i in chosen], "mmr_rank": range(1, len(chosen) + 1)})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    cut = results.withColumn("n", F.row_number().over(order)).where(F.col("n") <= min(3 * k, 150)).drop("n")
    return cut.groupBy("query_id").applyInPandas(choose, "query_id long, doc_id long, mmr_rank int")
