"""MinHash near-duplicates by circulant permutations.

A text's shingles are thrown into 2^20 bins by one permutation (a seeded hash); a second permutation of the bins, shifted by
k places, gives coordinate k of the signature: the least rank among the shingles' bins, shifted by k. So two permutations
give all COORDINATES coordinates, and those of a shingle lie side by side in one table. Bands of four coordinates make cells: a pair of
similarity 0.8 shares one of 32 bands but for a probability of 5e-8. The lowest bits of the coordinates are a sketch of 128
bits, of which a pair at 0.8 differs in 13 on average: pairs of a cell within RADIUS = 32 bits (more than that in one pair of
ten million) make clusters, and all pairs of a cluster are held against their exact similarity (see linking.py).

Texts of equal sets go as one; links of different texts are kept whole. Shingles are told apart by 64-bit hashes.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is its own component;
fewer words than a shingle make one shingle; a null doc_id comes after every other one, so a component of such rows alone has
a null component_id, whose rows are all kept; repeated rows are given each; an empty table gives an empty result; other
columns are unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import linking
from quillmill.llm.common import doc_texts, ordered_id, text_key, worker_cache, written
from quillmill.llm.components import first_of_each
from quillmill.llm.simhash import SEED, shingle_hashes
from quillmill.llm.tokens import text_slices

COORDINATES, BAND = 128, 4
RADIUS = 32
_BINS = 1 << 20
_SPREADER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, width))


def digest(held: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(held.tobytes(), SEED), np.uint64).view(np.int64))


def _ranks() -> np.ndarray:
    """Row i: the second permutation's ranks of bins i to i + COORDINATES - 1, in a circle."""
    ranks = np.random.default_rng(SEED).permutation(_BINS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: COORDINATES - 1]]), COORDINATES)


def signature(held: np.ndarray, ranks: np.ndarray, step: int = 4096) -> np.ndarray:
    """All coordinates of a set that isn't empty."""
    bins = (held * _SPREADER >> np.uint64(44)).astype(np.int64)
    least = np.full(COORDINATES, _BINS, np.uint32)
    for k in range(0, len(bins), step):
        np.minimum(least, ranks[bins[k : k + step]].min(axis=0), out=least)
    return least


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, item (digest of the set), n (its size), signature."""

    def run(batches):
        ranks = worker_cache("circulant", _ranks)
        for part in (x for b in batches for x in text_slices(b)):
            sets = [shingle_set(t.as_py(), width) for t in part.column(1)]
            signs = np.concatenate([signature(s, ranks) if len(s) else np.zeros(COORDINATES, np.uint32) for s in sets])
            signs = pa.ListArray.from_arrays(pa.array(np.arange(0, len(signs) + 1, COORDINATES, dtype=np.int32)), pa.array(signs.view(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), signs], ["doc_id", "key", "item", "n", "signature"])

    return doc_texts(docs, text_key(docs).alias("key")).mapInArrow(run, "doc_id long, key binary, item long, n long, signature array<int>")


def band_rows(signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x COORDINATES) -> cells (n x bands) and sketches (n x 2 words)."""
    bands = signs.reshape(len(signs), -1, BAND).astype(np.uint64)
    cell = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    for c in range(BAND):
        cell = (cell ^ bands[:, :, c]) * _SPREADER
        cell ^= cell >> np.uint64(29)
    return cell.view(np.int64), np.packbits((signs & 1).astype(np.uint8), axis=1).view(np.int64)


def _spread(batches):
    for b in batches:
        item = b.column(0).to_numpy()
        signs = b.column(1).flatten().to_numpy().reshape(len(item), COORDINATES)
        for k in range(0, len(item), 2048):
            cell, sketch = band_rows(signs[k : k + 2048])
            n = cell.shape[1]
            columns = [cell.reshape(-1), np.repeat(item[k : k + 2048], n), *np.repeat(sketch, n, axis=0).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["cell", "item", "s0", "s1"])


def near_dedup(docs: DataFrame, width: int = 2, per_cent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    rows = written(_sketches(docs, width), "signatures")
    items = written(rows.where("n > 0").groupBy(F.col("item").alias("node")).agg(F.min(ordered_id("key")).alias("least"), F.first("n").alias("n"), F.first("signature").alias("signature")), "items")
    spread = items.select("node", "signature").mapInArrow(_spread, "cell long, item long, s0 long, s1 long")
    edges = written(linking.cell_edges(spread, RADIUS), "edges")
    plain = items.drop("signature")
    sets_of = lambda members: linking.shingle_sets(docs, members.select("least.id", "least.key"), lambda t: shingle_set(t, width), digest)
    roots = linking.verified_components(edges, plain, sets_of, per_cent)
    first = first_of_each(plain, roots).select(F.col("node").alias("item"), F.col("first.id").alias("first"))
    joined = rows.select("doc_id", "n", "item").join(first, "item", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
