"""SimHash near-duplicates by a segment-popcount embedding.

Fingerprints (64 bits) are mapped to the bit counts of 32 segments of two bits. Manhattan distance between such vectors
is a lower bound of Hamming distance, so a pair within `radius` bits is within `radius` in the embedding. Its grid join:
the 32 counts form 8 groups of four; if the distances of the groups add up to at most 4, at least four groups have
distance 0, so the pair lies in one cell of the grid over some four of the groups. Each distinct fingerprint goes to its
cell in each of the 70 choices; within a cell pairs are held against the bound, then against the exact distance. Copies
share a fingerprint and go as one. A cell yields a spanning forest of its links, not all pairs; a large cell is worked
from pivots (see _large_cell), so that a big group of near copies costs about its size.

Defined results: a null text has no words, whose fingerprint is 0 and is linked like any other; fewer words than a
shingle make one shingle; a null doc_id sorts after every other one; rows of equal doc_id and text share their verdict
(keep_one keeps one of them); an empty table gives an empty result.

A cell holds four groups' counts, about 24 bits: of fingerprints without any relation the commonest cell gets 2^-16, and
within a cell a pivot meets only what is within twice the radius of it, so far members cost one comparison a pivot.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmill.llm.common import doc_texts, has_repeats, ordered_id, rows_that_stay, text_key, written
from quillmill.llm.components import components, first_of_each, forest
from quillmill.llm.tokens import text_slices

SEED = 42
GROUPS, SHARED = 8, 4
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bit k of a byte in byte k of a word: eight counters that are added at once.
_SPREAD = sum((np.arange(256, dtype=np.uint64) >> np.uint64(k) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of these 64-bit numbers have each bit."""
    lanes = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    lanes = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a counter of eight bits holds 255
    return lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """The hash of each run of `width` words, lower-cased; fewer words make one shingle, none make none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, last, strict=True)], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of these numbers."""
    if not len(hashes):
        return 0
    bits = (2 * bit_counts(hashes) > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, *more: Column) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long; `more` are passed on."""
    texts = doc_texts(docs, *more)
    schema = StructType([texts.schema["doc_id"], StructField("fp", LongType()), *texts.schema.fields[2:]])

    def run(batches):
        for part in (x for b in batches for x in text_slices(b)):
            found = np.array([fingerprint(t.as_py(), width) for t in part.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), *part.columns[2:]], schema.names)

    return texts.mapInArrow(run, schema)


def embed(fps: np.ndarray) -> np.ndarray:
    """The bit counts of 32 two-bit segments, two bits each."""
    x = fps.view(np.uint64)
    return x - (x >> np.uint64(1) & np.uint64(0x5555555555555555))


def _byte_distances() -> np.ndarray:
    """Manhattan distance of any two bytes of four counts."""
    fields = np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3
    return np.abs(fields[:, None, :] - fields[None, :, :]).sum(axis=2).astype(np.uint8)


_DISTANCE = _byte_distances()


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _DISTANCE[a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)].sum(axis=1)


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs of fingerprints are within radius: the lower bound first, the exact distance of what it leaves."""
    near = manhattan(embed(a), embed(b)) <= radius
    near[near] = np.bitwise_count((a[near] ^ b[near]).view(np.uint64)) <= radius
    return near


def cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) of each fingerprint in each choice of groups."""
    groups = np.ascontiguousarray(embed(fps)).view(np.uint8).reshape(-1, GROUPS).astype(np.int64)
    out = []
    for k, chosen in enumerate(combinations(range(GROUPS), SHARED)):
        cell = np.full(len(fps), k, np.int64)
        for g in chosen:
            cell = cell << 8 | groups[:, g]
        out.append(cell)
    return np.concatenate(out), np.tile(fps, len(out))


def _large_cell(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links that connect a cell as all its links would. A pivot is linked to all within radius; what is farther than
    2 radius from it cannot be linked to those, so only the shell between is held against them, in blocks."""
    out = []
    while len(fps) > 1:
        away = np.bitwise_count((fps ^ fps[0]).view(np.uint64))
        star, shell = fps[away <= radius], fps[(away > radius) & (away <= 2 * radius)]
        out.append(np.stack([star[1:], np.full(len(star) - 1, fps[0])], axis=1))
        for k in range(0, len(shell), max(1, (1 << 22) // len(star))):
            block = shell[k : k + max(1, (1 << 22) // len(star))]
            hit = np.bitwise_count((block[:, None] ^ star[None, :]).view(np.uint64)) <= radius
            met = hit.any(axis=1)
            out.append(np.stack([block[met], star[hit[met].argmax(axis=1)]], axis=1))
        fps = fps[away > radius]
    return out


def cell_links(cell: np.ndarray, fps: np.ndarray, radius: int, small: int = 32) -> np.ndarray:
    """Spanning links of cells that lie one after another."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.concatenate([begin, [len(cell)]]))
    out = [np.zeros((0, 2), np.int64)]
    for at, n in zip(begin[size > small].tolist(), size[size > small].tolist(), strict=True):
        out += _large_cell(fps[at : at + n], radius)
    keep = np.repeat((size > 1) & (size <= small), size)
    cell, fps = cell[keep], fps[keep]
    for step in range(1, small):
        left = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(left):
            break
        a, b = fps[left], fps[left + step]
        near = linked(a, b, radius)
        out.append(np.stack([a[near], b[near]], axis=1))
    return forest(np.concatenate(out))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps (fp: distinct) -> a, b: links that connect the fingerprints as all pairs within radius would."""
    if radius > GROUPS - SHARED:
        raise ValueError(f"the grid finds pairs within {GROUPS - SHARED} bits")

    def spread(batches):
        for b in batches:
            if b.num_rows:
                cell, fp = cells(b.column(0).to_numpy())
                for k in range(0, len(cell), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + (1 << 17)]), pa.array(fp[k : k + (1 << 17)])], ["cell", "fp"])

    def join(batches, least: int = 1 << 18):
        held, rows = [], 0
        for b in batches:  # sorted by cell; the last cell of what is held may go on in the next batch
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            rows += b.num_rows
            if rows >= least:
                every = np.concatenate(held, axis=1)
                end = int(np.searchsorted(every[0], every[0, -1]))
                if end:
                    yield _as_batch(cell_links(every[0, :end], every[1, :end], radius))
                held, rows = [every[:, end:]], every.shape[1] - end
        if rows:
            every = np.concatenate(held, axis=1)
            yield _as_batch(cell_links(every[0], every[1], radius))

    spread_out = fps.select("fp").mapInArrow(spread, "cell long, fp long")
    return spread_out.repartition("cell").sortWithinPartitions("cell").mapInArrow(join, "a long, b long")


def _as_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _firsts(rows: DataFrame, radius: int, *more: str) -> DataFrame:
    """rows (doc_id, fp, ...) -> node (fp), first (none, id, ...): the least row of what the fingerprint is linked to."""
    distinct = written(rows.groupBy(F.col("fp").alias("node")).agg(F.min(ordered_id(*more)).alias("least")), "distinct")
    return first_of_each(distinct, components(links(distinct.select(F.col("node").alias("fp")), radius)))


def near_dedup(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = written(fingerprints(docs, width), "fingerprints")
    members = _firsts(rows, radius).select(F.col("node").alias("fp"), F.col("first.id").alias("component_id"))
    return rows.join(members, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component by doc_id and text."""
    rows = written(fingerprints(docs, width, text_key(docs).alias("key")), "fingerprints")
    stay = written(_firsts(rows, radius, "key").select("first.*").distinct(), "stay")
    return rows_that_stay(docs, stay, text_key(docs), has_repeats(rows))
