"""SimHash near-dedup at a shingle similarity: texts whose sets of word shingles have a Jaccard similarity of `threshold`
per cent or more.

At a similarity of 0.8 a SimHash bit differs with probability 0.15, so such pairs lie far beyond the radius for which the
grid of simhash.py is exact. The embedding stays the same (bit counts of two-bit segments, Manhattan distance as a lower
bound of Hamming distance), with wider fingerprints and a grid of its own: 1,024 bits make 512 segments, each of TABLES tables
takes eight of these, and texts with the same counts in a table's segments share a cell. A segment of a pair at 0.8 keeps
its count with probability 0.73, so the pair meets in some cell but for one or two of a thousand; far texts share a cell of a
table by chance once in 2,500 times. Within a cell pairs are held against the Hamming radius of the first 192 bits (29 on average at 0.8, 96 between
texts without any relation). Sets of a few shingles have rough fingerprints; they meet by a prefix filter as well:
shingles in the order of their hashes, a pair at the threshold shares one of each other's first n - ceil(0.8 n) + 1, so they
are found without exception.

What meets makes clusters, and all pairs of a cluster are held against their exact similarity, by 64-bit hashes of their
shingles (see linking.py); so within a group of related texts it doesn't matter whether each pair shares a cell.

Texts of equal shingle sets go as one.

Defined results: a null text has no words and an empty set, and all such are copies; fewer words than a shingle make one
shingle; a null doc_id sorts after every other one; rows of equal doc_id and text share their verdict (keep_one keeps one
of them); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import linking
from quillmill.llm.common import doc_texts, has_repeats, met, ordered_id, rows_that_stay, text_key, written
from quillmill.llm.components import first_of_each
from quillmill.llm.minhash import digest, shingle_set
from quillmill.llm.simhash import SEED, embed
from quillmill.llm.tokens import text_slices

#: Words of 64 bits in a fingerprint, and those of them that travel with the cells.
WORDS, CARRIED = 16, 3
TABLES, SEGMENTS = 120, 8
#: Bits by which the carried words of alike texts may differ: 29 on average at 0.8, with a deviation of 5.
RADIUS = 52
#: A pair whose smaller set has up to so many shingles meets by a prefix filter, too.
FEW = 32
_CHOSEN = np.stack([np.random.default_rng(SEED + t).choice(32 * WORDS, SEGMENTS, replace=False) for t in range(TABLES)])
_POWERS = 3 ** np.arange(SEGMENTS)
_MIXES = np.random.default_rng(SEED).integers(1 << 62, dtype=np.uint64, size=WORDS) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(held: np.ndarray) -> list[int]:
    """WORDS fingerprints of a set, by hashes derived from its shingles' hashes: each bit that is set in over half of them."""
    if not len(held):
        return [0] * WORDS
    x = (held ^ (held >> np.uint64(31)))[:, None] * _MIXES
    x ^= x >> np.uint64(32)
    return over_half(x).tolist()


def over_half(hashes: np.ndarray) -> np.ndarray:
    """Of n rows of words, the words of each bit that is set in over half of the rows. Rows are counted bit by bit with
    carry-save adders: three of one weight make a row of that weight and one of twice the weight."""
    least, short = len(hashes) // 2 + 1, np.zeros(hashes.shape[1], np.uint64)
    rows, k = hashes, 0
    while len(rows):
        carried = []
        while len(rows) > 1:
            m = len(rows) // 3
            if m:
                a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
                odd = a ^ b
                carried.append((a & b) | (odd & c))
                rows = np.concatenate([odd ^ c, rows[3 * m :]])
            else:
                carried.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
        # bit k of each count, from which bit k of the least count is taken with what has been borrowed
        wanted = np.uint64(2**64 - 1 if least >> k & 1 else 0)
        short = (~rows[0] & (wanted | short)) | (wanted & short)
        rows, k = np.concatenate(carried) if carried else rows[:0], k + 1
    return ~short


def prefix(held: np.ndarray, per_cent: int) -> np.ndarray:
    """Of a small set those first shingles of which it shares one with any set that is similar enough."""
    n = len(held)
    return held[: n - -(-per_cent * n // 100) + 1] if 0 < n * per_cent <= 100 * FEW else held[:0]


def sketches(docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """doc_id, key, item (digest of the shingle set), n (its size), fp (its fingerprint's words), first (its prefix)."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b)):
            held = [shingle_set(t.as_py(), width) for t in part.column(1)]
            fps = pa.FixedSizeListArray.from_arrays(pa.array(np.array([w for h in held for w in wide_fingerprint(h)], np.uint64).view(np.int64)), WORDS).cast(pa.list_(pa.int64()))
            first = pa.array([prefix(h, per_cent).view(np.int64) for h in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([digest(h) for h in held], pa.int64()), pa.array([len(h) for h in held], pa.int64()), fps, first], ["doc_id", "key", "item", "n", "fp", "first"])

    return doc_texts(docs, text_key(docs).alias("key")).mapInArrow(run, "doc_id long, key binary, item long, n long, fp array<long>, first array<long>")


def cells(fps: np.ndarray) -> np.ndarray:
    """The cell of each fingerprint (n x WORDS) in each table (n x TABLES)."""
    held = np.ascontiguousarray(embed(fps.reshape(-1))).view(np.uint8).reshape(-1, 8 * WORDS)
    counts = (held[:, :, None] >> np.arange(0, 8, 2, dtype=np.uint8) & 3).reshape(len(held), -1).astype(np.int64)
    return np.stack([counts[:, chosen] @ _POWERS + t * 3**SEGMENTS for t, chosen in enumerate(_CHOSEN)], axis=1)


def _spread(batches):
    for b in batches:
        item, fps = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, WORDS)
        for k in range(0, len(item), 1024):
            found = cells(fps[k : k + 1024])
            carried = np.repeat(fps[k : k + 1024, :CARRIED], TABLES, axis=0)
            columns = [found.reshape(-1), np.repeat(item[k : k + 1024], TABLES), *carried.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["cell", "item", *(f"f{j}" for j in range(CARRIED))])


def candidates(items: DataFrame) -> DataFrame:
    """items (node, n, fp, first) -> a, b: links whose components hold every pair that shares a cell within the radius,
    and every pair of small sets that share a shingle of their prefixes."""
    kind = ", ".join(["cell long", "item long", *(f"f{j} long" for j in range(CARRIED))])
    near = linking.cell_edges(items.where("n > 0").select("node", "fp").mapInArrow(_spread, kind), RADIUS)
    small = written(items.select(F.col("node").alias("a"), F.explode("first").alias("shingle")), "prefixes")
    least = small.groupBy("shingle").agg(F.min("a").alias("b"), F.count("*").alias("sets")).where("sets > 1")
    return near.unionByName(met(small, least, "shingle").where("a <> b").select("a", "b"))


def _firsts(docs: DataFrame, rows: DataFrame, width: int, per_cent: int) -> DataFrame:
    """rows (of sketches) -> node (item), first (none, id, key): the least row of the item's component."""
    items = written(rows.groupBy(F.col("item").alias("node")).agg(F.min(ordered_id("key")).alias("least"), *[F.first(c).alias(c) for c in ("n", "fp", "first")]), "items")
    plain = items.select("node", "least", "n")
    sets_of = lambda members: linking.shingle_sets(docs, members.select("least.id", "least.key"), lambda t: shingle_set(t, width), digest)
    return first_of_each(plain, linking.verified_components(written(candidates(items), "edges"), plain, sets_of, per_cent))


def near_dedup(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, component_id (smallest doc_id reachable)."""
    rows = written(sketches(docs, width, per_cent), "sketches")
    members = _firsts(docs, rows, width, per_cent).select(F.col("node").alias("item"), F.col("first.id").alias("component_id"))
    return met(rows.select("doc_id", "item"), members, "item").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component by doc_id and text."""
    rows = written(sketches(docs, width, per_cent), "sketches")
    stay = written(_firsts(docs, rows, width, per_cent).select("first.*").distinct(), "stay")
    return rows_that_stay(docs, stay, text_key(docs), has_repeats(rows))
