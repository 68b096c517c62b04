"""Best-fit packing of token sequences, certified by lower bounds.

Documents are cut into pieces of at most `capacity` tokens (only longer ones, the first piece may be shorter). Pieces
are dealt by the hash of a row number (`uid`; equal or missing doc_ids are spread as others are) into partitions of about
`per_part` and packed best-fit decreasing in each. Dual feasible functions
over a partition's lengths give a number of sequences below which no packing can go; a partition that meets it is
certified and stays. The others exchange their pieces (they are dealt anew among themselves) and are packed again; a
round's result is taken if it needs fewer sequences than those partitions had.

Defined results: a null text is empty (the end id alone); repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, written
from quillmill.llm.tokens import encoder, text_slices

_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the remainder first, then full ones."""
    full, rest = divmod(total, capacity)
    return [rest] * (rest > 0) + [capacity] * full


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """uid, doc_id, piece, start, length, ids_crc32 of every piece; uid (task and place) holds once the rows are written."""

    def run(batches):
        coder, uid = encoder(tokenizer_path), TaskContext.get().partitionId() << 40
        for part in (x for b in batches for x in text_slices(b)):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode_each(part.column(1)), strict=True):
                ids, start = np.append(ids, end_id).astype("<u4"), 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    rows.append((uid, doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start, uid = start + n, uid + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_texts(docs).mapInArrow(run, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, and the number of bins. Bins are kept by the room they have; a bit mask over the
    rooms gives the tightest one that fits at once."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: dict[int, list[int]] = defaultdict(list)
    mask, opened = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            held = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            room, held, opened = capacity, opened, opened + 1
        bins[k], offsets[k] = held, capacity - room
        if room > n:
            by_room[room - n].append(held)
            mask |= 1 << (room - n)
    return bins, offsets, opened


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of three families of dual feasible functions: no packing of these lengths has fewer bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(float)
    x = np.arange(capacity + 1)
    best = count @ x / capacity
    for k in range(1, 33):  # x if (k+1)x/C is whole, else floor((k+1)x/C)C/k
        scaled = (k + 1) * x
        best = max(best, count @ np.where(scaled % capacity == 0, x / capacity, scaled // capacity / k))
    # lengths over C - e count as whole bins, those under e as nothing
    volume, number = np.cumsum(count * x), np.cumsum(count)
    for e in range(1, capacity // 2 + 1):
        middle = volume[capacity - e] - volume[e - 1]
        best = max(best, number[-1] - number[capacity - e] + middle / capacity)
    half = 2 * x > capacity
    for e in np.unique(capacity // np.arange(2, 65)):  # large: 1 - floor((C-x)/e)/floor(C/e); from e to half: 1/floor(C/e)
        if e:
            whole = capacity // e
            best = max(best, count @ np.where(half, 1 - (capacity - x) // e / whole, np.where(x >= e, 1 / whole, 0)))
    return math.ceil(best - 1e-6)


_PACKED = f"{_PIECES}, part long, bin long, offset long, n_bins long, bound long"


def _pack_parts(items: DataFrame, capacity: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        if n > 1 << 20:
            raise ValueError("a partition has more sequences than sequence_id has room for: lower per_part")
        for name, values in (("bin", bins), ("offset", offsets), ("n_bins", np.full(len(lengths), n)), ("bound", np.full(len(lengths), lower_bound(lengths, capacity)))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return items.groupBy("part").applyInArrow(run, _PACKED)


def _dealt(items: DataFrame, parts: int, seed: int) -> DataFrame:
    return items.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)) + F.lit(seed << 40))


def pack(pieces: DataFrame, capacity: int, per_part: int = 50_000, rounds: int = 3) -> DataFrame:
    """pieces (uid, doc_id, piece, start, length, ids_crc32) with sequence_id, offset, and certified: whether the piece's
    partition met its bound. A partition has about per_part pieces whatever the input's size."""
    parts = lambda size: max(1, math.ceil(size / per_part))
    now = written(_pack_parts(_dealt(pieces, parts(pieces.count()), 0), capacity), "packed-0")
    done: list[DataFrame] = []
    for turn in range(1, rounds + 1):
        held = now.groupBy("part").agg(F.count("*").alias("size"), F.max("n_bins").alias("bins"), F.max("bound").alias("bound"))
        gap = F.when(F.col("bins") > F.col("bound"), 1)
        sums = held.agg(F.count("*").alias("parts"), F.count(gap).alias("gaps"), F.sum("size").alias("size"), F.sum("bins").alias("bins"), F.sum(gap * F.col("size")).alias("gap_size"), F.sum(gap * F.col("bins")).alias("gap_bins")).first()
        if not sums.gaps or sums.parts < 2:
            break  # all certified, or nothing to exchange with
        among = sums.gaps >= 2  # a lone partition with a gap exchanges with all
        pool = now.where("n_bins > bound") if among else now
        dealt = _dealt(pool.select(*pieces.columns), parts(sums.gap_size if among else sums.size), turn)
        again = written(_pack_parts(dealt, capacity), f"packed-{turn}")
        if again.select("part", "n_bins").distinct().agg(F.sum("n_bins")).first()[0] < (sums.gap_bins if among else sums.bins):
            if among:
                done.append(now.where("n_bins <= bound"))
            now = again
    for part in done:
        now = now.unionByName(part)
    sequence = (F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id")
    return now.select(*pieces.drop("uid").columns, sequence, "offset", (F.col("n_bins") <= F.col("bound")).alias("certified"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, per_part: int = 50_000) -> DataFrame:
    pieces = written(cut_documents(docs, tokenizer_path, end_id, capacity), "pieces")
    return pack(pieces, capacity, per_part)
