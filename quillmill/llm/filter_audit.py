"""How filters interact: for every order of applying them, what each step keeps, removes and loses.

A document's failures are a mask of one bit a filter, so all that any order does follows from the counts of the masks
(`cells`: at most 2^k rows a part). The orders of a part are visited by single swaps of neighbours (plain changes): a swap
of places i and i + 1 changes these two steps alone, as the set of filters before and after them stays; their counts are
taken from the cells anew, all other steps' stay. Shapley sums accumulate along the walk.

Filters of this audit: A fewer than 100 words; B distinct words under 80 percent; C capitals over 10 percent of the code
points; D a character of #$%&*|; E a text that a smaller doc_id has, table-wide.

Defined results: a null text is empty (and fails A; equal empty texts fail E); a null lang is the part of the empty string;
a null doc_id comes after every other one and has no labels; rows of equal doc_id and text are equals, so E spares both if
no smaller doc_id has their text; repeated documents count each; repeated labels count once, a null label is none; without
documents there are no rows; other columns are unread. Texts are equal where their 128-bit BLAKE2 digests and lengths are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import ordered_id, written
from quillmill.llm.tokens import text_slices

LETTERS = "ABCDE"
#: The bit of E, the one filter that looks at other documents.
_REPEATED = 16
_CAPITALS, _SYMBOLS = bytes(range(0x41, 0x5B)), [bytes([c]) for c in b"#$%&*|"]


def own_failures(text: str) -> int:
    """The mask of A to D."""
    raw = text.encode()
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), any(s in raw for s in _SYMBOLS))
    return sum(bit << k for k, bit in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b)):
            texts = [t.as_py() for t in part.column(1)]
            keys = [hashlib.blake2b(f"{len(t)} {t}".encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(map(own_failures, texts), pa.int32())], ["doc_id", "part", "key", "own"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
    rows = written(whole.mapInArrow(run, "doc_id long, part string, key binary, own int"), "failures")
    # a text of very many rows is one group whose least row is found before the shuffle; rows meet it by id and text, a key
    # that no group of copies makes heavy
    first = rows.groupBy(F.col("key").alias("f_key")).agg(F.min(ordered_id()).alias("first")).select("f_key", F.col("first.id").alias("f_id"), F.lit(0).alias("spared"))
    both = rows.join(first, (rows["key"] == first["f_key"]) & rows["doc_id"].eqNullSafe(first["f_id"]), "left")
    return both.select("doc_id", "part", F.col("own").bitwiseOR(F.coalesce("spared", F.lit(_REPEATED))).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good (label quality 1), toxic."""
    is_one = lambda c: F.coalesce(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))), F.lit(0)).alias(c)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return masks.join(marked, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def plain_changes(k: int) -> Iterator[int]:
    """The places i whose swaps with i + 1, one after another, visit all orders of k things: the last thing walks through
    each order of the others, one way and then the other."""
    if k < 2:
        return
    down = True
    for at in [*plain_changes(k - 1), None]:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        if at is not None:
            yield at + down  # while the last thing stands first, the others stand one place on
        down = not down


def walk(masks: np.ndarray, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """masks, counts (n, good, toxic of each mask) -> (order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of every step of every order."""
    k = len(letters)
    fails = [int(counts[(masks >> f & 1) == 1, 0].sum()) for f in range(k)]
    alone = [int(counts[masks == 1 << f, 0].sum()) for f in range(k)]

    def step(before: int, f: int) -> tuple[int, int, int, int]:
        """kept, removed, good and toxic removed by f after the filters of the mask `before`."""
        left = (masks & before) == 0
        gone = counts[left & ((masks >> f & 1) == 1)].sum(axis=0)
        return int(counts[left, 0].sum() - gone[0]), *gone.tolist()

    order, steps, before, shapley, visited = list(range(k)), [], 0, [0] * k, []
    for f in order:
        steps.append(step(before, f))
        before |= 1 << f
    for at in [*plain_changes(k), None]:
        visited.append((tuple(order), tuple(steps)))
        for f, (_, removed, *_) in zip(order, steps, strict=True):
            shapley[f] += removed
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            before = sum(1 << f for f in order[:at])
            steps[at] = step(before, order[at])
            steps[at + 1] = step(before | 1 << order[at], order[at + 1])
    for held, taken in visited:
        name = "".join(letters[f] for f in held)
        for place, (f, (kept, removed, good, toxic)) in enumerate(zip(held, taken, strict=True), 1):
            yield name, place, kept, removed, fails[f] - removed, alone[f], good, toxic, shapley[f]


_KIND = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def orders(found: DataFrame, letters: str = LETTERS) -> DataFrame:
    """cells of k filters (bit f of a mask: letters[f]) -> a row for each part, order and step."""
    names = [c.split()[0] for c in _KIND.split(", ")]

    def run(batches):
        for b in batches:
            for part, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                masks = np.array([c["mask"] for c in held], np.int64)
                counts = np.array([[c["n"], c["good"], c["toxic"]] for c in held], np.int64)
                rows = [(part, *r) for r in walk(masks, counts, letters)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names)

    # at most 2^k cells a part
    return found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held")).mapInArrow(run, _KIND)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each lang, order of the five filters, and step."""
    return orders(cells(failures(docs), labels))
