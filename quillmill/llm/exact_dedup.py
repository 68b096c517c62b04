"""Exact deduplication by a cuckoo-filter index of live digests.

Texts are normalised and digested in the JVM. Every task keeps an index of the digests it has met: a filter of short
tags in buckets of four, beside it the bucketed content (digest, byte length). A tag that matches is only a hint; a hit
counts once the content in that bucket is equal. The index is used twice: on the map side, so that a group of copies
leaves a task as one row however large it is, and after the shuffle by digest, where those rows meet in the digests'
order: an index that has grown past its bound is passed on and begun anew at the next digest.

Defined results: a null text is the empty text; rows of equal doc_id and text count as rows and share their verdict
(keep_first keeps one of them); a null doc_id sorts after every other one; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, rows_that_stay, written

#: White space that the normal form holds as one space.
BLANKS = "[\\x20\\x09-\\x0D]+"
_SLOTS = 4


class CuckooIndex:
    """Live digests with a payload each. Two candidate buckets of four slots for a digest; a slot holds a 16-bit tag,
    its content (digest, length) and the payload. An insertion that finds no room after `kicks` moves doubles the
    table and puts every stored key in anew, so nothing is ever lost and no digest is held twice."""

    def __init__(self, buckets: int = 1024, kicks: int = 64):
        self.kicks, self.live, self.resized = kicks, 0, 0
        self._make(buckets)

    def _make(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags: list[list[int]] = [[] for _ in range(buckets)]
        self.content: list[list[tuple]] = [[] for _ in range(buckets)]
        self.payload: list[list] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _find(self, digest: bytes, length: int) -> tuple[int, int] | None:
        tag, a, b = self._places(digest)
        for bucket in (a, b):
            for slot, held in enumerate(self.tags[bucket]):
                if held == tag and self.content[bucket][slot] == (digest, length):
                    return bucket, slot
        return None

    def get(self, digest: bytes, length: int):
        at = self._find(digest, length)
        return None if at is None else self.payload[at[0]][at[1]]

    def insert(self, digest: bytes, length: int, payload) -> None:
        """For a digest that get() did not find."""
        self.live += 1
        self._put(digest, length, payload)

    def _put(self, digest: bytes, length: int, payload) -> None:
        tag, a, b = self._places(digest)
        bucket = a if len(self.tags[a]) <= len(self.tags[b]) else b
        entry = (tag, (digest, length), payload)
        for turn in range(self.kicks):
            if len(self.tags[bucket]) < _SLOTS:
                self._append(bucket, entry)
                return
            slot = turn % _SLOTS
            pushed = self.tags[bucket][slot], self.content[bucket][slot], self.payload[bucket][slot]
            self.tags[bucket][slot], self.content[bucket][slot], self.payload[bucket][slot] = entry
            entry, bucket = pushed, self._other(bucket, pushed[0])
        self._grow(entry)

    def _append(self, bucket: int, entry: tuple) -> None:
        self.tags[bucket].append(entry[0])
        self.content[bucket].append(entry[1])
        self.payload[bucket].append(entry[2])

    def _grow(self, homeless: tuple) -> None:
        self.resized += 1
        stored = [*self.items(), (*homeless[1], homeless[2])]
        self._make(2 * (self.mask + 1))
        for digest, length, payload in stored:
            self._put(digest, length, payload)

    def delete(self, digest: bytes, length: int) -> bool:
        at = self._find(digest, length)
        if at is None:
            return False
        bucket, slot = at
        for part in (self.tags, self.content, self.payload):
            part[bucket].pop(slot)
        self.live -= 1
        return True

    def items(self):
        for held, payloads in zip(self.content, self.payload, strict=True):
            for (digest, length), payload in zip(held, payloads, strict=True):
                yield digest, length, payload


_GROUPS = "digest binary, n_bytes long, keep_none boolean, keep_id long, group_size long, n_keep long"
_GROUPS_ARROW = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_none", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("n_keep", pa.int64())])


class Group:
    """A digest's payload: the smallest doc_id (none, id), how many live rows there are and how many have that doc_id.
    least is None where the document that stayed has gone while others live."""

    __slots__ = ("least", "size", "n_least")

    def __init__(self, least: tuple[bool, int] | None, size: int, n_least: int):
        self.least, self.size, self.n_least = least, size, n_least

    def add(self, least: tuple[bool, int] | None, size: int, n_least: int) -> None:
        self.size += size
        if self.least is None or least is None:
            self.least, self.n_least = None, 0
        elif least < self.least:
            self.least, self.n_least = least, n_least
        elif least == self.least:
            self.n_least += n_least

    def remove(self, gone: tuple[bool, int] | None, size: int) -> None:
        self.size -= size
        if gone == self.least:
            self.n_least -= size
            if self.n_least <= 0:
                self.least, self.n_least = None, 0


def _group_rows(batches):
    """Each row as digest, length, (least, size, n_least), and what follows those columns."""
    for batch in batches:
        for digest, length, none, keep, size, n_keep, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield digest, length, (None if none is None else (none, keep or 0), size, n_keep), more


def _merge_groups(most: int, sorted_rows: bool):
    """Merges rows of one digest. An index of more than `most` digests is passed on and begun anew: at once on the map
    side, and where rows come in the digests' order when a digest has met all its rows."""

    def run(batches):
        index, last = CuckooIndex(), None
        for digest, length, held, _ in _group_rows(batches):
            if index.live > most and not (sorted_rows and digest == last):
                yield from _rows_of(index)
                index = CuckooIndex()
            last, group = digest, index.get(digest, length)
            if group is None:
                index.insert(digest, length, Group(*held))
            else:
                group.add(*held)
        yield from _rows_of(index)

    return run


def _rows_of(index: CuckooIndex, step: int = 50_000):
    rows = [(d, n, g.least and g.least[0], None if not g.least or g.least[0] else g.least[1], g.size, g.n_least) for d, n, g in index.items()]
    for k in range(0, len(rows), step):
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[k : k + step], strict=True), _GROUPS_ARROW, strict=True)], schema=_GROUPS_ARROW)


def _digest(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " ").cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (sha256 of the normalised text, 32 bytes), n_bytes; in the JVM."""
    norm = doc_texts(docs).select("doc_id", F.regexp_replace("text", BLANKS, " ").alias("norm"))
    return norm.select("doc_id", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"))


def _as_groups(rows: DataFrame, *more: Column) -> DataFrame:
    one = F.lit(1).cast("long")
    return rows.select("digest", "n_bytes", F.col("doc_id").isNull().alias("keep_none"), F.col("doc_id").alias("keep_id"), one.alias("group_size"), one.alias("n_keep"), *more)


def build_index(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows (doc_id, digest, n_bytes) -> one row for each live digest: digest, n_bytes, the doc_id that stays (keep_none:
    it is null), group_size, n_keep (rows with the doc_id that stays)."""
    partial = _as_groups(rows).mapInArrow(_merge_groups(most, False), _GROUPS)
    return partial.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merge_groups(most, True), _GROUPS)


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame, most: int = 200_000) -> DataFrame:
    """An index with changes applied: `inserted` and `deleted` have doc_id, digest, n_bytes. A digest whose last live
    document goes is deleted from the cuckoo index. keep_none and keep_id become null where the document that stayed is
    deleted while others live on; the caller elects the smallest doc_id left from its own table."""

    def run(batches):
        live, last = CuckooIndex(), None
        for digest, length, held, (gone,) in _group_rows(batches):
            if live.live > most and digest != last:
                yield from _rows_of(live)
                live = CuckooIndex()
            last, group = digest, live.get(digest, length)
            if gone:
                if group is not None:
                    group.remove(held[0], held[1])
                    if group.size <= 0:
                        live.delete(digest, length)
            elif group is None:
                live.insert(digest, length, Group(*held))
            else:
                group.add(*held)
        yield from _rows_of(live)

    rows = index.select(*(f.name for f in _GROUPS_ARROW), F.lit(0).alias("gone")).unionByName(_as_groups(inserted, F.lit(0).alias("gone"))).unionByName(_as_groups(deleted, F.lit(1).alias("gone")))
    return rows.repartition("digest").sortWithinPartitions("digest", "gone").mapInArrow(run, _GROUPS)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = written(digests(docs), "digests")
    # Copies of one text meet in a join whose skewed partitions Spark splits; the index side has one row for a digest.
    joined = rows.join(build_index(rows), ["digest", "n_bytes"])
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay; one of those with equal doc_id and text."""
    index = written(build_index(written(digests(docs), "digests")), "index")
    stay = index.select(F.col("keep_id").alias("id"), F.col("digest").alias("key"))
    return rows_that_stay(docs, stay, _digest(F.coalesce(docs["text"], F.lit(""))), not index.where("n_keep > 1").isEmpty())
