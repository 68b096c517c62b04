"""Substring deduplication by super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is the least hash among its runs of `grain` words; consecutive
windows of a document that share a minimiser travel as one string, the super-k-mer, to that minimiser's bucket. Equal
windows have equal minimisers, so all copies of a window meet in one bucket, where sorting the windows shows exactly in
which documents each occurs. Equal super-k-mers of one map slice go as one row with the least and greatest doc_id, so a
passage in very many documents is one row for each slice. A bucket returns, for each super-k-mer with windows in more
than one document, those windows' least doc_ids; the documents' super-k-mers are joined with these by a 128-bit BLAKE2
digest of their words (a join whose skewed partitions Spark splits), and the word ranges found are joined with the texts.

The number of buckets follows the input's bytes, so a bucket holds about `bucket_bytes` of super-k-mers at any size. A
minimiser whose super-k-mers alone would fill a good part of a bucket (one phrase in many different surroundings) is
split: its windows go on one by one, by their own digest, and are counted by a pre-aggregated groupBy. Which minimisers
those are is estimated on every 16th text by its hash; that decides only which way a window goes, never the result.

Defined results: a null text has no words; a document shorter than a window has none; a null doc_id counts as 2^63-1
where ids are compared and stays null in results; rows of equal doc_id and text share their result; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import NO_ID, shuffle_width, written
from quillmill.llm.tokens import text_slices

#: A super-k-mer repeats the words that it shares with the next one: bytes sent for a byte of text, about.
_SPREAD = 3.3
#: Every so many texts are looked at to find the minimisers that are split; at most so many are.
_EVERY, _MOST_SPLIT = 16, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, n: int, join) -> np.ndarray:
    """join over each n consecutive values, where join may see a value twice."""
    size = 1
    while 2 * size <= n:
        x = join(x[:-size], x[size:])
        size *= 2
    return join(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def _runs_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes (n a power of two)."""
    size = 1
    while size < n:
        words = _mixed(words[:-size] * _MIX + words[size:])
        size *= 2
    return words


class SuperKmers:
    """The super-k-mers of a slice of texts: `key` (minimiser), `doc` (row), `start` (word), `windows` (how many) and
    `texts` (words joined by a space, unless only the keys are wanted)."""

    def __init__(self, texts: pa.Array, width: int, grain: int, keys_only: bool = False):
        trimmed = pc.ascii_trim_whitespace(texts)
        rows = np.flatnonzero(pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False))
        self.key = self.doc = self.start = self.windows = np.zeros(0, np.int64)
        self.texts: list[bytes] = []
        if not len(rows):
            return
        parts = pc.ascii_split_whitespace(trimmed.take(pa.array(rows)))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = parts.flatten().dictionary_encode()
        if len(coded) < width:
            return
        codes = coded.indices.to_numpy()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        size = np.diff(bounds)
        doc = np.repeat(np.arange(len(rows)), size)
        # a line has a space between its words only
        after = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes] + 1
        begin = np.cumsum(after) - after - doc
        end = begin + after - 1
        n = len(codes) - width + 1
        low = _sliding(_mixed(_runs_hash(hashes[codes], grain)), width - grain + 1, np.minimum)[:n]
        valid = doc[:n] == doc[width - 1 :]
        same = np.zeros(n, bool)
        same[1:] = valid[1:] & valid[:-1] & (low[1:] == low[:-1]) & (doc[1:n] == doc[: n - 1])
        first = np.flatnonzero(valid & ~same)
        if not len(first):
            return
        stop = np.concatenate([first[1:], [n]])
        # a run also stops where windows would cross into the next document
        last_valid = bounds[doc[first] + 1] - width
        count = np.minimum(stop - 1, last_valid) - first + 1
        self.key, self.doc, self.start, self.windows = low[first].view(np.int64), rows[doc[first]], first - bounds[doc[first]], count
        if keys_only:
            return
        line = b"".join(pc.binary_join(parts, " ").cast(pa.binary()).to_pylist())
        self.texts = [line[a:b] for a, b in zip(begin[first].tolist(), end[first + count + width - 2].tolist(), strict=True)]


    def split(self, keys: np.ndarray) -> np.ndarray:
        """Which have one of these sorted keys."""
        at = np.searchsorted(keys, self.key)
        return keys[np.minimum(at, len(keys) - 1)] == self.key if len(keys) else np.zeros(len(self.key), bool)

    def each_window(self, which: np.ndarray, width: int) -> tuple[list[int], list[int], list[bytes]]:
        """Row, first word and digest of each window of these super-k-mers."""
        docs, starts, digests = [], [], []
        for k in np.flatnonzero(which).tolist():
            words, doc, start = self.texts[k].split(b" "), int(self.doc[k]), int(self.start[k])
            for i in range(len(words) - width + 1):
                docs.append(doc)
                starts.append(start + i)
                digests.append(_digest(b" ".join(words[i : i + width])))
        return docs, starts, digests


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


_HEAD = struct.Struct("<II")


def pack_rows(table: pa.Table) -> bytes:
    """Rows (key, least, greatest, text: large_binary) as one compressed string with little besides the values."""
    text = table["text"].combine_chunks()
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    lines = memoryview(text.buffers()[2])[offsets[0] : offsets[-1]] if len(text) else b""
    numbers = [table[c].to_numpy().tobytes() for c in ("key", "least", "greatest")]
    raw = b"".join((*numbers, np.diff(offsets).astype("<u4").tobytes(), lines))
    return _HEAD.pack(len(text), len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_rows(blob: bytes) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """(key, least, greatest) as rows of one array, the texts' lengths, and the texts end to end."""
    n, size = _HEAD.unpack_from(blob)
    raw = pa.decompress(memoryview(blob)[_HEAD.size :], size, codec="zstd")
    numbers = np.frombuffer(raw, np.int64, 3 * n).reshape(3, n)
    return numbers, np.frombuffer(raw, "<u4", n, 24 * n), memoryview(raw)[28 * n :]


def _distinct(key: np.ndarray, least: np.ndarray, greatest: np.ndarray, text: pa.Array) -> pa.Table:
    """One row for each super-k-mer."""
    table = pa.table({"key": pa.array(key), "least": pa.array(least), "greatest": pa.array(greatest), "text": text})
    merged = table.group_by(["key", "text"]).aggregate([("least", "min"), ("greatest", "max")])
    return pa.table({"key": merged["key"], "least": merged["least_min"], "greatest": merged["greatest_max"], "text": merged["text"]}).combine_chunks()


def minimisers_to_split(docs: DataFrame, width: int, grain: int, split_from: int) -> np.ndarray:
    """The minimisers of about split_from super-k-mers or more, sorted; at most _MOST_SPLIT of them, whatever the input."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b, 2)):
            keys, counts = np.unique(SuperKmers(part.column(2), width, grain, keys_only=True).key, return_counts=True)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "n": pa.array(counts, pa.int64())})

    some = docs.select("doc_id", "text_hash", "text").where(F.pmod(F.xxhash64("text_hash"), F.lit(_EVERY)) == 0)
    counted = written(some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > 1), "minimisers")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(2, split_from / _EVERY, total / _MOST_SPLIT)
    return np.array(sorted(r.key for r in counted.where(F.col("n") >= least).select("key").collect()), np.int64)


def send(docs: DataFrame, width: int, grain: int, buckets: int, apart: np.ndarray) -> DataFrame:
    """bucket, packed: the distinct super-k-mers of each slice, compressed together for each bucket."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b, 2, 2 << 20)):
            found = SuperKmers(part.column(2), width, grain)
            at = np.flatnonzero(~found.split(apart))
            if not len(at):
                continue
            ids = part.column(0).to_numpy()[found.doc[at]]
            table = _distinct(found.key[at], ids, ids, pa.array([found.texts[k] for k in at.tolist()], pa.large_binary()))
            bucket = (table["key"].to_numpy().view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            table, bucket = table.take(pa.array(order)).combine_chunks(), bucket[order]
            begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            packed = [pack_rows(table.slice(a, b - a)) for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begin], pa.int32()), pa.array(packed, pa.binary())], ["bucket", "packed"])

    return docs.mapInArrow(run, "bucket int, packed binary")


def shared_windows(lines: list[bytes], least: list[int], greatest: list[int], width: int) -> list[list[tuple[int, int, int]]]:
    """For each of these distinct super-k-mers of one minimiser, the runs (from, to, least doc_id) of its windows that
    occur in more than one document.

    Windows are sorted by hash, and within one hash told apart by their words; only the hash and place of a window are
    kept, never its text, so a minimiser with very many or very long super-k-mers stays small in memory."""
    if len(lines) == 1:
        n = lines[0].count(b" ") + 2 - width
        return [[(0, n, least[0])] if least[0] < greatest[0] else []]
    ends = [np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20), len(line)) for line in lines]
    sizes = np.array([len(e) + 1 - width for e in ends])
    owner = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    digest = xxhash.xxh64_intdigest
    hashes = np.empty(len(owner), np.uint64)
    at = 0
    for line, end, n in zip(lines, ends, sizes.tolist(), strict=True):
        begins, stops = [0, *(end[: n - 1] + 1).tolist()], end[width - 1 :].tolist()
        hashes[at : at + n] = [digest(line[x:y]) for x, y in zip(begins, stops, strict=True)]
        at += n
    order = np.argsort(hashes, kind="stable")
    hashes, owner, place = hashes[order], owner[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    stop = np.append(begin[1:], len(hashes))
    low = np.minimum.reduceat(np.array(least)[owner], begin)
    shared = np.flatnonzero(low < np.maximum.reduceat(np.array(greatest)[owner], begin))
    kept, lows = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)

    def text(j: int) -> bytes:
        k, i = int(owner[j]), int(place[j])
        return lines[k][ends[k][i - 1] + 1 if i else 0 : ends[k][i + width - 1]]

    for x, y, m in zip(begin[shared].tolist(), stop[shared].tolist(), low[shared].tolist(), strict=True):
        first = text(x)
        if all(text(j) == first for j in range(x + 1, y)):
            kept[x:y], lows[x:y] = True, m
            continue
        groups: dict[bytes, list[int]] = {}  # different windows of one hash
        for j in range(x, y):
            groups.setdefault(text(j), []).append(j)
        for held in groups.values():
            m = min(least[owner[j]] for j in held)
            if m < max(greatest[owner[j]] for j in held):
                kept[held], lows[held] = True, m
    return _as_runs(owner[kept], place[kept], lows[kept], len(lines))


def _as_runs(owner: np.ndarray, place: np.ndarray, low: np.ndarray, n: int) -> list[list[tuple[int, int, int]]]:
    """Windows as runs of neighbours with the same least doc_id, for each of n owners."""
    order = np.lexsort((place, owner))
    owner, place, low = owner[order], place[order], low[order]
    follows = (owner[1:] == owner[:-1]) & (place[1:] == place[:-1] + 1) & (low[1:] == low[:-1])
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), ~follows]))
    last = np.append(begin[1:], len(owner))[: len(begin)] - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for k, x, y, m in zip(owner[begin].tolist(), place[begin].tolist(), place[last].tolist(), low[begin].tolist(), strict=True):
        out[k].append((x, y + 1, m))
    return out


_RUNS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64()), ("least", pa.int64())]))
_FOUND = "digest binary, runs array<struct<from:long,to:long,least:long>>"


def _bucket_rows(blobs: list[bytes], width: int):
    parts = [unpack_rows(b) for b in blobs]
    key, least, greatest = np.concatenate([p[0] for p in parts], axis=1)
    ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]), dtype=np.int64)])
    lines = pa.Array.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(p[2] for p in parts))])
    # minimisers met in one document only have no shared window
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    shared = np.minimum.reduceat(least[order], begin) < np.maximum.reduceat(greatest[order], begin)
    at = np.sort(order[np.repeat(shared, np.diff(np.append(begin, len(key))))])
    if not len(at):
        return
    table = _distinct(key[at], least[at], greatest[at], lines.take(pa.array(at))).sort_by("key").combine_chunks()
    key, least, greatest = (table[c].to_numpy() for c in ("key", "least", "greatest"))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    digests, found = [], []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(key)], strict=True):  # one minimiser's words at a time
        held = table["text"].slice(a, b - a).to_pylist()
        for line, runs in zip(held, shared_windows(held, least[a:b].tolist(), greatest[a:b].tolist(), width), strict=True):
            if runs:
                digests.append(_digest(line))
                found.append([{"from": x, "to": y, "least": z} for x, y, z in runs])
        if len(found) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, _RUNS)], ["digest", "runs"])
            digests, found = [], []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, _RUNS)], ["digest", "runs"])


def count_windows(sent: DataFrame, width: int, buckets: int) -> DataFrame:
    """digest, runs of each super-k-mer that has windows in more than one document. A bucket is a partition."""

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(number, []).append(blob)
        while held:  # more than one only where the session joins partitions
            yield from _bucket_rows(held.popitem()[1], width)

    return sent.repartitionById(buckets, "bucket").mapInArrow(run, _FOUND)


def occurrences(docs: DataFrame, width: int, grain: int, apart: np.ndarray) -> DataFrame:
    """digest, doc_id, text_hash, start of every super-k-mer that is not split."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b, 2, 2 << 20)):
            found = SuperKmers(part.column(2), width, grain)
            at = np.flatnonzero(~found.split(apart))
            if len(at):
                doc, digest = pa.array(found.doc[at]), pa.array([_digest(found.texts[k]) for k in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([digest, part.column(0).take(doc), part.column(1).take(doc), pa.array(found.start[at])], ["digest", "doc_id", "text_hash", "start"])

    return docs.mapInArrow(run, "digest binary, doc_id long, text_hash long, start long")


def split_windows(docs: DataFrame, width: int, grain: int, apart: np.ndarray, step: int = 100_000) -> DataFrame:
    """digest, doc_id, text_hash, start of every window of the super-k-mers that are split."""

    def run(batches):
        for part in (x for b in batches for x in text_slices(b, 2, 2 << 20)):
            found = SuperKmers(part.column(2), width, grain)
            rows, starts, digests = found.each_window(found.split(apart), width)
            for k in range(0, len(rows), step):
                doc = pa.array(rows[k : k + step], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digests[k : k + step], pa.binary()), part.column(0).take(doc), part.column(1).take(doc), pa.array(starts[k : k + step], pa.int64())], ["digest", "doc_id", "text_hash", "start"])

    return docs.mapInArrow(run, "digest binary, doc_id long, text_hash long, start long")


def repeated_ranges(docs: DataFrame, width: int = 50, grain: int = 8, bucket_bytes: int = 24 << 20, split_from: int = 20_000) -> DataFrame:
    """docs (doc_id, text_hash, text) -> doc_id, text_hash, ranges: starts (from, to) of windows, counted in words, that
    also start in a document of smaller doc_id."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), math.ceil(total * _SPREAD / bucket_bytes))
    apart = minimisers_to_split(docs, width, grain, split_from)
    found = written(count_windows(send(docs, width, grain, buckets, apart), width, buckets), "windows")
    runs = F.filter("runs", lambda r: r["least"] < F.col("doc_id"))
    moved = F.transform(runs, lambda r: F.struct((r["from"] + F.col("start")).alias("from"), (r["to"] + F.col("start")).alias("to")))
    met = occurrences(docs, width, grain, apart).join(found, "digest").select("doc_id", "text_hash", moved.alias("ranges")).where(F.size("ranges") > 0)
    if len(apart):
        each = split_windows(docs, width, grain, apart)
        least = written(each.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least"), "split_windows")
        one = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + 1).alias("to")))
        met = met.unionByName(each.join(least, "digest").where("least < doc_id").select("doc_id", "text_hash", one.alias("ranges")))
    # a set, so that repeated rows add nothing
    return met.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """doc_id (to be compared), text_hash, text, and more."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def keep_mask(words: list[bytes], ranges: list[dict] | None, width: int) -> np.ndarray:
    keep = np.ones(len(words), bool)
    for r in ranges or ():
        keep[r["from"] : r["to"] + width - 1] = False
    return keep


def kept_words(words: list[bytes], keep: np.ndarray) -> bytes:
    return b" ".join(words if keep.all() else [words[k] for k in np.flatnonzero(keep).tolist()])


def substring_digests(docs: DataFrame, width: int = 50, grain: int = 8, **how: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""
    texts = _keyed(docs, docs["doc_id"].cast("long").alias("own_id"))
    joined = texts.join(repeated_ranges(texts.drop("own_id"), width, grain, **how), ["doc_id", "text_hash"], "left").select("own_id", "text", "ranges")

    def run(batches):
        for part in (x for b in batches for x in text_slices(b)):
            rows = []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = text.encode().split()
                keep = keep_mask(words, ranges, width)
                rows.append((len(words), int((~keep).sum()), hashlib.sha256(kept_words(words, keep)).hexdigest()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 50, grain: int = 8, **how: int) -> DataFrame:
    """docs, all columns, where each text is without its repeated words: one that loses none stays as it is, one that
    does has its kept words joined by a space."""
    texts = _keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ranges = repeated_ranges(texts.drop("row"), width, grain, **how)
    joined = texts.join(ranges, ["doc_id", "text_hash"], "left").select("row.*", "ranges")
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            cleaned = []
            for text, found in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py()
                if found.is_valid:
                    words = text.encode().split()
                    text = kept_words(words, keep_mask(words, found.as_py(), width)).decode()
                cleaned.append(text)
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(cleaned, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
