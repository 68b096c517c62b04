"""Token ids as length-delimited binary records with a separate offset index.

Record: length of the payload (u64), its masked checksum (u32), payload, the payload's masked checksum (u32). Payload:
doc_id (i64), flags (u8; 1: doc_id is null), bytes per id (u8), ids (unsigned). All little-endian. A checksum is CRC-32,
rotated right by 15 bits plus 0xA282EAD8, so that data holding checksums don't check themselves.
Index: for each record its offset, payload length and number of ids before it in the file (u64 each).

A task writes a pair of files under names of its own into the shared folder and reports them in a manifest; only files
in the manifest count, so a task that runs again leaves no record twice. Records are in ascending doc_id order over the
files in part order (null first; equal doc_ids in the order of their texts' hash). Files hold ranges of (doc_id, hash of
the text, place in the input), so that rows without a doc_id, or repeated rows, are spread over files as others are.

Defined results: a null text is empty and holds the end id alone; an empty table has no file; other columns are unread.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import doc_texts, scratch_path, written
from quillmill.llm.tokens import batch_rows, encoder, text_slices

_LENGTH, _SUM, _PAYLOAD, _INDEX = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<qBB"), struct.Struct("<QQQ")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = _LENGTH.pack(len(payload))
    return b"".join((head, _SUM.pack(masked(head)), payload, _SUM.pack(masked(payload))))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _PAYLOAD.pack(doc_id or 0, doc_id is None, width) + ids


def index_entry(offset: int, length: int, ids_before: int) -> bytes:
    return _INDEX.pack(offset, length, ids_before)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class RecordFile:
    """Reads a record file by its index, in any order."""

    def __init__(self, path: str):
        system, at = _file_system(path)
        with system.open_input_file(f"{at}.idx") as f:
            self.index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)
        self.file = system.open_input_file(f"{at}.rec")

    def __len__(self) -> int:
        return len(self.index)

    def read(self, k: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of record k; ValueError if a checksum is wrong."""
        offset, length, _ = (int(x) for x in self.index[k])
        self.file.seek(offset)
        return _parsed(self.file.read(length + 16), length)

    def shuffled(self, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
        order = list(range(len(self)))
        random.Random(seed).shuffle(order)
        return (self.read(k) for k in order)

    def in_order(self, most_bytes: int = 4 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """All records by the index's offsets, read in runs of about `most_bytes`."""
        offsets, lengths = self.index[:, 0].astype(np.int64), self.index[:, 1].astype(np.int64)
        a = 0
        while a < len(offsets):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes)))
            self.file.seek(int(offsets[a]))
            data = memoryview(self.file.read(int(offsets[b - 1] + lengths[b - 1] + 16 - offsets[a])))
            for at, length in zip((offsets[a:b] - offsets[a]).tolist(), lengths[a:b].tolist(), strict=True):
                yield _parsed(bytes(data[at : at + length + 16]), length)
            a = b

    def close(self) -> None:
        self.file.close()


def _parsed(data: bytes, length: int) -> tuple[int | None, np.ndarray]:
    head, payload = data[:8], data[12:-4]
    if len(data) != length + 16 or _LENGTH.unpack(head)[0] != length or _SUM.unpack(data[8:12])[0] != masked(head) or _SUM.unpack(data[-4:])[0] != masked(payload):
        raise ValueError("damaged record")
    doc_id, null, width = _PAYLOAD.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=_PAYLOAD.size)


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encodes and writes all documents; the manifest: part, path, n_records, n_tokens."""
    folder = folder or scratch_path(docs.sparkSession, "records")

    def run(batches):
        coder, out, name = encoder(tokenizer_path), None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        end = end_id.to_bytes(coder.width, "little")
        at = records = tokens = 0
        for part in (x for b in batches for x in text_slices(b)):
            if out is None:
                system, path = _file_system(name)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out, index = system.open_output_stream(f"{path}.rec"), system.open_output_stream(f"{path}.idx")
            frames, entries = [], []
            for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode_each(part.column(1)), strict=True):
                framed = frame(payload_of(doc_id, ids.tobytes() + end, coder.width))
                frames.append(framed)
                entries.append(index_entry(at, len(framed) - 16, tokens))
                at, tokens = at + len(framed), tokens + len(ids) + 1
            out.write(b"".join(frames))
            index.write(b"".join(entries))
            records += part.num_rows
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [name], "n_records": [records], "n_tokens": [tokens]})

    keyed = doc_texts(docs).select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = keyed.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, path string, n_records long, n_tokens long"), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """One row per record of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32 (of the ids as
    little-endian u32), part, record. The manifest has a row for each file, whose starts are summed on the driver."""
    spark, files, before = manifest.sparkSession, [], 0
    for row in manifest.orderBy("part").collect():
        files.append((row.part, row.path, before))
        before += row.n_tokens

    def run(batches, step: int = 50_000):
        for b in batches:
            for part, path, start in batch_rows(b):
                held, rows = RecordFile(path), []
                for k, (doc_id, ids) in enumerate(held.in_order()):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), part, k))
                    start += len(ids)
                    if len(rows) == step:
                        yield as_batch(rows)
                        rows = []
                held.close()
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "record"]
    listed = spark.createDataFrame(files, "part long, path string, start long").repartition(max(1, len(files)), F.col("part"))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, part long, record long")
