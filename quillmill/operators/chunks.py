"""Chunkers: fixed width, sentences, paragraphs, two levels, and row chunks of tables.

Greedy cutting is sequential within one text, so these run as Arrow batch functions over rows; a text's chunks leave
the function as rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def fixed(text: str, size: int = 512, overlap: int = 64) -> list[tuple[int, str]]:
    """(start, chunk) of windows of `size` tokens, cut at the last space, with `overlap` tokens shared. Always moves on,
    where the rule alone would stand still."""
    width, back = size * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    out, start = [], 0
    while start < len(text):
        end = start + width
        if end < len(text) and (space := text.rfind(" ", start, end)) > start:
            end = space
        chunk = text[start:end].strip()
        if chunk:
            out.append((start, chunk))
        following = end - back
        start = end if following <= start else following
    return out


def packed(pieces: list[str], joiner: str, size: int) -> list[str]:
    """Pieces put together until one more would make more than `size` tokens."""
    out, held = [], ""
    for piece in (p.strip() for p in pieces):
        if not piece:
            continue
        longer = held + joiner + piece if held else piece
        if len(longer) // CHARS_PER_TOKEN > size and held:
            out.append(held)
            held = piece
        elif len(longer) // CHARS_PER_TOKEN > size:
            held = piece
        else:
            held = longer
    return [*out, held] if held else out


def sentences(text: str, size: int = 512) -> list[str]:
    return packed(re.split(r"[.!?]+(?:\s|$)", text), " ", size)


def paragraphs(text: str, size: int = 512) -> list[str]:
    return packed(re.split(r"\n\s*\n", text), "\n\n", size)


def two_levels(text: str, parent: int = 1024, child: int = 512, overlap: int = 64) -> list[tuple]:
    """(level, parent index, index in parent, start, chunk): parents first, each followed by its children. A position is
    where the chunk is next found in the text."""
    out, at = [], 0
    for p, (_, whole) in enumerate(fixed(text, parent, overlap)):
        found = text.find(whole, max(0, at))
        begin = found if found >= 0 else at
        out.append((0, p, 0, begin, whole))
        at = begin + len(whole) - overlap * CHARS_PER_TOKEN
        for c, (_, part) in enumerate(fixed(whole, child, overlap)):
            out.append((1, p, c, begin + max(0, whole.find(part)), part))
    return out


_CUTS = {
    "fixed": lambda t, **k: [(0, i, 0, s, x) for i, (s, x) in enumerate(fixed(t, **k))],
    "sentences": lambda t, **k: [(0, i, 0, -1, x) for i, x in enumerate(sentences(t, **k))],
    "paragraphs": lambda t, **k: [(0, i, 0, -1, x) for i, x in enumerate(paragraphs(t, **k))],
    "hierarchical": two_levels,
}


def in_slices(batches, rows: int = 64):
    """Batches of a few texts each, as what is made of a batch is held as Python objects and as Arrow data at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def chunk(docs: DataFrame, how: str, **sizes: int) -> DataFrame:
    """doc_id, level, parent_index, child_index, start_index (-1: not kept), content; null texts have no chunks."""

    def run(batches):
        for batch in in_slices(batches):
            rows = [(doc_id.as_py(), *c) for doc_id, text in zip(batch.column(0), batch.column(1), strict=True) for c in _CUTS[how](text.as_py() or "", **sizes)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["doc_id", "level", "parent_index", "child_index", "start_index", "content"])

    schema = "doc_id long, level int, parent_index int, child_index int, start_index long, content string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def with_ids(chunks: DataFrame) -> DataFrame:
    """Chunk and parent ids from document, level and place, token and character counts, and the label n/total."""
    name = lambda level, child: F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), level, F.col("parent_index").cast("string"), child), 256), 1, 16)
    siblings = F.count("*").over(Window.partitionBy("doc_id", "level", "parent_index"))
    return chunks.withColumns({
        "chunk_id": name(F.col("level").cast("string"), F.col("child_index").cast("string")),
        "parent_id": F.when(F.col("level") == 1, name(F.lit("0"), F.lit("0"))),
        "token_count": F.floor(F.length("content") / CHARS_PER_TOKEN),
        "char_count": F.length("content"),
        "position": F.when(F.col("level") == 1, F.concat_ws("/", (F.col("child_index") + 1).cast("string"), siblings.cast("string"))),
    })


def expanded_context(chunks: DataFrame) -> DataFrame:
    """Each child with its parent's text in which the child is marked, or the two texts where it isn't found."""
    parents = chunks.where("level = 0").select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    joined = chunks.where("level = 1").join(parents, "parent_id", "left")
    marked = F.concat(F.lit(">>>FOCUS>>> "), F.col("content"), F.lit(" <<<FOCUS<<<"))
    inside = F.replace("parent_content", F.col("content"), marked)
    found = F.contains("parent_content", F.col("content"))
    return joined.select("chunk_id", "parent_id", F.when(found, inside).otherwise(F.concat_ws("\n\n", "parent_content", "content")).alias("context"))
