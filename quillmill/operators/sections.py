"""Chunkers that follow a text's structure: markdown sections, code blocks, CSV rows. Pure functions over one text, used
through `explode_chunks`."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillmill.operators.chunks import in_slices

CHARS_PER_TOKEN = 4
# What begins a block in each language.
BLOCK_STARTS = {
    "python": r"^(?:async\s+def|def|class)\s+\w+",
    "javascript": r"^(?:export\s+)?(?:async\s+)?(?:function|class)\s+\w+",
    "java": r"^\s*(?:public|private|protected)\s+.*[({]",
}


def markdown_sections(text: str, size: int = 512) -> list[dict]:
    """Sections from one header to the next; one that is too large is cut at line ends and its parts are marked."""
    out: list[dict] = []
    header, level, held = "", 0, []

    def flush(partial: bool) -> None:
        content = "\n".join(held).strip()
        if content:
            out.append({"header": header, "level": level, "content": content, "partial": partial})
        held.clear()

    for line in text.split("\n"):
        if m := re.match(r"^(#{1,6})\s+(.+)$", line):
            flush(False)
            header, level = m[2], len(m[1])
        held.append(line)
        if sum(map(len, held)) // CHARS_PER_TOKEN > size:
            flush(True)
    flush(False)
    return out


def code_blocks(text: str, language: str, size: int = 512) -> list[dict]:
    """Blocks that begin at definitions; small neighbours are put together up to the size."""
    start = re.compile(BLOCK_STARTS.get(language, r"^\S"))
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        if start.match(line) and any(x.strip() for x in blocks[-1]):
            blocks.append([])
        blocks[-1].append(line)
    out, held = [], ""
    for block in ("\n".join(b) for b in blocks):
        if held and len(held) + len(block) > size * CHARS_PER_TOKEN:
            out.append(held)
            held = block
        else:
            held = f"{held}\n{block}" if held else block
    return [{"header": "", "level": 0, "content": c.strip("\n"), "partial": False} for c in [*out, held] if c.strip()]


def csv_rows(text: str, size: int = 512) -> list[dict]:
    """Rows put together under the header, which each chunk repeats; a row that is too large alone is marked."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return []
    head, out, held = lines[0], [], []
    room = size * CHARS_PER_TOKEN
    for line in lines[1:]:
        if held and len(head) + sum(len(x) + 1 for x in held) + len(line) + 1 > room:
            out.append(held)
            held = []
        held.append(line)
    if held:
        out.append(held)
    return [{"header": head, "level": 0, "content": "\n".join([head, *rows]), "partial": len(head) + sum(len(x) + 1 for x in rows) > room} for rows in out]


CHUNKERS = {"markdown": markdown_sections, "python": lambda t: code_blocks(t, "python"), "javascript": lambda t: code_blocks(t, "javascript"), "java": lambda t: code_blocks(t, "java"), "csv": csv_rows}


def explode_chunks(df: DataFrame, kind: str) -> DataFrame:
    """doc_id, chunk_index, header, level, content, partial."""
    cut = CHUNKERS[kind]

    def run(batches):
        for batch in in_slices(batches):
            rows = [(d.as_py(), k, c["header"], c["level"], c["content"], c["partial"]) for d, t in zip(batch.column(0), batch.column(1), strict=True) for k, c in enumerate(cut(t.as_py() or ""))]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)], ["doc_id", "chunk_index", "header", "level", "content", "partial"])

    return df.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, chunk_index int, header string, level int, content string, partial boolean")
