"""Tables inside texts: CSV, markdown pipes, boxes, aligned columns and JSON arrays as header and rows."""

from __future__ import annotations

import csv
import io
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame


def from_csv(text: str) -> tuple[list[str], list[list[str]]]:
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    return _fitting(rows[0], rows[1:]) if rows else ([], [])


def from_pipes(text: str) -> tuple[list[str], list[list[str]]]:
    """Markdown tables and boxes drawn with + - |."""
    lines = [x.strip() for x in text.split("\n") if "|" in x and not re.fullmatch(r"[|+:\-\s]+", x.strip())]
    rows = [[c.strip() for c in x.strip("|").split("|")] for x in lines]
    return _fitting(rows[0], rows[1:]) if rows else ([], [])


def from_aligned(text: str) -> tuple[list[str], list[list[str]]]:
    rows = [re.split(r"\t+|\s{2,}", x.strip()) for x in text.split("\n") if x.strip()]
    return _fitting(rows[0], rows[1:]) if rows else ([], [])


def from_json(text: str) -> tuple[list[str], list[list[str]]]:
    """Objects of an array; the header is all their names, sorted, and what is missing is empty."""
    items = [x for x in json.loads(text) if isinstance(x, dict)]
    head = sorted({k for x in items for k in x})
    return head, [[str(x.get(k, "")) for k in head] for x in items]


def _fitting(head: list[str], rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Rows of another length than the header's go."""
    return head, [r for r in rows if len(r) == len(head)]


FORMATS = {"csv": from_csv, "pipes": from_pipes, "aligned": from_aligned, "json": from_json}


def regions(text: str) -> list[tuple[int, int, str]]:
    """(first line, line after the last, format) of tables in a text: two lines and more of pipes or tabs in a row; of
    overlapping ones the earlier stays."""
    lines, found = text.split("\n"), []
    for kind, sign in (("pipes", "|"), ("aligned", "\t")):
        k = 0
        while k < len(lines):
            end = k
            while end < len(lines) and sign in lines[end]:
                end += 1
            if end - k >= 2:
                found.append((k, end, kind))
            k = max(end, k + 1)
    kept: list[tuple[int, int, str]] = []
    for region in sorted(found):
        if not kept or region[0] >= kept[-1][1]:
            kept.append(region)
    return kept


def parse_tables(df: DataFrame, kind: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, row_no, cells (header -> value) of each text read as one table of this format; unreadable ones have no rows."""
    read = FORMATS[kind]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    head, body = read(text.as_py() or "")
                except (ValueError, csv.Error):
                    continue
                rows += [(doc.as_py(), k, list(dict(zip(head, r, strict=True)).items())) for k, r in enumerate(body)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string())), strict=True)], [key, "row_no", "cells"])

    return df.selectExpr(f"cast({key} as long) as {key}", column).mapInArrow(run, f"{key} long, row_no long, cells map<string,string>")
