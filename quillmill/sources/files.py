"""Files as documents: one row per file with its text, kind, facts, or the error that stopped its parsing.

Spark lists and reads the files (any file system it knows); parsing runs as an Arrow batch function on their bytes."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Suffixes that a folder is searched for.
SUFFIXES = ["txt", "md", "csv", "json", "xml", "html", "htm", "py", "js", "docx", "xlsx"]
_CODE = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "cpp": "cpp", "c": "c", "h": "c_header"}
SCHEMA = "path string, kind string, text string, facts map<string,string>, error string"


def decoded(data: bytes) -> tuple[str, str]:
    """Text and the first encoding that fits: UTF-8, UTF-16 (with its mark), Latin-1."""
    for name in ("utf-8", "utf-16", "latin-1"):
        if name == "utf-16" and data[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if text:
            return text, name
    raise ValueError("empty file")


class _Visible(HTMLParser):
    def __init__(self, skip: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.skip, self.hidden, self.parts = skip, 0, []
        self.title, self.in_title, self.facts = "", False, {"links": 0, "images": 0, "tables": 0, "description": ""}

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.skip
        self.in_title = tag == "title" or self.in_title
        for name, key in (("a", "links"), ("img", "images"), ("table", "tables")):
            self.facts[key] += tag == name
        held = dict(attrs)
        if tag == "meta" and held.get("name") == "description":
            self.facts["description"] = held.get("content") or ""

    def handle_endtag(self, tag):
        self.hidden -= tag in self.skip and self.hidden > 0
        self.in_title = self.in_title and tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(html: str, skip: tuple[str, ...] = ("script", "style")) -> tuple[str, dict]:
    """Visible text, a line for each run of it, with title, description and counts."""
    parser = _Visible(skip)
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts), {"title": parser.title, **{k: str(v) for k, v in parser.facts.items()}}


def markdown(text: str) -> tuple[str, dict]:
    headers = re.findall(r"^#+\s+(.+)$", text, re.M)
    return text, {"headers": str(len(headers)), "first_headers": json.dumps(headers[:10], ensure_ascii=False), "lines": str(text.count("\n") + 1)}


def csv_summary(text: str, shown: int = 10) -> tuple[str, dict]:
    rows = list(csv.reader(io.StringIO(text)))
    head, body = (rows[0], rows[1:]) if rows else ([], [])
    lines = [f"Columns: {', '.join(head)}", f"Shape: {len(body)} rows x {len(head)} columns", *(", ".join(r) for r in body[:shown])]
    if len(body) > shown:
        lines.append(f"... and {len(body) - shown} more rows")
    return "\n".join(lines), {"rows": str(len(body)), "columns": str(len(head))}


def json_text(text: str) -> tuple[str, dict]:
    value = json.loads(text)
    facts = {"type": type(value).__name__}
    if isinstance(value, dict):
        facts |= {"keys": json.dumps(list(value), ensure_ascii=False)}
    if isinstance(value, list):
        facts |= {"size": str(len(value)), "item_type": type(value[0]).__name__ if value else ""}
    return json.dumps(value, indent=2, ensure_ascii=False), facts


def xml_text(text: str) -> tuple[str, dict]:
    root = ElementTree.fromstring(text)
    lines, count = [], 0

    def walk(node, depth):
        nonlocal count
        count += 1
        lines.append("  " * depth + node.tag.rpartition("}")[2] + (f": {node.text.strip()}" if node.text and node.text.strip() else ""))
        for child in node:
            walk(child, depth + 1)

    walk(root, 0)
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    return "\n".join(lines), {"root": root.tag.rpartition("}")[2], "elements": str(count), "namespace": space}


def code(text: str, suffix: str) -> tuple[str, dict]:
    lines = [x.strip() for x in text.split("\n")]
    return text, {"language": _CODE.get(suffix, "unknown"), "lines": str(len(lines)), "filled": str(sum(map(bool, lines))), "comments": str(sum(x.startswith(("#", "//", "/*")) for x in lines))}


def docx_text(data: bytes) -> tuple[str, dict]:
    """Paragraphs, then tables with ` | ` between cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    paragraphs = [said(p) for p in body.findall(f"{w}p")]
    tables = [" | ".join(said(c) for c in row.findall(f"{w}tc")) for table in body.findall(f"{w}tbl") for row in table.findall(f"{w}tr")]
    return "\n".join([p for p in paragraphs if p.strip()] + tables), {"paragraphs": str(len(paragraphs)), "table_rows": str(len(tables))}


def xlsx_text(data: bytes, shown: int = 5) -> tuple[str, dict]:
    """Each sheet's columns and first rows."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet")]
        lines = []
        for title, name in zip(sheets, sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])), strict=False):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{m}row"):
                cells = []
                for c in row.findall(f"{m}c"):
                    v = c.find(f"{m}v")
                    value = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{m}t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                rows.append(cells)
            lines += [f"Sheet: {title}", f"Shape: {max(0, len(rows) - 1)} rows x {len(rows[0]) if rows else 0} columns", *(", ".join(r) for r in rows[: shown + 1])]
    return "\n".join(lines), {"sheets": str(len(sheets))}


def parse(path: str, data: bytes) -> tuple[str, str, dict]:
    """kind, text, facts by the file's extension; unknown ones are text."""
    suffix = path.rpartition(".")[2].lower()
    if suffix == "docx":
        return ("docx", *docx_text(data))
    if suffix == "xlsx":
        return ("excel", *xlsx_text(data))
    text, encoding = decoded(data)
    if suffix in ("md", "markdown"):
        kind, (text, facts) = "markdown", markdown(text)
    elif suffix == "csv":
        kind, (text, facts) = "csv", csv_summary(text)
    elif suffix == "json":
        kind, (text, facts) = "json", json_text(text)
    elif suffix == "xml":
        kind, (text, facts) = "xml", xml_text(text)
    elif suffix in ("html", "htm"):
        kind, (text, facts) = "html", html_text(text, ())
    elif suffix in _CODE:
        kind, (text, facts) = "code", code(text, suffix)
    else:
        kind, facts = "text", {}
    return kind, text, facts | {"encoding": encoding, "bytes": str(len(data))}


def read_folder(spark: SparkSession, folder: str, suffixes: list[str] | None = None) -> DataFrame:
    """All files under a folder with these suffixes; a file that can't be parsed is a row with its error."""
    glob = "*.{" + ",".join(suffixes or SUFFIXES) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    kind, text, facts = parse(path.as_py(), content.as_py())
                    rows.append((path.as_py(), kind, text, list(facts.items()), None))
                except Exception as e:  # the row says what went wrong
                    rows.append((path.as_py(), None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "kind", "text", "facts", "error"])

    return found.mapInArrow(run, SCHEMA)
