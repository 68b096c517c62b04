"""File, table and message sources; structural chunkers."""

import io
import json
import zipfile

import pytest

from quillmill.operators import sections
from quillmill.sources import files, text_tables
from quillmill.sources.messages import ChannelHistory

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
M = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def zipped(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return held.getvalue()


def test_folder_of_many_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docx = zipped({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    sheet = f'<worksheet xmlns="{M}"><sheetData><row><c t="s"><v>0</v></c><c><v>2</v></c></row></sheetData></worksheet>'
    xlsx = zipped({"xl/workbook.xml": f'<workbook xmlns="{M}"><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{M}"><si><t>head</t></si></sst>', "xl/worksheets/sheet1.xml": sheet})
    for name, data in {
        "a.txt": "plain", "in/b.md": "# One\ntext\n## Two", "c.csv": "x,y\n" + "\n".join(f"{k},{k}" for k in range(12)), "d.json": json.dumps({"k": [1]}), "e.xml": '<r xmlns="urn:q"><i>1</i></r>',
        "f.html": "<title>T</title><script>s()</script><p>seen <a href=x>l</a></p>", "g.py": "# c\n\nx = 1", "h.docx": docx, "i.xlsx": xlsx, "j.json": "{broken", "k.txt": "é".encode("latin-1"), "l.bin": "unread",
    }.items():
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    got = {r.path.rpartition("/")[2]: r for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.txt", "b.md", "c.csv", "d.json", "e.xml", "f.html", "g.py", "h.docx", "i.xlsx", "j.json", "k.txt"}
    assert got["b.md"].facts["headers"] == "2" and got["c.csv"].text.endswith("... and 2 more rows")
    assert got["e.xml"].facts == {"root": "r", "elements": "2", "namespace": "urn:q", "encoding": "utf-8", "bytes": "29"}
    assert got["f.html"].facts["title"] == "T" and "s()" in got["f.html"].text and "s()" not in files.html_text("<script>s()</script>x")[0]
    assert got["g.py"].facts["comments"] == "1" and got["h.docx"].text == "Hello\na | b" and "head, 2" in got["i.xlsx"].text
    assert got["j.json"].text is None and got["j.json"].error.startswith("JSONDecodeError")
    assert got["k.txt"].text == "é" and got["k.txt"].facts["encoding"] == "latin-1"


@pytest.mark.parametrize(
    "kind, text, head, rows",
    [
        ("csv", "a,b\n1,2\n3\n4,5", ["a", "b"], [["1", "2"], ["4", "5"]]),
        ("pipes", "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |", ["a", "b"], [["1", "2"]]),
        ("pipes", "+---+---+\n| a | b |\n+---+---+\n| 1 | 2 |\n+---+---+", ["a", "b"], [["1", "2"]]),
        ("aligned", "a    b\n1    2\nx y   z", ["a", "b"], [["1", "2"], ["x y", "z"]]),
        ("json", '[{"b": 1}, {"a": 2}]', ["a", "b"], [["", "1"], ["2", ""]]),
    ],
)
def test_table_formats(kind, text, head, rows):
    assert text_tables.FORMATS[kind](text) == (head, rows)


def test_tables_of_texts_and_regions(spark):
    df = spark.createDataFrame([(1, "a,b\n1,2"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.cells) for r in text_tables.parse_tables(df, "csv").collect()] == [(1, {"a": "1", "b": "2"})]
    assert text_tables.regions("t\na|b\nc|d\nt\nx\ty\nz\tw\n|") == [(1, 3, "pipes"), (4, 6, "aligned")]


def pages(channel, page, size):
    posts = [{"id": f"{channel}{k}", "message": "" if k == 1 else f"m{k}", "create_at": k} for k in range(5)]
    return posts[page * size : (page + 1) * size]


def test_channel_history(spark):
    spark.dataSource.register(ChannelHistory)
    df = spark.read.format("channel_history").option("pages", "tests.test_sources:pages").option("channels", "a,b").option("per_page", "2").load()
    assert sorted(r.id for r in df.collect()) == ["a0", "a2", "a3", "a4", "b0", "b2", "b3", "b4"]


def test_structural_chunks(spark):
    md = sections.markdown_sections("intro\n# A\none\n## B\ntwo", 100)
    assert [(c["header"], c["level"], c["content"]) for c in md] == [("", 0, "intro"), ("A", 1, "# A\none"), ("B", 2, "## B\ntwo")]
    assert all(c["partial"] for c in sections.markdown_sections("# A\n" + "x\n" * 60, 10)[:-1])
    blocks = sections.code_blocks("import x\ndef a():\n  pass\ndef b():\n  pass", "python", 6)
    assert [c["content"].split("\n")[0] for c in blocks] == ["import x", "def b():"]
    rows = sections.csv_rows("h1,h2\n" + "\n".join(f"{k},{'x' * 30}" for k in range(10)), 25)
    assert all(c["content"].startswith("h1,h2\n") for c in rows) and sum(c["content"].count("\n") for c in rows) == 10
    df = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.header) for r in sections.explode_chunks(df, "markdown").collect()] == [(1, "A")]
