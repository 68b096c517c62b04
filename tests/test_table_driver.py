"""Texts with tables inside: every chunk has its parent, rows overlap, columns are counted, nothing is lost."""

import pytest

from quillmill.operators import table_driver

TABLE = "| name | size | name |\n|---|---|---|\n" + "\n".join(f"| a{k % 3} | {k} | b{k} |" for k in range(45)) + "\n| short | row |"
ROWS = [(1, f"Before it.\n\n{TABLE}\nAfter it.", "x"), (2, "no table | here", "x"), (3, "h1\th2\nv\tw", "x"), (4, None, "x"), (5, "", "x"), (6, "|-|\n|-|\nwords", "x"), (7, "a | b\nonly | one\n\ntext " * 300, "x")]


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, content string")
    return docs, [r.asDict() for r in table_driver.mixed_chunks(docs).collect()]


def test_every_parent_exists(made):
    _, rows = made
    ids = {r["chunk_id"] for r in rows}
    assert all(r["parent_id"] in ids for r in rows if r["parent_id"]) and all(r["main_parent"] in ids for r in rows if r["main_parent"])
    assert {r["chunk_type"] for r in rows if not r["parent_id"]} == {"parent", "table_summary"}
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 6, 7}


def test_a_text_keeps_what_is_no_table(made):
    _, rows = made
    own = [r["content"] for r in rows if r["doc_id"] == 1 and not r["table_id"]]
    assert own == ["Before it.\n\nAfter it."] * 2
    assert all(r["main_parent"] for r in rows if r["doc_id"] == 1 and r["table_id"]) and not any(r["main_parent"] for r in rows if r["doc_id"] == 3)


def test_rows_of_a_table(made):
    _, rows = made
    of = {r["chunk_id"]: r["content"] for r in rows if r["table_id"] == "1_table_0"}
    assert sorted(k for k in of if "_rows_" in k) == [f"1_table_0_rows_{k}_{k + 20}" for k in (0, 20, 40)]
    heads = [of[f"1_table_0_rows_{k}_{k + 20}"].split("\n")[0] for k in (0, 20, 40)]
    assert heads == ["Table rows 1 to 20 of 45", "Table rows 19 to 40 of 45", "Table rows 39 to 45 of 45"]
    assert of["1_table_0_rows_40_60"].endswith("Row 45:\n  name: b44\n  size: 44")
    summary = of["1_table_0_table_summary"]
    assert "45 rows × 2 columns\nFormat: pipes" in summary and "- size: string (45 non-null, 45 unique)" in summary and "Row 1: name=b0, size=0" in summary
    assert "Value distribution" not in of["1_table_0_column_size"] and "... and 35 more values" in of["1_table_0_column_size"]


def test_value_distribution_and_one_row(made):
    _, rows = made
    one = {r["chunk_id"]: r["content"] for r in rows if r["table_id"] == "3_table_0"}
    assert "Value distribution:\n  v: 1 (100.0%)\n\nSample values (first 1):\n  Row 1: v" in one["3_table_0_column_h1"]
    assert sorted(one) == ["3_table_0_column_h1", "3_table_0_column_h2", "3_table_0_rows_0_20", "3_table_0_table_summary"]


def test_no_documents(made):
    docs, _ = made
    assert table_driver.mixed_chunks(docs.where("false")).collect() == []
