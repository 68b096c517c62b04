"""Levels of long documents."""

import duckdb

from quillmill import plans


def text(n, words):
    """About n characters of words that occur from often to once in a while."""
    line = " ".join(f"{w} " * (len(words) - k) for k, w in enumerate(words))
    return (line + "\n") * (1 + n // len(line))


def test_near_links_of_long_documents_count(spark, tmp_path):
    """Documents of 10,000 characters and more that are near copies of each other; below, of shorter ones; or far too long for these."""
    names = [f"{a}{b}" for a in ("harbour", "station", "garden", "library", "market") for b in ("north", "south", "east", "west")]
    one, two, three = names, [*names[:-1], "otherword"], [f"un{x}" for x in names]
    rows = [(1, text(30_000, one)), (2, text(31_000, two)), (3, text(9_000, three)), (4, text(10_100, [*three[:-1], "elsewhere"])), (5, text(200_000, [*three[:-2], "fore", "after"])), (6, "short and alone"), (7, None)]
    assert len(rows[2][1]) < 10_000 <= len(rows[3][1])
    spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.level for r in plans.queries()["duplicate_levels"](spark, str(tmp_path)).collect()}
    assert found == {1: "near", 2: "near", 3: "near", 4: "near", 5: "semantic", 6: "none", 7: "none"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(con.sql(f"SELECT doc_id, level FROM ({plans.oracles()['duplicate_levels']})").fetchall()) == found
