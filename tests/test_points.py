"""Points of conversations: every child's parent is a point, places fit the text, short texts have none."""

from quillmill.operators import points


def test_points_are_linked_and_placed(spark):
    long = " ".join(f"word{k}" for k in range(2500))
    texts = spark.createDataFrame([("c", 1, 0, long), ("c", 1, 1, "short"), ("d", 2, 0, "x" * 120), ("d", 2, 1, None)], "channel string, session long, part long, text string")
    rows = points.channel_points(texts).collect()
    ids = {r.id for r in rows}
    assert len(ids) == len(rows) and {r.document_id for r in rows} == {"c|1|0", "d|2|0"}
    assert all((r.parent_id in ids) == (r.chunk_type == "child") for r in rows)
    assert all(long[r.start_index : r.end_index] == r.content for r in rows if r.channel == "c")
    assert {r.source for r in rows} == {"chat://c", "chat://d"} and sum(r.hierarchy_level == 0 for r in rows if r.channel == "c") > 1
    assert {tuple(r) for r in points.channel_points(texts.repartition(3)).collect()} == {tuple(r) for r in rows}
    assert points.channel_points(texts.where("false")).count() == 0
