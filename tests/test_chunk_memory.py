"""Chunkers hold a few texts' chunks at a time, whatever the size of a batch."""

from quillmill.operators import chunks, sections


def _rows_at_once(monkeypatch, spark, make):
    """The most rows that a batch of the function behind mapInArrow has, given one batch of 1,000 texts."""
    import pyarrow as pa
    from pyspark.sql import DataFrame

    held = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: held.append(f) or self, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: held.append(f) or self, raising=False)
    make(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(["h\nsome words here"] * 1000)], ["doc_id", "text"])
    made = list(held[0](iter([batch])))
    assert sum(b.num_rows for b in made) >= 1000
    return max(b.num_rows for b in made)


def test_batches_of_chunks_are_small(monkeypatch, spark):
    for make in (lambda d: chunks.chunk(d, "hierarchical"), lambda d: sections.explode_chunks(d, "csv"), lambda d: sections.explode_chunks(d, "python")):
        assert _rows_at_once(monkeypatch, spark, make) <= 200
