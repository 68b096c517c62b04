"""Embedding by a plugged-in function, a call for each batch, and by hashes."""

import math

from pyspark.sql import functions as F

from quillmill.operators import embedding, metrics


def test_a_batch_is_one_call(spark):
    rows = [(k, "w" * k if k % 7 else None, k // 10) for k in range(35)]
    batched = spark.createDataFrame(rows, "doc_id long, text string, batch_no long").repartition(4)
    found = {r.doc_id: r.embedding for r in embedding.embed(batched, lambda texts: [[float(len(t)), float(len(texts)), float(k)] for k, t in enumerate(texts)]).collect()}
    assert found == {k: [float(len(t or "")), 5.0 if b == 3 else 10.0, float(k % 10)] for k, t, b in rows}
    assert embedding.embed(batched.where("false"), lambda texts: [[0.0]] * len(texts)).count() == 0


def test_hashed_vectors_have_length_one_and_repeat(spark):
    docs = spark.createDataFrame([(1, "harbour boats harbour"), (2, "boats harbour harbour"), (3, None), (4, "the of 12"), (5, "lantern")], "doc_id long, text string")
    held = {}
    for r in embedding.hashed(docs, 64).collect():
        held.setdefault(r.doc_id, {})[r.dim] = r.value
    assert set(held) == {1, 2, 5} and held[1] == held[2] != held[5]
    assert all(math.isclose(sum(v * v for v in x.values()), 1) and all(0 <= d < 64 for d in x) for x in held.values())


def test_health_of_no_tasks_and_of_failures(spark):
    none = spark.createDataFrame([], "status string")
    errors = spark.createDataFrame([(k,) for k in range(12)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    row = metrics.health(none, errors.where("false")).first()
    assert (row.total_tasks, row.success_percent, row.health_score, row.recent_errors, row.healthy) == (0, 0.0, 1.0, 0, True)
    tasks = spark.createDataFrame([("completed",)] * 3 + [("failed",)] + [("queued",)], "status string")
    row = metrics.health(tasks, errors).first()
    assert (row.active_tasks, row.success_percent, row.health_score, row.recent_errors, row.healthy) == (1, 60.0, 0.6, 12, False)
