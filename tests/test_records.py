"""Signatures against the standard library, deliveries, histories and the lifecycle of a collection."""

import hashlib
import hmac
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillmill.operators import duplicates, records


def test_signature_is_hmac(spark):
    bodies = ["", "a", '{"id": 1}', "é" * 200]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    for secret in ("k", "long" * 40):
        want = {b: "sha256=" + hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies}
        assert {r.body: r.s for r in df.select("body", records.signature(F.col("body"), secret).alias("s")).collect()} == want


def test_deliveries(spark):
    rows = [(1, 1, 500), (1, 2, 200), (1, 3, 200), (2, 1, 500), (2, 2, 404), (2, 3, 500), (2, 4, 200), (3, 1, 204)]
    found = {r.delivery_id: (r.n_attempts, r.status, r.waited_s) for r in records.delivery_log(spark.createDataFrame(rows, "delivery_id long, attempt int, code int")).collect()}
    assert found == {1: (2, "success", 1.0), 2: (3, "failed", 3.0), 3: (1, "success", 0.0)}


def test_throughput_needs_two_events(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    assert records.throughput(df, "ts").first() == (1, 0.0) and records.throughput(df.where("false"), "ts").first() == (0, 0.0)


def test_latest_versions_and_tiers(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (2, 1, None)], "id int, v int, score double")
    got = {r.id: r.t for r in records.latest_versions(df, "id", ["v"]).select("id", records.tier(F.col("score")).alias("t")).collect()}
    assert got == {1: "medium", 2: "low"}


def test_collection_lifecycle(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    name = "made_by_test_records"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{tmp_path}/t' AS SELECT 1 AS id")
    assert not records.create_collection(df, name)
    assert records.collection_info(spark, name) == {"exists": True, "count": 1, "columns": ["id"]}
    assert records.drop_collection(spark, name) and not records.drop_collection(spark, name)
    assert records.collection_info(spark, name)["exists"] is False


def test_set_search_weighs_items(spark):
    sets = spark.createDataFrame([(1, ["a", "b"], 3), (2, ["a", "c"], 2), (3, ["z"], 5)], "item long, terms array<string>, weight long")
    asked = spark.createDataFrame([(k, ["a", "b"]) for k in (1, 10, 11)], "query_id long, terms array<string>")
    for block in (1, 2, 100):
        found = duplicates.search_sets(sets, asked, 0.3, False, 5, block).groupBy("query_id").agg(F.collect_set("item").alias("i")).collect()
        assert {r.query_id: sorted(r.i) for r in found} == {1: [2], 10: [1, 2], 11: [1, 2]}
    one = duplicates.search_sets(sets.coalesce(1), asked.where("query_id = 10"), 0.3, False, 1).first()
    assert duplicates.search_sets(sets, asked.where("false"), 0.3, False, 1).count() == 0 == duplicates.search_sets(sets.where("false"), asked, 0.3, False, 1).count()
    assert "Join" not in duplicates.search_sets(sets, asked, 0.3, False, 5, 1)._jdf.queryExecution().executedPlan().toString()
    assert (one.item, one.n) == (1, 5)


def test_set_search_looks_at_common_terms_only(spark):
    """Of 40,000 queries that share nothing with a set none is counted, and runs of rows give what one run gives."""
    r = np.random.default_rng(3)
    lists = [sorted(set(r.integers(0, 60, n).tolist())) for n in r.integers(1, 12, 300)]
    asked = pa.table({"q": pa.array(range(300), pa.int64()), "h": pa.array(lists, pa.list_(pa.int64()))})
    rows = pa.record_batch({"i": pa.array(range(300), pa.int64()), "h": pa.array(lists, pa.list_(pa.int64())), "w": pa.array(range(1, 301), pa.int64())})
    alike = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
    for least, strict, k in ((0.2, False, 1), (1 / 3, True, 3), (0.0, True, 2)):
        passes = {q: sorted((-s, i) for i in range(300) if i != q for s in [alike(lists[q], lists[i])] if s and (s > least if strict else s >= least)) for q in range(300)}
        want = {(q, i, -s, sum(j + 1 for _, j in found)) for q, found in passes.items() for s, i in found[:k]}
        for most in (1, 500, 1 << 19):
            (out,) = duplicates._sharing(asked, least, strict, k, most)(iter([rows]))
            assert set(zip(*(c.to_pylist() for c in out.columns), strict=True)) == want, (least, most)
    apart = pa.table({"q": pa.array(range(40_000), pa.int64()), "h": pa.array([[1000 + x] for x in range(40_000)], pa.list_(pa.int64()))})
    tracemalloc.start()
    assert not sum(b.num_rows for b in duplicates._sharing(apart, 0.2, False, 1)(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # a count for each row and query would take 96 MB
