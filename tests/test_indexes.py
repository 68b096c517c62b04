"""Persisted indexes answer like a scan over the same rows, and read only what a query asks for."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.operators import bm25, lexical_index, vector, vector_index

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the for with lambda mu nu xi omicron".split()


def text_of(k):
    r = random.Random(k)
    return " ".join(r.choice(WORDS) + r.choice(["", ".", ",", "!"]) for _ in range(r.randint(1, 60)))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, text_of(k)) for k in range(120)] + [(500, None), (501, "  "), (502, "12 34"), (503, "Alpha for beta " * 900)]
    return spark.createDataFrame(rows, "doc_id long, text string")


ASKED = ['"for alpha" beta gamma', "delta", "zeta zeta eta", "the", '"the for"', "unheard", "", '"kappa" theta iota mu']


def same(spark, path, docs, asked):
    of = lambda df: sorted((r.doc_id, *(round(r[c], 6) for c in ("bm25", "phrase", "proximity", "score"))) for r in df.collect())
    assert of(lexical_index.scores(spark, path, asked)) == of(bm25.scores(docs, asked)), asked


@pytest.fixture(scope="module")
def built(spark, docs, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/it"
    lexical_index.build(docs, path, buckets=8, files=2)
    return path


@pytest.mark.parametrize("asked", ASKED)
def test_built_index_scores_like_a_scan(spark, docs, built, asked):
    same(spark, built, docs, asked)


def test_a_search_reads_only_its_buckets(spark, built):
    plan = lexical_index.scores(spark, built, "delta")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(term" in plan or "EqualTo(term,delta)" in plan
    scans = [x for x in plan.split("\n") if "/postings" in x]
    assert scans and all("PartitionFilters: [bucket" in x or "bucket#" in x for x in scans)


def test_add_remove_and_compact(spark, docs, tmp_path):
    path, small = f"file://{tmp_path}/index", f"file://{tmp_path}/compact"
    lexical_index.build(docs, path, buckets=4, files=1)
    assert lexical_index.holds(spark, path, docs)
    new = spark.createDataFrame([(3, "alpha beta gamma news"), (900, "delta for alpha"), (901, None)], "doc_id long, text string")
    lexical_index.add(new, path, files=1)
    now = docs.join(new, "doc_id", "left_anti").unionByName(new)
    lexical_index.remove(spark, path, spark.createDataFrame([(5,), (5,), (7,), (12345,)], "doc_id long"))
    now = now.where("doc_id not in (5, 7)")
    for asked in ASKED[:3]:
        same(spark, path, now, asked)
    assert lexical_index.holds(spark, path, now) and not lexical_index.holds(spark, path, docs)
    counts = lambda df: {r.term: r.df for r in df.collect()}
    want = counts(bm25.term_stats(bm25.indexed(now)))
    assert counts(lexical_index.document_frequencies(spark, path)) == want
    lexical_index.compact(spark, path, small)
    same(spark, small, now, ASKED[0])
    assert counts(lexical_index.document_frequencies(spark, small)) == want


def test_an_unfinished_segment_is_not_read(spark, docs, built, tmp_path):
    path = f"file://{tmp_path}/index"
    lexical_index.build(docs, path, buckets=4, files=1)
    spark.createDataFrame([("delta", 7777, 1, 3, 5, [0, 1, 2], 0)], "term string, doc_id long, segment long, tf int, dl int, at array<int>, bucket int").write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    same(spark, path, docs, "delta")


def test_index_of_no_documents(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    lexical_index.build(docs.where("false"), path, buckets=4)
    assert lexical_index.scores(spark, path, "delta").count() == 0
    lexical_index.add(docs, path)
    same(spark, path, docs, "delta beta")


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + draw.normal(size=16) * 0.6).tolist()) for k in range(3000)]
    rows += [(5000 + k, [1.0] + [0.0] * 15) for k in range(1500)]  # one vector holds a third of the rows
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_vector_index_recall(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/vectors"
    cells = vector_index.fit(vectors, k=10, sample=2000)
    vector_index.build(vectors, cells, path)
    assert spark.read.parquet(path).count() == 4501  # all rows that have vectors of this length
    asked = vectors.where("vec_id % 20 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    found = {(r.query_id, r.rank): r.score for r in vector_index.search(spark, path, cells, asked, 10).collect()}
    true = {(r.query_id, r.rank): r.score for r in vector.top_k_batch(vectors.where("size(embedding) = 16"), asked, 10).collect()}
    assert found.keys() == true.keys()
    assert sum(found[k] == true[k] for k in true) >= 0.9 * len(true)
    plan = vector_index.search(spark, path, cells, asked, 10)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_probes_are_exact(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/vectors"
    cells = vector_index.fit(vectors, k=5, sample=500)
    vector_index.build(vectors, cells, path)
    asked = vectors.where("vec_id % 500 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))
    every = vector_index.search(spark, path, cells, asked, 5, skip_self=True, probes=len(cells.centres))
    assert rows(every) == rows(vector.top_k_batch(vectors.where("size(embedding) = 16"), asked, 5, skip_self=True))


def test_batch_search_in_blocks_joins_nothing(vectors):
    asked = vectors.where("vec_id % 100 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    held = vectors.where("size(embedding) = 16")
    whole, cut = (vector.top_k_batch(held, asked, 4, block=b) for b in (32_768, 7))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))
    assert rows(whole) == rows(cut)
    assert "Join" not in cut._jdf.queryExecution().executedPlan().toString()
    assert vector_index.fit(held.where(F.lit(False))) is None
