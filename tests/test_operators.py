"""Hand-made cases and properties of the operators that SQL doesn't reach."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import web
from quillmill.operators import bm25, catalog, chunks, conversation, fusion, metrics, vector


def scores(df, key="doc_id", value="score"):
    return {r[key]: r[value] for r in df.collect()}


@pytest.fixture(scope="module")
def fruit(spark):
    return spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "cherry date elder fig"), (4, "the fig"), (5, "  "), (6, None)], "doc_id long, text string")


def test_bm25_golden(fruit):
    # five is blank and is left out; four has one indexed term
    assert scores(bm25.search(fruit, "apple banana", proximity=False)) == {1: pytest.approx(1.102991, abs=1e-6)}
    assert scores(bm25.search(fruit, "elder")) == {3: pytest.approx(0.680312, abs=1e-6)}
    assert scores(bm25.search(fruit, "banana")) == {}
    assert scores(bm25.search(fruit, "")) == {}


def test_phrase_counts_overlapping_places(spark):
    docs = spark.createDataFrame([(1, "ab ab ab cd"), (2, "ab xy ab")], "doc_id long, text string")
    found = bm25.search(docs, '"ab ab"', 5).collect()
    assert [(r.doc_id, r.phrase) for r in found] == [(1, 4.0)]


def test_update_and_remove_documents(spark, fruit):
    index = bm25.indexed(fruit)
    changed = bm25.update_documents(index, spark.createDataFrame([(2, "kiwi"), (9, "lime")], "doc_id long, text string"))
    assert {r.doc_id: r.terms for r in changed.collect()}[2] == ["kiwi"]
    assert changed.count() == index.count() + 1
    assert bm25.remove_documents(changed, spark.createDataFrame([(9,)], "doc_id long")).count() == index.count()


def test_tokenizer_keeps_to_whole_words(spark):
    df = spark.createDataFrame([("été elle naïve a1b the_x don't AÉB ok",)], "text string")
    assert df.select(T.all_terms("text")).first()[0] == ["elle", "don", "ok"]


def test_fusion_golden(spark):
    lists = spark.createDataFrame([(1, "vector", 7, 0.9), (1, "vector", 8, 0.5), (1, "lexical", 8, 3.0), (1, "lexical", 7, 2.0)], "query_id int, list string, item_id int, score double")
    found = scores(fusion.reciprocal_rank(lists), "item_id")
    assert found[7] == found[8] == pytest.approx(1 / 61 + 1 / 62)
    equal = spark.createDataFrame([(1, "vector", k, 3.0) for k in range(3)], "query_id int, list string, item_id int, score double")
    assert [r.score for r in fusion.normalised(equal).collect()] == [1.0] * 3


def test_mmr_equals_greedy_choice(spark):
    rows = [(1, k, 1 - k / 20, sorted({f"w{(k * j) % 7}" for j in range(1, 5)})) for k in range(12)]
    found = vector.mmr(spark.createDataFrame(rows, "query_id long, doc_id long, score double, words array<string>"), 5)
    got = [r.doc_id for r in found.orderBy("mmr_rank").collect()]
    chosen = [0]
    while len(chosen) < 5:
        def value(k):
            alike = max(len(set(rows[k][3]) & set(rows[c][3])) / len(set(rows[k][3]) | set(rows[c][3])) for c in chosen)
            return round(0.7 * rows[k][2] + 0.3 * (1 - alike), 9)

        chosen.append(max((k for k in range(12) if k not in chosen), key=lambda k: (value(k), -k)))
    assert got == chosen


def test_cosine_of_empty_vector_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


TEXT = "abcdefg "


@pytest.mark.parametrize("n, lengths", [(1791, [1791]), (1793, [1793, 1]), (2048, [2047, 255]), (2049, [2047, 257])])
def test_fixed_chunk_golden(n, lengths):
    text = (TEXT * 300)[:n]
    assert [len(c) for _, c in chunks.fixed(text)] == [len(text[: lengths[0]].strip()), *[pytest.approx(x, abs=1) for x in lengths[1:]]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=600))
def test_fixed_chunks_end_and_cover(text):
    found = chunks.fixed(text, size=10, overlap=3)
    assert [s for s, _ in found] == sorted({s for s, _ in found})
    held = set()
    for start, chunk in found:
        at = text.index(chunk, start)
        held |= set(range(at, at + len(chunk)))
    assert all(k in held for k, c in enumerate(text) if not c.isspace())


def test_fixed_chunks_move_on_without_spaces():
    assert len(chunks.fixed("ab " * 700 + "z" * 1792)) < 20


def test_children_have_parents(spark):
    docs = spark.createDataFrame([(1, "word " * 3000), (2, ""), (3, None)], "doc_id long, text string")
    found = chunks.with_ids(chunks.chunk(docs, "hierarchical")).collect()
    parents = {r.chunk_id for r in found if r.level == 0}
    assert parents and all(r.parent_id in parents for r in found if r.level == 1)
    assert {r.doc_id for r in found} == {1}


def test_sessions_by_gap_and_size(spark):
    minute = 60
    at = [0, 1, 31, 62] + [100 + k for k in range(60)]  # gaps of 30 stay, of 31 part
    rows = [(k, m * minute, "u", "c") for k, m in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, s long, user_id string, channel string").withColumn("ts", F.timestamp_seconds("s"))
    sizes = sorted((r.session, r.part, r["count"]) for r in conversation.sessions(df).groupBy("session", "part").count().collect())
    assert sizes == [(1, 0, 3), (2, 0, 1), (3, 0, 25), (3, 1, 25), (3, 2, 10)]


def test_ir_metrics_golden(spark):
    runs = spark.createDataFrame([(1, 1, True, 2), (1, 2, False, 2), (1, 3, True, 2), (2, 1, False, 0)], "query_id int, rank int, relevant boolean, relevant_total int")
    r = metrics.retrieval_metrics(runs, 3).first()
    assert r.precision == pytest.approx((2 / 3 + 0) / 2, abs=1e-6)
    assert r.recall == 1.0 and r.mrr == 0.5
    assert r.ndcg == pytest.approx(0.919721 / 2, abs=1e-6)


def test_projection_golden(spark):
    usage = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 2.0), ("2024-01-03", 4.0)], "day string, cost double")
    r = metrics.projection(usage, 30).first()
    assert r.cost == 70.0 and r.low == pytest.approx(53.601463, abs=1e-5) and r.high == pytest.approx(86.398537, abs=1e-5)


def test_url_refusals(spark):
    urls = {"https://ok.org/a": None, "http://127.0.0.1/": "blocked host", "https://10.0.0.1/x": "address", "file:///etc": "protocol"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.why for r in df.select("url", web.url_refusal(F.col("url")).alias("why")).collect()} == urls


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, version int")
    once = catalog.upsert(old, new, "k", "version")
    assert sorted(map(tuple, catalog.upsert(once, new, "k", "version").collect())) == sorted(map(tuple, once.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]


def test_percentiles(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 10, 50)], "g string, v double")
    assert math.isclose(metrics.latency(df, ["g"], "v").first().p95, 42.0)
