"""The index gathers its lists before anything is shuffled: a row for each term of a run of documents."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.operators import bm25, lexical_index

WORDS = "alpha beta gamma delta epsilon the for".split()


def some_docs(n):
    r = random.Random(3)
    return [(k, [r.choice(WORDS) for _ in range(r.choice([1, 2, 5, 40]))]) for k in range(n)]


@pytest.mark.parametrize("most", [1, 30, 1 << 21])
def test_runs_hold_every_place(monkeypatch, most):
    monkeypatch.setattr(lexical_index, "_RUN", most)
    docs = [*some_docs(60), (70, []), (71, ["alpha"]), (None, ["beta", "alpha", "beta"])]
    made = lambda part: pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([len(t) for _, t in part], pa.int32()), pa.array([t for _, t in part], pa.list_(pa.string()))], ["doc_id", "dl", "terms"])
    found, rows = {}, 0
    for b in lexical_index._runs(iter([made(docs[:25]), made([]), made(docs[25:])])):
        for r in b.to_pylist():
            rows += 1
            assert len(r["docs"]) == len(r["dls"]) == len(r["ends"]) and r["ends"][-1] == len(r["at"])
            for d, dl, begin, end in zip(r["docs"], r["dls"], [0, *r["ends"]], r["ends"]):
                assert (r["term"], d) not in found
                found[r["term"], d] = (dl, r["at"][begin:end])
    assert found == {(w, d): (len(t), [i for i, x in enumerate(t) if x == w]) for d, t in docs for w in set(t)}
    assert rows == len(WORDS) if most == 1 << 21 else rows > len(WORDS)


def test_postings_are_a_row_for_each_term_of_a_run(spark, tmp_path, monkeypatch):
    path, small = f"file://{tmp_path}/index", f"file://{tmp_path}/compact"
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in some_docs(200)], "doc_id long, text string").coalesce(1)
    lexical_index.build(docs, path, buckets=4, files=2)
    assert spark.read.parquet(f"{path}/postings").count() == len(WORDS)
    now = docs.where("doc_id % 3 <> 0")
    lexical_index.remove(spark, path, docs.where("doc_id % 3 = 0").select("doc_id"))
    monkeypatch.setattr(lexical_index, "_LIST", 20)  # several lists of a term
    lexical_index.compact(spark, path, small, files=2)
    lists = spark.read.parquet(f"{small}/postings")
    assert lists.count() > len(WORDS) and lists.agg(F.max(F.size("docs"))).first()[0] < 60
    of = lambda df: sorted((r.doc_id, *(round(r[c], 6) for c in ("bm25", "phrase", "proximity", "score"))) for r in df.collect())
    for asked in ('"the alpha" beta gamma', "delta epsilon"):
        want = of(bm25.scores(now, asked))
        assert of(lexical_index.scores(spark, path, asked)) == want == of(lexical_index.scores(spark, small, asked))
