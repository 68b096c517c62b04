"""Streams over files, run to their end, against the batch answer or a small automaton."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmill.operators import conversation
from quillmill.streaming import live

BASE = dt.datetime(2024, 1, 1)


def run(df, mode="append"):
    name = f"out_{abs(hash(df)) % 10**9}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def stream(spark, tmp_path):
    def make(batches, schema):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/b{k}")
        kind = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b*")

    return make


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


SCHEMA = "id long, ts timestamp, channel string"


def test_counters_equal_batch(spark, stream):
    rows = [(k, at(k), "c") for k in range(12)]
    s = stream([rows[:6], rows[6:], [(99, at(500), "c")]], SCHEMA)
    got = {r.window_start: r.n for r in run(live.counters(s, "channel")).collect()}
    assert got[at(0)] == 5 and got[at(5)] == 5 and got[at(10)] == 2


def test_unseen_documents(spark, stream):
    s = stream([[(1, at(0), "a"), (2, at(1), "b")], [(3, at(2), "a")]], "doc_id long, ts timestamp, text string")
    assert sorted(r.doc_id for r in run(live.unseen(s)).collect()) == [1, 2]


def test_sized_sessions_equal_batch(spark, stream):
    minutes = [*range(60), 100, 140, 141]
    rows = [(k, at(m), "c") for k, m in enumerate(minutes)]
    s = stream([rows[:20], rows[20:], [(999, at(2000), "other")], [(1000, at(2001), "other")]], SCHEMA)
    got = sorted(r.n_messages for r in run(live.sized_sessions(s, "channel")).where("channel = 'c'").collect())
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("user_id", F.lit("u"))
    want = sorted(r["count"] for r in conversation.sessions(batch).groupBy("session", "part").count().collect())
    assert got == want == [1, 2, 10, 25, 25]


def test_token_bucket(spark, stream):
    rows = [(k, BASE + dt.timedelta(seconds=s), "u") for k, s in enumerate([0] * 12 + [6, 6, 30])]
    got = {r.id: r.allowed for r in run(live.token_bucket(stream([rows], SCHEMA), "channel")).collect()}
    assert [got[k] for k in range(15)] == [True] * 10 + [False] * 2 + [True, False, True]


def test_breaker(spark, stream):
    calls = [(k, BASE + dt.timedelta(seconds=k), "s", True) for k in range(5)] + [(10, BASE + dt.timedelta(seconds=10), "s", False)] + [(20 + k, BASE + dt.timedelta(seconds=40 + k), "s", False) for k in range(3)]
    got = {r.id: r.state for r in run(live.breaker(stream([calls], SCHEMA + ", failed boolean"), "channel")).collect()}
    assert got == {0: "closed", 1: "closed", 2: "closed", 3: "closed", 4: "closed", 10: "open", 20: "half_open", 21: "half_open", 22: "closed"}


def test_gap_sessions(spark, stream):
    rows = [(k, at(m), "c") for k, m in enumerate([0, 10, 50])]
    found = run(live.gap_sessions(stream([rows, [(9, at(500), "d")], [(10, at(501), "d")]], SCHEMA), "channel"))
    assert sorted(r.n_messages for r in found.where("channel = 'c'").collect()) == [1, 2]
