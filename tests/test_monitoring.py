"""Counters with resets, histogram quantiles, hooks on streams, incremental ingestion, the report sink, SQL table functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillmill.functions import table_functions
from quillmill.operators import chunks, counters
from quillmill.sources import report_sink
from quillmill.streaming import hooks, ingest

BASE = dt.datetime(2024, 1, 1)
SAMPLES = "series string, ts timestamp, id long, value long"


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def test_increases_survive_resets_and_empty_slots(spark):
    r, rows, value, t = random.Random(3), [], 0, 0
    for k in range(400):
        t += r.choice([1, 7, 30, 900])
        value = r.randrange(3) if r.random() < 0.1 else value + r.randrange(5)
        rows.append((r.choice(["a", "b", None]), at(t), k, None if k % 50 == 7 else value))
    want, last = {}, {}
    for series, ts, _, v in rows:
        if v is not None:
            slot = (series, ts.timestamp() // 60)
            n, grown = want.get(slot, (0, 0))
            before = last.get(series)
            want[slot] = (n + 1, grown + (0 if before is None else v - before if v >= before else v))
            last[series] = v
    df = spark.createDataFrame(rows, SAMPLES)
    got = {(x.series, x.slot_start.timestamp() // 60): (x.n, x.increase) for x in counters.increases(df, ["series"], 60).collect()}
    assert got == want
    assert counters.increases(df.where("false"), ["series"], 60).count() == 0


def test_samples_are_ordered_within_slots_only(spark):
    df = spark.createDataFrame([("a", BASE, 1, 1)], SAMPLES)
    plan = counters.increases(df, ["series"], 60)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x and "lag(value" in x]
    assert windows and all("_slot" in x.split("[")[-2] for x in windows)


def test_quantile_is_interpolated(spark):
    r, bounds = random.Random(1), [1.0, 2.0, 5.0]
    values = {"few": [0.5], "wide": [r.uniform(0, 7) for _ in range(300)], "beyond": [9.0, 9.5], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "kind string, value double")
    got = {x.kind: x.p for x in counters.buckets(df, ["kind"], bounds).select("kind", counters.quantile(0.9, bounds).alias("p")).collect()}
    for kind, vs in values.items():
        vs = [v for v in vs if v is not None]
        below, low, want = 0, 0.0, bounds[-1] if vs else None
        for b in bounds:
            n = sum(v <= b for v in vs)
            if vs and n >= 0.9 * len(vs):
                want = low + (b - low) * ((0.9 * len(vs) - below) / (n - below) if n > below else 1.0)
                break
            below, low = n, b
        assert got[kind] == pytest.approx(want) if want is not None else got[kind] is None


@pytest.fixture
def stream(spark, tmp_path):
    def make(batches, schema):
        kind = spark.createDataFrame([], schema).schema
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*"), kind

    return make


def test_listener_sees_each_micro_batch(spark, stream):
    rows, _ = stream([[("a", at(k), k, 1) for k in range(5)], [("a", at(9), 9, 70)]], SAMPLES)
    heard = []
    alerts = hooks.Alerts("load", {"most": (10, 50), "n": (5, 100)}, [lambda *x: heard.append(x)])
    spark.streams.addListener(alerts)
    try:
        seen = hooks.observed(rows, "load", n=F.count("*"), most=F.max("value"))
        seen.writeStream.format("noop").trigger(availableNow=True).start().awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(alerts)
    assert sorted((b["n"], b["most"]) for _, b in alerts.batches if b["n"]) == [(1, 70), (5, 1)]
    assert sorted(heard) == [("load", "most", 70, "critical"), ("load", "n", 5, "warning")] and list(alerts.alerts) == heard


def test_tracked_calls_are_logged(spark):
    log = []

    @hooks.tracked("query", log)
    def numbers(spark, n):
        return spark.range(n)

    assert numbers(spark, 7)(lambda df: df.count()) == 7
    with pytest.raises(ZeroDivisionError):
        numbers(spark, 7)(lambda df: 1 / 0)
    assert [(k, f, n, e) for k, f, _, n, e in log] == [("query", "numbers", 7, None), ("query", "numbers", None, "ZeroDivisionError")]


def test_replayed_batches_change_nothing(spark, stream, tmp_path):
    batches = [[("a", at(1), 1, 10), ("a", at(2), 2, 20), (None, at(3), 3, 30)], [("b", at(5), 2, 21), ("b", at(1), 2, 19), ("b", None, 4, 1)], [("c", at(4), 5, 50)]]
    rows, kind = stream(batches, SAMPLES)
    path = f"file://{tmp_path}/table"
    assert ingest.high_water(spark, path) is None
    held = lambda: sorted(map(tuple, ingest.current(spark, path, kind).select("id", "series", "value").collect()))
    ingest.ingest(rows, path).awaitTermination(120)
    want = [(1, "a", 10), (2, "b", 21), (3, None, 30), (5, "c", 50)]
    assert held() == want and ingest.high_water(spark, path) == at(5)
    ingest.ingest(rows, path).awaitTermination(120)  # goes on where it was: nothing new
    assert held() == want
    ingest.ingest(rows, path, checkpoint=f"{tmp_path}/another").awaitTermination(120)  # every batch once more
    assert held() == want
    spark.createDataFrame([("x", at(99), 1, 0)], SAMPLES).write.parquet(f"{path}/rows/batch=77")  # a batch that was never finished
    assert held() == want
    assert [r.id for r in ingest.newer(spark.createDataFrame([("a", at(5), 8, 1), ("a", at(6), 9, 1)], SAMPLES), ingest.high_water(spark, path)).collect()] == [9]


def test_report_is_whole_or_absent(spark, tmp_path):
    path, kind = f"file://{tmp_path}/report", "metric string, value double"
    spark.dataSource.register(report_sink.ReportSink)
    rows = spark.range(40).select(F.concat(F.lit("m"), "id").alias("metric"), F.col("id").cast("double").alias("value")).repartition(4)
    save = lambda df, mode: df.write.format("report").option("path", path).mode(mode).save()
    broken = rows.withColumn("value", F.when(F.col("metric") == "m7", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        save(broken, "append")
    assert report_sink.index_of(path) is None
    with pytest.raises(FileNotFoundError):
        report_sink.read_report(spark, path, kind)
    save(rows, "append")
    whole = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, report_sink.read_report(spark, path, kind).collect())) == whole and report_sink.index_of(path)["rows"] == 40
    with pytest.raises(Exception, match="there is a report"):
        save(rows.limit(1), "append")
    assert sorted(map(tuple, report_sink.read_report(spark, path, kind).collect())) == whole
    save(rows.where("value < 2"), "overwrite")
    assert report_sink.read_report(spark, path, kind).count() == 2


def test_table_functions_equal_the_operators(spark):
    text = "One is here. Two! Three?\n\nFour | a\nFive | b\nsix\t1\nseven\t2\n" + "word " * 700
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", None)], "doc_id long, text string, extra string")
    table_functions.register(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = chunks.chunk(docs, "fixed", size=64, overlap=8).select("doc_id", F.col("parent_index"), "start_index", "content")
    assert rows(spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_fixed(d.text, 64, 8) c", docs=docs)) == rows(want)
    cut = spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM {docs}), 'text', 'paragraphs')", docs=docs)
    assert cut.columns == ["doc_id", "text", "extra", "chunk_index", "content"]
    assert rows(cut.select("doc_id", "chunk_index", "content")) == rows(chunks.chunk(docs, "paragraphs").select("doc_id", "parent_index", "content"))
    assert rows(spark.sql("SELECT d.doc_id, r.* FROM {docs} d, LATERAL table_regions(d.text) r", docs=docs)) == [(1, 2, 3, "pipes"), (1, 4, 5, "aligned")]
    for bad in ("'nothing', 'fixed'", "'text', 'unknown'"):
        with pytest.raises(Exception, match="chunk_table|how is one of"):
            spark.sql(f"SELECT * FROM chunk_table(TABLE(SELECT * FROM {{docs}}), {bad})", docs=docs).collect()
