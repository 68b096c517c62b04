"""Folds split over ranges give what one loop gives, though one key spans many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import scan


@pytest.fixture(scope="module")
def calls(spark):
    r = random.Random(5)
    rows, t = [], 0
    for k in range(900):
        t += r.choice([0, 1, 3, 20, 200])
        rows.append((r.choice(["busy"] * 8 + ["calm", None]), t, k, r.choice([1, 1, 1, 2]), r.random() < 0.4))
    return rows, spark.createDataFrame(rows, "key string, s long, id long, weight int, failed boolean")


def looped(rows, fold):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        out |= dict(zip((r[2] for r in mine), fold(None, mine)[1], strict=True))
    return out


@pytest.mark.parametrize("fold", [scan.limiter(60, 3, 600, 12, 2, at=1), scan.breaker(3, 60, 40, 2, at=1, failed=4), scan.greedy_batches(40, 9, size=3)], ids=["limiter", "breaker", "batches"])
@pytest.mark.parametrize("per_range", [40, 10_000])
def test_folded_is_a_loop(calls, fold, per_range):
    rows, df = calls
    kind = "string" if isinstance(looped(rows, fold)[0], str) else "boolean"
    found = scan.folded(df, "key", ["s", "id"], fold, "got", kind, per_range)
    assert {r.id: r.got for r in found.collect()} == looped(rows, fold)


@pytest.mark.parametrize("per_range", [40, 10_000])
def test_bucket_is_a_loop(calls, per_range):
    rows, df = calls
    want = {}
    for key in {r[0] for r in rows}:
        tokens, last = 5, None
        for _, s, call, w, _ in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            tokens = tokens if last is None else min(5, tokens + s // 30 - last // 30)
            allowed = tokens >= w
            tokens, last = tokens - w * allowed, s
            want[call] = (allowed, tokens)
    found = scan.bucket_calls(df, "key", burst=5, seconds=30, per_range=per_range)
    assert {r.id: (r.allowed, r.tokens) for r in found.collect()} == want


def test_running_total_and_no_rows(spark, calls):
    _, df = calls
    got = {r.id: r.n for r in scan.running_total(df, ["id"], F.col("weight").cast("long"), "n", per_range=70).collect()}
    total = 0
    for r in sorted(calls[0], key=lambda r: r[2]):
        total += r[3]
        assert got[r[2]] == total
    none = df.where("false")
    assert scan.folded(none, "key", ["s", "id"], scan.limiter(1, 1, 1, 1, 1, at=1), "got", "boolean").count() == 0
    assert scan.bucket_calls(none, "key", 1, 1).count() == 0


def test_a_busy_key_runs_in_many_ranges(calls):
    _, df = calls
    parts = scan.in_ranges(df, ["key", "s", "id"], 40).where("key = 'busy'").select("range_no").distinct().count()
    assert parts > 10


def test_percentiles_of_groups(spark):
    import numpy as np

    from quillmill.operators import metrics

    r = random.Random(8)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([1.5, 2.0, r.uniform(0, 90)])) for _ in range(700)] + [("a", None), ("none", None), ("one", 7.0)]
    got = {x.g: x for x in metrics.latency(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert set(got) == {"a", "b", None, "none", "one"}
    for g, x in got.items():
        held = [v for k, v in rows if k == g and v is not None]
        assert x.n == sum(k == g for k, _ in rows)
        if held:
            want = [np.mean(held), *np.percentile(held, [50, 95, 99]), min(held), max(held)]
            assert [x.mean, x.median, x.p95, x.p99, x.min, x.max] == pytest.approx(want, abs=1e-6)
        else:
            assert x.mean is None and x.p95 is None


def test_counts_within_time_and_spikes(spark):
    import datetime as dt

    from quillmill.operators import metrics

    r, base = random.Random(4), dt.datetime(2024, 1, 1)
    rows, t = [], 0
    for k in range(600):
        t += r.choice([0, 1, 9, 60, 400])
        rows.append((k, r.choice(["busy"] * 9 + [None]), base + dt.timedelta(seconds=t), t, r.random() < 0.5, 100.0 if k % 97 == 0 else r.uniform(1, 5)))
    df = spark.createDataFrame(rows, "id long, who string, ts timestamp, s long, failed boolean, cost double").drop("s")
    near = lambda x, span, of: sum(y[1] == x[1] and x[3] - span <= y[3] <= x[3] for y in of)
    got = {x.id: (x.last_minute, x.last_hour, x.denied) for x in metrics.window_counts(df, "who", 3, 40).collect()}
    assert got == {x[0]: (m, h, m > 3 or h > 40) for x in rows for m, h in [(near(x, 60, rows), near(x, 3600, rows))]}
    failed = [x for x in rows if x[4]]
    assert {x.id: x.recent for x in metrics.breaker_trips(df, "who", 4, 90).collect()} == {x[0]: n for x in failed for n in [near(x, 90, failed)] if n >= 4}
    want = {}
    for who in ("busy", None):
        mine = [x for x in rows if x[1] == who]
        for k, x in enumerate(mine):
            mean = sum(y[5] for y in mine[max(0, k - 9) : k + 1]) / 10
            if k >= 9 and x[5] > 5 * mean:
                want[x[0]] = round(mean, 6)
    assert {x.id: x.mean for x in metrics.spikes(df, "who", 5.0, 10).collect()} == pytest.approx(want) and want


def test_means_are_added_in_order():
    """As a window of SQL adds doubles; a compensated sum is another one here, and decides whether ten times it is passed."""
    values = [0.1] * 10
    total = 0.0
    for v in values:
        total += v
    assert total != 1.0
    _, found = scan.last_mean(10, value=0)(None, [(v,) for v in values])
    assert found[-1] == total / 10


def test_spikes_round_as_sql_does(spark):
    """A mean whose digits end in half a millionth, but for the last bit."""
    import duckdb

    from quillmill.operators import metrics

    values = [0.425121, 0.282864, 0.775136, 0.994017, 0.365214, 0.247922, 0.120979, 0.062178, 0.888367, 50.271597]
    usage = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "provider string, id long, cost double").withColumn("ts", F.timestamp_seconds("id"))
    (row,) = metrics.spikes(usage, "provider", times=3.0).collect()
    want = duckdb.execute("SELECT round(avg(c), 6) FROM (SELECT unnest(?::DOUBLE[]) AS c)", [values]).fetchone()[0]
    assert row.mean == want


def test_bucket_of_many_keys_groups_ranges_only(spark):
    """Ten thousand keys of a few calls are no ten thousand groups; a null key, keys beyond 2^53 and calls without a time stay."""
    r = random.Random(9)
    rows = [(r.choice([None, 2**60 + r.randrange(3000)]), r.choice([None, r.randrange(900), r.randrange(900)]), k, r.choice([1, 2])) for k in range(9000)]
    df = spark.createDataFrame(rows, "key long, s long, id long, weight int")
    want = {}
    for key in {x[0] for x in rows}:
        tokens, last = 3, None
        for _, s, call, w in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is None, x[1] or 0, x[2])):
            tokens = 3 if s is None else tokens if last is None else min(3, tokens + s // 60 - last // 60)
            tokens, last, want[call] = tokens - w * (tokens >= w), s, (key, tokens >= w, tokens - w * (tokens >= w))
    found = scan.bucket_calls(df, "key", burst=3, seconds=60, per_range=700)
    assert {x.id: (x.key, x.allowed, x.tokens) for x in found.collect()} == want
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInArrow [range_no" in plan and "CoGroups" not in plan
