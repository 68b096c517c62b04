"""Folds along an order, split over tasks: what each row gets depends on all rows of its key before it.

Rows are cut into ranges of the order (key, time, id), so a busy key spans many ranges. Two ways over the ranges:

- `folded`: any fold with a small state. All ranges run at once, each as if it began anew; then the ranges whose first key
  goes on from the range before run again from the state that this one ended in, as long as such a state changes. Folds that
  forget (windows, breakers, open batches) settle in a few rounds; a fold that never does takes a round for each range of its
  longest key. The result is always that of one loop over the rows.
- `bucket_calls`: token buckets by composition. A key's calls in a range map the tokens they begin with (0 to `burst`) to those
  they end with: a table of burst + 1 numbers. Tables are composed along a key's ranges, one small row each.

A range is one group of at most about `per_range` rows; states go from range to range in a table of one row for each.
"""

from __future__ import annotations

import functools
import operator
import pickle
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.storage import stored

#: fold(state or None, row tuples of one key in order) -> state, one output for each row.
Fold = Callable[[object, Iterable[tuple]], tuple[object, list]]


def in_ranges(df: DataFrame, order: list[str], per_range: int) -> DataFrame:
    """df with range_no: contiguous ranges in this order, written, so that it never changes."""
    n = max(1, -(-df.count() // per_range))
    return stored(df.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id().cast("long")), "ranges")


def _runs(keys: list) -> Iterable[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    begin = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[begin]:
            yield begin, k
            begin = k


def folded(df: DataFrame, key: str, order: list[str], fold: Fold, output: str, kind: str, per_range: int = 100_000) -> DataFrame:
    """df with the column `output` (of type `kind`): what fold gives for each row, in the order of `order` within `key`.
    fold gets the tuples of df's columns. Ties in `order` are broken by nothing: make it a total order. A null key is a key."""
    names, sort = df.columns, [key, *order]
    rows = in_ranges(df, sort, per_range)
    spark = df.sparkSession

    def run(frame: pd.DataFrame, state: bytes | None) -> tuple[list, bytes | None]:
        frame = frame.sort_values(sort, kind="stable", na_position="first")
        keys = [None if pd.isna(k) else k for k in frame[key].tolist()]
        told = pickle.loads(state) if state is not None else None  # (key, state) of the range before
        values, out, held = list(frame[names].itertuples(index=False, name=None)), [], None
        for a, b in _runs(keys):
            start = told[1] if told is not None and told[0] == keys[a] else None
            end, found = fold(start, values[a:b])
            out += found
            held = (keys[a], end)
        return [frame, out], pickle.dumps(held) if held is not None else state

    def ends(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"range_no": [], "ended": []})
        _, end = run(left, right["began"].iloc[0] if len(right) else None)
        return pd.DataFrame({"range_no": [left["range_no"].iloc[0]], "ended": [end]})

    def outputs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (frame, out), _ = run(left, right["began"].iloc[0] if len(right) else None) if len(left) else ([left, []], None)
        return frame[names].assign(**{output: pd.Series(out, index=frame.index, dtype=object)})

    def each(left: DataFrame, right: DataFrame, f, schema: str) -> DataFrame:
        return left.groupBy("range_no").cogroup(right.groupBy("range_no")).applyInPandas(f, schema)

    # a range goes on from the one before it only if they share a key
    edges = stored(rows.groupBy("range_no").agg(F.min(F.struct(F.col(key))).alias("low"), F.max(F.struct(F.col(key))).alias("high")), "edges")
    along = Window.orderBy("range_no")  # a row for each range
    goes_on = stored(edges.select("range_no", (F.col("low") == F.lag("high").over(along)).alias("goes_on")), "edges")
    began = spark.createDataFrame([], "range_no long, began binary")
    ended = stored(each(rows, began, ends, "range_no long, ended binary"), "ended")
    while True:
        before = F.lag("ended").over(along)
        now = stored(goes_on.join(ended, "range_no").select("range_no", F.when(F.col("goes_on"), before).alias("began")).where("began is not null"), "began")
        # the states that differ from those with which the ranges last ran
        moved = stored(now.join(began.withColumnRenamed("began", "had"), "range_no", "left").where(~F.col("began").eqNullSafe(F.col("had"))).select("range_no", "began"), "moved")
        if moved.isEmpty():
            break
        again = each(rows.join(moved.select("range_no"), "range_no", "left_semi"), moved, ends, "range_no long, ended binary")
        ended = stored(ended.join(moved, "range_no", "left_anti").unionByName(again), "ended")
        began = now
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return each(rows, began, outputs, f"{fields}, `{output}` {kind}")


def running_total(df: DataFrame, order: list[str], value: Column, name: str, per_range: int = 100_000) -> DataFrame:
    """df with `name`: the sum of value up to and with each row. Ranges add up their own rows and are moved by what comes
    before them, so no task holds all rows."""
    rows = in_ranges(df.withColumn(name, value), order, per_range)
    sums = rows.groupBy("range_no").agg(F.sum(name).alias("_own"))
    before = sums.select("range_no", (F.sum("_own").over(Window.orderBy("range_no")) - F.col("_own")).alias("_before"))  # a row for each range
    inner = F.sum(name).over(Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, inner).join(before, "range_no").withColumn(name, F.col(name) + F.col("_before")).drop("range_no", "_before")


def bucket_calls(calls: DataFrame, key: str, burst: int, seconds: int, per_range: int = 100_000) -> DataFrame:
    """calls (key, s: whole seconds, id, weight) -> key, id, allowed, tokens: whether its key's bucket held the call's
    weight in tokens, and what it holds after. A bucket begins full and gets a token at every multiple of `seconds`, up to
    `burst`; a denied call takes none. Calls of a second go by id; those without a time come last and find it full.

    A range is worked on as a whole, however many keys it has; tables are made for the keys that go over a range's edge only."""
    timed = calls.select(key, F.coalesce(F.col("s").cast("long"), F.lit(_LATE)).alias("s"), "id", F.col("weight").cast("long"))
    rows = in_ranges(timed, [key, "s", "id"], per_range)

    def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """Rows by key, time and id; which begin a key; the tokens that come before each."""
        code = pc.dictionary_encode(table.column(key).combine_chunks(), null_encoding="encode").indices
        table = table.append_column("_code", code)
        table = table.take(pc.sort_indices(table, [("_code", "ascending"), ("s", "ascending"), ("id", "ascending")]))
        code, s = table.column("_code").to_numpy(), table.column("s").to_numpy()
        return table, np.append(True, code[1:] != code[:-1])[: len(s)], _refills(s, np.append(s[:1], s[:-1]), burst, seconds)

    def tables(table: pa.Table) -> pa.Table:
        table, _, more = ordered(table)
        weight, tokens = table.column("weight").to_numpy(), np.arange(burst + 1)
        step = max(1, (1 << 20) // (burst + 1))
        for at in range(0, len(more), step):
            tokens = _composed(more[at : at + step], weight[at : at + step], burst)[tokens]
        first = table.slice(0, 1)
        ends = [pa.array([int(table.column("s")[k].as_py())]) for k in (0, -1)]
        return pa.Table.from_arrays([first.column(key), first.column("range_no"), *ends, pa.array([tokens.tolist()], pa.list_(pa.int64()))], [key, "range_no", "first", "last", "to"])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        out, tokens, last = [], burst, None
        for k, range_no, first, end, to in frame.sort_values("range_no")[[key, "range_no", "first", "last", "to"]].itertuples(index=False, name=None):
            tokens = tokens if last is None else min(burst, tokens + int(_refills(first, last, burst, seconds)))
            out.append((k, range_no, tokens))
            tokens, last = int(to[tokens]), end
        return pd.DataFrame(out, columns=["_key", "range_no", "_begins"])

    def answer(table: pa.Table) -> pa.Table:
        table, opens, more = ordered(table)
        allowed, held, tokens = [], [], burst
        begins = pc.fill_null(table.column("_begins"), burst).to_numpy()
        for new, start, gain, w in zip(opens.tolist(), begins.tolist(), more.tolist(), table.column("weight").to_pylist(), strict=True):
            tokens = start if new else min(burst, tokens + gain)
            ok = tokens >= w
            tokens -= w * ok
            allowed.append(ok)
            held.append(tokens)
        return pa.Table.from_arrays([table.column(key), table.column("id"), pa.array(allowed, pa.bool_()), pa.array(held, pa.int64())], [key, "id", "allowed", "tokens"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    # the keys that a range has in common with the one before or after it: two of a range at most
    along = Window.orderBy("range_no")  # a row for each range
    edges = stored(rows.groupBy("range_no").agg(F.min(F.struct(F.col(key))).alias("low"), F.max(F.struct(F.col(key))).alias("high")), "edges")
    met = edges.select("range_no", F.when(F.col("low") == F.lag("high").over(along), F.col("low")).alias("a"), F.when(F.col("high") == F.lead("low").over(along), F.col("high")).alias("b"))
    over = met.select("range_no", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))).alias("over")).select(F.col("range_no").alias("_range"), F.col(f"over.{key}").alias("_key"))
    over = stored(over, "edges")
    across = rows.join(over, (F.col("range_no") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    made = stored(across.groupBy("range_no", key).applyInArrow(tables, f"`{key}` {kind[key]}, range_no long, first long, last long, to array<long>"), "tables")
    starts = stored(made.groupBy(key).applyInPandas(chain, f"_key {kind[key]}, range_no long, _begins long"), "starts")
    begun = rows.join(starts.withColumnRenamed("range_no", "_range"), (F.col("range_no") == F.col("_range")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_range", "_key")
    return begun.groupBy("range_no").applyInArrow(answer, f"`{key}` {kind[key]}, id {kind['id']}, allowed boolean, tokens long")


#: The second of calls without one.
_LATE = 1 << 62


def _refills(s, before, burst: int, seconds: int):
    """The tokens that come from one call's second to the next call's, up to `burst`."""
    return np.where(np.equal(s, _LATE), burst, np.minimum(burst, s // seconds - before // seconds))


def _composed(more: np.ndarray, weight: np.ndarray, burst: int) -> np.ndarray:
    """What one call after another makes of 0 to `burst` tokens: neighbours' tables become one until one is left."""
    to = np.minimum(burst, np.arange(burst + 1)[None, :] + more[:, None])
    to = np.where(to >= weight[:, None], to - weight[:, None], to)
    while len(to) > 1:
        odd = to[len(to) // 2 * 2 :]
        to = np.concatenate([np.take_along_axis(to[1::2], to[: len(to) // 2 * 2 : 2], axis=1), odd])
    return to[0]


def limiter(short: int, per_short: int, long: int, per_long: int, burst: int, at: int) -> Fold:
    """A sliding-log limiter: a call is recorded unless `per_short` recorded ones lie within `short` seconds and no burst token
    is left, or `per_long` within `long` seconds. Burst tokens never come back; one is spent before the long limit is
    looked at. at: the place of the call's seconds. Output: allowed."""

    def fold(state, rows):
        recorded, tokens = state or ([], burst)
        recorded, out = list(recorded), []
        for row in rows:
            now = row[at]
            recorded = [t for t in recorded if t >= now - long]
            allowed = True
            if sum(t >= now - short for t in recorded) >= per_short:
                allowed = tokens > 0
                tokens -= allowed
            allowed = allowed and len(recorded) < per_long
            if allowed:
                recorded.append(now)
            out.append(bool(allowed))
        return (recorded, tokens), out

    return fold


def breaker(failures: int, window: int, recovery: int, successes: int, at: int, failed: int) -> Fold:
    """The state that each call meets: closed; open (it is rejected) after `failures` within `window` seconds; half_open
    once `recovery` seconds have passed, from which a failure opens it again and `successes` close it. at, failed: the places
    of the call's seconds and of its failure."""

    def fold(state, rows):
        name, since, good, recent = state or ("closed", 0, 0, [])
        recent, out = list(recent), []
        for row in rows:
            now = row[at]
            if name == "open" and now - since >= recovery:
                name = "half_open"
            out.append(name)
            if name == "open":
                continue
            if row[failed]:
                recent = [t for t in recent if t >= now - window] + [now]
                if name == "half_open" or len(recent) >= failures:
                    name, since, good, recent = "open", now, 0, []
            elif name == "half_open":
                good += 1
                if good >= successes:
                    name, good, recent = "closed", 0, []
        return (name, since, good, recent), out

    return fold


def greedy_batches(limit: float, most: int, size: int) -> Fold:
    """Whether a row opens a new batch: the open one has `most` rows, or would pass `limit` with this row's size (at that
    place). A row beyond the limit is a batch alone."""

    def fold(state, rows):
        total, n = state or (0, 0)
        out = []
        for row in rows:
            opens = n == 0 or n >= most or total + row[size] > limit
            total, n = (row[size], 1) if opens else (total + row[size], n + 1)
            out.append(opens)
        return (total, n), out

    return fold


def attempts(ok: int) -> Fold:
    """How many failures in a row each row ends, 0 for a success. ok: the place of a row's success."""

    def fold(state, rows):
        n, out = state or 0, []
        for row in rows:
            n = 0 if row[ok] else n + 1
            out.append(n)
        return n, out

    return fold


def last_mean(back: int, value: int) -> Fold:
    """The mean of the last `back` values (at that place of a row), null as long as there are fewer rows; null values count as rows
    only. Values are added one by one in their order, as a window of SQL does: Python's own `sum` makes good for rounding, so that
    a value of just so many times the mean would pass in the one and not in the other."""

    def fold(state, rows):
        held, out = list(state or []), []
        for row in rows:
            held = [*held, row[value]][-back:]
            there = [v for v in held if v is not None and v == v]
            out.append(functools.reduce(operator.add, there) / len(there) if len(held) == back and there else None)
        return held, out

    return fold
