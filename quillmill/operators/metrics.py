"""Retrieval metrics, latency, usage cost, budgets, alerts, breakers and limits over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.scan import folded, last_mean, running_total
from quillmill.operators.storage import stored


def retrieval_metrics(runs: DataFrame, k: int) -> DataFrame:
    """runs (query_id, rank, relevant, relevant_total) -> one row: means over queries of precision (over what was
    retrieved), recall (1 where nothing is relevant), reciprocal rank and NDCG (ideal order of the retrieved)."""
    cut, hit = F.col("rank") <= k, F.col("relevant")
    gain = 1 / F.log2(F.col("rank") + 1)
    each = runs.groupBy("query_id").agg(
        F.count_if(cut).alias("n"), F.count_if(cut & hit).alias("hits"), F.first("relevant_total").alias("total"), F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.coalesce(F.sum(F.when(cut & hit, gain)), F.lit(0.0)).alias("dcg"), F.least(F.count_if(hit), F.lit(k)).cast("int").alias("ideal"),
    )
    best = F.aggregate(F.when(F.col("ideal") > 0, F.sequence(F.lit(1), F.col("ideal"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    scored = each.select(
        F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("hits", "total"), F.lit(1.0)).alias("r"), F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / best, F.lit(0.0)).alias("ndcg")
    )
    return scored.agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("mrr", "mrr"), ("ndcg", "ndcg"))])


def latency(facts: DataFrame, by: list[str], value: str) -> DataFrame:
    """by..., n, mean, median, p95, p99, min, max: exact percentiles, linear between values. Rows are counted by value first, and
    counts are added up over ranges of (by, value), so no group's values come to one task."""
    counts = stored(facts.groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_n")), "value_counts")
    there = F.col("_value").isNotNull()
    total = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(there, F.col("_n"))).alias("_all"), F.sum(F.col("_value") * F.col("_n")).alias("_sum"), F.min("_value").alias("min"), F.max("_value").alias("max"))
    total = stored(total.select(*[F.col(c).alias(f"_{c}") for c in by], "n", "_all", "_sum", "min", "max"), "totals")
    same = lambda mark: F.lit(True) if not by else reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}{c}")) for c in by])
    upto = stored(running_total(counts.where(there), [*by, "_value"], F.col("_n"), "_upto"), "running")
    start = upto.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"))
    placed = upto.join(start, same("__")).join(total, same("_")).withColumn("_high", F.col("_upto") - F.col("_start")).withColumn("_low", F.col("_high") - F.col("_n"))
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    at = lambda k: F.max(F.when((F.col("_low") <= k) & (k < F.col("_high")), F.col("_value")))
    place = lambda q: (F.col("_all") - 1) * q
    ends = [f(place(q)) for q in shares.values() for f in (F.floor, F.ceil)]
    found = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*[at(e).alias(f"_e{k}") for k, e in enumerate(ends)])
    rows = total.select(*[F.col(f"_{c}").alias(c) for c in by], "n", "_all", "_sum", "min", "max").join(found, same("__"), "left")
    between = lambda k, q: F.round(F.col(f"_e{2 * k}") + (F.col(f"_e{2 * k + 1}") - F.col(f"_e{2 * k}")) * (place(q) - F.floor(place(q))), 6)
    return rows.select(*by, "n", F.round(F.col("_sum") / F.col("_all"), 6).alias("mean"), *[between(k, q).alias(c) for k, (c, q) in enumerate(shares.items())], F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))


def cost_summary(usage: DataFrame) -> DataFrame:
    """provider, model and day totals and the grand total in one pass."""
    grouped = usage.groupingSets([[F.col("provider")], [F.col("model")], [F.col("day")], []], "provider", "model", "day")
    return grouped.agg(F.count("*").alias("n_requests"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.sum("cost") / F.count("*"), 6).alias("cost_per_request"), F.round(F.try_divide(F.sum("cost") * 1000, F.sum("tokens")), 6).alias("cost_per_1k"))


def cost_rollup(usage: DataFrame) -> DataFrame:
    return usage.rollup(F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("dom")).agg(F.round(F.sum("cost"), 6).alias("cost"))


def priced(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with its cost by prices per 1000 tokens; models without a price take
    the default one. The price table is a small dimension and Spark broadcasts it if its size allows."""
    joined = usage.join(prices, "model", "left")
    side = lambda n, k: F.col(f"{n}_tokens") / 1000 * F.coalesce(F.col(f"{n}_price"), F.lit(default[k]))
    return joined.withColumn("cost", side("input", 0) + side("output", 1))


def projection(usage: DataFrame, days: int, last: int = 7) -> DataFrame:
    """The mean of the last days' costs times `days`, with 1.96 standard errors; one day alone gives half to double."""
    daily = usage.groupBy("day").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    recent = daily.orderBy(F.desc("day")).limit(last)
    s = recent.agg(F.count("*").alias("k"), F.avg("cost").alias("m"), F.stddev_samp("cost").alias("sd"), F.avg("n").alias("r"))
    margin = 1.96 * F.col("sd") * F.sqrt(F.lit(float(days)))
    total = F.col("m") * days
    low, high = F.when(F.col("k") > 1, F.greatest(F.lit(0.0), total - margin)).otherwise(total * 0.5), F.when(F.col("k") > 1, total + margin).otherwise(total * 2)
    return s.select(F.round(total, 6).alias("cost"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.floor(F.col("r") * days).alias("requests"))


def first_over(usage: DataFrame, limit: float, period: str = "day") -> DataFrame:
    """When each period's running cost first passes the limit. Sums are made for every minute first."""
    minutes = usage.groupBy(period, F.date_trunc("minute", F.col("ts")).alias("minute")).agg(F.sum("cost").alias("cost"))
    running = F.sum("cost").over(Window.partitionBy(period).orderBy("minute"))
    return minutes.withColumn("running", F.round(running, 6)).where(F.col("running") > limit).groupBy(period).agg(F.min("minute").alias("minute"), F.min("running").alias("running"))


def spikes(usage: DataFrame, by: str, times: float = 5.0, back: int = 10) -> DataFrame:
    """Costs over `times` the mean of the last `back` ones of their group, themselves included. The last costs are handed from
    range to range, so a busy group is no single task."""
    rows = usage.select(F.col(by), F.unix_micros("ts").alias("_at"), "id", "cost")
    found = folded(rows, by, ["_at", "id"], last_mean(back, value=3), "mean", "double").where(F.col("cost") > times * F.col("mean"))
    # rounded as SQL's doubles are, by a whole number of millionths; F.round(mean, 6) looks at the decimal digits
    return found.select("id", by, "cost", (F.round(F.col("mean") * 1e6) / 1e6).alias("mean"))


def counted_within(calls: DataFrame, by: str, spans: dict[str, int]) -> DataFrame:
    """calls with a column for each span: how many calls of its group lie in the last so many seconds, its own second
    included. Calls are counted by second; a group is cut into slots as long as the longest span, and a slot is ordered
    together with the one before it only, so a busy group spans many tasks."""
    length = max(spans.values())
    marked = calls.withColumn("_s", F.unix_seconds("ts"))
    per = stored(marked.groupBy(F.col(by).alias("_by"), "_s").agg(F.count("*").alias("_n")), "seconds")
    slot = F.floor(F.col("_s") / length)
    both = per.select("*", slot.alias("_slot"), F.lit(True).alias("_own")).unionByName(per.select("*", (slot + 1).alias("_slot"), F.lit(False).alias("_own")))
    order = Window.partitionBy("_by", "_slot").orderBy("_s")
    sums = both.select("_by", "_s", "_own", *[F.sum("_n").over(order.rangeBetween(-n, 0)).alias(c) for c, n in spans.items()]).where("_own")
    there = sums.select("_by", F.col("_s").alias("_second"), *spans)
    return marked.join(there, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_s") == F.col("_second"))).drop("_by", "_second", "_s")


def threshold_alerts(values: DataFrame, thresholds: list[tuple[str, float, float]]) -> DataFrame:
    """values (one column per metric) -> metric, value, severity; critical before warning."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(w)).alias("warning"), F.lit(float(c)).alias("critical")) for m, w, c in thresholds])
    key = [c for c in values.columns if c not in {m for m, _, _ in thresholds}]
    each = values.select(*key, F.explode(cells).alias("x")).select(*key, "x.*")
    severity = F.when(F.col("value") >= F.col("critical"), "critical").when(F.col("value") >= F.col("warning"), "warning")
    return each.withColumn("severity", severity).where("severity is not null").drop("warning", "critical")


def breaker_trips(calls: DataFrame, by: str, failures: int = 5, seconds: int = 60) -> DataFrame:
    """Failed calls that are the n-th failure or later within the time before them."""
    return counted_within(calls.where("failed"), by, {"recent": seconds}).where(F.col("recent") >= failures)


def window_counts(calls: DataFrame, by: str, minute: int, hour: int) -> DataFrame:
    """For each call the calls of its group in the last minute and hour, and whether a limit denies it."""
    found = counted_within(calls, by, {"last_minute": 60, "last_hour": 3600})
    return found.withColumn("denied", (F.col("last_minute") > minute) | (F.col("last_hour") > hour))


def error_cube(errors: DataFrame) -> DataFrame:
    return errors.cube("type", "severity").agg(F.count("*").alias("n"))


def classify_error(kind: Column, message: Column, status: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("rate limit")) | F.contains(low, F.lit("too many requests")) | (status == 429), "rate_limit")
        .when(kind.isin("ConnectionError", "TimeoutError"), "network")
        .when(kind == "FileNotFoundError", "file_not_found")
        .when(kind == "PermissionError", "permission")
        .when(low.rlike("parse|decode|invalid format"), "parsing")
        .otherwise("unknown")
    )


def retry_delay(attempt: Column, initial: float = 1.0, base: float = 2.0, most: float = 60.0) -> Column:
    """Without jitter."""
    return F.least(initial * F.pow(F.lit(base), attempt - 1), F.lit(most))


def delivery_stats(deliveries: DataFrame) -> DataFrame:
    """n, success percent, mean duration of those that have one."""
    done = F.count_if(F.col("status") == "success")
    return deliveries.agg(F.count("*").alias("n"), F.round(100 * done / F.greatest(F.count("*"), F.lit(1)), 6).alias("success_percent"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def health(tasks: DataFrame, errors: DataFrame, most_errors: int = 10) -> DataFrame:
    """tasks (status), errors (ts) -> one row: tasks by status, the share of successes in percent, a score that falls by twice the
    share of failures, the errors of the newest hour, and whether all is well."""
    n, of = F.count("*"), lambda s: F.count_if(F.col("status") == s)
    counted = tasks.agg(n.alias("total_tasks"), of("completed").alias("completed_tasks"), of("failed").alias("failed_tasks"), F.count_if(~F.col("status").isin("completed", "failed")).alias("active_tasks"))
    newest = errors.agg(F.max(F.unix_micros("ts")).alias("now"))  # one row
    recent = errors.join(F.broadcast(newest)).agg(F.count_if(F.unix_micros("ts") > F.col("now") - 3_600_000_000).alias("recent_errors"))
    rate = F.coalesce(F.try_divide("failed_tasks", "total_tasks"), F.lit(0.0))
    rows = counted.crossJoin(recent)  # one row each
    rows = rows.withColumn("success_percent", F.round(F.coalesce(F.try_divide(F.col("completed_tasks") * 100, "total_tasks"), F.lit(0.0)), 6)).withColumn("health_score", F.round(F.greatest(F.lit(0.0), 1 - 2 * rate), 6))
    return rows.withColumn("healthy", (F.col("health_score") > 0.5) & (F.col("recent_errors") < most_errors))
