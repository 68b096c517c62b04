"""Reports and texts made from other operators' rows: prompts, labels, long forms, judge answers, advice on cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_text(sources: DataFrame) -> DataFrame:
    """sources (query_id, rank, key, snippet) -> query_id, text: one block per source in rank order, and a guide."""
    block = F.concat(F.lit("["), F.coalesce("key", F.lit("?")), F.lit("]\n"), F.coalesce("snippet", F.lit("")))
    gathered = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("rows"))
    return gathered.select("query_id", F.concat(F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n"), F.lit("\n\nCite sources by their key in brackets.")).alias("text"))


def conversational_query(turns: DataFrame, back: int = 3) -> DataFrame:
    """Each user turn with what was said in the `back` turns before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    said = F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))
    lines = turns.withColumn("before", F.array_join(F.collect_list(said).over(w), "\n")).where("role = 'user'")
    return lines.select("conv_id", "turn", F.when(F.col("before") == "", F.coalesce("text", F.lit(""))).otherwise(F.concat("before", F.lit("\n"), F.coalesce("text", F.lit("")))).alias("query"))


def long_form(summary: DataFrame, kind: str, key: str) -> DataFrame:
    """metric_type, metric_name, key, value of every other column."""
    names = [c for c in summary.columns if c != key]
    return summary.select(F.lit(kind).alias("metric_type"), key, F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("double") for c in names]))).alias("metric_name", "value"))


def judged(answer: Column) -> tuple[Column, Column]:
    """The score of a judge's answer, kept to 0..1 and 0.5 without one, and its issues (lines that begin with a dash)."""
    number = F.try_to_number(F.nullif(F.regexp_extract(answer, "(?i)score:\\s*(-?[0-9]+(?:\\.[0-9]+)?)", 1), F.lit("")), F.lit("S999999.999999"))
    issues = F.regexp_extract_all(answer, F.lit("(?m)^-\\s*(.+)$"), 1)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number.cast("double"))), F.lit(0.5)), issues


def size_label(n: Column) -> Column:
    return F.when(n > 10_000, "large").when(n > 1000, "medium").otherwise("small")


def tier_label(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def cost_advice(usage: DataFrame, tokens: int = 2000, share: float = 0.5, repeats: int = 5) -> DataFrame:
    """One row: the model with more than `share` of the cost (if any), the last 100 requests' mean tokens and whether
    they are many, how many request ids repeat among the last 50 and whether a cache would help."""
    by_model = usage.groupBy("model").agg(F.sum("cost").alias("cost"))
    total = by_model.agg(F.sum("cost").alias("total"))
    top = by_model.crossJoin(F.broadcast(total)).where(F.col("cost") > share * F.col("total")).agg(F.max("model").alias("dominant_model"))
    newest = usage.orderBy(F.desc("ts"), F.desc("id"))
    mean = newest.limit(100).agg(F.round(F.avg("tokens"), 6).alias("mean_tokens"))
    again = newest.limit(50).groupBy("request_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    return top.crossJoin(mean).crossJoin(again).withColumn("many_tokens", F.col("mean_tokens") > tokens).withColumn("cache_helps", F.col("repeated") > repeats)


def snapshot_summary(snapshots: DataFrame, by: str) -> DataFrame:
    """Over each group's cumulative counters: what was added in the time, and the share of successes."""
    grown = lambda c: F.max(c) - F.min(c)
    return snapshots.groupBy(by).agg(F.count("*").alias("n"), grown("ok").alias("ok"), grown("failed").alias("failed"), F.round(F.try_divide(grown("ok"), grown("ok") + grown("failed")), 6).alias("success"))
