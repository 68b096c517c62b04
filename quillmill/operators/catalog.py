"""Metadata catalogue and sources: upserts, purges, searches, backfill, audit trail, ranking, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the greatest version of each key; ties go to the changes. Aggregated before the shuffle, so a key with
    many versions is one row for each task."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = [c for c in table.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("row"))
    return last.select(key, "row.*")


def purge(table: DataFrame, condition: Column) -> DataFrame:
    """What is left; a row for which the condition is unknown stays."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def purge_preview(table: DataFrame, condition: Column) -> DataFrame:
    return table.agg(F.count("*").alias("n_all"), F.count_if(condition).alias("n_purged"), (F.count("*") - F.count_if(condition)).alias("n_left"))


def by_tags(table: DataFrame, column: str, wanted: list[str], every: bool = False) -> DataFrame:
    tags = F.array(*map(F.lit, wanted))
    return table.where(F.size(F.array_except(tags, column)) == 0 if every else F.arrays_overlap(column, tags))


def classify(path: Column, text: Column, is_chat: Column) -> Column:
    low, low_path = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    chat = F.when(low.rlike("question|help|how to|\\?"), "question_answer").when(low.rlike("announcement|update|release"), "announcement").otherwise("conversation")
    return F.when(is_chat, chat).when(F.contains(low_path, F.lit("readme")), "documentation").when(low_path.rlike("\\.py|\\.js|\\.java|\\.cpp"), "code").when(F.contains(low_path, F.lit("config")), "configuration").otherwise("other")


def source_type(path: Column) -> Column:
    ends = {".md": "markdown_file", ".pdf": "pdf_document", ".docx": "word_document", ".csv": "csv_data", ".json": "json_data", ".py": "code_file"}
    return F.when(F.startswith(path, F.lit("http")), "url_webpage").otherwise(F.coalesce(*[F.when(F.endswith(path, F.lit(e)), k) for e, k in ends.items()], F.lit("unknown")))


def missing(points: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Points without metadata: what a backfill has to make."""
    return points.join(metadata.select(key).distinct(), key, "left_anti")


def enriched(results: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    return results.join(metadata, key, "left")


def statistics(table: DataFrame) -> DataFrame:
    """Counts by category, source type and tier in one pass."""
    tier = F.when(F.col("quality") >= 0.7, "high").when(F.col("quality") >= 0.4, "medium").otherwise("low")
    sets = [[F.col("category")], [F.col("source_type")], [F.col("tier")], []]
    return table.withColumn("tier", tier).groupingSets(sets, "category", "source_type", "tier").agg(F.count("*").alias("n"))


def age_patterns(table: DataFrame, as_of: str) -> DataFrame:
    days = F.datediff(F.to_date(F.lit(as_of)), "created_at")
    age = F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 30, "month").otherwise("older")
    return table.groupBy(age.alias("age")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"))


def stage_times(history: DataFrame) -> DataFrame:
    """history (doc, stage, ts, failed) -> time since the stage before, error rate, by stage."""
    before = F.lag("ts").over(Window.partitionBy("doc").orderBy("ts", "stage"))
    timed = history.withColumn("seconds", (F.unix_micros("ts") - F.unix_micros(before)) / 1_000_000)
    return timed.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("seconds"), F.round(F.count_if("failed") / F.count("*"), 6).alias("error_rate"))


def current_status(events: DataFrame) -> DataFrame:
    return events.groupBy("task").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts"))


def ranked_sources(results: DataFrame, as_of: str, threshold: float, k: int = 5) -> DataFrame:
    """results (query_id, source_id, score, content, authority, created_at) -> each query's k best sources.

    Relevance is a source's best score; a threshold above all scores falls to a fifth of the best one, at least 0.01.
    Sources are ordered by 0.4 * combined top three scores + 0.3 * authority + 0.2 * freshness + 0.1 * number of chunks
    up to five. If none passes, the best k by relevance are taken."""
    # the three best scores of a source: each task drops what can't be among them before the shuffle
    own = Window.partitionBy("query_id", "source_id").orderBy(F.desc("score"))
    three = results.select("query_id", "source_id", "score", F.row_number().over(own).alias("n")).where("n <= 3")
    top = three.groupBy(F.col("query_id").alias("_q"), F.col("source_id").alias("_s")).agg(F.reverse(F.array_sort(F.collect_list("score"))).alias("top"))
    per = results.groupBy("query_id", "source_id").agg(
        F.max("score").alias("relevance"), F.count("*").alias("n_chunks"), F.substring(F.max_by("content", F.struct("score", "content")), 1, 300).alias("snippet"), F.max("authority").alias("authority"), F.max("created_at").alias("created_at")
    )
    per = per.join(top, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("source_id").eqNullSafe(F.col("_s"))).drop("_q", "_s")
    combined = F.coalesce(F.get("top", F.lit(0)), F.lit(0.0)) * 0.5 + F.coalesce(F.get("top", F.lit(1)), F.lit(0.0)) * 0.3 + F.coalesce(F.get("top", F.lit(2)), F.lit(0.0)) * 0.2
    fresh = F.coalesce(F.greatest(F.lit(0.1), 1 - F.datediff(F.to_date(F.lit(as_of)), "created_at") / 365), F.lit(0.5))
    scored = per.withColumn("score", F.round(combined * 0.4 + F.col("authority") * 0.3 + fresh * 0.2 + F.least(F.lit(1.0), F.col("n_chunks") / 5) * 0.1, 6))
    top = F.max("relevance").over(Window.partitionBy("query_id"))
    limit = F.when(F.lit(threshold) > top, F.greatest(F.lit(0.01), top * 0.2)).otherwise(threshold)
    passed = scored.withColumn("passes", F.col("relevance") >= limit)
    w = Window.partitionBy("query_id").orderBy(F.desc("passes"), F.desc("score"), "source_id")
    return passed.withColumn("any", F.max("passes").over(Window.partitionBy("query_id"))).withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col("passes") | ~F.col("any"))).drop("top", "any", "passes", "created_at")


def citation_key(source_id: Column, kind: Column, title: Column) -> Column:
    domain = F.replace(F.regexp_extract(source_id, "^https?://([^/]*)", 1), F.lit("www."), F.lit(""))
    name = F.substring(F.substring_index(F.substring_index(title, "/", -1), ".", 1), 1, 20)
    return F.when(kind == "web", domain).when(kind == "document", name).otherwise(F.concat(F.lit("src_"), F.substring(F.md5(source_id), 1, 8)))


def citations(answer: Column, valid: Column) -> dict[str, Column]:
    """What an answer cites in brackets, and how much of it is valid; no citation counts as all valid."""
    found = F.regexp_extract_all(answer, F.lit("\\[([^\\]]+)\\]"), 1)
    good = F.filter(found, lambda x: F.array_contains(valid, x))
    return {"n_citations": F.size(found), "n_valid": F.size(good), "accuracy": F.when(F.size(found) == 0, 1.0).otherwise(F.size(good) / F.size(found))}


def cache_key(query: Column, parameters: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lit("|"), parameters), 256), 1, 16)


def unexpired(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)
