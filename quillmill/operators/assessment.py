"""Answers' quality and confidence, relations between documents, savings, current load, and the stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import bm25, duplicates
from quillmill.operators.storage import stored

# Stop words of the relevance score and the marks of an attribution.
RELEVANCE_STOPWORDS = "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should".split()
ATTRIBUTIONS = ["source:", "from:", "according to", "based on", "reference:", "doc:"]


def response_scores(query: Column, response: Column, sources: Column) -> dict[str, Column]:
    """Six heuristics and their weighted mean; `sources` is an array of the retrieved texts."""
    asked, said = T.words(F.lower(query)), T.words(F.lower(response))
    said_set, held = F.array_distinct(said), F.array_distinct(F.flatten(F.transform(sources, lambda s: T.words(F.lower(s)))))
    n, none = F.size(said), F.length(response) == 0
    stop = F.array(*map(F.lit, RELEVANCE_STOPWORDS))
    wanted = F.array_except(asked, stop)
    pieces = F.filter(F.split(response, "\\."), lambda s: F.size(T.words(s)) > 0)
    mean = F.try_divide(n, F.size(pieces))
    factual = F.when(none | (F.size(held) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(said_set, held)) / F.greatest(F.lit(20.0), F.size(said_set) * 0.3)))
    complete = F.when(none | (F.size(asked) == 0), 0.0).otherwise(F.least(F.lit(1.0), n / F.greatest(F.lit(20), F.size(asked) * 3)))
    coherent = F.when(none, 0.0).when(~F.contains(response, F.lit(".")), 0.8).when(mean.between(10, 25), 1.0).otherwise(F.coalesce(F.greatest(F.lit(0.6), 1 - F.abs(mean - 17.5) / 20), F.lit(0.6)))
    marked = F.greatest(*[F.contains(F.lower(response), F.lit(a)) for a in ATTRIBUTIONS])
    attributed = F.when((F.size(sources) == 0) | marked, 1.0).otherwise(0.5)
    relevant = F.when(none | (F.size(asked) == 0), 0.0).when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, said_set)) / F.size(wanted))
    concise = F.when(none, 0.0).when(n < 50, n / 50).when(n <= 200, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (n - 200) / 500))
    parts = {"factual": (factual, 0.25), "complete": (complete, 0.2), "coherent": (coherent, 0.2), "attributed": (attributed, 0.15), "relevant": (relevant, 0.15), "concise": (concise, 0.05)}
    return {k: c for k, (c, _) in parts.items()} | {"overall": sum((c * w for c, w in parts.values()), F.lit(0.0))}


def confidence(hallucination: Column, consistency: Column, compliant: Column, citation: Column) -> Column:
    return (1 - hallucination) * 0.35 + consistency * 0.35 + F.when(compliant, 1.0).otherwise(0.3) * 0.15 + citation * 0.15


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "medium").when(score >= 0.3, "low").otherwise("very_low")


def verdict(hallucination: Column, consistency: Column, compliant: Column, n_issues: Column, score: Column) -> Column:
    return F.when(~compliant | (hallucination > 0.7), "rejected").when((hallucination > 0.4) | (consistency < 0.5) | (n_issues > 3), "flagged").when(score < 0.4, "needs_review").otherwise("approved")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, clusters: its source type and its source, each where another document shares it."""
    shared = lambda c: docs.groupBy(c).count().where("count > 1").select(c, F.lit(True).alias(f"_{c}"))
    joined = docs.select("doc_id", "source_type", "source").join(shared("source_type"), "source_type", "left").join(shared("source"), "source", "left")
    return joined.select("doc_id", F.array_join(F.array_compact(F.array(F.when(F.col("_source_type"), F.concat(F.lit("source_type:"), "source_type")), F.when(F.col("_source"), F.concat(F.lit("source:"), "source")))), ",").alias("clusters"))


def related_by_category(docs: DataFrame, category: str, k: int = 10) -> DataFrame:
    """doc_id, related_id: the first k other documents of the category. Each category's first k + 1 are found once and
    joined, so its size doesn't count twice."""
    w = Window.partitionBy(category).orderBy("doc_id")
    first = docs.select(category, F.col("doc_id").alias("related_id"), F.row_number().over(w).alias("n")).where(F.col("n") <= k + 1)
    joined = docs.select("doc_id", category).join(first.groupBy(category).agg(F.array_sort(F.collect_list("related_id")).alias("ids")), category)
    return joined.select("doc_id", F.explode(F.slice(F.filter("ids", lambda x: x != F.col("doc_id")), 1, k)).alias("related_id"))


def authority_connections(docs: DataFrame, threshold: float = 0.2, least: float = 0.8, sets: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, authority) -> doc_id, class_id, n_connections, nearest_id of every document. A class is the
    documents of equal key terms, named by its smallest doc_id; n_connections is how many other documents of more authority
    than `least` are at least this similar, nearest_id the most similar other class that holds such a document. Classes are
    compared, in blocks, so copies cost nothing; a document without key terms is its own class without connections. sets: the stored
    term sets with authority, where another operator takes them too."""
    sets = stored(duplicates.term_sets(docs, "authority"), "term_sets") if sets is None else sets
    strong = F.coalesce(F.col("authority") > least, F.lit(False))
    classes = stored(sets.groupBy("terms").agg(F.min("doc_id").alias("item"), F.count_if(strong).alias("weight")), "classes")
    found = duplicates.search_sets(classes.where("weight > 0"), classes.select(F.col("item").alias("query_id"), "terms"), threshold, False, 1)
    best = F.max_by("item", F.struct("similarity", (-F.col("item")).alias("_")))
    links = found.groupBy(F.col("query_id").alias("item")).agg(F.sum("n").alias("others"), best.alias("nearest_id"))
    linked = classes.join(links, "item", "left")
    members = sets.join(linked, "terms").select("doc_id", F.col("item").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("weight") - strong.cast("int")).alias("n"), "nearest_id")
    rows = docs.select("doc_id").join(members, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_connections"), "nearest_id")


def savings(usage: DataFrame, factors: dict[str, float], as_of: Column, days: int = 30, last: int = 7) -> DataFrame:
    """What changing models would save, from the last days' mean cost; models without a factor of their own save half."""
    recent = usage.where(F.col("day") > F.date_sub(as_of, last))
    factor = F.coalesce(*[F.when(F.col("model") == m, f) for m, f in factors.items()], F.lit(0.0))
    s = recent.groupBy("model").agg(F.sum("cost").alias("cost")).agg((F.sum("cost") / last).alias("daily"), (F.sum(F.col("cost") * factor) / last).alias("saved"))
    return s.select(F.round("daily", 6).alias("daily_cost"), F.round("saved", 6).alias("saved_per_day"), F.round(F.col("saved") * days, 6).alias("projected"), F.round(100 * F.col("saved") / F.greatest("daily", F.lit(0.01)), 6).alias("percent"))


def current_load(calls: DataFrame, seconds: int = 60, last: int = 1000) -> DataFrame:
    """Calls a second over the time before the newest call, and success and percentiles over the last calls."""
    newest = calls.agg(F.max("ts").alias("now"))
    recent = calls.join(F.broadcast(newest)).where(F.unix_micros("ts") > F.unix_micros("now") - seconds * 1_000_000).agg((F.count("*") / seconds).alias("per_second"))
    tail = calls.orderBy(F.desc("ts"), F.desc("id")).limit(last)
    shown = tail.agg(F.round(F.try_divide(F.count_if("ok"), F.count("*")), 6).alias("success"), F.round(F.percentile("ms", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95"))
    return recent.crossJoin(shown).withColumn("per_second", F.round("per_second", 6))


def delivery_history(log: DataFrame, limit: int, status: str) -> DataFrame:
    """The newest `limit` deliveries, of which those of this status."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit).where(F.col("status") == status)


def relevant_context(hits: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """hits (query_id, chunk_id, rank): each query's first k children; the first child of a parent brings the parent's
    text, later ones only their own."""
    children = hits.where(F.col("rank") <= k).join(chunks.where("level = 1").select("chunk_id", "parent_id", "content"), "chunk_id")
    parents = chunks.where("level = 0").select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank")) == 1
    return children.join(parents, "parent_id", "left").select("query_id", "rank", "chunk_id", F.when(first, F.coalesce("parent_content", "content")).otherwise(F.col("content")).alias("text"))


def save_index(docs: DataFrame, path: str) -> None:
    """The index as a table, and beside it the documents' checksum."""
    bm25.indexed(docs).write.mode("overwrite").parquet(f"{path}/index")
    bm25.checksum(docs).withColumn("version", F.lit("1.0")).write.mode("overwrite").parquet(f"{path}/meta")


def load_index(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame | None:
    """The stored index if it is of this version and these documents."""
    meta, now = spark.read.parquet(f"{path}/meta").first(), bm25.checksum(docs).first()
    valid = meta.version == "1.0" and (meta.n_docs, meta.checksum) == (now.n_docs, now.checksum)
    return spark.read.parquet(f"{path}/index") if valid else None
