"""Queries of answer assessment, relations between documents, savings and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import assessment, chunks, conversation
from quillmill.plans.analytics import USAGE, _usage
from quillmill.plans.chat import _messages
from quillmill.plans.chat import TWO_LEVELS
from quillmill.plans.common import SQL_SOURCE_TYPE, SQL_WORDS, sql_list, table, with_source_type
from quillmill.plans.content import _KEY

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_W = SQL_WORDS.format


@query(f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS response, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS q, role FROM conversations),
s AS (SELECT *, {_W('lower(q)')} AS a, {_W('lower(response)')} AS w FROM p WHERE role = 'assistant'),
d AS (SELECT *, list_distinct(w) AS ws, list_filter(list_distinct(a), lambda x: x NOT IN {sql_list(assessment.RELEVANCE_STOPWORDS)}) AS wanted, len(w) / nullif(len(list_filter(string_split(response, '.'), lambda x: regexp_matches(x, '\\S'))), 0) AS mean FROM s),
x AS (SELECT conv_id, turn, CASE WHEN response = '' OR len(a) = 0 THEN 0 ELSE least(1, len(list_intersect(ws, list_distinct(a))) / greatest(20, len(ws) * 0.3)) END::DOUBLE AS factual,
 CASE WHEN response = '' OR len(a) = 0 THEN 0 ELSE least(1, len(w) / greatest(20, len(a) * 3)) END::DOUBLE AS complete,
 CASE WHEN response = '' THEN 0 WHEN NOT contains(response, '.') THEN 0.8 WHEN mean BETWEEN 10 AND 25 THEN 1 ELSE coalesce(greatest(0.6, 1 - abs(mean - 17.5) / 20), 0.6) END::DOUBLE AS coherent,
 CASE WHEN regexp_matches(lower(response), 'source:|from:|according to|based on|reference:|doc:') THEN 1 ELSE 0.5 END::DOUBLE AS attributed,
 CASE WHEN response = '' OR len(a) = 0 THEN 0 WHEN len(wanted) = 0 THEN 1 ELSE len(list_intersect(wanted, ws)) / len(wanted) END::DOUBLE AS relevant,
 CASE WHEN response = '' THEN 0 WHEN len(w) < 50 THEN len(w) / 50 WHEN len(w) <= 200 THEN 1 ELSE greatest(0.3, 1 - (len(w) - 200) / 500) END::DOUBLE AS concise FROM d)
SELECT conv_id, turn, round(factual, 6) AS factual, round(complete, 6) AS complete, round(coherent, 6) AS coherent, attributed, round(relevant, 6) AS relevant, round(concise, 6) AS concise,
 round(factual * 0.25 + complete * 0.2 + coherent * 0.2 + attributed * 0.15 + relevant * 0.15 + concise * 0.05, 6) AS overall FROM x""")
def response_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = table(spark, sf_dir, "conversations").withColumn("q", F.coalesce(before, F.lit(""))).where("role = 'assistant'")
    scores = assessment.response_scores(F.col("q"), F.coalesce("text", F.lit("")), F.array("q"))
    return turns.select("conv_id", "turn", *[F.round(c, 6).alias(k) for k, c in scores.items()])


@query("""WITH s AS (SELECT event_id, (user_id % 10) / 10 AS h, (event_id % 7) / 7 AS c, user_id % 11 <> 0 AS ok, (event_id % 5) / 5 AS z, event_id % 6 AS n FROM events),
t AS (SELECT *, (1 - h) * 0.35 + c * 0.35 + CASE WHEN ok THEN 1.0 ELSE 0.3 END * 0.15 + z * 0.15 AS score FROM s)
SELECT event_id, round(score, 6) AS score, CASE WHEN round(score, 6) >= 0.8 THEN 'high' WHEN round(score, 6) >= 0.6 THEN 'medium' WHEN round(score, 6) >= 0.3 THEN 'low' ELSE 'very_low' END AS level,
 CASE WHEN NOT ok OR h > 0.7 THEN 'rejected' WHEN h > 0.4 OR c < 0.5 OR n > 3 THEN 'flagged' WHEN round(score, 6) < 0.4 THEN 'needs_review' ELSE 'approved' END AS verdict FROM t""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10 / 10).alias("h"), (F.col("event_id") % 7 / 7).alias("c"), (F.col("user_id") % 11 != 0).alias("ok"), (F.col("event_id") % 5 / 5).alias("z"), (F.col("event_id") % 6).alias("n"))
    s = s.withColumn("score", F.round(assessment.confidence(F.col("h"), F.col("c"), F.col("ok"), F.col("z")), 6))
    return s.select("event_id", "score", assessment.confidence_level(F.col("score")).alias("level"), assessment.verdict(F.col("h"), F.col("c"), F.col("ok"), F.col("n"), F.col("score")).alias("verdict"))


@query(f"""WITH d AS (SELECT doc_id, source, {SQL_SOURCE_TYPE} AS st FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY st) AS n, count(*) OVER (PARTITION BY source) AS m FROM d)
SELECT doc_id, array_to_string(list_filter([CASE WHEN n > 1 THEN 'source_type:' || st END, CASE WHEN m > 1 THEN 'source:' || source END], lambda x: x IS NOT NULL), ',') AS clusters FROM c""")
def content_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.clusters(with_source_type(table(spark, sf_dir, "documents")))


@query("""WITH f AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents), p AS (SELECT d.doc_id, f.doc_id AS related_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY f.doc_id) AS k FROM documents d JOIN f ON d.lang = f.lang AND d.doc_id <> f.doc_id AND f.n <= 11)
SELECT doc_id, related_id FROM p WHERE k <= 10""")
def related_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.related_by_category(table(spark, sf_dir, "documents"), "lang")


def with_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_source_type(table(spark, sf_dir, "documents")).withColumn("authority", F.when(F.col("source_type").isin("documentation", "official_website"), 0.9).otherwise(0.5))


@query(f"""WITH {_KEY}, d AS (SELECT s.doc_id, s.terms, {SQL_SOURCE_TYPE} IN ('documentation', 'official_website') AS strong FROM sets s JOIN documents d ON s.doc_id = d.doc_id),
c AS (SELECT terms, min(doc_id) AS id, count(*) FILTER (strong) AS w FROM d GROUP BY terms),
p AS (SELECT x.id, y.id AS o, y.w, round(len(list_intersect(x.terms, y.terms)) / (len(x.terms) + len(y.terms) - len(list_intersect(x.terms, y.terms))), 6) AS s FROM c x JOIN c y ON x.id <> y.id AND y.w > 0),
l AS (SELECT id, sum(w) AS n, arg_max(o, (s, -o)) AS nearest_id FROM p WHERE s >= 0.2 GROUP BY id),
m AS (SELECT d.doc_id, c.id AS class_id, coalesce(n, 0) + w - strong::INT AS n, nearest_id FROM d JOIN c ON d.terms = c.terms LEFT JOIN l ON c.id = l.id)
SELECT documents.doc_id, coalesce(class_id, documents.doc_id) AS class_id, coalesce(n, 0)::BIGINT AS n_connections, nearest_id FROM documents LEFT JOIN m ON documents.doc_id = m.doc_id""")
def authority_connections(spark: SparkSession, sf_dir: str, sets: DataFrame | None = None) -> DataFrame:
    return assessment.authority_connections(with_authority(spark, sf_dir), sets=sets)


@query(f"""WITH {USAGE}, r AS (SELECT model, sum(cost) AS c FROM u WHERE day > DATE '2024-01-30' - 7 GROUP BY 1), s AS (SELECT sum(c) / 7 AS daily, sum(c * CASE model WHEN 'click-0' THEN 0.8 WHEN 'view-1' THEN 0.73 ELSE 0 END) / 7 AS saved FROM r)
SELECT round(daily, 6) AS daily_cost, round(saved, 6) AS saved_per_day, round(saved * 30, 6) AS projected, round(100 * saved / greatest(daily, 0.01), 6) AS percent FROM s""")
def savings_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.savings(_usage(spark, sf_dir), {"click-0": 0.8, "view-1": 0.73}, F.to_date(F.lit("2024-01-30")))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT count(*) / 60 AS per_second FROM events, n WHERE epoch_us(ts) > epoch_us(now) - 60000000), t AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
SELECT (SELECT round(per_second, 6) FROM r) AS per_second, round(count(*) FILTER (user_id % 9 <> 0) / count(*), 6) AS success, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM t""")
def current_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 9 != 0).alias("ok"), F.col("value").alias("ms"))
    return assessment.current_load(calls)


@query("WITH t AS (SELECT event_id AS id, ts, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT id, status FROM t WHERE status = (SELECT min(event_type) FROM events)")
def delivery_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("status"))
    return assessment.delivery_history(log, 200, log.agg(F.min("status")).first()[0]).select("id", "status")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, ''))::INT AS content_length, len(" + _W("text") + ")::INT AS token_count FROM documents")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.functions import text as T

    text = T.text("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("content_hash"), F.length(text).alias("content_length"), F.size(T.words("text")).alias("token_count"))


@query("""WITH m AS (SELECT event_id AS id, ts, event_type AS channel FROM events), f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, id) > 1800000000 THEN 1 ELSE 0 END AS b FROM m),
s AS (SELECT *, 1 + sum(b) OVER (PARTITION BY channel ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM f)
SELECT id, channel, session::BIGINT AS session, ((row_number() OVER (PARTITION BY channel, session ORDER BY ts, id) - 1) // 20)::BIGINT AS part FROM s""")
def sessionize_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.sessions(_messages(spark, sf_dir), most=20).select("id", "channel", "session", "part")


def relevant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document asks for its own first ten children."""
    from pyspark.sql import Window

    held = chunks.with_ids(chunks.chunk(table(spark, sf_dir, "documents"), "hierarchical"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("parent_index", "child_index"))
    hits = held.where("level = 1").select(F.col("doc_id").alias("query_id"), "chunk_id", rank.alias("rank"))
    return assessment.relevant_context(hits, held)


QUERIES["relevant_context"] = relevant_context
ORACLES["relevant_context"] = f"""WITH RECURSIVE {TWO_LEVELS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS rank FROM gc)
SELECT doc_id AS query_id, rank::INT AS rank, substr(sha256(doc_id || '|1|' || p || '|' || i), 1, 16) AS chunk_id, CASE WHEN i = 0 THEN whole ELSE c END AS text FROM k WHERE rank <= 10"""
