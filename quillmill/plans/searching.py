"""Queries of metadata filters, histories, deliveries and compositions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import bm25, chunks, duplicates, records
from quillmill.operators.storage import stored
from quillmill.plans import chat, content, reporting, retrieval
from quillmill.plans.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


START, END = "2024-01-05 00:00:00", "2024-01-12 12:00:00"
_BETWEEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query(f"SELECT event_id, event_type FROM events WHERE {_BETWEEN}")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.in_date_range(table(spark, sf_dir, "events"), "ts", START, END).select("event_id", "event_type")


_MAYBE = "CASE WHEN event_id % 7 <> 0 THEN ts END"


@query(f"WITH e AS (SELECT event_id, event_type, {_MAYBE} AS ts FROM events) SELECT event_id, event_type FROM e WHERE ts IS NULL OR {_BETWEEN}")
def date_range_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a time pass."""
    hits = table(spark, sf_dir, "events").withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    return records.in_date_range(hits, "ts", START, END, keep_missing=True).select("event_id", "event_type")


@query(f"WITH s AS ({retrieval.TOPK.replace('LIMIT 10', 'LIMIT 20')}) SELECT s.doc_id, s.score FROM s JOIN documents d ON s.doc_id = d.doc_id WHERE d.lang = 'en' AND d.source IS NOT NULL ORDER BY s.score DESC, s.doc_id LIMIT 10")
def lexical_filter_after_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetches twice the lexical hits, then filters by their documents' metadata."""
    docs = table(spark, sf_dir, "documents")
    hits = bm25.search(docs, retrieval.ASKED, 20, phrases=False, proximity=False).select("doc_id", F.round("score", 6).alias("score"))
    kept = hits.join(docs.select("doc_id", "lang", "source"), "doc_id").where("lang = 'en' AND source IS NOT NULL")
    return kept.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


@query("SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def source_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", "lang")


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def category_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source")


@query(f"SELECT doc_id, overall FROM ({content.ORACLES['store_quality']}) WHERE overall BETWEEN 0.4 AND 0.7")
def quality_range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.store_quality(spark, sf_dir).where("overall BETWEEN 0.4 AND 0.7").select("doc_id", "overall")


@query("""WITH r AS (SELECT epoch_us(ts) AS us FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) FROM events) - 3600000000)
SELECT count(*) AS n, round(coalesce(CASE WHEN count(*) > 1 AND max(us) > min(us) THEN count(*) / ((max(us) - min(us)) / 1000000) END, 0), 6) AS per_second FROM r""")
def recent_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.throughput(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts").withColumn("per_second", F.round("per_second", 6))


@query(f"SELECT count(*) AS n, round(avg(overall), 5) AS overall, round(avg(readability), 5) AS readability FROM ({content.ORACLES['store_quality']})")
def mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.mean_of_each(content.store_quality(spark, sf_dir), ["overall", "readability"])
    return found.select("n", F.round("overall", 5).alias("overall"), F.round("readability", 5).alias("readability"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record_id"), "ts", F.col("event_type").alias("stage"), "event_id", "value")


@query("SELECT user_id AS record_id, epoch_us(ts) AS at, event_type AS stage FROM events WHERE user_id IN (1, 2, 3)")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.audit_trail(_history(spark, sf_dir), [1, 2, 3]).select("record_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "stage")


@query("""WITH l AS (SELECT user_id AS record_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1)
SELECT record_id, round(value / 100, 6) AS quality, CASE WHEN round(value / 100, 6) >= 0.8 THEN 'high' WHEN round(value / 100, 6) >= 0.5 THEN 'medium' ELSE 'low' END AS tier FROM l""")
def tier_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of each record after its newest quality update."""
    newest = records.latest_versions(_history(spark, sf_dir).select("record_id", "ts", "event_id", "value"), "record_id", ["ts", "event_id"])
    quality = F.round(F.col("value") / 100, 6)
    return newest.select("record_id", quality.alias("quality"), records.tier(quality).alias("tier"))


_SECRET = "quill-secret"
_PADS = ["".join(f"\\x{b ^ pad:02X}" for b in _SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"WITH b AS (SELECT event_id, '{{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}}' AS body FROM events) SELECT event_id, 'sha256=' || sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(body)))) AS signature FROM b")
def delivery_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", records.signature(body, _SECRET).alias("signature"))


@query("""WITH a AS (SELECT user_id AS delivery_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, CASE WHEN value > 60 THEN 200 ELSE 500 END AS code FROM events),
t AS (SELECT delivery_id, min(attempt) FILTER (code = 200) AS good, max(attempt) AS last FROM a WHERE attempt <= 3 GROUP BY 1)
SELECT delivery_id, coalesce(good, last)::INT AS n_attempts, CASE WHEN good IS NULL THEN 'failed' ELSE 'success' END AS status, (2 ** (coalesce(good, last) - 1) - 1)::DOUBLE AS waited_s FROM t""")
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    attempts = table(spark, sf_dir, "events").select(F.col("user_id").alias("delivery_id"), F.row_number().over(order).alias("attempt"), F.when(F.col("value") > 60, 200).otherwise(500).alias("code"))
    return records.delivery_log(attempts)


@query(f"""WITH e AS ({content.ORACLES['exact_duplicates']}), n AS ({content.ORACLES['near_duplicates'].replace('a.n < 10000 AND ', '')}), s AS ({reporting.ORACLES['semantic_duplicates']})
SELECT d.doc_id, CASE WHEN e.doc_id IS NOT NULL THEN 'exact' WHEN n.n_links > 0 THEN 'near' WHEN s.n_links > 0 THEN 'semantic' ELSE 'none' END AS level
FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id""")
def duplicate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near links count for documents of any length, unlike in near_duplicates."""
    docs = table(spark, sf_dir, "documents")
    sets = stored(duplicates.sized_term_sets(docs), "term_sets")
    return records.duplicate_levels(docs, duplicates.exact_matches(docs), duplicates.near_duplicates(docs, sets=sets), duplicates.semantic_duplicates(docs, sets=sets))


@query("SELECT event_type AS name, 'event' AS kind FROM events UNION ALL SELECT c_mktsegment, 'segment' FROM customer")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.lit("event").alias("kind")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("segment").alias("kind")))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@query("SELECT event_id, user_id, event_type, value FROM events")
def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metadata to JSON and back, with its nesting."""
    events = table(spark, sf_dir, "events")
    nested = events.select(F.struct("event_id", F.struct("user_id", F.struct("event_type", "value").alias("what")).alias("who")).alias("m"))
    back = nested.select(F.from_json(F.to_json("m"), nested.schema["m"].dataType).alias("m"))
    return back.select("m.event_id", "m.who.user_id", "m.who.what.event_type", "m.who.what.value")


def conversation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts of 100 characters and more as chunks (parents and children) with their group's columns; chunk
    places are those of the hierarchical chunker, which tests hold against brute force."""
    texts = chat.conversation_text(spark, sf_dir).where(F.length("text") >= 100)
    keyed = texts.select("channel", "session", "part", F.xxhash64("channel", "session", "part").alias("doc_id"), "text")
    made = chunks.chunk(keyed.select("doc_id", "text"), "hierarchical")
    return made.join(keyed.drop("text"), "doc_id")


QUERIES["conversation_chunks"] = conversation_chunks


@query(f"SELECT channel, count(*) AS n_groups, sum(length(text))::BIGINT AS n_chars FROM ({chat.ORACLES['conversation_text']}) WHERE length(text) >= 100 GROUP BY channel")
def channel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = chat.conversation_text(spark, sf_dir).where(F.length("text") >= 100)
    return texts.groupBy("channel").agg(F.count("*").alias("n_groups"), F.sum(F.length("text")).alias("n_chars"))
