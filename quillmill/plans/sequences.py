"""Queries of folds along an order: token buckets, limiters, breakers, batches for embedding calls. Their SQL steps through
all keys' rows by number, in a recursive CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import scan, tables
from quillmill.plans.common import SQL_WORDS, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.col("event_id").alias("id"), F.coalesce(F.col("value") > 20, F.lit(False)).alias("failed"))


CALLS = "c AS (SELECT event_type, user_id, floor(epoch(ts))::BIGINT AS s, event_id AS id, coalesce(value > 20, false) AS failed, row_number() OVER (PARTITION BY {0} ORDER BY floor(epoch(ts))::BIGINT, event_id) AS n FROM events)"


@query(f"""WITH RECURSIVE {CALLS.format('user_id')}, w AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END AS weight FROM c),
r AS (SELECT user_id, n, id, s, 3 >= weight AS allowed, CASE WHEN 3 >= weight THEN 3 - weight ELSE 3 END::BIGINT AS tokens FROM w WHERE n = 1 UNION ALL
SELECT w.user_id, w.n, w.id, w.s, least(3, tokens + w.s // 21600 - r.s // 21600) >= weight,
       least(3, tokens + w.s // 21600 - r.s // 21600) - CASE WHEN least(3, tokens + w.s // 21600 - r.s // 21600) >= weight THEN weight ELSE 0 END
FROM r JOIN w ON w.user_id = r.user_id AND w.n = r.n + 1)
SELECT user_id, id, allowed, tokens FROM r""")
def burst_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's bucket of three tokens, one back every six hours; a purchase takes two."""
    weight = F.when(F.col("event_type") == "purchase", 2).otherwise(1)
    return scan.bucket_calls(_calls(spark, sf_dir).withColumn("weight", weight), "user_id", burst=3, seconds=21_600)


@query(f"""WITH RECURSIVE {CALLS.format('event_type')},
r AS (SELECT event_type, n, id, true AS allowed, [s] AS rec, 2 AS tokens FROM c WHERE n = 1 UNION ALL
SELECT event_type, n, id, ok, CASE WHEN ok THEN list_append(held, s) ELSE held END, left_over FROM (
  SELECT *, (free OR tokens > 0) AND len(held) < 3 AS ok, tokens - (NOT free AND tokens > 0)::INT AS left_over FROM (
    SELECT c.event_type, c.n, c.id, c.s, r.tokens, list_filter(rec, lambda t: t >= c.s - 3600) AS held, len(list_filter(rec, lambda t: t >= c.s - 600)) < 1 AS free
    FROM r JOIN c ON c.event_type = r.event_type AND c.n = r.n + 1)))
SELECT id, event_type, allowed FROM r""")
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls a sliding-log limiter records: one in ten minutes beside two burst tokens, three in an hour."""
    calls = _calls(spark, sf_dir).select("event_type", "s", "id")
    fold = scan.limiter(short=600, per_short=1, long=3600, per_long=3, burst=2, at=1)
    return scan.folded(calls, "event_type", ["s", "id"], fold, "allowed", "boolean").select("id", "event_type", "allowed")


@query(f"""WITH RECURSIVE {CALLS.format('event_type')},
r AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS id, 'closed' AS met, 'closed' AS state, 0::BIGINT AS since, 0 AS good, []::BIGINT[] AS rec FROM (SELECT DISTINCT event_type FROM c) UNION ALL
SELECT event_type, n, id, met, CASE WHEN trips THEN 'open' WHEN mends THEN 'closed' ELSE met END, CASE WHEN trips THEN s ELSE since END,
       CASE WHEN trips OR mends THEN 0 WHEN met = 'half_open' AND NOT failed THEN good + 1 ELSE good END, CASE WHEN trips OR mends THEN [] WHEN met <> 'open' AND failed THEN list_append(held, s) ELSE rec END FROM (
  SELECT *, failed AND (met = 'half_open' OR (met = 'closed' AND len(held) + 1 >= 3)) AS trips, met = 'half_open' AND NOT failed AND good + 1 >= 2 AS mends FROM (
    SELECT c.event_type, c.n, c.id, c.s, c.failed, since, good, rec, CASE WHEN state = 'open' AND c.s - since >= 1800 THEN 'half_open' ELSE state END AS met, list_filter(rec, lambda t: t >= c.s - 3600) AS held
    FROM r JOIN c ON c.event_type IS NOT DISTINCT FROM r.event_type AND c.n = r.n + 1)))
SELECT id, event_type, met AS state FROM r WHERE n > 0""")
def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker's state that each call meets: open after three failures in an hour, half open after half an hour."""
    calls = _calls(spark, sf_dir).select("event_type", "s", "id", "failed")
    fold = scan.breaker(failures=3, window=3600, recovery=1800, successes=2, at=1, failed=3)
    return scan.folded(calls, "event_type", ["s", "id"], fold, "state", "string").select("id", "event_type", "state")


SIZES = f"t AS (SELECT doc_id, len({SQL_WORDS.format('text')}) * 1.3::DOUBLE AS tokens, row_number() OVER (ORDER BY doc_id) - 1 AS row_no FROM documents)"


def _token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.size(T.words("text")) * 1.3).alias("tokens"))


@query(f"""WITH {SIZES}, p AS (SELECT CASE WHEN sum(tokens) <= 250000 THEN count(*) ELSE greatest(1, count(*) // greatest(1, floor(sum(tokens) / 250000)::BIGINT + 1)) END AS size FROM t)
SELECT (row_no // size)::BIGINT AS batch_no, count(*) AS n_texts, round(sum(tokens), 6) AS tokens, min(doc_id) AS first_id, max(doc_id) AS last_id FROM t, p GROUP BY 1""")
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of an embedding run, of equal numbers of texts in their order."""
    sizes = tables.numbered(_token_sizes(spark, sf_dir), ["doc_id"])
    total = sizes.agg(F.count("*").alias("n"), F.sum("tokens").alias("all"))  # one row
    parts = F.greatest(F.lit(1), F.floor(F.col("all") / 250_000) + 1)
    size = F.when(F.col("all") <= 250_000, F.col("n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("n") / parts)))
    placed = sizes.join(F.broadcast(total.select(size.alias("size")))).withColumn("batch_no", F.floor(F.col("row_no") / F.col("size")))
    return placed.groupBy("batch_no").agg(F.count("*").alias("n_texts"), F.round(F.sum("tokens"), 6).alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""WITH RECURSIVE {SIZES}, r AS (SELECT row_no, doc_id, tokens, 0::BIGINT AS batch_no, tokens AS total, 1 AS n FROM t WHERE row_no = 0 UNION ALL
SELECT t.row_no, t.doc_id, t.tokens, CASE WHEN opens THEN batch_no + 1 ELSE batch_no END, CASE WHEN opens THEN t.tokens ELSE total + t.tokens END, CASE WHEN opens THEN 1 ELSE n + 1 END
FROM (SELECT r.*, n >= 256 OR total + x.tokens > 8000 AS opens FROM r JOIN t x ON x.row_no = r.row_no + 1) r JOIN t ON t.row_no = r.row_no + 1)
SELECT batch_no, count(*) AS n_texts, round(sum(tokens), 6) AS tokens, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY 1""")
def embedding_batches_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that keep a limit of 8,000 tokens and 256 texts, filled in order; ranges hand on their open batch."""
    sizes = _token_sizes(spark, sf_dir).select(F.lit(0).alias("run"), "doc_id", "tokens")
    opened = scan.folded(sizes, "run", ["doc_id"], scan.greedy_batches(limit=8000, most=256, size=2), "opens", "boolean")
    placed = scan.running_total(opened, ["doc_id"], F.col("opens").cast("long"), "batch_no").withColumn("batch_no", F.col("batch_no") - 1)
    return placed.groupBy("batch_no").agg(F.count("*").alias("n_texts"), F.round(F.sum("tokens"), 6).alias("tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
