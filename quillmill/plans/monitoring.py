"""Queries of counters, histograms and SQL table functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import table_functions
from quillmill.operators import counters, embedding, metrics
from quillmill.plans import chat
from quillmill.plans.analytics import PRICES, USAGE, _usage
from quillmill.plans.common import SQL_TERMS, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT event_type, event_id AS id, ts, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS value FROM events),
d AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, id) AS prior FROM s),
g AS (SELECT *, CASE WHEN prior IS NULL THEN 0 WHEN value >= prior THEN value - prior ELSE value END AS step FROM d)
SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS slot_start, count(*) AS n, sum(step)::DOUBLE AS increase, sum(step)::DOUBLE / 300 AS rate FROM g GROUP BY ALL""")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of event has a counter that begins anew every day; how fast it grows in five minutes."""
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    samples = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.row_number().over(day).alias("value"))
    found = counters.increases(samples, ["event_type"], 300)
    return found.withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz"))


BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 200.0]
_LE = ", ".join(f"count(*) FILTER (value <= {b}) AS le_{k}" for k, b in enumerate(BOUNDS))


def _quantile_sql(q: float) -> str:
    parts = [f"WHEN le_{k} >= {q} * total THEN {BOUNDS[k - 1] if k else 0.0} + {b - (BOUNDS[k - 1] if k else 0.0)} * coalesce(({q} * total - {f'le_{k - 1}' if k else '0'}) / nullif(le_{k} - {f'le_{k - 1}' if k else '0'}, 0), 1.0)" for k, b in enumerate(BOUNDS)]
    return "CASE WHEN total = 0 THEN NULL " + " ".join(parts) + f" ELSE {BOUNDS[-1]} END::DOUBLE"


@query(f"""WITH h AS (SELECT event_type, ts::DATE AS day, {_LE}, count(value) AS total FROM events GROUP BY ALL)
SELECT event_type, day, total, round({_quantile_sql(0.5)}, 6) AS p50, round({_quantile_sql(0.95)}, 6) AS p95 FROM h""")
def histogram_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = counters.buckets(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["event_type", "day"], BOUNDS)
    return held.select("event_type", "day", "total", *[F.round(counters.quantile(q, BOUNDS), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))])


def _registered(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    table_functions.register(spark)
    return spark.sql(sql, docs=table(spark, sf_dir, "documents"))


@query(chat.ORACLES["chunk_fixed"])
def sql_chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir, "SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk_fixed(d.text, 512, 64) c")


@query(chat.ORACLES["chunk_sentences"])
def sql_chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir, "SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM {docs}), 'text', 'sentences')").drop("text")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, 'pipes' AS format FROM l WHERE contains(line, '|') UNION ALL SELECT doc_id, i, 'aligned' FROM l WHERE contains(line, chr(9))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, format ORDER BY i) AS island FROM k)
SELECT doc_id, min(i)::INT AS first_line, max(i)::INT AS last_line, format FROM g GROUP BY doc_id, format, island HAVING count(*) >= 2""")
def sql_table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where tables stand in the documents (none of these overlap in the given tables)."""
    return _registered(spark, sf_dir, "SELECT d.doc_id, r.* FROM {docs} d, LATERAL table_regions(d.text) r")


@query("""WITH t AS (SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END, (ts, event_id)) AS status FROM events GROUP BY 1),
c AS (SELECT count(*) AS total_tasks, count(*) FILTER (status = 'completed') AS completed_tasks, count(*) FILTER (status = 'failed') AS failed_tasks, count(*) FILTER (status = 'running') AS active_tasks FROM t),
e AS (SELECT count(*) AS recent_errors FROM events WHERE event_type = 'error' AND epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events WHERE event_type = 'error') - 3600000000),
h AS (SELECT *, round(coalesce(100 * completed_tasks / nullif(total_tasks, 0), 0), 6)::DOUBLE AS success_percent, round(greatest(0, 1 - 2 * coalesce(failed_tasks / nullif(total_tasks, 0), 0)), 6)::DOUBLE AS health_score FROM c, e)
SELECT *, health_score > 0.5 AND recent_errors < 10 AS healthy FROM h""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand in for tasks; the newest event of each says how it stands."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    tasks = events.groupBy("user_id").agg(F.max_by(status, F.struct("ts", "event_id")).alias("status"))
    return metrics.health(tasks, events.where("event_type = 'error'"))


@query(f"""WITH {USAGE}, p AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in PRICES)}) v(model, i, o))
SELECT u.model, count(*) AS n, round(sum(tokens / 1000 * coalesce(i, 0) + user_id / 1000 * coalesce(o, 0)), 6)::DOUBLE AS cost FROM u LEFT JOIN p ON u.model = p.model GROUP BY 1""")
def evaluation_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As evaluations count it: a model without a price costs nothing."""
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    usage = _usage(spark, sf_dir).select("model", F.col("tokens").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return metrics.priced(usage, prices, (0.0, 0.0)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""WITH t AS (SELECT doc_id, md5(unnest({SQL_TERMS.format('text')})) AS h FROM documents),
c AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % 256 AS dim, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM t GROUP BY ALL HAVING n <> 0)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents without a model."""
    return embedding.hashed(table(spark, sf_dir, "documents")).withColumn("value", F.round("value", 6))
