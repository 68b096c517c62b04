"""Queries of table profiling, evaluation, cost and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import metrics, scan, tables
from quillmill.plans.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_shipdate"]
KINDS = {"l_returnflag": "string", "l_linestatus": "string", "l_linenumber": "int", "l_quantity": "double", "l_shipdate": "timestamp_ntz"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{KINDS[c]}' AS kind, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique, count(*) AS n_rows FROM lineitem" for c in COLUMNS))
def table_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.summary(table(spark, sf_dir, "lineitem"), COLUMNS)


PROFILED = ["l_returnflag", "l_linestatus", "l_linenumber", "l_shipdate"]


@query(f"""WITH u AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {c}::VARCHAR AS v FROM lineitem" for c in PROFILED)}), n AS (SELECT c, v, count(*) AS n FROM u GROUP BY ALL),
p AS (SELECT c, count(v) AS k, sum(n) AS t FROM n GROUP BY c) SELECT n.c AS "column", v AS value, n, round(100 * n / t, 6) AS percent FROM n JOIN p ON n.c = p.c WHERE k <= 20 AND v IS NOT NULL""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.value_distribution(table(spark, sf_dir, "lineitem"), PROFILED)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), c AS (SELECT i, unnest(CASE WHEN i % 20 >= 18 THEN [i // 20, i // 20 + 1] ELSE [i // 20] END) AS k FROM r)
SELECT k::BIGINT AS chunk_no, min(i) + 1 AS first_row, max(i) + 1 AS last_row, count(*) AS n_rows, k > 0 AS has_overlap FROM c WHERE k <= (SELECT max(i // 20) FROM r) GROUP BY k""")
def row_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunk_ranges(tables.row_chunks(tables.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])))


@query("""WITH r AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT (i // 20)::BIGINT AS batch_no, count(*) AS n_rows, count(DISTINCT o_orderstatus) AS n_unique FROM r GROUP BY 1""")
def row_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    return rows.groupBy(F.floor(F.col("row_no") / 20).alias("batch_no")).agg(F.count("*").alias("n_rows"), F.countDistinct("o_orderstatus").alias("n_unique"))


@query("SELECT c_mktsegment, count(*) AS n_rows FROM customer GROUP BY 1")
def group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.groups(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT c_custkey, 'c_name: ' || coalesce(nullif(c_name, ''), 'N/A') || chr(10) || 'c_mktsegment: ' || coalesce(nullif(c_mktsegment, ''), 'N/A') || chr(10) || 'c_nationkey: ' || coalesce(c_nationkey::VARCHAR, 'N/A') AS text FROM customer")
def row_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tables.row_text(["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS name FROM events ORDER BY name")
def json_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.header_union(table(spark, sf_dir, "events"), "props")


RUNS = """s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS relevant, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, count(*) FILTER (relevant) OVER (PARTITION BY query_id) AS total FROM s),
t AS (SELECT * FROM r WHERE rank <= 20)"""


@query(f"""WITH {RUNS}, e AS (SELECT query_id, count(*) FILTER (rank <= 10) AS n, count(*) FILTER (rank <= 10 AND relevant) AS hits, max(total) AS total, min(rank) FILTER (relevant) AS f,
 coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10 AND relevant), 0) AS dcg, least(10, count(*) FILTER (relevant)) AS ideal FROM t GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(hits / n), 6) AS precision, round(avg(CASE WHEN total = 0 THEN 1 ELSE hits / total END), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr,
 round(avg(CASE WHEN ideal = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, ideal + 1), lambda i: 1 / log2(i + 1))) END), 6) AS ndcg FROM e""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmill.operators import vector

    held = table(spark, sf_dir, "embeddings")
    runs = vector.top_k_batch(held, held.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 20, skip_self=True)
    labels = held.select("vec_id", "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("relevant_total"))
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label")).join(sizes.withColumnRenamed("label", "q_label"), "q_label")
    judged = runs.join(labels, "vec_id").join(asked, "query_id").withColumn("relevant", F.col("label") == F.col("q_label"))
    return metrics.retrieval_metrics(judged, 10)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(table(spark, sf_dir, "events"), ["event_type"], "value")


USAGE = "u AS (SELECT event_id AS id, ts, ts::DATE AS day, event_type AS provider, event_type || '-' || user_id % 3 AS model, value AS cost, 100 + user_id AS tokens, user_id FROM events)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"), F.col("event_type").alias("provider"), F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")).alias("model"), F.col("value").alias("cost"), (100 + F.col("user_id")).alias("tokens"), "user_id"
    )


@query(f"WITH {USAGE} SELECT provider, model, day, count(*) AS n_requests, round(sum(cost), 6) AS cost, round(sum(cost) / count(*), 6) AS cost_per_request, round(sum(cost) * 1000 / sum(tokens), 6) AS cost_per_1k FROM u GROUP BY GROUPING SETS ((provider), (model), (day), ())")
def cost_summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_summary(_usage(spark, sf_dir))


@query(f"WITH {USAGE} SELECT year(day)::INT AS year, month(day)::INT AS month, day(day)::INT AS dom, round(sum(cost), 6) AS cost FROM u GROUP BY ROLLUP (1, 2, 3)")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cost_rollup(_usage(spark, sf_dir))


@query(f"""WITH {USAGE}, d AS (SELECT day, sum(cost) AS c, count(*) AS n FROM u GROUP BY 1 ORDER BY day DESC LIMIT 7), s AS (SELECT count(*) AS k, avg(c) AS m, stddev_samp(c) AS sd, avg(n) AS r FROM d)
SELECT round(m * 30, 6) AS cost, round(CASE WHEN k > 1 THEN greatest(0, m * 30 - 1.96 * sd * sqrt(30)) ELSE m * 15 END, 6) AS low, round(CASE WHEN k > 1 THEN m * 30 + 1.96 * sd * sqrt(30) ELSE m * 60 END, 6) AS high, floor(r * 30)::BIGINT AS requests FROM s""")
def cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.projection(_usage(spark, sf_dir), 30)


PRICES = [("click-0", 0.003, 0.015), ("click-1", 0.0008, 0.004), ("view-0", 0.015, 0.075)]


@query(f"""WITH {USAGE}, p AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {a}, {b})" for m, a, b in PRICES)}) v(model, i, o))
SELECT u.model, count(*) AS n, round(sum(tokens / 1000 * coalesce(i, 0.003) + user_id / 1000 * coalesce(o, 0.015)), 6) AS cost FROM u LEFT JOIN p ON u.model = p.model GROUP BY 1""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    usage = _usage(spark, sf_dir).select("model", F.col("tokens").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return metrics.priced(usage, prices, (0.003, 0.015)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query(f"""WITH {USAGE}, m AS (SELECT day, date_trunc('minute', ts) AS minute, sum(cost) AS c FROM u GROUP BY ALL), r AS (SELECT day, minute, round(sum(c) OVER (PARTITION BY day ORDER BY minute), 6) AS running FROM m)
SELECT day, min(minute) AS minute, min(running) AS running FROM r WHERE running > 50 GROUP BY day""")
def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_over(_usage(spark, sf_dir), 50.0).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(f"""WITH {USAGE}, w AS (SELECT id, provider, cost, avg(cost) OVER (PARTITION BY provider ORDER BY ts, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY provider ORDER BY ts, id) AS n FROM u)
SELECT id, provider, cost, round(m, 6) AS mean FROM w WHERE n >= 10 AND cost > 3 * m""")
def cost_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spikes(_usage(spark, sf_dir), "provider", times=3.0)


@query("""WITH p AS (SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1), x AS (SELECT event_type, 'mean' AS metric, mean AS value, 40 AS w, 60 AS c FROM p UNION ALL SELECT event_type, 'p95', p95, 90, 200 FROM p)
SELECT event_type, metric, round(value, 6) AS value, CASE WHEN value >= c THEN 'critical' WHEN value >= w THEN 'warning' END AS severity FROM x WHERE value >= w""")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.95)).alias("p95"))
    return metrics.threshold_alerts(values, [("mean", 40, 60), ("p95", 90, 200)]).withColumn("value", F.round("value", 6))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).select("id", "ts", "user_id", "provider", (F.col("cost") > 20).alias("failed"))


@query(f"""WITH {USAGE}, f AS (SELECT id, provider, floor(epoch(ts))::BIGINT AS s FROM u WHERE cost > 20), w AS (SELECT id, provider, count(*) OVER (PARTITION BY provider ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM f)
SELECT id, provider, recent FROM w WHERE recent >= 3""")
def breaker_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breaker_trips(_calls(spark, sf_dir), "provider", failures=3, seconds=3600).select("id", "provider", "recent")


@query(f"""WITH {USAGE}, c AS (SELECT id, user_id, floor(epoch(ts))::BIGINT AS s FROM u), w AS (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS last_minute, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS last_hour FROM c)
SELECT id, last_minute, last_hour, last_minute > 1 OR last_hour > 2 AS denied FROM w""")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.window_counts(_calls(spark, sf_dir), "user_id", 1, 2).select("id", "last_minute", "last_hour", "denied")


@query("SELECT event_type AS type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY CUBE (1, 2)")
def error_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.when(F.col("value") > 50, "high").otherwise("low").alias("severity"))
    return metrics.error_cube(errors)


@query("SELECT count(*) AS n, round(100 * count(*) FILTER (value > 10) / count(*), 6) AS success_percent, round(avg(CASE WHEN user_id % 4 <> 0 THEN value END), 6) AS mean_ms FROM events")
def delivery_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.when(F.col("value") > 10, "success").otherwise("failed").alias("status"), F.when(F.col("user_id") % 4 != 0, F.col("value")).alias("duration_ms"))
    return metrics.delivery_stats(log)


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM events GROUP BY ALL")
def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "5 minutes")
    counted = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round(F.col("n") / 300, 6).alias("per_second"))


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value > 60 AS ok, ts FROM events),
g AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY n) AS runs FROM f), a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, runs ORDER BY n) - (max(ok::INT) OVER (PARTITION BY user_id, runs)) AS attempt, ok FROM g)
SELECT user_id, event_id, attempt::INT AS attempt, least(2.0 ** (attempt - 1), 60.0)::DOUBLE AS delay FROM a WHERE NOT ok""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's calls fail until one succeeds: how long is waited after each failure since the last success."""
    ok = F.coalesce(F.col("value") > 60, F.lit(False))
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), ok.alias("ok"))
    tries = scan.folded(calls, "user_id", ["at", "event_id"], scan.attempts(ok=3), "attempt", "int").where("not ok")
    return tries.select("user_id", "event_id", "attempt", metrics.retry_delay(F.col("attempt")).alias("delay"))


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'rate_limit' WHEN user_id % 5 = 1 THEN 'network' WHEN user_id % 5 = 2 THEN 'permission' WHEN user_id % 5 = 3 THEN 'parsing' ELSE 'unknown' END AS error_class FROM events""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id") % 5
    kind = F.when(n == 1, "TimeoutError").when(n == 2, "PermissionError").otherwise("ValueError")
    message = F.when(n == 3, "could not PARSE it").when(n == 4, "other")
    return table(spark, sf_dir, "events").select("event_id", metrics.classify_error(kind, message, F.when(n == 0, 429)).alias("error_class"))
