"""Queries of semantic duplicates, mentions, reports and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.operators import duplicates, reports
from quillmill.plans.analytics import USAGE, _usage
from quillmill.plans.catalogue import RANKED, source_ranking
from quillmill.plans.common import SQL_TOKENS, table
from quillmill.plans.content import _KEY

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_KEY}, e AS (SELECT doc_id, unnest(terms) AS term FROM sets), df AS (SELECT term, ln((1 + (SELECT count(*) FROM sets)) / (1 + count(*))) + 1 AS w FROM e GROUP BY 1),
c AS (SELECT terms, min(doc_id) AS item, count(*) AS size FROM sets GROUP BY terms), x AS (SELECT item, unnest(terms) AS term FROM c), v AS (SELECT item, x.term, w / sqrt(sum(w * w) OVER (PARTITION BY item)) AS w FROM x JOIN df ON x.term = df.term),
p AS (SELECT a.item AS a, b.item AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.term = b.term AND a.item <> b.item GROUP BY ALL), o AS (SELECT a AS item, sum(size) AS others FROM p JOIN c ON p.b = c.item WHERE round(s, 9) >= 0.7 GROUP BY 1),
l AS (SELECT terms, c.item AS class_id, coalesce(others, 0) + size - 1 AS n_links FROM c LEFT JOIN o ON c.item = o.item)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN l ON s.terms = l.terms""")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.semantic_duplicates(table(spark, sf_dir, "documents"))


_PAD = "' ' || array_to_string(" + SQL_TOKENS + ", ' ') || ' '"


@query(f"""WITH b AS (SELECT -1 - item_id AS title_id, split_part(text, '.', 1) AS title FROM benchmark WHERE length(split_part(text, '.', 1)) > 10)
SELECT doc_id, title_id FROM documents d JOIN b ON contains({_PAD.format('d.text')}, {_PAD.format('b.title')})""")
def explicit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("title_id"), F.substring_index("text", ".", 1).alias("title"))
    return duplicates.title_mentions(table(spark, sf_dir, "documents"), titles)


@query(f"""WITH {RANKED} SELECT query_id, string_agg('[' || coalesce(source_id, '?') || ']' || chr(10) || coalesce(snippet, ''), chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Cite sources by their key in brackets.' AS text FROM k WHERE rank <= 5 GROUP BY 1""")
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.context_text(source_ranking(spark, sf_dir).withColumn("key", F.col("source_id")))


@query("""WITH b AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN before = '' THEN t ELSE before || chr(10) || t END AS query FROM b WHERE role = 'user'""")
def conversational_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.conversational_query(table(spark, sf_dir, "conversations"))


@query("""WITH s AS (SELECT event_type, count(*)::DOUBLE AS n, avg(value) AS mean, max(value) AS max FROM events GROUP BY 1)
SELECT 'latency' AS metric_type, event_type, metric_name, round(value, 6) AS value FROM (UNPIVOT s ON n, mean, max INTO NAME metric_name VALUE value)""")
def report_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    return reports.long_form(s, "latency", "event_type").withColumn("value", F.round("value", 6))


JUDGED = "'Score: ' || (user_id % 30 - 5) / 10 || chr(10) || '- issue ' || user_id || chr(10) || 'text' || CASE WHEN user_id % 2 = 0 THEN chr(10) || '- second' ELSE '' END"


@query(f"""WITH a AS (SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'nothing' ELSE {JUDGED} END AS answer FROM events)
SELECT event_id, coalesce(greatest(0, least(1, try_cast(regexp_extract(answer, '(?i)score:\\s*(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE))), 0.5)::DOUBLE AS score, len(regexp_extract_all(answer, '(?m)^-\\s*(.+)$', 1))::INT AS n_issues FROM a""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("user_id")
    text = F.concat(F.lit("Score: "), ((n % 30 - 5) / 10).cast("string"), F.lit("\n- issue "), n.cast("string"), F.lit("\ntext"), F.when(n % 2 == 0, "\n- second").otherwise(""))
    answers = table(spark, sf_dir, "events").select("event_id", F.when(n % 7 == 0, "nothing").otherwise(text).alias("answer"))
    score, issues = reports.judged(F.col("answer"))
    return answers.select("event_id", score.alias("score"), F.size(issues).alias("n_issues"))


@query("SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'large' WHEN n_chars > 1000 THEN 'medium' ELSE 'small' END AS size, CASE WHEN n_chars % 10 >= 8 THEN 'high' WHEN n_chars % 10 >= 5 THEN 'medium' ELSE 'low' END AS tier FROM documents")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", reports.size_label(n).alias("size"), reports.tier_label(n % 10 / 10).alias("tier"))


@query(f"""WITH {USAGE}, m AS (SELECT provider, sum(cost) AS c FROM u GROUP BY 1), a AS (SELECT avg(tokens) AS t FROM (SELECT tokens FROM u ORDER BY ts DESC, id DESC LIMIT 100)),
r AS (SELECT count(*) AS n FROM (SELECT user_id FROM (SELECT user_id FROM u ORDER BY ts DESC, id DESC LIMIT 50) GROUP BY 1 HAVING count(*) > 1))
SELECT (SELECT max(provider) FROM m WHERE c > 0.2 * (SELECT sum(c) FROM m)) AS dominant_model, (SELECT round(t, 6) FROM a) AS mean_tokens, (SELECT n FROM r) AS repeated, (SELECT round(t, 6) > 150 FROM a) AS many_tokens, (SELECT n > 5 FROM r) AS cache_helps""")
def cost_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _usage(spark, sf_dir).withColumn("model", F.col("provider")).withColumn("request_id", F.col("user_id"))
    return reports.cost_advice(usage, tokens=150, share=0.2)


@query("""WITH s AS (SELECT user_id, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) OVER w AS ok, sum(CASE WHEN value > 10 THEN 0 ELSE 1 END) OVER w AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS n, (max(ok) - min(ok))::BIGINT AS ok, (max(failed) - min(failed))::BIGINT AS failed, round((max(ok) - min(ok)) / nullif(max(ok) - min(ok) + max(failed) - min(failed), 0), 6) AS success FROM s GROUP BY 1""")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") > 10).cast("long").alias("good"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return reports.snapshot_summary(good.select("user_id", F.sum("good").over(w).alias("ok"), F.sum(1 - F.col("good")).over(w).alias("failed")), "user_id")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'purchase')")
def active_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")
