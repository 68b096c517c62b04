"""Queries of pages, file formats, the metadata catalogue and source ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import web
from quillmill.operators import catalog
from quillmill.plans.common import SQL_SOURCE_TYPE, table, with_source_type

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS description,
 len(regexp_extract_all(html, '(?i)<a[\s>]'))::INT AS n_links, len(regexp_extract_all(html, '(?i)<img[\s>/]'))::INT AS n_images, regexp_matches(html, '(?i)<table[\s>]') AS has_tables FROM pages""")
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in web.html_facts(F.col("html")).items()])


@query(r"SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'unknown_source' WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^(https?://[^?#]*)', 1) WHEN starts_with(url, 'file://') THEN url ELSE lower(trim(url)) END AS source_id FROM pages")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.normal_url(F.col("url")).alias("source_id"))


URLS = ["http://localhost/a", "ftp://x.org/", "https://10.1.2.3/", "https://ok.org:8080/a", "https://ok.org:22/", "https://u@ok.org/", "https://a.internal/", "https://12345/", "https:///x", "https://ok.org/a%20b", "https://metadata.x.org/", "https://172.20.1.1/"]
_URL_ROWS = ", ".join(f"({-k - 1}::BIGINT, '{u}')" for k, u in enumerate(URLS))


@query(f"""WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM (VALUES {_URL_ROWS}) v(a, b)),
p AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS h, try_cast(regexp_extract(url, '^[^:]+://[^/:]*:([0-9]{{1,5}})', 1) AS INT) AS port FROM u)
SELECT page_id, CASE WHEN s NOT IN ('http', 'https') THEN 'protocol' WHEN h = '' THEN 'no host' WHEN h IN ('localhost', '127.0.0.1', '0.0.0.0', '169.254.169.254') THEN 'blocked host' WHEN regexp_matches(h, '{web.SUSPICIOUS_HOST}') THEN 'suspicious host'
 WHEN regexp_matches(h, '{web.PRIVATE_HOST}') THEN 'address' WHEN port NOT IN (80, 443) AND port < 1024 THEN 'port' WHEN regexp_matches(url, '@|%[0-9a-fA-F]{{2}}|\\\\|\\.\\.') THEN 'manipulation' END AS refusal FROM p""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-k - 1, u) for k, u in enumerate(URLS)], "page_id long, url string")
    return table(spark, sf_dir, "pages").select("page_id", "url").unionByName(own).select("page_id", web.url_refusal(F.col("url")).alias("refusal"))


_EXT = "CASE regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in web.EXTENSIONS.items()) + " ELSE 'unknown' END"
_STRATEGY = "CASE " + " ".join(f"WHEN f IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in web.STRATEGIES.items()) + " ELSE 'text_processor' END"
PATHS = "p AS (SELECT doc_id, 'dir/readme_' || doc_id || '.' || (['py', 'md', 'csv', 'json', 'pdf', 'zzz', 'html', 'docx'])[doc_id % 8 + 1] AS path, text FROM documents)"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.array(*map(F.lit, ["py", "md", "csv", "json", "pdf", "zzz", "html", "docx"]))
    return table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("dir/readme_"), F.col("doc_id").cast("string"), F.lit("."), F.get(ends, (F.col("doc_id") % 8).cast("int"))))


@query(f"WITH {PATHS}, e AS (SELECT doc_id, {_EXT} AS f FROM p) SELECT doc_id, f AS format, {_STRATEGY} AS strategy FROM e")
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _paths(spark, sf_dir).select("doc_id", web.format_by_extension(F.col("path")).alias("format"))
    return named.withColumn("strategy", web.strategy(F.col("format")))


_SIGNS = {
    "html": ["(?i)<!doctype html", "(?i)<html", "(?i)<body"], "json": ["^\\s*[\\[{]", '"[^"]+"\\s*:'], "xml": ["^\\s*<\\?xml"], "markdown": ["(?m)^#{1,6}\\s", "(?m)^```", "\\[[^\\]]+\\]\\([^)]+\\)"],
}
_HITS = {k: " + ".join(f"regexp_matches(h, '{p}')::INT" for p in ps) for k, ps in _SIGNS.items()}


@query(f"""WITH t AS (SELECT page_id, substr(html, 1, 2048) AS h FROM pages), s AS (SELECT page_id, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM t), b AS (SELECT *, greatest({', '.join(_HITS)}) AS best FROM s)
SELECT page_id, CASE WHEN best = 0 THEN 'text' {' '.join(f"WHEN {k} = best THEN '{k}'" for k in _HITS)} END AS format, round(CASE WHEN best = 0 THEN 0.3 ELSE least(0.9, 0.3 + 0.3 * best) END::DOUBLE, 6) AS confidence FROM b""")
def content_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, confidence = web.content_format(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("format"), F.round(confidence, 6).alias("confidence"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?m)^#+\s+(.+)$'))::INT AS n_headers, len(string_split(coalesce(text, ''), chr(10)))::INT AS n_lines FROM documents")
def markdown_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = web.markdown_facts(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", facts["n_headers"].alias("n_headers"), facts["n_lines"].alias("n_lines"))


@query(r"WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+', '')) AS l FROM documents) SELECT doc_id, len(l)::INT AS n_lines, len(list_filter(l, lambda x: x <> ''))::INT AS n_filled, len(list_filter(l, lambda x: regexp_matches(x, '^(#|//|/\*)')))::INT AS n_comments FROM l")
def code_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in web.code_facts(F.coalesce("text", F.lit(""))).items()])


@query(f"""WITH {PATHS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN regexp_matches(lower(coalesce(text, '')), 'question|help|how to|\\?') THEN 'question_answer' WHEN regexp_matches(lower(coalesce(text, '')), 'announcement|update|release') THEN 'announcement' ELSE 'conversation' END
 ELSE 'documentation' END AS category, CASE WHEN ends_with(path, '.md') THEN 'markdown_file' WHEN ends_with(path, '.pdf') THEN 'pdf_document' WHEN ends_with(path, '.docx') THEN 'word_document' WHEN ends_with(path, '.csv') THEN 'csv_data' WHEN ends_with(path, '.json') THEN 'json_data' WHEN ends_with(path, '.py') THEN 'code_file' ELSE 'unknown' END AS source_type FROM p""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", catalog.classify(F.col("path"), F.col("text"), F.col("doc_id") % 2 == 0).alias("category"), catalog.source_type(F.col("path")).alias("source_type"))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT 1000000, 7, 2")
def upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(1).alias("version"))
    changed = old.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    new = spark.createDataFrame([(1_000_000, 7, 2)], "vec_id long, label int, version int")
    return catalog.upsert(old, changed.unionByName(new), "vec_id", "version")


@query("SELECT vec_id, label FROM embeddings WHERE NOT coalesce(label = 2, false)")
def purge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.purge(table(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("label") == 2)


@query("SELECT count(*) AS n_all, count(*) FILTER (label = 2) AS n_purged, count(*) - count(*) FILTER (label = 2) AS n_left FROM embeddings")
def purge_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.purge_preview(table(spark, sf_dir, "embeddings"), F.col("label") == 2)


TAGGED = "t AS (SELECT doc_id, [lang, source, 'all'] AS tags FROM documents)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source", F.lit("all")).alias("tags"))


@query(f"WITH {TAGGED} SELECT doc_id FROM t WHERE list_has_any(tags, ['de', 'src3'])")
def tag_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_tags(_tagged(spark, sf_dir), "tags", ["de", "src3"]).select("doc_id")


@query(f"WITH {TAGGED} SELECT doc_id FROM t WHERE list_has_all(tags, ['en', 'src3'])")
def tag_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_tags(_tagged(spark, sf_dir), "tags", ["en", "src3"], every=True).select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def migration_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def metadata_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.enriched(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@query(f"""WITH m AS (SELECT lang AS category, {SQL_SOURCE_TYPE} AS source_type, CASE WHEN n_chars % 100 >= 70 THEN 'high' WHEN n_chars % 100 >= 40 THEN 'medium' ELSE 'low' END AS tier FROM documents)
SELECT category, source_type, tier, count(*) AS n FROM m GROUP BY GROUPING SETS ((category), (source_type), (tier), ())""")
def metadata_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_source_type(table(spark, sf_dir, "documents"))
    return catalog.statistics(docs.select(F.col("lang").alias("category"), "source_type", ((F.col("n_chars") % 100) / 100).alias("quality")))


@query("""WITH m AS (SELECT (n_chars % 60)::INT AS age, (n_chars % 100) / 100 AS q FROM documents) SELECT CASE WHEN age <= 1 THEN 'day' WHEN age <= 7 THEN 'week' WHEN age <= 30 THEN 'month' ELSE 'older' END AS age, count(*) AS n, round(avg(q), 6) AS quality FROM m GROUP BY 1""")
def content_age_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.date_sub(F.to_date(F.lit("2024-07-01")), (F.col("n_chars") % 60).cast("int")).alias("created_at"), ((F.col("n_chars") % 100) / 100).alias("quality"))
    return catalog.age_patterns(docs, "2024-07-01")


@query("""WITH h AS (SELECT user_id AS doc, event_type AS stage, ts, value > 50 AS failed, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_type)) / 1000000 AS s FROM events)
SELECT stage, count(*) AS n, round(avg(s), 6) AS seconds, round(count(*) FILTER (failed) / count(*), 6) AS error_rate FROM h GROUP BY 1""")
def stage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return catalog.stage_times(events.select(F.col("user_id").alias("doc"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 50).alias("failed")))


@query("SELECT user_id AS task, arg_max(event_type, (ts, event_type)) AS status, max(ts) AS ts FROM events GROUP BY 1")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.current_status(table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("status"), "ts"))


RANKED = f"""r AS (SELECT lang AS query_id, source AS source_id, ((n_chars * 7919) % 1000) / 1000 AS score, coalesce(text, '') AS content, CASE {SQL_SOURCE_TYPE} WHEN 'documentation' THEN 0.9 WHEN 'forum' THEN 0.4 ELSE 0.6 END::DOUBLE AS authority, DATE '2024-07-01' - (n_chars % 700)::INT AS created FROM documents),
p AS (SELECT query_id, source_id, max(score) AS relevance, count(*) AS n_chunks, list_sort(list(score), 'DESC')[1:3] AS top, max(authority) AS authority, max(created) AS created, substr(arg_max(content, (score, content)), 1, 300) AS snippet FROM r GROUP BY ALL),
s AS (SELECT *, round((coalesce(top[1], 0) * 0.5 + coalesce(top[2], 0) * 0.3 + coalesce(top[3], 0) * 0.2) * 0.4 + authority * 0.3 + greatest(0.1, 1 - (DATE '2024-07-01' - created) / 365) * 0.2 + least(1, n_chunks / 5) * 0.1, 6) AS score, max(relevance) OVER (PARTITION BY query_id) AS best FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM s WHERE relevance >= CASE WHEN 0.5 > best THEN greatest(0.01, best * 0.2) ELSE 0.5 END)"""


@query(f"WITH {RANKED} SELECT query_id, source_id, relevance, n_chunks, snippet, authority, score, rank::INT AS rank FROM k WHERE rank <= 5")
def source_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_source_type(table(spark, sf_dir, "documents"))
    results = docs.select(
        F.col("lang").alias("query_id"), F.col("source").alias("source_id"), ((F.col("n_chars") * 7919) % 1000 / 1000).alias("score"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.col("source_type") == "documentation", 0.9).when(F.col("source_type") == "forum", 0.4).otherwise(0.6).alias("authority"), F.date_sub(F.to_date(F.lit("2024-07-01")), (F.col("n_chars") % 700).cast("int")).alias("created_at"),
    )
    return catalog.ranked_sources(results, "2024-07-01", 0.5)


@query("""WITH a AS (SELECT doc_id, 'see [' || source || '] and [' || lang || ']' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' [src1]' END AS answer FROM documents UNION ALL SELECT -1, 'none'),
c AS (SELECT doc_id, regexp_extract_all(answer, '\\[([^\\]]+)\\]', 1) AS f FROM a) SELECT doc_id, len(f)::INT AS n_citations, len(list_filter(f, lambda x: x IN ('src1', 'src2', 'en')))::INT AS n_valid, round(CASE WHEN len(f) = 0 THEN 1.0 ELSE len(list_filter(f, lambda x: x IN ('src1', 'src2', 'en'))) / len(f) END, 6) AS accuracy FROM c""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("see ["), F.col("source"), F.lit("] and ["), F.col("lang"), F.lit("]"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(" [src1]"))
    answers = table(spark, sf_dir, "documents").select("doc_id", said.alias("answer")).unionByName(spark.createDataFrame([(-1, "none")], "doc_id long, answer string"))
    facts = catalog.citations(F.col("answer"), F.array(F.lit("src1"), F.lit("src2"), F.lit("en")))
    return answers.select("doc_id", facts["n_citations"].alias("n_citations"), facts["n_valid"].alias("n_valid"), F.round(facts["accuracy"], 6).alias("accuracy"))


@query("SELECT item_id, substr(sha256(lower(trim(coalesce(text, ''))) || '|k=' || item_id % 5), 1, 16) AS cache_key FROM benchmark WHERE item_id % 7 > 2")
def result_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "benchmark").withColumn("expires_at", F.col("item_id") % 7)
    key = catalog.cache_key(F.col("text"), F.concat(F.lit("k="), (F.col("item_id") % 5).cast("string")))
    return catalog.unexpired(held, F.lit(2)).select("item_id", key.alias("cache_key"))
