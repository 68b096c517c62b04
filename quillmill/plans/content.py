"""Queries of quality, fingerprints, duplicates and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import duplicates, quality
from quillmill.plans.common import SQL_SOURCE_TYPE, SQL_TOKENS, SQL_WORDS, sql_list, table, with_source_type

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


AS_OF = "2024-07-01"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a kind of source, and a date made from their length (null for every tenth length)."""
    docs = with_source_type(table(spark, sf_dir, "documents"))
    return docs.withColumn("created_at", F.when(F.col("n_chars") % 10 != 0, F.date_sub(F.to_date(F.lit(AS_OF)), (F.col("n_chars") % 900).cast("int"))))


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(low, '{w}')::INT" for w in words) + ")"


DOCS = f"""d AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, {SQL_SOURCE_TYPE} AS st, len({SQL_WORDS.format('text')}) AS w,
  CASE WHEN n_chars % 10 <> 0 THEN DATE '{AS_OF}' - (n_chars % 900)::INT END AS created, md5(coalesce(text, '')) AS h FROM documents)"""
_AUTH = "CASE st " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.AUTHORITY.items()) + " ELSE 0.3 END::DOUBLE"
_STRUCT = r"0.5 + CASE WHEN contains(t, chr(10)) THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t, '(?m)^#+\s') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(t, '(?m)^\s*[-*•]\s') THEN 0.1 ELSE 0 END"
SCORED = f"""{DOCS}, s AS (SELECT *,
  greatest(0, least(1, 0.5::DOUBLE + least({_hits(quality.TECHNICAL)} * 0.1, 0.3) + least({_hits(quality.AUTHORITATIVE)} * 0.05, 0.2) - {_hits(quality.LOW_QUALITY)} * 0.1
    + CASE WHEN st IN ('documentation', 'official_website') THEN 0.1 ELSE 0 END))::DOUBLE AS relevance,
  {_AUTH} AS authority,
  CASE WHEN w = 0 THEN 0 ELSE least(1, greatest(0, 1 - abs(w / len(regexp_split_to_array(t, '[.!?]+')) - 17.5) / 17.5) * 0.3 + greatest(0, 1 - abs(length(t) / w - 5) / 5) * 0.3 + ({_STRUCT}) * 0.4) END::DOUBLE AS readability,
  CASE WHEN w = 0 THEN 0 ELSE greatest(0, least(1, 0.5::DOUBLE + CASE WHEN w > 100 THEN 0.2 ELSE 0 END + CASE WHEN w > 500 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(t, '(?m)^#+\\s') THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(t, '(?m)^\\s*[-*•]\\s') THEN 0.05 ELSE 0 END + CASE WHEN contains(t, '```') OR regexp_matches(t, '`[^`]+`') THEN 0.1 ELSE 0 END - {_hits(quality.INCOMPLETE)} * 0.1)) END::DOUBLE AS completeness,
  CASE WHEN created IS NULL THEN 0.5 WHEN DATE '{AS_OF}' - created <= 7 THEN 1 WHEN DATE '{AS_OF}' - created <= 30 THEN 0.9 WHEN DATE '{AS_OF}' - created <= 90 THEN 0.8 WHEN DATE '{AS_OF}' - created <= 365 THEN 0.6 WHEN DATE '{AS_OF}' - created <= 730 THEN 0.4 ELSE 0.2 END::DOUBLE AS freshness FROM d),
o AS (SELECT *, relevance * 0.3 + authority * 0.25 + readability * 0.2 + completeness * 0.15 + freshness * 0.1 AS overall,
  list_filter([CASE WHEN length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) < 50 THEN 'Content too short' END, CASE WHEN w < 10 THEN 'Insufficient word count' END,
   CASE WHEN {_hits(quality.PLACEHOLDERS)} > 0 THEN 'Contains placeholder content' END, CASE WHEN {_hits(quality.UNFINISHED)} > 0 THEN 'Content appears incomplete' END,
   CASE WHEN NOT contains(t, chr(10)) AND length(t) > 500 THEN 'Poor formatting (no paragraphs)' END, CASE WHEN st = 'unknown' THEN 'Unknown source type' END, CASE WHEN created IS NULL THEN 'No timestamp information' END], lambda x: x IS NOT NULL) AS issues,
  doc_id > min(doc_id) OVER (PARTITION BY h) AS is_copy FROM s)"""


@query(f"WITH {SCORED} SELECT doc_id, round(relevance, 6) AS relevance, round(authority, 6) AS authority, round(readability, 6) AS readability, round(completeness, 6) AS completeness, freshness, round(overall, 6) AS overall FROM o")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scores(_docs(spark, sf_dir), AS_OF)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("relevance", "authority", "readability", "completeness", "freshness", "overall")])


@query(f"WITH {SCORED} SELECT doc_id, array_to_string(issues, '; ') AS issues, CASE WHEN st IN ('official_website', 'documentation') THEN 'high' WHEN st IN ('github_repository', 'wikipedia') THEN 'medium' WHEN st IN ('blog_post', 'forum') THEN 'low' ELSE 'unknown' END AS authority_category FROM o")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("source_type")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(quality.issues(T.text("text"), kind, F.col("created_at")), "; ").alias("issues"), quality.authority_category(kind).alias("authority_category"))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = duplicates.exact_matches(table(spark, sf_dir, "documents")).select("doc_id", F.lit(True).alias("is_copy"))
    docs = quality.scores(_docs(spark, sf_dir), AS_OF, keep_counts=True)
    docs = docs.withColumn("issues", quality.issues(T.text("text"), F.col("source_type"), F.col("created_at"), F.col("_n_words"))).drop("text")
    return docs.join(copies, "doc_id", "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN is_copy THEN 'exact duplicate' WHEN overall < 0.4 THEN 'low quality' WHEN list_has_any(issues, ['Contains placeholder content', 'Content too short', 'Insufficient word count']) THEN 'blocking issue' END AS skip_reason FROM o")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.gate(_gated(spark, sf_dir)).select("doc_id", "skip_reason")


@query(f"""WITH {SCORED} SELECT doc_id, array_to_string(list_filter([CASE WHEN overall < 0.3 THEN 'Consider rejecting - very low quality content' WHEN overall < 0.5 THEN 'Flag for manual review - below quality threshold' END,
 CASE WHEN relevance < 0.4 THEN 'Low relevance - consider content filtering' END, CASE WHEN completeness < 0.4 THEN 'Content appears incomplete - verify source' END,
 CASE WHEN len(issues) > 0 THEN 'Quality issues detected: ' || array_to_string(issues, ', ') END, CASE WHEN is_copy THEN 'Exact duplicate found - skip ingestion' END], lambda x: x IS NOT NULL), ' | ') AS advice FROM o""")
def quality_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", F.array_join(quality.recommendations(), " | ").alias("advice"))


@query(f"WITH {SCORED} SELECT st AS source_type, count(*) AS n_docs, round(avg(overall), 6) AS avg_overall, count(*) FILTER (overall >= 0.8) AS n_high, count(*) FILTER (overall >= 0.5 AND overall < 0.8) AS n_medium, count(*) FILTER (overall < 0.5) AS n_low FROM o GROUP BY GROUPING SETS ((st), ())")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scores(_docs(spark, sf_dir), AS_OF)
    return found.groupingSets([[F.col("source_type")], []], "source_type").agg(
        F.count("*").alias("n_docs"), F.round(F.avg("overall"), 6).alias("avg_overall"), F.count_if(F.expr("overall >= 0.8")).alias("n_high"), F.count_if(F.expr("overall >= 0.5 and overall < 0.8")).alias("n_medium"), F.count_if(F.expr("overall < 0.5")).alias("n_low")
    )


@query(f"""WITH {DOCS}, s AS (SELECT doc_id, CASE WHEN length(t) > 1000 THEN 0.9 WHEN length(t) > 500 THEN 0.7 ELSE 0.5 END::DOUBLE AS completeness,
 greatest(0.1, least(1, 1 - (coalesce(length(regexp_replace(t, '\\s+', '', 'g')) / nullif(w, 0), 0) - 5) / 10))::DOUBLE AS readability, 0.5::DOUBLE AS authority,
 coalesce(greatest(0.1, 1 - (DATE '{AS_OF}' - created) / 365), 0.5)::DOUBLE AS freshness FROM d)
SELECT doc_id, completeness, round(readability, 6) AS readability, round(freshness, 6) AS freshness, round(completeness * 0.25 + readability * 0.2 + authority * 0.25 + 0.7 * 0.15 + freshness * 0.15, 6) AS overall FROM s""")
def store_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.store_scores(_docs(spark, sf_dir), AS_OF)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("completeness", "readability", "freshness", "overall")])


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 50 AND coalesce(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / nullif(length(text), 0), 0) >= 0.4 AS valid FROM documents")
def content_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(quality.valid(T.text("text")), F.lit(False)).alias("valid"))


def _ranked(array: str, where: str = "true") -> str:
    return f"""r AS (SELECT doc_id, word, freq, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, first_at) AS rank FROM (
  SELECT doc_id, word, count(*) AS freq, min(pos) AS first_at FROM (SELECT doc_id, unnest({array}) AS word, unnest(range(len({array}))) AS pos FROM documents) WHERE {where} GROUP BY doc_id, word))"""


_KEY = _ranked(SQL_TOKENS.format("text")) + f", kt AS (SELECT * FROM r WHERE rank <= 20 AND length(word) > 3 AND word NOT IN {sql_list(T.KEY_TERM_STOPWORDS)} AND NOT regexp_full_match(word, '\\p{{N}}+')), sets AS (SELECT doc_id, list_sort(list(word)) AS terms FROM kt GROUP BY doc_id)"


@query(f"WITH {_KEY} SELECT doc_id, word, freq, rank::INT AS rank FROM kt")
def key_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.key_terms(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "word", "freq", "rank")


@query(f"WITH {_ranked(SQL_TOKENS.format('text'), where=f'regexp_full_match(word, {chr(39)}[a-z]{{3,}}{chr(39)}) AND word NOT IN {sql_list(T.CHAT_STOPWORDS)}')} SELECT doc_id, word, freq, rank::INT AS rank FROM r WHERE rank <= 10 AND freq > 1")
def chat_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chat_keywords(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "word", "freq", "rank")


@query(f"WITH {_ranked(SQL_WORDS.format('lower(text)'), where=f'length(word) > 3 AND word NOT IN {sql_list(T.METADATA_STOPWORDS)}')} SELECT doc_id, word, freq, rank::INT AS rank FROM r WHERE rank <= 20")
def metadata_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.metadata_keywords(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "word", "freq", "rank")


@query(f"""WITH {_KEY}, {DOCS} SELECT d.doc_id, h AS content_hash, md5(regexp_replace(regexp_replace(low, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS fuzzy_hash,
 md5(coalesce(array_to_string(terms, ' '), '')) AS semantic_hash, length(t)::INT AS length, w::INT AS word_count FROM d LEFT JOIN sets ON d.doc_id = sets.doc_id""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.fingerprints(table(spark, sf_dir, "documents"))


@query(f"WITH {DOCS} SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM d) WHERE doc_id > first_id")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_matches(table(spark, sf_dir, "documents"))


@query(f"""WITH {_KEY}, l AS (SELECT s.doc_id, terms, length(coalesce(text, '')) AS n FROM sets s JOIN documents d ON s.doc_id = d.doc_id),
m AS (SELECT a.doc_id, count(*) AS n_links FROM l a JOIN l b ON a.n < 10000 AND a.doc_id <> b.doc_id AND abs(a.n - b.n) <= 0.3 * greatest(a.n, b.n)
  AND len(list_intersect(a.terms, b.terms)) / (len(a.terms) + len(b.terms) - len(list_intersect(a.terms, b.terms))) >= 0.85 GROUP BY a.doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY terms, n) AS class_id FROM l)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN m ON d.doc_id = m.doc_id""")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_duplicates(table(spark, sf_dir, "documents"), longest=10_000)


@query(f"""WITH {_KEY}, c AS (SELECT terms, min(doc_id) AS doc_id FROM sets GROUP BY terms), q AS (SELECT * FROM sets WHERE doc_id % 20 = 0),
p AS (SELECT q.doc_id AS query_id, c.doc_id AS related_id, round(len(list_intersect(q.terms, c.terms)) / (len(q.terms) + len(c.terms) - len(list_intersect(q.terms, c.terms))), 6) AS similarity FROM q JOIN c ON q.doc_id <> c.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, related_id) AS rank FROM p WHERE similarity > 0.3)
SELECT query_id, related_id, similarity, rank::INT AS rank FROM k WHERE rank <= 10""")
def related_topics(spark: SparkSession, sf_dir: str, sets: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return duplicates.related_topics(docs, docs.where("doc_id % 20 = 0"), sets=sets)
