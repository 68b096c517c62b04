"""Queries of the retrieval operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import bm25, fusion, vector
from quillmill.plans.common import SQL_ALL_TERMS, SQL_TERMS, SQL_TOKENS, SQL_WORDS, sql_list, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


WORDS = ["stanin", "lyon", "orin", "hati", "atst"]
ASKED = " ".join(WORDS)
PHRASE = "for the"

INDEX = f"idx AS (SELECT doc_id, {SQL_TERMS.format('text')} AS terms FROM documents WHERE length(trim(coalesce(text, ''))) > 0)"
POSTINGS = f"{INDEX}, p AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM idx), tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM idx), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"
PART = "ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


@query(f"SELECT doc_id, len(t)::INT AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {SQL_TERMS.format('text')} AS t FROM documents)")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.terms("text").alias("t")).select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query(f"WITH {POSTINGS} SELECT term, df FROM df")
def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(bm25.indexed(table(spark, sf_dir, "documents")))


@query(f"WITH {POSTINGS} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS vocabulary FROM st")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = bm25.indexed(table(spark, sf_dir, "documents"))
    return bm25.corpus_stats(index).crossJoin(bm25.term_stats(index).agg(F.count("*").alias("vocabulary"))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"WITH {POSTINGS} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 20")
def bm25_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.term_stats(bm25.indexed(table(spark, sf_dir, "documents"))).orderBy(F.desc("df"), "term").limit(20)


@query("SELECT count(*) AS n_docs, sum(('0x' || substr(sha256(doc_id::VARCHAR || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT)::BIGINT AS checksum FROM documents")
def index_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.checksum(table(spark, sf_dir, "documents"))


TOPK = f"WITH {POSTINGS} SELECT doc_id, round(sum({PART}), 6) AS score FROM tf JOIN df USING (term), st WHERE term IN {sql_list(WORDS)} GROUP BY doc_id HAVING sum({PART}) > 0 ORDER BY score DESC, doc_id LIMIT 10"


@query(TOPK)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(table(spark, sf_dir, "documents"), ASKED, 10, phrases=False, proximity=False).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {POSTINGS} SELECT doc_id, term, tf, df, round(ln((n - df + 0.5) / (df + 0.5)), 6) AS idf, round({PART}, 6) AS score FROM tf JOIN df USING (term), st WHERE term IN {sql_list(WORDS)}")
def bm25_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.explain(table(spark, sf_dir, "documents"), ASKED)
    return found.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), "df", F.round("idf", 6).alias("idf"), F.round("score", 6).alias("score"))


@query(f"""
WITH {POSTINGS},
d AS (SELECT doc_id, {SQL_ALL_TERMS.format('text')} AS w FROM documents WHERE length(trim(coalesce(text, ''))) > 0),
pos AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM d),
ph AS (SELECT a.doc_id, 2.0 * count(*) AS phrase FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.term = 'for' AND b.term = 'orin' GROUP BY a.doc_id),
q AS (SELECT * FROM (VALUES ('stanin'), ('lyon')) v(term)),
gap AS (SELECT a.doc_id, min(abs(a.i - b.i) - 1)::DOUBLE AS g FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.term = 'stanin' AND b.term = 'lyon' GROUP BY a.doc_id),
near AS (SELECT doc_id, 0.5 * CASE WHEN g = 0 THEN 1.0 WHEN g <= 5 THEN 1 - g / 5 ELSE 0.1 END AS proximity FROM gap),
b AS (SELECT doc_id, sum({PART}) AS bm25 FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY doc_id),
cand AS (SELECT doc_id FROM b UNION SELECT doc_id FROM tf WHERE term = 'orin')
SELECT doc_id, round(coalesce(bm25, 0), 6) AS bm25, coalesce(phrase, 0)::DOUBLE AS phrase, round(coalesce(proximity, 0), 6) AS proximity,
       round(coalesce(bm25, 0) + coalesce(phrase, 0) + coalesce(proximity, 0), 6) AS score
FROM cand LEFT JOIN b USING (doc_id) LEFT JOIN ph USING (doc_id) LEFT JOIN near USING (doc_id)
WHERE coalesce(bm25, 0) + coalesce(phrase, 0) + coalesce(proximity, 0) > 0 ORDER BY score DESC, doc_id LIMIT 25
""")
def bm25_phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25.search(table(spark, sf_dir, "documents"), '"for orin" stanin lyon', 25)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("bm25", "phrase", "proximity", "score")])


@query(f"""
WITH {POSTINGS},
q AS (SELECT item_id AS query_id, unnest(list_distinct({SQL_TERMS.format('text')})) AS term FROM benchmark),
s AS (SELECT query_id, doc_id, round(sum({PART}), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5
""")
def bm25_batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.terms("text")).alias("terms"))
    return bm25.search_batch(table(spark, sf_dir, "documents"), asked, 5)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [(i % 7 - 3) / 10 for i in range(64)]


QV = "[" + ", ".join(str((i % 7 - 3) / 10) for i in range(64)) + "]::DOUBLE[]"
COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {QV}), 6)"


@query(f"SELECT vec_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10)


@query(f"SELECT vec_id, {COS} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.top_k(table(spark, sf_dir, "embeddings").where("label = 3"), _query_vector(spark, sf_dir), 10)


BATCH = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
           FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 {0}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, rank::INT AS rank FROM r WHERE rank <= {1}
"""


@query(BATCH.format("", 10))
def vector_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    return vector.top_k_batch(held, held.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)


@query(BATCH.format("AND q.vec_id <> v.vec_id", 5))
def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "embeddings")
    return vector.top_k_batch(held, held.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 5, skip_self=True)


@query("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE label IN (1, 2)")
def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("label in (1, 2)").select("vec_id", "label", F.lit(1.0).alias("score"))


@query("SELECT vec_id, label, 1.0::DOUBLE AS score FROM embeddings WHERE vec_id IN (3, 5, 8, 13, -1)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(3,), (5,), (8,), (13,), (-1,)], "vec_id long")
    return table(spark, sf_dir, "embeddings").join(F.broadcast(ids), "vec_id", "left_semi").select("vec_id", "label", F.lit(1.0).alias("score"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id > 99 ORDER BY vec_id LIMIT 100")
def scroll_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id > 99").select("vec_id", "label").orderBy("vec_id").limit(100)


@query(f"""
WITH s AS (SELECT vec_id, label, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20)
SELECT vec_id, score FROM s WHERE label IN (0, 1, 2) ORDER BY score DESC, vec_id LIMIT 10
""")
def filter_after_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetches twice the rows, then filters: may return fewer than there are."""
    held = table(spark, sf_dir, "embeddings")
    best = vector.top_k(held, _query_vector(spark, sf_dir), 20)
    return best.join(held.select("vec_id", "label"), "vec_id").where("label in (0, 1, 2)").orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


LISTS = f"""
v AS (SELECT vec_id AS item_id, {COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 100),
{POSTINGS},
x AS (SELECT doc_id % 500 AS item_id, max(round(s, 6)) AS score FROM (SELECT doc_id, sum({PART}) AS s FROM tf JOIN df USING (term), st WHERE term IN {sql_list(WORDS)} GROUP BY doc_id HAVING sum({PART}) > 0) GROUP BY 1 ORDER BY score DESC, item_id LIMIT 100),
lists AS (SELECT 'vector' AS list, * FROM v UNION ALL SELECT 'lexical', * FROM x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY score DESC, item_id) AS rank FROM lists),
norm AS (SELECT list, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS score FROM lists WINDOW w AS (PARTITION BY list))
"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' hits for one question; documents and vectors share item ids here."""
    near = vector.top_k(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 100).select(F.lit("vector").alias("list"), F.col("vec_id").alias("item_id"), "score")
    hits = bm25.scores(table(spark, sf_dir, "documents"), ASKED, phrases=False, proximity=False)
    lexical = hits.groupBy((F.col("doc_id") % 500).alias("item_id")).agg(F.max(F.round("score", 6)).alias("score")).orderBy(F.desc("score"), "item_id").limit(100)
    return near.unionByName(lexical.select(F.lit("lexical").alias("list"), "item_id", "score")).withColumn("query_id", F.lit(1))


@query(f"WITH {LISTS} SELECT item_id, round(sum(1 / (60 + rank)), 6) AS score FROM ranked GROUP BY 1")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(_lists(spark, sf_dir)).select("item_id", F.round("score", 6).alias("score"))


@query(f"WITH {LISTS} SELECT item_id, round(sum(score * CASE list WHEN 'vector' THEN 0.7 ELSE 0.3 END), 6) AS score FROM norm GROUP BY 1")
def linear_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.linear(_lists(spark, sf_dir), {"vector": fusion.VECTOR_WEIGHT, "lexical": fusion.LEXICAL_WEIGHT})
    return fused.select("item_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {LISTS}, o AS (
SELECT item_id, max(rank) FILTER (list = 'vector') AS vector_rank, max(rank) FILTER (list = 'lexical') AS lexical_rank,
       max(score) FILTER (list = 'vector') AS vector_score, max(score) FILTER (list = 'lexical') AS lexical_score, round(sum(1 / (60 + rank)), 6) AS score
FROM ranked GROUP BY 1)
SELECT item_id, vector_rank::INT AS vector_rank, lexical_rank::INT AS lexical_rank, vector_score, lexical_score, score FROM o
""")
def hybrid_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.explain(_lists(spark, sf_dir)).drop("query_id").withColumn("score", F.round("score", 6))


@query(f"WITH {LISTS}, f AS (SELECT item_id, round(sum(1 / (60 + rank)), 6) AS score FROM ranked GROUP BY 1) SELECT item_id, score FROM f WHERE score >= 0.01 ORDER BY score DESC, item_id LIMIT 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.finished(fusion.reciprocal_rank(_lists(spark, sf_dir)).withColumn("score", F.round("score", 6)), 10, 0.01)
    return fused.select("item_id", "score")


EXAMPLES = [
    "What is the latest release?", "How to set up the service and the client and the proxy", "error code in the login function", "documents similar to this concept", "compare red versus blue",
    "name of the owner", "Why does this happen", "who is it and what is it", "updated guide in 2024 for the api", "one two three four five six seven eight nine ten eleven", "short one", "various and multiple aspects of a thing?",
    "these are words that go on and on for a long while so that there are more than twenty of them in the whole question text ok",
]
ASK = "asked AS (SELECT item_id::BIGINT AS query_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-k - 1}::BIGINT, '{t}')" for k, t in enumerate(EXAMPLES)) + ") e(query_id, text))"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(EXAMPLES)], "query_id long, text string")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text").unionByName(own)


@query(f"""
WITH {ASK} SELECT query_id, CASE
 WHEN regexp_matches(lower(text), 'name|title|called|specific') THEN 0.5
 WHEN regexp_matches(lower(text), 'similar|related|concept|meaning|like') THEN 0.8
 WHEN regexp_matches(lower(text), 'error|code|function|method|api') THEN 0.4
 WHEN len({SQL_WORDS.format('text')}) > 10 THEN 0.8 WHEN len({SQL_WORDS.format('text')}) <= 3 THEN 0.4 ELSE 0.7 END::DOUBLE AS vector_weight FROM asked
""")
def adaptive_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", fusion.adaptive_weights(F.col("text")).alias("vector_weight"))


@query(f"WITH {LISTS} SELECT item_id, round(sum(score * CASE list WHEN 'vector' THEN 0.7 ELSE 0.3 END), 6) AS score FROM norm GROUP BY 1")
def adaptive_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = fusion.adaptive_weights(F.lit(ASKED))
    return fusion.linear(_lists(spark, sf_dir), {"vector": weight, "lexical": 1 - weight}).select("item_id", F.round("score", 6).alias("score"))


# The patterns that speak for each type of question, in the order in which ties are settled.
QUERY_PATTERNS = {
    "simple_factual": ["what is", "who is", "when was", "where is", "define", "explain"],
    "complex_analytical": ["analyze", "compare and contrast", "why does", "how does.*work", "what are the implications", "what factors"],
    "multi_faceted": ["and\\b.*\\band", "or\\b.*\\bor", "multiple", "various", "all.*aspects"],
    "procedural": ["how to", "steps to", "process for", "instructions", "guide"],
    "comparison": ["vs", "versus", "compare", "difference between", "better than", "similar to"],
    "temporal": ["recent", "latest", "updated", "current", "today", "yesterday", "last week", "in [0-9]+"],
}
#: top_k, rerank_top_n, mmr, temperature of each type.
QUERY_PARAMS = {
    "simple_factual": (25, 10, False, 0.0),
    "complex_analytical": (50, 25, True, 0.1),
    "multi_faceted": (75, 35, True, 0.2),
    "procedural": (30, 15, False, 0.0),
    "comparison": (60, 30, True, 0.1),
    "temporal": (40, 20, False, 0.0),
}


def query_type(text: Column) -> Column:
    low = F.lower(text)
    scores = {k: sum((F.regexp_count(low, F.lit(f"\\b{p}\\b")) for p in ps), F.lit(0)) for k, ps in QUERY_PATTERNS.items()}
    best = F.greatest(*scores.values())
    chosen = F.coalesce(*[F.when(s == best, F.lit(k)) for k, s in scores.items()])
    unclear = F.when((F.size(T.words(text)) > 5) & F.contains(text, F.lit("?")), "complex_analytical").otherwise("simple_factual")
    return F.when(best == 0, unclear).otherwise(chosen)


_COUNTS = {k: " + ".join(f"len(regexp_extract_all(lower(text), '\\b{p}\\b'))" for p in ps) for k, ps in QUERY_PATTERNS.items()}
TYPED = f"{ASK}, c AS (SELECT query_id, text, {', '.join(f'{v} AS {k}' for k, v in _COUNTS.items())} FROM asked), ty AS (SELECT query_id, text, CASE WHEN greatest({', '.join(_COUNTS)}) = 0 THEN CASE WHEN len({SQL_WORDS.format('text')}) > 5 AND contains(text, '?') THEN 'complex_analytical' ELSE 'simple_factual' END {' '.join(f'WHEN {k} = greatest({', '.join(_COUNTS)}) THEN {chr(39)}{k}{chr(39)}' for k in _COUNTS)} END AS query_type FROM c)"


@query(f"WITH {TYPED} SELECT query_id, query_type FROM ty")
def query_type_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", query_type(F.col("text")).alias("query_type"))


@query(f"WITH {ASK} SELECT query_id, array_to_string(list_filter({SQL_TOKENS.format('text')}, lambda x, i: length(x) > 2 AND x NOT IN {sql_list(T.QUERY_STOPWORDS)} AND list_position({SQL_TOKENS.format('text')}, x) = i)[1:10], ' ') AS keywords FROM asked")
def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", F.array_join(T.query_keywords("text"), " ").alias("keywords"))


def _case(at: int, kind: str) -> str:
    return "CASE query_type " + " ".join(f"WHEN '{k}' THEN {v[at]}" for k, v in QUERY_PARAMS.items()) + f" END::{kind}"


@query(f"""
WITH {TYPED}, n AS (SELECT query_id, query_type, len({SQL_WORDS.format('text')}) AS words FROM ty)
SELECT query_id, query_type, CASE WHEN words > 20 THEN least({_case(0, 'DOUBLE')} * 1.5, 100) WHEN words < 5 THEN greatest({_case(0, 'DOUBLE')} * 0.7, 15) ELSE {_case(0, 'DOUBLE')} END::DOUBLE AS top_k,
       {_case(1, 'INT')} AS rerank_top_n, words > 20 OR {_case(2, 'BOOLEAN')} AS mmr, {_case(3, 'DOUBLE')} AS temperature FROM n
""")
def query_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _asked(spark, sf_dir).select("query_id", query_type(F.col("text")).alias("query_type"), F.size(T.words("text")).alias("words"))
    pick = lambda at: F.coalesce(*[F.when(F.col("query_type") == k, F.lit(v[at])) for k, v in QUERY_PARAMS.items()])
    k = pick(0).cast("double")
    top_k = F.when(F.col("words") > 20, F.least(k * 1.5, F.lit(100.0))).when(F.col("words") < 5, F.greatest(k * 0.7, F.lit(15.0))).otherwise(k)
    return typed.select("query_id", "query_type", top_k.alias("top_k"), pick(1).alias("rerank_top_n"), ((F.col("words") > 20) | pick(2)).alias("mmr"), pick(3).alias("temperature"))


def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hits that are good and differ from one another, chosen one by one."""
    docs = table(spark, sf_dir, "documents")
    hits = bm25.search(docs, ASKED, 150, phrases=False, proximity=False).select("doc_id", F.round("score", 6).alias("score"))
    found = hits.join(docs.select("doc_id", F.array_distinct(T.words(F.lower("text"))).alias("words")), "doc_id").withColumn("query_id", F.lit(1).cast("long"))
    return vector.mmr(found, 10).select("doc_id", "mmr_rank")


QUERIES["mmr_select"] = mmr_select
ORACLES["mmr_select"] = f"""WITH RECURSIVE h AS ({TOPK.replace('LIMIT 10', 'LIMIT 30')}), c AS (SELECT h.doc_id, score, row_number() OVER (ORDER BY score DESC, h.doc_id) AS k, list_distinct({SQL_WORDS.format('lower(text)')}) AS w FROM h JOIN documents d ON d.doc_id = h.doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, coalesce(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0.0) AS s FROM c a JOIN c b ON a.doc_id <> b.doc_id),
r AS (SELECT 1 AS n, [(SELECT doc_id FROM c WHERE k = 1)] AS picked WHERE EXISTS (SELECT 1 FROM c) UNION ALL
SELECT n + 1, list_append(picked, best) FROM (SELECT n, picked, (SELECT arg_max(doc_id, (v, -k)) FROM (SELECT c.doc_id, k, round(0.7 * score + 0.3 * (1 - max(s)), 9) AS v FROM c JOIN x ON x.a = c.doc_id WHERE list_contains(picked, x.b) AND NOT list_contains(picked, c.doc_id) GROUP BY c.doc_id, k, score)) AS best FROM r WHERE n < 10) WHERE best IS NOT NULL)
SELECT unnest(picked) AS doc_id, unnest(range(1, n + 1))::INT AS mmr_rank FROM (SELECT * FROM r ORDER BY n DESC LIMIT 1)"""
