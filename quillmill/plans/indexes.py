"""Queries over persisted indexes, with their SQL where the answer is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.operators import lexical_index, vector_index
from quillmill.operators.storage import new_path
from quillmill.plans.common import table
from quillmill.plans.retrieval import ASKED, bm25_phrase_proximity, bm25_topk

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The documents without the toxic ones, for the SQL of a query over `documents`.
CLEAN = "clean AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"


def _over_clean(sql: str) -> str:
    return sql.replace("WITH ", f"WITH {CLEAN}, ", 1).replace("FROM documents WHERE length", "FROM clean WHERE length")


def _maintained(spark: SparkSession, sf_dir: str) -> str:
    """An index over all documents, from which those labelled toxic are then removed."""
    path = new_path(spark, "lexical")
    lexical_index.build(table(spark, sf_dir, "documents"), path, buckets=16, files=2)
    lexical_index.remove(spark, path, table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"))
    return path


def _sql_of(name: str) -> str:
    from quillmill.plans import retrieval

    return retrieval.ORACLES[name]


@query(_over_clean(_sql_of(bm25_topk.__name__)))
def index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_index.search(spark, _maintained(spark, sf_dir), ASKED, 10, phrases=False, proximity=False)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(_over_clean(_sql_of(bm25_phrase_proximity.__name__)))
def index_phrase_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_index.search(spark, _maintained(spark, sf_dir), '"for orin" stanin lyon', 25)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("bm25", "phrase", "proximity", "score")])


@query(_over_clean(_sql_of("bm25_term_stats")))
def index_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term counts of the living documents, from what each change of the index wrote."""
    return lexical_index.document_frequencies(spark, _maintained(spark, sf_dir))


@query(None)
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector's ten nearest of all vectors, through the index; tests measure its recall."""
    held = table(spark, sf_dir, "embeddings")
    cells, path = vector_index.fit(held), new_path(spark, "vectors")
    if cells is None:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    vector_index.build(held, cells, path)
    return vector_index.search(spark, path, cells, held.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10)
