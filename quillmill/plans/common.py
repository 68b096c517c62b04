"""What the query modules share: tables, and SQL pieces for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SQL_WORDS = "list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> '')"
SQL_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
SQL_ALL_TERMS = "list_filter(" + SQL_TOKENS + ", lambda x: regexp_full_match(x, '[a-z]{{2,}}'))"
SQL_TERMS = "list_filter(" + SQL_ALL_TERMS + f", lambda x: x NOT IN {sql_list(T.INDEX_STOPWORDS)})"

#: The kinds of source that stand in for the documents' sources, by the number in their name.
SOURCE_TYPES = ["documentation", "official_website", "github_repository", "wikipedia", "stackoverflow", "blog_post", "forum", "unknown"]


def with_source_type(docs: DataFrame) -> DataFrame:
    kinds = F.array(*map(F.lit, SOURCE_TYPES))
    number = F.coalesce(F.try_to_number(F.regexp_extract("source", "([0-9]+)$", 1), F.lit("99999")).cast("int"), F.lit(7))
    return docs.withColumn("source_type", F.get(kinds, F.pmod(number, F.lit(len(SOURCE_TYPES)))))


SQL_SOURCE_TYPE = "[" + ", ".join(f"'{x}'" for x in SOURCE_TYPES) + "][coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 7) % 8 + 1]"
