"""Table operators: summaries, column profiles, row chunks with overlap, groups, rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, column, value (as text) of every cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(key, F.explode(cells).alias("cell")).select(key, "cell.*")


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, n_rows, non_null, n_unique; one pass over the table."""
    kinds = dict(df.dtypes)
    counted = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in columns], *[F.countDistinct(c).alias(f"u_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.col(f"n_{c}").alias("non_null"), F.col(f"u_{c}").alias("n_unique")) for c in columns])
    return counted.select("n_rows", F.explode(each).alias("x")).select("x.*", "n_rows")


def value_distribution(df: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """column, value, n, percent of columns with at most `most` distinct values. Counts are made per task first."""
    counts = unpivoted(df, columns[0], columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    per = counts.groupBy("column").agg(F.count("value").alias("n_unique"), F.sum("n").alias("n_rows")).where(F.col("n_unique") <= most)
    return counts.where("value is not null").join(F.broadcast(per), "column").select("column", "value", "n", F.round(100 * F.col("n") / F.col("n_rows"), 6).alias("percent"))


def numbered(df: DataFrame, order: list[str], ranges: int = 64) -> DataFrame:
    """df with row_no from 0 in this order, whose first column is a number. Approximate quantiles of that column, found
    once, cut the rows into ranges; each range numbers its own rows and is moved by how many come before it, so no task
    holds all rows and the cut is the same however often it is computed."""
    cuts = df.agg(F.percentile_approx(order[0], [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    held = df.withColumn("_p", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order[0]))) if cuts else F.lit(0))
    sizes = held.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row for each range
    inner = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return held.join(F.broadcast(before), "_p").withColumn("row_no", (F.col("_before") + inner).cast("long")).drop("_p", "_before")


def row_chunks(rows: DataFrame, size: int = 20, overlap: int = 2) -> DataFrame:
    """rows (row_no) with chunk_no: the last `overlap` rows of a chunk are also the first of the next one."""
    own = F.floor(F.col("row_no") / size)
    also = F.when(F.col("row_no") % size >= size - overlap, F.array(own, own + 1)).otherwise(F.array(own))
    total = rows.agg(F.max(own).alias("_last"))
    return rows.withColumn("chunk_no", F.explode(also)).crossJoin(F.broadcast(total)).where(F.col("chunk_no") <= F.col("_last")).drop("_last")


def chunk_ranges(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("chunk_no").agg((F.min("row_no") + 1).alias("first_row"), (F.max("row_no") + 1).alias("last_row"), F.count("*").alias("n_rows")).withColumn("has_overlap", F.col("chunk_no") > 0)


def row_text(columns: list[str]) -> Column:
    """A row as `name: value` lines; null and empty are N/A."""
    cell = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("N/A")))
    return F.concat_ws("\n", *[cell(c) for c in columns])


def groups(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))


def header_union(objects: DataFrame, column: str) -> DataFrame:
    """The sorted names that JSON objects in a column have."""
    return objects.select(F.explode(F.json_object_keys(column)).alias("name")).distinct().orderBy("name")
