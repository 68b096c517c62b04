"""Filters over metadata, histories of records, deliveries and compositions of other operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_date_range(df: DataFrame, column: str, start: str, end: str, keep_missing: bool = False) -> DataFrame:
    """Rows whose time lies between start and end, both included. A row without a time fails in the store (the
    predicate reaches the scan) and passes where hits are filtered after a search (keep_missing)."""
    held = F.col(column).between(F.lit(start).cast(df.schema[column].dataType), F.lit(end).cast(df.schema[column].dataType))
    return df.where(F.col(column).isNull() | held) if keep_missing else df.where(held)


def throughput(events: DataFrame, ts: str, minutes: int = 60) -> DataFrame:
    """One row: events a second between the first and last of the newest `minutes`; 0 for fewer than two."""
    newest = events.agg(F.max(F.unix_micros(ts)).alias("now"))  # one row
    recent = events.select(F.unix_micros(ts).alias("at")).join(F.broadcast(newest)).where(F.col("at") >= F.col("now") - minutes * 60_000_000)
    span = (F.max("at") - F.min("at")) / 1_000_000
    return recent.agg(F.count("*").alias("n"), F.coalesce(F.when((F.count("*") > 1) & (span > 0), F.count("*") / span), F.lit(0.0)).alias("per_second"))


def mean_of_each(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows, and each column's mean."""
    return df.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def audit_trail(history: DataFrame, ids: list, key: str = "record_id") -> DataFrame:
    """The stages of these records in order of time; history (key, ts, stage) is only ever appended to."""
    return history.where(F.col(key).isin(ids)).orderBy(key, "ts", "stage")


def latest_versions(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key; each task keeps one row of a key before the shuffle."""
    rest = [c for c in updates.columns if c != key]
    newest = updates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(key, *[F.col("row")[c].alias(c) for c in rest])


def tier(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a string column as sha256=<hex>: two digests around padded keys, in the JVM."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256))


def delivery_log(attempts: DataFrame, most: int = 3) -> DataFrame:
    """attempts (delivery_id, attempt: from 1, code, ms) -> one row per delivery: attempts made (up to `most`, none after
    a success), the final status, and the seconds waited between them (1, 2, 4, ... up to 30)."""
    tried = attempts.where(F.col("attempt") <= most)
    ok = F.col("code").between(200, 299)
    first_ok = F.min(F.when(ok, F.col("attempt")))
    made = F.coalesce(first_ok, F.max("attempt"))
    found = tried.groupBy("delivery_id").agg(made.alias("n_attempts"), F.when(first_ok.isNotNull(), "success").otherwise("failed").alias("status"))
    waits = F.aggregate(F.sequence(F.lit(1), F.col("n_attempts").cast("int")), F.lit(0.0), lambda s, n: s + F.when(n < F.col("n_attempts"), F.least(F.pow(F.lit(2.0), n - 1), F.lit(30.0))).otherwise(0.0))
    return found.withColumn("waited_s", waits)


def duplicate_levels(docs: DataFrame, exact: DataFrame, near: DataFrame, semantic: DataFrame) -> DataFrame:
    """doc_id, level: the first level at which a document has a duplicate. exact: doc_ids with an earlier copy; near and
    semantic: doc_id, n_links to any other document."""
    has = lambda df, name: df.where("n_links > 0").select("doc_id", F.lit(True).alias(name))
    joined = docs.select("doc_id").join(exact.select("doc_id", F.lit(True).alias("e")), "doc_id", "left").join(has(near, "n"), "doc_id", "left").join(has(semantic, "s"), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("e"), "exact").when(F.col("n"), "near").when(F.col("s"), "semantic").otherwise("none").alias("level"))


def create_collection(df: DataFrame, name: str) -> bool:
    """A table for df's rows unless there is one; says whether it was made."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    df.write.saveAsTable(name)
    return True


def drop_collection(spark, name: str) -> bool:
    held = spark.catalog.tableExists(name)
    if held:
        spark.sql(f"DROP TABLE {name}")
    return held


def collection_info(spark, name: str) -> dict:
    """Whether it exists, how many rows and which columns it has."""
    if not spark.catalog.tableExists(name):
        return {"exists": False, "count": 0, "columns": []}
    df = spark.table(name)
    return {"exists": True, "count": df.count(), "columns": df.columns}
