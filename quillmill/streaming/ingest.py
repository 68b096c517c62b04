"""Incremental ingestion: micro-batches are merged into a table by key, with a committed high-water mark.

In the table's folder each batch is a folder `batch=N` of the newest row of each key in it, written over what a failed or
repeated run of the batch left, and `marks/batch=N` says that it is whole and up to which time it goes. Readers see marked
batches only, and of a key the row of greatest time (of equal ones, that of greatest content), so the order and the cut of the
batches don't matter: replaying any of them changes nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StructType


def _newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.col(at), F.xxhash64(*rest))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(key, *[F.col("row")[c].alias(c) for c in rest])


def ingest(rows: DataFrame, path: str, key: str = "id", at: str = "ts", checkpoint: str | None = None) -> StreamingQuery:
    """Starts a run over what the stream has (availableNow); rows without a key or time are left out."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = _newest(batch.where(F.col(key).isNotNull() & F.col(at).isNotNull()), key, at)
        newest.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        written = batch.sparkSession.read.schema(newest.schema).parquet(f"{path}/rows/batch={number}")
        written.agg(F.count("*").alias("n"), F.max(at).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start()


def _marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/marks")


def current(spark: SparkSession, path: str, schema: StructType, key: str = "id", at: str = "ts") -> DataFrame:
    """The table: the newest row of each key."""
    finished = [r.batch for r in _marks(spark, path).select("batch").distinct().collect()]
    held = spark.read.schema(StructType([*schema.fields]).add("batch", IntegerType())).parquet(f"{path}/rows").where(F.col("batch").isin(finished))
    return _newest(held.drop("batch"), key, at)


def high_water(spark: SparkSession, path: str):
    """The greatest time that is ingested, None before the first batch: where the next run goes on."""
    try:
        return _marks(spark, path).agg(F.max("mark")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newer(rows: DataFrame, mark, at: str = "ts") -> DataFrame:
    """What a source holds beyond the mark; the predicate reaches its scan."""
    return rows if mark is None else rows.where(F.col(at) > F.lit(mark))
