"""Helpers that the training-data operators share: scratch tables, the documents' columns, token caches."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a null doc_id counts as where ids are compared by size alone; it stays null in results.
NO_ID = 2**63 - 1

_scratch: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests, one
    machine) gets a folder of its own; on a cluster that would lie on each machine's own disk, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
        folder = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join both sides of which grow with the documents: by sorting, never by a broadcast. Spark judges a written table by its
    files, and long columns of small numbers take a few bytes a row there but dozens in the driver, where a broadcast is built."""
    return left.join(right.hint("merge"), on, how)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables made so far. Call it only when results that read them are written."""
    held = _scratch.get(spark.sparkContext.applicationId, [])
    while held:
        delete_path(spark, held.pop())


def ordered_id(*more: str) -> Column:
    """doc_id as a struct (none, id, ...) to be compared: a null doc_id comes after every other one."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *more)


def text_key(docs: DataFrame) -> Column:
    """Stands for a row's text where rows are told apart."""
    return F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))


def has_repeats(rows: DataFrame) -> bool:
    """Whether any (doc_id, key) occurs more than once."""
    return not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty()


def new_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name = f"_{name}"
    return name


def rows_that_stay(docs: DataFrame, stay: DataFrame, key: Column, repeated: bool) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id and key are in stay (id, key). repeated: some of these
    occur more than once, and one row of each stays."""
    mark, held_id, held_key = (new_name(docs, c) for c in ("row_key", "held_id", "held_key"))
    marked = docs.select("*", key.alias(mark))
    if repeated:
        marked = marked.dropDuplicates([c for c in docs.columns if c.lower() == "doc_id"] + [mark])
    held = stay.select(F.col("id").alias(held_id), F.col("key").alias(held_key))
    return met(marked, held, F.col("doc_id").eqNullSafe(F.col(held_id)) & (F.col(mark) == F.col(held_key)), "left_semi").drop(mark)


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (other columns, whatever their names, stay out of the way); a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def give_back() -> None:
    """Returns freed memory to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = worker_cache("malloc_trim", _find_trim)
    if trim:
        trim(0)


def _find_trim():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


_loaded: dict = {}


def worker_cache(key, make):
    """An object made once in each Python worker."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok
