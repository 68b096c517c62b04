"""Embedding as a step that is plugged in: any function from a batch of texts to vectors, and a built-in one without a model.

`embed` calls the function once for each of a text's batches; `hashed` is a deterministic embedder of DataFrame functions: terms
are thrown into dimensions with a sign by their MD5, counted, and brought to length 1."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T


def embed(batched: DataFrame, call: Callable[[list[str]], list[list[float]]], key: str = "doc_id") -> DataFrame:
    """batched (key: long, text, batch_no: as a batch plan gives it) -> key, embedding. The texts of a batch go to the function
    in one call, in order of the key; batches run side by side. A batch is bounded by its plan; null texts are empty."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        vectors = call([t or "" for t in table["text"].to_pylist()])
        return pa.table({key: table[key], "embedding": pa.array(vectors, pa.list_(pa.float64()))})

    return batched.select("batch_no", F.col(key).cast("long").alias(key), "text").groupBy("batch_no").applyInArrow(run, f"{key} long, embedding array<double>")


def hashed(docs: DataFrame, width: int = 256, key: str = "doc_id") -> DataFrame:
    """key, dim, value: the dimensions of each text's vector that aren't 0. Texts without terms have none."""
    digest = F.md5("term")
    part = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("long")
    sign: Column = F.when(part(9, 1) % 2 == 0, 1).otherwise(-1)
    counts = docs.select(key, F.explode(T.terms("text")).alias("term")).groupBy(key, (part(1, 8) % width).alias("dim")).agg(F.sum(sign).alias("n")).where("n <> 0")
    length = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, key).select(key, "dim", (F.col("n") / F.col("length")).alias("value"))
