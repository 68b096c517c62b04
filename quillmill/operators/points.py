"""Chunks of conversations as points of a store: flat rows, children and parents alike, each with its channel's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import chunks


def channel_points(texts: DataFrame, scheme: str = "chat", least: int = 100) -> DataFrame:
    """texts (channel, session, part, text) -> a point for each chunk of the texts of at least `least` characters: id, content,
    source, document_id, chunk_type, parent_id, hierarchy_level, start_index, end_index, token_count, char_count, channel,
    session, part. Every child's parent is a point; ids follow from the places, so storing points again changes nothing."""
    kept = texts.where(F.length("text") >= least).withColumn("document_id", F.concat_ws("|", "channel", F.col("session").cast("string"), F.col("part").cast("string")))
    keyed = kept.withColumn("doc_id", F.xxhash64("document_id"))
    made = chunks.chunk(keyed.select("doc_id", "text"), "hierarchical").join(keyed.drop("text"), "doc_id")
    place = lambda level, child: F.substring(F.sha2(F.concat_ws("|", "document_id", level.cast("string"), F.col("parent_index").cast("string"), child.cast("string")).cast("binary"), 256), 1, 16)
    inner: Column = F.col("level") == 1
    return made.select(
        place(F.col("level"), F.col("child_index")).alias("id"), "content", F.concat(F.lit(f"{scheme}://"), "channel").alias("source"), "document_id", F.when(inner, "child").otherwise("parent").alias("chunk_type"),
        F.when(inner, place(F.lit(0), F.lit(0))).alias("parent_id"), F.col("level").alias("hierarchy_level"), "start_index", (F.col("start_index") + F.length("content")).alias("end_index"),
        F.floor(F.length("content") / chunks.CHARS_PER_TOKEN).alias("token_count"), F.length("content").alias("char_count"), "channel", "session", "part",
    )
