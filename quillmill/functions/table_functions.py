"""Chunkers and table regions as table functions of SQL.

    table_functions.register(spark)
    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk_fixed(d.text, 512, 64) c
    SELECT * FROM chunk_table(TABLE(SELECT doc_id, text FROM documents), 'text', 'sentences')

`chunk_table` is polymorphic: its result has all columns of the table that it is given, whatever these are, and those of
the chunks."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillmill.operators import chunks
from quillmill.sources import text_tables

_CUTS = {"fixed": lambda t: [x for _, x in chunks.fixed(t)], "sentences": chunks.sentences, "paragraphs": chunks.paragraphs}


@udtf(returnType="chunk_index int, start_index long, content string")
class ChunkFixed:
    """chunk_fixed(text, size, overlap): windows of `size` tokens."""

    def eval(self, text: str, size: int, overlap: int):
        for k, (start, content) in enumerate(chunks.fixed(text or "", size, overlap)):
            yield k, start, content


@udtf(returnType="chunk_index int, content string")
class ChunkSentences:
    """chunk_sentences(text, size): sentences put together up to `size` tokens."""

    def eval(self, text: str, size: int):
        yield from enumerate(chunks.sentences(text or "", size))


@udtf(returnType="first_line int, last_line int, format string")
class TableRegions:
    """table_regions(text): where tables stand in a text, by lines from 0, the last one included."""

    def eval(self, text: str):
        for first, end, kind in text_tables.regions(text or ""):
            yield first, end - 1, kind


@udtf
class ChunkTable:
    """chunk_table(TABLE(...), column, how): the table's columns, chunk_index and content."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.names = analyzed.schema.names[:-2] if analyzed else []

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, how: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.names:
            raise ValueError("chunk_table(TABLE(...), column, how): the column must be one of the table")
        if how.value not in _CUTS:
            raise ValueError(f"how is one of {', '.join(_CUTS)}")
        kind = StructType([*rows.dataType.fields]).add("chunk_index", IntegerType()).add("content", StringType())
        return AnalyzeResult(kind)

    def eval(self, row: Row, column: str, how: str):
        for k, content in enumerate(_CUTS[how](row[column] or "")):
            yield (*row, k, content)


FUNCTIONS = {"chunk_fixed": ChunkFixed, "chunk_sentences": ChunkSentences, "table_regions": TableRegions, "chunk_table": ChunkTable}


def register(spark: SparkSession) -> None:
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
