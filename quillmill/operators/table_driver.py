"""Tables to chunks, and texts with tables inside to one set of linked chunks.

`table_chunks` takes any number of tables of any length at once, as rows (table_id, row_no, cells): a summary chunk for each table
(the parent), chunks of rows that share their last rows with the next one, and a chunk for each column. A table's rows are
grouped by chunk and its cells are counted by value before anything is gathered, so a long table is no single task.

`mixed_chunks` finds the tables that stand in a text, subtracts their lines from it, cuts what is left into parents and children,
and links every table chunk to its table's summary (`parent_id`) and to the first parent of the text (`main_parent`).

Defined results: of columns with one name the last counts, at the place of the first; rows of another length than the header's go;
a null text has no chunks; a text that is all table has no parents, and its tables' main_parent is null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators import chunks
from quillmill.operators.storage import stored
from quillmill.sources.text_tables import regions

ROWS, OVERLAP, DISTINCT, SAMPLES, SHOWN = 20, 2, 20, 10, 5
_BLANK = "^[ \\t\\r\\x0B\\f]+|[ \\t\\r\\x0B\\f]+$"


def split_texts(docs: DataFrame) -> DataFrame:
    """doc_id, table_no (null: the text without its tables), format, lines, content of what a text consists of."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                lines = (text.as_py() or "").split("\n")
                left, at = [], 0
                for k, (first, end, kind) in enumerate(regions("\n".join(lines))):
                    rows.append((doc_id, k, kind, lines[first:end], None))
                    left += lines[at:first]
                    at = end
                rows.append((doc_id, None, None, None, "\n".join(left + lines[at:])))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], ["doc_id", "table_no", "format", "lines", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, table_no int, format string, lines array<string>, content string")


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def parsed(parts: DataFrame) -> DataFrame:
    """parts with lines and format -> doc_id, table_no, format, headers, rows (arrays of cells)."""
    lines = F.filter(F.transform("lines", _bare), lambda x: x != "")
    pipes = F.filter(lines, lambda x: ~x.rlike("^[|+:\\-\\s]+$"))
    by_pipe = F.transform(pipes, lambda x: F.transform(F.split(F.btrim(x, F.lit("|")), "\\|"), _bare))
    by_gap = F.transform(lines, lambda x: F.split(x, "\\t+|\\s{2,}"))
    cut = parts.where("table_no is not null").select("doc_id", "table_no", "format", F.when(F.col("format") == "pipes", by_pipe).otherwise(by_gap).alias("cut"))
    head = F.get("cut", F.lit(0))
    body = F.filter(F.slice("cut", 2, F.greatest(F.lit(0), F.size("cut") - 1)), lambda r: F.size(r) == F.size(head))
    return cut.where(F.size("cut") > 0).select("doc_id", "table_no", "format", head.alias("headers"), body.alias("rows"))


def table_chunks(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """tables (table_id, format, source, headers), rows (table_id, row_no from 0, cells) -> table_id, chunk_id, parent_id,
    chunk_type, content."""
    names = F.array_distinct("headers")
    tables = stored(tables.withColumn("names", names).withColumn("places", F.transform(names, lambda n: F.size("headers") - F.array_position(F.reverse("headers"), n))), "tables")
    values = F.transform("places", lambda p: F.get("cells", p.cast("int")))
    rows = stored(rows.join(tables.select("table_id", "places"), "table_id").select("table_id", "row_no", values.alias("cells")), "table_rows")
    counted = rows.groupBy("table_id").agg(F.count("*").alias("n_rows"))
    tables = stored(tables.join(counted, "table_id", "left").select("table_id", "format", "source", "names", F.coalesce("n_rows", F.lit(0)).alias("n_rows")), "tables")
    by_value = rows.select("table_id", "row_no", F.posexplode("cells").alias("at", "value")).groupBy("table_id", "at", "value").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    by_value = stored(by_value, "cell_values")
    facts = by_value.groupBy("table_id", "at").agg(F.count("value").alias("n_unique"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("non_null"))
    columns = tables.select("table_id", "source", "n_rows", "names", F.posexplode("names").alias("at", "name")).join(facts, ["table_id", "at"], "left").fillna(0, ["n_unique", "non_null"])
    columns = stored(columns, "columns")
    return _summaries(tables, rows, columns).unionByName(_row_chunks(tables, rows)).unionByName(_column_chunks(columns, rows, by_value))


def _id(kind: str) -> Column:
    return F.concat("table_id", F.lit(kind))


def _lines(array: str | Column) -> Column:
    """The texts of gathered structs (order, text), a line each."""
    return F.array_join(F.transform(F.array_sort(array), lambda x: x["text"]), "\n")


def _summaries(tables: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    line = F.concat(F.lit("- "), "name", F.lit(": string ("), F.col("non_null").cast("string"), F.lit(" non-null, "), F.col("n_unique").cast("string"), F.lit(" unique)"))
    info = columns.groupBy("table_id").agg(_lines(F.collect_list(F.struct("at", line.alias("text")))).alias("info"))
    pairs = F.array_join(F.zip_with("names", "cells", lambda k, v: F.concat(k, F.lit("="), F.coalesce(v, F.lit("N/A")))), ", ")
    shown = rows.where(F.col("row_no") < SHOWN).join(tables.select("table_id", "names"), "table_id").select("table_id", "row_no", F.concat(F.lit("Row "), (F.col("row_no") + 1).cast("string"), F.lit(": "), pairs).alias("text"))
    first = shown.groupBy("table_id").agg(_lines(F.collect_list(F.struct("row_no", "text"))).alias("first"))
    held = tables.join(info, "table_id", "left").join(first, "table_id", "left")
    content = F.concat(
        F.lit("Table Summary: "), F.col("n_rows").cast("string"), F.lit(" rows × "), F.size("names").cast("string"), F.lit(" columns\nFormat: "), "format", F.lit("\nSource: "), "source",
        F.lit("\n\nColumns: "), F.array_join("names", ", "), F.lit("\n\nColumn Information:\n"), F.coalesce("info", F.lit("")), F.lit("\n\nFirst 5 rows:"), F.coalesce(F.concat(F.lit("\n"), "first"), F.lit("")),
    )
    return held.select("table_id", _id("_table_summary").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("table_summary").alias("chunk_type"), content.alias("content"))


def _row_chunks(tables: DataFrame, rows: DataFrame) -> DataFrame:
    own = F.floor(F.col("row_no") / ROWS)
    goes_on = (F.col("row_no") % ROWS >= ROWS - OVERLAP) & ((own + 1) * ROWS < F.col("n_rows"))
    placed = rows.join(tables.select("table_id", "names", "n_rows"), "table_id").withColumn("chunk_no", F.explode(F.when(goes_on, F.array(own, own + 1)).otherwise(F.array(own))))
    cells = F.array_join(F.zip_with("names", "cells", lambda k, v: F.concat(F.lit("  "), k, F.lit(": "), F.coalesce(v, F.lit("N/A")))), "\n")
    text = F.concat(F.lit("Row "), (F.col("row_no") + 1).cast("string"), F.lit(":\n"), cells)
    # at most ROWS + OVERLAP rows a chunk
    gathered = placed.groupBy("table_id", "chunk_no", "names", "n_rows").agg(F.min("row_no").alias("low"), F.max("row_no").alias("high"), F.array_sort(F.collect_list(F.struct("row_no", text.alias("text")))).alias("held"))
    head = F.concat(F.lit("Table rows "), (F.col("low") + 1).cast("string"), F.lit(" to "), (F.col("high") + 1).cast("string"), F.lit(" of "), F.col("n_rows").cast("string"), F.lit("\nColumns: "), F.array_join("names", ", "))
    content = _bare(F.concat(head, F.lit("\n\n"), F.array_join(F.transform("held", lambda x: x["text"]), "\n\n")))
    name = F.concat("table_id", F.lit("_rows_"), (F.col("chunk_no") * ROWS).cast("string"), F.lit("_"), ((F.col("chunk_no") + 1) * ROWS).cast("string"))
    return gathered.select("table_id", name.alias("chunk_id"), _id("_table_summary").alias("parent_id"), F.lit("table_rows").alias("chunk_type"), content.alias("content"))


def _column_chunks(columns: DataFrame, rows: DataFrame, by_value: DataFrame) -> DataFrame:
    few = by_value.join(columns.where(F.col("n_unique") <= DISTINCT).select("table_id", "at", "n_rows"), ["table_id", "at"]).where("value is not null")
    share = F.format_string("%.1f", F.round(100 * F.col("n") / F.col("n_rows"), 1))
    line = F.concat(F.lit("  "), "value", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), share, F.lit("%)"))
    spread = few.groupBy("table_id", "at").agg(_lines(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", line.alias("text")))).alias("spread"))
    sampled = rows.where(F.col("row_no") < SAMPLES).select("table_id", "row_no", F.posexplode("cells").alias("at", "value"))
    sampled = sampled.withColumn("text", F.concat(F.lit("  Row "), (F.col("row_no") + 1).cast("string"), F.lit(": "), F.coalesce("value", F.lit("N/A"))))
    samples = sampled.groupBy("table_id", "at").agg(_lines(F.collect_list(F.struct("row_no", "text"))).alias("samples"))
    held = columns.join(spread, ["table_id", "at"], "left").join(samples, ["table_id", "at"], "left")
    text = lambda c: F.col(c).cast("string")
    more = F.when(F.col("n_rows") > SAMPLES, F.concat(F.lit("\n  ... and "), (F.col("n_rows") - SAMPLES).cast("string"), F.lit(" more values"))).otherwise("")
    content = F.concat(
        F.lit("Column Analysis: "), "name", F.lit("\nTable: "), "source", F.lit("\nPosition: Column "), (F.col("at") + 1).cast("string"), F.lit(" of "), F.size("names").cast("string"),
        F.lit("\n\nStatistics:\n- Data type: string\n- Non-null values: "), text("non_null"), F.lit("/"), text("n_rows"), F.lit("\n- Unique values: "), text("n_unique"), F.lit("\n\n"),
        F.when(F.col("n_unique") <= DISTINCT, F.concat(F.lit("Value distribution:\n"), F.coalesce(F.concat("spread", F.lit("\n")), F.lit("")), F.lit("\n"))).otherwise(""),
        F.lit("Sample values (first "), F.least(F.lit(SAMPLES), F.col("n_rows")).cast("string"), F.lit("):"), F.coalesce(F.concat(F.lit("\n"), "samples"), F.lit("")), more,
    )
    return held.select("table_id", F.concat(_id("_column_"), F.col("name")).alias("chunk_id"), _id("_table_summary").alias("parent_id"), F.lit("table_column").alias("chunk_type"), content.alias("content"))


def mixed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, table_id (null for the text's own chunks), chunk_id, parent_id, main_parent, chunk_type, content."""
    parts = stored(split_texts(docs), "parts")
    text = chunks.with_ids(chunks.chunk(parts.where("table_no is null").select("doc_id", F.col("content").alias("text")), "hierarchical"))
    text = stored(text.select("doc_id", "chunk_id", "parent_id", F.when(F.col("level") == 0, "parent").otherwise("child").alias("chunk_type"), "content", "level", "parent_index"), "text_chunks")
    found = stored(parsed(parts).withColumn("table_id", F.concat(F.col("doc_id").cast("string"), F.lit("_table_"), F.col("table_no").cast("string"))), "parsed")
    made = table_chunks(
        found.select("table_id", "format", F.lit("").alias("source"), "headers"),
        found.select("table_id", F.posexplode("rows").alias("row_no", "cells")).withColumn("row_no", F.col("row_no").cast("long")),
    )
    first = text.where("level = 0 and parent_index = 0").select("doc_id", F.col("chunk_id").alias("main_parent"))
    linked = made.join(found.select("table_id", "doc_id"), "table_id").join(first, "doc_id", "left")
    own = text.select("doc_id", F.lit(None).cast("string").alias("table_id"), "chunk_id", "parent_id", F.lit(None).cast("string").alias("main_parent"), "chunk_type", "content")
    return own.unionByName(linked.select("doc_id", "table_id", "chunk_id", "parent_id", "main_parent", "chunk_type", "content"))
