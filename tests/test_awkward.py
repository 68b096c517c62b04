"""Every query runs over tables with nulls in any column, empty texts and repeated rows, and over empty tables; where
there is SQL, its rows are the same."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmill import plans
from tests.test_oracles import rows_of

SF = Path("/root/testdata/sf0.001")
TABLES = ["customer", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Keys that stay without nulls: the time of an event and the numbers that stand for clocks and ids.
NULLS = {
    "documents": ["text", "lang", "source"],
    "events": ["props"],
    "conversations": ["text"],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "labels": ["quality", "toxic"],
    "customer": ["c_name", "c_mktsegment"],
    "lineitem": ["l_returnflag", "l_quantity"],
    "embeddings": ["label"],
}


def write(spark, folder, rows):
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet").limit(rows)
        for c in NULLS.get(t, []) if rows else []:
            df = df.withColumn(c, F.when(F.rand(7) < 0.85, F.col(c)))
        if t == "documents" and rows:
            df = df.withColumn("text", F.when(F.col("doc_id") % 11 == 3, "").otherwise(F.col("text")))
        if rows:
            df = df.withColumn("extra", F.lit("x"))
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    write(spark, folder, 60)
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write(spark, folder, 0)
    return folder


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_awkward_rows(spark, awkward, name):
    df = plans.queries()[name](spark, str(awkward))
    names = sorted(df.columns)
    got = df.select(*names).collect()
    if name in plans.oracles():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{awkward}/{t}.parquet/*.parquet'")
        columns = ", ".join(f'"{n}"' for n in names)
        assert rows_of(names, got) == rows_of(names, con.sql(f"SELECT {columns} FROM ({plans.oracles()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_empty_tables(spark, empty, name):
    plans.queries()[name](spark, str(empty)).collect()
