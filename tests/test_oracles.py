"""Every registered query with SQL gives the same rows in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillmill import plans

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF / t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    return sorted((repr([plain(v) for v in r]) for r in rows))


@pytest.mark.parametrize("name", sorted(plans.oracles()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, str(SF))
    names = sorted(df.columns)
    sql = plans.oracles()[name]
    assert names == sorted(duck.sql(sql).columns)
    columns = ", ".join(f'"{n}"' for n in names)
    assert rows_of(names, df.select(*names).collect()) == rows_of(names, duck.sql(f"SELECT {columns} FROM ({sql})").fetchall())
