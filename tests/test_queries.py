"""Every registered query on the smallest tables: against SQL where there is SQL, and its plan."""

from __future__ import annotations

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry
from areal_exposure.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
UNWANTED = r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def text(x) -> str:
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return "nan" if math.isnan(x) else repr(float(x))
    return str(x)


def canonical(rows) -> list:
    return sorted(tuple(text(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    assert got
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(UNWANTED, plan)
    sql = entry.oracle_sql().get(name)
    if sql:
        names = ", ".join(f'"{c}"' for c in columns)
        assert sorted(duck.sql(sql).columns) == columns
        assert got == canonical(duck.sql(f"select {names} from ({sql})").fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["chem_code"] for r in rows} == {"573", "136"}
    unused = [r for r in rows if r["county"].startswith("REGION")]
    assert len(unused) == 10
    assert all(r[f"y{y}"] == 0 for r in unused for y in range(1996, 2001))


def test_only_round_overlaps_lack_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"school_apportion_round"}
