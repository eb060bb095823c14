"""Every registered text query runs over the smallest tables and gives the columns it promises."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from areal_exposure.llm import catalogue

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6_near_copies": "doc_id bigint, class_id bigint",
    "op7_versions": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op12_token_automaton": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_disclosure": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
}
OTHER_COLUMNS = {
    "op11_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_ranked_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}
NATIVE = ("op4_benchmark_leaks", "op7_versions", "op10_disclosure")
UNWANTED = "CartesianProduct|BroadcastNestedLoopJoin"
PYTHON = "Python|Pandas|Arrow"


def test_all_are_registered():
    assert set(catalogue.queries()) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert [f"{c} {t}" for c, t in df.dtypes] == COLUMNS[name].split(", ")
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
        assert df.agg(F.count("*"), F.count_distinct("doc_id")).first() == (docs, docs)
    elif name in OTHER_COLUMNS:
        assert [f"{c} {t}" for c, t in df.dtypes] == OTHER_COLUMNS[name].split(", ")
    else:
        assert "doc_id" in df.columns and df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(UNWANTED, plan)
    assert name not in NATIVE or not re.search(PYTHON, plan)
