"""The operators as queries over the test tables, and SQL for checking those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal_exposure.llm import (
    benchmark_leaks,
    disclosure,
    language,
    near_copies,
    packing,
    phrases,
    quality,
    ranked_search,
    secret_scan,
    token_automaton,
    token_counts,
    token_files,
    versions,
)
from areal_exposure.llm.catalogue_sql import ORACLE_SQL
from areal_exposure.llm.common import documents, table
from areal_exposure.sources.scratch import shared_folder


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    token_files.write_ids(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.id_digests(token_files.read_ids(spark, folder))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(documents(spark, sf_dir))


def op7_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.fingerprints(documents(spark, sf_dir))


def language_model(docs: DataFrame) -> language.Model:
    return language.train(docs.where(~language.held_out(F.col("doc_id"))))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language_model(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def of_kinds(spans: str, *kinds: str) -> Column:
    """How many spans are of these kinds."""
    return F.size(F.filter(spans, lambda s: s["kind"].isin(*kinds))).cast("long")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secret_scan.find_secrets(docs, secret_scan.word_ranks(docs))
    counts = [of_kinds("spans", kind).alias(f"n_{kind}") for kind in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE))
    digest = F.sha2(secret_scan.span_text(base), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.disclosures(documents(spark, sf_dir))
    counts = [of_kinds("spans", kind).alias(f"n_{kind}") for kind in disclosure.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*disclosure.BASE))
    digest = F.sha2(disclosure.span_text(base), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), disclosure.span_text(F.col("spans")).alias("spans"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


def op12_token_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_automaton.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_packing,
        op2_token_counts,
        op3_quality,
        op4_benchmark_leaks,
        op5_token_files,
        op6_near_copies,
        op7_versions,
        op8_language,
        op9_secrets,
        op10_disclosure,
        op11_phrases,
        op12_token_automaton,
        op13_ranked_search,
    )
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
