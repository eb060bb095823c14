"""Exact quantiles, correlation and histogram against plain implementations."""

from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from areal_exposure.operators import stats as S

PROBS = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 0.99, 1.0)


def samples():
    rng = random.Random(5)
    return {
        "heavy": [10 ** rng.uniform(-6, 9) for _ in range(3000)],
        "signed": [rng.gauss(0, 5) for _ in range(2000)],
        "ties": [float(rng.choice([0, 0, 0, 1, 7])) for _ in range(1500)],
        "narrow": [1e6 + rng.random() * 1e-3 for _ in range(1000)],
        "one": [4.25],
        "two": [-1.0, 3.0],
    }


@pytest.mark.parametrize("few", [True, False])
def test_quantiles_are_exact(spark, few):
    data = samples()
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("heavy", None), ("none", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {(r["g"], r["prob"]): r["value"] for r in S.exact_quantiles(df, "v", PROBS, ["g"], few_groups=few).collect()}
    for g, vs in data.items():
        for p in PROBS:
            assert got[(g, p)] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)
    assert got[(None, 0.5)] == 2.0
    assert ("none", 0.5) not in got


def test_quantiles_without_groups(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert [r["value"] for r in S.exact_quantiles(df, "v", (0.0, 0.25, 1.0)).orderBy("prob").collect()] == [0.0, 25.0, 100.0]


def test_correlation_uses_complete_rows_only(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 3))
    m[:, 2] += m[:, 0]
    rows = [tuple(float(x) for x in r) + (5.0,) for r in m] + [(1.0, None, 3.0, 5.0), (None, 9.0, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {(r["var_x"], r["var_y"]): r["r"] for r in S.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    full = np.corrcoef(m.T)
    assert got[("c", "a")] == pytest.approx(full[2, 0], abs=1e-12)
    assert got[("b", "a")] == pytest.approx(full[1, 0], abs=1e-12)
    assert got[("k", "a")] is None and len(got) == 6


def test_correlation_in_one_pass(spark):
    """Large values with a small noise keep nine digits, no row is fanned out, and constants stay constants."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(5000, 3))
    m[:, 1] += m[:, 0]
    rows = [(1e9 + float(a), float(b), float(c), 0.1) for a, b, c in m]
    df = spark.createDataFrame(rows, "a double, b double, n double, c double").repartition(7)
    matrix = S.correlation_matrix(df, df.columns)
    got = {(r["var_x"], r["var_y"]): r["r"] for r in matrix.collect()}
    exact = np.corrcoef((np.array(rows)[:, :3] - [1e9, 0, 0]).T)
    assert got[("b", "a")] == pytest.approx(exact[1, 0], abs=1e-9) and got[("n", "a")] == pytest.approx(exact[2, 0], abs=1e-9)
    assert got[("c", "a")] is None and got[("c", "n")] is None
    assert "Generate" not in matrix._jdf.queryExecution().toString()
    nothing = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    assert [tuple(r) for r in S.correlation_matrix(nothing, ["a", "b"]).collect()] == [("b", "a", None)]
    assert S.correlation_matrix(nothing.limit(0), ["a", "b"]).count() == 0


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    rows = [("a", x / 10) for x in range(11)] + [("b", 2.0), ("b", 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in S.histogram(df, "v", ["g"], bins=5).collect()}
    assert got[("a", 5)] == 3 and sum(n for (g, _), n in got.items() if g == "a") == 11
    assert got[("b", 1)] == 2


def test_ordered_bits_are_the_pattern_of_the_double(spark):
    rng = random.Random(8)
    edge = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 1.7976931348623157e308, math.inf, -math.inf]
    edge += [math.nextafter(2.0**k, d) for k in range(-1073, 1024, 7) for d in (0, math.inf)] + [2.0**k for k in range(-1074, 1024, 5)]
    values = edge + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", S.ordered_bits(F.col("v")).alias("k"))
    rows = df.select("v", "k", S.from_ordered_bits(F.col("k")).alias("back")).collect()
    for r in rows:
        pattern = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
        assert r["k"] == (-pattern if r["v"] < 0 else pattern) and r["back"] == r["v"]
    special = spark.createDataFrame([(math.nan,), (None,)], "v double").select(S.ordered_bits(F.col("v")).alias("k"))
    found = [r[0] for r in special.select(S.from_ordered_bits(F.col("k"))).collect()]
    assert math.isnan(found[0]) and found[1] is None


def test_quantiles_of_values_that_hardly_differ(spark):
    """A million values within 1e-12 of each other, and one far off; no round orders more than 4,096 counts of a prefix."""
    df = spark.range(1_000_000).select((F.lit(1.0) + (F.col("id") % 4500) * 2.0**-52).alias("v")).union(spark.sql("select 1e9D"))
    got = {r["prob"]: r["value"] for r in S.exact_quantiles(df, "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    values = np.append(1.0 + (np.arange(1_000_000) % 4500) * 2.0**-52, 1e9)
    assert got == {p: np.quantile(values, p) for p in got} and len(got) == 4
    steps = np.diff([64, *S._ROUNDS])
    assert (-steps <= 12).all() and S._ROUNDS[-1] == 0
