"""Missing-value rules and small column functions."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from areal_exposure.functions import values as V
from areal_exposure.operators import census as C
from areal_exposure.operators import joins as J
from areal_exposure.operators import records as R
from areal_exposure.operators import totals as T
from areal_exposure.sources.names import clean_names, snake


def one(df):
    return df.collect()[0][0]


def test_sums_over_missing_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert one(df.agg(V.sum_or_zero("x"))) == 0
    assert one(df.agg(V.sum_or_null("x"))) is None
    mixed = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert one(mixed.agg(V.sum_or_zero("x"))) == 1
    assert one(mixed.agg(V.sum_or_null("x"))) is None
    assert one(mixed.where("x is not null").agg(V.sum_or_null("x"))) == 1


def test_row_sum_and_paste(spark):
    df = spark.createDataFrame([(1.0, None, "a", None)], "a double, b double, s string, t string")
    assert one(df.select(V.row_sum(["a", "b"]))) == 1
    assert one(df.select(V.row_sum(["b"]))) == 0
    assert one(df.select(V.paste("s", "t", F.lit(3)))) == "aNA3"


@pytest.mark.parametrize(
    "text, date",
    [
        ("1/2/2018", dt.date(2018, 1, 2)),
        ("01/02/2018", dt.date(2018, 1, 2)),
        ("12-31-2019", dt.date(2019, 12, 31)),
        (" 3/4/2020 ", dt.date(2020, 3, 4)),
        ("13/01/2018", None),
        ("2/30/2018", None),
        ("soon", None),
        (None, None),
    ],
)
def test_month_day_year(spark, text, date):
    df = spark.createDataFrame([(text,)], "s string")
    assert one(df.select(V.month_day_year("s"))) == date


def test_water_year_turns_in_october(spark):
    days = [("2018-09-30", 2018), ("2018-10-01", 2019), ("2018-11-30", 2019), ("2018-12-31", 2019), ("2019-01-01", 2019)]
    df = spark.createDataFrame(days, "d string, y int").select(F.to_date("d").alias("d"), "y")
    assert df.where(V.water_year("d") != F.col("y")).count() == 0


def test_codes_numbers_and_ratios(spark):
    df = spark.createDataFrame([("x2018y2019", "7", "1e3", 0.0, 5.0)], "t string, c string, n string, z double, v double")
    row = df.select(
        V.first_year("t"), V.pad_code(F.col("c").cast("int")), V.pad_code(F.lit(123)), V.number("n"), V.number("t"),
        V.ratio("v", "z"), V.ratio("v", F.lit(10.0), 100), V.percent_share(F.lit(1.0), F.lit(3.0)),
        V.sentinel_to_null(F.lit(-999.0)), V.first_year(F.lit("none")),
    ).collect()[0]
    assert list(row) == [2018, "07", "123", 1000.0, None, None, 50.0, 33.3, None, None]


def test_snake_case_names(spark):
    assert snake("CDSCode") == "cds_code"
    assert snake("EnrollTotal") == "enroll_total"
    assert snake("RPL_THEME1") == "rpl_theme1"
    assert snake(" % Poor ") == "percent_poor"
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a.b", "a_b"])
    assert clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]


def raw_records(spark, rows):
    names = ("use_no", "chem_code", "county_cd", "applic_dt", "lbs_chm_used", "error_flag")
    full = [dict(zip(names, r)) for r in rows]
    schema = (
        "use_no string, chem_code string, county_cd string, base_ln_mer string, township string, tship_dir string, "
        "range string, range_dir string, section string, applic_dt string, lbs_chm_used string, acre_treated string, error_flag string"
    )
    fixed = dict(base_ln_mer="M", township="01", tship_dir="N", range="02", range_dir="E", section="03", acre_treated="2")
    return spark.createDataFrame([{**fixed, **f} for f in full], schema)


def test_cleaning_and_county_years(spark):
    raw = raw_records(
        spark,
        [
            ("1", "573", "01", "1/5/2018", "10", None),
            ("1", "573", "01", "1/5/2018", "10", None),  # a copy
            ("2", "573", "01", "2/5/2018", "5", "E"),  # flagged
            ("3", "573", "02", "3/5/2019", "bad", None),  # unreadable pounds
            ("4", "136", "01", "3/5/2022", "7", None),
            ("5", "999", "01", "3/5/2022", "7", None),  # another chemical
            ("6", "573", "01", "3/5/2017", "99", None),  # before the period
        ],
    )
    clean = R.clean(raw)
    assert clean.count() == 4
    assert clean.select("co_mtrs").first()[0] == "01M01N02E03"
    counties = spark.createDataFrame([("Alba", 1), ("Bera", 2), ("Cora", 3)], "county string, county_code int")
    rows = T.in_report_order(T.county_year(clean, counties)).collect()
    table = {(r["chem_code"], r["county"]): [r[f"y{y}"] for y in range(2018, 2023)] for r in rows}
    assert table[("573", "Alba")] == [10, 0, 0, 0, 0]
    assert table[("573", "Bera")] == [0, 0, 0, 0, 0]
    assert table[("136", "Alba")] == [0, 0, 0, 0, 7]
    assert len(table) == 6
    assert [r["county"] for r in rows if r["chem_code"] == "136"] == ["Alba", "Bera", "Cora"]
    state = {r["chem_code"]: r for r in T.state_year(clean).collect()}
    assert state["573"]["y2018"] == 10 and state["573"]["y2019"] == 0 and state["573"]["y2020"] is None


def test_state_totals_are_regenerated(spark):
    # Published statewide pounds by calendar year, 2018 to 2022.
    published = {
        "573": [12446586.8354759, 11237039.7436773, 11535331.4826497, 10931937.0050539, 9652337.551719],
        "136": [7255723.1900333, 7912624.11299, 8219629.0879656, 8451791.2242996, 8625336.9453093],
    }
    rows = [
        (f"{c}{y}{part}", c, f"{part:02d}", f"6/1/{y}", repr(total * share), None)
        for c, totals in published.items()
        for y, total in zip(range(2018, 2023), totals)
        for part, share in ((1, 0.25), (2, 0.75))
    ]
    got = {r["chem_code"]: [r[f"y{y}"] for y in range(2018, 2023)] for r in T.state_year(R.clean(raw_records(spark, rows))).collect()}
    for code, totals in published.items():
        assert got[code] == pytest.approx(totals, rel=1e-12)


def test_cropland_slots(spark):
    rows = [("U", None, "V", None, True), ("I", "2", None, None, True), ("I", "1", None, None, False), (None, None, None, None, False)]
    df = spark.createDataFrame(rows, "class1 string, subclass1 string, class2 string, subclass2 string, keep boolean")
    assert R.cropland(df, slots=(1, 2)).select("keep").distinct().collect() == [(True,)]
    assert R.cropland(df, slots=(1, 2)).count() == 2


def test_null_matches_null_in_natural_join(spark):
    a = spark.createDataFrame([("1", None, 1.0), ("2", "x", 2.0)], "k string, d string, near double")
    b = spark.createDataFrame([("1", None, 10.0), ("3", "y", 30.0)], "k string, d string, far double")
    got = {tuple(r) for r in J.natural_full(a, b).select("k", "d", "near", "far").collect()}
    assert got == {("1", None, 1.0, 10.0), ("2", "x", 2.0, None), ("3", "y", None, 30.0)}
    assert J.null_safe(a, b, ["k", "d"], "left_semi").count() == 1


def test_ratio_to_state_goes_by_name(spark):
    places = spark.createDataFrame([("a", 10.0, 20.0)], "geoid string, pc_poverty double, pc_latino double")
    state = spark.createDataFrame([(40.0, 5.0)], "pc_latino double, pc_poverty double")
    row = C.relative_to_state(places, state, ["pc_poverty", "pc_latino"]).first()
    assert (row["pc_poverty_relative"], row["pc_latino_relative"]) == (2.0, 0.5)
    with pytest.raises(Exception):
        C.relative_to_state(places, state.union(state), ["pc_poverty"]).collect()


def test_census_profile(spark):
    rows = [
        ("06", "S", "B01001_001", 1000.0),
        ("06", "S", "B01001_003", 100.0),
        ("06", "S", "B01001_027", 50.0),
        ("06", "S", "B16005_007", 30.0),
        ("06", "S", "B16005_001", 900.0),
        ("06", "S", "B17001_002", 10.0),
        ("06", "S", "B99999_001", 1.0),
    ]
    long = spark.createDataFrame(rows, "geoid string, name string, variable string, estimate double")
    r = C.profile(C.label_variables(long)).first()
    assert r["pc_age_17_and_below"] == 15.0
    assert r["pc_limited_english"] == 3.3
    assert r["pc_poverty"] is None and r["median_household_income"] is None


def test_sentinel_leaves_text_alone(spark):
    df = spark.createDataFrame([("-999", -999.0, 1)], "t string, x double, i int")
    assert list(C.without_sentinel(df).first()) == ["-999", None, 1]


def test_first_by_key_is_repeatable(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.0, 5.0), ("b", 3.0, 3.0)], "k string, x double, y double")
    assert sorted(map(tuple, T.first_by_key(df, "k", ["x"]).collect())) == [("a", 1.0, 5.0), ("b", 3.0, 3.0)]


def test_duplicate_rows_in_chunks(spark):
    df = spark.createDataFrame([("a",)] * 23 + [("b",)] * 2 + [("c",), (None,), (None,)], "k string")
    got = T.duplicate_rows(df, chunk=5).groupBy("k", "dupe_count").count().collect()
    assert {tuple(r) for r in got} == {("a", 23, 23), ("b", 2, 2), (None, 2, 2)}


@pytest.mark.parametrize("parts, min_rows", [(4, 1), (64, 200_000)])
def test_hot_keys_split_join_equals_plain_join(spark, parts, min_rows):
    left = spark.range(400).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), F.col("id").alias("l"))
    right = spark.range(300).select(F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 4 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("k"), F.col("id").alias("r"))
    left = left.union(spark.createDataFrame([(None, -1)], "k string, l bigint"))
    got = J.many_to_many(left, right, ["k"], parts=parts, min_rows=min_rows)
    plain = left.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).drop("k2")
    assert got.count() == plain.count()
    assert got.exceptAll(plain.select(*got.columns)).count() == 0


def test_hot_keys_are_really_split(spark):
    left = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("l"))
    right = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("r"))
    l2, r2, keys = J.split_hot(left, right, ["k"], ["l"], ["r"], parts=4, min_rows=1)
    assert keys == ["k", "_block_a", "_block_b"]
    assert l2.count() == 4000 and r2.count() == 4000
    assert l2.groupBy(*keys).count().agg(F.max("count")).first()[0] < 330


def test_identical_rows_of_a_hot_key_are_spread(spark):
    """100,000 identical rows on one key, and others: counted, cut into chunks, dealt to blocks, all written out again."""
    left = spark.range(100_000).select(F.lit("hot").alias("k"), F.lit(1).alias("l")).union(spark.range(50).select(F.col("id").cast("string"), F.lit(2)))
    right = spark.createDataFrame([("hot", 7), ("hot", 7), ("hot", 8), (None, 9), ("3", 9)], "k string, r int")
    got = J.many_to_many(left, right, ["k"], parts=8, min_rows=1000)
    found = {(r["k"], r["l"], r["r"]): r["count"] for r in got.groupBy("k", "l", "r").count().collect()}
    assert found == {("hot", 1, 7): 200_000, ("hot", 1, 8): 100_000, ("3", 2, 9): 1}
    chunks = J.counted_copies(left.where("k = 'hot'"), "_copies_l", 1000)
    assert chunks.count() == 100 and chunks.agg(F.sum("_copies_l")).first()[0] == 100_000
    others = J.counted_copies(right, "_copies_r", 1000)
    l2, _, keys = J.split_hot(chunks, others, ["k"], chunks.columns, others.columns, 8, 1000, ("_copies_l", "_copies_r"))
    assert l2.groupBy(*keys).agg(F.sum("_copies_l").alias("n")).agg(F.max("n"), F.count("*")).first()[0] < 40_000


def test_keys_are_cut_by_pairs(spark):
    """Neither side has many rows on the key, but nearly all pairs are its own."""
    left = spark.range(900).select(F.when(F.col("id") < 90, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("l"))
    right = spark.range(900).select(F.when(F.col("id") < 90, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("r"))
    l2, r2, keys = J.split_hot(left, right, ["k"], ["l"], ["r"], parts=8, min_rows=1)
    most = l2.groupBy(*keys).count().join(r2.groupBy(*keys).agg(F.count("*").alias("m")), keys).agg(F.max(F.col("count") * F.col("m"))).first()[0]
    assert most < 90 * 90 / 4
    assert J.many_to_many(left, right, ["k"], parts=8, min_rows=1).count() == 90 * 90 + 810


def test_missing_code_stays_missing(spark):
    df = spark.createDataFrame([("7",), (None,), ("123",)], "c string")
    assert [r["p"] for r in df.select(V.pad_code("c").alias("p")).collect()] == ["07", None, "123"]


def test_years_without_end(spark):
    df = spark.createDataFrame([(y,) for y in (2017, 2018, 2030, None)], "water_year int")
    assert [r[0] for r in R.between_years(df, (2018, None)).collect()] == [2018, 2030]
    assert [r[0] for r in R.between_years(df, (2017, 2018)).collect()] == [2017, 2018]
