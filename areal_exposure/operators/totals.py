"""Grouped totals. Every one is a map-side partial sum followed by a shuffle of one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import values as V


def total(records: DataFrame, by: Sequence[str], **sums: str) -> DataFrame:
    """``total(df, ["k"], pounds="lbs")``: one null-skipping sum per keyword, grouped by ``by``."""
    return records.groupBy(*by).agg(*[V.sum_or_zero(src).alias(name) for name, src in sums.items()])


def section_totals(records: DataFrame) -> DataFrame:
    return total(records, ["chem_code", "co_mtrs"], pounds="lbs_chm_used")


def section_water_year(records: DataFrame) -> DataFrame:
    return total(records, ["chem_code", "co_mtrs", "water_year"], pounds="lbs_chm_used")


def section_calendar_totals(records: DataFrame) -> DataFrame:
    return total(records, ["chem_code", "co_mtrs"], acres_treated="acre_treated", pounds="lbs_chm_used")


def by_year(records: DataFrame, by: Sequence[str], years: tuple[int, int], prefix: str = "y") -> DataFrame:
    """Pounds per group with one column per calendar year.

    The years are known, so each column is a conditional sum: one aggregation, one shuffle, fixed column
    order. A group without use in a year is null there; a group whose uses are all null is 0.
    """
    span = range(years[0], years[1] + 1)

    def pounds(y: int):
        here = F.col("year") == y
        return F.when(F.count_if(here) > 0, V.sum_or_zero(F.when(here, F.col("lbs_chm_used")))).alias(f"{prefix}{y}")

    return records.where(F.col("year").isin(*span)).groupBy(*by).agg(*[pounds(y) for y in span])


def state_year(records: DataFrame, years: tuple[int, int] = K.STUDY_YEARS, prefix: str = "y") -> DataFrame:
    return by_year(records, ["chem_code"], years, prefix)


def county_year(
    records: DataFrame,
    counties: DataFrame,
    years: tuple[int, int] = K.STUDY_YEARS,
    codes: Sequence[str] = tuple(K.CHEMICALS),
    prefix: str = "y",
) -> DataFrame:
    """County totals per chemical and calendar year; listed counties without use appear with zeros.

    ``counties`` is the lookup ``(county, county_code)`` with a whole-number code.
    """
    listed = counties.select(
        "county",
        V.pad_code("county_code").alias("county_cd"),
        F.explode(F.array(*[F.lit(c) for c in codes])).alias("chem_code"),
    )
    wide = by_year(records, ["chem_code", "county_cd"], years, prefix)
    columns = [f"{prefix}{y}" for y in range(years[0], years[1] + 1)]
    return (
        wide.withColumn("used", F.lit(1))
        .join(listed, ["chem_code", "county_cd"], "full")
        .fillna(0.0, columns)
        .select("chem_code", "county_cd", "county", "used", *columns)
    )


def in_report_order(county_years: DataFrame) -> DataFrame:
    """Counties with use first, then the listed ones without, each by code. For the final sink."""
    return county_years.orderBy("chem_code", F.desc_nulls_last("used"), F.asc_nulls_last("county_cd"))


def first_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order`` (then by the remaining columns, so that it is repeatable).

    A minimum over structs, not a ranked window: the choice is made before the shuffle, so a hot key costs
    one row per task.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("best")
    return df.groupBy(key).agg(best).select(*[c if c == key else F.col("best")[c].alias(c) for c in df.columns])


def duplicate_rows(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Every whole-row copy with ``dupe_count``, rows without a twin left out.

    Copies are counted before the shuffle. A row with very many copies is written out again in chunks that
    are spread over tasks, so no task has to hold or emit one group.
    """
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("dupe_count")).where(F.col("dupe_count") > 1)
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("dupe_count") - 1) / chunk))
    pieces = counted.withColumn("_chunk", F.explode(chunks))
    spread = pieces.repartition("_chunk", *df.columns)
    here = F.least(F.lit(chunk).cast("bigint"), F.col("dupe_count") - F.col("_chunk") * chunk)
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), here))).drop("_chunk", "_copy")
