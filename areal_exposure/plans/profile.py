"""The tract profile: scores, census shares, pounds and rates in one row per tract."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import values as V


def pounds_by_tract(tract_pounds: DataFrame, span: str, labels: Mapping[str, str] = K.CHEMICALS) -> DataFrame:
    """One row per tract, one pounds column per chemical."""
    return tract_pounds.groupBy("geoid").agg(
        *[F.max(F.when(F.col("chem_code") == c, F.col("pounds"))).alias(f"pounds_{n}_{span}") for c, n in labels.items()]
    )


def tract_profile(
    scores: DataFrame,
    census: DataFrame,
    land: DataFrame,
    tract_pounds: DataFrame,
    years: tuple[int, int] = K.STUDY_YEARS,
    labels: Mapping[str, str] = K.CHEMICALS,
) -> DataFrame:
    """Tracts with scores and census row; land area and pounds where known; pounds per 100 acres and per 1000 people.

    All inputs have one row per tract, so every join is one to one.
    """
    span = f"{years[0]}_{years[1]}"
    joined = (
        scores.join(census.withColumnRenamed("geoid", "fips"), "fips")
        .join(land.withColumnRenamed("geoid", "fips"), "fips", "left")
        .join(pounds_by_tract(tract_pounds, span, labels).withColumnRenamed("geoid", "fips"), "fips", "left")
    )
    names = list(labels.values())
    rates = {}
    for n in names:
        rates[f"pounds_{n}_per_100_acres_{span}"] = V.ratio(f"pounds_{n}_{span}", "land_area_acres", 100)
    for n in names:
        rates[f"pounds_{n}_per_1000_people_{span}"] = V.ratio(f"pounds_{n}_{span}", "population", 1000)
    shape = ["geom"] if "geom" in scores.columns else []
    relative = [f"{c}_relative" for c in compared()]
    return joined.withColumns(rates).select(
        "county", "fips", "name", "area_sqmi", "land_area_acres", "population", "housing_units", "households",
        *SCORES, *compared(), *relative, *[f"pounds_{n}_{span}" for n in names], *rates, *shape,
    )


SCORES = [n for c, n in K.SVI_COLUMNS.items() if c.startswith("rpl")]


def compared() -> list[str]:
    return ["median_household_income", *K.CENSUS_SHARES]


def correlated_columns(years: tuple[int, int] = K.STUDY_YEARS, labels: Mapping[str, str] = K.CHEMICALS) -> list[str]:
    """Scores, income, shares and the four rates."""
    span = f"{years[0]}_{years[1]}"
    rates = [f"pounds_{n}_per_{base}_{span}" for base in ("100_acres", "1000_people") for n in labels.values()]
    return [*SCORES, *compared(), *rates]
