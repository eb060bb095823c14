"""Census estimates and social-vulnerability scores: widen, sum, share, compare with the state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from areal_exposure import constants as K
from areal_exposure.functions import values as V


def columns_with(df: DataFrame, part: str) -> list[str]:
    """Names that contain ``part``, in any case."""
    return [c for c in df.columns if part.lower() in c.lower()]


def label_variables(long: DataFrame, names: Mapping[str, str] = K.CENSUS_VARIABLES) -> DataFrame:
    """Census codes in ``variable`` to readable names; codes outside the list are dropped, as they are not asked for."""
    lookup = F.create_map(*[F.lit(v) for name, code in names.items() for v in (code, name)])
    return long.where(F.col("variable").isin(*names.values())).withColumn("variable", lookup[F.col("variable")])


def widen(long: DataFrame, names: Sequence[str] = tuple(K.CENSUS_VARIABLES)) -> DataFrame:
    """One row per place and one column per variable, margins of error left behind.

    A place has one estimate per variable, so the maximum picks it; with the names known this is a single
    aggregation.
    """
    pick = [F.max(F.when(F.col("variable") == n, F.col("estimate"))).alias(n) for n in names]
    return long.groupBy("geoid", "name").agg(*pick)


def with_sums(wide: DataFrame) -> DataFrame:
    """People of 17 and below, and with limited English: sums over the matching columns, nulls as 0."""
    return wide.withColumns(
        {
            "age_17_and_below": V.row_sum(columns_with(wide, "yrs")),
            "limited_english": V.row_sum(columns_with(wide, "limited")),
        }
    )


def with_shares(summed: DataFrame) -> DataFrame:
    return summed.withColumns({name: V.percent_share(a, b) for name, (a, b) in K.CENSUS_SHARES.items()})


def profile(long: DataFrame) -> DataFrame:
    """Population, income and shares per place from long estimates."""
    shares = with_shares(with_sums(widen(long)))
    return shares.select("geoid", "name", "population", "median_household_income", *columns_with(shares, "pc_"))


def compared_columns(profile_df: DataFrame) -> list[str]:
    return ["median_household_income", *columns_with(profile_df, "pc_")]


def relative_to_state(places: DataFrame, state: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ratio of each column to the same-named column of the one state row, as ``<name>_relative``.

    The state row is read as a scalar subquery, which fails if there is more than one row.
    """
    columns = list(columns or compared_columns(places))
    row = state.select(F.struct(*columns)).scalar()
    ratios = {f"{c}_relative": V.ratio(F.col(c), F.col("_state")[c]) for c in columns}
    return places.withColumn("_state", row).withColumns(ratios).drop("_state")


def long_form(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns to rows ``(*ids, variable, value)``, nulls kept."""
    return df.unpivot(list(ids), list(columns), "variable", "value")


def without_sentinel(df: DataFrame, sentinel: float = K.MISSING_SCORE, keep: Sequence[str] = ()) -> DataFrame:
    """The missing-score number to null in every numeric column; text and geometry are left alone."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in keep]
    return df.withColumns({c: V.sentinel_to_null(c, sentinel) for c in numeric})


def vulnerability_scores(svi: DataFrame, geom: str | None = "geom") -> DataFrame:
    """Chosen columns under readable names, sentinel removed, polygon kept when there is one."""
    chosen = [F.col(c).alias(name) for c, name in K.SVI_COLUMNS.items()]
    shape = [geom] if geom and geom in svi.columns else []
    return without_sentinel(svi.select(*chosen, *shape))


def land_area(tracts: DataFrame) -> DataFrame:
    return tracts.select("geoid", (F.col("aland") * K.ACRES_PER_SQ_METRE_LAND).alias("land_area_acres"))
