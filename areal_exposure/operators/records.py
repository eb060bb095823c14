"""Cleaning of raw use records (all columns text) into typed, de-duplicated, unflagged records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import values as V


def keep_chemicals(raw: DataFrame, codes: Sequence[str] = tuple(K.CHEMICALS)) -> DataFrame:
    """The filter reaches the scan, so nothing else is shuffled later."""
    return raw.where(F.col("chem_code").isin(*codes))


def typed(raw: DataFrame) -> DataFrame:
    """Date, pounds and acres from text (null when unreadable), with calendar and water year."""
    date = V.month_day_year("applic_dt")
    return raw.withColumns(
        {
            "applic_dt": date,
            "lbs_chm_used": V.number("lbs_chm_used"),
            "acre_treated": V.number("acre_treated"),
            "year": F.year(date),
            "water_year": V.water_year(date),
        }
    )


def drop_flagged(records: DataFrame) -> DataFrame:
    return records.where(F.col("error_flag").isNull())


def distinct_records(raw: DataFrame, codes: Sequence[str] = tuple(K.CHEMICALS)) -> DataFrame:
    """Records of the given chemicals, whole-row copies removed (copies collapse before the shuffle)."""
    return keep_chemicals(raw, codes).dropDuplicates()


def clean(raw: DataFrame, codes: Sequence[str] = tuple(K.CHEMICALS)) -> DataFrame:
    """Typed records without copies and without flagged rows, keyed by land-survey section."""
    return with_section_key(typed(drop_flagged(distinct_records(raw, codes))))


def with_section_key(records: DataFrame, parts: Sequence[str] = K.SECTION_KEY_PARTS) -> DataFrame:
    return records.withColumn("co_mtrs", V.paste(*parts))


def between_years(
    records: DataFrame, years: tuple[int, int | None] = K.STUDY_YEARS, column: str = "water_year"
) -> DataFrame:
    """Years from the first to the second, or without end if that is None.

    A list of years, not two comparisons: the filter moves below the de-duplication, next to the scan, and there
    the date is parsed once."""
    if years[1] is None:
        return records.where(F.col(column) >= years[0])
    return records.where(F.col(column).isin(*range(years[0], years[1] + 1)))


def cropland(crops: DataFrame, slots: Sequence[int] = K.CROP_SLOTS) -> DataFrame:
    """Survey polygons whose class in any slot is one the chemicals may be applied to."""

    def suits(i: int):
        klass, sub = F.col(f"class{i}"), F.col(f"subclass{i}")
        return klass.isin(*K.CROP_CLASSES) | ((klass == K.IDLE_CLASS) & (sub == K.IDLE_SUBCLASS))

    return crops.where(reduce(or_, [suits(i) for i in slots]))
