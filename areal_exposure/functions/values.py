"""Missing-value semantics, unit arithmetic and text helpers as column expressions.

The rules follow the statistical convention the published results rest on, where they differ from SQL:
a sum over nothing is 0, text built from a missing part reads ``NA``, unreadable text is null, and a
ratio to zero is null (not infinite).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from areal_exposure.constants import MISSING_SCORE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum_or_zero(c: Column | str) -> Column:
    """Aggregate: sum that skips nulls; 0 when there is nothing to add."""
    return F.coalesce(F.sum(_col(c)), F.lit(0.0))


def sum_or_null(c: Column | str) -> Column:
    """Aggregate: sum that is null as soon as one input is null."""
    c = _col(c)
    return F.when(F.count_if(c.isNull()) == 0, F.sum(c))


def row_sum(columns: Iterable[Column | str]) -> Column:
    """Sum across columns of one row, nulls as 0."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0.0)) for c in columns], F.lit(0.0))


def paste(*columns: Column | str) -> Column:
    """Concatenate as text; a missing part becomes the two letters ``NA``."""
    return F.concat(*[F.coalesce(_col(c).cast("string"), F.lit("NA")) for c in columns])


def number(c: Column | str) -> Column:
    """Text to double, null when unreadable."""
    return _col(c).try_cast("double")


def month_day_year(c: Column | str) -> Column:
    """Month-day-year text to date, one- or two-digit month and day, any of ``/ - . space`` between.

    Slashes are tried first; only text that is not read that way pays for the clean-up.
    """
    c = _col(c)
    return F.coalesce(
        F.try_to_date(c, "M/d/yyyy"), F.try_to_date(F.translate(F.trim(c), "-. ", "///"), "M/d/yyyy")
    )


def water_year(date: Column | str) -> Column:
    """Year that begins on 1 October of the year before: the calendar year three months on.

    ``date`` appears once, so that a filter on it parses a text date once per row.
    """
    return F.year(F.add_months(_col(date), 3))


def first_year(text: Column | str) -> Column:
    """First run of four digits as an integer, null when there is none."""
    return F.regexp_extract(_col(text), r"(\d{4})", 1).try_cast("int")


def pad_code(code: Column | str, width: int = 2) -> Column:
    """Zero-pad a whole number; longer codes stay whole, a missing one stays null."""
    whole = _col(code).cast("int")
    return F.when(whole.isNotNull(), F.format_string(f"%0{width}d", whole))


def ratio(a: Column | str, b: Column | str, per: float = 1.0) -> Column:
    """``a / b * per``, null on a zero base."""
    r = F.try_divide(_col(a), _col(b))
    return r if per == 1.0 else r * F.lit(float(per))


def percent_share(a: Column | str, b: Column | str) -> Column:
    """Percent to one decimal. Exact halves round away from zero."""
    return F.round(ratio(a, b) * 100, 1)


def sentinel_to_null(c: Column | str, sentinel: float = MISSING_SCORE) -> Column:
    c = _col(c)
    return F.when(c != sentinel, c)


def blank_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c != "", c)
