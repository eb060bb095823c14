"""Column names to snake case."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def snake(name: str) -> str:
    """``Enroll Total`` and ``EnrollTotal`` to ``enroll_total``, ``% Poor`` to ``percent_poor``; a leading digit gets an ``x``."""
    s = name.replace("%", "_percent_").replace("#", "_number_").replace("'", "").replace('"', "")
    s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"([A-Za-z])(\d+)(?=[A-Z][a-z])", r"\1\2_", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    return f"x{s}" if not s or s[0].isdigit() else s


def clean_names(df: DataFrame) -> DataFrame:
    """All columns renamed; a repeated name gets ``_2``, ``_3`` and so on."""
    taken: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = snake(c)
        taken[n] = taken.get(n, 0) + 1
        names.append(n if taken[n] == 1 else f"{n}_{taken[n]}")
    return df.toDF(*names)
