"""CSV folders read as text, and CSV output with blanks for nulls."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from areal_exposure.functions import values as V
from areal_exposure.sources.order import FILE_ORDER, file_order
from areal_exposure.sources.ranges import csv_records


def read_text_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    pattern: str | None = None,
    with_path: bool = False,
    keep: Mapping[str, Sequence[str]] | None = None,
    trim: bool = True,
    multi_line: bool = False,
    with_order: bool = False,
    whole_file: bool = False,
) -> DataFrame:
    """Every column as text, so codes keep their zeros. Blank and ``NA`` are null, fields are trimmed.

    Quotes inside quoted fields are doubled, as in ordinary CSV; a row with a wrong number of fields stops the job.
    Files with line breaks inside quotes need ``multi_line``: they are read in byte ranges too, where the quotes before
    each range tell which line breaks end a record, and line feeds end lines, with or without a carriage return. A file with
    single quotes inside unquoted fields fails there and needs ``whole_file``, which reads each file in one task.
    ``trim=False`` keeps outer blanks.

    ``path`` is searched through its subfolders; ``pattern`` is a file-name glob such as ``*udc*``. Without
    ``columns`` the names come from the header of one file. Every file must carry the same header; one that
    does not fails instead of putting values under the wrong name. ``keep`` lists the wanted values of some
    columns; it is put straight on the file column, so the scan drops other rows while it parses them. ``with_order``
    adds ``file_order``, which sorts rows as they stand in the files, by path (see ``operators.totals.first_by_key``).
    """
    options = {
        "nullValue": "NA",
        "escape": '"',
        "mode": "FAILFAST",
        "columnPruning": False,  # else the fields of a row aren't counted
        "multiLine": multi_line or whole_file,
        "ignoreLeadingWhiteSpace": trim,
        "ignoreTrailingWhiteSpace": trim,
    }
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.options(**options).option("header", True).option("enforceSchema", False)
    if columns:
        files = files.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = files.csv(path)
    names = df.columns
    if multi_line and not whole_file:
        reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
        lines = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path).select("value", file_order())
        df = _parsed(csv_records(lines), names, options)
    for name, values in (keep or {}).items():
        df = df.where(F.col(f"`{name}`").isin(*values))
    if multi_line and not whole_file:
        path_of, order_of = F.col(f"{FILE_ORDER}.path"), F.col(FILE_ORDER)
    else:
        path_of, order_of = F.col("_metadata.file_path"), file_order()
    path_column = [path_of.alias("_path")] if with_path else []
    order = [order_of] if with_order else []
    return df.select(*[V.blank_to_null(F.col(f"`{c}`")).alias(c) for c in names], *path_column, *order)


def _parsed(records: DataFrame, names: Sequence[str], options: Mapping[str, object]) -> DataFrame:
    """Fields of records under ``names``. The first record of each file must hold these names."""
    places = [f"c{k}" for k in range(len(names))]
    fields = F.from_csv("value", ", ".join(f"{p} string" for p in places), {k: str(v) for k, v in options.items()})
    parsed = records.select(fields.alias("_fields"), "place", FILE_ORDER)
    held = F.array(*[F.lower(F.trim(F.coalesce(F.col(f"_fields.{p}"), F.lit("NA")))) for p in places])
    wrong = F.raise_error(F.concat(F.lit("a file with another header: "), F.col(f"{FILE_ORDER}.path"))).cast("boolean")
    header = F.when(held == F.array(*[F.lit(c.strip().lower()) for c in names]), False).otherwise(wrong)
    # The row number keeps Spark from putting a later filter, which may drop headers unseen, before this one.
    parsed = parsed.where(F.when(F.col("place") > 0, True).otherwise(header) & (F.monotonically_increasing_id() >= 0))
    return parsed.select(*[F.col(f"_fields.{p}").alias(c) for p, c in zip(places, names, strict=True)], FILE_ORDER)


def below(root: str) -> Column:
    """The part of a row's file path under the folder that was read, which may be given relative to the current one.

    The first copy of the folder's path is cut, so that folders of the same name below it stay.
    """
    folder = re.escape(quote(root.split(":")[-1].rstrip("/")))
    return F.regexp_replace(F.col("_path"), rf"^.*?(?<=/){folder.lstrip('/')}(?=/|$)", "")


def read_records(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    pattern: str | None = "*udc*",
    codes: Sequence[str] | None = None,
) -> DataFrame:
    """Use records as text, only those of the chemicals in ``codes`` when given."""
    return read_text_table(spark, path, columns, pattern, keep={"chem_code": codes} if codes else None)


def read_with_path_year(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, pattern: str | None = "*errors2*"
) -> DataFrame:
    """A text table with ``year`` from the file's path, looking only below the folder that is read."""
    table = read_text_table(spark, path, columns, pattern, with_path=True)
    return table.withColumn("year", V.first_year(below(path))).drop("_path")


def read_distinct(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, pattern: str | None = "*chemical*"
) -> DataFrame:
    return read_text_table(spark, path, columns, pattern).dropDuplicates()


def write_text_table(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls blank, quotes doubled, blanks kept. The folder holds one file per task."""
    writer = df.write.option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
