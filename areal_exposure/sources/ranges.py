"""Records that a file's bytes define only from its start on, read by as many tasks as the file has blocks.

What a piece of a file means may depend on all before it: whether it stands inside quotes, how deep it is nested. Each
block is summed up by its own task, the sums of a file's blocks are added from its start (one row a block), and every
piece gets what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal_exposure.sources.order import FILE_ORDER
from areal_exposure.sources.scratch import written

_BLOCK = (f"{FILE_ORDER}.path", f"{FILE_ORDER}.block")


def sums_before(pieces: DataFrame, amount: Column, name: str) -> DataFrame:
    """``pieces`` (with ``file_order``) and ``name``: the sum of ``amount`` over all earlier pieces of the file."""
    own = pieces.withColumns({"_path": F.col(_BLOCK[0]), "_block": F.col(_BLOCK[1]), "_amount": amount.cast("bigint")})
    blocks = own.groupBy("_path", "_block").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_path", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_path", "_block").orderBy(FILE_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_within", F.coalesce(F.sum("_amount").over(within), F.lit(0))).join(blocks, ["_path", "_block"])
    return own.select(*pieces.columns, (F.col("_before") + F.col("_within")).alias(name))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def collection_members(pieces: DataFrame) -> DataFrame:
    """The objects in the top-level array ``features`` of JSON files: ``value``, ``place`` in the file, ``file_order``.

    ``pieces`` are the files' text cut after every closing brace (``value`` without it) with ``file_order`` and the file's ``size``. Braces in
    strings don't count, nor do quotes behind a backslash. Other top-level members are skipped. A file that ends before its
    object does, or that has no ``features``, fails the job. No task holds more than a block of a file and a feature.
    """
    bare = F.regexp_replace("value", r"\\.", "")
    pieces = written(sums_before(pieces.withColumn("bare", bare), _count(F.col("bare"), '"'), "quotes"), "quotes")
    inside = F.col("quotes") % 2 == 1
    ends_inside = (F.col("quotes") + _count(F.col("bare"), '"')) % 2 == 1
    outside = F.regexp_replace(F.when(inside, F.regexp_replace("bare", r'^[^"]*("|$)', "")).otherwise(F.col("bare")), r'"[^"]*("|$)', "")
    # What follows the last brace of a file has no brace of its own; the file's size tells (unless it is compressed).
    own = F.sum(F.octet_length("value") + 1) - F.max("size")
    last = pieces.groupBy(F.col(_BLOCK[0]).alias("_file")).agg(F.max(FILE_ORDER).alias("_last"), own.alias("_over"))
    pieces = pieces.join(last, F.col(_BLOCK[0]) == F.col("_file"))
    blank = ~inside & (F.regexp_replace("bare", r"\s", "") == "")
    unclosed = (F.col(FILE_ORDER) == F.col("_last")) & F.when(F.col("_over").isin(0, 1), F.col("_over") == 1).otherwise(blank)
    change = _count(outside, "{") - F.when(ends_inside | unclosed, 0).otherwise(1)
    pieces = pieces.select("value", FILE_ORDER, change.cast("bigint").alias("change"), _count(outside, "{").alias("opened"))
    pieces = sums_before(pieces, F.col("change"), "depth")
    after = F.col("depth") + F.col("change")
    # A member ends where the depth falls from two to one.
    ended = (after == 1) & (F.col("change") < F.col("opened"))
    pieces = sums_before(pieces.withColumns({"after": after, "ended": ended.cast("int")}), F.col("ended"), "place")
    order = F.struct(FILE_ORDER, "value")
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(order)), lambda p: F.concat(p["value"], F.lit("}"))))
    closed = F.max((F.col("after") == 0).cast("int")).alias("closed")
    found = pieces.groupBy(F.col(_BLOCK[0]).alias("_file"), "place").agg(text.alias("text"), F.min(FILE_ORDER).alias(FILE_ORDER), closed)
    opening = F.when(F.col("place") == 0, F.regexp_replace("text", r"^\s*\{", "")).otherwise(F.col("text"))
    found = found.withColumn("opening", opening).withColumn("before", F.regexp_extract("opening", r'^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)', 1))
    found = written(found.withColumn("value", F.expr("substring(opening, length(before) + 1)")).drop("text", "opening"), "members")
    whole = found.groupBy("_file").agg((F.max("closed") * F.max(F.col("before").rlike(r'"features"\s*:').cast("int"))).alias("whole"))
    wrong = F.raise_error(F.concat(F.lit("a file that holds no whole collection of features: "), F.col("_file")))
    checked = found.join(whole, "_file").withColumn("value", F.when(F.col("whole") == 1, F.col("value")).otherwise(wrong))
    member = F.col("before").rlike(r'"\s*:\s*$')
    return checked.where((F.col("value") != "") & ~member).select("value", "place", FILE_ORDER)


def _quotes(text: Column) -> Column:
    return _count(text, '"')


def csv_records(lines: DataFrame) -> DataFrame:
    """The records of CSV files whose quoted fields may hold line breaks: ``value``, ``place`` in the file, ``file_order``.

    ``lines`` are the files' text cut after every line feed (``value`` without it) with ``file_order``. A line that an even
    number of quotes stands before begins a record, others go on with it; the end of a record loses a carriage return. Blank
    lines between records are skipped. Only records of several lines are moved, each to one task. A file that ends inside
    quotes fails the job, and so does a record of several lines with a quote inside an unquoted field.
    """
    lines = written(sums_before(lines, _quotes(F.col("value")), "quotes"), "csv-lines")
    begins = F.col("quotes") % 2 == 0
    lines = lines.withColumn("begins", begins.cast("int")).where(~begins | (F.trim(F.regexp_replace("value", r"\s", " ")) != ""))
    lines = sums_before(lines, F.col("begins"), "place").withColumn("place", F.col("place") + F.col("begins") - 1)
    single = begins & (_quotes(F.col("value")) % 2 == 0)
    path = F.col(_BLOCK[0]).alias("_file")
    # What ends inside quotes would gather the rest of its file, so it's told before anything is gathered.
    ends = lines.groupBy(path).agg((F.max(F.col("quotes") + _quotes(F.col("value"))) % 2).alias("_open"))
    wrong = F.raise_error(F.concat(F.lit("a file that ends inside quotes: "), F.col("_file")))
    parts = lines.where(~single).withColumn("_file", path).join(ends, "_file")
    parts = parts.withColumn("value", F.when(F.col("_open") == 0, F.col("value")).otherwise(wrong))
    order = F.array_sort(F.collect_list(F.struct(FILE_ORDER, "value")))
    whole = parts.groupBy("_file", "place").agg(F.concat_ws("\n", F.transform(order, lambda p: p["value"])).alias("value"), F.min(FILE_ORDER).alias(FILE_ORDER))
    field = r'(?:\s*+"[^"]*+"\s*+|[^",]*+)'  # doubled quotes are taken out first
    plain = F.replace("value", F.lit('""'), F.lit("")).rlike(rf"^{field}(?:,{field})*+\z")
    stray = F.raise_error(F.concat(F.lit("a quote inside an unquoted field: "), F.col("_file")))
    whole = whole.select(F.when(plain, F.col("value")).otherwise(stray).alias("value"), "place", FILE_ORDER)
    records = lines.where(single).select("value", "place", FILE_ORDER).unionByName(whole)
    return records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))
