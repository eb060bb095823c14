"""Where a row stood in the files that were read, as a column that sorts in file order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_ORDER = "file_order"


def file_order(*within: Column) -> Column:
    """File path, start of the block, place of the row in the block, and what tells several rows of one record apart.

    For the ``select`` right on a file scan. A block is read in order by one task, whose row numbers grow, so the
    numbers sort rows within a block; blocks and files sort by their own columns.
    """
    place = (F.monotonically_increasing_id(), *within)
    named = [c.cast("bigint").alias(f"place{k}") for k, c in enumerate(place)]
    return F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), *named).alias(FILE_ORDER)
