"""Equi joins with the missing-matches-missing rule, and a split of hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on shared columns where null equals null; key columns come out once.

    Spark plans ``<=>`` as an ordinary equi join.
    """
    marked = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    joined = left.join(marked, reduce(and_, [left[k].eqNullSafe(marked[f"_r_{k}"]) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return joined
    rest = [c for c in marked.columns if not c.startswith("_r_") or c[3:] not in keys]
    keyed = [(F.coalesce(k, f"_r_{k}") if how in ("full", "right") else F.col(k)).alias(k) for k in keys]
    return joined.select(*keyed, *[c for c in left.columns if c not in keys], *rest)


def natural_full(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full join on all shared columns, null equal to null."""
    return null_safe(left, right, [c for c in left.columns if c in right.columns], "full")


def _hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int, min_rows: int, copies: tuple[str, str] | None
) -> DataFrame:
    """Keys with more than ``1/parts`` of a side's rows or of all pairs, and the numbers of blocks ``_a`` and ``_b``."""
    n_left, n_right = [F.col(c) for c in copies] if copies else [F.lit(1), F.lit(1)]
    sides = left.select(*keys, n_left.cast("bigint").alias("_l"), F.lit(0).cast("bigint").alias("_r")).union(
        right.select(*keys, F.lit(0).cast("bigint").alias("_l"), n_right.cast("bigint").alias("_r"))
    )
    pairs = (F.sum("_l").cast("double") * F.sum("_r")).alias("_pairs")
    counts = sides.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), pairs)
    totals = counts.agg(F.struct(*[F.sum(c).alias(c) for c in ("_l", "_r", "_pairs")])).scalar()

    def share(of: str, least: float) -> Column:
        return F.greatest(F.lit(float(least)), F.col("_total")[of] / parts)

    def blocks(side: str) -> Column:
        return F.greatest(F.ceil(F.col(side) / share(side, min_rows)), F.lit(1))

    own = counts.withColumn("_total", totals).withColumns({"_a": blocks("_l"), "_b": blocks("_r")})
    # More blocks on the larger side where those of the rows alone would leave one with too many pairs.
    more = F.greatest(F.ceil(F.col("_pairs") / (F.col("_a") * F.col("_b")) / share("_pairs", 100.0 * min_rows)), F.lit(1))
    larger = F.col("_l") >= F.col("_r")
    a, b = F.when(larger, F.col("_a") * more).otherwise(F.col("_a")), F.when(larger, F.col("_b")).otherwise(F.col("_b") * more)
    return own.select(*keys, a.cast("int").alias("_a"), b.cast("int").alias("_b")).where((F.col("_a") > 1) | (F.col("_b") > 1))


def split_hot(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_left: Sequence[Column | str],
    spread_right: Sequence[Column | str],
    parts: int = 64,
    min_rows: int = 200_000,
    copies: tuple[str, str] | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a many-to-many equi join with their hot keys cut into blocks.

    A key with more than ``1/parts`` of the rows of a side (and more than ``min_rows``), or of all pairs (and more than 100
    times ``min_rows``), is cut: a left row goes to one of ``a`` row blocks and to all ``b`` column blocks, a right row
    the other way round, so every pair still meets exactly once (the block scheme of Okcan and Riedewald 2011). Other
    keys are untouched. The block is a hash of ``spread_*``, hence the same on a re-run after an executor is lost; name
    columns that tell rows of one key apart. ``copies`` names a column of each side that says how many rows a row
    stands for. Returns the two sides and the extended key list.

    At most ``parts`` keys per side and ``parts`` by pairs can be hot, which bounds the broadcast table by ``3 * parts`` rows.
    """
    hot = _hot_keys(left, right, keys, parts, min_rows, copies)

    def with_blocks(df: DataFrame, own: str, other: str, spread: Sequence[Column | str]) -> DataFrame:
        marked = null_safe(df, F.broadcast(hot), keys, "left")
        block = F.when(F.col(own) > 1, F.pmod(F.xxhash64(*spread), own)).otherwise(F.lit(0)).cast("int")
        copied = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return marked.select(*df.columns, block.alias(f"_block{own}"), copied.alias(f"_block{other}"))

    return (
        with_blocks(left, "_a", "_b", spread_left),
        with_blocks(right, "_b", "_a", spread_right),
        [*keys, "_block_a", "_block_b"],
    )


def counted_copies(df: DataFrame, copies: str, chunk: int) -> DataFrame:
    """Each distinct row with how often it is there, in rows that stand for ``chunk`` at most, told apart by ``<copies>_nth``."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    nth = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / chunk)))
    here = F.least(F.lit(chunk).cast("bigint"), F.col("_n") - F.col(f"{copies}_nth") * chunk)
    return counted.withColumn(f"{copies}_nth", nth).withColumn(copies, here).drop("_n")


def many_to_many(
    left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int = 64, min_rows: int = 200_000, chunk: int = 1000
) -> DataFrame:
    """Inner join on shared columns, null equal to null, hot keys split on both sides.

    Identical rows of hot keys are counted before they are sent and written out after the join, in chunks of at most
    ``chunk`` by ``chunk``; a hash of the row alone would leave all of them in one block. Rows of other keys take the plain
    join. Where no key is hot, adaptive execution drops the other way before it reads anything.
    """
    keys = list(keys)
    hot = F.broadcast(_hot_keys(left, right, keys, parts, min_rows, None).select(*keys))
    plain = null_safe(null_safe(left, hot, keys, "left_anti"), null_safe(right, hot, keys, "left_anti"), keys)
    l1 = counted_copies(null_safe(left, hot, keys, "left_semi"), "_copies_l", chunk)
    r1 = counted_copies(null_safe(right, hot, keys, "left_semi"), "_copies_r", chunk)
    copies = ("_copies_l", "_copies_r")
    l2, r2, all_keys = split_hot(l1, r1, keys, l1.columns, r1.columns, parts, min_rows, copies)
    met = null_safe(l2, r2, all_keys)
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies_l") * F.col("_copies_r")))
    return plain.union(met.withColumn("_each", each).select(*plain.columns))
