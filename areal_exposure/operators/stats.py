"""Exact quantiles, complete-case correlation and histogram counts, without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal_exposure.operators.joins import null_safe
from areal_exposure.sources.scratch import written

#: Bits of a double's ordered pattern left out after each round of counting; a round tells 4,096 prefixes apart at most.
_ROUNDS = (52, 40, 28, 16, 4, 0)
_MANTISSA = 1 << 52


def ordered_bits(v: Column) -> Column:
    """A double's 64-bit pattern as a long that sorts as the value does: 0 for both zeros, NaN last, null for null.

    Sign, exponent and mantissa are worked out by exact scaling with powers of two.
    """
    size = F.abs(v)
    # log2 may be one off beside a power of two; the mantissa then shows it
    guess = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)).cast("int")

    def scaled(by: Column) -> Column:
        first = F.floor(by / 2).cast("int")
        return size * F.pow(F.lit(2.0), -first) * F.pow(F.lit(2.0), first - by)

    exponent = guess - (scaled(guess) < 1).cast("int") + (scaled(guess) >= 2).cast("int")
    least = F.greatest(exponent, F.lit(-1022))  # below, numbers have no leading one
    mantissa = (scaled(least) * float(_MANTISSA)).cast("bigint")
    bits = (least + 1022).cast("bigint") * F.lit(_MANTISSA) + mantissa
    bits = F.when(size == 0, F.lit(0)).when(size == float("inf"), F.lit(2047 * _MANTISSA)).otherwise(bits)
    return F.when(F.isnan(v), F.lit(2047 * _MANTISSA + 1)).when(v < 0, -bits).otherwise(bits)


def from_ordered_bits(k: Column) -> Column:
    """The double that :func:`ordered_bits` gave ``k`` for."""
    bits = F.abs(k)
    exponent = F.greatest(F.shiftright(bits, 52), F.lit(1)).cast("int") - 1022
    whole = (bits - (exponent + 1022 - 1).cast("bigint") * F.lit(_MANTISSA)).cast("double") / float(_MANTISSA)
    first = F.floor((exponent - 1) / 2).cast("int")
    value = whole * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), exponent - 1 - first)
    value = F.when(bits == 2047 * _MANTISSA, F.lit(float("inf"))).when(bits > 2047 * _MANTISSA, F.lit(float("nan"))).otherwise(value)
    return F.when(k < 0, -value).otherwise(value)


def _holding_ranks(buckets: DataFrame, group: Sequence[str], bucket: str) -> DataFrame:
    """Buckets that hold a wanted rank, with the ranks counted from the start of the bucket.

    ``buckets`` has ``_n`` rows each and the wanted 0-based ranks of the group in ``_ranks``; ``_at`` becomes
    pairs of the rank in the bucket and the rank in the whole group.
    """
    upto = F.sum("_n").over(Window.partitionBy(*group).orderBy(bucket))
    return (
        buckets.withColumn("_start", upto - F.col("_n"))
        .withColumn(
            "_at",
            F.transform(
                F.filter("_ranks", lambda r: (r["at"] >= F.col("_start")) & (r["at"] < F.col("_start") + F.col("_n"))),
                lambda r: F.struct((r["at"] - F.col("_start")).alias("at"), r["rank"].alias("rank")),
            ),
        )
        .where(F.size("_at") > 0)
        .drop("_start", "_ranks", "_n")
        .withColumnRenamed("_at", "_ranks")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), few_groups: bool = False
) -> DataFrame:
    """Interpolated quantiles per group, as rows ``(*by, prob, value)``; nulls are left out, NaN sorts last.

    The built-in exact ``percentile`` keeps every distinct value of a group in one task. Here the wanted ranks
    are found by radix descent on the values' ordered 64-bit patterns: six rounds count the rows below the prefixes
    that still hold a rank, by the next twelve bits (four in the last), until the prefix is the value. Whatever
    the values, a round puts at most 4,096 counts of one prefix in order, and none sorts values. Rows are counted
    before each shuffle. ``few_groups`` states that the groups are few and known, so that the table of wanted prefixes
    (two per probability and group) may be broadcast. The patterns are written once and read by each round.
    """
    by = list(by)
    hint = F.broadcast if few_groups else (lambda d: d)
    x = written(df.select(*by, ordered_bits(F.col(value).cast("double")).alias("_k")).where(F.col("_k").isNotNull()), "ordered")

    def prefix(left_out: int) -> Column:
        return F.shiftright("_k", left_out)

    counts = x.groupBy(*by, prefix(_ROUNDS[0]).alias("_b")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy(*by)))
    positions = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in positions])))
    counts = counts.withColumn("_ranks", F.transform(ranks, lambda r: F.struct(r.alias("at"), r.alias("rank"))))
    wanted = _holding_ranks(counts, by, "_b")
    for known, left_out in pairwise(_ROUNDS):
        inside = null_safe(x.withColumn("_b", prefix(known)), hint(wanted), [*by, "_b"])
        counts = inside.groupBy(*by, "_b", prefix(left_out).alias("_next")).agg(
            F.count("*").alias("_n"), F.max("_total").alias("_total"), F.max("_ranks").alias("_ranks")
        )
        wanted = _holding_ranks(counts, [*by, "_b"], "_next").drop("_b").withColumnRenamed("_next", "_b")
    found = wanted.withColumn("_v", from_ordered_bits(F.col("_b"))).withColumn("_rank", F.explode("_ranks.rank"))
    by_rank = found.groupBy(*by).agg(
        F.max("_total").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")
    )
    # The same arithmetic, and the same rounding, as the wanted ranks above.
    rows = [
        F.struct(
            F.lit(float(p)).alias("prob"),
            (
                F.element_at("_at", F.floor(pos))
                + (F.element_at("_at", F.ceil(pos)) - F.element_at("_at", F.floor(pos))) * (pos - F.floor(pos))
            ).alias("value"),
        )
        for p, pos in zip(probs, positions)
    ]
    return by_rank.select(*by, F.explode(F.array(*rows)).alias("_row")).select(*by, "_row.prob", "_row.value")


_MOMENTS = "n long, base array<double>, mean array<double>, c array<double>"


def _co_moments(rows: DataFrame, width: int, merge: bool = False) -> DataFrame:
    """Rows (n, base, mean, c), one per task: count, means from ``base`` on, sums of products of deviations.

    From complete rows of numbers, or with ``merge`` from such rows (Chan, Golub and LeVeque). ``base`` is one of the rows:
    a constant column has deviations of exactly zero, and large values lose no digits.
    """

    def parts(batch):
        if merge:
            for row in batch.to_pylist():
                yield row["n"], np.array(row["base"]), np.array(row["mean"]), np.array(row["c"]).reshape(width, width)
            return
        whole = np.ones(batch.num_rows, dtype=bool)
        for column in batch.columns:
            whole &= column.is_valid().to_numpy(zero_copy_only=False)
        x = np.stack([c.to_numpy(zero_copy_only=False)[whole] for c in batch.columns], axis=1).astype(float)
        if len(x):
            off = x - x[0]
            apart = off - off.mean(0)
            yield len(x), x[0], off.mean(0), apart.T @ apart

    def task(batches):
        n, base, mean, c, any_row = 0, np.zeros(width), np.zeros(width), np.zeros((width, width)), False
        with np.errstate(all="ignore"):
            for batch in batches:
                any_row = any_row or batch.num_rows > 0
                for n2, base2, mean2, c2 in parts(batch):
                    if not n2:
                        continue
                    if not n:
                        n, base, mean, c = n2, base2, mean2, c2
                        continue
                    gap, total = (base2 - base) + (mean2 - mean), n + n2
                    c = c + c2 + np.outer(gap, gap) * (n * n2 / total)
                    mean, n = mean + gap * (n2 / total), total
        if any_row:
            row = {"n": n, "base": base.tolist(), "mean": mean.tolist(), "c": c.ravel().tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=shape)

    numbers = pa.list_(pa.float64())
    shape = pa.schema([("n", pa.int64()), ("base", numbers), ("mean", numbers), ("c", numbers)])
    return rows.mapInArrow(task, _MOMENTS)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle ``(var_x, var_y, r)`` over the rows that have every column; null for a constant column.

    An incomplete row counts in no pair, but a pair is listed even if no row is complete; an empty table gives no rows.
    One pass: each task makes one row of count, means and co-moments of its rows by matrix products, and these
    are merged. Nothing is fanned out, and no more than the square of the number of columns is held.
    """
    names = list(columns)
    values = df.select(*[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(names)])
    merged = _co_moments(_co_moments(values, len(names)).repartition(1), len(names), merge=True)

    def triangle(batches):
        for batch in batches:
            for row in batch.to_pylist():
                c, size = row["c"], len(names)
                found = []
                for i, x in enumerate(names):
                    for j, y in enumerate(names[:i]):
                        xx, yy = c[i * size + i], c[j * size + j]
                        known = row["n"] > 1 and xx != 0 and yy != 0
                        r = float(c[i * size + j] / np.sqrt(xx) / np.sqrt(yy)) if known else None
                        found.append({"var_x": x, "var_y": y, "r": r})
                yield pa.RecordBatch.from_pylist(found, schema=shape)

    shape = pa.schema([("var_x", pa.string()), ("var_y", pa.string()), ("r", pa.float64())])
    return merged.mapInArrow(triangle, "var_x string, var_y string, r double")


def histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 30, few_groups: bool = False) -> DataFrame:
    """Counts in equal-width bins from each group's minimum to its maximum, as ``(*by, bin, n)``, bin from 1.

    The maximum belongs to the last bin; empty bins are not listed. ``few_groups`` as in
    :func:`exact_quantiles`.
    """
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = null_safe(known.select(*by, value), F.broadcast(ends) if few_groups else ends, list(by))
    width = F.col("_hi") - F.col("_lo")
    position = F.floor((F.col(value) - F.col("_lo")) / width * bins) + 1
    bin_no = F.when(width > 0, F.least(position, F.lit(bins).cast("bigint"))).otherwise(F.lit(1).cast("bigint"))
    return placed.withColumn("bin", bin_no).groupBy(*by, "bin").agg(F.count("*").alias("n"))
