"""Overlay of polygons with very many vertices: their sides are cut up along a grid, and a cell carries only its own.

A side is cut where it crosses lines of the grid on which the other layer's polygons lie in at most four cells. In
a cell the polygon is known from the fragments there and from how often it winds round the cell's upper left corner.
That number follows from where sides cross the vertical line below or above the corner, and changes along the
cell's upper edge at each fragment that crosses it; so the polygon is never put together again, and a cell that
lies wholly inside needs no row. Which lines a fragment crosses is decided by the numbers of its ends' rows and columns
alone, the same for the two sides at a vertex, so vertices and sides that lie on grid lines are counted right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.functions import geometry as G
from areal_exposure.operators.overlay import boxed, level_size, levels_of, meeting_pairs

_SIDE = "struct<sign:double,x0:double,x1:double,y0:double,slope:double>"


def _side(sign: Column, x0: Column, x1: Column, y0: Column, slope: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((sign, "sign"), (x0, "x0"), (x1, "x1"), (y0, "y0"), (slope, "slope"))])


def _sides(geom: Column) -> Column:
    """All sides of a polygon as drawn, from a to b."""
    return F.flatten(
        F.transform(
            geom,
            lambda r: F.transform(
                r,
                lambda p, i: F.struct(
                    p["x"].alias("xa"), p["y"].alias("ya"), F.get(r, (i + 1) % F.size(r))["x"].alias("xb"), F.get(r, (i + 1) % F.size(r))["y"].alias("yb")
                ),
            ),
        )
    )


def _cuts(a: Column, b: Column, first: Column, last: Column, here: Column, size: Column) -> tuple[Column, Column]:
    """Where a stretch from a to b, from line number ``first`` to ``last``, enters and leaves the lane ``here``."""
    onwards = first <= last
    enters = F.when(here == first, a).otherwise(F.when(onwards, here).otherwise(here + 1) * size)
    leaves = F.when(here == last, b).otherwise(F.when(onwards, here + 1).otherwise(here) * size)
    return enters, leaves


def _along(t: Column, a: Column, b: Column, u: Column, v: Column) -> Column:
    """The value between u and v where the other coordinate, which goes from a to b, is t."""
    between = u + (v - u) * F.try_divide(t - a, b - a)
    return F.when(t == a, u).when(t == b, v).otherwise(F.least(F.greatest(between, F.least(u, v)), F.greatest(u, v)))


def cut_up(layer: DataFrame, key: str, geom: str, levels: Column) -> tuple[DataFrame, DataFrame]:
    """Fragments by cell ``(key, _level, _gx, _gy, sides)`` and crossings of the lines between columns ``(key, _level, _gx, crossings)``.

    ``levels`` is an array of grid levels (cells of 4**level). There are as many fragments as sides and crossed cells.
    """
    sides = layer.select(key, F.explode(_sides(F.col(geom))).alias("e")).select(key, "e.*")
    sides = sides.select("*", F.explode(levels).alias("_level")).withColumn("_size", level_size(F.col("_level")))
    size = F.col("_size")

    def line(c: str) -> Column:
        return F.floor(F.col(c) / size)

    sides = sides.withColumns({"_ca": line("xa"), "_cb": line("xb")})
    ca, cb = F.col("_ca"), F.col("_cb")
    columns = sides.withColumn("_gx", F.explode(F.sequence(ca, cb)))
    enters, leaves = _cuts(F.col("xa"), F.col("xb"), ca, cb, F.col("_gx"), size)
    columns = columns.withColumns({"_xs": enters, "_xe": leaves})

    def height(x: str) -> Column:
        return _along(F.col(x), F.col("xa"), F.col("xb"), F.col("ya"), F.col("yb"))

    ends = {"_ys": F.when(F.col("_gx") == ca, F.col("ya")).otherwise(height("_xs")), "_ye": F.when(F.col("_gx") == cb, F.col("yb")).otherwise(height("_xe"))}
    columns = columns.withColumns(ends).withColumns({"_rs": F.floor(F.col("_ys") / size), "_re": F.floor(F.col("_ye") / size)})

    # Rightward sides lie below what they bound, so they count -1 for a point beneath them.
    rightward = columns.where((ca < cb) & (F.col("_gx") > ca)).select(key, "_level", "_gx", F.col("_rs").alias("row"), F.lit(-1).alias("sign"))
    leftward = columns.where((ca > cb) & (F.col("_gx") < ca)).select(key, "_level", (F.col("_gx") + 1).alias("_gx"), F.col("_rs").alias("row"), F.lit(1).alias("sign"))
    crossed = rightward.unionByName(leftward).groupBy(key, "_level", "_gx", "row").agg(F.sum("sign").alias("sign")).where("sign != 0")
    crossings = crossed.groupBy(key, "_level", "_gx").agg(F.collect_list(F.struct("row", "sign")).alias("crossings"))

    rs, re = F.col("_rs"), F.col("_re")
    cells = columns.withColumn("_gy", F.explode(F.sequence(rs, re)))
    low, high = _cuts(F.col("_ys"), F.col("_ye"), rs, re, F.col("_gy"), size)
    cells = cells.withColumns({"_y1": low, "_y2": high})
    x1, x2 = (_along(F.col(y), F.col("_ys"), F.col("_ye"), F.col("_xs"), F.col("_xe")) for y in ("_y1", "_y2"))
    cells = cells.withColumns({"_x1": F.when(F.col("_gy") == rs, F.col("_xs")).otherwise(x1), "_x2": F.when(F.col("_gy") == re, F.col("_xe")).otherwise(x2)})
    from_x, to_x, slope = F.col("_x1"), F.col("_x2"), F.try_divide(F.col("yb") - F.col("ya"), F.col("xb") - F.col("xa"))
    rightwards = from_x < to_x
    fragment = _side(F.when(rightwards, -1).otherwise(1), F.least(from_x, to_x), F.greatest(from_x, to_x), F.when(rightwards, F.col("_y1")).otherwise(F.col("_y2")), slope)
    fragment = F.when(from_x != to_x, F.array(fragment))
    # Going right along the cell's upper edge, a side that goes up is where the polygon ends, one that goes down where it begins.
    edge, right = (F.col("_gy") + 1) * size, (F.col("_gx") + 1) * size
    up, down = (rs < re) & (F.col("_gy") < re), (rs > re) & (F.col("_gy") < rs)
    over = F.when(up, F.array(_side(F.lit(-1), to_x, right, edge, F.lit(0)))).when(down, F.array(_side(F.lit(1), from_x, right, edge, F.lit(0))))
    none = F.array().cast(f"array<{_SIDE}>")
    both = F.concat(F.coalesce(fragment, none), F.coalesce(over, none))
    fragments = cells.select(key, "_level", "_gx", "_gy", F.explode(both).alias("side")).groupBy(key, "_level", "_gx", "_gy")
    return fragments.agg(F.collect_list("side").alias("sides")), crossings


def _side_level(layer: DataFrame, geom: str) -> Column:
    """Grid level of the layer's mean side, as a scalar; finer cells would cut sides up for nothing."""
    length = F.transform(_sides(F.col(geom)), lambda e: F.sqrt((e["xb"] - e["xa"]) * (e["xb"] - e["xa"]) + (e["yb"] - e["ya"]) * (e["yb"] - e["ya"])))
    sums = layer.select(F.size(length).alias("n"), F.aggregate(length, F.lit(0.0), lambda s, v: s + v).alias("length")).where("n > 0")
    mean = F.sum("length") / F.sum("n")
    return sums.agg(F.when(mean > 0, F.greatest(F.ceil(F.log2(mean) / 2), F.lit(-10))).otherwise(F.lit(0)).cast("int")).scalar()


def detailed_overlap_join(
    detailed: DataFrame, others: DataFrame, detailed_key: str, other_key: str, geom: str = "geom", other_geom: str = "other_geom", on: Sequence[str] = (), **skew: int
) -> DataFrame:
    """Pairs ``(detailed_key, other_key, area_intersect)`` that share area, as by ``overlap_join``, for detailed polygons.

    Keys name one polygon each, and are not null; empty and null polygons meet nothing. The bytes that are moved
    grow with the vertices of ``detailed`` and with the pairs, not with their product, and a single polygon is
    spread over as many tasks as it has cells. Cells are not finer than the mean side, so sides are cut few times. Polygons of ``others`` travel whole, so give the layer with the larger
    polygons as ``detailed``.
    """
    box = G.box(F.col(geom))
    extended = (box["x0"] < box["x1"]) & (box["y0"] < box["y1"])
    outline = F.when(extended, G.rectangle(box["x0"], box["y0"], box["x1"], box["y1"]))
    outlines = detailed.select(*on, detailed_key, outline.alias("_outline"))
    finest = _side_level(detailed, geom)

    def on_grid(df: DataFrame) -> DataFrame:
        return boxed(df, other_geom, "o").withColumn("_o_level", F.greatest("_o_level", finest))

    b = F.col("_o")
    measured = on_grid(others.select(other_geom)).where((b["x0"] < b["x1"]) & (b["y0"] < b["y1"]))
    fragments, crossings = cut_up(detailed.select(detailed_key, geom), detailed_key, geom, levels_of(measured, "o"))

    pairs = meeting_pairs(outlines, others.select(*on, other_key, other_geom), "_outline", other_geom, on, **skew).drop("_outline", "_common")
    placed = on_grid(pairs).withColumn("_level", F.col("_o_level"))
    size = level_size(F.col("_level"))

    def lanes(lo: str, hi: str) -> Column:
        first = F.floor(b[lo] / size)
        return F.sequence(first, F.greatest(first, F.ceil(b[hi] / size) - 1))

    placed = placed.withColumn("_gx", F.explode(lanes("x0", "x1"))).withColumn("_gy", F.explode(lanes("y0", "y1")))
    here = placed.join(fragments, [detailed_key, "_level", "_gx", "_gy"], "left").join(crossings, [detailed_key, "_level", "_gx"], "left")
    above = F.filter("crossings", lambda c: c["row"] > F.col("_gy"))
    winding = F.coalesce(F.aggregate(above, F.lit(0).cast("bigint"), lambda s, c: s + c["sign"]), F.lit(0))
    x0, y0 = F.col("_gx") * size, F.col("_gy") * size
    none = F.array().cast(f"array<{_SIDE}>")
    base = F.when(F.col("_winding") != 0, F.array(_side(F.col("_winding"), x0, x0 + size, y0 + size, F.lit(0)))).otherwise(none)
    here = here.withColumn("_winding", winding).withColumn("_sides", F.concat(F.coalesce("sides", none), base)).where(F.size("_sides") > 0)
    whole = (x0 <= b["x0"]) & (b["x1"] <= x0 + size) & (y0 <= b["y0"]) & (b["y1"] <= y0 + size)
    cell = F.get(G.rectangle(x0, y0, x0 + size, y0 + size), F.lit(0))
    here = here.withColumn("_within", F.when(whole, F.col(other_geom)).otherwise(G.clip_to_convex(F.col(other_geom), cell)))
    here = here.withColumn("_edges", G.edges(F.col("_within")))
    part = here.select(*on, detailed_key, other_key, G.overlap_area(F.col("_edges"), F.col("_sides")).alias("_part"), ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("_box"))
    total = part.groupBy(*on, detailed_key, other_key).agg(F.sum("_part").alias("area_intersect"), F.max("_box").alias("_box"))
    return total.where(F.col("area_intersect") > F.col("_box") * 2.0**-44).drop("_box")
