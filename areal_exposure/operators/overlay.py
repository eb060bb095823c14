"""Spatial overlay: which polygons of two layers meet, over what area, and the common pieces.

Each polygon is put on a grid whose square cell is the power of four just above its longer side, so it touches at
most four cells whatever its size. A pair meets on the coarser grid of the two; polygons are
therefore also listed on those coarser grids that the other layer uses. A pair is kept only in the one cell
that holds the lower-left corner of the common box (Dittrich and Seeger 2000), so no ``distinct`` follows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.functions import geometry as G
from areal_exposure.operators.joins import split_hot

_CELL = ("_level", "_gx", "_gy")
_FINEST = -10  # smaller shapes share the grid of 4**-10 units, which keeps cell numbers within 64 bits


def _level(lo: Column, hi: Column) -> Column:
    """Exponent of the cell size; a shape without extent gets the finest one (it is listed in no cell)."""
    extent = F.when(hi > lo, hi - lo)
    return F.coalesce(F.greatest(F.ceil(F.log2(extent) / 2), F.lit(_FINEST)), F.lit(_FINEST)).cast("int")


def level_size(level: Column) -> Column:
    """Side of a grid cell."""
    return F.pow(F.lit(4.0), level)


def boxed(layer: DataFrame, geom: str, side: str) -> DataFrame:
    """Add the bounding box and its grid level, that of its longer side."""
    b = F.col(f"_{side}")
    boxed = layer.withColumn(f"_{side}", G.box(F.col(geom)))
    level = F.greatest(_level(b["x0"], b["x1"]), _level(b["y0"], b["y1"]))
    return boxed.withColumn(f"_{side}_level", level)


def levels_of(boxed: DataFrame, side: str) -> Column:
    """All grid levels of a layer as one array. There are a few dozen at most: sizes by powers of four."""
    return boxed.agg(F.sort_array(F.collect_set(f"_{side}_level"))).scalar()


def _in_cells(boxed: DataFrame, side: str, other_levels: Column) -> DataFrame:
    """One row per cell the box touches, on its own grid or the other layer's coarser ones.

    Polygons without extent cannot share area and are listed nowhere.
    """
    b = F.col(f"_{side}")
    grids = F.array_distinct(F.transform(F.col("_other"), lambda o: F.greatest(F.col(f"_{side}_level"), o)))

    def span(lo: str, hi: str, level: Column) -> Column:
        return F.sequence(F.floor(b[lo] / level_size(level)), F.floor(b[hi] / level_size(level)))

    def cells(g: Column) -> Column:
        columns = F.transform(
            span("x0", "x1", g),
            lambda gx: F.transform(
                span("y0", "y1", g), lambda gy: F.struct(g.alias("_level"), gx.alias("_gx"), gy.alias("_gy"))
            ),
        )
        return F.flatten(columns)

    has_area = (b["x0"] < b["x1"]) & (b["y0"] < b["y1"])
    listed = boxed.withColumn("_other", other_levels).select(
        *boxed.columns, F.explode(F.when(has_area, F.flatten(F.transform(grids, cells)))).alias("_cell")
    )
    return listed.select(*boxed.columns, "_cell.*")


def meeting_pairs(
    left: DataFrame,
    right: DataFrame,
    left_geom: str,
    right_geom: str,
    on: Sequence[str] = (),
    parts: int = 64,
    min_rows: int = 20_000,
) -> DataFrame:
    """Pairs whose bounding boxes share area, each once, with all columns of both layers and ``_common``.

    ``_common`` is the area of the common box. Apart from ``on`` the layers must not share column names.
    Cells that hold a large part of a layer are split over tasks (see
    :func:`~areal_exposure.operators.joins.split_hot`).
    """
    lb, rb = boxed(left, left_geom, "l"), boxed(right, right_geom, "r")
    lc, rc = _in_cells(lb, "l", levels_of(rb, "r")), _in_cells(rb, "r", levels_of(lb, "l"))

    def told_apart_by(df: DataFrame, geom: str, side: str) -> list[str]:
        return [c for c in df.columns if c != geom] + [f"_{side}"]

    l2, r2, keys = split_hot(
        lc, rc, [*on, *_CELL], told_apart_by(left, left_geom, "l"), told_apart_by(right, right_geom, "r"), parts, min_rows
    )
    lbox, rbox = F.col("_l"), F.col("_r")
    x0, y0 = F.greatest(lbox["x0"], rbox["x0"]), F.greatest(lbox["y0"], rbox["y0"])
    x1, y1 = F.least(lbox["x1"], rbox["x1"]), F.least(lbox["y1"], rbox["y1"])
    once = (
        (x0 < x1)
        & (y0 < y1)
        & (F.greatest("_l_level", "_r_level") == F.col("_level"))
        & (F.floor(x0 / level_size(F.col("_level"))) == F.col("_gx"))
        & (F.floor(y0 / level_size(F.col("_level"))) == F.col("_gy"))
    )
    columns = [c for df in (left, right) for c in df.columns if c not in on]
    # Pairs cost far more than their sides' bytes: a small side is not broadcast, which would leave all work to the few
    # partitions of the other.
    return l2.hint("shuffle_merge").join(r2, keys).where(once).select(*on, *columns, ((x1 - x0) * (y1 - y0)).alias("_common"))


def _computed_once(value: Column, area: str | None) -> Column:
    """Generator of one row with ``value`` where its area counts, none where it does not.

    Borders that touch give an area of a few rounding errors of the common box's; a piece is kept unless its area is
    below that noise, so thin slivers stay. A plain filter would be pushed into the join and compute the value there
    a second time.
    """
    floor = F.col("_common") * 2.0**-50
    return F.explode(F.filter(F.array(value), lambda v: (v if area is None else v[area]) > floor))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_geom: str = "geom",
    right_geom: str = "other_geom",
    on: Sequence[str] = (),
    **skew: int,
) -> DataFrame:
    """Pairs of polygons that share area, with ``area_intersect`` in squared units of the layers.

    Polygons travel as vertices; their edges are worked out where the pair meets.
    """
    pairs = meeting_pairs(left, right, left_geom, right_geom, on, **skew)
    edged = pairs.withColumns({"_le": G.edges(F.col(left_geom)), "_re": G.edges(F.col(right_geom))})
    area = _computed_once(G.overlap_area(F.col("_le"), F.col("_re")), None)
    kept = [c for c in pairs.columns if c not in ("_common", left_geom, right_geom)]
    return edged.select(*kept, area.alias("area_intersect"))


def overlap_pieces(
    left: DataFrame,
    right: DataFrame,
    left_geom: str = "geom",
    right_geom: str = "other_geom",
    on: Sequence[str] = (),
    piece: str = "geom",
    **skew: int,
) -> DataFrame:
    """Like :func:`overlap_join`, with the common piece as a polygon for further overlay."""
    marked = right.withColumn("_convex", G.is_convex(F.col(right_geom)))
    pairs = meeting_pairs(left, marked, left_geom, right_geom, on, **skew)
    cut = pairs.withColumn("_piece", G.clip(F.col(left_geom), F.col(right_geom), F.col("_convex")))
    measured = _computed_once(F.struct(F.col("_piece").alias("g"), G.area(F.col("_piece")).alias("a")), "a")
    kept = [c for c in pairs.columns if c not in ("_common", "_convex", left_geom, right_geom)]
    return cut.select(*kept, measured.alias("_cut")).select(
        *kept, F.col("_cut.g").alias(piece), F.col("_cut.a").alias("area_intersect")
    )
