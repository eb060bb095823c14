"""Polygon layers as GeoJSON, one feature per line, and yearly output folders.

The usual writers put one feature per line even inside a ``FeatureCollection``, so such files are read as
lines and split over tasks. A file that holds the whole collection in a single line or spreads a feature over
several lines is read with ``whole_file``: in byte ranges too, whose nesting is worked out from all before them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areal_exposure.functions import geometry as G
from areal_exposure.functions.projection import map_points
from areal_exposure.sources.order import FILE_ORDER, file_order
from areal_exposure.sources.ranges import collection_members

_RING = "array<array<double>>"


def _vertices(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def _polygon(rings: Column) -> Column:
    return G.orient(G.open_rings(_vertices(rings)))


def _parse(kind: Column, coordinates: Column) -> Column:
    strict = {"mode": "FAILFAST"}
    one = F.from_json(F.when(kind == "Polygon", coordinates), f"array<{_RING}>", strict)
    many = F.from_json(F.when(kind == "MultiPolygon", coordinates), f"array<array<{_RING}>>", strict)
    return F.when(kind == "Polygon", _polygon(one)).when(kind == "MultiPolygon", F.flatten(F.transform(many, _polygon)))


def _shape(geometry: Column) -> Column:
    """The polygons of a geometry; of a collection, those of its members (lines and points have no area)."""
    members = F.filter(geometry["geometries"], lambda g: g["type"].isin("Polygon", "MultiPolygon"))
    collected = F.flatten(F.transform(members, lambda g: _parse(g["type"], g["coordinates"])))
    other = F.raise_error(F.concat(F.lit("geometry that is no polygon, collection or point: "), geometry["type"]))
    return (
        F.when(geometry["type"] == "GeometryCollection", collected)
        .when(geometry["type"].isNull() | geometry["type"].isin("Polygon", "MultiPolygon", "Point"), _parse(geometry["type"], geometry["coordinates"]))
        .otherwise(other.cast("array<array<struct<x:double,y:double>>>"))
    )


def _checked(feature: Column) -> Column:
    wrong = F.raise_error(F.lit("an object that is no feature, or one that can't be read"))
    return F.when(feature["type"] == "Feature", feature).otherwise(wrong)


def _features(raw: DataFrame, properties: StructType, further: Sequence[Column] = ()) -> DataFrame:
    """Rows of one struct ``feature`` to property columns and ``geom`` (``x``/``y`` for points)."""
    raw = raw.withColumn("feature", _checked(F.col("feature")))
    kind, coordinates = F.col("feature.geometry.type"), F.col("feature.geometry.coordinates")
    xy = F.from_json(F.when(kind == "Point", coordinates), "array<double>", {"mode": "FAILFAST"})
    return raw.select(
        *[F.col("feature.properties")[n].alias(n) for n in properties.names],
        _shape(F.col("feature.geometry")).alias("geom"),
        F.when(kind == "Point", G.point(F.get(xy, F.lit(0)), F.get(xy, F.lit(1)))).alias("point"),
        "path",
        *further,
    )


def read_layer(
    spark: SparkSession,
    path: str | Sequence[str],
    properties: str,
    whole_file: bool = False,
    pattern: str | None = None,
    with_path: bool = False,
    with_order: bool = False,
) -> DataFrame:
    """Polygon features below ``path`` (all files stacked), with the given property columns, e.g. ``"co_mtrs string"``.

    A property that some file lacks is null there. A line may hold several features, and the end of a collection
    after them. A line from which not every feature it announces can be read fails the job, and so does a whole
    collection in one line; wrapper lines without a feature are skipped. Point features come back in ``point``;
    of a collection of geometries the polygons count; other kinds fail the job. ``with_order`` adds ``file_order``,
    which sorts features as they stand in the files, by path.
    """
    props, shape = StructType.fromDDL(properties), "type:string,coordinates:string"
    feature = f"struct<type:string,properties:{props.simpleString()},geometry:struct<{shape},geometries:array<struct<{shape}>>>>"
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if whole_file:
        pieces = reader.option("lineSep", "}").text(path).select("value", file_order(), F.col("_metadata.file_size").alias("size"))
        members = collection_members(pieces)
        held = F.from_json("value", feature, {"mode": "FAILFAST"})
        raw = members.select(held.alias("feature"), F.col(f"{FILE_ORDER}.path").alias("path"), FILE_ORDER, "place")
    else:
        announced = F.regexp_count(F.col("value"), F.lit(r'"type"\s*:\s*"Feature"'))
        whole = F.col("value").rlike(r'"type"\s*:\s*"FeatureCollection"')
        order = [file_order()] if with_order else []
        lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), announced.alias("n"), *order)
        lines = lines.where(F.col("n") > 0)
        array = F.concat(F.lit("["), F.regexp_replace(F.trim("value"), r",$", ""), F.lit("]"))
        text = F.when(whole, F.raise_error(F.lit("a collection begins in a line with features: read it with whole_file=True"))).otherwise(array)
        held = F.from_json(text, f"array<{feature}>", {"mode": "FAILFAST"})
        raw = lines.select("path", "n", held.alias("held"), *([FILE_ORDER] if with_order else []))
        lost = F.raise_error(F.lit("a line announces features that can't be read")).cast(f"array<{feature}>")
        all_read = F.when(F.size("held") == F.col("n"), F.col("held")).otherwise(lost)
        raw = raw.select("path", *([FILE_ORDER] if with_order else []), F.posexplode(all_read).alias("place", "feature"))
    placed = [F.struct(f"{FILE_ORDER}.*", "place").alias(FILE_ORDER)] if with_order else []
    out = _features(raw, props, placed)
    return out if with_path else out.drop("path")


def _geometry_json(geom: Column) -> Column:
    """Shells start a polygon, the clockwise rings after a shell are its holes."""
    rings = F.transform(
        geom,
        lambda r: F.struct(
            (G.ring_area(r) >= 0).alias("shell"),
            F.transform(F.concat(r, F.slice(r, 1, 1)), lambda p: F.array(p["x"], p["y"])).alias("ring"),
        ),
    )
    empty = F.array().cast(f"array<array<{_RING}>>")
    polygons = F.aggregate(
        rings,
        empty,
        lambda done, r: F.when(r["shell"] | (F.size(done) == 0), F.concat(done, F.array(F.array(r["ring"])))).otherwise(
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.concat(F.get(done, F.size(done) - 1), F.array(r["ring"]))),
            )
        ),
    )
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(polygons, F.lit(0)).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")))
    return F.when(geom.isNull(), F.lit("null")).when(F.size(polygons) == 1, single).otherwise(multi)


def feature_lines(df: DataFrame, geom: str = "geom", point: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One text column ``value`` with a GeoJSON feature per row; other columns become properties, nulls kept."""
    names = [c for c in df.columns if c not in (geom, point)]
    if point:
        p = F.col(point)
        shape = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(p["x"], p["y"]).alias("coordinates")))
    else:
        shape = _geometry_json(F.col(geom))
    props = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    text = F.concat(
        F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(shape, F.lit("null")), F.lit("}")
    )
    return df.select(text.alias("value"), *keep)


def moved(layer: DataFrame, move: Callable[[Column, Column], tuple[Column, Column]], geom: str = "geom") -> DataFrame:
    """A layer on other coordinates: ``CALIFORNIA.forward`` after reading degrees, ``.inverse`` before writing them."""
    return layer.withColumn(geom, map_points(F.col(geom), move))


def write_layer(df: DataFrame, path: str, geom: str = "geom", point: str | None = None) -> None:
    feature_lines(df, geom, point).write.text(path)


def _by_folder(df: DataFrame, column: str, replace: bool) -> DataFrameWriter:
    """The rebalance hint lets adaptive execution cut a large year into several files and merge small ones."""
    writer = df.hint("rebalance", column).write.partitionBy(column)
    return writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else writer


def write_layer_by(df: DataFrame, path: str, column: str, geom: str = "geom", replace: bool = False) -> None:
    """One subfolder per value of ``column``, in a single pass; fails if there is something at ``path``.

    With ``replace`` the subfolders of the values that are in ``df`` take the place of earlier ones and the others stay
    as they are. The new files are staged and moved when all are written: a run that fails leaves the old ones.
    """
    _by_folder(feature_lines(df, geom, keep=[column]), column, replace).text(path)


def write_table_by(df: DataFrame, path: str, column: str, replace: bool = False) -> None:
    """The same as Parquet."""
    _by_folder(df, column, replace).parquet(path)


def stack(layers: Sequence[DataFrame]) -> DataFrame:
    """Layers one below the other by column name; a missing column is null."""
    first, *rest = layers
    for layer in rest:
        first = first.unionByName(layer, allowMissingColumns=True)
    return first
