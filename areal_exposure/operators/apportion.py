"""Pounds carried from sections to densities, tracts and school surroundings by share of area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import geometry as G
from areal_exposure.functions import values as V
from areal_exposure.operators.fragments import detailed_overlap_join
from areal_exposure.operators.joins import many_to_many
from areal_exposure.operators.overlay import overlap_join, overlap_pieces


def acres(area, square_units_per_acre: float = K.SQ_METRES_PER_ACRE):
    return area / F.lit(square_units_per_acre)


def on_section_map(totals: DataFrame, sections: DataFrame) -> DataFrame:
    """Totals with their section's polygon; sections that are not on the map drop out.

    Both sides hold one row per section (and chemical, year), so no key is hot here.
    """
    return sections.select("co_mtrs", "geom").join(totals, "co_mtrs")


def section_density(
    totals: DataFrame, sections: DataFrame, square_units_per_acre: float = K.SQ_METRES_PER_ACRE, geometry: bool = False
) -> DataFrame:
    """Pounds per 100 acres of section. The area is taken before the join, so polygons travel only if asked for."""
    shape = ["geom"] if geometry else []
    measured = sections.select(
        "co_mtrs", acres(G.area(F.col("geom")), square_units_per_acre).alias("section_total_acres"), *shape
    )
    rate = V.ratio("pounds", "section_total_acres", 100)
    return measured.join(totals, "co_mtrs").withColumn("pounds_per_100_acres", rate)


def section_tract_shares(
    sections: DataFrame, tracts: DataFrame, square_units_per_acre: float = K.SQ_METRES_PER_ACRE, detailed: bool = False, **skew: int
) -> DataFrame:
    """Which part of each section lies in which tract: ``(co_mtrs, geoid, area_intersect, area_proportion)``.

    The whole-section area rides along through the overlay, which saves joining it back. ``detailed`` is for tracts
    of thousands of vertices, whose sides are then cut up along the grid; co_mtrs and geoid must be unique.
    """
    whole = sections.select("co_mtrs", "geom", G.area(F.col("geom")).alias("_area"))
    if detailed:
        layer = sections.select("co_mtrs", F.col("geom").alias("other_geom"))
        pieces = detailed_overlap_join(tracts.select("geoid", "geom"), layer, "geoid", "co_mtrs", **skew).join(whole.drop("geom"), "co_mtrs")
    else:
        pieces = overlap_join(whole, tracts.select("geoid", F.col("geom").alias("other_geom")), **skew)
    return pieces.select(
        "co_mtrs",
        "geoid",
        acres(F.col("area_intersect"), square_units_per_acre).alias("area_intersect"),
        V.ratio("area_intersect", "_area").alias("area_proportion"),
    )


def tract_totals(shares: DataFrame, totals: DataFrame, pounds: str = "pounds") -> DataFrame:
    """Pounds per chemical and tract: section totals weighted by the part of the section in the tract."""
    weighted = shares.join(totals, "co_mtrs").withColumn("_weighted", F.col(pounds) * F.col("area_proportion"))
    return weighted.groupBy("chem_code", "geoid").agg(V.sum_or_zero("_weighted").alias(pounds))


def crops_by_section(crops: DataFrame, sections: DataFrame, **skew: int) -> DataFrame:
    """Cropland polygons cut along section lines, each piece with its section key."""
    layer = sections.select("co_mtrs", F.col("geom").alias("other_geom"))
    return overlap_pieces(crops, layer, **skew).drop("area_intersect")


def cropland_years(
    crop_pieces: DataFrame,
    by_water_year: DataFrame,
    codes: Sequence[str] = tuple(K.CHEMICALS),
    square_units_per_acre: float = K.SQ_METRES_PER_ACRE,
) -> DataFrame:
    """Per section and water year: whole cropland area and pounds, one column per chemical (null where unused)."""
    key = ["co_mtrs", "water_year"]
    used = by_water_year.groupBy(*key).agg(
        *[F.max(F.when(F.col("chem_code") == c, F.col("pounds"))).alias(f"_pounds_{c}") for c in codes]
    )
    size = acres(G.area(F.col("geom")), square_units_per_acre)
    whole = crop_pieces.select(*key, size.alias("_acres")).groupBy(*key).agg(F.sum("_acres").alias("crops_acres"))
    return whole.join(used, key)


def school_buffers(
    schools: DataFrame, radii: Sequence[float] = K.BUFFER_MILES, units_per_mile: float = K.METRES_PER_MILE, directions: int = 64
) -> DataFrame:
    """One row per distinct school row and radius (in miles), polygon grown by the radius."""
    sized = schools.dropDuplicates().withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    return sized.withColumn("geom", G.buffer(F.col("geom"), F.col("radius") * units_per_mile, directions))


def buffer_crop_acres(
    buffers: DataFrame, crop_pieces: DataFrame, square_units_per_acre: float = K.SQ_METRES_PER_ACRE, **skew: int
) -> DataFrame:
    """Cropland inside each school buffer, per section and water year. One overlay serves all radii."""
    school = [c for c in buffers.columns if c != "geom"]
    crops = crop_pieces.select("co_mtrs", "water_year", "geom")
    pieces = overlap_join(buffers.withColumnRenamed("geom", "_buffer"), crops, "_buffer", "geom", **skew)
    inside = acres(F.sum("area_intersect"), square_units_per_acre).alias("intersection_acres")
    return pieces.groupBy(*school, "co_mtrs", "water_year").agg(inside)


def crop_fractions(
    inside: DataFrame, years: DataFrame, codes: Sequence[str] = tuple(K.CHEMICALS), **skew: int
) -> DataFrame:
    """Part of the section-year's cropland inside the buffer and its pounds, per chemical used there.

    ``inside`` is :func:`buffer_crop_acres`, ``years`` is :func:`cropland_years`. Joined after the overlay, so
    that no polygon is shuffled for it; a section-year near many schools is split. The join counts ``inside``
    first, so hand over a written table.
    """
    key = ["co_mtrs", "water_year"]
    joined = many_to_many(inside, years, key, **skew)
    per_chemical = F.array(
        *[F.struct(F.lit(c).alias("chem_code"), F.col(f"_pounds_{c}").alias("pounds")) for c in codes]
    )
    used = F.filter(per_chemical, lambda s: s["pounds"].isNotNull())
    rows = joined.withColumn("_use", F.explode(used)).select(*inside.columns, "crops_acres", "_use.*")
    fraction = V.ratio("intersection_acres", "crops_acres")
    return rows.withColumns(
        {"intersection_fraction": fraction, "pounds_intersection": fraction * F.col("pounds")}
    )


def school_totals(fractions: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Estimated pounds per chemical, radius and school; null if any part is unknown."""
    return fractions.groupBy("chem_code", "radius", *attributes).agg(
        V.sum_or_null("pounds_intersection").alias("pounds")
    )


def radius_column(radius: float) -> str:
    return "pounds_" + f"{radius:g}".replace(".", "_")


def two_buffers(totals: DataFrame, attributes: Sequence[str], radii: Sequence[float] = K.BUFFER_MILES) -> DataFrame:
    """One row per chemical and school with a pounds column per radius, null where the buffer has none.

    The same rows as a full join of the per-radius tables on all shared columns (grouping matches null with
    null too), for one shuffle of already small rows.
    """
    return totals.groupBy("chem_code", *attributes).agg(
        *[F.max(F.when(F.col("radius") == r, F.col("pounds"))).alias(radius_column(r)) for r in radii]
    )


def exposed_to_both(wide: DataFrame, column: str, codes: Sequence[str] = tuple(K.CHEMICALS)) -> DataFrame:
    """Schools whose buffer has a total for each of the chemicals, however many; one row a school."""
    known = wide.where(F.col(column).isNotNull() & F.col("chem_code").isin(*codes))
    counted = known.groupBy("cds_code").agg(F.min("school").alias("school"), F.count_distinct("chem_code").alias("_n"))
    return counted.where(F.col("_n") == len(set(codes))).select("cds_code", "school")


def pounds_mismatch(pieces: DataFrame, crops: DataFrame, keys: Sequence[str], pounds: str = "pounds") -> DataFrame:
    """Rows whose pounds differ between the two inputs; none are expected."""
    other = crops.select(*keys, F.col(pounds).alias("_other"))
    return many_to_many(pieces, other, keys).where(F.col(pounds) != F.col("_other")).drop("_other")
