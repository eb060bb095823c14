"""The whole analysis: every published table and layer, written below one output folder.

``publish`` runs what a user of the original analysis runs from raw records to correlation matrix. Steps that
several outputs read are written once to shared storage (``sources.scratch.written``): they are then computed
once, and a lost executor costs one task, not the chain of steps before it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions.projection import CALIFORNIA
from areal_exposure.operators import apportion as A
from areal_exposure.operators import census as C
from areal_exposure.operators import joins as J
from areal_exposure.operators import records as R
from areal_exposure.operators import stats as S
from areal_exposure.operators import totals as T
from areal_exposure.plans import profile as P
from areal_exposure.sources import layers
from areal_exposure.sources.order import FILE_ORDER
from areal_exposure.sources.scratch import written
from areal_exposure.sources.text import write_text_table

QUINTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


@dataclass(frozen=True)
class Inputs:
    """The tables the analysis starts from. Polygons are planar and equal-area, in ``geom``."""

    chemicals: DataFrame  # code list as delivered, any columns
    records: DataFrame  # raw use records, all text
    errors: DataFrame  # use_no, year, ...
    counties: DataFrame  # county, county_code
    sections: DataFrame  # co_mtrs, geom
    crops: DataFrame  # water_year, class1.., subclass1.., geom
    schools: DataFrame  # cds_code, school, district, any further attributes, geom
    enrollment: DataFrame  # cds_code, enroll_total
    school_points: DataFrame  # cds_code, x, y; with file_order, the first in the files counts, else the least x, y
    vulnerability: DataFrame  # the social-vulnerability columns, geom
    census_tracts: DataFrame  # geoid, name, variable (names), estimate
    census_state: DataFrame  # the same for the one state row
    tracts: DataFrame  # geoid, aland, geom


@dataclass(frozen=True)
class Choices:
    years: tuple[int, int] = K.STUDY_YEARS
    chemicals: Mapping[str, str] = field(default_factory=lambda: dict(K.CHEMICALS))
    radii: Sequence[float] = K.BUFFER_MILES
    square_units_per_acre: float = K.SQ_METRES_PER_ACRE
    units_per_mile: float = K.METRES_PER_MILE
    directions: int = 64
    detailed_tracts: bool = False  # tracts of thousands of vertices, with unique geoid
    to_lonlat: Callable[[Column, Column], tuple[Column, Column]] | None = CALIFORNIA.inverse


def _write_years(yearly: DataFrame, cropland: DataFrame, sections: DataFrame, out: str, exported: Callable[[DataFrame], DataFrame], replace: bool = False) -> None:
    layers.write_layer_by(exported(A.on_section_map(yearly, sections)), f"{out}/section_years", "water_year", replace=replace)
    layers.write_layer_by(exported(cropland), f"{out}/cropland", "water_year", replace=replace)


def republish_years(inputs: Inputs, out: str, choices: Choices) -> None:
    """Write the yearly layers of ``choices.years`` anew; other years' files stay untouched, also if this fails.

    For years whose records or surveys were corrected. The outputs that sum over years are left as they are.
    """
    records = R.drop_flagged(R.with_section_key(R.typed(R.distinct_records(inputs.records, tuple(choices.chemicals)))))
    yearly = T.section_water_year(R.between_years(records, choices.years, "water_year"))
    cropland = R.between_years(R.cropland(inputs.crops), choices.years, "water_year")
    _write_years(yearly, cropland, inputs.sections, out, _exporter(choices.to_lonlat), replace=True)


def publish(inputs: Inputs, out: str, choices: Choices = Choices()) -> None:
    """Write all outputs. Existing outputs are not overwritten: the write fails instead."""
    c = choices
    codes = tuple(c.chemicals)
    exported = _exporter(c.to_lonlat)

    # Code list, records, records with errors.
    write_text_table(inputs.chemicals.dropDuplicates(), f"{out}/chemical")
    distinct = written(R.with_section_key(R.typed(R.distinct_records(inputs.records, codes))), "records")
    write_text_table(J.many_to_many(distinct, inputs.errors, ["use_no", "year"]), f"{out}/records_with_errors")
    clean = R.drop_flagged(distinct)

    # Sections over all water years: map, and breaks for its legend.
    in_water_years = R.between_years(clean, c.years, "water_year")
    yearly = written(T.section_water_year(in_water_years), "section-years")
    totals = T.total(yearly, ["chem_code", "co_mtrs"], pounds="pounds")
    density = written(A.section_density(totals, inputs.sections, c.square_units_per_acre, geometry=True), "density")
    layers.write_layer_by(exported(density), f"{out}/section_map", "chem_code")
    breaks = S.exact_quantiles(density, "pounds_per_100_acres", QUINTILES, ["chem_code"], few_groups=True)
    write_text_table(breaks.orderBy("chem_code", "prob"), f"{out}/section_quintiles")

    # Sections per water year, and the cropland of each survey year.
    cropland = R.cropland(inputs.crops)
    _write_years(yearly, cropland, inputs.sections, out, exported)

    # Schools.
    pieces = written(A.crops_by_section(cropland.select("water_year", "geom"), inputs.sections), "crop-pieces")
    buffers = A.school_buffers(inputs.schools, c.radii, c.units_per_mile, c.directions)
    inside = written(A.buffer_crop_acres(buffers, pieces, c.square_units_per_acre), "inside")
    years = A.cropland_years(pieces, yearly, codes, c.square_units_per_acre)
    fractions = written(A.crop_fractions(inside, years, codes), "fractions")
    write_text_table(fractions, f"{out}/school_years")
    bins = S.histogram(fractions, "intersection_fraction", ["chem_code", "radius"], few_groups=True)
    write_text_table(bins.orderBy("chem_code", "radius", "bin"), f"{out}/fraction_histogram")

    attributes = [n for n in inputs.schools.columns if n != "geom"]
    totals_by_school = written(A.school_totals(fractions, attributes), "school-totals")
    by_pounds = totals_by_school.orderBy("chem_code", "radius", F.desc_nulls_last("pounds"))
    write_text_table(by_pounds, f"{out}/school_totals")
    wide = A.two_buffers(totals_by_school, attributes, c.radii)
    columns = [A.radius_column(r) for r in c.radii]
    listed = written(
        J.null_safe(wide, inputs.enrollment, ["cds_code"], "left").select(
            "chem_code", "cds_code", "school", "district", "enroll_total", *columns
        ),
        "schools",
    )
    write_text_table(listed.orderBy("chem_code", F.desc_nulls_last(columns[-1])), f"{out}/schools")
    for column in columns:
        write_text_table(A.exposed_to_both(listed, column, codes), f"{out}/schools_exposed_to_both/{column}")
    order = [FILE_ORDER] if FILE_ORDER in inputs.school_points.columns else ["x", "y"]
    points = T.first_by_key(inputs.school_points, "cds_code", order).withColumn("point", F.struct("x", "y"))
    layers.write_layer(J.null_safe(points.drop("x", "y", FILE_ORDER), listed, ["cds_code"]), f"{out}/school_map", point="point")

    # Tracts.
    shares = A.section_tract_shares(inputs.sections, inputs.tracts, c.square_units_per_acre, c.detailed_tracts)
    calendar = T.section_calendar_totals(R.between_years(clean, c.years, "year"))
    census = C.relative_to_state(C.profile(inputs.census_tracts), C.profile(inputs.census_state))
    write_text_table(C.profile(inputs.census_state), f"{out}/census_state")
    profile = written(
        P.tract_profile(
            C.vulnerability_scores(inputs.vulnerability),
            census,
            C.land_area(inputs.tracts),
            A.tract_totals(shares, calendar),
            c.years,
            c.chemicals,
        ),
        "tracts",
    )
    write_text_table(profile.drop("geom"), f"{out}/tract_profile")
    layers.write_layer(exported(profile), f"{out}/tract_map")
    matrix = S.correlation_matrix(profile, P.correlated_columns(c.years, c.chemicals))
    write_text_table(matrix, f"{out}/correlation_matrix")

    # Counties and the state by calendar year.
    county = T.in_report_order(T.county_year(clean, inputs.counties, c.years, codes, prefix="")).drop("used", "county_cd")
    write_text_table(county, f"{out}/county_year")
    write_text_table(T.state_year(clean, c.years, prefix=""), f"{out}/state_year")


def _exporter(to_lonlat) -> Callable[[DataFrame], DataFrame]:
    def export(layer: DataFrame) -> DataFrame:
        return layers.moved(layer, to_lonlat) if to_lonlat else layer

    return export
