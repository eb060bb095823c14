"""Every operator as a query over the driver tables, with SQL for the same result where SQL can say it.

A query takes ``(spark, folder)`` and returns a DataFrame. Results that depend on floating-point addition
order are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import geometry as G
from areal_exposure.functions import values as V
from areal_exposure.functions.projection import CALIFORNIA, ellipsoid_area, map_points
from areal_exposure.operators import apportion as A
from areal_exposure.operators import census as C
from areal_exposure.operators import fragments as FR
from areal_exposure.operators import joins as J
from areal_exposure.operators import records as R
from areal_exposure.operators import stats as S
from areal_exposure.operators import totals as T
from areal_exposure.plans import profile as P
from areal_exposure.plans.driver_sql import meets, over, shared_area
from areal_exposure.plans.driver_views import (
    RECORD_COLUMNS,
    SQUARE_UNITS_PER_ACRE,
    UNITS_PER_MILE,
    YEARS,
    Views,
)
from areal_exposure.sources import layers, names, text
from areal_exposure.sources.scratch import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

SPAN = list(range(YEARS[0], YEARS[1] + 1))
SCHOOL = ("cds_code", "school", "district")
CROP_COLUMNS = ("co_mtrs", "water_year", "class1", "subclass1", "class2")
CODES = ", ".join(f"'{c}'" for c in K.CHEMICALS)


def query(sql: str | None = None, *views: str) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    def register(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        name = build.__name__
        _QUERIES[name] = lambda spark, folder: build(Views(spark, folder))
        if sql:
            _SQL[name] = over(sql, *views) if views else sql
        return build

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: Column | str, name: str) -> Column:
    """Rounded, without a negative zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(name)


# Shared steps -----------------------------------------------------------------------------------


def clean(v: Views) -> DataFrame:
    return R.clean(v.records())


def in_water_years(v: Views) -> DataFrame:
    return R.between_years(clean(v), YEARS, "water_year")


def in_calendar_years(v: Views) -> DataFrame:
    return R.between_years(clean(v), YEARS, "year")


def density(v: Views) -> DataFrame:
    return A.section_density(T.section_totals(in_water_years(v)), v.sections(), SQUARE_UNITS_PER_ACRE)


def shares(v: Views) -> DataFrame:
    return A.section_tract_shares(v.sections(), v.tracts(), SQUARE_UNITS_PER_ACRE)


def tract_pounds(v: Views) -> DataFrame:
    return A.tract_totals(shares(v), T.section_calendar_totals(in_calendar_years(v)))


def yearly_pounds(v: Views) -> DataFrame:
    return written(T.section_water_year(in_water_years(v)), "yearly")


def fractions(v: Views, directions: int = 4, yearly: DataFrame | None = None) -> DataFrame:
    """Buffers with 4 directions around rectangular grounds are rectangles, so SQL can state the result.

    Cropland and yearly pounds are written, as the overlay and the join read their sides several times over; so the
    records are gone through once for each of the two. ``yearly`` is :func:`yearly_pounds`, if at hand.
    """
    crops = written(R.cropland(v.crops()), "crops")
    yearly = yearly_pounds(v) if yearly is None else yearly
    buffers = A.school_buffers(v.schools(), units_per_mile=UNITS_PER_MILE, directions=directions)
    inside = written(A.buffer_crop_acres(buffers, crops, SQUARE_UNITS_PER_ACRE), "inside")
    years = written(A.cropland_years(crops, yearly, square_units_per_acre=SQUARE_UNITS_PER_ACRE), "years")
    return A.crop_fractions(inside, years)


def school_totals(v: Views) -> DataFrame:
    return A.school_totals(fractions(v), SCHOOL)


def two_buffers(v: Views) -> DataFrame:
    return A.two_buffers(school_totals(v), SCHOOL)


def census_wide(v: Views) -> DataFrame:
    return C.widen(C.label_variables(v.acs_long()))


def census_profile(v: Views) -> DataFrame:
    return C.profile(C.label_variables(v.acs_long()))


def relative(v: Views) -> DataFrame:
    return C.relative_to_state(census_profile(v), C.profile(C.label_variables(v.acs_state_long())))


def profile(v: Views) -> DataFrame:
    return P.tract_profile(C.vulnerability_scores(v.svi()), relative(v), C.land_area(v.tracts()), tract_pounds(v), YEARS)


# Records ----------------------------------------------------------------------------------------


@query(f"select distinct * from records where chem_code in ({CODES})", "records")
def pur_scan(v):
    return R.distinct_records(v.records())


@query("select distinct chem_code from records", "records")
def chemical_codes(v):
    path = shared_folder(v.spark, "chemical")
    text.write_text_table(v.records().select("chem_code"), path)
    return text.read_distinct(v.spark, path, ["chem_code"], pattern=None)


@query(f"select distinct * from records where chem_code in ({CODES})", "records")
def csv_scan(v):
    """The records as CSV files; the chemicals are picked while the files are parsed."""
    path = shared_folder(v.spark, "records")
    text.write_text_table(v.records(), path)
    raw = text.read_records(v.spark, path, RECORD_COLUMNS, pattern="*.csv", codes=tuple(K.CHEMICALS))
    return R.distinct_records(raw)


@query("select use_no, year, error_desc from errors", "errors")
def path_year(v):
    path = shared_folder(v.spark, "errors")
    v.errors().write.partitionBy("year").option("header", True).csv(path)
    return text.read_with_path_year(v.spark, path, ["use_no", "error_desc"], pattern="*.csv").select(
        "use_no", "year", "error_desc"
    )


@query("select * from records", "records")
def csv_roundtrip(v):
    path = shared_folder(v.spark, "records")
    text.write_text_table(v.records(), path)
    return text.read_records(v.spark, path, RECORD_COLUMNS, pattern="*.csv")


@query(
    'select s_suppkey as supp_key, s_name as supp_name, s_nationkey as nation_key, s_acctbal as acct_bal, '
    "s_acctbal as acct_bal_2 from supplier"
)
def clean_names(v):
    messy = v.table("supplier").select(
        F.col("s_suppkey").alias("Supp Key"),
        F.col("s_name").alias("SuppName"),
        F.col("s_nationkey").alias("NATION_KEY"),
        F.col("s_acctbal").alias("Acct.Bal"),
        F.col("s_acctbal").alias("acct  bal"),
    )
    return names.clean_names(messy)


@query(
    "select use_no, strftime(d, '%Y-%m-%d') as applic_dt, year, month, lbs, acres from typed",
    "typed",
)
def typed_records(v):
    return R.typed(v.records()).select(
        "use_no",
        F.col("applic_dt").cast("string").alias("applic_dt"),
        "year",
        F.month("applic_dt").alias("month"),
        F.col("lbs_chm_used").alias("lbs"),
        F.col("acre_treated").alias("acres"),
    )


@query(
    f"""select chem_code, water_year, count(*) as n, coalesce(sum(lbs), 0) as pounds from clean
where water_year between {YEARS[0]} and {YEARS[1]} group by all""",
    "clean",
)
def water_year(v):
    return in_water_years(v).groupBy("chem_code", "water_year").agg(
        F.count("*").alias("n"), V.sum_or_zero("lbs_chm_used").alias("pounds")
    )


@query(
    """select concat(county_cd, base_ln_mer, township, case when township = '00' then 'NA' else tship_dir end, "range",
  range_dir, section) as co_mtrs, count(*) as n from records group by 1""",
    "records",
)
def section_key(v):
    gaps = v.records().withColumn("tship_dir", F.when(F.col("township") != "00", F.col("tship_dir")))
    return R.with_section_key(gaps).groupBy("co_mtrs").agg(F.count("*").alias("n"))


@query("select use_no, chem_code, lbs from clean", "clean")
def drop_flagged(v):
    kept = R.drop_flagged(R.typed(R.distinct_records(v.records())))
    return kept.select("use_no", "chem_code", F.col("lbs_chm_used").alias("lbs"))


@query(
    """select t.use_no, t.year, chem_code, lbs, error_desc from distinct_typed t
join errors e on t.use_no = e.use_no and t.year = e.year""",
    "distinct_typed",
    "errors",
)
def records_with_errors(v):
    typed = R.typed(R.distinct_records(v.records()))
    return J.many_to_many(typed, v.errors(), ["use_no", "year"]).select(
        "use_no", "year", "chem_code", F.col("lbs_chm_used").alias("lbs"), "error_desc"
    )


@query(
    """select l_orderkey, l_linenumber, dupe_count from (
  select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey, l_linenumber) as dupe_count from lineitem)
where dupe_count > 1"""
)
def duplicate_rows(v):
    return T.duplicate_rows(v.table("lineitem").select("l_orderkey", "l_linenumber"))


# Totals -----------------------------------------------------------------------------------------


@query("select chem_code, co_mtrs, pounds from section_totals", "section_totals")
def section_totals(v):
    return T.section_totals(in_water_years(v))


@query("select chem_code, co_mtrs, water_year, pounds from section_water_year", "section_water_year")
def section_water_year(v):
    return T.section_water_year(in_water_years(v)).orderBy("water_year", "co_mtrs", F.desc_nulls_last("pounds"))


@query(
    "select chem_code, co_mtrs, round(acres_treated, 6) as acres_treated, pounds from section_calendar_totals",
    "section_calendar_totals",
)
def section_calendar_totals(v):
    return T.section_calendar_totals(in_calendar_years(v)).withColumn("acres_treated", r6("acres_treated", "acres_treated"))


_BY_YEAR = ", ".join(f"sum(case when year = {y} then coalesce(lbs, 0) end) as y{y}" for y in SPAN)
_ZEROED = ", ".join(f"coalesce(y{y}, 0) as y{y}" for y in SPAN)


@query(
    f"""select coalesce(u.chem_code, l.chem_code) as chem_code, coalesce(county_cd, code) as county_cd, county, {_ZEROED} from
  (select chem_code, county_cd, {_BY_YEAR} from clean where year between {YEARS[0]} and {YEARS[1]} group by 1, 2) u
full join (select county, lpad(cast(county_code as string), 2, '0') as code, chem_code
  from county_lookup cross join (select distinct chem_code from clean)) l on u.chem_code = l.chem_code and county_cd = code""",
    "clean",
    "county_lookup",
)
def county_year(v):
    return T.in_report_order(T.county_year(clean(v), v.county_lookup(), YEARS)).drop("used")


@query(
    f"select chem_code, {_BY_YEAR} from clean where year between {YEARS[0]} and {YEARS[1]} group by 1",
    "clean",
)
def state_year(v):
    return T.state_year(clean(v), YEARS)


# Files and layers -------------------------------------------------------------------------------


@query("select co_mtrs, x0, y0, x1, y1 from sections", "sections")
def geojson_roundtrip(v):
    path = shared_folder(v.spark, "sections")
    layers.write_layer(v.sections(), path)
    back = layers.read_layer(v.spark, path, "co_mtrs string")
    return back.withColumn("box", G.box(F.col("geom"))).select("co_mtrs", "box.*")


@query("select doc_id, text, lang from documents")
def csv_text_roundtrip(v):
    """Free text with quotes, commas and line breaks through CSV files."""
    path = shared_folder(v.spark, "texts")
    text.write_text_table(v.table("documents").select(F.col("doc_id").cast("string"), "text", "lang"), path)
    back = text.read_text_table(v.spark, path, ["doc_id", "text", "lang"], pattern="*.csv", trim=False, multi_line=True)
    return back.withColumn("doc_id", F.col("doc_id").cast("long"))


@query(
    f"""select co_mtrs, water_year, class1, subclass1, case when water_year = {YEARS[0]} then null else class2 end as class2,
  round((x1 - x0) * (y1 - y0), 6) as area from crops""",
    "crops",
)
def layer_union(v):
    """The first survey year comes from a layer without the second class column."""
    root = shared_folder(v.spark, "crops")
    crops = v.crops().select(*CROP_COLUMNS, "geom")
    early = F.col("water_year") == YEARS[0]
    layers.write_layer(crops.where(early).drop("class2"), f"{root}/{YEARS[0]}")
    layers.write_layer_by(crops.where(~early), f"{root}/later", "water_year")
    properties = "co_mtrs string, water_year int, class1 string, subclass1 string"
    stacked = layers.stack(
        [
            layers.read_layer(v.spark, f"{root}/later", properties + ", class2 string"),
            layers.read_layer(v.spark, f"{root}/{YEARS[0]}", properties),
        ]
    )
    return stacked.select(*CROP_COLUMNS, r6(G.area(F.col("geom")), "area"))


@query("select water_year, chem_code, co_mtrs, pounds from section_water_year", "section_water_year")
def yearly_partitions(v):
    path = shared_folder(v.spark, "yearly")
    layers.write_table_by(T.section_water_year(in_water_years(v)), path, "water_year")
    return v.spark.read.parquet(path).select("water_year", "chem_code", "co_mtrs", "pounds")


# Census -----------------------------------------------------------------------------------------


@query(
    "select fips, housing_units, households, " + ", ".join(P.SCORES) + " from scores",
    "scores",
)
def sentinel_to_null(v):
    return C.vulnerability_scores(v.svi()).select("fips", "housing_units", "households", *P.SCORES)


@query("select * from acs_wide", "acs_wide")
def acs_wide(v):
    return census_wide(v)


_YRS = " + ".join(f"coalesce({n}, 0)" for n in K.CENSUS_VARIABLES if "yrs" in n)
_LIMITED = " + ".join(f"coalesce({n}, 0)" for n in K.CENSUS_VARIABLES if "limited" in n)


@query(
    f"select geoid, round({_YRS}, 6) as age_17_and_below, round({_LIMITED}, 6) as limited_english from acs_wide",
    "acs_wide",
)
def row_sums(v):
    return C.with_sums(census_wide(v)).select(
        "geoid", r6("age_17_and_below", "age_17_and_below"), r6("limited_english", "limited_english")
    )


@query("select * from acs_profile", "acs_profile")
def percent_share(v):
    return census_profile(v)


_RATIOS = ", ".join(f"round({c}_relative, 6) as {c}_relative" for c in P.compared())


@query(f"select geoid, {_RATIOS} from relative", "relative")
def relative_to_state(v):
    return relative(v).select("geoid", *[r6(f"{c}_relative", f"{c}_relative") for c in P.compared()])


@query(
    " union all ".join(f"select geoid, '{c}_relative' as variable, round({c}_relative, 6) as value from relative" for c in P.compared()),
    "relative",
)
def relative_long(v):
    columns = [f"{c}_relative" for c in P.compared()]
    return C.long_form(relative(v), ["geoid"], columns).withColumn("value", r6("value", "value"))


@query("select geoid, round(aland * 0.000247105E0, 6) as land_area_acres from tracts", "tracts")
def land_area(v):
    return C.land_area(v.tracts()).withColumn("land_area_acres", r6("land_area_acres", "land_area_acres"))


# Spatial ----------------------------------------------------------------------------------------


@query(
    """select 'section' as layer, co_mtrs, 0 as water_year, round((x1 - x0) * (y1 - y0), 6) as area from sections
union all select 'crop', co_mtrs, water_year, round((x1 - x0) * (y1 - y0), 6) from crops""",
    "crops",
)
def polygon_area(v):
    sections = v.sections().withColumns({"layer": F.lit("section"), "water_year": F.lit(0)})
    crops = v.crops().withColumn("layer", F.lit("crop"))
    both = sections.unionByName(crops.select("layer", "co_mtrs", "water_year", "geom"))
    return both.select("layer", "co_mtrs", "water_year", r6(G.area(F.col("geom")), "area"))


def _projected(lon: str, lat: str, tag: str) -> str:
    """Albers forward as SQL from the public constants, with the cone written out as sub-expressions."""
    e = "sqrt(2/298.257222101E0 - 1/(298.257222101E0*298.257222101E0))"

    def q(phi: str) -> str:
        s = f"sin(radians({phi}))"
        return f"((1-{e}*{e})*({s}/(1-{e}*{e}*{s}*{s}) + atanh({e}*{s})/{e}))"

    def m2(phi: str) -> str:
        return f"(cos(radians({phi}))**2/(1-({e}*sin(radians({phi})))**2))"

    n = f"(({m2('34.0E0')}-{m2('40.5E0')})/({q('40.5E0')}-{q('34.0E0')}))"
    c = f"({m2('34.0E0')}+{n}*{q('34.0E0')})"
    rho = f"(6378137.0E0*sqrt({c}-{n}*{q(lat)})/{n})"
    theta = f"({n}*radians({lon}+120.0E0))"
    return f"{rho}*sin({theta}) as x{tag}, -{rho}*cos({theta}) as y{tag}"


_CORNERS = (("x0", "y0", "1"), ("x1", "y0", "2"), ("x1", "y1", "3"), ("x0", "y1", "4"))
_PROJECTED = ", ".join(_projected(f"(-121.0E0 + {x}/500)", f"(35.0E0 + {y}/200)", t) for x, y, t in _CORNERS)


def _zone(lat: str) -> str:
    """SQL: authalic q of a latitude on the ellipsoid."""
    e2 = "(0.006694380022900788E0)"
    s = f"sin(radians({lat}))"
    return f"((1 - {e2}) * ({s} / (1 - {e2} * {s} * {s}) + atanh(sqrt({e2}) * {s}) / sqrt({e2})))"


@query(
    f"""select co_mtrs, round(6378137.0E0 * 6378137.0E0 / 2 * radians((x1 - x0) / 500)
  * ({_zone("35.0E0 + y1 / 200")} - {_zone("35.0E0 + y0 / 200")}) / 4046.8564224E0, 4) as acres from sections""",
    "sections",
)
def ellipsoid_acres(v):
    """Acres of sections given in degrees, on the ellipsoid and without a projection."""
    degrees = map_points(F.col("geom"), lambda x, y: (x / 500 - 121.0, y / 200 + 35.0))
    return v.sections().select("co_mtrs", F.round(ellipsoid_area(degrees) / K.SQ_METRES_PER_ACRE, 4).alias("acres"))


@query(
    f"""select co_mtrs, round(((xa3-xa1)*(ya4-ya2) - (xa4-xa2)*(ya3-ya1)) / 2 / 4046.8564224E0, 4) as acres
from (select co_mtrs, {_PROJECTED.replace(" as x", " as xa").replace(" as y", " as ya")} from sections)""",
    "sections",
)
def albers_area(v):
    """Sections read as a longitude/latitude grid, projected, measured."""
    degrees = map_points(F.col("geom"), lambda x, y: (x / 500 - 121.0, y / 200 + 35.0))
    metres = map_points(F.col("degrees"), CALIFORNIA.forward)
    area = G.area(F.col("metres")) / K.SQ_METRES_PER_ACRE
    return v.sections().withColumn("degrees", degrees).withColumn("metres", metres).select(
        "co_mtrs", F.round(area, 4).alias("acres")
    )


@query("select co_mtrs, round(x0, 6) as lon, round(y0, 6) as lat from sections", "sections")
def albers_roundtrip(v):
    """Forward and back; the corner comes out where it was."""
    box = G.box(F.col("geom"))
    there = CALIFORNIA.forward(box["x0"] / 500 - 121.0, box["y0"] / 200 + 35.0)
    back = CALIFORNIA.inverse(F.col("x"), F.col("y"))
    projected = v.sections().select("co_mtrs", there[0].alias("x"), there[1].alias("y"))
    return projected.select("co_mtrs", r6((back[0] + 121.0) * 500, "lon"), r6((back[1] - 35.0) * 200, "lat"))


@query(
    "select co_mtrs, geoid, round(area_intersect, 6) as area_intersect, round(area_proportion, 6) as area_proportion from shares",
    "shares",
)
def overlay_join(v):
    return shares(v).select(
        "co_mtrs", "geoid", r6("area_intersect", "area_intersect"), r6("area_proportion", "area_proportion")
    )


@query(
    f"""select s.co_mtrs, water_year, class1, round(c.x0, 6) as x0, round(c.x1, 6) as x1, round({shared_area('s', 'c')}, 6) as area
from sections s join (select * replace (x0 + 0.4375E0 as x0, x1 + 0.4375E0 as x1) from cropland) c on {meets('s', 'c')}""",
    "sections",
    "cropland",
)
def crop_pieces(v):
    """Cropland cut along section lines; ``x0`` and ``x1`` tell the survey polygon apart."""
    crops = R.cropland(v.shifted_crops())
    box = G.box(F.col("geom"))
    marked = crops.select("water_year", "class1", "geom", box["x0"].alias("x0"), box["x1"].alias("x1"))
    pieces = A.crops_by_section(marked, v.sections())
    return pieces.select(
        "co_mtrs", "water_year", "class1", r6("x0", "x0"), r6("x1", "x1"), r6(G.area(F.col("geom")), "area")
    )


@query(
    """select chem_code, co_mtrs, pounds, round(section_total_acres, 6) as section_total_acres,
  round(pounds_per_100_acres, 6) as pounds_per_100_acres from section_density""",
    "section_density",
)
def section_density(v):
    return density(v).select(
        "chem_code", "co_mtrs", "pounds", r6("section_total_acres", "section_total_acres"),
        r6("pounds_per_100_acres", "pounds_per_100_acres"),
    )


PROBS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


@query(
    """select chem_code, unnest([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::double[]) as prob,
  round(unnest(quantile_cont(pounds_per_100_acres, [0, 0.2, 0.4, 0.6, 0.8, 1])), 6) as value from section_density group by 1""",
    "section_density",
)
def density_quintiles(v):
    breaks = S.exact_quantiles(density(v), "pounds_per_100_acres", PROBS, ["chem_code"], few_groups=True)
    return breaks.withColumn("value", r6("value", "value"))


@query("select chem_code, geoid, round(pounds, 6) as pounds from tract_pounds", "tract_pounds")
def tract_apportion(v):
    return tract_pounds(v).withColumn("pounds", r6("pounds", "pounds"))


@query(
    """select chem_code, geoid, round(pounds / nullif(land_area_acres, 0) * 100, 6) as pounds_per_100_acres,
  round(pounds / nullif(population, 0) * 1000, 6) as pounds_per_1000_people
from tract_pounds join (select geoid, aland * 0.000247105E0 as land_area_acres from tracts) using (geoid)
left join acs_profile using (geoid)""",
    "tract_pounds",
    "tracts",
    "acs_profile",
)
def rates(v):
    people = census_profile(v).select("geoid", "population")
    known = tract_pounds(v).join(C.land_area(v.tracts()), "geoid").join(people, "geoid", "left")
    return known.select(
        "chem_code",
        "geoid",
        r6(V.ratio("pounds", "land_area_acres", 100), "pounds_per_100_acres"),
        r6(V.ratio("pounds", "population", 1000), "pounds_per_1000_people"),
    )


# Schools ----------------------------------------------------------------------------------------


@query("select co_mtrs, water_year, class1, subclass1, class2 from cropland", "cropland")
def cropland_filter(v):
    return R.cropland(v.crops()).select(*CROP_COLUMNS)


@query(
    "select cds_code, radius, round((x1 - x0) * (y1 - y0), 6) as area from buffers",
    "buffers",
)
def school_buffer(v):
    buffers = A.school_buffers(v.schools(), units_per_mile=UNITS_PER_MILE, directions=4)
    return buffers.select("cds_code", "radius", r6(G.area(F.col("geom")), "area"))


@query(
    f"""select cds_code, radius, round(w * h + 2 * r * (w + h) + 64 * r * r * tan(pi() / 64), 6) as area
from (select *, x1 - x0 - 2 * r as w, y1 - y0 - 2 * r as h from (select *, radius * {UNITS_PER_MILE} as r from buffers))""",
    "buffers",
)
def school_buffer_round(v):
    """Buffers with 64 directions: the grounds, a strip along each side, and 64 triangles at the corners."""
    buffers = A.school_buffers(v.schools(), units_per_mile=UNITS_PER_MILE)
    return buffers.select("cds_code", "radius", r6(G.area(F.col("geom")), "area"))


@query(
    """select cds_code, r as radius, round(0.75E0 * 0.04E0 + 0.8E0 * r + 80 * tan(pi() / 64) * r * r - r * r, 6) as area
from (select cds_code, 0.01E0 * (1 + cast(cds_code as bigint) % 9) as r from schools)""",
    "schools",
)
def school_buffer_concave(v):
    """Grounds without their upper right quarter: five round corners, and a square at the inner one that counts once."""
    box = G.box(F.col("geom"))
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    xm, ym = (x0 + x1) / 2, (y0 + y1) / 2
    grounds = F.array(F.array(*[G.point(x, y) for x, y in ((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))]))
    radius = (F.col("cds_code").cast("bigint") % 9 + 1) * F.lit(0.01)
    shaped = written(v.schools().select("cds_code", radius.alias("radius"), grounds.alias("geom")))
    return shaped.select("cds_code", "radius", r6(G.area(G.buffer(F.col("geom"), F.col("radius"))), "area"))


def _below_diagonal(c: str) -> str:
    """SQL: area of a section right of and below the diagonal of a tract, above height c."""
    line = "t.y0 + (t.y1 - t.y0) / (t.x1 - t.x0) * ({} - t.x0) - " + c
    lo, hi = line.format("greatest(s.x0, t.x0)"), line.format("least(s.x1, t.x1)")
    return f"(pow(greatest({hi}, 0), 2) - pow(greatest({lo}, 0), 2)) / (2 * (t.y1 - t.y0) / (t.x1 - t.x0))"


@query(
    f"""select co_mtrs, geoid, round(area, 6) as area from (
  select co_mtrs, geoid, {_below_diagonal("greatest(s.y0, t.y0)")} - {_below_diagonal("least(s.y1, t.y1)")} as area
  from sections s join tracts t on {meets("s", "t")}) where area > 1e-9""",
    "sections",
    "tracts",
)
def overlay_triangles(v):
    """Sections against the lower halves of tracts, by fragments of the tracts' sides."""
    box = G.box(F.col("geom"))
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    half = F.array(F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1)))
    sections = v.sections().select("co_mtrs", F.col("geom").alias("other_geom"))
    shared = FR.detailed_overlap_join(v.tracts().select("geoid", half.alias("geom")), sections, "geoid", "co_mtrs")
    return shared.where("area_intersect > 1e-9").select("co_mtrs", "geoid", r6("area_intersect", "area"))


@query(
    "select chem_code, radius, cds_code, school, district, round(pounds, 6) as pounds from school_totals",
    "school_totals",
)
def school_apportion(v):
    totals = school_totals(v).withColumn("pounds", r6("pounds", "pounds"))
    return totals.orderBy("chem_code", "radius", F.desc_nulls_last("pounds"))


@query()
def school_apportion_round(v):
    """The same with round buffers (64 directions)."""
    return A.school_totals(fractions(v, directions=64), SCHOOL).withColumn("pounds", r6("pounds", "pounds"))


@query(
    """select chem_code, radius,
  case when hi > lo then least(cast(floor((f - lo) / (hi - lo) * 30) as bigint) + 1, 30) else 1 end as bin, count(*) as n
from (select chem_code, radius, round(fraction, 9) as f from fractions)
join (select chem_code, radius, min(round(fraction, 9)) as lo, max(round(fraction, 9)) as hi from fractions group by 1, 2)
  using (chem_code, radius)
group by 1, 2, 3""",
    "fractions",
)
def fraction_histogram(v):
    marked = written(fractions(v).select("chem_code", "radius", F.round("intersection_fraction", 9).alias("f")))
    return S.histogram(marked, "f", ["chem_code", "radius"], few_groups=True)


@query(
    """select count(*) as n_compared, cast(count(*) filter (where co_mtrs like '%7') as bigint) as n_mismatch
from fractions""",
    "fractions",
)
def pounds_mismatch(v):
    """Pounds carried through the overlay against section-year totals of which those that end in 7 were changed."""
    keys = ["chem_code", "co_mtrs", "water_year"]
    yearly = yearly_pounds(v)
    parts = written(fractions(v, yearly=yearly).select(*keys, "pounds"))
    yearly = yearly.select(*keys, (F.col("pounds") + F.when(F.col("co_mtrs").endswith("7"), 1.0).otherwise(0.0)).alias("pounds"))
    mismatch = A.pounds_mismatch(parts, yearly, keys).select(F.lit(1).alias("bad"))
    compared = parts.select(F.lit(0).alias("bad"))
    return compared.unionByName(mismatch).agg(
        F.count_if(F.col("bad") == 0).alias("n_compared"), F.count_if(F.col("bad") == 1).alias("n_mismatch")
    )


@query(
    """select chem_code, cds_code, school, district, enroll_total, round(pounds_0_25, 6) as pounds_0_25, round(pounds_1, 6) as pounds_1
from two_buffers left join (select cds_code, enroll_total from schools) using (cds_code)""",
    "two_buffers",
    "schools",
)
def school_two_buffers(v):
    listed = two_buffers(v).join(v.enrollment(), "cds_code", "left")
    return listed.select(
        "chem_code", *SCHOOL, "enroll_total", r6("pounds_0_25", "pounds_0_25"), r6("pounds_1", "pounds_1")
    ).orderBy(F.desc_nulls_last("pounds_1"))


@query(
    """select chem_code, cds_code, school, district, round(max(p25), 6) as pounds_0_25, round(max(p1), 6) as pounds_1 from (
  select chem_code, cds_code, school, district, pounds as p25, null as p1 from school_totals where radius = 0.25E0
  union all select chem_code, cds_code, school, district, null, pounds from school_totals where radius = 1) group by 1, 2, 3, 4""",
    "school_totals",
)
def natural_full_join(v):
    """Both radii joined on all shared columns, null equal to null."""
    totals = written(school_totals(v))
    near, far = (
        totals.where(F.col("radius") == r).select("chem_code", *SCHOOL, r6("pounds", A.radius_column(r)))
        for r in K.BUFFER_MILES
    )
    return J.natural_full(near, far)


@query(
    " union all ".join(
        f"""select {r} as radius, cds_code, school from two_buffers where chem_code = '573' and {c} is not null
and cds_code in (select cds_code from two_buffers where chem_code = '136' and {c} is not null)"""
        for r, c in (("0.25E0", "pounds_0_25"), ("1.0E0", "pounds_1"))
    ),
    "two_buffers",
)
def schools_both(v):
    wide = written(two_buffers(v))
    exposed = [
        A.exposed_to_both(wide, A.radius_column(r)).select(F.lit(r).alias("radius"), "cds_code", "school")
        for r in K.BUFFER_MILES
    ]
    return exposed[0].unionByName(exposed[1])


@query(
    """select chem_code, cds_code, round(x0, 6) as x, round(y0, 6) as y, round(pounds_1, 6) as pounds_1
from two_buffers join (select cds_code, x0, y0 from schools) using (cds_code)""",
    "two_buffers",
    "schools",
)
def school_points(v):
    """First point of each school, joined to its totals."""
    points = T.first_by_key(v.school_points(), "cds_code", ["x", "y"])
    return points.join(two_buffers(v), "cds_code").select(
        "chem_code", "cds_code", r6("x", "x"), r6("y", "y"), r6("pounds_1", "pounds_1")
    )


# Tract profile ----------------------------------------------------------------------------------

_PROFILE_TEXT = ("county", "fips", "name")
_PROFILE_NUMBERS = [
    "area_sqmi", "land_area_acres", "population", "housing_units", "households", *P.SCORES, *P.compared(),
    *[f"{c}_relative" for c in P.compared()],
    *[f"pounds_{n}_{YEARS[0]}_{YEARS[1]}" for n in K.CHEMICALS.values()],
    *P.correlated_columns(YEARS)[-4:],
]


@query(
    f"select {', '.join(_PROFILE_TEXT)}, {', '.join(f'round({c}, 6) as {c}' for c in _PROFILE_NUMBERS)} from tract_profile",
    "tract_profile",
)
def tract_profile(v):
    return profile(v).select(*_PROFILE_TEXT, *[r6(c, c) for c in _PROFILE_NUMBERS])


_CORRELATED = P.correlated_columns(YEARS)
_COMPLETE = "complete as (select * from tract_profile where " + " and ".join(f"{c} is not null" for c in _CORRELATED) + ")"


def _corr(a: str, b: str) -> str:
    spread = f"stddev({a}) > 0 and stddev({b}) > 0"
    return f"select '{a}' as var_x, '{b}' as var_y, round(case when {spread} then corr({a}, {b}) end, 6) as r from complete"


_PAIRS = " union all ".join(_corr(a, b) for i, a in enumerate(_CORRELATED) for b in _CORRELATED[:i])


@query(f"select * from (with {_COMPLETE} {_PAIRS})", "tract_profile")
def correlation_matrix(v):
    return S.correlation_matrix(profile(v), _CORRELATED).withColumn("r", r6("r", "r"))
