"""The domain tables, derived from the driver's star-schema tables by DataFrame expressions.

``driver_sql`` holds the same views as SQL text. The synthetic map is planar: one unit is one mile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import geometry as G
from areal_exposure.functions import values as V

YEARS = (1996, 2000)
UNITS_PER_MILE = 1.0
SQUARE_UNITS_PER_ACRE = 0.0015625

RECORD_COLUMNS = (
    "use_no", "chem_code", *K.SECTION_KEY_PARTS, "applic_dt", "lbs_chm_used", "acre_treated", "error_flag",
)

# Census variable carried by each (order priority digit, order status).
VARIABLE_OF_ORDER = {
    "1F": "population",
    "1O": "median_household_income",
    "1P": "poverty",
    "2F": "population_assessed_poverty",
    "2O": "born_central_america",
    "2P": "population_5_and_older",
    "3F": "limited_english_1",
    "3O": "limited_english_2",
    "3P": "limited_english_3",
    "4F": "male_under_5_yrs",
    "4O": "male_5_9_yrs",
    "4P": "female_under_5_yrs",
    "5F": "latino",
    "5O": "female_15_17_yrs",
    "5P": "male_15_17_yrs",
}
SEGMENT_OF_THEME = {
    "rpl_theme1": "BUILDING",
    "rpl_theme2": "FURNITURE",
    "rpl_theme3": "HOUSEHOLD",
    "rpl_theme4": "MACHINERY",
}


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _money(c: str) -> Column:
    """Sums of cents are exact as decimals, so the result does not depend on the order of addition."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


@dataclass(frozen=True)
class Views:
    spark: SparkSession
    folder: str
    _tables: dict[str, DataFrame] = field(default_factory=dict, compare=False)

    def table(self, name: str) -> DataFrame:
        """A driver table; its file footer is looked at once per query."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def records(self) -> DataFrame:
        if "records" not in self._tables:
            self._tables["records"] = self._records()
        return self._tables["records"]

    def _lines(self) -> DataFrame:
        return self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))

    @staticmethod
    def _section_key(supplier: Column, part: Column) -> list[Column]:
        """The parts of a section's key; they depend on the remainders by 20 and 180 of the line's keys only."""
        return [
            _two(F.col("s_nationkey")).alias("county_cd"),
            F.lit("M").alias("base_ln_mer"),
            _two(supplier % 20).alias("township"),
            F.when(supplier % 2 == 0, "N").otherwise("S").alias("tship_dir"),
            _two(part % 5).alias("range"),
            F.lit("E").alias("range_dir"),
            _two(part % 36 + 1).alias("section"),
        ]

    def _records(self) -> DataFrame:
        day = F.col("l_shipdate")
        return self._lines().select(
            F.col("l_orderkey").cast("string").alias("use_no"),
            F.when(F.col("l_returnflag") == "A", "573").when(F.col("l_returnflag") == "R", "136").otherwise("999").alias("chem_code"),
            *self._section_key(F.col("l_suppkey"), F.col("l_partkey")),
            F.concat_ws("/", _two(F.month(day)), _two(F.dayofmonth(day)), F.year(day).cast("string")).alias("applic_dt"),
            F.when(F.col("l_discount") != 0, F.col("l_quantity").cast("string")).alias("lbs_chm_used"),
            F.col("l_extendedprice").cast("string").alias("acre_treated"),
            F.when(F.col("l_tax") >= 0.08, "E").alias("error_flag"),
        )

    def errors(self) -> DataFrame:
        return (
            self.table("orders")
            .where(F.col("o_orderstatus") == "P")
            .select(
                F.col("o_orderkey").cast("string").alias("use_no"),
                F.year("o_orderdate").alias("year"),
                F.col("o_orderpriority").alias("error_desc"),
            )
        )

    def county_lookup(self) -> DataFrame:
        """The nations, and the regions as further counties in which nothing was ever applied."""
        nations = self.table("nation").select(F.col("n_name").alias("county"), F.col("n_nationkey").alias("county_code"))
        regions = self.table("region").select(
            F.concat(F.lit("REGION "), "r_name").alias("county"), (F.col("r_regionkey") + 90).alias("county_code")
        )
        return nations.unionByName(regions)

    def section_corners(self) -> DataFrame:
        # Whole numbers are made distinct before text is made of them, which costs far less a line.
        places = self._lines().select("s_nationkey", (F.col("l_suppkey") % 20).alias("s"), (F.col("l_partkey") % 180).alias("p"))
        parts = places.distinct().select(*self._section_key(F.col("s"), F.col("p"))).distinct()
        x = F.col("county_cd").cast("int") * 20.0 + F.col("township").cast("int")
        y = F.col("range").cast("int") * 36.0 + F.col("section").cast("int") - 1
        return parts.select(
            F.concat(*K.SECTION_KEY_PARTS).alias("co_mtrs"),
            x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"),
        )

    def sections(self) -> DataFrame:
        return self._shaped(self.section_corners())

    def tracts(self) -> DataFrame:
        strips = self.table("nation").withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(4)])))
        x = F.col("n_nationkey") * 20.0 + F.col("j") * 5 + 0.3
        corners = strips.select(
            F.concat(_two(F.col("n_nationkey")), F.lit("0"), F.col("j").cast("string")).alias("geoid"),
            ((F.col("j") + 1) * 1.0e6).alias("aland"),
            x.alias("x0"), F.lit(-1.0).alias("y0"), (x + 5).alias("x1"), F.lit(200.0).alias("y1"),
        )
        return self._shaped(corners)

    def schools(self) -> DataFrame:
        located = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        x = F.col("s_nationkey") * 20.0 + F.col("s_suppkey") % 20 + 0.4
        y = (F.col("s_suppkey") % 5) * 36.0 + F.col("s_suppkey") % 36 + 0.4
        corners = located.select(
            F.lpad(F.col("s_suppkey").cast("string"), 14, "0").alias("cds_code"),
            F.col("s_name").alias("school"),
            F.col("n_name").alias("district"),
            x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.2).alias("y1"),
        )
        return self._shaped(corners)

    def enrollment(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            F.lpad(key.cast("string"), 14, "0").alias("cds_code"),
            F.when(key % 6 != 0, (key + 100).cast("double")).alias("enroll_total"),
        )

    def school_points(self) -> DataFrame:
        """Each school twice: a point at its middle and one at its corner."""
        box = G.box(F.col("geom"))
        middle = F.struct(((box["x0"] + box["x1"]) / 2).alias("x"), ((box["y0"] + box["y1"]) / 2).alias("y"))
        corner = F.struct(box["x0"].alias("x"), box["y0"].alias("y"))
        points = self.schools().select("cds_code", F.explode(F.array(middle, corner)).alias("p"))
        return points.select("cds_code", "p.x", "p.y")

    def crop_corners(self) -> DataFrame:
        w = F.col("water_year")
        years = F.array(*[F.lit(y) for y in range(YEARS[0], YEARS[1] + 1)])
        kind = (F.col("x0") + F.col("y0") + w).cast("bigint") % 5
        return self.section_corners().withColumn("water_year", F.explode(years)).select(
            "co_mtrs",
            "water_year",
            (F.col("x0") + 0.125).alias("x0"),
            (F.col("y0") + 0.25).alias("y0"),
            F.col("x1"),
            (F.col("y1") - (w % 4) * 0.125).alias("y1"),
            F.when(kind == 0, "G").when(kind == 1, "I").when(kind == 2, "U").when(kind == 3, "NW").otherwise("YP").alias("class1"),
            (F.col("y0").cast("bigint") % 3).cast("string").alias("subclass1"),
            F.when((F.col("x0") + w).cast("bigint") % 7 == 0, "V").alias("class2"),
            *[F.lit(None).cast("string").alias(c) for c in ("subclass2", "class3", "subclass3", "class4", "subclass4")],
        )

    def crops(self) -> DataFrame:
        return self._shaped(self.crop_corners())

    def shifted_crops(self) -> DataFrame:
        """Cropland moved off the section lines and without a section key, as a survey delivers it."""
        corners = self.crop_corners().drop("co_mtrs")
        return self._shaped(corners.withColumns({"x0": F.col("x0") + 0.4375, "x1": F.col("x1") + 0.4375}))

    def acs_long(self) -> DataFrame:
        priced = self._orders_by_variable()
        geoid = F.concat(_two(F.col("c_nationkey")), F.lit("0"), (F.col("c_custkey") % 4).cast("string"))
        return self._estimates(priced.withColumns({"geoid": geoid, "name": F.concat(F.lit("Tract "), geoid)}))

    def acs_state_long(self) -> DataFrame:
        return self._estimates(self._orders_by_variable().withColumns({"geoid": F.lit("06"), "name": F.lit("State")}))

    def _orders_by_variable(self) -> DataFrame:
        code_of = F.create_map(*[F.lit(t) for k, n in VARIABLE_OF_ORDER.items() for t in (k, K.CENSUS_VARIABLES[n])])
        orders = self.table("orders").join(self.table("customer"), F.col("c_custkey") == F.col("o_custkey"))
        kind = F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus")
        return orders.withColumn("variable", code_of[kind])

    @staticmethod
    def _estimates(orders: DataFrame) -> DataFrame:
        long = orders.groupBy("geoid", "name", "variable").agg(_money("o_totalprice").alias("estimate"))
        return long.withColumn("moe", F.col("estimate") / 10)

    def svi(self) -> DataFrame:
        place = F.col("c_custkey") % 4
        sentinel = F.lit(float(K.MISSING_SCORE))
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        balance = F.col("c_acctbal").cast("decimal(18,2)")
        scores = {
            name: F.coalesce(F.sum(F.when(F.col("c_mktsegment") == segment, balance)).cast("double"), sentinel)
            for name, segment in SEGMENT_OF_THEME.items()
        }
        grouped = people.groupBy(F.col("n_name").alias("county"), "c_nationkey", place.alias("j")).agg(
            (F.count("*") / 4.0).alias("area_sqmi"),
            F.count("*").cast("double").alias("e_hu"),
            F.count_if(F.col("c_acctbal") >= 0).cast("double").alias("e_hh"),
            _money("c_acctbal").alias("balance"),
            *[v.alias(n) for n, v in scores.items()],
        )
        unscored = (F.col("c_nationkey") * 4 + F.col("j")) % 7 == 0
        return grouped.select(
            "county",
            F.concat(_two(F.col("c_nationkey")), F.lit("0"), F.col("j").cast("string")).alias("fips"),
            "area_sqmi", "e_hu", "e_hh",
            F.when(unscored, sentinel).otherwise(F.col("balance")).alias("rpl_themes"),
            *SEGMENT_OF_THEME,
        )

    def svi_map(self) -> DataFrame:
        shapes = self.tracts().select(F.col("geoid").alias("fips"), "geom")
        return self.svi().join(shapes, "fips")

    @staticmethod
    def _shaped(corners: DataFrame) -> DataFrame:
        shape = G.rectangle(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
        return corners.withColumn("geom", shape).drop("x0", "y0", "x1", "y1")
