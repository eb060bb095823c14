"""The views of ``driver_views`` as SQL text, for checking results with another engine."""

from __future__ import annotations

from areal_exposure import constants as K
from areal_exposure.plans.driver_views import SEGMENT_OF_THEME, VARIABLE_OF_ORDER, YEARS

_FIRST, _LAST = YEARS
_SPAN = list(range(_FIRST, _LAST + 1))
_YEAR_ROWS = " union all ".join(f"select {y} as w" for y in _SPAN)
_CODES = ", ".join(f"'{c}'" for c in K.CHEMICALS)
_KEY = "co_mtrs"
_CLASSES = ", ".join(f"'{c}'" for c in K.CROP_CLASSES)


def _in_slot(i: int) -> str:
    return (
        f"(class{i} in ({_CLASSES}) or (class{i} = '{K.IDLE_CLASS}' and subclass{i} = '{K.IDLE_SUBCLASS}'))"
    )


_AREA_SHARED = (
    "(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
)
_SHARES_AREA = "{a}.x0 < {b}.x1 and {b}.x0 < {a}.x1 and {a}.y0 < {b}.y1 and {b}.y0 < {a}.y1"


def shared_area(a: str, b: str) -> str:
    return _AREA_SHARED.format(a=a, b=b)


def meets(a: str, b: str) -> str:
    return _SHARES_AREA.format(a=a, b=b)


def _percent(a: str, b: str) -> str:
    return f"round(({a}) / nullif({b}, 0) * 100, 1)"


_WIDE = ",\n".join(
    f"max(case when variable = '{n}' then estimate end) as {n}" for n in K.CENSUS_VARIABLES
)
_YRS = " + ".join(f"coalesce({n}, 0)" for n in K.CENSUS_VARIABLES if "yrs" in n)
_LIMITED = " + ".join(f"coalesce({n}, 0)" for n in K.CENSUS_VARIABLES if "limited" in n)
_VARIABLE = " ".join(f"when '{k}' then '{n}'" for k, n in VARIABLE_OF_ORDER.items())
_THEMES = ", ".join(
    f"coalesce(cast(sum(case when c_mktsegment = '{s}' then cast(c_acctbal as decimal(18,2)) end) as double), -999.0E0) as {t}"
    for t, s in SEGMENT_OF_THEME.items()
)
_COMPARED = ["median_household_income", *K.CENSUS_SHARES]


def _profile(source: str) -> str:
    shares = ", ".join(f"{_percent(a, b)} as {n}" for n, (a, b) in K.CENSUS_SHARES.items())
    return f"""select geoid, name, population, median_household_income, {shares} from
      (select *, {_YRS} as age_17_and_below, {_LIMITED} as limited_english from {source})"""


def _estimates(geoid: str, name: str) -> str:
    return f"""select {geoid} as geoid, {name} as name, variable,
      cast(sum(cast(o_totalprice as decimal(18,2))) as double) as estimate
    from (select *, case concat(substr(o_orderpriority, 1, 1), o_orderstatus) {_VARIABLE} end as variable
          from customer join orders on c_custkey = o_custkey) group by 1, 2, 3"""


_GEOID = "concat(lpad(cast(c_nationkey as string), 2, '0'), '0', cast(c_custkey % 4 as string))"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "records": (
        (),
        """select cast(l_orderkey as string) as use_no,
  case l_returnflag when 'A' then '573' when 'R' then '136' else '999' end as chem_code,
  lpad(cast(s_nationkey as string), 2, '0') as county_cd, 'M' as base_ln_mer,
  lpad(cast(l_suppkey % 20 as string), 2, '0') as township,
  case when l_suppkey % 2 = 0 then 'N' else 'S' end as tship_dir,
  lpad(cast(l_partkey % 5 as string), 2, '0') as "range", 'E' as range_dir,
  lpad(cast(l_partkey % 36 + 1 as string), 2, '0') as section,
  concat(lpad(cast(month(l_shipdate) as string), 2, '0'), '/', lpad(cast(day(l_shipdate) as string), 2, '0'), '/',
         cast(year(l_shipdate) as string)) as applic_dt,
  case when l_discount = 0 then null else cast(l_quantity as string) end as lbs_chm_used,
  cast(l_extendedprice as string) as acre_treated,
  case when l_tax >= 0.08 then 'E' end as error_flag
from lineitem join supplier on l_suppkey = s_suppkey""",
    ),
    "typed": (
        ("records",),
        """select use_no, chem_code, county_cd,
  concat(county_cd, base_ln_mer, township, tship_dir, "range", range_dir, section) as co_mtrs,
  strptime(applic_dt, '%m/%d/%Y') as d, try_cast(lbs_chm_used as double) as lbs, try_cast(acre_treated as double) as acres,
  error_flag, year(d) as year, month(d) as month, year(d) + case when month(d) >= 10 then 1 else 0 end as water_year
from records""",
    ),
    "distinct_typed": (
        ("records",),
        f"""select use_no, chem_code, county_cd,
  concat(county_cd, base_ln_mer, township, tship_dir, "range", range_dir, section) as co_mtrs,
  strptime(applic_dt, '%m/%d/%Y') as d, try_cast(lbs_chm_used as double) as lbs, try_cast(acre_treated as double) as acres,
  error_flag, year(d) as year, month(d) as month, year(d) + case when month(d) >= 10 then 1 else 0 end as water_year
from (select distinct * from records where chem_code in ({_CODES}))""",
    ),
    "clean": (("distinct_typed",), "select * from distinct_typed where error_flag is null"),
    "errors": (
        (),
        """select cast(o_orderkey as string) as use_no, year(o_orderdate) as year, o_orderpriority as error_desc
from orders where o_orderstatus = 'P'""",
    ),
    "county_lookup": (
        (),
        """select n_name as county, n_nationkey as county_code from nation
union all select concat('REGION ', r_name), r_regionkey + 90 from region""",
    ),
    "sections": (
        ("records",),
        """select concat(county_cd, base_ln_mer, township, tship_dir, "range", range_dir, section) as co_mtrs,
  20.0E0 * cast(county_cd as int) + cast(township as int) as x0,
  36.0E0 * cast("range" as int) + cast(section as int) - 1 as y0, x0 + 1 as x1, y0 + 1 as y1
from (select distinct county_cd, base_ln_mer, township, tship_dir, "range", range_dir, section from records)""",
    ),
    "tracts": (
        (),
        """select concat(lpad(cast(n_nationkey as string), 2, '0'), '0', cast(j as string)) as geoid,
  20.0E0 * n_nationkey + 5 * j + 0.3E0 as x0, -1.0E0 as y0, x0 + 5 as x1, 200.0E0 as y1, 1.0E6 * (1 + j) as aland
from nation cross join (select 0 as j union all select 1 union all select 2 union all select 3) t""",
    ),
    "schools": (
        (),
        """select lpad(cast(s_suppkey as string), 14, '0') as cds_code, s_name as school, n_name as district,
  20.0E0 * s_nationkey + s_suppkey % 20 + 0.4E0 as x0, 36.0E0 * (s_suppkey % 5) + s_suppkey % 36 + 0.4E0 as y0,
  x0 + 0.2E0 as x1, y0 + 0.2E0 as y1,
  case when s_suppkey % 6 = 0 then null else cast(100 + s_suppkey as double) end as enroll_total
from supplier join nation on s_nationkey = n_nationkey""",
    ),
    "crops": (
        ("sections",),
        f"""select co_mtrs, w as water_year, x0 + 0.125E0 as x0, y0 + 0.25E0 as y0, x1, y1 - 0.125E0 * (w % 4) as y1,
  case cast(s.x0 + s.y0 + w as bigint) % 5 when 0 then 'G' when 1 then 'I' when 2 then 'U' when 3 then 'NW' else 'YP' end as class1,
  cast(cast(s.y0 as bigint) % 3 as string) as subclass1,
  case when cast(s.x0 + w as bigint) % 7 = 0 then 'V' end as class2,
  cast(null as string) as subclass2
from sections s cross join ({_YEAR_ROWS}) t""",
    ),
    "cropland": (("crops",), f"select * from crops where {_in_slot(1)} or {_in_slot(2)}"),
    "section_totals": (
        ("clean",),
        f"""select chem_code, co_mtrs, coalesce(sum(lbs), 0) as pounds from clean
where water_year between {_FIRST} and {_LAST} group by 1, 2""",
    ),
    "section_water_year": (
        ("clean",),
        f"""select chem_code, co_mtrs, water_year, coalesce(sum(lbs), 0) as pounds from clean
where water_year between {_FIRST} and {_LAST} group by 1, 2, 3""",
    ),
    "section_calendar_totals": (
        ("clean",),
        f"""select chem_code, co_mtrs, coalesce(sum(acres), 0) as acres_treated, coalesce(sum(lbs), 0) as pounds from clean
where year between {_FIRST} and {_LAST} group by 1, 2""",
    ),
    "section_density": (
        ("section_totals", "sections"),
        """select chem_code, co_mtrs, pounds, (x1 - x0) * (y1 - y0) / 0.0015625E0 as section_total_acres,
  pounds / section_total_acres * 100 as pounds_per_100_acres
from section_totals join sections using (co_mtrs)""",
    ),
    "shares": (
        ("sections", "tracts"),
        f"""select co_mtrs, geoid, {shared_area('s', 't')} / 0.0015625E0 as area_intersect,
  {shared_area('s', 't')} / ((s.x1 - s.x0) * (s.y1 - s.y0)) as area_proportion
from sections s join tracts t on {meets('s', 't')}""",
    ),
    "tract_pounds": (
        ("shares", "section_calendar_totals"),
        """select chem_code, geoid, coalesce(sum(pounds * area_proportion), 0) as pounds
from shares join section_calendar_totals using (co_mtrs) group by 1, 2""",
    ),
    "buffers": (
        ("schools",),
        """select cds_code, school, district, radius, x0 - radius as x0, y0 - radius as y0, x1 + radius as x1, y1 + radius as y1
from schools cross join (select 0.25E0 as radius union all select 1.0E0) r""",
    ),
    "fractions": (
        ("buffers", "cropland", "section_water_year"),
        f"""select radius, cds_code, school, district, co_mtrs, water_year, chem_code, pounds,
  inside / whole as fraction, fraction * pounds as part
from (select radius, cds_code, school, district, co_mtrs, water_year, sum({shared_area('b', 'c')}) as inside
      from buffers b join cropland c on {meets('b', 'c')} group by all)
join (select co_mtrs, water_year, sum((x1 - x0) * (y1 - y0)) as whole from cropland group by all) using (co_mtrs, water_year)
join section_water_year using (co_mtrs, water_year)""",
    ),
    "school_totals": (
        ("fractions",),
        """select chem_code, radius, cds_code, school, district, sum(part) as pounds from fractions group by all""",
    ),
    "two_buffers": (
        ("school_totals",),
        """select chem_code, cds_code, school, district,
  max(case when radius = 0.25E0 then pounds end) as pounds_0_25, max(case when radius = 1 then pounds end) as pounds_1
from school_totals group by all""",
    ),
    "acs_long": ((), _estimates(_GEOID, f"concat('Tract ', {_GEOID})")),
    "acs_state_long": ((), _estimates("'06'", "'State'")),
    "acs_wide": (("acs_long",), f"select geoid, name, {_WIDE} from acs_long group by 1, 2"),
    "acs_state_wide": (("acs_state_long",), f"select geoid, name, {_WIDE} from acs_state_long group by 1, 2"),
    "acs_profile": (("acs_wide",), _profile("acs_wide")),
    "acs_state": (("acs_state_wide",), _profile("acs_state_wide")),
    "relative": (
        ("acs_profile", "acs_state"),
        "select p.*, " + ", ".join(f"p.{c} / nullif(s.{c}, 0) as {c}_relative" for c in _COMPARED)
        + " from acs_profile p cross join acs_state s",
    ),
    "svi": (
        (),
        f"""select county, concat(lpad(cast(c_nationkey as string), 2, '0'), '0', cast(j as string)) as fips,
  n / 4.0E0 as area_sqmi, cast(n as double) as e_hu, e_hh,
  case when (c_nationkey * 4 + j) % 7 = 0 then -999.0E0 else balance end as rpl_themes, {", ".join(SEGMENT_OF_THEME)}
from (select n_name as county, c_nationkey, c_custkey % 4 as j, count(*) as n,
        cast(sum(case when c_acctbal >= 0 then 1 else 0 end) as double) as e_hh,
        cast(sum(cast(c_acctbal as decimal(18,2))) as double) as balance, {_THEMES}
      from customer join nation on c_nationkey = n_nationkey group by 1, 2, 3)""",
    ),
    "scores": (
        ("svi",),
        "select county, fips, nullif(area_sqmi, -999) as area_sqmi, nullif(e_hu, -999) as housing_units, "
        "nullif(e_hh, -999) as households, "
        + ", ".join(f"nullif({c}, -999) as {n}" for c, n in K.SVI_COLUMNS.items() if c.startswith("rpl"))
        + " from svi",
    ),
    "tract_profile": (
        ("scores", "relative", "tracts", "tract_pounds"),
        f"""select s.*, r.* exclude (geoid), aland * 0.000247105E0 as land_area_acres,
  a.pounds as pounds_13d_{_FIRST}_{_LAST}, b.pounds as pounds_chloropicrin_{_FIRST}_{_LAST},
  a.pounds / land_area_acres * 100 as pounds_13d_per_100_acres_{_FIRST}_{_LAST},
  b.pounds / land_area_acres * 100 as pounds_chloropicrin_per_100_acres_{_FIRST}_{_LAST},
  a.pounds / nullif(population, 0) * 1000 as pounds_13d_per_1000_people_{_FIRST}_{_LAST},
  b.pounds / nullif(population, 0) * 1000 as pounds_chloropicrin_per_1000_people_{_FIRST}_{_LAST}
from scores s join relative r on fips = r.geoid left join tracts t on fips = t.geoid
left join tract_pounds a on fips = a.geoid and a.chem_code = '573'
left join tract_pounds b on fips = b.geoid and b.chem_code = '136'""",
    ),
}


def over(query: str, *views: str) -> str:
    """``query`` behind a WITH clause that defines the named views and all they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for d in VIEWS[name][0]:
            add(d)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in needed) + "\n" + query
