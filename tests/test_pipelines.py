"""The whole analysis on the smallest tables, file by file."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

import pytest

from areal_exposure.operators import census as C
from areal_exposure.plans import catalogue
from areal_exposure.plans.driver_views import SQUARE_UNITS_PER_ACRE, YEARS, Views
from areal_exposure.plans.pipelines import Choices, Inputs, publish, republish_years

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    v = Views(spark, FOLDER)
    inputs = Inputs(
        chemicals=v.records().select("chem_code"),
        records=v.records(),
        errors=v.errors(),
        counties=v.county_lookup(),
        sections=v.sections(),
        crops=v.crops().drop("co_mtrs"),
        schools=v.schools(),
        enrollment=v.enrollment(),
        school_points=v.school_points(),
        vulnerability=v.svi_map(),
        census_tracts=C.label_variables(v.acs_long()),
        census_state=C.label_variables(v.acs_state_long()),
        tracts=v.tracts(),
    )
    folder = str(tmp_path_factory.mktemp("published"))
    choices = Choices(
        years=YEARS, square_units_per_acre=SQUARE_UNITS_PER_ACRE, units_per_mile=1.0, directions=4, to_lonlat=None
    )
    publish(inputs, folder, choices)
    _PUBLISHED.update(inputs=inputs, choices=choices)
    return folder


_PUBLISHED = {}


def table(spark, path):
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def test_counties(spark, out):
    rows = table(spark, f"{out}/county_year").collect()
    assert rows[0].asDict().keys() == {"chem_code", "county", *map(str, range(YEARS[0], YEARS[1] + 1))}
    assert len(rows) == 60
    state = {r["chem_code"]: r for r in table(spark, f"{out}/state_year").collect()}
    for code in (573, 136):
        for y in range(YEARS[0], YEARS[1] + 1):
            assert sum(r[str(y)] for r in rows if r["chem_code"] == code) == pytest.approx(state[code][str(y)])


def test_schools(spark, out):
    """Crops cut by section lines, then by buffers, give what crops with a given section give."""
    got = {(r["chem_code"], r["radius"], int(r["cds_code"])): r["pounds"] for r in table(spark, f"{out}/school_totals").collect()}
    direct = catalogue.queries()["school_apportion"](spark, FOLDER).collect()
    assert got.keys() == {(int(r["chem_code"]), r["radius"], int(r["cds_code"])) for r in direct}
    for r in direct:
        assert got[(int(r["chem_code"]), r["radius"], int(r["cds_code"]))] == pytest.approx(r["pounds"], abs=1e-5)
    assert all(0 < r["intersection_fraction"] <= 1 + 1e-9 for r in table(spark, f"{out}/school_years").collect())
    points = [json.loads(r["value"]) for r in spark.read.text(f"{out}/school_map").collect()]
    assert points and all(p["geometry"]["type"] == "Point" for p in points)


def test_tracts_and_sections(spark, out):
    assert table(spark, f"{out}/tract_profile").count() == 80
    assert table(spark, f"{out}/correlation_matrix").count() == 105
    assert table(spark, f"{out}/section_quintiles").count() == 12
    tract = json.loads(spark.read.text(f"{out}/tract_map").first()["value"])
    assert tract["geometry"]["type"] == "Polygon" and "svi" in tract["properties"]
    years = spark.read.text(f"{out}/section_years").select("water_year").distinct().count()
    assert years == 5
    for name in ("chemical", "records_with_errors", "section_map", "cropland", "schools", "census_state", "fraction_histogram"):
        assert spark.read.text(f"{out}/{name}").count() > 0


def test_republishing_a_year(spark, out):
    def files(name):
        return {f.relative_to(out).as_posix(): f.read_bytes() for f in Path(out, name).rglob("part-*")}

    def lines(name):
        return sorted(tuple(r) for r in spark.read.text(f"{out}/{name}").collect())

    names = ("section_years", "cropland")
    before, rows = {n: files(n) for n in names}, {n: lines(n) for n in names}
    year = YEARS[0] + 1
    republish_years(_PUBLISHED["inputs"], out, replace(_PUBLISHED["choices"], years=(year, year)))
    for n in names:
        after = files(n)
        same = {f for f in after if before[n].get(f) == after[f]}
        assert same and same == {f for f in after if f"water_year={year}" not in f} and lines(n) == rows[n]
