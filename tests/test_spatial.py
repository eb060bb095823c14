"""Geometry kernel and overlay against independent arithmetic on random shapes."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from areal_exposure import constants as K
from areal_exposure.functions import geometry as G
from areal_exposure.functions.projection import CALIFORNIA, ellipsoid_area, map_points
from areal_exposure.operators import apportion as A
from areal_exposure.operators import fragments as FR
from areal_exposure.operators import overlay as O

PAIR = f"id int, a {G.GEOM_TYPE}, b {G.GEOM_TYPE}"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return [ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


def star(rng, cx, cy, n, low=0.2):
    angles = [2 * math.pi * (k + rng.uniform(0, 0.4)) / n for k in range(n)]
    return [ring([(cx + r * math.cos(t), cy + r * math.sin(t)) for t in angles for r in [rng.uniform(low, 1.0)]])]


def shoelace(r):
    return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(r, r[1:] + r[:1])) / 2


def inside(pt, geom):
    x, y = pt
    odd = False
    for r in geom:
        for p, q in zip(r, r[1:] + r[:1]):
            if (p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                odd = not odd
    return odd


L_SHAPE = [ring([(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)])]
U_SHAPE = [ring([(0, 0), (3, 0), (3, 2), (2, 2), (2, 1), (1, 1), (1, 2), (0, 2)])]
WITH_HOLE = [*box(0, 0, 3, 3), ring([(1, 1), (1, 2), (2, 2), (2, 1)])]


@pytest.mark.parametrize(
    "a, b, area",
    [
        (box(0, 0, 2, 2), box(1, 1, 3, 3), 1.0),
        (box(0, 0, 1, 1), box(1, 0, 2, 1), 0.0),
        (L_SHAPE, box(0.5, 0.5, 2, 2), 1.25),
        (U_SHAPE, box(0, 1, 3, 2), 2.0),
        (U_SHAPE, L_SHAPE, 3.0),
        (WITH_HOLE, box(0, 0, 1.5, 3), 4.0),
        (WITH_HOLE, WITH_HOLE, 8.0),
        (box(0, 0, 1, 1) + box(5, 5, 6, 6), box(0.5, 0, 6, 5.5), 1.0),
        (box(1e7, 1e7, 1e7 + 1, 1e7 + 1), box(1e7 + 0.5, 1e7, 1e7 + 2, 1e7 + 2), 0.5),
    ],
)
def test_known_overlaps(spark, a, b, area):
    df = spark.createDataFrame([(0, a, b), (1, b, a)], PAIR).withColumns({"ea": G.edges(F.col("a")), "eb": G.edges(F.col("b"))})
    for r in df.select(G.overlap_area(F.col("ea"), F.col("eb")), G.area(G.clip(F.col("a"), F.col("b")))).collect():
        assert r[0] == pytest.approx(area, abs=1e-9)
        assert r[1] == pytest.approx(area, abs=1e-8)


def test_two_methods_agree_on_random_shapes(spark):
    rng = random.Random(7)
    rows = [(i, star(rng, 0, 0, rng.randint(3, 9)), star(rng, rng.uniform(-1, 1), rng.uniform(-1, 1), rng.randint(3, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, PAIR).repartition(8).withColumns({"ea": G.edges(F.col("a")), "eb": G.edges(F.col("b"))})
    got = df.select(
        "id",
        G.overlap_area(F.col("ea"), F.col("eb")).alias("edges"),
        G.area(G.clip(F.col("a"), F.col("b"))).alias("clip"),
        G.area(F.col("a")).alias("area"),
    ).collect()
    for r in got:
        assert r["edges"] == pytest.approx(r["clip"], abs=1e-9)
        assert r["area"] == pytest.approx(sum(shoelace(x) for x in rows[r["id"]][1]), abs=1e-12)
        assert -1e-12 <= r["edges"] <= r["area"] + 1e-9


def test_overlap_matches_point_counting(spark):
    rng = random.Random(3)
    a, b = star(rng, 0, 0, 8), star(rng, 0.3, 0.2, 7)
    n = 400
    hits = sum(
        inside((x, y), a) and inside((x, y), b)
        for i in range(n) for j in range(n)
        for x, y in [(-1.5 + 3 * (i + 0.5) / n, -1.5 + 3 * (j + 0.5) / n)]
    )
    df = spark.createDataFrame([(0, a, b)], PAIR).withColumns({"ea": G.edges(F.col("a")), "eb": G.edges(F.col("b"))})
    assert df.select(G.overlap_area(F.col("ea"), F.col("eb"))).first()[0] == pytest.approx(hits * 9 / n / n, abs=5e-3)


def test_start_vertex_does_not_matter(spark):
    turned = [U_SHAPE[0][k:] + U_SHAPE[0][:k] for k in range(8)]
    df = spark.createDataFrame([(k, [t], L_SHAPE) for k, t in enumerate(turned)], PAIR)
    areas = {round(r[0], 9) for r in df.select(G.area(G.clip(F.col("b"), F.col("a")))).collect()}
    assert areas == {3.0}


def test_convexity(spark):
    pentagram = [ring([(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)])]
    rows = [(0, box(0, 0, 1, 1), []), (1, L_SHAPE, []), (2, WITH_HOLE, []), (3, pentagram, [])]
    got = dict(spark.createDataFrame(rows, PAIR).select("id", G.is_convex(F.col("a"))).collect())
    assert got == {0: True, 1: False, 2: False, 3: False}


def test_buffer(spark):
    rows = [(0, box(0, 0, 4, 3), []), (1, box(0, 0, 1e-9, 1e-9), [])]
    df = spark.createDataFrame(rows, PAIR)
    round_ = dict(df.select("id", G.area(G.buffer(F.col("a"), F.lit(2.0)))).collect())
    square = dict(df.select("id", G.area(G.buffer(F.col("a"), F.lit(2.0), 4))).collect())
    exact = 12 + 2 * 7 * 2 + math.pi * 4
    assert exact < round_[0] < exact * 1.0003
    assert math.pi * 4 < round_[1] < math.pi * 4 * 1.001
    assert square[0] == pytest.approx(8 * 7)


def test_buffers_of_concave_shapes_and_parts(spark):
    r = 0.5
    far = box(0, 0, 1, 1) + box(9, 9, 10, 11)
    spike = [ring([(0, 0), (4, 0), (4, 0), (2, 0)])]
    rows = [(0, L_SHAPE, []), (1, far, []), (2, WITH_HOLE, []), (3, [ring([(3, 3)])], []), (4, [ring([(0, 0), (3, 4)])], []), (5, spike, []), (6, [], []), (7, None, [])]
    got = dict(spark.createDataFrame(rows, PAIR).select("id", G.area(G.buffer(F.col("a"), F.lit(r)))).collect())
    disc = math.pi * r * r
    exact = {
        0: 3 + 8 * r + 5 / 4 * disc - r * r,  # the two rectangles at the inner corner share a square
        1: (1 + 4 * r + disc) + (2 + 6 * r + disc),
        2: 9 + 12 * r + disc,  # the hole of 1 x 1 closes
        3: disc,
        4: 5 * 2 * r + disc,
        5: 4 * 2 * r + disc,
    }
    for k, area in exact.items():
        assert area - 1e-9 <= got[k] <= area * 1.001
    assert got[6] is None and got[7] is None


def distance(pt, geom):
    def to_side(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = max(0, min(1, ((pt[0] - p["x"]) * dx + (pt[1] - p["y"]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(pt[0] - p["x"] - t * dx, pt[1] - p["y"] - t * dy)

    return 0 if inside(pt, geom) else min(to_side(p, q) for r in geom for p, q in zip(r, r[1:] + r[:1]))


@pytest.mark.parametrize("seed", range(4))
def test_buffers_meet_fields_as_by_point_counting(spark, seed):
    rng = random.Random(seed)
    grounds = star(rng, 0, 0, 9, 0.1) + star(rng, 1.8, 0.4, 6, 0.3) if seed else [*box(-1, -1, 1, 1), ring([(-0.8, -0.8), (-0.8, 0.8), (0.8, 0.8), (0.8, -0.8)])]
    field, r, n = star(rng, 0.6, 0.3, 7), rng.uniform(0.1, 0.5), 200
    hits = sum(
        inside(pt, field) and distance(pt, grounds) <= r
        for i in range(n) for j in range(n) for pt in [(-1 + 3 * (i + 0.5) / n, -1 + 3 * (j + 0.5) / n)]
    )
    df = spark.createDataFrame([(0, grounds, field)], PAIR).withColumn("a", G.buffer(F.col("a"), F.lit(r)))
    got = df.select(G.overlap_area(G.edges(F.col("a")), G.edges(F.col("b")))).first()[0]
    assert got == pytest.approx(hits * 9 / n / n, abs=0.01)


def test_overlapping_curves_count_once(spark):
    curves = [(0, box(0, 0, 2, 2) + box(1, 1, 3, 3) + box(0, 0, 2, 2), []), (1, [ring([(0, 0), (2, 2), (2, 0), (0, 2)])], [])]
    got = dict(spark.createDataFrame(curves, PAIR).select("id", G.area(G.wound(F.col("a")))).collect())
    assert got[0] == pytest.approx(7)
    assert got[1] == pytest.approx(1)  # of a bow tie, the half that is wound round counter-clockwise


def test_equal_area_projection(spark):
    cell = box(-120, 36, -119, 37)
    fine = [ring([(-120 + k / 400, 36) for k in range(400)] + [(-119, 36 + k / 400) for k in range(400)]
                 + [(-119 - k / 400, 37) for k in range(400)] + [(-120, 37 - k / 400) for k in range(400)])]
    df = spark.createDataFrame([(0, fine, cell)], PAIR)
    area = df.select(G.area(map_points(F.col("a"), CALIFORNIA.forward))).first()[0]
    e = CALIFORNIA._e
    b2 = K.GRS80_SEMI_MAJOR**2 * (1 - e * e)

    def zone(lat):
        s = math.sin(math.radians(lat))
        return b2 / 2 * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)

    assert area == pytest.approx(math.radians(1) * (zone(37) - zone(36)), rel=1e-6)
    x, y = CALIFORNIA.forward(F.lit(-118.25), F.lit(34.05))
    lon, lat = CALIFORNIA.inverse(F.col("x"), F.col("y"))
    back = spark.range(1).select(x.alias("x"), y.alias("y")).select("x", "y", lon.alias("lon"), lat.alias("lat")).first()
    assert (back["lon"], back["lat"]) == (pytest.approx(-118.25, abs=1e-12), pytest.approx(34.05, abs=1e-12))
    assert (back["x"], back["y"]) == (pytest.approx(161_000, abs=2_000), pytest.approx(-437_000, abs=3_000))


def layers(spark, n, m, seed):
    rng = random.Random(seed)

    def shape():
        size = 4 ** rng.uniform(-3, 3)
        cx, cy = rng.uniform(-20, 20), rng.uniform(-20, 20)
        return [[{"x": p["x"] * size + cx, "y": p["y"] * size + cy} for p in r] for r in star(rng, 0, 0, rng.randint(3, 7))]

    left = spark.createDataFrame([(i, shape()) for i in range(n)], f"i int, geom {G.GEOM_TYPE}")
    right = spark.createDataFrame([(j, shape()) for j in range(m)], f"j int, other_geom {G.GEOM_TYPE}")
    return left, right


@pytest.mark.parametrize("skew", [{}, {"parts": 5, "min_rows": 1}])
def test_overlay_finds_every_pair_once(spark, skew):
    left, right = layers(spark, 60, 50, 11)
    every = left.crossJoin(right).withColumns({"ea": G.edges(F.col("geom")), "eb": G.edges(F.col("other_geom"))})
    every = every.select("i", "j", G.overlap_area(F.col("ea"), F.col("eb")).alias("area")).where("area > 1e-9")
    expected = {(r["i"], r["j"]): r["area"] for r in every.collect()}
    got = O.overlap_join(left, right, **skew).select("i", "j", "area_intersect").collect()
    assert len(got) == len({(r["i"], r["j"]) for r in got})
    found = {(r["i"], r["j"]): r["area_intersect"] for r in got if r["area_intersect"] > 1e-9}
    assert found.keys() == expected.keys() and len(found) > 100
    assert all(found[k] == pytest.approx(v, rel=1e-9) for k, v in expected.items())
    pieces = O.overlap_pieces(left, right, **skew).select("i", "j", G.area(F.col("geom")).alias("area")).collect()
    assert {(r["i"], r["j"]): pytest.approx(r["area"], rel=1e-6, abs=1e-8) for r in pieces if r["area"] > 1e-9}.keys() == expected.keys()


def test_empty_flat_and_touching_shapes_do_not_meet(spark):
    left = spark.createDataFrame([(0, []), (1, [ring([(0, 0), (1, 0), (0.5, 0)])]), (2, box(0, 0, 1, 1)), (3, None)], f"i int, geom {G.GEOM_TYPE}")
    right = spark.createDataFrame([(0, box(1, 0, 2, 1)), (1, box(-1, -1, 0, 0))], f"j int, other_geom {G.GEOM_TYPE}")
    assert O.overlap_join(left, right).count() == 0


def test_concave_crops_conserve_area_and_pounds(spark):
    """Pieces of a partition add up to the whole, and so do the pounds."""
    crops = spark.createDataFrame([(2018, L_SHAPE), (2018, [ring([(2.5, 0), (3.5, 1), (2.5, 2)])])], f"water_year int, geom {G.GEOM_TYPE}")
    grid = [(f"s{i}{j}", box(i, j, i + 1, j + 1)) for i in range(4) for j in range(2)]
    sections = spark.createDataFrame(grid, f"co_mtrs string, geom {G.GEOM_TYPE}")
    pieces = A.crops_by_section(crops, sections)
    assert pieces.agg(F.sum(G.area(F.col("geom")))).first()[0] == pytest.approx(4.0)
    totals = spark.createDataFrame([("573", s, 2018, 100.0) for s, _ in grid], "chem_code string, co_mtrs string, water_year int, pounds double")
    years = A.cropland_years(pieces, totals, square_units_per_acre=1.0)
    schools = spark.createDataFrame([("k1", "S", box(-9, -9, 9, 9)), ("k1", "S", box(-9, -9, 9, 9)), ("k2", "T", box(0.1, 0.1, 0.2, 0.2))], f"cds_code string, school string, geom {G.GEOM_TYPE}")
    buffers = A.school_buffers(schools, radii=(0.5,), units_per_mile=1.0)
    parts = A.crop_fractions(A.buffer_crop_acres(buffers, pieces, 1.0), years)
    rows = parts.collect()
    assert all(0 < r["intersection_fraction"] <= 1 + 1e-9 for r in rows)
    got = {r["cds_code"]: r["pounds"] for r in A.school_totals(parts, ["cds_code", "school"]).collect()}
    n_used = pieces.select("co_mtrs").distinct().count()
    assert got["k1"] == pytest.approx(100.0 * n_used)  # everything, once, although the school is listed twice
    assert 0 < got["k2"] < 100


def test_tract_pounds_are_conserved_and_unknown_sections_drop(spark):
    sections = spark.createDataFrame([("s1", box(0, 0, 1, 1)), ("s2", L_SHAPE)], f"co_mtrs string, geom {G.GEOM_TYPE}")
    tracts = spark.createDataFrame([("t1", box(-1, -1, 0.3, 3)), ("t2", box(0.3, -1, 5, 3))], f"geoid string, geom {G.GEOM_TYPE}")
    totals = spark.createDataFrame([("573", "s1", 10.0), ("573", "s2", 20.0), ("573", "gone", 5.0)], "chem_code string, co_mtrs string, pounds double")
    got = A.tract_totals(A.section_tract_shares(sections, tracts), totals).agg(F.sum("pounds")).first()[0]
    assert got == pytest.approx(30.0)
    dense = A.section_density(totals, sections, square_units_per_acre=1.0)
    assert {r["co_mtrs"]: r["pounds_per_100_acres"] for r in dense.collect()} == {"s1": 1000.0, "s2": pytest.approx(2000 / 3)}


def test_mismatch_report(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0)], "k string, pounds double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.5), (None, 4.0)], "k string, pounds double")
    assert {r["k"] for r in A.pounds_mismatch(a, b, ["k"]).collect()} == {"y", None}


def shapes(spark, name, rings):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring]]) for k, ring in enumerate(rings)]
    return spark.createDataFrame(rows, f"{name} int, {name}_geom array<array<struct<x:double,y:double>>>")


def test_thin_sliver_is_kept_and_touching_borders_are_not(spark):
    section = shapes(spark, "s", [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]])
    others = [[(0, 0), (1000, 1000), (1000, 1000 + 1e-9)], [(1, 1), (999, 999), (999, 999 + 1e-9)], [(1000, 0), (1100, 0), (1100, 90), (1000, 90)]]
    found = O.overlap_join(section, shapes(spark, "o", others), "s_geom", "o_geom").collect()
    rows = {r["o"]: r["area_intersect"] for r in found}
    assert 2 not in rows and rows[1] == pytest.approx(4.99e-7, rel=0.2)


def test_rows_per_polygon_before_the_shuffle(spark):
    fields = shapes(spark, "f", [[(k, 0), (k + 1, 0), (k + 1, 1), (k, 1)] for k in range(200)])
    boxes = [[(0, 0), (1.5 * 2**i, 0), (1.5 * 2**i, 1.5 * 2**j), (0, 1.5 * 2**j)] for i in range(8) for j in range(8)]
    left, right = O.boxed(fields, "f_geom", "l"), O.boxed(shapes(spark, "b", boxes), "b_geom", "r")
    assert O._in_cells(left, "l", O.levels_of(right, "r")).count() <= 10 * fields.count()


@pytest.mark.parametrize("codes", [("a",), ("a", "b", "c")])
def test_exposed_to_any_number_of_chemicals(spark, codes):
    rows = [(c, s, "n", 1.0 if s != "2" or c != "a" else None) for c in "abcd" for s in ("1", "2")]
    wide = spark.createDataFrame(rows, "chem_code string, cds_code string, school string, pounds double")
    assert [r["cds_code"] for r in A.exposed_to_both(wide, "pounds", codes).collect()] == ["1"]


@pytest.mark.parametrize("seed", [0, 1])
def test_fragments_give_the_same_areas(spark, seed):
    """Shapes of all sizes, many of them with vertices and sides on the lines of the grid."""
    rng = random.Random(seed)

    def shape(k):
        if k % 3 == 0:  # on the grid
            x, y, w, h = (rng.randint(-6, 6) for _ in range(4))
            return box(x, y, x + abs(w) + 1, y + abs(h) + 1)
        if k % 3 == 1:
            x, y = rng.randint(-4, 4), rng.randint(-4, 4)
            return [ring([(x + p["x"] * 4, y + p["y"] * 4) for p in r]) for r in (L_SHAPE, U_SHAPE, WITH_HOLE)[k % 9 // 3]]
        size, x, y = 4 ** rng.uniform(-2, 2), rng.uniform(-6, 6), rng.uniform(-6, 6)
        return [ring([(x + size * p["x"], y + size * p["y"]) for p in r]) for r in star(rng, 0, 0, rng.randint(3, 40))]

    left = spark.createDataFrame([(i, shape(i)) for i in range(60)] + [(98, []), (99, None)], f"i int, geom {G.GEOM_TYPE}")
    right = spark.createDataFrame([(j, shape(j)) for j in range(60)] + [(99, [])], f"j int, other_geom {G.GEOM_TYPE}")
    want = {(r["i"], r["j"]): r["area_intersect"] for r in O.overlap_join(left, right).collect() if r["area_intersect"] > 1e-9}
    got = {(r["i"], r["j"]): r["area_intersect"] for r in FR.detailed_overlap_join(left, right, "i", "j").collect() if r["area_intersect"] > 1e-9}
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())


def test_a_tract_of_many_vertices(spark):
    """50,000 vertices against 5,000 sections; a pair is told the few sides in its cells."""
    n, rng = 50_000, random.Random(2)
    angles = [2 * math.pi * k / n for k in range(n)]
    radii = [30 + 3 * math.sin(40 * t) + rng.uniform(0, 0.01) for t in angles]
    tract = [ring([(37 + r * math.cos(t), 37 + r * math.sin(t)) for r, t in zip(radii, angles)])]
    tracts = spark.createDataFrame([(1, tract)], f"t int, geom {G.GEOM_TYPE}")
    sections = spark.range(74 * 74).select(F.col("id"), (F.col("id") % 74).cast("double").alias("x"), F.floor(F.col("id") / 74).cast("double").alias("y"))
    sections = sections.select("id", G.rectangle(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("other_geom"))
    fragments, crossings = FR.cut_up(tracts, "t", "geom", F.array(F.lit(0)))
    assert fragments.agg(F.sum(F.size("sides"))).first()[0] < 1.1 * n
    assert crossings.agg(F.sum(F.size("crossings"))).first()[0] < 1000
    got = {r["id"]: r["area_intersect"] for r in FR.detailed_overlap_join(tracts, sections, "t", "id").collect()}
    assert sum(got.values()) == pytest.approx(sum(shoelace(r) for r in tract), rel=1e-9)
    some = sections.where(F.col("id").isin(*[k for k in got if 0 < got[k] < 1][:40], 37 * 74 + 37))
    for r in O.overlap_join(tracts, some).collect():
        assert got[r["id"]] == pytest.approx(r["area_intersect"], abs=1e-9)


def test_area_on_the_ellipsoid(spark):
    e = CALIFORNIA._e

    def zone(lat):
        s = math.sin(math.radians(lat))
        return (1 - e * e) * (s / (1 - e * e * s * s) + math.atanh(e * s) / e)

    cell = K.GRS80_SEMI_MAJOR**2 / 2 * math.radians(1) * (zone(37) - zone(36))
    over_date_line = [ring([(179.5, 36), (-179.5, 36), (-179.5, 37), (179.5, 37)])]
    clockwise = [ring([(-120, 36), (-120, 37), (-119, 37), (-119, 36)])]
    triangle = [ring([(-120, 36), (-119, 36.5), (-119.5, 37)])]
    rows = [(0, box(-120, 36, -119, 37), []), (1, over_date_line, []), (2, clockwise, []), (3, triangle, []), (4, [], []), (5, None, [])]
    got = dict(spark.createDataFrame(rows, PAIR).select("id", ellipsoid_area(F.col("a"))).collect())
    assert got[0] == pytest.approx(cell, rel=1e-12) and got[1] == pytest.approx(cell, rel=1e-12) and got[2] == pytest.approx(-cell, rel=1e-12)
    fine = [[{"x": p["x"] + (q["x"] - p["x"]) * k / 200, "y": p["y"] + (q["y"] - p["y"]) * k / 200} for p, q in zip(r, r[1:] + r[:1]) for k in range(200)] for r in triangle]
    projected = spark.createDataFrame([(0, fine, [])], PAIR).select(G.area(map_points(F.col("a"), CALIFORNIA.forward))).first()[0]
    assert got[3] == pytest.approx(projected, rel=1e-5)
    assert spark.createDataFrame([(0, fine, [])], PAIR).select(ellipsoid_area(F.col("a"))).first()[0] == pytest.approx(got[3], rel=1e-9)
    assert got[4] == 0 and got[5] is None


def test_tract_shares_by_fragments(spark):
    sections = spark.createDataFrame([("s1", box(0, 0, 1, 1)), ("s2", L_SHAPE)], f"co_mtrs string, geom {G.GEOM_TYPE}")
    tracts = spark.createDataFrame([("t1", box(-1, -1, 0.3, 3)), ("t2", U_SHAPE)], f"geoid string, geom {G.GEOM_TYPE}")
    plain, detailed = ({(r[0], r[1]): (r[2], r[3]) for r in A.section_tract_shares(sections, tracts, 1.0, detailed=d).collect()} for d in (False, True))
    assert plain.keys() == detailed.keys() and all(plain[k] == pytest.approx(detailed[k]) for k in plain)


def test_school_fractions_read_the_records_no_more_once_built(spark, tmp_path):
    """Overlay and join read their sides many times over; both must come from written tables, not from the lines."""
    from datetime import date

    from areal_exposure.plans import catalogue
    from areal_exposure.plans.driver_views import Views

    flag, day = ["A", "R", "N"], date(1997, 5, 1)
    lines = [(i, i % 40, i * 7 % 180, flag[i % 3], 0.05, float(i % 9), 10.0, 0.01, day) for i in range(400)]
    names = "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_discount double, l_quantity double, l_extendedprice double, l_tax double, l_shipdate date"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(k, f"S{k}", k % 3) for k in range(40)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in range(3)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    found = catalogue.fractions(Views(spark, str(tmp_path)))
    assert found.count() > 0
    assert not [f for f in found.inputFiles() if "lineitem" in f or "supplier" in f]


def test_sections_of_large_and_negative_keys(spark, tmp_path):
    from areal_exposure.constants import SECTION_KEY_PARTS
    from areal_exposure.plans.driver_views import Views

    keys = [(s, p) for s in (-41, -20, -1, 0, 7, 19, 123457) for p in (-181, -36, -7, 0, 5, 179, 987654, None)]
    rows = [(1, s, p, "A", 0.05, 1.0, 1.0, 0.01, None) for s, p in keys]
    names = "l_orderkey long, l_suppkey long, l_partkey long, l_returnflag string, l_discount double, l_quantity double, l_extendedprice double, l_tax double, l_shipdate date"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    suppliers = [(s, "S", n) for s, n in zip((-41, -20, -1, 0, 7, 19, 123457), (0, 1, None, 3, 4, 5, 6), strict=True)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    v = Views(spark, str(tmp_path))
    of_records = v.records().select(F.concat(*SECTION_KEY_PARTS).alias("k")).distinct()
    assert sorted(str(r["co_mtrs"]) for r in v.section_corners().select("co_mtrs").distinct().collect()) == sorted(str(r["k"]) for r in of_records.collect())
