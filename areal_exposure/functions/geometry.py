"""Polygon arithmetic on nested-array columns, inside the JVM, without a geometry library.

A polygon is ``array<array<struct<x:double,y:double>>>``: open rings (last vertex not repeated), shells
counter-clockwise, holes clockwise, several shells allowed. All areas are signed sums over rings, so
holes and multi-part shapes need no special case. Coordinates are planar; project first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOM_TYPE = "array<array<struct<x:double,y:double>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _next(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def ring_area(ring: Column) -> Column:
    """Signed area, positive when counter-clockwise. Measured from the first vertex to keep digits."""
    o = F.get(ring, F.lit(0))
    cross = F.transform(
        ring,
        lambda p, i: (p["x"] - o["x"]) * (_next(ring, i)["y"] - o["y"])
        - (_next(ring, i)["x"] - o["x"]) * (p["y"] - o["y"]),
    )
    return F.aggregate(cross, F.lit(0.0), lambda s, v: s + v) * 0.5


def area(geom: Column) -> Column:
    return F.aggregate(F.transform(geom, ring_area), F.lit(0.0), lambda s, v: s + v)


def _turned(ring: Column, counter_clockwise: Column) -> Column:
    return F.when((ring_area(ring) >= 0) == counter_clockwise, ring).otherwise(F.reverse(ring))


def orient(rings: Column) -> Column:
    """Turn a shell-then-holes ring list so that the first ring is counter-clockwise, the rest clockwise."""
    return F.transform(rings, lambda r, i: _turned(r, i == 0))


def open_rings(rings: Column) -> Column:
    """Drop the repeated closing vertex."""
    return F.transform(
        rings,
        lambda r: F.when(
            (F.size(r) > 1) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)), F.slice(r, F.lit(1), F.size(r) - 1)
        ).otherwise(r),
    )


def close_rings(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.concat(r, F.slice(r, 1, 1)))


def box(geom: Column) -> Column:
    """Bounding box ``struct<x0,y0,x1,y1>`` in one pass over the vertices; inside out for an empty polygon.

    A fold, not a struct of four array functions: the optimizer would copy the latter to every place that
    reads one side of the box.
    """
    inf = float("inf")
    sides = ("x0", inf, F.least, "x"), ("y0", inf, F.least, "y"), ("x1", -inf, F.greatest, "x"), ("y1", -inf, F.greatest, "y")
    start = F.struct(*[F.lit(limit).alias(n) for n, limit, _, _ in sides])
    return F.aggregate(
        F.flatten(geom), start, lambda b, p: F.struct(*[pick(b[n], p[axis]).alias(n) for n, _, pick, axis in sides])
    )


def edges(geom: Column) -> Column:
    """Non-vertical edges, left to right: start, slope and the sign of the area beneath them.

    The indicator of a polygon is the signed sum, over these edges, of the half-infinite strip below each.
    """

    def of_ring(ring: Column) -> Column:
        return F.transform(
            ring,
            lambda p, i: F.struct(
                p["x"].alias("xa"), p["y"].alias("ya"), _next(ring, i)["x"].alias("xb"), _next(ring, i)["y"].alias("yb")
            ),
        )

    def left_to_right(e: Column) -> Column:
        rightward = e["xa"] < e["xb"]
        return F.struct(
            F.when(rightward, F.lit(-1.0)).otherwise(F.lit(1.0)).alias("sign"),
            F.least(e["xa"], e["xb"]).alias("x0"),
            F.greatest(e["xa"], e["xb"]).alias("x1"),
            F.when(rightward, e["ya"]).otherwise(e["yb"]).alias("y0"),
            ((e["yb"] - e["ya"]) / (e["xb"] - e["xa"])).alias("slope"),
        )

    sides = F.flatten(F.transform(geom, of_ring))
    return F.transform(F.filter(sides, lambda e: e["xa"] != e["xb"]), left_to_right)


def overlap_area(edges_a: Column, edges_b: Column) -> Column:
    """Area common to two polygons, given their :func:`edges`; any shapes, convex or not, with holes.

    With each indicator written as a signed sum of strips below edges, the common area is the signed sum
    over edge pairs of the integral of ``min(a(x), b(x))`` where both exist. The integral of ``b`` alone
    cancels around the closed ring of ``a``, which leaves ``min(a - b, 0)``: differences only, so the
    result does not lose digits to the size of the coordinates.
    """

    def gaps(a: Column) -> Column:
        """For each b beside a: width of the common stretch, and how far a lies above b at its two ends."""

        def gap(b: Column) -> Column:
            lo = F.greatest(a["x0"], b["x0"])
            width = F.least(a["x1"], b["x1"]) - lo
            at_lo = (a["y0"] - b["y0"]) + a["slope"] * (lo - a["x0"]) - b["slope"] * (lo - b["x0"])
            return F.struct(
                (b["sign"] * width).alias("w"), at_lo.alias("d"), ((a["slope"] - b["slope"]) * width).alias("rise")
            )

        beside = F.filter(edges_b, lambda b: (b["x0"] < a["x1"]) & (a["x0"] < b["x1"]))
        return F.transform(F.transform(beside, gap), lambda g: F.struct(g["w"].alias("w"), g["d"].alias("d0"), (g["d"] + g["rise"]).alias("d1")))

    def below(g: Column) -> Column:
        """Signed integral of the negative part of a straight line from d0 to d1."""
        low = F.least(g["d0"], g["d1"])
        return (
            F.when(low >= 0, F.lit(0.0))
            .when(F.greatest(g["d0"], g["d1"]) <= 0, g["w"] * 0.5 * (g["d0"] + g["d1"]))
            .otherwise(g["w"] * -0.5 * low * low / F.abs(g["d0"] - g["d1"]))
        )

    return F.aggregate(
        edges_a,
        F.lit(0.0),
        lambda s, a: s + a["sign"] * F.aggregate(gaps(a), F.lit(0.0), lambda t, g: t + below(g)),
    )


def _clip_by_line(ring: Column, a: Column, b: Column) -> Column:
    """Part of a ring on the left of the line from a to b (one step of Sutherland and Hodgman 1974)."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    none = F.array().cast("array<struct<x:double,y:double>>")

    def step(p: Column, q: Column) -> Column:
        t = p["side"] / (p["side"] - q["side"])
        here, cut = point(p["x"], p["y"]), point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        p_in, q_in = p["side"] >= 0, q["side"] >= 0
        return F.when(p_in & q_in, F.array(here)).when(p_in, F.array(here, cut)).when(q_in, F.array(cut)).otherwise(none)

    def cut_ring(side: Column) -> Column:
        sided = F.zip_with(ring, side, lambda p, d: F.struct(p["x"].alias("x"), p["y"].alias("y"), d.alias("side")))
        return _let(sided, lambda z: F.flatten(F.transform(z, lambda p, i: step(p, _next(z, i)))))

    # Most lines leave most rings alone: those are passed on or dropped after a single look.
    return _let(
        F.transform(ring, lambda p: dx * (p["y"] - a["y"]) - dy * (p["x"] - a["x"])),
        lambda side: F.when(F.array_min(side) >= 0, ring).when(F.array_max(side) < 0, none).otherwise(cut_ring(side)),
    )


def clip_to_convex(geom: Column, convex_ring: Column) -> Column:
    """Every ring of a polygon cut to a convex counter-clockwise ring.

    A concave ring may come back with sides that run forth and back along the cut; they enclose nothing, so
    :func:`area`, :func:`overlap_area` and further clipping stay exact.
    """

    def clipped(ring: Column) -> Column:
        sides = F.transform(convex_ring, lambda p, i: F.struct(p.alias("a"), _next(convex_ring, i).alias("b")))
        return F.aggregate(sides, ring, lambda left, s: _clip_by_line(left, s["a"], s["b"]))

    return F.filter(F.transform(geom, clipped), lambda r: F.size(r) >= 3)


def fan(geom: Column) -> Column:
    """Signed triangles ``struct<sign, ring>`` from each ring's first vertex; their signed sum is the polygon."""

    def of_ring(ring: Column) -> Column:
        o = F.get(ring, F.lit(0))
        triangles = F.transform(
            F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 2, F.lit(0))),
            lambda p, i: F.array(o, p, F.get(ring, i + 2)),
        )
        return F.transform(
            triangles,
            lambda t: F.struct(
                F.signum(ring_area(t)).alias("sign"), F.when(ring_area(t) < 0, F.reverse(t)).otherwise(t).alias("ring")
            ),
        )

    return F.filter(F.flatten(F.transform(geom, of_ring)), lambda t: t["sign"] != 0)


def is_convex(geom: Column) -> Column:
    """One counter-clockwise ring that never turns right, once around."""
    ring = F.get(geom, F.lit(0))

    def turn(p: Column, i: Column) -> Column:
        q, r = _next(ring, i), _next(ring, i + 1)
        return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

    # A ring that turns left everywhere goes round once exactly when every fan triangle is left-turning.
    o = F.get(ring, F.lit(0))
    fan_turns = F.transform(
        ring,
        lambda p, i: (p["x"] - o["x"]) * (_next(ring, i)["y"] - o["y"]) - (_next(ring, i)["x"] - o["x"]) * (p["y"] - o["y"]),
    )
    return (
        (F.size(geom) == 1)
        & F.forall(F.transform(ring, turn), lambda v: v >= 0)
        & F.forall(fan_turns, lambda v: v >= 0)
    )


def clip(geom: Column, other: Column, other_is_convex: Column | None = None) -> Column:
    """Common part of two polygons as rings: one cut for a convex ``other``, signed triangles otherwise.

    With a concave ``other`` the rings are a signed cover, right in every area and overlap computed from it.
    ``other_is_convex`` saves the test when the answer of :func:`is_convex` is at hand.
    """
    by_triangles = F.flatten(
        F.transform(
            fan(other),
            lambda t: F.transform(
                clip_to_convex(geom, t["ring"]), lambda r: F.when(t["sign"] < 0, F.reverse(r)).otherwise(r)
            ),
        )
    )
    convex = is_convex(other) if other_is_convex is None else other_is_convex
    return F.when(convex, clip_to_convex(geom, F.get(other, F.lit(0)))).otherwise(by_triangles)


def _distinct_vertices(ring: Column) -> Column:
    """The ring without vertices that repeat the one before."""
    differing = F.filter(
        F.transform(ring, lambda p, i: F.struct(p.alias("p"), _next(ring, i).alias("q"))),
        lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"]),
    )
    return F.when(F.size(ring) > 0, _let(differing, lambda d: F.when(F.size(d) > 0, F.transform(d, lambda e: e["p"])).otherwise(F.slice(ring, 1, 1))))


def _offset_ring(ring: Column, radius: Column, directions: int) -> Column:
    """The ring moved outwards (to its right): sides by ``radius``, arcs round outer corners, inner corners kept.

    It may cross itself. Where it winds round a point at least once, the point is in the ring's shape or within
    ``radius`` of it: the curve is the sum of the ring, a rectangle on each side and a sector on each outer corner.
    """
    step = 2 * math.pi / directions

    def corner(n: Column, m: Column, v: Column) -> Column:
        """Vertices for ``v`` between sides with unit normals n and m."""
        cross, dot = n["x"] * m["y"] - n["y"] * m["x"], n["x"] * m["x"] + n["y"] * m["y"]
        back = (cross == 0) & (dot < 0)  # the ring turns round and runs back
        turn = F.when(back, F.lit(math.pi)).otherwise(F.atan2(cross, dot))

        def arc(t: Column) -> Column:
            pieces = F.greatest(F.ceil(t / step - 1e-9), F.lit(1))
            # A single vertex is reckoned without angles, so that right corners stay exact.
            single = F.array(point(v["x"] + radius * (n["x"] + m["x"]) / (dot + 1), v["y"] + radius * (n["y"] + m["y"]) / (dot + 1)))
            several = _let(
                F.struct((t / pieces).alias("d"), F.atan2(n["y"], n["x"]).alias("a")),
                lambda u: F.transform(
                    F.sequence(F.lit(0).cast("bigint"), pieces - 1),
                    lambda k: point(
                        v["x"] + radius / F.cos(u["d"] / 2) * F.cos(u["a"] + (k + 0.5) * u["d"]),
                        v["y"] + radius / F.cos(u["d"] / 2) * F.sin(u["a"] + (k + 0.5) * u["d"]),
                    ),
                ),
            )
            return F.when(pieces == 1, single).otherwise(several)

        moved = [point(v["x"] + radius * u["x"], v["y"] + radius * u["y"]) for u in (n, m)]
        inner = F.array(moved[0], point(v["x"], v["y"]), moved[1])
        return _let(turn, lambda t: F.when(t > 0, arc(t)).when(t < 0, inner).otherwise(F.array(moved[1])))

    def normal(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        length = F.sqrt(dx * dx + dy * dy)
        return F.struct((dy / length).alias("x"), (-dx / length).alias("y"))

    def around(r: Column) -> Column:
        normals = F.transform(r, lambda p, i: normal(p, _next(r, i)))
        return _let(
            normals,
            lambda n: F.flatten(F.transform(r, lambda v, i: corner(F.get(n, F.when(i == 0, F.size(n) - 1).otherwise(i - 1)), F.get(n, i), v))),
        )

    def disc(v: Column) -> Column:
        far = 1 / math.cos(step / 2)
        return F.transform(
            F.sequence(F.lit(0), F.lit(directions - 1)),
            lambda k: point(v["x"] + radius * far * F.cos((k + 0.5) * step), v["y"] + radius * far * F.sin((k + 0.5) * step)),
        )

    return _let(_distinct_vertices(ring), lambda r: F.when(F.size(r) == 1, disc(F.get(r, F.lit(0)))).otherwise(around(r)))


def wound(curves: Column) -> Column:
    """What closed curves wind round at least once, as a polygon of upright trapezoids that don't overlap.

    The plane is cut into vertical strips at every vertex and crossing. In a strip no two sides cross, so the sides
    there, in order of height, bound the trapezoids by their running winding count; overlaps count once.
    """

    def height(e: Column, x: Column) -> Column:
        return F.when(x == e["x0"], e["y0"]).otherwise(e["y0"] + e["slope"] * (x - e["x0"]))

    def crossings(sides: Column) -> Column:
        def of(a: Column) -> Column:
            def met(b: Column) -> Column:
                lo, hi = F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])
                return F.struct(lo.alias("lo"), hi.alias("hi"), (height(a, lo) - height(b, lo)).alias("d0"), (height(a, hi) - height(b, hi)).alias("d1"))

            beside = F.filter(sides, lambda b: (b["slope"] > a["slope"]) & (b["x0"] < a["x1"]) & (a["x0"] < b["x1"]))
            crossing = F.filter(F.transform(beside, met), lambda m: (m["d0"] > 0) & (m["d1"] < 0))
            return F.transform(crossing, lambda m: m["lo"] + (m["hi"] - m["lo"]) * (m["d0"] / (m["d0"] - m["d1"])))

        return F.flatten(F.transform(sides, of))

    def strip(sides: Column, x0: Column, x1: Column) -> Column:
        there = F.transform(
            F.filter(sides, lambda e: (e["x0"] <= x0) & (e["x1"] >= x1)),
            lambda e: F.struct((height(e, x0) + height(e, x1)).alias("mid"), height(e, x0).alias("y0"), height(e, x1).alias("y1"), (-e["sign"]).alias("w")),
        )
        none = F.array().cast(GEOM_TYPE)
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), none.alias("out"))

        def step(s: Column, e: Column) -> Column:
            w = s["w"] + e["w"]
            opens, closes = (s["w"] <= 0) & (w > 0), (s["w"] > 0) & (w <= 0)
            made = F.array(point(x0, s["y0"]), point(x1, s["y1"]), point(x1, e["y1"]), point(x0, e["y0"]))
            return F.struct(
                w.alias("w"),
                F.when(opens, e["y0"]).otherwise(s["y0"]).alias("y0"),
                F.when(opens, e["y1"]).otherwise(s["y1"]).alias("y1"),
                F.when(closes, F.concat(s["out"], F.array(made))).otherwise(s["out"]).alias("out"),
            )

        return F.aggregate(F.array_sort(there), start, step, lambda s: s["out"])

    def cut(sides: Column) -> Column:
        ends = F.array_sort(F.array_distinct(F.concat(F.transform(sides, lambda e: e["x0"]), F.transform(sides, lambda e: e["x1"]), crossings(sides))))
        strips = _let(
            ends,
            lambda xs: F.flatten(F.transform(F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), lambda x, i: strip(sides, x, F.get(xs, i + 1)))),
        )
        return F.filter(strips, lambda r: ring_area(r) > 0)

    return _let(edges(curves), cut)


def buffer(geom: Column, radius: Column, directions: int = 64) -> Column:
    """Polygon of all that lies within ``radius`` of ``geom``, be it concave, with holes or in several parts.

    Full circles have ``directions`` sides that touch the round arc from outside: 0.08 % more than a disc at 64.
    One convex ring stays one ring; from other shapes the grown ring of each ring is made into trapezoids that don't
    overlap (see :func:`wound`). Null for null and empty polygons; a ring of one vertex is a point.
    """
    rings = F.filter(geom, lambda r: F.size(r) > 0)
    curves = F.transform(rings, lambda r: _offset_ring(r, radius, directions))
    simple = (F.size(geom) == 1) & (is_convex(geom) | (F.size(F.get(geom, F.lit(0))) <= 2))
    return F.when(F.size(F.flatten(geom)) > 0, F.when(simple, curves).otherwise(wound(curves)))
