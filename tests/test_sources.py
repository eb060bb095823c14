"""Readers and writers on files in a fresh folder."""

from __future__ import annotations

import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from areal_exposure.functions import geometry as G
from areal_exposure.sources import layers, text
from areal_exposure.sources.scratch import shared_folder, written


def test_text_table_rules(spark, tmp_path):
    root = tmp_path / "run1999" / "pur"
    for year, body in (("2018", 'code,name\n06, NA \n"",x\n'), ("2019", "code,name\n007,NA\n")):
        (root / year).mkdir(parents=True)
        (root / year / "udc_1.txt").write_text(body)
        (root / year / "other.txt").write_text("a,b\n1,2\n")
    rows = {tuple(r) for r in text.read_records(spark, str(root), ["code", "name"]).collect()}
    assert rows == {("06", None), (None, "x"), ("007", None)}
    named = text.read_records(spark, str(root))
    assert named.columns == ["code", "name"]
    years = text.read_with_path_year(spark, str(root), pattern="*udc*")
    assert {r["year"] for r in years.collect()} == {2018, 2019}


def test_header_mismatch_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n2,1\n")
    with pytest.raises(Exception):
        text.read_records(spark, str(tmp_path), ["x", "y"], pattern="*.csv").collect()


def test_csv_keeps_nulls_and_zeros(spark):
    path = shared_folder(spark, "csv")
    df = spark.createDataFrame([("01", None), (None, "a,b")], "k string, v string")
    text.write_text_table(df, path)
    assert {tuple(r) for r in text.read_records(spark, path, pattern="*.csv").collect()} == {("01", None), (None, "a,b")}


def test_chemical_filter_reaches_the_scan(spark, tmp_path):
    (tmp_path / "udc.csv").write_text("use_no,chem_code,lbs\n1,573,2\n2,999,3\n3,136,\n4,,5\n")
    df = text.read_records(spark, str(tmp_path), codes=["573", "136"])
    assert {tuple(r) for r in df.collect()} == {("1", "573", "2"), ("3", "136", None)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(chem_code, [136,573])" in plan or "In(chem_code, [573,136])" in plan
    only_pounds = df.select("lbs")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<chem_code:string,lbs:string>" in only_pounds


def feature(geometry, **properties):
    return {"type": "Feature", "properties": properties, "geometry": geometry}


SQUARE = {"type": "Polygon", "coordinates": [[[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], [[0.5, 0.5], [1, 0.5], [1, 1], [0.5, 1], [0.5, 0.5]]]}
TWO = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 6], [5, 5]]]]}


def test_collection_with_one_feature_per_line(spark, tmp_path):
    lines = [json.dumps(feature(SQUARE, key="a", n=1)), json.dumps(feature(TWO, key="b", n=None)), json.dumps(feature(None, key="c", n=2))]
    (tmp_path / "layer.geojson").write_text('{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n' + ",\n".join(lines) + "\n]\n}\n")
    df = layers.read_layer(spark, str(tmp_path), "key string, n int, gone string")
    got = {r["key"]: r for r in df.withColumn("area", G.area(F.col("geom"))).collect()}
    assert got["a"]["area"] == pytest.approx(3.75) and got["a"]["n"] == 1 and got["a"]["gone"] is None
    assert got["b"]["area"] == pytest.approx(2.0)
    assert got["c"]["geom"] is None and len(got) == 3


def test_whole_collection_file(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [feature(SQUARE, key="a"), feature(TWO, key="b")]}
    (tmp_path / "layer.geojson").write_text(json.dumps(doc))
    df = layers.read_layer(spark, str(tmp_path), "key string", whole_file=True)
    assert {r["key"]: round(r["area"], 6) for r in df.withColumn("area", G.area(F.col("geom"))).collect()} == {"a": 3.75, "b": 2.0}
    with pytest.raises(Exception, match="whole_file"):
        layers.read_layer(spark, str(tmp_path), "key string").collect()


def test_whole_collection_is_read_in_byte_ranges(spark, tmp_path):
    """One line, strings with braces, quotes and backslashes, members before and after; cut at any byte."""
    odd = ['a{b', 'c}d', 'say "x{"', "back\\", '\\"}{', "é日", "", "[{]"]
    made = [feature(SQUARE if k % 2 else TWO, key=f"{k} {odd[k % len(odd)]}", n=k) for k in range(400)]
    crs = {"type": "name", "properties": {"name": "x}{\\\""}}
    doc = {"type": "FeatureCollection", "name": "a{b", "crs": crs, "features": made, "further": {"a": {"b": 1}}}
    (tmp_path / "one.geojson").write_text(json.dumps(doc, ensure_ascii=False))
    (tmp_path / "two.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": made[:3]}, indent=2) + "\n\n")
    (tmp_path / "none.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001")
    try:
        df = layers.read_layer(spark, str(tmp_path), "key string, n int", whole_file=True, with_path=True, with_order=True)
        rows = df.withColumn("area", G.area(F.col("geom"))).orderBy("file_order").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = [r for r in rows if r["path"].endswith("one.geojson")]
    assert [(r["key"], r["n"]) for r in one] == [(f["properties"]["key"], f["properties"]["n"]) for f in made]
    assert {round(r["area"], 6) for r in one[1::2]} == {3.75} and len(rows) == 403
    assert len({r["file_order"]["block"] for r in one}) > 10


@pytest.mark.parametrize("end", [1, 2, 3, 40])
def test_collection_cut_short_fails(spark, tmp_path, end):
    whole = json.dumps({"type": "FeatureCollection", "features": [feature(SQUARE, key="a"), feature(None, key="b")]})
    (tmp_path / "layer.geojson").write_text(whole[:-end])
    with pytest.raises(Exception):
        layers.read_layer(spark, str(tmp_path), "key string", whole_file=True).collect()


def test_broken_feature_fails(spark, tmp_path):
    (tmp_path / "layer.geojson").write_text('{"type":"Feature","properties":{"key":"a"},"geometry":\n')
    with pytest.raises(Exception):
        layers.read_layer(spark, str(tmp_path), "key string").collect()


def test_layer_roundtrip_keeps_holes_and_parts(spark, tmp_path):
    lines = "\n".join(json.dumps(feature(g, key=k)) for k, g in (("a", SQUARE), ("b", TWO)))
    (tmp_path / "in.geojson").write_text(lines)
    df = layers.read_layer(spark, str(tmp_path), "key string").drop("point")
    path = shared_folder(spark, "layer")
    layers.write_layer(df, path)
    raw = {json.loads(r["value"])["properties"]["key"]: json.loads(r["value"])["geometry"] for r in spark.read.text(path).collect()}
    assert raw["a"]["type"] == "Polygon" and len(raw["a"]["coordinates"]) == 2
    assert raw["b"]["type"] == "MultiPolygon" and len(raw["b"]["coordinates"]) == 2
    back = layers.read_layer(spark, path, "key string").drop("point")
    assert back.exceptAll(df).count() == 0 and back.count() == 2


def test_point_layer(spark):
    df = spark.createDataFrame([("a", (1.5, 2.0))], "key string, point struct<x:double,y:double>")
    path = shared_folder(spark, "points")
    layers.write_layer(df, path, point="point")
    row = layers.read_layer(spark, path, "key string").first()
    assert (row["point"]["x"], row["point"]["y"], row["geom"]) == (1.5, 2.0, None)


def test_yearly_layers_and_stacking(spark):
    square = spark.createDataFrame([("a", 2018), ("b", 2019)], "key string, water_year int").withColumn(
        "geom", G.rectangle(*[F.lit(float(v)) for v in (0, 0, 1, 1)])
    )
    path = shared_folder(spark, "yearly")
    layers.write_layer_by(square, path, "water_year")
    one = layers.read_layer(spark, f"{path}/water_year=2018", "key string, water_year int")
    assert [(r["key"], r["water_year"]) for r in one.collect()] == [("a", 2018)]
    both = layers.stack([one.drop("water_year"), layers.read_layer(spark, f"{path}/water_year=2019", "key string, water_year int")])
    assert {(r["key"], r["water_year"]) for r in both.collect()} == {("a", None), ("b", 2019)}


def test_written_table_is_in_the_shared_folder(spark):
    df = written(spark.range(3), "numbers")
    assert df.count() == 3
    assert all(spark.conf.get("spark.checkpoint.dir") in f for f in df.inputFiles())


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [("1", 'Joe "Red" Hill, Jr'), ("2", "two\nlines"), ("3", "  padded "), ("4", "back\\slash"), ("5", None)]
    text.write_text_table(spark.createDataFrame(rows, "id string, name string").coalesce(1), f"{tmp_path}/out")
    (file,) = (tmp_path / "out").glob("part-*.csv")
    assert file.read_bytes() == b'id,name\n1,"Joe ""Red"" Hill, Jr"\n2,"two\nlines"\n3,  padded \n4,back\\slash\n5,\n'
    back = text.read_text_table(spark, f"{tmp_path}/out", pattern="*.csv", trim=False, multi_line=True)
    assert sorted(map(tuple, back.collect())) == rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_breaks_is_read_in_byte_ranges(spark, tmp_path, end):
    """Equal to one task per file, wherever the ranges are cut."""
    odd = ["plain", "two\nlines", 'say "x"', 'a\n"\n",\n', "", "NA", "é,日", "\n\n\n", " pad ", '"', "a\r\nb", "x" * 900]
    rows = [(f"{k:04d}", odd[k % len(odd)], odd[(k * 5 + 1) % len(odd)]) for k in range(600)]
    for name, part in (("a.csv", rows[:450]), ("b.csv", rows[450:]), ("none.csv", [])):
        with open(tmp_path / name, "w", newline="") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(["id", "note", "other"])
            writer.writerows(part)
            file.write(end * 2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2501")
    try:
        df = text.read_text_table(spark, str(tmp_path), multi_line=True, trim=False, with_order=True)
        got = df.orderBy("file_order").collect()
        kept = text.read_text_table(spark, str(tmp_path), multi_line=True, with_path=True, keep={"id": ["0007", "0451"]}).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = text.read_text_table(spark, str(tmp_path), whole_file=True, trim=False).collect()
    assert [r["id"] for r in got] == [r[0] for r in rows]
    assert [tuple(r)[:3] for r in got] == [tuple(None if x in ("", "NA") else x for x in r) for r in rows]
    if end == "\n":  # one task per file turns breaks inside quotes into line feeds where lines end otherwise
        assert [tuple(r)[:3] for r in got] == sorted(map(tuple, whole))
    assert len({r["file_order"]["block"] for r in got}) > 20
    assert sorted((r["id"], r["_path"][-5:]) for r in kept) == [("0007", "a.csv"), ("0451", "b.csv")]


@pytest.mark.parametrize(
    "content, told",
    [
        ("id,name\n1,a\n2,\"b\n3,c\n", "ends inside quotes"),
        ("id,name\n1,5\" pipe\n2,b\n3,6\" pipe\n", "inside an unquoted field"),
        ("id,name\n1,\"a\nb\",c\n", "(?i)malformed"),
        ("name,id\n1,a\n", "another header"),
    ],
)
def test_csv_with_breaks_that_cannot_be_read_fails(spark, tmp_path, content, told):
    (tmp_path / "a.csv").write_text(content)
    with pytest.raises(Exception, match=told):
        text.read_text_table(spark, str(tmp_path), ["id", "name"], multi_line=True, keep={"id": ["1"]}).collect()


def test_csv_row_of_wrong_width_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a,b\n2,c\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        text.read_text_table(spark, str(tmp_path)).select("id").collect()


@pytest.mark.parametrize("root", ["pur", "/data/2001/pur/", "file:/data/2001/pur"])
def test_path_below_the_folder_that_was_read(spark, root):
    paths = spark.createDataFrame([("file:///data/2001/pur/2018/pur/pur_errors2.csv",)], "_path string")
    assert paths.select(text.below(root).alias("p")).first()["p"] == "/2018/pur/pur_errors2.csv"


def test_year_below_a_relative_folder(spark, tmp_path, monkeypatch):
    folder = tmp_path / "pur" / "2018"
    folder.mkdir(parents=True)
    (folder / "pur_errors2.csv").write_text("use_no\n1\n")
    monkeypatch.chdir(tmp_path)
    path = "file:" + str(tmp_path / "pur")
    assert [r["year"] for r in text.read_with_path_year(spark, path).collect()] == [2018]


RING = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"
POLYGON = f'{{"type":"Polygon","coordinates":{RING}}}'


def named(name, geometry=POLYGON):
    return f'{{"type":"Feature","properties":{{"name":"{name}"}},"geometry":{geometry}}}'


def areas(spark, path, **how):
    layer = layers.read_layer(spark, str(path), "name string", **how)
    return {r["name"]: r["a"] for r in layer.select("name", G.area(F.col("geom")).alias("a")).collect()}


def test_two_features_in_a_line_and_the_end_of_a_collection(spark, tmp_path):
    (tmp_path / "a.json").write_text(f"{named('a')},{named('b')},\n{named('c')}]}}\n")
    assert areas(spark, tmp_path) == {"a": 1.0, "b": 1.0, "c": 1.0}


@pytest.mark.parametrize(
    "content",
    [
        f'{{"type":"FeatureCollection","features":[{named("a")}],"bbox":[0,0,1,1]}}',
        f"{named('a')} {named('b')}",
        named("a", '{"type":"LineString","coordinates":[[0,0],[1,1]]}'),
    ],
)
def test_what_would_be_lost_fails(spark, tmp_path, content):
    (tmp_path / "a.json").write_text(content + "\n")
    with pytest.raises(Exception, match="whole_file|announces|no polygon|Malformed"):
        areas(spark, tmp_path)


def test_collections_of_geometries_and_whole_files(spark, tmp_path):
    line = '{"type":"LineString","coordinates":[[0,0],[1,1]]}'
    mixed = f'{{"type":"GeometryCollection","geometries":[{POLYGON},{line}]}}'
    (tmp_path / "a.json").write_text(named("a", mixed) + "\n")
    assert areas(spark, tmp_path) == {"a": 1.0}
    whole = tmp_path / "whole"
    whole.mkdir()
    (whole / "b.json").write_text(f'{{"type":"FeatureCollection","features":[{named("b")},\n{named("c", mixed)}],"bbox":[0]}}')
    assert areas(spark, whole, whole_file=True) == {"b": 1.0, "c": 1.0}


def test_first_in_file_order(spark, tmp_path):
    """The files' order is neither that of the values nor of the tasks; small blocks, several in a file."""
    from areal_exposure.operators.totals import first_by_key
    from areal_exposure.sources.order import FILE_ORDER

    first = "".join(f"k{i % 50},{9999 - i}\n" for i in range(3000))
    (tmp_path / "b.csv").write_text("k,x\n" + "k1,-5\nk99,1\n")
    (tmp_path / "a.csv").write_text("k,x\n" + first)
    (tmp_path / "a.geojson").write_text("".join(f'{named(f"k{i % 50}")},{named("twice")}\n' for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = text.read_text_table(spark, str(tmp_path), ["k", "x"], pattern="*.csv", with_order=True)
        assert rows.rdd.getNumPartitions() > 4
        got = {r["k"]: r["x"] for r in first_by_key(rows, "k", [FILE_ORDER]).collect()}
        layer = layers.read_layer(spark, str(tmp_path), "name string", pattern="*.geojson", with_order=True)
        in_order = [r["name"] for r in layer.orderBy(FILE_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {f"k{i}": str(9999 - i) for i in range(50)} | {"k99": "1"}
    assert in_order == [x for i in range(500) for x in (f"k{i % 50}", "twice")]


def test_replacing_one_year_leaves_the_others(spark, tmp_path):
    box = G.rectangle(*[F.lit(float(v)) for v in (0, 0, 1, 1)])
    years = spark.createDataFrame([("a", 2018), ("b", 2019), ("c", 2019)], "key string, water_year int").withColumn("geom", box)
    path = str(tmp_path / "years")

    def files():
        return {f.relative_to(path).as_posix(): f.read_bytes() for f in Path(path).rglob("part-*")}

    layers.write_layer_by(years, path, "water_year")
    before = files()
    layers.write_layer_by(years.where("water_year = 2019").withColumn("key", F.lit("new")), path, "water_year", replace=True)
    after = files()
    assert {n: b for n, b in after.items() if "2018" in n} == {n: b for n, b in before.items() if "2018" in n}
    assert all(b"new" in b for n, b in after.items() if "2019" in n) and set(after) != set(before)
    failing = years.withColumn("key", F.when(F.col("key") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("key")))
    with pytest.raises(Exception, match="broken"):
        layers.write_layer_by(failing, path, "water_year", replace=True)
    assert files() == after
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        layers.write_layer_by(years, path, "water_year")
