"""Literal cases of the scalar functions, helpers and readers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyquilt.functions import geo
from skyquilt.operators import joins
from skyquilt.plans.maps import simplified
from skyquilt.plans.stages import recipe_key
from skyquilt.plans.zones import clip_ring
from skyquilt.sources import readers
from skyquilt.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_texture_addresses(spark):
    x, y = geo.texture_at(F.lit(43.4), F.lit(5.2), 14)
    r = one(spark, x.alias("x"), y.alias("y"))
    assert (r["x"], r["y"]) == (8416, 5984)
    assert one(spark, geo.texture_name(F.lit(8416), F.lit(5984), F.lit("BI"), F.lit(14)).alias("n"))["n"] == "5984_8416_BI14"
    assert one(spark, geo.pixel_size_m(F.lit(0.0), 0).alias("m"))["m"] == pytest.approx(156543.03392804097)


@pytest.mark.parametrize("name,code,zl", [("5952_8416_PDOK1814", "PDOK18", 14), ("5952_8416_PDOK189", "PDOK18", 9), ("0_0_Arc@16", "Arc@", 16), ("a/16_32_USGS22.dds", "USGS", 22)])
def test_texture_names(spark, name, code, zl):
    r = one(spark, geo.parse_texture_name(F.lit(name)).alias("t"))["t"]
    assert (r["provider"], r["zl"]) == (code, zl)


@pytest.mark.parametrize("x,y,zl,key", [(3, 5, 3, "213"), (16857, 11990, 15, "120222133031221")])
def test_quadkeys(spark, x, y, zl, key):
    bx, by = geo.quadkey_xy(F.lit(key))
    r = one(spark, geo.quadkey(F.lit(x), F.lit(y), F.lit(zl)).alias("k"), bx.alias("x"), by.alias("y"))
    assert (r["k"], r["x"], r["y"]) == (key, x, y)


def test_texture_holds_its_point(spark):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame(pd.DataFrame({"lat": rng.uniform(-85, 85, 300), "lon": rng.uniform(-180, 180, 300), "zl": rng.integers(10, 20, 300)}))
    x, y = geo.texture_at("lat", "lon", "zl")
    b = pts.withColumn("x", x).withColumn("y", y).withColumn("b", geo.texture_bbox("x", "y", "zl"))
    assert b.where("lat < b.south - 1e-9 OR lat > b.north + 1e-9 OR lon < b.west - 1e-9 OR lon > b.east + 1e-9").count() == 0


def test_nulls_stay_null(spark):
    r = one(spark, geo.haversine_km(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("d"))
    assert r["d"] is None


def test_clip_concave_free_ring(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(p(-1, -1), p(2, -1), p(2, 0.5), p(-1, 0.5))
    edges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1.0, 0.0, 0.0), (-1.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.0, -1.0, 1.0))))
    got = {(v["x"], v["y"]) for v in one(spark, clip_ring(ring, edges).alias("r"))["r"]}
    assert got == {(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.0, 0.5)}


def test_box_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(1)
    make = lambda s: pd.DataFrame({f"id{s}": range(200), f"w{s}": (w := rng.uniform(-5, 5, 200)), f"s{s}": (t := rng.uniform(-5, 5, 200)), f"e{s}": w + rng.uniform(0, 3, 200), f"n{s}": t + rng.uniform(0, 3, 200)})
    a, b = make("a"), make("b")
    got = joins.box_join(spark.createDataFrame(a), spark.createDataFrame(b), 0.7, ("wa", "sa", "ea", "na"), ("wb", "sb", "eb", "nb")).select("ida", "idb").collect()
    want = {(i, j) for i, p in a.iterrows() for j, q in b.iterrows() if p.wa <= q.eb and q.wb <= p.ea and p.sa <= q.nb and q.sb <= p.na}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 100)], "k string, t int, v int")
    assert {(r["k"], r["t"], r["v"]) for r in joins.as_of(left, right, "k", "t", ["v"]).collect()} == {("a", 5, 50), ("a", 1, None), ("b", 9, None)}
    assert {(r["k"], r["t"], r["v"]) for r in joins.as_of(left, right, "k", "t", ["v"], forward=True).collect()} == {("a", 5, 50), ("a", 1, 20), ("b", 9, 100)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (52, 51)], "a long, b long")
    got = {r["node"]: r["root"] for r in joins.connected_components(links).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {51: 50, 52: 50}


def test_airport_records(spark, tmp_path):
    text = "I\r\n1100 Version\r\n\r\n1 74 1 0 LFML Marseille Provence\r\n1302 icao_code LFML\r\n100 45.00 1 0 0.25 0 2 1 13L 43.44 5.20 0 0 2 0 0 1 31R 43.42 5.22 0 0 2 0 0 1\r\n1 10 0 0 GONE No geometry\r\n16 0 0 0 PAMB Sea base\r\n101 49.00 1 08 59.10 -158.60 26 59.12 -158.62\r\n99\r\n"
    (tmp_path / "apt.dat").write_text("﻿" + text)
    got = {r["ident"]: r for r in readers.read_airports(spark, str(tmp_path)).collect() if r["lat"] is not None or True}
    assert "GONE" not in got and got["LFML"]["icao"] == "LFML" and got["LFML"]["name"] == "Marseille Provence" and got["LFML"]["elev_ft"] == 74


def test_osm_xml_and_json(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="2.5" lon="3.5"><tag k="a" v="b"/></node><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="x"/></way><relation id="9"><member type="way" ref="7" role="outer"/></relation></osm>')
    t = readers.read_osm_xml(spark, str(tmp_path / "a.osm"))
    assert t["nodes"].first()["tags"] == {"a": "b"} and t["ways"].first()["nodes"] == [1, 2]
    (tmp_path / "a.json").write_text('{"elements":[\n{"type":"node","id":1,"lat":2.5,"lon":3.5},{"type":"way","id":7,"nodes":[1,2]},{"type":"relation","id":9,"members":[{"type":"way","ref":7,"role":"outer"}]}]}')
    t = readers.read_osm_json(spark, str(tmp_path / "a.json"))
    assert t["relations"].first()["members"][0]["role"] == "outer" and t["ways"].first()["nodes"] == [1, 2]


def test_elevation_cells(spark, tmp_path):
    z = (np.arange(25) - 5).astype(">i2")
    (tmp_path / "c.hgt").write_bytes(z.tobytes())
    got = {(r["row"], r["col"]): r["alt"] for r in readers.read_elevation(spark, str(tmp_path / "c.hgt"), block=2).collect()}
    assert got == {(i // 5, i % 5): int(z[i]) for i in range(25)}


def test_flight_plan_drops_repeats(spark, tmp_path):
    (tmp_path / "p.fms").write_text("I\n1100 Version\n1 AAA 0 1.0 2.0\n1 AAA 0 1.0 2.0\n11 BBB 0 3.0 4.0\n1 AAA 0 1.0 2.0\n")
    assert [r["ident"] for r in readers.read_flight_plan(spark, str(tmp_path)).orderBy("n").collect()] == ["AAA", "BBB", "AAA"]


def test_simplify_keeps_within_tolerance():
    t = np.linspace(0, 6, 200)
    chain = {"aircraft": np.ones(200), "event_id": np.arange(200), "lat": np.sin(t), "lon": t}
    kept = simplified(chain, 0.05)["event_id"].tolist()
    assert kept[0] == 0 and kept[-1] == 199 and len(kept) < 40
    assert np.abs(np.interp(t, t[kept], np.sin(t)[kept]) - np.sin(t)).max() < 0.08


def test_track_window_has_hysteresis():
    state = {}
    step = lambda lat, lon: jobs.track_window(state, {"lat": lat, "lon": lon, "event_id": 0})
    assert step(43.63, 1.40) and (state["col"], state["row"]) == (1, 43)
    assert step(43.63, 1.60) is None and step(44.05, 1.60) is None
    assert step(43.63, 1.70)["col"] == 2 and step(43.63, 1.40) is None and step(43.63, 1.30)["col"] == 1


def test_recipe_key_ignores_order():
    assert recipe_key("r", 1, {"a": 1, "b": 2}, {}) == recipe_key("r", 1, {"b": 2, "a": 1}, {}) != recipe_key("r", 2, {"a": 1, "b": 2}, {})


def test_sun_is_high_at_noon_in_summer(spark):
    r = one(spark, geo.sun_height(F.lit(172), F.lit(12.0), F.lit(45.0)).alias("h"), geo.is_night(F.lit(172), F.lit(0.0), F.lit(45.0)).alias("n"))
    assert r["h"] == pytest.approx(45 + 23.44, abs=0.1) and r["n"]
    assert math.isclose(geo.KM_PER_DEGREE, 111.195, rel_tol=1e-4)


def test_point_in_ring_on_its_sides(spark):
    """Of a triangle and of a square turned on its tip: sides count in, lower ends and level sides don't."""
    ring = {"t": ([0.0, 4.0, 0.0], [0.0, 0.0, 2.0]), "d": ([0.0, 2.0, 0.0, -2.0], [-2.0, 0.0, 2.0, 0.0])}
    cases = [("t", 1.0, 1.0, True), ("t", 2.0, 1.0, True), ("t", 0.0, 1.0, True), ("t", 2.01, 1.0, False), ("t", -0.01, 1.0, False), ("t", 1.0, 0.0, False), ("t", 0.0, 2.0, True), ("t", 0.0, 0.0, False), ("d", 0.0, 0.0, True), ("d", 1.0, 1.0, True), ("d", -1.0, -1.0, True), ("d", 1.0, -1.0, True), ("d", 2.0, 0.0, True), ("d", -2.0, 0.0, True), ("d", 1.5, 1.0, False), ("d", -1.5, -1.0, False), ("d", 0.0, -2.0, False)]
    df = spark.createDataFrame([(k, x, y, *ring[k], want) for k, x, y, want in cases], "k string, x double, y double, xs array<double>, ys array<double>, want boolean")
    bad = df.where(geo.point_in_ring("x", "y", "xs", "ys") != F.col("want")).collect()
    assert not bad
