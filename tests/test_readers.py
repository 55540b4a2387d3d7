"""Readers on texts as they come: formats, missing parts, broken rows."""

import json
import math
import time

from pyspark.sql import functions as F

from skyquilt import catalog  # noqa: F401
from skyquilt.sources import readers
from skyquilt.sources.queries import read_terrain_files


def points(df):
    return [tuple(r) for r in df.orderBy("plan", "n").select("n", "ident", "lat", "lon", "first", "last").collect()]


def test_text_plan(spark, tmp_path):
    (tmp_path / "a.fms").write_text("I\n1100 Version\nADEP aaaa\nADES BBBB\n1 aaaa ADEP 0 10.0 20.0\n1 aaaa ADEP 0 10.0 20.0\n11 x 0 99.0 1.0\n28 y 0 1.5 -2.5\n")
    (tmp_path / "b.fms").write_text("no plan\nat all\n1 x 0 1 2")
    assert points(readers.read_flight_plan(spark, str(tmp_path))) == [(0, "AAAA", 10.0, 20.0, "AAAA", "BBBB"), (1, "Y", 1.5, -2.5, "AAAA", "BBBB")]


def test_log_of_one_fix_and_of_none(spark, tmp_path):
    a, b = {"icao_code": "AAAA", "pos_lat": "1", "pos_long": "2"}, {"iata_code": "bb", "pos_lat": "3", "pos_long": "4"}
    (tmp_path / "a.json").write_text(json.dumps({"origin": a, "destination": b, "navlog": {"fix": {"ident": "mid", "pos_lat": "2", "pos_long": "3"}}}))
    got = points(readers.read_flight_plan(spark, str(tmp_path / "a.json"), "json"))
    assert got == [(0, "AAAA", 1.0, 2.0, "AAAA", "BB"), (1, "MID", 2.0, 3.0, "AAAA", "BB"), (2, "BB", 3.0, 4.0, "AAAA", "BB")]
    (tmp_path / "b.json").write_text(json.dumps({"origin": a, "destination": {"icao_code": "CCCC"}}))
    assert points(readers.read_flight_plan(spark, str(tmp_path / "b.json"), "json")) == [(0, "AAAA", 1.0, 2.0, "AAAA", "CCCC")]


def test_waypoints_of_several_plans(spark, tmp_path):
    spot = lambda n, lat: f'<Waypoint><Ident>{n}</Ident><Pos Lon="5" Lat="{lat}"/></Waypoint>'
    plan = lambda *s: "<Flightplan><Waypoints>" + "".join(s) + "</Waypoints></Flightplan>"
    (tmp_path / "a.xml").write_text(f"<doc>{plan(spot('A', 1), spot('A', 1), spot('', 2), '<Waypoint><Ident>Q</Ident></Waypoint>')}{plan(spot('C', 3))}</doc>")
    got = points(readers.read_flight_plan(spark, str(tmp_path), "xml"))
    assert got == [(0, "A", 1.0, 5.0, "A", "?"), (1, "?", 2.0, 5.0, "A", "?"), (0, "C", 3.0, 5.0, "C", "C")]


def test_system_and_threads(spark, tmp_path):
    head = ",".join(readers.SYSTEM)
    (tmp_path / "system.csv").write_text(f"{head}\n1.0,2,3,4,5,6,a=7;b=8\n2.0,2,3,4,5,6,a=x\n3.0,2,3\nbad,2,3,4,5,6,a=1\n4.0,2,3,4,5,6,c=9\n")
    got = [(r.wall, r.net_in, r.disks, r.heat) for r in readers.read_system(spark, str(tmp_path / "system.csv")).orderBy("wall").collect()]
    assert got == [(1.0, 6, {"a": 7, "b": 8}, None), (4.0, 6, {"c": 9}, None)]
    (tmp_path / "threads.csv").write_text("wall,thread,name,cpu_s,state\n1.5,,main,2.5,R\n1.5,7,main,x,R\n2.5,8,io,1\n")
    assert [tuple(r) for r in readers.read_threads(spark, str(tmp_path / "threads.csv")).orderBy("wall").collect()] == [(1.5, "?", "main", 2.5, "R"), (2.5, "8", "io", 1.0, "")]


def test_overlay_text_by_splits(spark, tmp_path):
    """A file that is cut into many splits, and one with lines before its first block; no row holds a file."""
    big = "".join(f"BEGIN_{k} {i}\n" + "".join(f"POINT {j}\n" for j in range(i % 4)) + f"END_{k}\n" for i in range(3000) for k in ("POLYGON",))
    (tmp_path / "a.txt").write_text(big)
    (tmp_path / "b.txt").write_text("A\n800\nPOLYGON_DEF lib 7\nPOINT 1\nBEGIN_PATCH 5\nPOINT 1\nBEGIN_SEGMENT 6\nEND_SEGMENT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        own = readers.read_overlay_text(spark, str(tmp_path))
        assert own.select("kind").rdd.getNumPartitions() > 4
        got = [tuple(r) for r in own.orderBy("file", "block").select("block", "kind", "number", "points").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, "POLYGON", i, i % 4) for i in range(3000)] + [(1, "PATCH", 5, 1), (2, "SEGMENT", 6, 0)]


def test_long_plan_is_read_in_its_length(spark, tmp_path):
    """Forty thousand points, each named twice: a reader that takes every point's plan anew doesn't end."""
    (tmp_path / "a.fms").write_text("I\n1100 Version\nADEP AAAA\n" + "".join(f"1 P{i} ADEP 0.0 {i % 170 - 85}.0 {i % 340 - 170}.5\n" * 2 for i in range(20_000)))
    began = time.time()
    got = readers.read_flight_plan(spark, str(tmp_path)).agg(F.count("*"), F.max("n"), F.max("first"), F.min("last")).first()
    assert tuple(got) == (20_000, 19_999, "AAAA", "P19999")
    assert time.time() - began < 60


def test_read_terrain_files(spark):
    """Lines of blanks, ends of lines, places and repeats of keys; and no text is too long, nor is a list made of its lines."""
    lon, name, head, base = 24 / 4096 * 360 - 180, "16_16_BI12", "A\n800\nTERRAIN\n", "BASE_TEX_NOWRAP ../textures/16_16_BI12.dds\n"
    centre = f"LOAD_CENTER {math.degrees(2 * math.atan(math.exp(math.pi * (1 - 2 * 24 / 4096)))) - 90:.5f} {lon:.5f} 4000 4096\n"
    good = head + "\n" + centre + base
    texts = {
        "plain": (good, None), "returns": (good.replace("\n", "\r\n"), None), "blanks": ("\n  \n" + good.replace("\n", "\n \n"), None), "no end": (good[:-1], None), "swapped": (head + base + centre, None),
        "first": (head + base + "BASE_TEX_NOWRAP other.dds\n" + centre, None), "other": (head + "BASE_TEX_NOWRAP other.dds\n" + base + centre, "texture"), "longer key": (head + "LOAD_CENTERS 1\n" + centre + base, None),
        "no value": (head + "LOAD_CENTER\n" + centre + base, "missing"), "empty": (head + "LOAD_CENTER \n" + centre + base, "centre"), "key inside": (head + "X " + centre + base, "missing"), "early": ("A\n800\n" + base + "TERRAIN\n" + centre, "header"),
        "three": (head + centre.replace(" 4096", "") + base, "centre"), "size": (head + centre.replace("4096", "2048") + base, "centre"), "long": ("\n" * 200_000 + head + "K v\n" * 300_000 + centre + base, None), "none": (None, "header"),
    }
    rows = spark.createDataFrame([(name + ".ter", t) for t, _ in texts.values()], "name string, text string")
    out = read_terrain_files(rows)
    assert [r["fault"] for r in out.collect()] == [fault for _, fault in texts.values()]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    names = {"16_16_BI12.ter": 16, "x16_16_BI12.ter": None, "16_16_BI2.ter": None, "16_99999999999999999999_BI12.ter": None, "16_16_BI12": None}
    got = read_terrain_files(spark.createDataFrame([(n, good) for n in names], "name string, text string")).collect()
    assert [r["til_x"] for r in got] == list(names.values()) and [r["fault"] for r in got] == [None if v else "name" for v in names.values()]
