"""Operators on small tables against plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from skyquilt.functions import geo
from skyquilt.operators.joins import connected_components, first_in_budget, in_groups, rows_at
from skyquilt.plans import raster
from skyquilt.plans.maps import kinds_met
from skyquilt.plans.planning import tiles_near


def test_first_in_budget(spark):
    rng = random.Random(1)
    own = [(k, rng.randrange(4), rng.randrange(6), i, rng.choice([0, 1, 5, 20])) for k in "ab" for i in range(150)] + [("c", 1, 1, 1, 3)]
    budgets = {"a": 200, "b": 10_000, "c": 3}
    df = spark.createDataFrame(own, "key string, day long, block long, id long, size long").repartition(5)
    got = first_in_budget(df, "key", ["day", "block", "id"], "size", spark.createDataFrame(list(budgets.items()), "key string, budget long"))
    want = []
    for key, rows in itertools.groupby(sorted(own), lambda r: r[0]):
        before = 0
        for r in rows:
            if before < budgets[key]:
                want.append(r)
            before += r[4]
    assert sorted(map(tuple, got.select("key", "day", "block", "id", "size").collect())) == want


def test_rows_at(spark):
    own = [(k, i * i) for k in (0, 1) for i in range(70 + k)]
    places = lambda m: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * m / 5))
    got = rows_at(spark.createDataFrame(own, "key long, id long").repartition(4), "key", "id", 64, places)
    want = {(k, (n * j // 5) ** 2) for k, n in ((0, 70), (1, 71)) for j in range(5)}
    assert set(map(tuple, got.select("key", "id").collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1_000, 1_040)] + [(2_000, i) for i in range(2_001, 2_030)]
    root = {n: n for pair in links for n in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked if find(n) != n}


def filled(alts):
    """Twenty rounds over a dict of posts, all at once in a round."""
    alts, voids = dict(alts), {p for p, v in alts.items() if v == raster.VOID}
    for _ in range(20):
        new = {}
        for r, c in voids:
            near = [alts[p] for p in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)) if alts.get(p, raster.VOID) != raster.VOID]
            if near:
                new[r, c] = max(near)
        alts |= new
        voids -= set(new)
    return alts | {p: 0.0 for p in voids}


def test_clustered_voids(spark, monkeypatch):
    rng = random.Random(3)
    alts = {(r, c): float(rng.randrange(500)) for r in range(12) for c in range(60)}
    alts |= {(r, c): float(raster.VOID) for r in range(2, 12) for c in range(5, 12)}  # several rounds
    alts |= {(r, c): float(raster.VOID) for r in range(12) for c in range(14, 60)}  # more than twenty deep
    df = spark.createDataFrame([(r, c, v) for (r, c), v in alts.items()], "r long, c long, alt double")
    got = {(x["r"], x["c"]): x["alt"] for x in raster.fill_voids(df, F.expr("r div 1200")).collect()}
    want = filled(alts)
    assert got == {p: want[p] for p, v in alts.items() if v == raster.VOID} and 0.0 in got.values()
    monkeypatch.setattr(raster, "MOST_VOIDS", 60)
    got = {(x["r"], x["c"]) for x in raster.fill_voids(df, F.expr("c div 13")).collect()}
    assert got == set()
    got = {(x["r"], x["c"]) for x in raster.fill_voids(df, F.expr("r div 4 * 10 + c div 13")).collect()}
    sizes = {}
    for (r, c), v in alts.items():
        sizes[r // 4, c // 13] = sizes.get((r // 4, c // 13), 0) + (v == raster.VOID)
    assert got == {(r, c) for (r, c), v in alts.items() if v == raster.VOID and sizes[r // 4, c // 13] < 60}


def test_names_that_are_none(spark):
    names = ["16_32_BI14", "a/16_32_EOX9.dds", "17_32_BI14", "16_33_BI14", "16_32_14", "16_BI14", "x16_32_BI14", "16_32_BI", "", None]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(geo.parse_texture_name("n").alias("t")).collect()
    assert [r["t"] and tuple(r["t"]) for r in got] == [(16, 32, "BI", 14), (16, 32, "EOX", 9)] + [None] * 8


def test_groups_cut_from_batches(spark):
    """Groups of one row to many batches, null keys among them, come whole and in order."""
    sizes = {1: 1, 2: 40, 3: 2, None: 9, 5: 7, 6: 1}
    rows = [(k, i, float(i * i % 13)) for k, n in sizes.items() for i in reversed(range(n))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        step = lambda g: {"k": g["k"][:1], "n": [len(g["i"])], "path": [",".join(map(str, g["i"]))]}
        df = spark.createDataFrame(rows, "k long, i long, v double")
        got = {(r.k, r.n, r.path) for r in in_groups(df, ["k"], ["i"], step, "k long, n long, path string").collect()}
        assert got == {(k, n, ",".join(map(str, range(n)))) for k, n in sizes.items()}
        assert in_groups(df.limit(0), ["k"], ["i"], step, "k long, n long, path string").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("lat", [69.5, -56.25])
def test_tiles_near_reach_as_far_as_the_circle(spark, lat):
    """The last sliver of a circle's width, which an arc of the parallel taken for the chord's leaves out."""
    d, k = 100 / geo.KM_PER_DEGREE, math.cos(math.radians(lat))
    chord = math.degrees(2 * math.asin(math.sin(math.radians(d) / 2) / k))
    lon = 10 - (d / k + chord) / 2
    got = {(r["tlat"], r["tlon"]) for r in tiles_near(spark.createDataFrame([(lat, lon)], "lat double, lon double"), 100.0).collect()}
    assert (math.floor(lat), 10) in got


def test_tiles_near_go_round_a_pole(spark):
    got = {(r["tlat"], r["tlon"]) for r in tiles_near(spark.createDataFrame([(89.9, 0.5)], "lat double, lon double"), 100.0).collect()}
    assert got == {(t, u) for t in (89,) for u in range(-180, 180)} | {(88, u) for u in range(-180, 180)} & got


def test_kinds_met(spark):
    rng = random.Random(3)
    points = [(rng.randrange(-40, 40) / 4, rng.randrange(-40, 40) / 4, rng.random() < 0.2) for _ in range(120)]
    boxes = [(i, x, y, x + rng.choice([0.0, 0.25, 1.0, 2.5, 6.0]), y + rng.choice([0.25, 1.0, 3.0])) for i, x, y in ((i, rng.randrange(-44, 44) / 4, rng.randrange(-44, 44) / 4) for i in range(150))]
    got = {r["id"]: (r["land"], r["water"]) for r in kinds_met(spark.createDataFrame(boxes, "id long, w double, s double, e double, n double"), spark.createDataFrame(points, "x double, y double, water boolean"), 1.0).collect()}
    for i, w, s, e, n in boxes:
        met = [k for x, y, k in points if w <= x <= e and s <= y <= n]
        assert got.get(i, (False, False)) == (False in met, True in met)
