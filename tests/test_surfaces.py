"""Smoothing, coverage, land shares, routes and estimates against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyquilt import catalog
from skyquilt.functions import geo
from skyquilt.plans.diff import SPOTS, surface_moves
from skyquilt.plans.lineage import estimates, ewma_costs
from skyquilt.plans.maps import smooth_along
from skyquilt.plans.raster import land_shares, painted, smoothed
from skyquilt.streaming import jobs


def moving_mean(pts, z, step, window):
    """One way: samples, their means, and what lies at the points."""
    far = [math.dist(a, b) for a, b in zip(pts, pts[1:])]
    place = np.concatenate([[0.0], np.cumsum(far)]) if far else np.zeros(1)
    length = place[-1]
    if length <= 0:
        return list(z)
    count = max(math.ceil(length / step), 1)
    ring = pts[0] == pts[-1]
    grid = np.linspace(0, length, count + 1)[: count if ring else None]
    moving = np.concatenate([[True], np.array(far) > 0])
    samples = np.interp(grid, place[moving], np.array(z)[moving])
    n, half = len(samples), round(window / 2 / (length / count))
    if ring:
        means = [samples.mean() if 2 * half + 1 >= n else np.mean([samples[(k + d) % n] for d in range(-half, half + 1)]) for k in range(n)]
        return np.interp(place, np.append(grid, length), [*means, means[0]])
    return np.interp(place, grid, [samples[max(0, k - half) : k + half + 1].mean() for k in range(n)])


def test_smooth_along(spark):
    rng, own, want = random.Random(2), [], {}
    for way in range(14):
        n = (1, 2, 3, 5, 9)[way % 5]
        pts = [(rng.random(), rng.random()) for _ in range(n)]
        if way == 7:
            pts = [(0.3, 0.3)] * 3
        if way == 11:
            pts[1:1] = [pts[0], pts[0]]
        if way % 3 == 0 and n > 1:
            pts.append(pts[0])
        if way == 12:
            pts = [(0.1, 0.1), (0.12, 0.1), (0.11, 0.12), (0.1, 0.1)]  # a ring shorter than the window
        z = [float(rng.randrange(500)) for _ in pts]
        own += [(way, i, x, y, a) for i, ((x, y), a) in enumerate(zip(pts, z))]
        want |= {(way, i): v for i, v in enumerate(moving_mean(pts, z, 0.03, 0.31))}
    rng.shuffle(own)
    df = spark.createDataFrame(own, "way long, pos long, x double, y double, alt double").repartition(4)
    got = {(r["way"], r["pos"]): r["smooth"] for r in smooth_along(df, "way", ["pos"], 0.03, 0.31).collect()}
    assert got.keys() == want.keys()
    assert {k: round(v, 6) for k, v in got.items()} == pytest.approx({k: float(v) for k, v in want.items()}, abs=1e-5)


@pytest.mark.parametrize("p", [1, 3, 8])
def test_smoothed(spark, p):
    rng = np.random.default_rng(p)
    alt, weight = rng.integers(0, 900, (9, 13)).astype(float), rng.choice([0.0, 0.25, 1.0], (9, 13))
    kernel = np.array([p + 1 - abs(k) for k in range(-p, p + 1)], float)
    both = lambda a: np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, a, kernel)[:, p:-p], kernel)[p:-p]
    num, den = both(alt * weight), both(weight)
    s = np.where(weight > 0, weight * num / np.where(den > 0, den, 1) + (1 - weight) * alt, alt)
    edge = lambda n: np.minimum(np.minimum(np.arange(n), np.arange(n)[::-1]), p) / p
    down, side = edge(9)[:, None], edge(13)[None, :]
    s = side * (down * s + (1 - down) * alt) + (1 - side) * alt
    want = np.where(weight > 0, s, alt)
    rows = [(r, c, float(alt[r, c]), float(weight[r, c])) for r in range(9) for c in range(13)]
    random.Random(1).shuffle(rows)
    got = np.zeros((9, 13))
    for r in smoothed(spark.createDataFrame(rows, "r long, c long, alt double, weight double").repartition(3), p).collect():
        got[r["r"], r["c"]] = r["smooth"]
    assert np.allclose(got, want, atol=1e-9)


def test_painted(spark):
    rng, own, want = random.Random(6), [], {}
    for m in range(3):
        for _ in range(40):
            kind, x0, y0 = rng.choice("ab"), rng.randrange(30), rng.randrange(30)
            x1, y1 = x0 + rng.randrange(-1, 9), y0 + rng.randrange(-1, 9)
            own.append((m, kind, x0, x1, y0, y1))
            for x in range(x0, x1 + 1):
                for y in range(y0, y1 + 1):
                    want.setdefault((m, x, y), {"a": 0, "b": 0})[kind] += 1
    got = {}
    for r in painted(spark.createDataFrame(own, "map long, kind string, x0 long, x1 long, y0 long, y1 long"), "map", ["a", "b"]).collect():
        for x in range(r["x0"], r["x1"]):
            for y in range(r["y0"], r["y1"]):
                assert (r["map"], x, y) not in got
                got[r["map"], x, y] = {"a": r["a"], "b": r["b"]}
    assert got == want


def test_land_shares(spark):
    rng = random.Random(8)
    posts = [(r, c, float(rng.randrange(500))) for r in range(0, 60) for c in range(0, 60) if rng.random() < 0.95]
    areas = []
    for area in range(25):
        cx, cy, size = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.4, 3, 12, 30])
        k = rng.choice([3, 4, 9])
        ring = [(cx + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / k), cy + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / k)) for i in range(k)]
        areas.append((area, [x for x, _ in ring], [y for _, y in ring]))
    want = {}
    for area, xs, ys in areas:
        inside = []
        for r, c, alt in posts:
            if r % 2 or c % 2:
                continue
            odd = False
            for (x1, y1), (x2, y2) in zip(zip(xs, ys), zip(xs[1:] + xs[:1], ys[1:] + ys[:1])):
                if (y1 > r) != (y2 > r) and c < (x2 - x1) * (r - y1) / (y2 - y1) + x1:
                    odd = not odd
            inside += [alt > 250] if odd else []
        if inside:
            want[area] = (len(inside), sum(inside))
    df = spark.createDataFrame(areas, "area long, xs array<double>, ys array<double>")
    got = {r["area"]: (r["posts"], r["land"]) for r in land_shares(df, spark.createDataFrame(posts, "r long, c long, alt double"), 250.0, stride=2, block=3).collect()}
    assert got == want and len(want) > 15


def test_follow_route(spark):
    """Along a route, beside it, against it, before its start, beyond its end, too far from it, and without one."""
    points = [(0.0, 0.0), (0.0, 1.0), (0.0, 1.0), (0.5, 1.0), (0.5, 2.0)]
    own = [(1, 1, 0.01, 0.5, 90.0), (1, 2, 0.01, 0.5, 270.0), (1, 3, 0.01, 0.5, None), (1, 4, 0.0, -0.1, 90.0), (1, 5, 0.5, 2.1, None), (1, 6, 1.5, 1.5, None), (2, 7, 0.0, 0.5, None), (3, 8, 0.0, 0.0, None), (1, 9, 0.25, 1.02, 10.0)]
    routes = spark.createDataFrame([(1, points), (3, [(0.0, 0.0)])], "aircraft long, points array<struct<lat:double,lon:double>>")
    fixes = spark.createDataFrame(own, "aircraft long, event_id long, lat double, lon double, track double")
    got = {r["event_id"]: r for r in jobs.follow_route(fixes, routes, 100.0).collect()}
    km = geo.KM_PER_DEGREE
    assert [got[i]["leg"] for i in range(1, 10)] == [0, None, 0, 0, 3, None, None, None, 2]
    assert got[1]["off_km"] == pytest.approx(0.01 * km, abs=1e-5) and got[2]["ahead"] is None and got[4]["off_km"] == pytest.approx(0.1 * km, abs=1e-5)
    ahead = [(p["lat"], p["lon"]) for p in got[1]["ahead"]]
    scale = math.cos(math.radians(0.01))
    left = 100.0 - 0.5 * scale * km  # to the corner; the repeated point takes nothing
    assert ahead[:3] == [(0.0, 0.5), (0.0, 1.0), (0.0, 1.0)] and ahead[3] == pytest.approx((left / km, 1.0)) and len(ahead) == 4
    assert [(p["lat"], p["lon"]) for p in got[5]["ahead"]] == [(0.5, 2.0), (0.5, 2.0)]
    assert [tuple(p) for p in got[4]["ahead"]][0] == (0.0, 0.0)


def test_estimates_inherit_the_latest_version(spark):
    runs = spark.createDataFrame([("a", 1, 10.0, 1, 1), ("a", 1, 20.0, 2, 2), ("a", 3, 5.0, 1, 3), ("a", 3, -5.0, 1, 4), ("b", 2, 7.0, 1, 5)], "rule string, version long, seconds double, day int, run long")
    costs = ewma_costs(runs)
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 9), ("b", 1), ("c", 1)], "rule string, version long")
    got = {(r["rule"], r["version"]): (round(r["cost"], 9), r["from_version"]) for r in estimates(asked, costs).collect()}
    assert got == {("a", 1): (13.0, 1), ("a", 2): (3.5, 3), ("a", 3): (3.5, 3), ("a", 9): (3.5, 3), ("b", 1): (7.0, 2), ("c", 1): (1.0, None)}
    assert costs.select(F.sum("n")).first()[0] == 5


def held(px, py, corners):
    """The height at a point that lies on a triangle."""
    (x1, y1, z1), (x2, y2, z2), (x3, y3, z3) = corners
    det = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    if det == 0:
        return None
    w1, w2 = ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / det, ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / det
    return w1 * z1 + w2 * z2 + (1 - w1 - w2) * z3 if min(w1, w2, 1 - w1 - w2) >= -1e-9 else None


def moves_by_hand(triangles, posts):
    meshes = [{}, {}]
    for tri, v1, v2, v3, wet, mesh in triangles:
        for k in (0, 1):
            if mesh & 1 << k and all(v in posts for v in (v1, v2, v3)):
                meshes[k][tri] = ([posts[v][3:] if k and posts[v][3] is not None else posts[v][:3] for v in (v1, v2, v3)], wet)
    place = lambda p: (round(p[0] * 1e8), round(p[1] * 1e8))
    key = lambda c: tuple(sorted((*place(p), round(p[2] * 1e4)) for p in c))
    out = []
    for k in (0, 1):
        keys, places = {key(c) for c, _ in meshes[1 - k].values()}, {place(p) for c, _ in meshes[1 - k].values() for p in c}
        for c, wet in meshes[k].values():
            if wet or key(c) in keys:
                continue
            for w in SPOTS:
                px, py, pz = (sum(a * p[i] for a, p in zip(w, c)) for i in range(3))
                on = next((h for h in ((held(px, py, meshes[1 - k][t][0]), meshes[1 - k][t][1]) for t in sorted(meshes[1 - k])) if h[0] is not None), None)
                if on and not on[1]:
                    out.append((all(place(p) in places for p in c), round(abs(on[0] - pz) * 1000)))
    return sorted(out)


@pytest.mark.parametrize("sheet", [0.07, 0.3, 9.0])
def test_surface_moves(spark, sheet):
    """Two meshes on sheets narrower than a triangle, a few triangles wide, and on one; left and below of 0 as well."""
    rng, side, posts, triangles = random.Random(5), 9, {}, []
    for i in range(side * side):
        x, y, z = i % side / 10 - 0.4 + rng.uniform(0, 0.03), i // side / 10 - 0.4 + rng.uniform(0, 0.03), rng.uniform(0, 9)
        new = (x + 0.004, y, z) if i % 11 == 0 else (x, y, z + 1.5) if i % 7 == 0 else (None,) * 3
        posts[i] = (x, y, z, *new)
    for i in (i for i in range(side * (side - 1)) if i % side < side - 1):
        a, b, c, d = i, i + 1, i + side, i + side + 1
        wet, turned = i % 5 == 0, i % 4 == 0
        triangles += [(2 * i, a, b, c, wet, 1 if turned else 3), (2 * i + 1, b, d, c, wet, 1 if turned else 3)]
        if turned:
            triangles += [(2 * i, a, b, d, wet, 2), (2 * i + 1, a, d, c, wet, 2)]
    triangles += [(900, 0, 8, 72, False, 2), (901, 3, 3, 50, False, 1), (902, 1, 2, 999, False, 3), (903, 10, 11, 20, False, 1), (904, 20, 10, 11, False, 2)]
    rng.shuffle(triangles)
    t = spark.createDataFrame(triangles, "tri long, v1 long, v2 long, v3 long, wet boolean, mesh int").repartition(3)
    p = spark.createDataFrame([(i, *v) for i, v in posts.items()], "id long, x double, y double, z double, nx double, ny double, nz double")
    want = moves_by_hand(triangles, posts)
    assert sorted(map(tuple, surface_moves(t, p, sheet, 0.05).collect())) == want
    assert len(want) > 300 and {r for r, _ in want} == {True, False}


def test_meshes_are_laid_out_once(spark, sf_dir, monkeypatch):
    """Both meshes take their corners together and are shuffled by place once; neither is written."""
    from skyquilt.operators import joins

    monkeypatch.setattr(joins, "shared_dir", lambda df, name: pytest.fail(f"{name} is written"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = catalog.queries()["jn42_surface_moves"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange hashpartitioning(cx") == 1
