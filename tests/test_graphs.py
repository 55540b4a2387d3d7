"""Chains, loops, coasts, blobs, evictions and located points against plain Python."""

import random

import pytest

from skyquilt.operators.joins import connected_components, ranked
from skyquilt.plans.coast import coast_loops
from skyquilt.plans.imagery import evictions
from skyquilt.plans.maps import rings
from skyquilt.plans.mesh import located
from skyquilt.plans import sky
from skyquilt.plans.sky import cell_components, cloud_areas, disc


def walked(after):
    """Every node's first, place and whether it stands on a loop, by walking."""
    out, before = {}, {b: a for a, b in after.items() if b is not None}
    for node in after:
        back, here = [node], node
        while before.get(here) is not None and before[here] != node:
            here = before[here]
            back.append(here)
        if before.get(here) == node:
            first = min(back)
            out[node] = (first, back.index(first), True)
        else:
            out[node] = (here, len(back) - 1, False)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_ranked(spark, seed):
    rng = random.Random(seed)
    names = rng.sample(range(1000), 160)
    after, at = {}, 0
    for size, loop in ((1, False), (1, True), (2, False), (2, True), (7, True), (40, False), (57, True), (50, False)):
        own = names[at : at + size]
        after |= dict(zip(own, [*own[1:], own[0] if loop else None]))
        at += size
    links = list(after.items())
    rng.shuffle(links)
    got = {r["node"]: (r["first"], r["place"], r["closed"]) for r in ranked(spark.createDataFrame(links, "node long, next long").repartition(5)).collect()}
    assert got == walked(after)


def test_ranked_without_rows(spark):
    assert ranked(spark.createDataFrame([], "node long, next long")).count() == 0


def test_rings(spark):
    rng, own, want, way = random.Random(3), [], {}, 0
    for rel, sizes in ((1, [3, 6]), (2, [30]), (3, [1]), (4, [2])):
        for size in sizes:
            nodes = rng.sample(range(rel * 1000 + size * 30, rel * 1000 + size * 30 + 30), size)
            ids = list(range(way, way + size))
            way += size
            own += [(rel, i, *rng.sample([nodes[k], nodes[(k + 1) % size]], 2)) for k, i in enumerate(ids)]
            at = nodes.index(min(nodes))
            ways = [[nodes[(at + s * k) % size] for k in range(size)] for s in (1, -1)]
            want[rel, ids[0]] = min(ways)
    rng.shuffle(own)
    got = {}
    for r in rings(spark.createDataFrame(own, "rel long, way long, e1 long, e2 long").repartition(4), "rel").orderBy("place").collect():
        got.setdefault((r["rel"], r["ring"]), []).append(r["node"])
    assert got == want


def coast(*ways):
    """(tile, way, a, b, xa, ya, xb, yb) of named places; a place is its own node unless it says another."""
    return [(t, w, a, b, *pa, *pb) for t, w, (a, pa), (b, pb) in ways]


def test_coast_loops_and_faults(spark):
    n = lambda i, x, y: (i, (float(x), float(y)))
    west, north, east, south = n(1, 0, 0.5), n(2, 0.5, 1), n(3, 1, 0.5), n(4, 0.5, 0)
    mid = n(5, 0.4, 0.6)
    a, b, c = n(6, 0.3, 0.3), n(7, 0.4, 0.3), n(8, 0.3, 0.4)
    rows = coast(
        # tile 0: one chain of two ways from north to west (the loop goes back along the corner between), an island, a ring of two
        (0, 11, north, mid), (0, 10, mid, west), (0, 1, a, b), (0, 2, b, c), (0, 3, c, a), (0, 4, n(20, 0.7, 0.7), n(21, 0.8, 0.7)), (0, 5, n(21, 0.8, 0.7), n(20, 0.7, 0.7)),
        # tile 1: two chains that make one loop through both, and a sea
        (1, 31, west, north), (1, 30, east, south), (1, 32, b, a), (1, 33, a, c), (1, 34, c, b),
        # tile 2: an end inside; tile 3: three ways at a node; tile 4: both chains end where the next ends; tile 5: two begin at one place
        (2, 40, north, mid), (3, 50, north, mid), (3, 51, mid, west), (3, 52, mid, east), (4, 60, west, north), (4, 61, south, east), (5, 70, north, west), (5, 71, n(9, 0.5, 1), east),
        # tile 6: two ways that meet head on
        (6, 80, north, mid), (6, 81, west, mid),
    )
    random.Random(1).shuffle(rows)
    loops, faults = coast_loops(spark.createDataFrame(rows, "tile long, way long, a long, b long, xa double, ya double, xb double, yb double").repartition(3))
    got = {}
    for r in loops.orderBy("place").collect():
        got.setdefault((r["tile"], r["loop"], r["kind"]), []).append((r["way"], r["area"]))
    ways = {k: [w for w, _ in v] for k, v in got.items()}
    assert ways == {(0, 10, "border"): [10, 11], (0, 1, "island"): [1, 2, 3], (1, 30, "border"): [30, 31], (1, 32, "sea"): [32, 33, 34]}
    assert got[0, 1, "island"][0][1] == pytest.approx(0.005) and got[1, 32, "sea"][0][1] == pytest.approx(-0.005)
    assert got[0, 10, "border"][0][1] == pytest.approx(-0.2)  # clockwise, the corner counted in
    found = {}
    for r in faults.collect():
        found.setdefault((r["tile"], r["fault"]), set()).add(r["way"])
    assert found == {
        (0, "degenerate ring"): {4, 5}, (2, "open end"): {40}, (2, "orientation"): {40}, (3, "triple junction"): {50, 51, 52}, (3, "orientation"): {51, 52}, (4, "orientation"): {60, 61},
        (5, "triple junction"): {70, 71}, (5, "orientation"): {70, 71}, (6, "orientation"): {80, 81},
    }


def test_evictions(spark):
    rng, size = random.Random(5), lambda level: 4_194_304 >> 2 * level
    own = [(s, i, rng.randrange(5), rng.random() < 0.4, rng.randrange(6), rng.random() < 0.8, rng.random() < 0.7) for s in range(4) for i in range(60)]
    budgets = {0: 10**10, 1: 20_000_000, 2: 900_000, 3: 1}
    df = spark.createDataFrame(own, "store long, id long, level int, behind boolean, seen long, coarsen boolean, neutral boolean").repartition(4)
    got = evictions(df, spark.createDataFrame(list(budgets.items()), "store long, budget long"), "store", ["id"])
    want = []
    for store, budget in budgets.items():
        mine = [r for r in own if r[0] == store]
        total = sum(size(r[2]) for r in mine)
        if total <= budget:
            continue
        for sharp, to in ((True, 4), (False, 5)):
            for r in sorted((r for r in mine if ((r[2] < 4 and r[5]) if sharp else (r[2] == 4 and r[6]))), key=lambda r: (not r[3], r[4], r[1])):
                if total <= budget * 9 // 10:
                    break
                freed = size(r[2]) - (size(4) if sharp else 0)
                want.append((store, r[1], r[2], to, freed))
                total -= freed
    assert sorted(map(tuple, got.collect())) == sorted(want) and {w[3] for w in want} == {4, 5}


def labels(cells):
    """Cells by the smallest cell, by row, of what they touch."""
    left, out = set(cells), {}
    while left:
        todo = [left.pop()]
        blob = set(todo)
        while todo:
            x, y = todo.pop()
            for near in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if near in left:
                    left.remove(near)
                    blob.add(near)
                    todo.append(near)
        name = min(y * 2**32 + x + 2**31 for x, y in blob)
        out |= dict.fromkeys(blob, name)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_cloud_areas(spark, seed):
    rng = random.Random(seed)
    cells = {(x + dx, y + dy): "cloud" for x, y in [(rng.randrange(60), rng.randrange(60)) for _ in range(9)] for dx in range(rng.randrange(1, 4)) for dy in range(2)}
    for x, y in [(rng.randrange(-3, 60), rng.randrange(60)) for _ in range(25)]:
        for k in range(rng.randrange(1, 6)):
            cells.setdefault((x + k, y), "shadow")
    grow = lambda own, r: {(x + i, y + j) for x, y in own for i, j in disc(r)}
    cloud, shadow = ({c for c, k in cells.items() if k == kind} for kind in ("cloud", "shadow"))
    wide = grow(grow(cloud, 2), 3)
    blob = labels({(x, y) for x, y in wide if all((x + i, y + j) in wide for i, j in disc(3))})
    size = {b: sum(blob[c] == b for c in cloud) for b in set(blob.values())}
    blob = {c: b for c, b in blob.items() if size[b] >= 3}
    shade = labels(shadow)
    owned = {}
    for b in set(blob.values()):
        reach = grow([c for c in blob if blob[c] == b], 4)
        near = {c for c in shadow if c in reach and blob.get(c) != b}
        whole = {s for s in {shade[c] for c in near} if sum(v == s for v in shade.values()) <= 2 * size[b]}
        owned[b] = near | {c for c in shadow if shade[c] in whole}
    areas = [{b} for b in owned]
    joined = True
    while joined:
        joined = False
        for i, p in enumerate(areas):
            for q in areas[i + 1 :]:
                if {c for b in p for c in owned[b]} & {c for b in q for c in owned[b]}:
                    p |= q
                    areas.remove(q)
                    joined = True
                    break
            if joined:
                break
    want = []
    for own in areas:
        core, dark = {c for c in cloud if blob.get(c) in own}, {c for b in own for c in owned[b]}
        every = core | dark
        want.append((min(own), len(core), len(dark), min(x for x, _ in every), max(x for x, _ in every), min(y for _, y in every), max(y for _, y in every)))
    rows = [(x, y, k) for (x, y), k in cells.items()]
    got = cloud_areas(spark.createDataFrame(rows, "x long, y long, kind string").repartition(3), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_cell_components(spark, monkeypatch):
    """Cells touch over edges and corners, also where runs end and below 0; links grow with runs, not with cells."""
    rng, links = random.Random(4), []
    monkeypatch.setattr(sky, "RUN", 8)
    for share in (0.25, 0.4, 0.7):
        cells = [(x, y) for x in range(-20, 21) for y in range(-12, 13) if rng.random() < share]
        got = cell_components(spark.createDataFrame(cells, "x long, y long").repartition(3)).collect()
        assert {(r["x"], r["y"]): r["blob"] for r in got} == labels(cells) and len(got) == len(cells)
    monkeypatch.setattr(sky, "RUN", 256)
    monkeypatch.setattr(sky, "connected_components", lambda t: links.append(t.count()) or connected_components(t))
    got = cell_components(spark.range(9000).selectExpr("id % 300 - 20 AS x", "id div 300 AS y"))
    assert got.select("blob").distinct().count() == 1 and links[0] <= 5 * 3 * 30


def test_located(spark):
    tris = [(5, 0, 0, 0, 1, 0, 10, 0, 1, 20), (3, 1, 0, 10, 1, 1, 30, 0, 1, 20), (1, 0, 0, 5, 1, 1, 5, 0.5, 0.5, 5), (4, 9, 9, 1, 9.5, 9, 1, 9, 9.5, 1)]
    names = "tri long, " + ", ".join(f"{c}{i} double" for i in (1, 2, 3) for c in "xyz")
    t = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in tris], names)
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 0.5, 0.5), (3, 1.0, 1.0), (4, 2.0, 2.0), (5, 9.1, 9.1), (6, 0.0, 0.0)], "point long, px double, py double")
    got = {r["point"]: (r["tri"], round(r["height"], 9)) for r in located(points, t, ["point"], 0.3).collect()}
    assert got == {1: (5, 7.5), 2: (3, 15.0), 3: (3, 30.0), 5: (4, 1.0), 6: (5, 0.0)}


def test_located_shuffles_each_side_once(spark):
    """Points beside triangles come too when asked for, and what joins by place is not dealt out again to be grouped."""
    t = spark.createDataFrame([(i, float(i), 0.0, 1.0, i + 1.0, 0.0, 2.0, float(i), 1.0, 3.0) for i in range(5)], "tri long, " + ", ".join(f"{c}{i} double" for i in (1, 2, 3) for c in "xyz"))
    points = spark.createDataFrame([(1, 0.25, 0.25), (2, 0.9, 0.9), (3, 1.0, 0.0), (4, -3.0, 7.0)], "point long, px double, py double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = located(points, t, ["point"], 0.3, every=True)
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = {r["point"]: (r["tri"], r["height"]) for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {1: (0, pytest.approx(1.75)), 2: (None, None), 3: (0, pytest.approx(2.0)), 4: (None, None)}
