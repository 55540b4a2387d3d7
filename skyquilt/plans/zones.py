"""Zones over a grid of cells: validity, priority, coverage, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, view
from ..functions import geo
from ..operators.joins import box_join, dealt
from ..registry import query

# Half-degree cells that hold a point, and the textures that were built before.
VIEWS["cells"] = ("customer", ["CAST(floor(((c_custkey*10007)%36000-18000)/50.0) AS BIGINT) AS cx", "CAST(floor(((c_custkey*7919)%14000-7000)/50.0) AS BIGINT) AS cy", "c_custkey AS id"])
CELLS = ", cell AS (SELECT cx, cy, min(id) AS id, cx*0.5e0 AS w, cy*0.5e0 AS s, cx*0.5e0+0.5e0 AS e, cy*0.5e0+0.5e0 AS n FROM cells GROUP BY cx, cy) "
BASE = cte("cells", "zones") + CELLS


def cells(spark, sf_dir) -> DataFrame:
    c = view(spark, sf_dir, "cells").groupBy("cx", "cy").agg(F.min("id").alias("id"))
    return c.select("*", *((F.col(k) * 0.5 + d).alias(a) for a, k, d in (("w", "cx", 0.0), ("s", "cy", 0.0), ("e", "cx", 0.5), ("n", "cy", 0.5))))


def claims(spark, sf_dir) -> DataFrame:
    """Cells with the zones that overlap them."""
    z = view(spark, sf_dir, "zones")
    return box_join(cells(spark, sf_dir), z, 4.0, ("w", "s", "e", "n"), ("west", "south", "east", "north")).where("w < east AND west < e AND s < north AND south < n")


CLAIMS = ", claims AS (SELECT * FROM cell JOIN zones ON w < east AND west < e AND s < north AND south < n) "


@query(BASE + CLAIMS + "SELECT cell.cx, cell.cy, CAST(coalesce(arg_min(zl, priority), 10) AS BIGINT) AS zl, min(priority) AS zone FROM cell LEFT JOIN claims USING (cx, cy) GROUP BY ALL")
def jn5_zone_cells(spark, sf_dir):
    """The first zone of the list that covers any of a cell wins; the others keep the base level."""
    won = claims(spark, sf_dir).groupBy("cx", "cy").agg(F.min(F.struct("priority", "zl")).alias("z"))
    return cells(spark, sf_dir).join(won, ["cx", "cy"], "left").select("cx", "cy", F.coalesce("z.zl", F.lit(10)).cast("long").alias("zl"), F.col("z.priority").alias("zone"))


@query(cte("cells", "zones", "sites") + CELLS + ", air AS (SELECT *, lon-1.2 AS aw, lat-1.2 AS s2, lon+1.2 AS ae, lat+1.2 AS an FROM sites) SELECT cx, cy, CAST(greatest(10+cell.id%6, coalesce(max(CASE WHEN air.id IS NOT NULL THEN 14+air.id%3 END), 0)) AS BIGINT) AS zl FROM cell LEFT JOIN air ON w <= ae AND aw <= e AND s <= an AND s2 <= n GROUP BY cx, cy, cell.id")
def jn6_airport_covers(spark, sf_dir):
    """Cells round an airport take its level where it is sharper."""
    air = view(spark, sf_dir, "sites").selectExpr("lon-1.2 AS aw", "lat-1.2 AS s2", "lon+1.2 AS ae", "lat+1.2 AS an", "14+id%3 AS azl")
    best = box_join(cells(spark, sf_dir), air, 2.0, ("w", "s", "e", "n"), ("aw", "s2", "ae", "an")).groupBy("cx", "cy").agg(F.max("azl").alias("azl"))
    return cells(spark, sf_dir).join(best, ["cx", "cy"], "left").select("cx", "cy", F.greatest(F.expr("10+id%6"), F.coalesce("azl", F.lit(0))).cast("long").alias("zl"))


@query(BASE + CLAIMS + ", old AS (SELECT cx, cy, arg_max(id, k) AS texture, max(k)//1000000 AS zl FROM (SELECT cx//2 AS cx, cy//2 AS cy, id, (12+id%4)*1000000+id AS k FROM cells) GROUP BY ALL), lvl AS (SELECT cx, cy, min(zl) AS zl FROM claims GROUP BY ALL) SELECT c.cx, c.cy, CASE WHEN coalesce(l.zl, 0) <= o.zl THEN o.texture END AS texture FROM cell c LEFT JOIN lvl l USING (cx, cy) JOIN old o ON o.cx = c.cx//2 AND o.cy = c.cy//2".replace("cx//2", "CAST(floor(cx/2) AS BIGINT)").replace("cy//2", "CAST(floor(cy/2) AS BIGINT)").replace("c.CAST(floor(cx/2) AS BIGINT)", "CAST(floor(c.cx/2) AS BIGINT)").replace("c.CAST(floor(cy/2) AS BIGINT)", "CAST(floor(c.cy/2) AS BIGINT)"))
def jn7_existing_claims(spark, sf_dir):
    """A texture that exists claims its four cells unless a zone wants more; the sharpest, then the latest, stands."""
    half = lambda n: F.floor(F.col(n) / 2)
    old = view(spark, sf_dir, "cells").select(half("cx").alias("ox"), half("cy").alias("oy"), "id", F.expr("12+id%4").alias("ozl")).groupBy("ox", "oy").agg(F.max(F.struct("ozl", "id")).alias("t"))
    level = claims(spark, sf_dir).groupBy("cx", "cy").agg(F.min("zl").alias("zl"))
    c = cells(spark, sf_dir).join(level, ["cx", "cy"], "left").withColumn("ox", half("cx")).withColumn("oy", half("cy")).join(old, ["ox", "oy"])
    return c.select("cx", "cy", F.when(F.coalesce("zl", F.lit(0)) <= F.col("t.ozl"), F.col("t.id")).alias("texture"))


@query(cte("points", "zones") + "SELECT p.id, list_aggregate(list_sort(list(z.priority)), 'string_agg', ',') AS others FROM points p JOIN zones z ON lon < east AND lon+1 > west AND lat < north AND lat+1 > south AND z.priority <> p.id%25 GROUP BY p.id")
def fl8_other_sources(spark, sf_dir):
    """Sources whose extent meets a tile, without its own."""
    t = view(spark, sf_dir, "points").selectExpr("id", "lon AS w", "lat AS s", "lon+1 AS e", "lat+1 AS n")
    hit = box_join(t, view(spark, sf_dir, "zones"), 4.0, ("w", "s", "e", "n"), ("west", "south", "east", "north")).where("w < east AND e > west AND s < north AND n > south AND priority <> id%25")
    return hit.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("priority")), ",").alias("others"))


@query(cte("zones") + "SELECT priority, array_to_string(list_filter([CASE WHEN zl > 15 THEN 'level' END, CASE WHEN east > 150 THEN 'east' END, CASE WHEN (east-west)*(north-south) < 2 THEN 'small' END, CASE WHEN priority%6=0 THEN 'provider' END], lambda x: x IS NOT NULL), ',') AS problems FROM zones")
def fl13_validate_zones(spark, sf_dir):
    """All problems of a zone; a faulty one never refuses the set."""
    rules = {"level": "zl > 15", "east": "east > 150", "small": "(east-west)*(north-south) < 2", "provider": "priority%6=0"}
    return view(spark, sf_dir, "zones").select("priority", F.array_join(F.array_compact(F.array(*(F.when(F.expr(r), n) for n, r in rules.items()))), ",").alias("problems"))


@query(cte("zones") + "SELECT priority, zl FROM zones WHERE west <= 60 AND east >= -70 AND south <= 30 AND north >= -35")
def fl16_visible(spark, sf_dir):
    return view(spark, sf_dir, "zones").where("west <= 60 AND east >= -70 AND south <= 30 AND north >= -35").select("priority", "zl")


@query(BASE + CLAIMS + "SELECT CAST(floor(w/10) AS BIGINT) AS bx, CAST(floor(s/10) AS BIGINT) AS byy, min(zl) AS lowest, max(zl) AS highest FROM claims GROUP BY ALL")
def ag37_lowest_zl(spark, sf_dir):
    return claims(spark, sf_dir).groupBy(F.floor(F.col("w") / 10).alias("bx"), F.floor(F.col("s") / 10).alias("byy")).agg(F.min("zl").alias("lowest"), F.max("zl").alias("highest"))


@query(BASE + CLAIMS + "SELECT priority FROM zones WHERE priority NOT IN (SELECT zone FROM (SELECT min(priority) AS zone FROM claims GROUP BY cx, cy))")
def ag38_unclaimed_zones(spark, sf_dir):
    winners = claims(spark, sf_dir).groupBy("cx", "cy").agg(F.min("priority").alias("priority")).select("priority")
    return view(spark, sf_dir, "zones").select("priority").join(winners, "priority", "left_anti")


@query(cte("cells", "chunks") + "SELECT t, provider, n FROM (SELECT x//256 AS t, provider, count(*) AS n, row_number() OVER (PARTITION BY x//256 ORDER BY count(*) DESC, provider) AS rn FROM chunks GROUP BY 1, 2) WHERE rn = 1")
def ag39_majority_provider(spark, sf_dir):
    n = view(spark, sf_dir, "chunks").groupBy(F.expr("x div 256").alias("t"), "provider").agg(F.count("*").alias("n"))
    return n.groupBy("t").agg(F.min_by(F.struct("provider", "n"), F.struct(-F.col("n"), F.col("provider"))).alias("b")).select("t", "b.provider", "b.n")


@query(cte("zones") + "SELECT priority, count(*) AS textures FROM (SELECT cx, cy, min(priority) AS priority FROM (SELECT priority, cx, unnest(range(CAST(floor(south*2) AS BIGINT), CAST(floor(north*2) AS BIGINT)+1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(west*2) AS BIGINT), CAST(floor(east*2) AS BIGINT)+1)) AS cx FROM zones)) GROUP BY ALL) GROUP BY priority")
def ag40_texture_count(spark, sf_dir):
    """Textures that a zone adds to what the zones before it take."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) * 2), F.floor(F.col(b) * 2)))
    t = view(spark, sf_dir, "zones").withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))
    return t.groupBy("cx", "cy").agg(F.min("priority").alias("priority")).groupBy("priority").agg(F.count("*").alias("textures"))


def clip_ring(ring, edges):
    """Sutherland-Hodgman: a fold over lines (a, b, c), each of which keeps the side a*x + b*y + c >= 0.

    The ring is a lambda's variable, so that no step copies the expression of the steps before it.
    """

    def one(own, e):
        side = lambda p: e["a"] * p["x"] + e["b"] * p["y"] + e["c"]

        def cross(p, q):
            t = side(p) / F.nullif(side(p) - side(q), F.lit(0.0))
            return F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))

        def step(q, i):
            p = F.get(own, F.pmod(i - 1, F.size(own)))
            kept = F.array(F.when((side(p) >= 0) != (side(q) >= 0), cross(p, q)), F.when(side(q) >= 0, F.struct(q["x"].alias("x"), q["y"].alias("y"))))
            return F.filter(kept, lambda v: v.isNotNull())

        return F.flatten(F.transform(own, step))

    return F.aggregate(edges, ring, one)


@query(cte("zones") + """SELECT priority, tlat, t AS tlon, round(a, 6) AS area FROM (SELECT *, (least(east, t+1)-greatest(west, t))*(least(north, tlat+1)-greatest(south, tlat)) AS a FROM (SELECT *, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT)+1)) AS t FROM (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT)+1)) AS tlat FROM zones))) WHERE a > 1e-10""")
def ar4_clip_to_tile(spark, sf_dir):
    """Zone rings cut to the one-degree tiles they meet; slivers go.

    A ring is cut and measured as a lambda's variable inside one generator: a filter on the area, which the planner
    would push down, has nothing to copy.
    """
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    z = dealt(view(spark, sf_dir, "zones"), "priority").withColumn("ring", F.array(p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north")))
    z = z.withColumn("tlat", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("tlon", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    line = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.cast("double").alias("c"))
    edges = F.array(line(1.0, 0.0, -F.col("tlon")), line(-1.0, 0.0, F.col("tlon") + 1), line(0.0, 1.0, -F.col("tlat")), line(0.0, -1.0, F.col("tlat") + 1))

    def area(ring):
        cross = lambda v, i: F.get(ring, F.pmod(i - 1, F.size(ring)))["x"] * v["y"] - v["x"] * F.get(ring, F.pmod(i - 1, F.size(ring)))["y"]
        return F.abs(F.aggregate(F.transform(ring, cross), F.lit(0.0), lambda a, v: a + v)) / 2

    areas = F.filter(F.transform(F.array(clip_ring(F.col("ring"), edges)), area), lambda a: a > 1e-10)
    return z.select("priority", "tlat", "tlon", F.explode(areas).alias("a")).select("priority", "tlat", "tlon", F.round("a", 6).alias("area"))


@query(cte("points", "zones") + "SELECT p.id, min(z.priority) AS zone FROM points p JOIN zones z ON lon >= west AND lon < east AND lat > south AND lat <= north AND (lon-west)/(east-west)+(lat-south)/(north-south) <= 1 GROUP BY p.id")
def ar5_zone_colours(spark, sf_dir):
    """The first zone whose ring (here the triangle below its diagonal) holds a pixel."""
    p = view(spark, sf_dir, "points").selectExpr("id", "lon", "lat", "lon AS lon2", "lat AS lat2")
    pairs = box_join(p, view(spark, sf_dir, "zones"), 4.0, ("lon", "lat", "lon2", "lat2"), ("west", "south", "east", "north"))
    xs, ys = F.array("west", "east", "west"), F.array("south", "south", "north")
    return pairs.where(geo.point_in_ring("lon", "lat", xs, ys)).groupBy("id").agg(F.min("priority").alias("zone"))


@query(cte("points") + "SELECT DISTINCT CAST(floor(lat) AS BIGINT) AS tlat, CAST(floor(lon) AS BIGINT) AS tlon, round(x, 6) AS x FROM points, (SELECT unnest(range(0, 1024))/1024.0*360-180 AS g) gr, LATERAL (SELECT unnest([floor(lon), floor(lon)+1, CASE WHEN g > floor(lon) AND g < floor(lon)+1 THEN g END]) AS x) WHERE x IS NOT NULL")
def st9_grid_lines(spark, sf_dir):
    """Texture-grid meridians inside a tile, and the tile's edges."""
    t = view(spark, sf_dir, "points").select(F.floor("lat").alias("tlat"), F.floor("lon").alias("tlon")).distinct()
    step = 360.0 / 1024
    inner = F.transform(F.sequence(F.floor((F.col("tlon") + 180) / step), F.ceil((F.col("tlon") + 181) / step)), lambda k: k * step - 180)
    lines = F.array_union(F.array(F.col("tlon").cast("double"), F.col("tlon") + 1.0), F.filter(inner, lambda x: (x > F.col("tlon")) & (x < F.col("tlon") + 1)))
    return t.select("tlat", "tlon", F.explode(lines).alias("x")).select("tlat", "tlon", F.round("x", 6).alias("x")).distinct()
