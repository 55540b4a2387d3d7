"""Flights over sites: paths, corridors, textures, and what building them costs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import cte, view
from ..functions import geo
from ..operators.joins import box_join, dealt, rows_at
from ..registry import query

STEP_KM, RADIUS_KM, ZL = 50.0, 60.0, 11


def legs(spark, sf_dir) -> DataFrame:
    """A leg from each site to the next by id, dealt out by leg: what a leg becomes stays where it is."""
    s = view(spark, sf_dir, "sites")
    own = s.select(F.col("id").alias("leg"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).join(s.select((F.col("id") - 1).alias("leg"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "leg")
    return dealt(own, "leg")


LEGS = ", legs AS (SELECT a.id AS leg, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM sites a JOIN sites b ON b.id = a.id+1) "


def great_circle(df: DataFrame, step_km: float = STEP_KM) -> DataFrame:
    """Adds step, lat, lon: points of the great circle from 1 to 2, the first included, the last not."""
    x = lambda n: F.cos(F.radians(f"lat{n}")) * F.cos(F.radians(f"lon{n}"))
    y = lambda n: F.cos(F.radians(f"lat{n}")) * F.sin(F.radians(f"lon{n}"))
    z = lambda n: F.sin(F.radians(f"lat{n}"))
    df = df.select("*", *(f(n).alias(f"_{k}{n}") for k, f in (("x", x), ("y", y), ("z", z)) for n in (1, 2)))
    df = df.withColumn("_angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.expr("_x1*_x2+_y1*_y2+_z1*_z2")))))
    df = df.withColumn("_n", F.when(F.sin("_angle") < 1e-12, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("_angle") * geo.EARTH_KM / step_km))).cast("int"))
    df = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("step") / F.col("_n")
    wa, wb = F.sin((1 - f) * F.col("_angle")), F.sin(f * F.col("_angle"))
    p = {k: wa * F.col(f"_{k}1") + wb * F.col(f"_{k}2") for k in "xyz"}
    lat, lon = F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))), F.degrees(F.atan2(p["y"], p["x"]))
    out = df.withColumns({"lat": F.when(F.col("step") == 0, F.col("lat1")).otherwise(lat), "lon": F.when(F.col("step") == 0, F.col("lon1")).otherwise(lon)})
    return out.drop("_n", "_angle", *(f"_{k}{n}" for k in "xyz" for n in (1, 2)))


CIRCLE = f""", angles AS (SELECT *, acos(greatest(-1, least(1, cos(radians(lat1))*cos(radians(lat2))*cos(radians(lon2-lon1)) + sin(radians(lat1))*sin(radians(lat2))))) AS a FROM legs),
counted AS (SELECT *, CAST(greatest(1, ceil(a*6371.0088/{STEP_KM})) AS INT) AS n FROM angles),
parts AS (SELECT *, sin((1-i/n)*a) AS wa, sin(i/n*a) AS wb FROM (SELECT *, unnest(range(0, n)) AS step, unnest(range(0, n))::DOUBLE AS i FROM counted)),
xyz AS (SELECT leg, step, lat1, lon1, wa*cos(radians(lat1))*cos(radians(lon1)) + wb*cos(radians(lat2))*cos(radians(lon2)) AS x,
  wa*cos(radians(lat1))*sin(radians(lon1)) + wb*cos(radians(lat2))*sin(radians(lon2)) AS y, wa*sin(radians(lat1)) + wb*sin(radians(lat2)) AS z FROM parts),
path AS (SELECT leg, step, CASE WHEN step=0 THEN lat1 ELSE degrees(atan2(z, sqrt(x*x+y*y))) END AS lat, CASE WHEN step=0 THEN lon1 ELSE degrees(atan2(y, x)) END AS lon FROM xyz) """


@query(cte("sites") + LEGS + CIRCLE + "SELECT leg, CAST(step AS INT) AS step, round(lat, 4) AS lat, round(lon, 4) AS lon FROM path")
def ar1_great_circle(spark, sf_dir):
    return great_circle(legs(spark, sf_dir)).select("leg", "step", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


@query(cte("sites") + LEGS + """, u AS (SELECT *, lon2 + CASE WHEN lon2-lon1 > 180 THEN -360 WHEN lon2-lon1 < -180 THEN 360 ELSE 0 END AS v FROM legs),
e AS (SELECT *, CASE WHEN v > 180 THEN 180 WHEN v < -180 THEN -180 END AS edge FROM u)
SELECT leg, 0 AS piece, round(lat1, 5) AS lat_a, round(lon1, 5) AS lon_a, round(CASE WHEN edge IS NULL THEN lat2 ELSE lat1+(edge-lon1)/(v-lon1)*(lat2-lat1) END, 5) AS lat_b, round(coalesce(edge, v), 5) AS lon_b FROM e
UNION ALL SELECT leg, 1, round(lat1+(edge-lon1)/(v-lon1)*(lat2-lat1), 5), round(-edge, 5), round(lat2, 5), round(lon2, 5) FROM e WHERE edge IS NOT NULL""")
def ar2_cut_antimeridian(spark, sf_dir):
    """Legs cut at 180 degrees, at the latitude where they cross it."""
    e = legs(spark, sf_dir).withColumn("v", geo.lon_unwrap("lon1", "lon2")).withColumn("edge", F.expr("CASE WHEN v > 180 THEN 180D WHEN v < -180 THEN -180D END"))
    e = e.withColumn("cut", F.expr("lat1 + (edge-lon1)/(v-lon1)*(lat2-lat1)"))
    first = "named_struct('piece', 0, 'lat_a', lat1, 'lon_a', lon1, 'lat_b', coalesce(cut, lat2), 'lon_b', coalesce(edge, v))"
    second = "named_struct('piece', 1, 'lat_a', cut, 'lon_a', -edge, 'lat_b', lat2, 'lon_b', lon2)"
    out = e.selectExpr("leg", f"explode(CASE WHEN edge IS NULL THEN array({first}) ELSE array({first}, {second}) END) AS p")
    return out.select("leg", "p.piece", *(F.round(f"p.{n}", 5).alias(n) for n in ("lat_a", "lon_a", "lat_b", "lon_b")))


@query(cte("sites") + LEGS + """, c AS (SELECT leg, lat1, lon1, lat2, lon1 + (CASE WHEN lon2-lon1 > 180 THEN lon2-360 WHEN lon2-lon1 < -180 THEN lon2+360 ELSE lon2 END - lon1) AS v, lon2 FROM legs),
cuts AS (SELECT leg, 0.0::DOUBLE AS t FROM c UNION SELECT leg, 1.0::DOUBLE FROM c
  UNION SELECT leg, (k-lat1)/(lat2-lat1) FROM c, range(-91, 92) r(k) WHERE lat1 <> lat2 AND (k-lat1)/(lat2-lat1) > 0 AND (k-lat1)/(lat2-lat1) < 1
  UNION SELECT leg, (k-lon1)/(v-lon1) FROM c, range(-400, 401) r(k) WHERE v <> lon1 AND (k-lon1)/(v-lon1) > 0 AND (k-lon1)/(v-lon1) < 1),
mids AS (SELECT leg, (t + lead(t) OVER (PARTITION BY leg ORDER BY t))/2 AS m, lead(t) OVER (PARTITION BY leg ORDER BY t) - t AS w FROM cuts)
SELECT DISTINCT leg, CAST(floor(lat1+m*(lat2-lat1)) AS BIGINT) AS tlat, CAST((floor(lon1+m*(v-lon1))+180+360) % 360 - 180 AS BIGINT) AS tlon FROM mids JOIN c USING (leg) WHERE w > 1e-9""")
def ar3_grid_walk(spark, sf_dir):
    """One-degree squares that a straight leg enters: cut at every grid line, the middle of each cut names its square."""
    d = legs(spark, sf_dir).withColumn("v", geo.lon_unwrap("lon1", "lon2"))
    lines = lambda a, b: F.sequence(F.floor(F.least(a, b)), F.ceil(F.greatest(a, b)))
    ts = F.concat(
        F.array(F.lit(0.0), F.lit(1.0)),
        F.when(F.col("lat1") != F.col("lat2"), F.transform(lines("lat1", "lat2"), lambda k: (k - F.col("lat1")) / F.nullif(F.col("lat2") - F.col("lat1"), F.lit(0.0)))).otherwise(F.array().cast("array<double>")),
        F.when(F.col("lon1") != F.col("v"), F.transform(lines("lon1", "v"), lambda k: (k - F.col("lon1")) / F.nullif(F.col("v") - F.col("lon1"), F.lit(0.0)))).otherwise(F.array().cast("array<double>")),
    )
    d = d.withColumn("ts", F.array_sort(F.array_distinct(F.filter(ts, lambda t: (t >= 0) & (t <= 1)))))
    d = d.withColumn("m", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda i: F.when(F.get("ts", i) - F.get("ts", i - 1) > 1e-9, (F.get("ts", i) + F.get("ts", i - 1)) / 2)), lambda t: t.isNotNull())))
    return d.select("leg", F.floor(F.expr("lat1+m*(lat2-lat1)")).alias("tlat"), geo.lon_wrap(F.floor(F.expr("lon1+m*(v-lon1)"))).cast("long").alias("tlon")).distinct()


def tiles_near(df: DataFrame, radius_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds tlat, tlon: the one-degree tiles whose nearest point lies within the radius; round a pole a tile may come twice."""
    dphi = min(radius_km / geo.KM_PER_DEGREE, 180.0)
    # Where a circle's sides are, which is poleward of its middle; a circle round a pole has none.
    side = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(dphi, 90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))))) + 1e-9
    dlam = F.when(F.abs(lat) + dphi < 90, side).otherwise(180.0)
    rows = F.sequence(F.greatest(F.lit(-90), F.floor(F.col(lat) - dphi)), F.least(F.lit(89), F.floor(F.col(lat) + dphi)))
    df = df.withColumn("tlat", F.explode(rows)).withColumn("_t", F.explode(F.sequence(F.floor(F.col(lon) - dlam), F.floor(F.col(lon) + dlam))))
    clamp = lambda v, t: F.least(F.greatest(F.col(v), F.col(t).cast("double")), F.col(t) + 1.0)
    return df.where(geo.haversine_km(lat, lon, clamp(lat, "tlat"), clamp(lon, "_t")) <= radius_km).withColumn("tlon", geo.lon_wrap("_t").cast("long")).drop("_t")


NEAR = """(2*6371.0088*asin(least(1, sqrt(sin(radians(least(greatest(lat,tlat),tlat+1)-lat)/2)^2 + cos(radians(lat))*cos(radians(least(greatest(lat,tlat),tlat+1)))*sin(radians(least(greatest(lon,t),t+1)-lon)/2)^2))))"""
CANDIDATES = "SELECT *, unnest(range(CAST(floor(lon)-{w} AS BIGINT), CAST(floor(lon)+{w}+1 AS BIGINT))) AS t FROM (SELECT *, unnest(range(greatest(-90, CAST(floor(lat)-2 AS BIGINT)), least(90, CAST(floor(lat)+3 AS BIGINT)))) AS tlat FROM {table})"


@query(cte("points") + f"SELECT DISTINCT id, tlat, (t+180+360)%360-180 AS tlon FROM ({CANDIDATES.format(w=6, table='points')}) WHERE {NEAR} <= 100")
def jn8_tiles_within(spark, sf_dir):
    return tiles_near(dealt(view(spark, sf_dir, "points"), "id"), 100.0).select("id", "tlat", "tlon").distinct()


def corridor(spark, sf_dir) -> DataFrame:
    """leg, tlat, tlon, first_step: tiles near a leg's path, by the step that first comes near."""
    path = great_circle(legs(spark, sf_dir))
    return tiles_near(path, RADIUS_KM).groupBy("leg", "tlat", "tlon").agg(F.min("step").alias("first_step"))


CORRIDOR = CIRCLE + f", corridor AS (SELECT leg, tlat, (t+180+720)%360-180 AS tlon, CAST(min(step) AS INT) AS first_step FROM ({CANDIDATES.format(w=14, table='path')}) WHERE {NEAR} <= {RADIUS_KM} GROUP BY ALL) "


@query(cte("sites") + LEGS + CORRIDOR + "SELECT * FROM corridor")
def jn9_corridor_tiles(spark, sf_dir):
    return corridor(spark, sf_dir)


SCENERY = ", scenery AS (SELECT DISTINCT CAST(floor(lat) AS BIGINT) AS tlat, CAST(floor(lon) AS BIGINT) AS tlon FROM points) "


def scenery(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "points").select(F.floor("lat").alias("tlat"), F.floor("lon").alias("tlon")).distinct()


@query(cte("sites", "points") + LEGS + CORRIDOR + SCENERY + "SELECT leg, count(s.tlat) AS kept, count(*) - count(s.tlat) AS left_out FROM corridor LEFT JOIN scenery s USING (tlat, tlon) GROUP BY leg")
def jn10_has_scenery(spark, sf_dir):
    has = scenery(spark, sf_dir).withColumn("has", F.lit(1))
    return corridor(spark, sf_dir).join(has, ["tlat", "tlon"], "left").groupBy("leg").agg(F.count("has").alias("kept"), F.count_if(F.col("has").isNull()).alias("left_out"))


@query(cte("sites", "points") + SCENERY + "SELECT s.id, tlat, tlon, 18 AS zl FROM sites s JOIN scenery ON s.lon-0.3 <= tlon+1 AND tlon <= s.lon+0.3 AND s.lat-0.3 <= tlat+1 AND tlat <= s.lat+0.3")
def jn31_runway_boxes(spark, sf_dir):
    """Tiles met by the grown box of a site, which get sharper textures."""
    s = view(spark, sf_dir, "sites").selectExpr("id", "lon-0.3 AS w", "lat-0.3 AS s", "lon+0.3 AS e", "lat+0.3 AS n")
    t = scenery(spark, sf_dir).selectExpr("tlat", "tlon", "double(tlon) AS w2", "double(tlat) AS s2", "tlon+1D AS e2", "tlat+1D AS n2")
    return box_join(s, t, 2.0, ("w", "s", "e", "n"), ("w2", "s2", "e2", "n2")).select("id", "tlat", "tlon", F.lit(18).alias("zl"))


@query(cte("points", "sites") + "SELECT p.id, r.region FROM points p JOIN (SELECT floor(lat/10) AS a, floor(lon/10) AS b, min(id) AS region FROM sites GROUP BY 1, 2) r ON floor(p.lat/10) = a AND floor(p.lon/10) = b")
def jn32_region_of(spark, sf_dir):
    """A region is named by its first site; there are at most 648 ten-degree blocks, so the map is broadcast."""
    block = lambda n: F.floor(F.col(n) / 10)
    regions = view(spark, sf_dir, "sites").groupBy(block("lat").alias("a"), block("lon").alias("b")).agg(F.min("id").alias("region"))
    return view(spark, sf_dir, "points").select("id", block("lat").alias("a"), block("lon").alias("b")).join(F.broadcast(regions), ["a", "b"]).select("id", "region")


ROUTE = ((48.0, 2.0), (50.0, 8.5), (47.5, 19.0), (41.0, 29.0), (25.0, 55.0))


def leg_km(lat, lon, a, b):
    """Distance of a point to the leg a-b on a plane scaled at the point's latitude."""
    k = F.cos(F.radians(lat))
    km = geo.KM_PER_DEGREE
    px, py, bx, by = (F.col(lon) - a[1]) * k * km, (F.col(lat) - a[0]) * km, (b[1] - a[1]) * k * km, F.lit((b[0] - a[0]) * km)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / (bx * bx + by * by)))
    return F.sqrt(F.pow(px - t * bx, 2) + F.pow(py - t * by, 2))


def _leg_sql(a, b):
    k, km = "cos(radians(lat))", repr(geo.KM_PER_DEGREE)
    px, py, bx, by = f"((lon-{a[1]})*{k}*{km})", f"((lat-{a[0]})*{km})", f"({b[1] - a[1]}*{k}*{km})", f"({b[0] - a[0]}*{km})"
    t = f"greatest(0, least(1, ({px}*{bx}+{py}*{by})/({bx}^2+{by}^2)))"
    return f"sqrt(({px}-{t}*{bx})^2+({py}-{t}*{by})^2)"


@query(cte("points") + f"SELECT id, round(least({', '.join(_leg_sql(a, b) for a, b in zip(ROUTE, ROUTE[1:]))}), 3) AS km FROM points")
def jn35_distance_to_route(spark, sf_dir):
    """The route is a parameter of a few legs: an expression, no join."""
    return view(spark, sf_dir, "points").select("id", F.round(F.least(*(leg_km("lat", "lon", a, b) for a, b in zip(ROUTE, ROUTE[1:]))), 3).alias("km"))


TX = "CAST(trunc(({lon}/180+1)*2^{e}) AS BIGINT)*16"
TY = "CAST(trunc((1-ln(tan((90+({lat}))*pi()/360))/pi())*2^{e}) AS BIGINT)*16"


def textures_of_box(df: DataFrame, zl: int, west: str, south: str, east: str, north: str) -> DataFrame:
    """Adds til_x, til_y: all textures of the closed box."""
    x0, y0 = geo.texture_at(north, west, zl)
    x1, y1 = geo.texture_at(south, east, zl)
    return df.withColumn("til_x", F.explode(F.sequence(x0, x1, F.lit(16).cast("long")))).withColumn("til_y", F.explode(F.sequence(y0, y1, F.lit(16).cast("long"))))


@query(cte("zones") + f"SELECT DISTINCT til_x, til_y FROM (SELECT *, unnest(range({TY.format(lat='north', e=5)}, {TY.format(lat='south', e=5)}+16, 16)) AS til_y FROM (SELECT *, unnest(range({TX.format(lon='west', e=5)}, {TX.format(lon='east', e=5)}+16, 16)) AS til_x FROM zones))")
def st1_textures_covering(spark, sf_dir):
    return textures_of_box(view(spark, sf_dir, "zones"), 10, "west", "south", "east", "north").select("til_x", "til_y").distinct()


@query(cte("zones") + """SELECT DISTINCT tlat, (t+180+360)%360-180 AS tlon FROM (SELECT *, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT)+1)) AS t FROM (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT)+1)) AS tlat FROM zones))
WHERE (least(east, t+1)-greatest(west, t))*(least(north, tlat+1)-greatest(south, tlat)) > 1e-10""")
def st2_tiles_touched(spark, sf_dir):
    z = view(spark, sf_dir, "zones").withColumn("tlat", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("t", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    area = F.expr("(least(east, t+1)-greatest(west, t))*(least(north, tlat+1)-greatest(south, tlat))")
    return z.where(area > 1e-10).select("tlat", geo.lon_wrap("t").cast("long").alias("tlon")).distinct()


@query(cte("sites") + LEGS + CORRIDOR + ", ends AS (SELECT leg, CAST(floor(lat1) AS BIGINT) AS tlat, CAST(floor(lon1) AS BIGINT) AS tlon FROM legs UNION SELECT leg, CAST(floor(lat2) AS BIGINT), CAST(floor(lon2) AS BIGINT) FROM legs) SELECT leg, tlat, tlon, 'end' AS part FROM ends UNION ALL SELECT leg, tlat, tlon, 'along' FROM corridor ANTI JOIN ends USING (leg, tlat, tlon)")
def st3_ends_and_along(spark, sf_dir):
    own = legs(spark, sf_dir)
    end = lambda n: own.select("leg", F.floor(f"lat{n}").alias("tlat"), F.floor(f"lon{n}").alias("tlon"))
    ends = end(1).union(end(2)).distinct()
    along = corridor(spark, sf_dir).select("leg", "tlat", "tlon").join(ends, ["leg", "tlat", "tlon"], "left_anti")
    return ends.withColumn("part", F.lit("end")).unionByName(along.withColumn("part", F.lit("along")))


@query(cte("points") + ", n AS (SELECT *, row_number() OVER (PARTITION BY id%8 ORDER BY id)-1 AS i, count(*) OVER (PARTITION BY id%8) AS m FROM points) SELECT id, id%8 AS lot FROM n WHERE i IN (SELECT CAST(floor(k*m/20.0) AS BIGINT) FROM range(0, 20) t(k))")
def tk7_evenly_spaced(spark, sf_dir):
    """Twenty items of each lot, at even distances in its order."""
    n = view(spark, sf_dir, "points").select("id", F.expr("id%8").alias("lot"))
    places = lambda m: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(k * m / 20))
    return rows_at(n, "lot", "id", 4096, places).select("id", "lot")


@query(cte("sites") + LEGS + CORRIDOR + "SELECT leg, tlat, tlon, row_number() OVER (PARTITION BY leg ORDER BY first_step, tlat, tlon) AS pos FROM corridor")
def tk9_flight_order(spark, sf_dir):
    order = Window.partitionBy("leg").orderBy("first_step", "tlat", "tlon")
    return corridor(spark, sf_dir).select("leg", "tlat", "tlon", F.row_number().over(order).alias("pos"))


HAV = "2*6371.0088*asin(least(1, sqrt(sin(radians(lat-la)/2)^2 + cos(radians(la))*cos(radians(lat))*sin(radians(lon-lo)/2)^2)))"


@query(cte("fixes") + f", p AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM fixes WINDOW w AS (PARTITION BY aircraft ORDER BY ts, event_id)) SELECT aircraft, event_id, CASE WHEN la IS NOT NULL THEN round({HAV}, 4) END AS km, round(sum(CASE WHEN la IS NULL THEN 0 ELSE {HAV} END) OVER (PARTITION BY aircraft ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM p")
def wn6_leg_lengths(spark, sf_dir):
    w = Window.partitionBy("aircraft").orderBy("ts", "event_id")
    p = view(spark, sf_dir, "fixes").withColumn("km", geo.haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"))
    return p.select("aircraft", "event_id", F.round("km", 4).alias("km"), F.round(F.sum(F.coalesce("km", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("so_far"))


@query(cte("loads") + "SELECT run, event_id, tlat FROM (SELECT *, lag(tlat) OVER (PARTITION BY run ORDER BY ts, event_id) AS p FROM loads) WHERE p IS DISTINCT FROM tlat")
def wn18_consecutive_dedup(spark, sf_dir):
    w = Window.partitionBy("run").orderBy("ts", "event_id")
    return view(spark, sf_dir, "loads").withColumn("p", F.lag("tlat").over(w)).where(~F.col("p").eqNullSafe(F.col("tlat"))).select("run", "event_id", "tlat")


PIECES = ", pieces AS (SELECT provider, CAST(zl AS INT) AS zl, CASE WHEN count(*) >= 32 THEN round(avg(bytes)/1000.0, 6) ELSE 13.0 END AS kb FROM chunks WHERE status = 0 GROUP BY ALL) "


def piece_kb(chunks: DataFrame, least: int = 32, default: float = 13.0) -> DataFrame:
    """Mean size of a piece by source and level, the default below ``least`` pieces."""
    mean = F.when(F.count("*") >= least, F.round(F.avg("bytes") / 1000.0, 6)).otherwise(default)
    return chunks.where("status = 0").groupBy("provider", "zl").agg(mean.alias("kb"))


@query(cte("chunks") + PIECES + "SELECT * FROM pieces")
def ag25_piece_kb(spark, sf_dir):
    return piece_kb(view(spark, sf_dir, "chunks"))


@query(cte("sites", "points", "chunks") + LEGS + CORRIDOR + SCENERY + PIECES + f""", need AS (SELECT DISTINCT tlat, tlon FROM corridor SEMI JOIN scenery USING (tlat, tlon)),
sized AS (SELECT tlat, tlon, (({TX.format(lon='(tlon+1)', e=6)}-{TX.format(lon='tlon', e=6)})//16+1)*(({TY.format(lat='tlat', e=6)}-{TY.format(lat='tlat+1', e=6)})//16+1) AS textures FROM need WHERE tlat BETWEEN -84 AND 83)
SELECT tlat, tlon, CAST(sum(textures) AS BIGINT) AS textures, CAST(sum(textures)*256 AS BIGINT) AS requests, round(sum(textures*256*(SELECT kb FROM pieces WHERE provider='BI'))/1000, 2) AS download_mb, CAST(grouping(tlat) AS INT) AS is_total FROM sized GROUP BY GROUPING SETS ((tlat, tlon), ())""")
def ag26_build_estimate(spark, sf_dir):
    """What flights along all legs need to build: by tile, and in total.

    Legs to great circles, to corridor tiles that have scenery, to textures, to pieces and megabytes.
    """
    need = corridor(spark, sf_dir).select("tlat", "tlon").distinct().join(scenery(spark, sf_dir), ["tlat", "tlon"], "left_semi").where("tlat BETWEEN -84 AND 83")
    x0, y0 = geo.texture_at(F.col("tlat") + 1, "tlon", ZL)
    x1, y1 = geo.texture_at("tlat", F.col("tlon") + 1, ZL)
    sized = need.withColumn("textures", (((x1 - x0) / 16 + 1) * ((y1 - y0) / 16 + 1)).cast("long"))
    kb = piece_kb(view(spark, sf_dir, "chunks")).where("provider = 'BI'").agg(F.max("kb").alias("kb"))  # one row
    sized = sized.join(F.broadcast(kb)).withColumn("mb", F.col("textures") * 256 * F.col("kb") / 1000)
    return sized.groupingSets([["tlat", "tlon"], []], "tlat", "tlon").agg(
        F.sum("textures").alias("textures"), (F.sum("textures") * 256).alias("requests"), F.round(F.sum("mb"), 2).alias("download_mb"), F.grouping("tlat").cast("int").alias("is_total"),
    )


assert math.isclose(geo.KM_PER_DEGREE, 111.1950797, rel_tol=1e-6)
