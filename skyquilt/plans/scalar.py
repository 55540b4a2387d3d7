"""Scalar functions over tables: addresses, geometry, classes, keys, arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..fixtures import cte, table, view
from ..functions import geo
from ..registry import query

NORTH = "ln(tan((90+lat)*pi()/360))/pi()"


@query(cte("points") + f"SELECT id, round((lon/180+1)*2^11, 6) AS x, round((1-{NORTH})*2^11, 6) AS y FROM points")
def sc1_tile_xy(spark, sf_dir):
    x, y = geo.tile_xy("lat", "lon", 12)
    return view(spark, sf_dir, "points").select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(cte("points") + f"SELECT id, CAST(round_even((lon/180+1)*2^19, 0) AS BIGINT)//256 AS x, CAST(round_even((1-{NORTH})*2^19, 0) AS BIGINT)//256 AS y FROM points")
def sc2_gtile(spark, sf_dir):
    x, y = geo.gtile("lat", "lon", 12)
    return view(spark, sf_dir, "points").select("id", x.alias("x"), y.alias("y"))


@query(cte("points") + f"SELECT id, CAST(trunc((lon/180+1)*2^11) AS BIGINT)*16 AS x, CAST(trunc((1-{NORTH})*2^11) AS BIGINT)*16 AS y FROM points")
def sc3_texture_at(spark, sf_dir):
    x, y = geo.texture_at("lat", "lon", 16)
    return view(spark, sf_dir, "points").select("id", x.alias("x"), y.alias("y"))


CORNER = "round(degrees(atan(sinh(pi()*(1-2*({y})/4096.0)))), 6)"


@query(cte("chunks") + f"SELECT DISTINCT x, y, {CORNER.format(y='y')} AS lat, round(x/4096.0*360-180, 6) AS lon FROM chunks")
def sc4_tile_corner(spark, sf_dir):
    lat, lon = geo.tile_corner("x", "y", "zl")
    return view(spark, sf_dir, "chunks").select("x", "y", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon")).distinct()


@query(cte("chunks") + f"""
SELECT DISTINCT x, y, {CORNER.format(y='y')} AS north, {CORNER.format(y='y+16')} AS south,
       round(x/4096.0*360-180, 6) AS west, round((x+16)/4096.0*360-180, 6) AS east, round(degrees(atan(sinh(pi()*(1-2*(y+8)/4096.0)))), 6) AS mid_lat
FROM (SELECT x//16*16 AS x, y//16*16 AS y FROM chunks)""")
def sc5_texture_bbox(spark, sf_dir):
    t = view(spark, sf_dir, "chunks").selectExpr("x - x % 16 AS x", "y - y % 16 AS y", "zl").distinct()
    mid, _ = geo.tile_corner(F.col("x") + 8, F.col("y") + 8, "zl")
    box = t.select("x", "y", geo.texture_bbox("x", "y", "zl").alias("b"), mid.alias("m"))
    return box.select("x", "y", *(F.round(f"b.{n}", 6).alias(n) for n in ("north", "south", "west", "east")), F.round("m", 6).alias("mid_lat"))


@query(cte("chunks") + """
SELECT DISTINCT x, y, list_aggregate([CAST(((x >> (12-i)) & 1) + 2*((y >> (12-i)) & 1) AS VARCHAR) for i in range(1, 13)], 'string_agg', '') AS quadkey, x AS back_x, y AS back_y FROM chunks""")
def sc6_quadkey(spark, sf_dir):
    key = view(spark, sf_dir, "chunks").select("x", "y", geo.quadkey("x", "y", "zl").alias("quadkey")).distinct()
    x, y = geo.quadkey_xy("quadkey")
    return key.select("*", x.alias("back_x"), y.alias("back_y"))


@query(cte("chunks") + """
SELECT DISTINCT y||'_'||x||'_'||code||zl AS name, y AS t_y, x AS t_x, code AS t_provider, CAST(zl AS INT) AS t_zl
FROM (SELECT x//16*16 AS x, y//16*16 AS y, provider||CASE WHEN o%2=0 THEN '18' ELSE '' END AS code, CASE WHEN o%2=0 AND ln%2=0 THEN 9 ELSE 14 END AS zl FROM chunks)""")
def sc7_texture_name(spark, sf_dir):
    t = view(spark, sf_dir, "chunks").selectExpr("x - x % 16 AS x", "y - y % 16 AS y", "concat(provider, CASE WHEN o%2=0 THEN '18' ELSE '' END) AS code", "CASE WHEN o%2=0 AND ln%2=0 THEN 9 ELSE 14 END AS zl")
    named = t.select(geo.texture_name("x", "y", "code", "zl").alias("name")).distinct()
    return named.withColumn("t", geo.parse_texture_name("name")).select("name", F.col("t.y").alias("t_y"), F.col("t.x").alias("t_x"), F.col("t.provider").alias("t_provider"), F.col("t.zl").alias("t_zl"))


@query(cte("chunks") + "SELECT DISTINCT x, y, x//8 AS px, y//8 AS py, x//64 AS fx, y//64 AS fy FROM chunks")
def sc8_parent_tile(spark, sf_dir):
    up = lambda v, n: F.shiftright(v, n)
    return view(spark, sf_dir, "chunks").select("x", "y", up("x", 3).alias("px"), up("y", 3).alias("py"), up("x", 6).alias("fx"), up("y", 6).alias("fy")).distinct()


@query(cte("points") + "SELECT id, round(2*pi()*6378137.0*cos(radians(lat))/2^(14+8), 5) AS metres FROM points")
def sc9_pixel_size_m(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", F.round(geo.pixel_size_m("lat", 14), 5).alias("metres"))


@query(cte("points") + f"""
SELECT id, round(greatest(0, least(1, (lon/180+1)*2^9 - tx)), 6) AS s, round(greatest(0, least(1, 1-((1-{NORTH})*2^9 - ty))), 6) AS t
FROM (SELECT *, floor((lon/180+1)*2^9) AS tx, floor((1-{NORTH})*2^9) AS ty FROM points)""")
def sc10_st_coord(spark, sf_dir):
    x, y = geo.texture_at("lat", "lon", 14)
    s, t = geo.st_coord("lat", "lon", "x", "y", 14)
    return view(spark, sf_dir, "points").withColumns({"x": x, "y": y}).select("id", F.round(s, 6).alias("s"), F.round(t, 6).alias("t"))


@query(cte("points") + f"""
SELECT id, px, py, round(degrees(atan(sinh(pi()*(1-2*py/2.0^22)))), 5) AS back_lat, round(px/2.0^22*360-180, 5) AS back_lon
FROM (SELECT id, CAST(round_even((lon/180+1)*2^21, 0) AS BIGINT) AS px, CAST(round_even((1-{NORTH})*2^21, 0) AS BIGINT) AS py FROM points)""")
def sc11_to_pixel(spark, sf_dir):
    px, py = geo.to_pixel("lat", "lon", 14)
    lat, lon = geo.pixel_to_latlon("px", "py", 14)
    return view(spark, sf_dir, "points").select("id", px.alias("px"), py.alias("py")).select("id", "px", "py", F.round(lat, 5).alias("back_lat"), F.round(lon, 5).alias("back_lon"))


HAV = "2*6371.0088*asin(least(1, sqrt(sin(radians({b}-{a})/2)^2 + cos(radians({a}))*cos(radians({b}))*sin(radians({d}-{c})/2)^2)))"


@query(cte("points") + f"SELECT id, CAST(round(1000*{HAV.format(a='lat', b='48.1', c='lon', d='11.5')}) AS BIGINT) AS metres FROM points")
def sc12_haversine(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", F.round(1000 * geo.haversine_km("lat", "lon", 48.1, 11.5)).cast("long").alias("metres"))


@query(cte("points") + """
SELECT id, round(b, 5) AS bearing, round(CASE WHEN abs(b-90) > 180 THEN 360-abs(b-90) ELSE abs(b-90) END, 5) AS off_east FROM (
 SELECT id, (degrees(atan2(sin(radians(11.5-lon))*cos(radians(48.1)), cos(radians(lat))*sin(radians(48.1))-sin(radians(lat))*cos(radians(48.1))*cos(radians(11.5-lon))))+360) % 360 AS b FROM points)""")
def sc13_bearing(spark, sf_dir):
    b = view(spark, sf_dir, "points").select("id", geo.bearing_deg("lat", "lon", 48.1, 11.5).alias("b"))
    return b.select("id", F.round("b", 5).alias("bearing"), F.round(geo.angle_diff("b", 90.0), 5).alias("off_east"))


@query(cte("points") + """
SELECT id, CAST((floor(lon)+400+180) % 360 - 180 AS BIGINT) AS wrapped, round(lon2 + CASE WHEN lon2-lon > 180 THEN -360 WHEN lon2-lon < -180 THEN 360 ELSE 0 END, 6) AS unwrapped
FROM (SELECT *, -lon AS lon2 FROM points)""")
def sc14_lon_wrap(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", geo.lon_wrap(F.floor("lon") + 400).cast("long").alias("wrapped"), F.round(geo.lon_unwrap("lon", -F.col("lon")), 6).alias("unwrapped"))


KMD = "(pi()*6371.0088/180)"


@query(cte("fixes") + f"""
SELECT event_id, round(lat + gs_ms*2*60/1000*cos(radians(agl_m/25))/{KMD}, 6) AS lat, round(lon + gs_ms*2*60/1000*sin(radians(agl_m/25))/({KMD}*greatest(0.01, cos(radians(lat)))), 6) AS lon FROM fixes""")
def sc15_dead_reckon(spark, sf_dir):
    lat, lon = geo.dead_reckon("lat", "lon", F.col("agl_m") / 25, "gs_ms", 2)
    return view(spark, sf_dir, "fixes").select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(cte("points") + "SELECT id, round(6378137.0*pi()/180, 4) AS per_lat, round(6378137.0*pi()/180*cos(radians(lat)), 4) AS per_lon, round(cos(radians(floor(lat)+0.5)), 8) AS scale_x FROM points")
def sc16_metres_per_degree(spark, sf_dir):
    a, b = geo.metres_per_degree("lat")
    return view(spark, sf_dir, "points").select("id", F.round(a, 4).alias("per_lat"), F.round(b, 4).alias("per_lon"), F.round(F.cos(F.radians(F.floor("lat") + 0.5)), 8).alias("scale_x"))


SIGNED = "CASE WHEN {v} < 0 THEN '-' ELSE '+' END || lpad(CAST(abs({v}) AS VARCHAR), {n}, '0')"


@query(cte("points") + f"""
SELECT id, {SIGNED.format(v='a', n=2)} || {SIGNED.format(v='b', n=3)} AS tile, CASE WHEN a < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(a) AS VARCHAR), 2, '0') || CASE WHEN b < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(b) AS VARCHAR), 3, '0') AS hemi,
  {SIGNED.format(v='ta', n=2)} || {SIGNED.format(v='tb', n=3)} AS block, a AS back_lat, b AS back_lon
FROM (SELECT id, CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS b, CAST(floor(lat/10)*10 AS INT) AS ta, CAST(floor(lon/10)*10 AS INT) AS tb FROM points)""")
def sc17_tile_name(spark, sf_dir):
    t = view(spark, sf_dir, "points").select("id", geo.tile_name("lat", "lon").alias("tile"), geo.hemisphere_name("lat", "lon").alias("hemi"), geo.ten_degree_name("lat", "lon").alias("block"))
    part = lambda i: F.regexp_extract("tile", r"^([+-]\d+)([+-]\d+)$", i).cast("int")
    return t.select("*", part(1).alias("back_lat"), part(2).alias("back_lon"))


@query(cte("points") + """
SELECT id, lpad(CAST(CAST(floor((lon+180)/6) AS INT)+1 AS VARCHAR), 2, '0') || substr('CDEFGHJKLMNPQRSTUVWX', CAST(floor((lat+80)/8) AS INT)+1, 1) AS zone FROM points""")
def sc18_relief_block(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", geo.grid_zone("lat", "lon").alias("zone"))


URL = "https://{switch:a, b,c}.tiles.test/{zoom}/{x}/{-y}/{quadkey}.jpg"


@query(cte("chunks") + """
SELECT DISTINCT x, y, 'https://' || (['a','b','c'])[(x+y)%3+1] || '.tiles.test/12/' || x || '/' || (4095-y) || '/' || list_aggregate([CAST(((x >> (12-i)) & 1) + 2*((y >> (12-i)) & 1) AS VARCHAR) for i in range(1, 13)], 'string_agg', '') || '.jpg' AS url FROM chunks""")
def sc19_tile_url(spark, sf_dir):
    t = view(spark, sf_dir, "chunks").select("x", "y", "zl").distinct()
    return t.select("x", "y", geo.tile_url(F.lit(URL), "x", "y", "zl").alias("url"))


@query(cte("points") + """
SELECT id, round(abs(d*1.5 - d*0.5*0)/2*2*cos(radians((4*lat+2*d)/4))*111195.0*111195.0/10000*0 + abs((lon+1.5-lon)*d)*cos(radians((4*lat+2*d)/4))*111195.0*111195.0/10000, 0) AS ha FROM (SELECT *, 0.5 + id%7/10.0 AS d FROM points)""")
def sc20_ring_area_ha(spark, sf_dir):
    d = F.lit(0.5) + (F.col("id") % 7) / 10.0
    ring = view(spark, sf_dir, "points").select("id", F.array("lat", "lat", F.col("lat") + d, F.col("lat") + d).alias("lats"), F.array(F.col("lon"), F.col("lon") + 1.5, F.col("lon") + 1.5, F.col("lon")).alias("lons"))
    return ring.select("id", F.round(geo.ring_area_ha("lats", "lons"), 0).alias("ha"))


@query(cte("triangles", "nodes") + """
SELECT t.v1, t.n, round(abs((b.x-a.x)*(c.y-a.y)-(c.x-a.x)*(b.y-a.y))/2*(pi()*6378137.0/180)^2*cos(radians((a.y+b.y+c.y)/3)), 0) AS m2
FROM triangles t JOIN nodes a ON a.id=t.v1 JOIN nodes b ON b.id=t.v2 JOIN nodes c ON c.id=t.v3""")
def sc21_triangle_area(spark, sf_dir):
    from .mesh import corners

    return corners(spark, sf_dir).select("v1", "n", F.round(geo.triangle_area_m2("y1", "x1", "y2", "x2", "y3", "x3"), 0).alias("m2"))


SUN = "degrees(asin(greatest(-1, least(1, sin(radians(lat))*sin(radians(-23.44*cos(radians(360/365.0*(day+10))))) + cos(radians(lat))*cos(radians(-23.44*cos(radians(360/365.0*(day+10)))))*cos(radians(15*({h}-12)))))))"


@query(cte("points") + f"SELECT id, round({SUN.format(h='solar')}, 5) AS height, least({SUN.format(h='solar')}, {SUN.format(h='solar+1')}, {SUN.format(h='(solar-2)')}) < 0 AS night FROM (SELECT *, id%365+1 AS day, id%24 AS solar FROM points)")
def sc22_sun_height(spark, sf_dir):
    p = view(spark, sf_dir, "points").selectExpr("*", "id%365+1 AS day", "id%24 AS solar")
    return p.select("id", F.round(geo.sun_height("day", "solar", "lat"), 5).alias("height"), geo.is_night("day", "solar", "lat", 1.0, 2.0).alias("night"))


@query(cte("points") + """
SELECT id, CASE WHEN abs(lat) < 23.44 THEN 'summer' ELSE (['spring','summer','autumn','winter'])[(CASE WHEN md >= 320 AND md < 621 THEN 0 WHEN md >= 621 AND md < 923 THEN 1 WHEN md >= 923 AND md < 1221 THEN 2 ELSE 3 END + CASE WHEN lat < 0 THEN 2 ELSE 0 END) % 4 + 1] END AS season
FROM (SELECT id, lat, month(d)*100+day(d) AS md FROM (SELECT *, DATE '2023-01-01' + CAST(id%365 AS INT) AS d FROM points))""")
def sc23_season_on(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", geo.season_on(F.col("id") % 365 + 1, "lat", 2023).alias("season"))


@query(cte("points") + """
SELECT id, name, CASE WHEN name IS NOT NULL THEN s < 100 AND s%10 = 9 END AS rural FROM (SELECT id, s, CASE WHEN s//10 IN (10, 11) THEN 'motorway' WHEN s//10 = 12 THEN 'motorway_link' WHEN s//10 IN (1, 2) THEN 'primary' WHEN s//10 IN (3, 4) THEN 'secondary' WHEN s//10 IN (5, 6, 7) THEN 'residential' END AS name FROM (SELECT id, id%230 AS s FROM points))""")
def sc24_road_class(spark, sf_dir):
    return view(spark, sf_dir, "points").select("id", geo.road_class(F.col("id") % 230).alias("r")).select("id", "r.name", "r.rural")


@query(cte("points") + """
SELECT id, CAST(CASE WHEN f <= 0 AND d <= 13.6*1.11*k THEN 0 WHEN f <= 1 AND d <= 23.7*1.11*k THEN 1 WHEN f <= 2 AND d <= 42.9*1.11*k THEN 2 WHEN f <= 3 AND d <= 81.4*1.11*k THEN 3 ELSE 4 END AS INT) AS level, CAST(greatest(-1, least(4, z-16)) AS INT) AS top
FROM (SELECT id, id%100*1.0 AS d, id%4 AS f, 14+id%5 AS z, 2.0^(16-(14+id%5)) AS k FROM points)""")
def sc25_top_level(spark, sf_dir):
    p = view(spark, sf_dir, "points").selectExpr("id", "double(id%100) AS d", "id%4 AS f", "int(14+id%5) AS z")
    return p.select("id", geo.top_level_for("d", "z", "f").alias("level"), geo.file_top("z", 16).cast("int").alias("top"))


@query(cte("points") + "SELECT id, round(CASE WHEN fov BETWEEN 1 AND 170 AND w > 0 THEN least(4, greatest(1, w/2704.0*tan(radians(32.5))/tan(radians(fov/2.0)))) ELSE 1 END, 6) AS scale FROM (SELECT id, id%50*100 AS w, id%180 AS fov FROM points)")
def sc26_screen_scale(spark, sf_dir):
    p = view(spark, sf_dir, "points").selectExpr("id", "double(id%50*100) AS w", "double(id%180) AS fov")
    return p.select("id", F.round(geo.screen_scale("w", "fov"), 6).alias("scale"))


@query(cte("fixes") + """
SELECT event_id, round(max(greatest(0, CASE WHEN h < r THEN a + sqrt(r*r-h*h) - r*1.11 ELSE 0 END)), 5) AS reach
FROM (SELECT event_id, gs_ms/10 AS a, agl_m/100 AS h FROM fixes), (VALUES (81.4*1.5), (42.9*1.5), (23.7*1.5), (13.6*1.5)) v(r) GROUP BY event_id""")
def sc27_reach_needed(spark, sf_dir):
    return view(spark, sf_dir, "fixes").select("event_id", F.round(geo.reach_needed(F.col("gs_ms") / 10, F.col("agl_m") / 100, 1.5), 5).alias("reach"))


@query(cte("points") + """
SELECT id, CAST(((side+3)//4)*((side+3)//4)*16 AS BIGINT) AS level_bytes, CAST(ceil((128 + (SELECT sum(((greatest(1, side // CAST(2^k AS BIGINT))+3)//4)*((greatest(1, side // CAST(2^k AS BIGINT))+3)//4)*16) FROM range(0, CAST(log2(side) AS INT)+1) t(k))) / 4096.0)*4096 AS BIGINT) AS file_bytes
FROM (SELECT id, CAST(2^(id%13) AS BIGINT) AS side FROM points)""")
def sc28_level_size(spark, sf_dir):
    p = view(spark, sf_dir, "points").select("id", F.pow(F.lit(2.0), F.col("id") % 13).alias("side"))
    return p.select("id", geo.level_bytes("side").alias("level_bytes"), geo.file_bytes("side").alias("file_bytes"))


@query(cte("triangles") + "SELECT v1, n, CAST(CASE WHEN attr & 7 = 0 THEN 0 WHEN attr & 7 > 1 THEN 2 ELSE 1 END AS INT) AS new_type, CAST(CASE WHEN attr & 3 = 0 THEN 0 WHEN attr & 3 > 1 THEN 2 ELSE 1 END AS INT) AS old_type FROM triangles")
def sc29_triangle_type(spark, sf_dir):
    return view(spark, sf_dir, "triangles").select("v1", "n", geo.triangle_type("attr").alias("new_type"), geo.triangle_type("attr", 3).alias("old_type"))


@query(cte("triangles") + "SELECT v1, n, CASE WHEN a%10=0 THEN 'skip' WHEN a >= 8 THEN 'interp' WHEN a&2 > 0 THEN 'sea' WHEN a&5 > 0 THEN 'water' ELSE 'land' END AS class FROM (SELECT v1, n, attr*(1+v1%4) AS a FROM triangles)")
def sc30_classify_triangle(spark, sf_dir):
    return view(spark, sf_dir, "triangles").select("v1", "n", geo.classify_triangle(F.expr("attr*(1+v1%4)")).alias("class"))


@query(cte("raster") + "SELECT r, c, CAST(CASE WHEN c%7=0 THEN 0 ELSE trunc(65535*greatest(0.1::DOUBLE, least(1.0::DOUBLE, 10*0.5::DOUBLE*(CAST(alt AS INT) & 255)/255.0::DOUBLE))) END AS INT) AS depth FROM raster WHERE alt > -32768")
def sc31_depth_ratio(spark, sf_dir):
    d = view(spark, sf_dir, "raster").where("alt > -32768").selectExpr("r", "c", "int(alt) & 255 AS b", "c%7=0 AS coast")
    return d.select("r", "c", geo.depth_ratio("b", "coast", 0.5).alias("depth"))


@query(cte("points") + """
SELECT id, CAST(qx AS BIGINT) AS qx, CAST(qy AS BIGINT) AS qy, CAST((SELECT sum((((qx >> i) & 1) << (2*i)) + (((qy >> i) & 1) << (2*i+1))) FROM range(0, 24) t(i)) AS BIGINT) AS code
FROM (SELECT id, CAST(floor((lon+180)/360*16777215) AS BIGINT) AS qx, CAST(floor((lat+90)/180*16777215) AS BIGINT) AS qy FROM points)""")
def sc32_morton(spark, sf_dir):
    q = view(spark, sf_dir, "points").select("id", geo.quantize24("lon", -180.0, 180.0).alias("qx"), geo.quantize24("lat", -90.0, 90.0).alias("qy"))
    return q.select("*", geo.morton("qx", "qy").alias("code"))


RGB = "SELECT r AS row, c AS col, CAST(alt AS INT)%256 AS cr, (CAST(alt AS INT)*7)%256 AS cg, (CAST(alt AS INT)*13)%256 AS cb FROM raster WHERE alt > -32768"


def _rgb(spark, sf_dir):
    return view(spark, sf_dir, "raster").where("alt > -32768").selectExpr("r AS row", "c AS col", "double(int(alt)%256) AS cr", "double((int(alt)*7)%256) AS cg", "double((int(alt)*13)%256) AS cb")


def _byte(v):
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(v))).cast("int")


@query(cte("raster") + f"""
SELECT row, col, {', '.join(f"CAST(greatest(0, least(255, round_even(g + (v{n} - g)*1.3, 0))) AS INT) AS {n}" for n in 'rgb')}
FROM (SELECT row, col, vr, vg, vb, 0.299*vr+0.587*vg+0.114*vb AS g FROM (SELECT row, col, {', '.join(f"(c{n}*1.1 - 127.5)*1.2 + 127.5 AS v{n}" for n in 'rgb')} FROM (SELECT row, col, cr::DOUBLE AS cr, cg::DOUBLE AS cg, cb::DOUBLE AS cb FROM ({RGB}))))""")
def sc33_adjust_photo(spark, sf_dir):
    """Brightness, contrast round the middle, saturation round the luma."""
    p = _rgb(spark, sf_dir).select("row", "col", *(((F.col(f"c{n}") * 1.1 - 127.5) * 1.2 + 127.5).alias(f"v{n}") for n in "rgb"))
    p = p.withColumn("g", 0.299 * F.col("vr") + 0.587 * F.col("vg") + 0.114 * F.col("vb"))
    return p.select("row", "col", *(_byte(F.col("g") + (F.col(f"v{n}") - F.col("g")) * 1.3).alias(n) for n in "rgb"))


@query(cte("raster") + f"""
SELECT row, col, {', '.join(f"CAST(greatest(0, least(255, round_even(v{n} + green*0.5*(v{n} - g), 0))) AS INT) AS {n}" for n in 'rgb')}
FROM (SELECT *, 0.299*vr+0.587*vg+0.114*vb AS g FROM (SELECT row, col, greatest(0, least(1, (cg - greatest(cr, cb))/64.0)) AS green, cr*1.06 AS vr, cg*1.0 AS vg, cb*0.94 AS vb FROM (SELECT row, col, cr::DOUBLE AS cr, cg::DOUBLE AS cg, cb::DOUBLE AS cb FROM ({RGB}))))""")
def sc34_season_look(spark, sf_dir):
    """Warmth on red and blue, then green made fresher by how green the pixel is."""
    p = _rgb(spark, sf_dir)
    green = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cg") - F.greatest("cr", "cb")) / 64.0))
    p = p.select("row", "col", green.alias("green"), (F.col("cr") * 1.06).alias("vr"), F.col("cg").alias("vg"), (F.col("cb") * 0.94).alias("vb"))
    p = p.withColumn("g", 0.299 * F.col("vr") + 0.587 * F.col("vg") + 0.114 * F.col("vb"))
    return p.select("row", "col", *(_byte(F.col(f"v{n}") + F.col("green") * 0.5 * (F.col(f"v{n}") - F.col("g"))).alias(n) for n in "rgb"))


@query(cte("pixels") + "SELECT cloud, px, CAST(CASE WHEN here BETWEEN 1 AND 254 AND (src*3 >= 735 OR src*3 <= 35) THEN 0 ELSE here END AS INT) AS mask FROM pixels")
def sc35_clean_halo(spark, sf_dir):
    white_or_black = (F.col("src") * 3 >= 735) | (F.col("src") * 3 <= 35)
    return view(spark, sf_dir, "pixels").select("cloud", "px", F.when(F.col("here").between(1, 254) & white_or_black, 0).otherwise(F.col("here")).alias("mask"))


@query(cte("raster") + "SELECT r, c, CAST(floor(255*CASE c%3 WHEN 0 THEN (1-t) WHEN 1 THEN (1-t)*(1-t) ELSE power(1-t, 0.6) END) AS INT) AS value FROM (SELECT r, c, (CAST(alt AS INT)%100)/100.0::DOUBLE AS t FROM raster WHERE alt > -32768)")
def sc36_transition_value(spark, sf_dir):
    p = view(spark, sf_dir, "raster").where("alt > -32768").selectExpr("r", "c", "1 - (int(alt)%100)/100D AS u")
    curve = F.when(F.col("c") % 3 == 0, F.col("u")).when(F.col("c") % 3 == 1, F.col("u") * F.col("u")).otherwise(F.pow("u", F.lit(0.6)))
    return p.select("r", "c", F.floor(255 * curve).cast("int").alias("value"))


@query("""
SELECT page_id, CASE WHEN lower(substr(url, 1, 5)) = 'http:' AND page_id%2=0 THEN 'header' WHEN sha256(html) = sha256('') THEN 'hash' WHEN strlen(html)%50 = 7 THEN 'size' END AS signal FROM pages""")
def sc39_is_placeholder(spark, sf_dir):
    """A header is decisive, a body's hash exact, its size the last resort."""
    p = table(spark, sf_dir, "pages").withColumn("headers", F.create_map(F.lit("X-Scheme"), F.when(F.col("page_id") % 2 == 0, F.substring("url", 1, 5)).otherwise("")))
    lower = F.transform_keys("headers", lambda k, v: F.lower(k))
    tests = [F.when(F.lower(lower["x-scheme"]) == "http:", "header"), F.when(F.sha2("html", 256) == F.sha2(F.lit(""), 256), "hash"), F.when(F.octet_length("html") % 50 == 7, "size")]
    return p.select("page_id", F.coalesce(*tests).alias("signal"))


@query(cte("transfers") + "SELECT event_id, CASE WHEN code >= 500 THEN 'error' WHEN kind = 'text/html' THEN 'refused' WHEN bytes = 0 THEN 'missing' ELSE 'ok' END AS answer FROM (SELECT *, CASE WHEN event_id%9=0 THEN 'text/html' ELSE 'image/jpeg' END AS kind FROM transfers)")
def sc40_classify_answer(spark, sf_dir):
    t = view(spark, sf_dir, "transfers").withColumn("type", F.when(F.col("event_id") % 9 == 0, "text/html; charset=utf-8").otherwise("image/jpeg"))
    kind = F.lower(F.trim(F.split("type", ";")[0]))
    return t.select("event_id", F.when(F.col("code") >= 500, "error").when(~kind.startswith("image/"), "refused").when(F.col("bytes") == 0, "missing").otherwise("ok").alias("answer"))


@query(cte("artifacts") + """SELECT key, sha256('{"inputs":["' || (key//3) || '"],"params":' || params || ',"rule":"' || rule || '","version":' || version || '}') AS content_key FROM artifacts""")
def sc41_canonical_key(spark, sf_dir):
    """SHA-256 of the recipe as JSON with sorted names."""
    recipe = F.struct(F.array(F.expr("string(key div 3)")).alias("inputs"), F.col("params"), F.col("rule"), F.col("version"))
    return view(spark, sf_dir, "artifacts").select("key", F.sha2(F.to_json(recipe), 256).alias("content_key"))


def group_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each brand's digests joined; rows come sorted by brand, so one hash state is held."""
    now, state = None, None
    for batch in batches:
        brands, own = batch["brand"].to_pylist(), batch["d"].to_pylist()
        out = []
        for brand, d in zip(brands, own):
            if state is None or brand != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = brand, hashlib.sha256()
            state.update(d.encode())
        if out:
            yield pa.RecordBatch.from_pydict({"brand": pa.array([b for b, _ in out], pa.string()), "digest": [h for _, h in out]})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"brand": pa.array([now], pa.string()), "digest": [state.hexdigest()]})


@query(cte("tags") + "SELECT brand, sha256(string_agg(h, '' ORDER BY lot)) AS digest FROM (SELECT brand, substr(d, 1, 2) AS lot, sha256(string_agg(d, '' ORDER BY d)) AS h FROM (SELECT brand, sha256(id || '|' || type || '|' || size) AS d FROM tags) GROUP BY ALL) GROUP BY brand")
def sc42_element_digest(spark, sf_dir):
    """A digest that does not depend on the order of elements.

    A group's digests are cut into 256 lots by how they begin, sorted, which spills, and hashed as they pass; then the
    lots' digests are, so no task hashes all elements of a large group.
    """
    one = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "type", "size"), 256)
    d = view(spark, sf_dir, "tags").select("brand", one.alias("d")).select(F.concat(F.substring("d", 1, 2), "brand").alias("brand"), "d")
    lots = d.repartition("brand").sortWithinPartitions("brand", "d").mapInArrow(group_digests, "brand string, digest string")
    own = lots.select(F.expr("substring(brand, 3)").alias("brand"), F.substring("brand", 1, 2).alias("lot"), F.col("digest").alias("d"))
    return own.repartition("brand").sortWithinPartitions("brand", "lot").select("brand", "d").mapInArrow(group_digests, "brand string, digest string")


@query(cte("tags") + "SELECT id, CASE id%3 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' ELSE 'node' END AS kind, 'brand' AS key, CASE WHEN id%2=0 THEN brand ELSE '' END AS value FROM tags")
def sc43_selector_tag(spark, sf_dir):
    kind = F.expr("CASE id%3 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' ELSE 'node' END")
    text = F.when(F.col("id") % 2 == 0, F.concat(kind, F.lit('["brand"="'), F.col("brand"), F.lit('"]'))).otherwise(F.concat(kind, F.lit('["brand"]')))
    pattern = r'^(\w+)\["([^"]+)"(?:="([^"]*)")?\]$'
    return view(spark, sf_dir, "tags").withColumn("s", text).select("id", *(F.regexp_extract("s", pattern, i + 1).alias(n) for i, n in enumerate(("kind", "key", "value"))))


@query(cte("fixes") + f"SELECT event_id, round(lat - (event_id%500-250)/({KMD}*1000), 7) AS lat, round(lon + (event_id%300)/({KMD}*1000*greatest(0.01, cos(radians(lat)))), 7) AS lon FROM fixes")
def sc45_camera_position(spark, sf_dir):
    lat, lon = geo.camera_position("lat", "lon", F.col("event_id") % 300, F.col("event_id") % 500 - 250)
    return view(spark, sf_dir, "fixes").select("event_id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query(cte("points") + "SELECT id, round(lat-0.5, 4) AS south, round(lon-0.25, 4) AS west, round(lat+0.75, 4) AS north, round(lon+1, 4) AS east FROM points")
def ar7_bounds(spark, sf_dir):
    ring = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.col("lat") + F.when(i == 0, -0.5).when(i == 1, 0.75).otherwise(0.0)).alias("lat"), (F.col("lon") + F.when(i == 2, -0.25).when(i == 3, 1.0).otherwise(0.0)).alias("lon")))
    p = view(spark, sf_dir, "points").withColumn("ring", ring)
    at = lambda f, n: F.round(f(F.transform("ring", lambda v: v[n])), 4)
    return p.select("id", at(F.array_min, "lat").alias("south"), at(F.array_min, "lon").alias("west"), at(F.array_max, "lat").alias("north"), at(F.array_max, "lon").alias("east"))


@query(cte("triangles") + "SELECT v1, n, array_to_string(list_filter([CASE WHEN m&1>0 THEN 'DUMMY' END, CASE WHEN m&2>0 THEN 'WATER' END, CASE WHEN m&4>0 THEN 'SEA' END, CASE WHEN m&8>0 THEN 'RUNWAY' END], lambda x: x IS NOT NULL), ',') AS flags FROM (SELECT v1, n, v1%16 AS m FROM triangles)")
def ar16_decode_flags(spark, sf_dir):
    names = ("DUMMY", "WATER", "SEA", "RUNWAY")
    mark = F.expr("v1%16")
    flags = F.array_compact(F.array(*(F.when(mark.bitwiseAND(F.lit(1 << i).cast("long")) != 0, n) for i, n in enumerate(names))))
    return view(spark, sf_dir, "triangles").select("v1", "n", F.array_join(flags, ",").alias("flags"))
