"""Streaming jobs run to the end over staged tables; where SQL can say the same, it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, table, view
from ..functions import geo, tables
from ..plans.planning import STEP_KM, legs
from ..registry import ORACLES, query
from . import jobs

F_ = cte("fixes")
COLUMNS = ["ts", "event_id", "lat", "lon", "gs_ms", "agl_m", "vs_ms"]
W = "PARTITION BY aircraft ORDER BY ts, event_id"
HAV = "2*6371.0088*asin(least(1, sqrt(sin(radians(lat-la)/2)^2 + cos(radians(la))*cos(radians(lat))*sin(radians(lon-lo)/2)^2)))"
LAG = f", p AS (SELECT *, lag(lat) OVER ({W}) AS la, lag(lon) OVER ({W}) AS lo, epoch(ts) - epoch(lag(ts) OVER ({W})) AS dt FROM fixes) "


def fixes(spark, sf_dir):
    return view(spark, sf_dir, "fixes").withColumn("ts", F.col("ts").cast("timestamp"))


def fix_stream(spark, sf_dir):
    return jobs.stream_of(fixes(spark, sf_dir), "fixes")


def machine(spark, sf_dir, step, schema, silent=None):
    return jobs.drained(jobs.stateful(fix_stream(spark, sf_dir), step, "aircraft long, event_id long, " + schema, COLUMNS, silent), step.__name__)


# Ten points a route, along the band in which its aircraft's fixes lie; one aircraft in ten has none.
VIEWS["routes"] = (
    "customer",
    [
        "CAST(floor(c_custkey/10) AS BIGINT) AS aircraft", "c_custkey%10 AS seq", "CAST((floor(c_custkey/10)*37)%100 AS DOUBLE)-50e0 + (c_custkey%10)*0.2e0 + ((c_custkey*7)%3)*0.1e0 AS lat",
        "CAST((floor(c_custkey/10)*71)%340 AS DOUBLE)-170e0 + (c_custkey%10)*0.3e0 AS lon",
    ],
)
AHEAD_KM = 90.0


#: Each fix's nearest leg (ok), and the points ahead of it with the part of the way to each that is taken (e).
ON_ROUTE = f""", leg AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM routes WHERE aircraft%10 <> 7 WINDOW w AS (PARTITION BY aircraft ORDER BY seq)),
f AS (SELECT aircraft, event_id, lat, lon, (event_id*47)%360 AS track, gs_ms, cos(radians(lat))*{geo.KM_PER_DEGREE!r} AS kx, {geo.KM_PER_DEGREE!r} AS ky FROM fixes),
v AS (SELECT f.*, seq, (l.lon-f.lon)*kx AS ax, (l.lat-f.lat)*ky AS ay, (lon2-l.lon)*kx AS dx, (lat2-l.lat)*ky AS dy, l.lat AS alat, l.lon AS alon, lat2-l.lat AS dlat, lon2-l.lon AS dlon FROM f JOIN leg l ON l.aircraft = f.aircraft AND lat2 IS NOT NULL),
t AS (SELECT *, greatest(0, least(1, -(ax*dx+ay*dy)/(dx*dx+dy*dy))) AS t FROM v), n AS (SELECT *, round(sqrt((ax+t*dx)^2+(ay+t*dy)^2), 6) AS d FROM t QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(sqrt((ax+t*dx)^2+(ay+t*dy)^2), 6), seq) = 1),
ok AS (SELECT *, (alon+t*dlon-lon)*kx AS hx, (alat+t*dlat-lat)*ky AS hy FROM n WHERE d <= {jobs.ROUTE_KM} AND NOT coalesce(gs_ms >= 25 AND abs((track-degrees(atan2(dx, dy))+180+360)%360-180) > {jobs.WRONG_WAY_DEG}, false)),
a AS (SELECT o.event_id, o.seq AS leg, o.d, r.seq AS k, r.lat, r.lon, coalesce(lag(r.lat) OVER w, alat+t*dlat) AS plat, coalesce(lag(r.lon) OVER w, alon+t*dlon) AS plon, kx, ky FROM ok o JOIN routes r ON r.aircraft = o.aircraft AND r.seq > o.seq WINDOW w AS (PARTITION BY event_id ORDER BY r.seq)),
s AS (SELECT *, sqrt(((lon-plon)*kx)^2+((lat-plat)*ky)^2) AS step FROM a), c AS (SELECT *, sum(step) OVER (PARTITION BY event_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM s),
e AS (SELECT *, CASE WHEN upto >= {AHEAD_KM} THEN ({AHEAD_KM}-upto+step)/step ELSE 1 END AS part FROM c WHERE upto - step < {AHEAD_KM})"""


def routes(spark, sf_dir):
    """(aircraft, points, seqs): a row a route, with its points' numbers; a route may lack some."""
    r = view(spark, sf_dir, "routes").where("aircraft%10 <> 7")
    p = r.groupBy("aircraft").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("p"))
    return p.selectExpr("aircraft", "transform(p, q -> named_struct('lat', q.lat, 'lon', q.lon)) AS points", "transform(p, q -> int(q.seq)) AS seqs")


def tracked(spark, sf_dir):
    """Fixes as a stream with a track; a slow aircraft's says nothing."""
    return fix_stream(spark, sf_dir).selectExpr("aircraft", "event_id", "lat", "lon", f"CASE WHEN gs_ms >= {jobs.MOVING_MS} THEN double((event_id*47)%360) END AS track")


INDEX = ", idx AS (SELECT CAST(floor(lat) AS BIGINT) AS tlat, CAST(floor(lon) AS BIGINT) AS tlon, 't'||min(id) AS name, CAST(min(id)%7 AS INT) AS level FROM points GROUP BY 1, 2) "


@query(cte("fixes", "routes", "points") + ON_ROUTE + INDEX + f""", pl AS (SELECT aircraft, event_id, lat, lon FROM fixes UNION ALL SELECT aircraft, event_id, alat+t*dlat, alon+t*dlon FROM ok UNION ALL SELECT aircraft, event_id, plat+part*(e.lat-plat), plon+part*(e.lon-plon) FROM e JOIN fixes USING (event_id)),
j AS (SELECT aircraft, event_id, name, level, min(2*6371.0088*asin(least(1, sqrt(sin(radians(tlat+0.5e0-lat)/2)^2 + cos(radians(lat))*cos(radians(tlat+0.5e0))*sin(radians(tlon+0.5e0-lon)/2)^2)))) AS km FROM pl JOIN idx ON abs(tlat+0.5e0-lat) <= 3 AND (abs(tlon+0.5e0-lon) <= 6 OR abs(tlon+0.5e0-lon) >= 354) GROUP BY ALL),
w AS (SELECT *, CAST(CASE WHEN km <= 13.6*1.11 THEN 0 WHEN km <= 23.7*1.11 THEN 1 WHEN km <= 42.9*1.11 THEN 2 WHEN km <= 81.4*1.11 THEN 3 ELSE 4 END AS INT) AS want FROM j WHERE km <= 300)
SELECT aircraft, event_id, name, want, round(km, 3) AS km, round(km - CASE want WHEN 0 THEN 13.6e0*1.11e0 WHEN 1 THEN 23.7e0*1.11e0 WHEN 2 THEN 42.9e0*1.11e0 WHEN 3 THEN 81.4e0*1.11e0 ELSE {geo.LOAD_KM}e0 END, 3) AS urgency FROM w WHERE want < level""")
def sm1_plan_stream(spark, sf_dir):
    """Fixes and the routes ahead of them against an index of one texture a square, as its middle; 64,800 at most, so it goes to every task."""
    p = view(spark, sf_dir, "points").groupBy(F.floor("lat").alias("tlat"), F.floor("lon").alias("tlon")).agg(F.min("id").alias("id"))
    index = p.select("tlat", "tlon", F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.expr("int(id%7)").alias("level"), (F.col("tlat") + 0.5).alias("ty"), (F.col("tlon") + 0.5).alias("tx"))
    f = jobs.follow_route(tracked(spark, sf_dir), routes(spark, sf_dir).drop("seqs"), AHEAD_KM)
    own = F.array(F.struct("lat", "lon"))
    return jobs.drained(jobs.level_work(f.withColumn("places", F.concat(own, F.coalesce("ahead", F.slice(own, 1, 0)))), F.broadcast(index)), "plan")


# One row a step: the window of an aircraft's next fix follows from its last.
@query("WITH RECURSIVE " + F_.removeprefix("WITH ") + f""", o AS (SELECT aircraft, event_id, lat, lon, row_number() OVER ({W}) AS n FROM fixes),
r(aircraft, n, event_id, col, tilerow, moved) AS (SELECT aircraft, n, event_id, CAST(floor(lon+0.5e0) AS BIGINT), CAST(floor(lat) AS BIGINT), true FROM o WHERE n = 1 UNION ALL
 SELECT aircraft, n, event_id, c, t, c <> col OR t <> tilerow FROM (SELECT o.aircraft, o.n, o.event_id, r.col, r.tilerow, abs(lon-col) > 2 OR abs(lat-tilerow-0.5e0) > 2 AS far,
  CAST(CASE WHEN far THEN floor(lon+0.5e0) ELSE col + greatest(0, ceil(lon-col-0.65e0)) - greatest(0, ceil(col-0.65e0-lon)) END AS BIGINT) AS c,
  CAST(CASE WHEN far THEN floor(lat) ELSE tilerow + greatest(0, ceil(lat-tilerow-1.1e0)) - greatest(0, ceil(tilerow-0.1e0-lat)) END AS BIGINT) AS t FROM r JOIN o ON o.aircraft = r.aircraft AND o.n = r.n + 1))
SELECT aircraft, event_id, col, tilerow AS row FROM r WHERE moved""")
def sm2_track_window(spark, sf_dir):
    return machine(spark, sf_dir, jobs.track_window, "col long, row long")


@query(F_ + LAG + f"SELECT aircraft, event_id, round({HAV}, 3) AS km FROM p WHERE la IS NOT NULL AND {HAV} > 20")
def sm3_jumps(spark, sf_dir):
    return machine(spark, sf_dir, jobs.jump, "km double")


BEARING = "(degrees(atan2(sin(radians(lon-lo))*cos(radians(lat)), cos(radians(la))*sin(radians(lat))-sin(radians(la))*cos(radians(lat))*cos(radians(lon-lo))))+360) % 360"


@query(F_ + LAG + f"SELECT aircraft, event_id, round({HAV}*1000/dt, 4) AS speed, round({BEARING}, 3) AS track FROM p WHERE gs_ms <= 25 AND dt >= 0.5e0 AND {HAV}*1000/dt > 25 AND {HAV}*1000/dt < 1000")
def sm4_motion(spark, sf_dir):
    return machine(spark, sf_dir, jobs.motion, "speed double, track double")


@query(F_ + f""", e AS (SELECT *, CASE WHEN agl_m/0.3048e0 > 18500 AND ahead > 270 THEN true WHEN agl_m/0.3048e0 < 17500 OR ahead < 180 THEN false END AS s FROM (SELECT *, CASE WHEN vs_ms < -1 THEN (agl_m-3962.4e0)/-vs_ms ELSE 1e308 END AS ahead FROM fixes)), c AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), false) AS onn FROM e)
SELECT aircraft, event_id, onn AS cruising FROM (SELECT *, coalesce(lag(onn) OVER ({W}), false) AS was FROM c) WHERE onn <> was""")
def sm5_cruise_state(spark, sf_dir):
    return machine(spark, sf_dir, jobs.cruise, "cruising boolean")


def transfers(spark, sf_dir):
    t = view(spark, sf_dir, "transfers").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.stream_of(t, "transfers").withWatermark("ts", jobs.WATERMARK)


@query(cte("transfers") + "SELECT CAST(h AS TIMESTAMP) AS start, sum(bytes) AS bytes, count(*) AS n FROM (SELECT bytes, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS h FROM transfers) GROUP BY 1")
def sm6_rate(spark, sf_dir):
    """Sliding windows, three times as long as their slide."""
    w = transfers(spark, sf_dir).groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return jobs.drained(w.select(F.col("window.start").alias("start"), "bytes", "n"), "rate", "complete")


PAST = "(SELECT epoch_ms(max(ts)) - 10000 FROM fixes)"


@query(F_ + LAG + f"SELECT aircraft, event_id, round(dt, 3) AS silent_s FROM p WHERE dt > 3600 UNION ALL SELECT aircraft, event_id, NULL::DOUBLE FROM (SELECT *, lead(ts) OVER ({W}) AS nxt FROM fixes) WHERE nxt IS NULL AND epoch_ms(ts) + 3600000 < {PAST}")
def sm7_stall(spark, sf_dir):
    return machine(spark, sf_dir, jobs.stalled, "silent_s double", jobs.still_silent)


@query(F_ + "SELECT CAST(floor(lat) AS BIGINT) AS tlat, CAST(floor(lon) AS BIGINT) AS tlon, max(ts) AS seen, count(*) AS n FROM fixes GROUP BY 1, 2")
def sm9_seen_state(spark, sf_dir):
    s = fix_stream(spark, sf_dir).groupBy(F.floor("lat").alias("tlat"), F.floor("lon").alias("tlon")).agg(F.max("ts").alias("seen"), F.count("*").alias("n"))
    return jobs.drained(s, "seen", "complete")


@query(cte("loads") + """, g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 3600000000 AND lag(event_type) OVER w <> 'error' THEN 0 ELSE 1 END AS fresh FROM loads WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT run, k, min(ts) FILTER (event_type <> 'error') AS start, max(ts) AS till, count(*) FILTER (event_type <> 'error') AS n, bool_or(event_type = 'error') AS mark, k = max(k) OVER (PARTITION BY run) AS final FROM s GROUP BY run, k)
SELECT run, start, n, CASE WHEN mark THEN 'mark' ELSE 'silence' END AS how FROM c WHERE n > 0 AND (mark OR NOT final OR epoch_ms(till) + 3600000 <= (SELECT epoch_ms(max(ts)) - 10000 FROM loads))""")
def sm10_load_sessions(spark, sf_dir):
    """Loads as sessions that an end mark or an hour's silence closes; what is still open is not told yet."""
    l = view(spark, sf_dir, "loads").select(F.col("run").alias("aircraft"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    s = jobs.stateful(jobs.stream_of(l, "loads"), jobs.load_session, "aircraft long, start timestamp, n long, how string", ["ts", "event_type"], jobs.no_more_loads)
    return jobs.drained(s, "sessions").withColumnRenamed("aircraft", "run")


@query(cte("fixes", "routes") + ON_ROUTE + """, z AS (SELECT event_id, min(leg) AS leg, min(d) AS d, count(*)+1 AS points, arg_max(plat+part*(lat-plat), k) AS elat, arg_max(plon+part*(lon-plon), k) AS elon FROM e GROUP BY event_id)
SELECT aircraft, event_id, CAST(leg AS INT) AS leg, round(d, 3) AS off_km, CAST(points AS INT) AS points, round(elat, 5) AS end_lat, round(elon, 5) AS end_lon FROM fixes LEFT JOIN z USING (event_id)""")
def sm12_follow_route(spark, sf_dir):
    """Each fix on its aircraft's route, at the leg that begins at a point of that number, and where the next 90 km of it end; null off the route or against it."""
    out = jobs.follow_route(tracked(spark, sf_dir), routes(spark, sf_dir), AHEAD_KM)
    end = F.element_at("ahead", -1)
    out = out.select("aircraft", "event_id", F.expr("get(seqs, leg)").alias("leg"), (F.round(F.col("off_km") * 1000) / 1000).alias("off_km"), F.when(F.col("ahead").isNotNull(), F.size("ahead")).alias("points"), F.round(end["lat"], 5).alias("end_lat"), F.round(end["lon"], 5).alias("end_lon"))
    return jobs.drained(out, "route")


@query(cte("transfers") + "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, code, sum(bytes) AS bytes FROM transfers GROUP BY ALL")
def sm14_written_by_kind(spark, sf_dir):
    w = transfers(spark, sf_dir).groupBy(F.window("ts", "5 minutes"), "code").agg(F.sum("bytes").alias("bytes"))
    return jobs.drained(w.select(F.col("window.start").alias("start"), "code", "bytes"), "kinds", "complete")


ENDED = "epoch_ms(start) + {ms} <= (SELECT epoch_ms(max(ts)) - 10000 FROM {t})"


@query(F_ + f", g AS (SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, aircraft, CASE WHEN agl_m >= 3048 THEN 'high' ELSE 'low' END AS phase, max(gs_ms) AS farthest, min(agl_m) AS lowest, count(*) AS fixes FROM fixes GROUP BY ALL) SELECT * FROM g WHERE {ENDED.format(ms=86_400_000, t='fixes')}")
def sm15_camera_stream(spark, sf_dir):
    """Camera reach by phase and day; a day comes out once, when the watermark has passed its end."""
    w = fix_stream(spark, sf_dir).withWatermark("ts", jobs.WATERMARK).groupBy(F.window("ts", "1 day"), "aircraft", F.when(F.col("agl_m") >= 3048, "high").otherwise("low").alias("phase"))
    out = w.agg(F.max("gs_ms").alias("farthest"), F.min("agl_m").alias("lowest"), F.count("*").alias("fixes"))
    return jobs.drained(out.select(F.col("window.start").alias("start"), "aircraft", "phase", "farthest", "lowest", "fixes"), "camera")


@query(F_ + f""", n AS (SELECT *, row_number() OVER ({W}) - 1 AS before, lead(ts) OVER ({W}) AS nxt, epoch_ms(first_value(ts) OVER ({W})) AS since, lat-floor(lat) < 0.5e0 AND lon-floor(lon) < 0.5e0 AS here FROM fixes),
d AS (SELECT aircraft, arg_min(event_id, before) AS event_id, min(before) AS before, CASE WHEN arg_min(here, before) THEN 'here' ELSE 'elsewhere' END AS how FROM n WHERE here OR epoch_ms(ts) >= since + 10000 GROUP BY aircraft)
SELECT * FROM d UNION ALL SELECT aircraft, event_id, before + 1, 'elsewhere' FROM n WHERE nxt IS NULL AND aircraft NOT IN (SELECT aircraft FROM d) AND since + 10000 < {PAST}""")
def sm16_arrivals(spark, sf_dir):
    return machine(spark, sf_dir, jobs.arrived, "before long, how string", jobs.nothing_came)


@query(cte("chunks") + "SELECT count(*) AS pieces FROM (SELECT DISTINCT provider, x, y FROM chunks)")
def sm17_dedup_pieces(spark, sf_dir):
    """One answer a piece, however often it comes within the watermark."""
    c = view(spark, sf_dir, "chunks").select("provider", "x", "y", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    s = jobs.stream_of(c, "pieces").withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["provider", "x", "y"])
    return jobs.drained(s, "pieces").agg(F.count("*").alias("pieces"))


@query("WITH f AS (SELECT user_id AS run, ts, value AS frame_ms FROM events), g AS (SELECT run, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS stutters, max(frame_ms) AS worst FROM f WHERE frame_ms > 100 GROUP BY ALL) SELECT * FROM g WHERE " + ENDED.format(ms=21_600_000, t="(SELECT ts FROM f WHERE frame_ms > 100)"))
def sm18_frame_stutters(spark, sf_dir):
    """Frames over 100 ms, counted with the worst by six hours; a window comes out once, when the watermark has passed it."""
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("frame_ms"))
    slow = jobs.stream_of(f, "frames").where("frame_ms > 100").withWatermark("ts", jobs.WATERMARK)
    w = slow.groupBy(F.window("ts", "6 hours"), "run").agg(F.count("*").alias("stutters"), F.max("frame_ms").alias("worst"))
    return jobs.drained(w.select("run", F.col("window.start").alias("start"), "stutters", "worst"), "stutters")


@query(F_ + "SELECT aircraft, count(*) AS fixes, min(event_id) AS first FROM fixes GROUP BY aircraft")
def src19_position_stream(spark, sf_dir):
    return jobs.drained(fix_stream(spark, sf_dir).groupBy("aircraft").agg(F.count("*").alias("fixes"), F.min("event_id").alias("first")), "positions", "complete")


BLOCK = "SELECT DISTINCT CAST(floor(lat/2) AS BIGINT) AS y, CAST(floor(lon/2) AS BIGINT) AS x FROM points"


@query("WITH RECURSIVE points AS (SELECT c_custkey AS id, CAST((c_custkey*7919)%14000 AS DOUBLE)/100.0-70.0 AS lat, CAST((c_custkey*10007)%36000 AS DOUBLE)/100.0-180.0 AS lon FROM customer), t AS (" + BLOCK + "), r(y, x) AS (SELECT y, x FROM t WHERE (y*31+x*7)%10 = 0 UNION SELECT t.y, t.x FROM r JOIN t ON abs(t.y-r.y)+abs(t.x-r.x) = 1) SELECT y, x FROM r")
def it9_airport_block(spark, sf_dir):
    """Cells that touch the seeds' cells, and so on: whole components that hold a seed."""
    from ..operators.joins import connected_components

    t = view(spark, sf_dir, "points").select(F.floor(F.col("lat") / 2).alias("y"), F.floor(F.col("lon") / 2).alias("x")).distinct().withColumn("id", F.expr("y*4294967296 + x + 2147483648"))
    ahead = t.select(F.col("id").alias("a"), F.explode(F.array(F.col("id") + 1, F.col("id") + 4294967296)).alias("id"))
    links = ahead.join(t.select("id"), "id").select("a", F.col("id").alias("b"))
    roots = connected_components(links)
    named = t.join(roots, t["id"] == roots["node"], "left").select("y", "x", F.coalesce("root", "id").alias("root"))
    return named.join(named.where("(y*31+x*7)%10 = 0").select("root").distinct(), "root", "left_semi").select("y", "x")


@query(cte("points") + "SELECT round(lat, 4) AS lat, round(lon, 4) AS lon, id, x, y FROM (SELECT id, lat, lon, CAST(trunc((lon/180+1)*2^5) AS BIGINT)*16 AS x, CAST(trunc((1-ln(tan((90+lat)*pi()/360))/pi())*2^5) AS BIGINT)*16 AS y FROM points)")
def ud4_texture_table_function(spark, sf_dir):
    """The address of a texture as a SQL function, for users who write SQL."""
    p, s = "CAST((lon/180D+1)*pow(2D, zl-5) AS BIGINT)*16", "CAST((1-ln(tan((90+lat)*pi()/360))/pi())*pow(2D, zl-5) AS BIGINT)*16"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION texture_of(lat DOUBLE, lon DOUBLE, zl INT) RETURNS STRUCT<x: BIGINT, y: BIGINT> RETURN named_struct('x', {p}, 'y', {s})")
    t = view(spark, sf_dir, "points").selectExpr("id", "lat", "lon", "texture_of(lat, lon, 10) AS t")
    return t.select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "id", "t.x", "t.y")


def rows_of(spark, table, sql):
    """SQL over a table as ``t``, with the library's table functions."""
    tables.create(spark)
    return spark.sql(sql, t=table)


@query(ORACLES["st2_tiles_touched"])
def ud4b_tiles_of_box(spark, sf_dir):
    return rows_of(spark, view(spark, sf_dir, "zones"), "SELECT DISTINCT b.tlat, b.tlon FROM {t} AS z, LATERAL tiles_of_box(z.west, z.south, z.east, z.north) AS b")


@query(ORACLES["ar3_grid_walk"])
def ud4c_grid_walk(spark, sf_dir):
    return rows_of(spark, legs(spark, sf_dir), "SELECT l.leg, g.tlat, g.tlon FROM {t} AS l, LATERAL grid_walk(l.lat1, l.lon1, l.lat2, l.lon2) AS g")


@query(ORACLES["ar1_great_circle"])
def ud4d_great_circle(spark, sf_dir):
    return rows_of(spark, legs(spark, sf_dir), f"SELECT l.leg, g.step, round(g.lat, 4) AS lat, round(g.lon, 4) AS lon FROM {{t}} AS l, LATERAL great_circle(l.lat1, l.lon1, l.lat2, l.lon2, {STEP_KM}D) AS g")


assert geo.LOAD_LEVEL == 4
