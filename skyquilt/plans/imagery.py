"""The imagery warehouse: pieces, textures, fallbacks, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, table, view
from ..operators.joins import first_in_budget, written
from ..registry import query

VIEWS["built"] = ("lineitem", ["l_partkey*16 AS til_x", "l_suppkey*16 AS til_y", "10+l_linenumber AS zl", "CASE l_returnflag WHEN 'A' THEN 'BI' ELSE 'EOX' END AS provider", "l_linestatus AS kind", "l_orderkey AS o", "l_linenumber%5 AS level", "l_shipdate AS seen", "l_quantity AS dist"])
LATEST = ", piece AS (SELECT provider, x, y, arg_max(status, k) AS status, arg_max(bytes, k) AS bytes, max(fetched_at) AS fetched_at FROM (SELECT *, struct_pack(a := fetched_at, b := o, c := ln, d := bytes) AS k FROM chunks) GROUP BY ALL) "


def pieces(spark, sf_dir) -> DataFrame:
    """One answer a piece: the latest."""
    last = F.max(F.struct("fetched_at", "o", "ln", "bytes", "status")).alias("m")
    return view(spark, sf_dir, "chunks").groupBy("provider", "x", "y").agg(last).select("provider", "x", "y", "m.status", "m.bytes", "m.fetched_at")


P = cte("chunks") + LATEST


@query(P + "SELECT provider, x//16 AS tx, y//16 AS ty, count(*) AS pieces, bool_and(status < 3) AS complete FROM piece GROUP BY ALL HAVING count(*) >= 2")
def fl19_completed(spark, sf_dir):
    """Textures by whether all their known pieces have a final answer."""
    t = pieces(spark, sf_dir).groupBy("provider", F.expr("x div 16").alias("tx"), F.expr("y div 16").alias("ty"))
    return t.agg(F.count("*").alias("pieces"), F.bool_and(F.col("status") < 3).alias("complete")).where("pieces >= 2")


@query(P + "SELECT provider, x, y, status FROM piece p WHERE status IN (2, 3) AND NOT EXISTS (FROM piece q WHERE q.status = 0 AND q.x = p.x AND q.y = p.y)")
def fl20_refill_candidates(spark, sf_dir):
    """Errors worth asking again, where no source has answered."""
    p = pieces(spark, sf_dir)
    return p.where("status IN (2, 3)").join(p.where("status = 0").select("x", "y"), ["x", "y"], "left_anti").select("provider", "x", "y", "status")


@query(cte("pixels") + "SELECT cloud, max(here) AS most FROM pixels GROUP BY cloud HAVING max(here) > 30")
def fl12_needs_mask(spark, sf_dir):
    return view(spark, sf_dir, "pixels").groupBy("cloud").agg(F.max("here").alias("most")).where("most > 30")


@query(P + ", mask AS (SELECT x//64 AS mx, y//64 AS my, count(*) AS size FROM piece WHERE status = 1 GROUP BY ALL) SELECT DISTINCT x//16 AS tx, y//16 AS ty, mx, my, x//16%4 AS wx, y//16%4 AS wy, size FROM piece JOIN mask ON mx = x//64 AND my = y//64")
def jn17_mask_lookup(spark, sf_dir):
    """The mask two levels up that holds a texture, and the texture's window in it."""
    p = pieces(spark, sf_dir)
    masks = p.where("status = 1").groupBy(F.shiftright("x", 6).alias("mx"), F.shiftright("y", 6).alias("my")).agg(F.count("*").alias("size"))
    t = p.select(F.shiftright("x", 4).alias("tx"), F.shiftright("y", 4).alias("ty")).distinct()
    t = t.select("*", F.shiftright("tx", 2).alias("mx"), F.shiftright("ty", 2).alias("my"), F.expr("tx % 4").alias("wx"), F.expr("ty % 4").alias("wy"))
    return t.join(masks, ["mx", "my"]).select("tx", "ty", "mx", "my", "wx", "wy", "size")


@query(P + """, want AS (SELECT provider, x, y FROM piece WHERE status IN (1, 3)), up AS (SELECT DISTINCT provider, k, x >> k AS px, y >> k AS py FROM piece, range(1, 6) t(k) WHERE status = 0 AND (x+y) % 3 = 0)
SELECT w.provider, w.x, w.y, CAST(min(u.k) AS INT) AS levels, CAST(min(u.k) IS NULL AS BOOLEAN) AS missing FROM want w LEFT JOIN up u ON u.provider = w.provider AND u.px = (w.x >> u.k) AND u.py = (w.y >> u.k) GROUP BY ALL""")
def jn23_parent_fallback(spark, sf_dir):
    """A missing piece takes the nearest ancestor that is held, up to five levels; which ancestors are held follows from the pieces."""
    p = pieces(spark, sf_dir)
    up = lambda df: df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("px", F.expr("shiftright(x, k)")).withColumn("py", F.expr("shiftright(y, k)"))
    held = up(p.where("status = 0 AND (x+y) % 3 = 0")).select("provider", "k", "px", "py").distinct().withColumn("held", F.lit(True))
    want = up(p.where("status IN (1, 3)").select("provider", "x", "y")).join(held, ["provider", "k", "px", "py"], "left")
    return want.groupBy("provider", "x", "y").agg(F.min(F.when(F.col("held"), F.col("k"))).alias("levels")).withColumn("missing", F.col("levels").isNull())


@query(P + ", square AS (SELECT x//128 AS sx, y//128 AS sy, provider, count(*) AS n FROM piece WHERE status = 0 GROUP BY ALL) SELECT sx, sy, arg_min(provider, CASE provider WHEN 'Arc' THEN 0 WHEN 'BI' THEN 1 ELSE 2 END) AS pack FROM square WHERE n >= 12 GROUP BY ALL")
def jn28_covered_squares(spark, sf_dir):
    """The first pack in order that covers a square well enough owns it."""
    n = pieces(spark, sf_dir).where("status = 0").groupBy(F.expr("x div 128").alias("sx"), F.expr("y div 128").alias("sy"), "provider").count().where("count >= 12")
    order = F.when(F.col("provider") == "Arc", 0).when(F.col("provider") == "BI", 1).otherwise(2)
    return n.groupBy("sx", "sy").agg(F.min_by("provider", order).alias("pack"))


@query(cte("zones", "points") + ", sq AS (SELECT priority, unnest(range(CAST(floor(west) AS BIGINT), CAST(ceil(east) AS BIGINT))) AS t, south, north, west, east FROM zones), sq2 AS (SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(ceil(north) AS BIGINT))) AS u FROM sq) SELECT priority, t, u, round(greatest(west, t), 4) AS w, round(least(east, t+1), 4) AS e, round(greatest(south, u), 4) AS s, round(least(north, u+1), 4) AS n FROM sq2 WHERE NOT EXISTS (FROM points q WHERE floor(q.lat) = sq2.u AND floor(q.lon) = sq2.t)")
def jn29_texture_part_outside(spark, sf_dir):
    """Rectangles cut at whole degrees, without the squares that are covered."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(a), F.ceil(b) - 1))
    z = view(spark, sf_dir, "zones").withColumn("t", cut("west", "east")).withColumn("u", cut("south", "north"))
    covered = view(spark, sf_dir, "points").select(F.floor("lat").alias("u"), F.floor("lon").alias("t")).distinct()
    out = z.join(covered, ["u", "t"], "left_anti")
    part = lambda f, a, b, n: F.round(f(F.col(a), b), 4).alias(n)
    return out.select("priority", "t", "u", part(F.greatest, "west", F.col("t").cast("double"), "w"), part(F.least, "east", F.col("t") + 1.0, "e"), part(F.greatest, "south", F.col("u").cast("double"), "s"), part(F.least, "north", F.col("u") + 1.0, "n"))


@query(cte("zones") + "SELECT a.priority AS point, b.priority AS texture, row_number() OVER (PARTITION BY a.priority ORDER BY (b.east-b.west)*(b.north-b.south), b.priority) AS pos FROM zones a JOIN zones b ON a.west BETWEEN b.west AND b.east AND a.south BETWEEN b.south AND b.north")
def jn30_textures_at(spark, sf_dir):
    """What lies under a point, the smallest first."""
    from ..operators.joins import box_join

    z = view(spark, sf_dir, "zones")
    p = z.selectExpr("priority AS point", "west AS x", "south AS y", "west AS x2", "south AS y2")
    hit = box_join(p, z, 4.0, ("x", "y", "x2", "y2"), ("west", "south", "east", "north"))
    order = Window.partitionBy("point").orderBy(F.expr("(east-west)*(north-south)"), "priority")
    return hit.select("point", F.col("priority").alias("texture"), F.row_number().over(order).alias("pos"))


@query(cte("built") + "SELECT til_x//256 AS sx, til_y//256 AS sy, count(*) AS textures, max(zl) AS sharpest FROM (SELECT DISTINCT til_x, til_y, zl FROM built) GROUP BY ALL")
def ag2_count_by_square(spark, sf_dir):
    return view(spark, sf_dir, "built").select("til_x", "til_y", "zl").distinct().groupBy(F.expr("til_x div 256").alias("sx"), F.expr("til_y div 256").alias("sy")).agg(F.count("*").alias("textures"), F.max("zl").alias("sharpest"))


@query(cte("built") + "SELECT til_x, til_y, string_agg(kind, ',' ORDER BY p, kind) AS kinds FROM (SELECT til_x, til_y, kind, min(o*10+zl) AS p FROM built GROUP BY ALL) GROUP BY ALL")
def ag3_kinds_per_texture(spark, sf_dir):
    first = view(spark, sf_dir, "built").groupBy("til_x", "til_y", "kind").agg(F.min(F.expr("o*10+zl")).alias("p"))
    kinds = F.sort_array(F.collect_list(F.struct("p", "kind")))
    return first.groupBy("til_x", "til_y").agg(F.array_join(F.transform(kinds, lambda k: k["kind"]), ",").alias("kinds"))


@query(cte("built") + "SELECT level, kind, sum(CAST(4194304 / 4^level AS BIGINT)) AS bytes, count(*) AS files FROM built GROUP BY ROLLUP (level, kind)")
def ag27_usage_by_level(spark, sf_dir):
    size = F.shiftright(F.lit(4194304).cast("long"), 0) / F.pow(F.lit(4.0), F.col("level"))
    return view(spark, sf_dir, "built").rollup("level", "kind").agg(F.sum(size.cast("long")).alias("bytes"), F.count("*").alias("files"))


@query(cte("transfers") + "SELECT user_id%5 AS source, code, count(*) AS n, CAST(grouping(user_id%5)*2+grouping(code) AS INT) AS cut FROM transfers GROUP BY CUBE (user_id%5, code)")
def ag32_source_answers(spark, sf_dir):
    t = view(spark, sf_dir, "transfers").withColumn("source", F.expr("user_id%5"))
    return t.cube("source", "code").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("cut"))


@query(P + """, want AS (SELECT provider, x, y FROM piece WHERE status IN (1, 3)), have AS (SELECT provider, x, y, bytes FROM piece WHERE status = 0)
SELECT w.provider, w.x, w.y, round(coalesce(avg(h.bytes), (SELECT avg(bytes) FROM have)), 2) AS fill FROM want w LEFT JOIN (SELECT provider, x+dx AS x, y+dy AS y, bytes FROM have, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)) h ON h.provider = w.provider AND h.x = w.x AND h.y = w.y GROUP BY ALL""")
def ag35_mean_fill(spark, sf_dir):
    """A gap takes the mean of its filled neighbours, else the overall mean (one row, broadcast)."""
    p = pieces(spark, sf_dir)
    have = p.where("status = 0").select("provider", F.col("x").alias("hx"), F.col("y").alias("hy"), "bytes")
    offsets = F.expr("explode(transform(sequence(0, 8), i -> named_struct('dx', i % 3 - 1, 'dy', i div 3 - 1)))")
    want = p.where("status IN (1, 3)").select("provider", "x", "y", offsets.alias("d")).select("provider", "x", "y", (F.col("x") + F.col("d.dx")).alias("hx"), (F.col("y") + F.col("d.dy")).alias("hy"))
    near = want.join(have, ["provider", "hx", "hy"], "left").groupBy("provider", "x", "y").agg(F.avg("bytes").alias("m"))
    overall = have.agg(F.avg("bytes").alias("all"))
    return near.join(F.broadcast(overall)).select("provider", "x", "y", F.round(F.coalesce("m", "all"), 2).alias("fill"))


@query(P + "SELECT x//256 AS tx, y//256 AS ty, count(*) AS pieces, count(*) FILTER (status = 0) AS fetched, count(*) FILTER (status = 1) AS missing, count(*) FILTER (status = 3) AS errors, sum(bytes) FILTER (status = 0) AS bytes FROM piece GROUP BY ALL")
def ag36_texture_report(spark, sf_dir):
    n = lambda s: F.count_if(F.col("status") == s)
    return pieces(spark, sf_dir).groupBy(F.expr("x div 256").alias("tx"), F.expr("y div 256").alias("ty")).agg(F.count("*").alias("pieces"), n(0).alias("fetched"), n(1).alias("missing"), n(3).alias("errors"), F.sum(F.when(F.col("status") == 0, F.col("bytes"))).alias("bytes"))


@query(P + ", need AS (SELECT DISTINCT tx*16+dx AS x, ty*16+dy AS y FROM (SELECT DISTINCT x//16 AS tx, y//16 AS ty FROM piece WHERE provider = 'Arc'), range(0, 16) a(dx), range(0, 16) b(dy)) SELECT x//16 AS tx, y//16 AS ty, count(*) AS missing FROM need WHERE NOT EXISTS (FROM piece q WHERE q.status = 0 AND q.x = need.x AND q.y = need.y) GROUP BY ALL")
def st4_missing_pieces(spark, sf_dir):
    p = pieces(spark, sf_dir)
    t = p.where("provider = 'Arc'").select(F.expr("x div 16").alias("tx"), F.expr("y div 16").alias("ty")).distinct()
    need = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(255)))).selectExpr("tx", "ty", "tx*16 + i % 16 AS x", "ty*16 + i div 16 AS y")
    return need.join(p.where("status = 0").select("x", "y"), ["x", "y"], "left_anti").groupBy("tx", "ty").agg(F.count("*").alias("missing"))


@query(P + ", r AS (SELECT *, sum(bytes) OVER (PARTITION BY provider ORDER BY fetched_at, x, y ROWS UNBOUNDED PRECEDING) AS freed FROM piece WHERE status = 0) SELECT provider, x, y, bytes FROM r WHERE freed - bytes < 20000000")
def tk2_evict_pieces(spark, sf_dir):
    """The oldest of a store until enough is freed."""
    p = written(pieces(spark, sf_dir).where("status = 0"), "pieces")
    budgets = p.select("provider").distinct().withColumn("budget", F.lit(20_000_000).cast("long"))
    return first_in_budget(p, "provider", ["fetched_at", "x", "y"], "bytes", budgets).select("provider", "x", "y", "bytes")


@query(cte("built") + ", r AS (SELECT *, row_number() OVER (PARTITION BY sx ORDER BY zl DESC, til_x, til_y) AS rn FROM (SELECT DISTINCT til_x//2048 AS sx, til_x, til_y, zl FROM built)) SELECT sx, til_x, til_y, zl, CAST(1 AS BIGINT) AS n FROM r WHERE rn <= 20 UNION ALL SELECT sx, NULL, NULL, max(zl), count(*) FROM r WHERE rn > 20 GROUP BY sx")
def tk5_sharpest_first(spark, sf_dir):
    """The twenty sharpest of a square in full, the rest as one row."""
    w = Window.partitionBy("sx").orderBy(F.desc("zl"), "til_x", "til_y")
    r = view(spark, sf_dir, "built").selectExpr("til_x div 2048 AS sx", "til_x", "til_y", "zl").distinct().withColumn("rn", F.row_number().over(w))
    rest = r.where("rn > 20").groupBy("sx").agg(F.max("zl").alias("zl"), F.count("*").alias("n"))
    return r.where("rn <= 20").select("sx", "til_x", "til_y", "zl", F.lit(1).cast("long").alias("n")).unionByName(rest, allowMissingColumns=True)


#: Bytes of a texture by level; one coarser than the last is the neutral clone, which holds none of its own.
LEVEL_BYTES, SMALL, NEUTRAL = 4_194_304, 4, 5


def texture_bytes(level: Column) -> Column:
    return (F.lit(float(LEVEL_BYTES)) / F.pow(F.lit(4.0), level)).cast("long")


def evictions(built: DataFrame, budgets: DataFrame, by: str, key: list[str]) -> DataFrame:
    """(by, key, level, new_level, freed): the textures to coarsen so that each store holds 90 % of its budget, if it holds more than all of it.

    ``built``: by, key, level, behind (of the aircraft), seen, coarsen and neutral (whether it may become that coarse);
    ``budgets``: by, budget. First sharp textures go back to the level of 256 pixels, then those that stood there
    to the neutral clone; in each step those behind the aircraft first, then the longest unseen. Both steps are rows
    of one order, and the budget's end is found by sums of coarse values, so no task puts a store's rows in order.
    """
    held = written(built.withColumn("bytes", texture_bytes(F.col("level"))), "built")
    used = held.groupBy(by).agg(F.sum("bytes").alias("used")).join(budgets, by).where("used > budget")
    sharp, small = (F.col("level") < SMALL) & F.col("coarsen"), (F.col("level") == SMALL) & F.col("neutral")
    items = held.where(sharp | small).select(
        by, *key, "level", F.when(sharp, SMALL).otherwise(NEUTRAL).alias("new_level"), F.when(sharp, F.col("bytes") - texture_bytes(F.lit(SMALL))).otherwise(F.col("bytes")).alias("freed"),
        (F.when(sharp, 0).otherwise(2) + F.when(F.col("behind"), 0).otherwise(1)).alias("turn"), "seen",
    )
    need = used.select(by, F.expr("used - budget * 9 div 10").alias("need"))
    return first_in_budget(items, by, ["turn", "seen", *key], "freed", need).select(by, *key, "level", "new_level", "freed")


# A store is a band of columns; the aircraft stands in its middle, heads east, and keeps what is near it sharp.
@query(cte("built") + f""", t AS (SELECT til_x//4096 AS lot, til_x, til_y, zl, min(level) AS level, max(seen) AS seen, min(dist) AS dist FROM built GROUP BY ALL),
h AS (SELECT *, til_x < lot*4096+2048 AS behind, CAST({LEVEL_BYTES} / 4**level AS BIGINT) AS bytes FROM t),
u AS (SELECT lot, CAST(sum(bytes) AS BIGINT) AS used, CAST(sum(bytes) AS BIGINT)*CASE lot%3 WHEN 0 THEN 15 WHEN 1 THEN 500 ELSE 1200 END//1000 AS budget FROM h GROUP BY lot),
i AS (SELECT lot, til_x, til_y, zl, level, 4 AS new_level, bytes - {LEVEL_BYTES >> 8} AS freed, CASE WHEN behind THEN 0 ELSE 1 END AS turn, seen FROM h WHERE level < 4 AND (dist > 5 OR lot%3=0)
 UNION ALL SELECT lot, til_x, til_y, zl, level, 5, bytes, CASE WHEN behind THEN 2 ELSE 3 END, seen FROM h WHERE level = 4 AND dist > 20),
o AS (SELECT *, sum(freed) OVER (PARTITION BY lot ORDER BY turn, seen, til_x, til_y, zl ROWS UNBOUNDED PRECEDING) AS gone FROM i)
SELECT lot, til_x, til_y, zl, level, CAST(new_level AS INT) AS new_level, CAST(freed AS BIGINT) AS freed FROM o JOIN u USING (lot) WHERE used > budget AND gone - freed < used - budget*9//10""")
def tk1_evict(spark, sf_dir):
    """What is coarsened, in two steps, by the order of need."""
    t = view(spark, sf_dir, "built").groupBy(F.expr("til_x div 4096").alias("lot"), "til_x", "til_y", "zl").agg(F.min("level").alias("level"), F.max("seen").alias("seen"), F.min("dist").alias("dist"))
    t = written(t.selectExpr("*", "til_x < lot*4096+2048 AS behind", "dist > 5 OR lot%3=0 AS coarsen", "dist > 20 AS neutral"), "textures")
    used = t.groupBy("lot").agg(F.sum(texture_bytes(F.col("level"))).alias("used"))
    return evictions(t, used.selectExpr("lot", "used*CASE lot%3 WHEN 0 THEN 15 WHEN 1 THEN 500 ELSE 1200 END div 1000 AS budget"), "lot", ["til_x", "til_y", "zl"])


@query("WITH r AS (SELECT event_id AS report, user_id, ts, value AS rate, CAST(date_diff('second', ts, max(ts) OVER (PARTITION BY user_id)) AS DOUBLE)/43200 AS age FROM events), w AS (SELECT *, 0.5e0^age AS w FROM r), c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY rate, report ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY user_id) AS total FROM w) SELECT user_id, round(min(rate), 4) AS factor FROM c WHERE upto >= total/2 GROUP BY user_id")
def ag28_line_factor(spark, sf_dir):
    """Weighted median; a report's weight halves every twelve hours."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("rate"), F.col("event_id").alias("report"), "ts")
    user = Window.partitionBy("user_id")
    age = (F.unix_timestamp(F.max("ts").over(user)) - F.unix_timestamp("ts")) / 43200.0
    w = e.withColumn("w", F.pow(F.lit(0.5), age)).withColumn("total", F.sum("w").over(user)).withColumn("upto", F.sum("w").over(user.orderBy("rate", "report").rowsBetween(Window.unboundedPreceding, 0)))
    return w.where("upto >= total/2").groupBy("user_id").agg(F.round(F.min("rate"), 4).alias("factor"))


@query(cte("raster") + ", base AS (SELECT r, c, CAST(alt AS INT)%256 AS v FROM raster WHERE alt > -32768), l1 AS (SELECT r//2 AS r, c//2 AS c, pow(avg(pow(v/255e0, 2.2e0)), 1/2.2e0)*255 AS v FROM base GROUP BY 1, 2), l2 AS (SELECT r//2 AS r, c//2 AS c, pow(avg(pow(v/255e0, 2.2e0)), 1/2.2e0)*255 AS v FROM l1 GROUP BY 1, 2) SELECT CAST(1 AS INT) AS level, r, c, round(v, 3) AS v FROM l1 UNION ALL SELECT 2, r, c, round(v, 3) FROM l2")
def ar12_mosaic_pyramid(spark, sf_dir):
    """Halved twice, in linear light."""
    p = view(spark, sf_dir, "raster").where("alt > -32768").selectExpr("r", "c", "int(alt)%256 AS v")
    out = []
    for level in (1, 2):
        p = p.groupBy(F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c")).agg((F.pow(F.avg(F.pow(F.col("v") / 255.0, F.lit(2.2))), F.lit(1 / 2.2)) * 255).alias("v"))
        out.append(p.select(F.lit(level).alias("level"), "r", "c", F.round("v", 3).alias("v")))
    return out[0].unionByName(out[1])
