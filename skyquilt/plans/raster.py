"""Rasters in long form: sampling, filling, smoothing, distances, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, table, view
from ..operators.joins import box_join, written
from ..registry import query

VOID = -32768.0
VIEWS["spots"] = ("customer", ["c_custkey AS id", "CAST((c_custkey*7919)%3900 AS DOUBLE)/100.0e0 AS y", "CAST((c_custkey*10007)%4900 AS DOUBLE)/100.0e0 AS x"])
R = cte("raster")
RS = cte("raster", "spots")


def raster(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "raster").selectExpr("r", "c", "double(alt) AS alt")


def square(spark, sf_dir) -> DataFrame:
    """Spots with the four posts round them, z<row><col>, where none is void: four keys a spot, one equi-join."""
    s = view(spark, sf_dir, "spots").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s = s.select("id", "x", "y", "i", (F.floor("y") + F.expr("i div 2")).alias("r"), (F.floor("x") + F.expr("i % 2")).alias("c"))
    z = s.join(raster(spark, sf_dir).where(f"alt > {VOID}"), ["r", "c"])
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("alt")))
    q = z.groupBy("id", "x", "y").agg(at(0).alias("z00"), at(1).alias("z01"), at(2).alias("z10"), at(3).alias("z11"), F.count("*").alias("n")).where("n = 4")
    return q.selectExpr("*", "x-floor(x) AS fx", "y-floor(y) AS fy")


QUAD = ", q AS (SELECT s.id, s.x-floor(s.x) AS fx, s.y-floor(s.y) AS fy, a.alt::DOUBLE AS z00, b.alt::DOUBLE AS z01, d.alt::DOUBLE AS z10, e.alt::DOUBLE AS z11 FROM spots s JOIN raster a ON a.r=floor(s.y) AND a.c=floor(s.x) JOIN raster b ON b.r=a.r AND b.c=a.c+1 JOIN raster d ON d.r=a.r+1 AND d.c=a.c JOIN raster e ON e.r=a.r+1 AND e.c=a.c+1 WHERE least(a.alt, b.alt, d.alt, e.alt) > -32768) "


@query(RS + QUAD + "SELECT id, round(CASE WHEN fx+fy <= 1 THEN z00+fx*(z01-z00)+fy*(z10-z00) ELSE z11+(1-fx)*(z10-z11)+(1-fy)*(z01-z11) END, 5) AS z FROM q")
def jn19_sample_elevation(spark, sf_dir):
    """On the two triangles of a post square."""
    return square(spark, sf_dir).selectExpr("id", "round(CASE WHEN fx+fy <= 1 THEN z00+fx*(z01-z00)+fy*(z10-z00) ELSE z11+(1-fx)*(z10-z11)+(1-fy)*(z01-z11) END, 5) AS z")


@query(RS + "SELECT s.id, coalesce(r.alt, -32768)::DOUBLE AS z FROM spots s LEFT JOIN raster r ON r.r = round_even(s.y*1.1e0, 0) AND r.c = round_even(s.x, 0)")
def jn20_sample_nearest(spark, sf_dir):
    s = view(spark, sf_dir, "spots").select("id", F.rint(F.col("y") * 1.1).cast("long").alias("r"), F.rint("x").cast("long").alias("c"))
    return s.join(raster(spark, sf_dir), ["r", "c"], "left").select("id", F.coalesce("alt", F.lit(VOID)).alias("z"))


@query(RS + QUAD + "SELECT id, round((z00*(1-fx)+z01*fx)*(1-fy)+(z10*(1-fx)+z11*fx)*fy, 5) AS z FROM q")
def jn21_sample_bilinear(spark, sf_dir):
    return square(spark, sf_dir).selectExpr("id", "round((z00*(1-fx)+z01*fx)*(1-fy)+(z10*(1-fx)+z11*fx)*fy, 5) AS z")


@query(RS + "SELECT s.id, CAST(coalesce(CASE WHEN r.alt > -32768 THEN CAST(r.alt AS INT) % 256 END, 255) AS INT) AS bathy FROM spots s LEFT JOIN raster r ON r.r = floor(s.y) AND r.c = floor(s.x)")
def jn18_bathy_at(spark, sf_dir):
    s = view(spark, sf_dir, "spots").select("id", F.floor("y").alias("r"), F.floor("x").alias("c"))
    return s.join(raster(spark, sf_dir).where(f"alt > {VOID}"), ["r", "c"], "left").select("id", F.coalesce(F.expr("int(alt) % 256"), F.lit(255)).alias("bathy"))


def lay_over(base: DataFrame, step: float, overlays: list[tuple[DataFrame, float, bool]]) -> DataFrame:
    """(r, c, alt): overlays over a base raster where they have data, the last of the list first.

    ``base``: r, c, alt, posts ``step`` apart; ``overlays``: (posts without voids, their step in the same measure,
    whether the file is the user's own), both numbered from the same corner. The nearest post counts, to the even
    one between two. An overlay coarser than the base is left out, unless it is the user's own: that is laid below
    the finer ones, between its four posts where all are there and by its nearest where only that is.
    A post names the posts of each overlay that it needs, so each overlay is one equi-join.
    """
    out = base.withColumn("_best", F.lit(None).cast("double"))
    coarse = [(o, s) for o, s, own in overlays if s > step * 1.000001 and own]
    for over, wide in coarse:
        k = step / wide
        near = {n: F.rint(F.col(n) * k).cast("long") for n in ("r", "c")}
        low = {n: F.floor(F.col(n) * k) for n in ("r", "c")}
        corner = F.array(*(F.struct((low["r"] + i).alias("_r"), (low["c"] + j).alias("_c"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)))
        asked = base.select("r", "c", F.explode(corner).alias("q")).select("r", "c", "q._r", "q._c", "q.i", "q.j")
        held = asked.join(over.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("alt").alias("_z")), ["_r", "_c"])
        part = lambda n, side: F.when(side == 1, F.col(n) * k - F.floor(F.col(n) * k)).otherwise(1 - F.col(n) * k + F.floor(F.col(n) * k))  # noqa: B023, E731
        between = F.sum(F.col("_z") * part("r", F.col("i")) * part("c", F.col("j")))
        mean = held.groupBy("r", "c").agg(F.count("*").alias("_n"), between.alias("_mean"), F.max(F.when((F.col("_r") == near["r"]) & (F.col("_c") == near["c"]), F.col("_z"))).alias("_near"))
        laid = mean.select("r", "c", F.when(F.col("_n") == 4, F.col("_mean")).otherwise(F.col("_near")).alias("_new"))
        out = out.join(laid, ["r", "c"], "left").withColumn("_best", F.coalesce("_new", "_best")).drop("_new")
    for over, wide, _ in overlays:
        if wide <= step * 1.000001:
            k = step / wide
            near = [F.rint(F.col(n) * k).cast("long").alias(f"_{n}") for n in ("r", "c")]
            laid = over.select(F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("alt").alias("_new"))
            out = out.select("*", *near).join(laid, ["_r", "_c"], "left").withColumn("_best", F.coalesce("_new", "_best")).drop("_r", "_c", "_new")
    return out.select("r", "c", F.coalesce("_best", "alt").alias("alt"))


# Over the raster as base, with a step of 2: a source at 3 is left out, the user's own at 3 is laid between its posts, then sources at 2 and at 1.
_OVERS = ("r < 40 AND (r+c)%7 > 0", "(r*c)%5 > 1", "r%4 = 0 AND c%3 > 0")


@query(R + f""", b AS (SELECT r, c, alt::DOUBLE AS alt FROM raster), o AS (SELECT r, c, alt+10 AS z FROM b WHERE alt > -32768 AND {_OVERS[0]}), f AS (SELECT r, c, alt+20 AS z FROM b WHERE alt > -32768 AND {_OVERS[1]} AND (r+c)%3=0), g AS (SELECT r, c, alt+30 AS z FROM b WHERE alt > -32768 AND {_OVERS[2]}),
q AS (SELECT b.r, b.c, count(*) AS n, sum(z*(1-abs(b.r*2/3e0-o.r))*(1-abs(b.c*2/3e0-o.c))) AS mean, max(z) FILTER (o.r = round_even(b.r*2/3e0, 0) AND o.c = round_even(b.c*2/3e0, 0)) AS near FROM b JOIN o ON o.r BETWEEN floor(b.r*2/3e0) AND floor(b.r*2/3e0)+1 AND o.c BETWEEN floor(b.c*2/3e0) AND floor(b.c*2/3e0)+1 GROUP BY b.r, b.c)
SELECT b.r, b.c, round(coalesce(g.z, f.z, CASE WHEN q.n = 4 THEN q.mean ELSE q.near END, b.alt), 4) AS alt FROM b LEFT JOIN q ON q.r = b.r AND q.c = b.c LEFT JOIN f ON f.r = b.r AND f.c = b.c LEFT JOIN g ON g.r = b.r*2 AND g.c = b.c*2""")
def jn22_lay_over(spark, sf_dir):
    """Overlays of three steps over a base, one of them coarser and skipped, one coarser and the user's own."""
    base = raster(spark, sf_dir)
    known = base.where(f"alt > {VOID}")
    lift = lambda df, m: df.select("r", "c", (F.col("alt") + m).alias("alt"))
    return lay_over(base, 2.0, [(lift(known, 99), 3.0, False), (lift(known.where(_OVERS[0]), 10), 3.0, True), (lift(known.where(f"{_OVERS[1]} AND (r+c)%3=0"), 20), 2.0, False), (lift(known.where(_OVERS[2]), 30), 1.0, False)]).select("r", "c", F.round("alt", 4).alias("alt"))


@query(R + ", d AS (SELECT f.r//10 AS block, abs(f.alt-g.alt)::DOUBLE AS d FROM raster f JOIN raster g ON g.r = f.r-f.r%2 AND g.c = f.c-f.c%2 WHERE f.alt > -32768 AND g.alt > -32768) SELECT block, count(*) AS n, round(avg(d), 5) AS mean, quantile_disc(d, 0.5) AS median, round(avg(CASE WHEN d > 100 THEN 1.0e0 ELSE 0 END), 5) AS share FROM d GROUP BY block")
def jn36_compare_relief(spark, sf_dir):
    """A coarser relief read at the finer one's posts, where both have data."""
    f = raster(spark, sf_dir).where(f"alt > {VOID}")
    coarse = f.where("r%2=0 AND c%2=0").selectExpr("r AS gr", "c AS gc", "alt AS g")
    d = f.selectExpr("r div 10 AS block", "r-r%2 AS gr", "c-c%2 AS gc", "alt").join(coarse, ["gr", "gc"]).select("block", F.abs(F.col("alt") - F.col("g")).alias("d"))
    w = Window.partitionBy("block")
    mid = d.withColumn("i", F.row_number().over(w.orderBy("d"))).withColumn("n", F.count("*").over(w))
    return mid.groupBy("block").agg(F.count("*").alias("n"), F.round(F.avg("d"), 5).alias("mean"), F.max(F.when(F.col("i") == F.ceil(F.col("n") / 2), F.col("d"))).alias("median"), F.round(F.avg((F.col("d") > 100).cast("double")), 5).alias("share"))


@query(R + "SELECT r, c, least(((r*31+c*17)%400)::DOUBLE, floor(alt)-2)::DOUBLE AS bathy FROM raster WHERE alt > -32768")
def jn37_clamp_bathymetry(spark, sf_dir):
    b = raster(spark, sf_dir).where(f"alt > {VOID}").selectExpr("r", "c", "double((r*31+c*17)%400) AS bathy", "alt")
    return b.select("r", "c", F.least("bathy", F.floor("alt") - 2.0).cast("double").alias("bathy"))


@query(R + "SELECT v.r, v.c, coalesce(max(n.alt), 0)::DOUBLE AS alt FROM raster v LEFT JOIN raster n ON n.alt > -32768 AND abs(n.r-v.r)+abs(n.c-v.c) = 1 WHERE v.alt = -32768 GROUP BY v.r, v.c")
def it6_fill_voids(spark, sf_dir):
    """Voids take the most of their four neighbours, again and again; what twenty rounds leave becomes 0."""
    return fill_voids(raster(spark, sf_dir), F.expr("r div 1200"))


#: A tile with more voids than this is refused.
MOST_VOIDS = 10_000


def fill_voids(own: DataFrame, tile: Column) -> DataFrame:
    """(r, c, alt) of the voids of a raster; a tile with MOST_VOIDS of them or more is refused as a whole."""
    void = own.where(f"alt = {VOID}").groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))
    own = own.join(void.where(F.col("n") >= MOST_VOIDS).select("tile"), tile == F.col("tile"), "left_anti")
    known, voids = written(own.where(f"alt > {VOID}")), written(own.where(f"alt = {VOID}").select("r", "c"))
    side = F.expr("explode(array(named_struct('dr', 0, 'dc', 1), named_struct('dr', 0, 'dc', -1), named_struct('dr', 1, 'dc', 0), named_struct('dr', -1, 'dc', 0)))")
    filled = []
    for _ in range(20):
        near = voids.select("r", "c", side.alias("d")).selectExpr("r AS vr", "c AS vc", "r + d.dr AS r", "c + d.dc AS c").join(known, ["r", "c"])
        new = written(near.groupBy(F.col("vr").alias("r"), F.col("vc").alias("c")).agg(F.max("alt").alias("alt")))
        if new.isEmpty():
            break
        filled.append(new)
        known, voids = new, written(voids.join(new, ["r", "c"], "left_anti"))  # only fresh posts can fill more
        if voids.isEmpty():
            break
    return reduce(DataFrame.unionByName, filled, voids.withColumn("alt", F.lit(0.0)))


def triangle_sums(df: DataFrame, columns: list[str], by: str, along: str, p: int) -> DataFrame:
    """Each column's sum with the weights 1 ... p+1 ... 1 along one axis, whose rows have no gaps; beyond the ends there is nothing.

    A triangle is a box summed twice, and so three places of a running sum of running sums: two windows and three
    looks aside, however wide p is. Beyond the end the running sums go on as a straight line.
    """
    w = Window.partitionBy(by).orderBy(along)
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = [c for c in df.columns if c not in columns]
    once = df.select(*own, *(F.sum(c).over(upto).alias(c) for c in columns), F.row_number().over(w).alias("_n"), F.count("*").over(Window.partitionBy(by)).alias("_all"))
    twice = once.select(*own, "_n", "_all", *(F.sum(c).over(upto).alias(c) for c in columns), *(F.last(c).over(whole).alias(f"_{c}") for c in columns))
    beyond = F.greatest(F.col("_n") + p - F.col("_all"), F.lit(0))

    def total(c):
        back = lambda k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
        ahead = F.coalesce(F.lead(c, p).over(w), F.last(c).over(whole) + beyond * F.col(f"_{c}"))
        return (ahead - 2 * back(1) + back(p + 2)).alias(c)

    return twice.select(*own, *map(total, columns))


def smoothed(raster: DataFrame, p: int) -> DataFrame:
    """(r, c, alt, smooth): a raster smoothed by a triangle of p posts either way, along rows, then along columns.

    ``raster``: r, c, alt, weight (0 to 1). A post counts by its weight; the result is blended with the post's own
    height by its weight, and again over the p rows and columns next to the border, where the outermost stay as
    they are. A post of weight 0 stays as it is.
    """
    m = raster.select("r", "c", "alt", "weight", (F.col("alt") * F.col("weight")).alias("v"), F.col("weight").alias("w"))
    out = triangle_sums(triangle_sums(m, ["v", "w"], "r", "c", p), ["v", "w"], "c", "r", p)
    inside = F.col("weight") * F.col("v") / F.col("w") + (1 - F.col("weight")) * F.col("alt")
    edge = lambda by, n: F.least(F.row_number().over(Window.partitionBy(by).orderBy(n)) - 1, F.count("*").over(Window.partitionBy(by)) - F.row_number().over(Window.partitionBy(by).orderBy(n)), F.lit(p)) / float(p)
    at = out.select("r", "c", "alt", "weight", F.when(F.col("weight") > 0, inside).otherwise(F.col("alt")).alias("s"), edge("c", "r").alias("down"), edge("r", "c").alias("side"))
    blend = lambda k, s: F.col(k) * s + (1 - F.col(k)) * F.col("alt")
    return at.select("r", "c", "alt", F.when(F.col("weight") > 0, blend("side", blend("down", F.col("s")))).otherwise(F.col("alt")).alias("smooth"))


#: Posts either way.
SMOOTH_P = 3
TRI = "+".join(f"{SMOOTH_P + 1 - abs(k)}*coalesce({'lag' if k >= 0 else 'lead'}({{v}}, {abs(k)}) OVER w, 0)" for k in range(-SMOOTH_P, SMOOTH_P + 1))
EDGE = f"least(row_number() OVER {{w}} - 1, count(*) OVER {{a}} - row_number() OVER {{w}}, {SMOOTH_P})/{SMOOTH_P}e0"


# Voids weigh nothing, every third row half; SQL adds up the weights term by term.
@query(R + f""", m AS (SELECT r, c, alt::DOUBLE AS alt, w AS m, alt::DOUBLE*w AS v, w FROM (SELECT *, CASE WHEN alt <= -32768 THEN 0e0 WHEN r%3=0 THEN 0.5e0 ELSE 1e0 END AS w FROM raster)), a AS (SELECT r, c, alt, w AS k, {TRI.format(v='v')} AS v, {TRI.format(v='m')} AS m FROM m WINDOW w AS (PARTITION BY r ORDER BY c)),
b AS (SELECT r, c, alt, k, {TRI.format(v='v')} AS v, {TRI.format(v='m')} AS m FROM a WINDOW w AS (PARTITION BY c ORDER BY r)),
e AS (SELECT *, k*v/m + (1-k)*alt AS s, {EDGE.format(w='(PARTITION BY c ORDER BY r)', a='(PARTITION BY c)')} AS down, {EDGE.format(w='(PARTITION BY r ORDER BY c)', a='(PARTITION BY r)')} AS side FROM b)
SELECT r, c, round(CASE WHEN k > 0 THEN side*(down*s+(1-down)*alt)+(1-side)*alt ELSE alt END/0.3048e0, 3) AS feet FROM e""")
def wn9_triangular_smooth(spark, sf_dir):
    """Smoothed along rows, then along columns, in feet."""
    weight = F.when(F.col("alt") <= VOID, 0.0).when(F.col("r") % 3 == 0, 0.5).otherwise(1.0)
    return smoothed(raster(spark, sf_dir).withColumn("weight", weight), SMOOTH_P).select("r", "c", F.round(F.col("smooth") / 0.3048, 3).alias("feet"))


@query(R + ", b AS (SELECT r, c, CAST(alt AS INT) % 256 AS v FROM raster WHERE alt > -32768), s AS (SELECT r, c, sum(v) OVER w AS s, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT r, c, CAST(2*least(CAST(floor(s/n) AS INT), 127) AS INT) AS v FROM s")
def wn10_hat_blur(spark, sf_dir):
    w = Window.partitionBy("r").orderBy("c").rowsBetween(-1, 1)
    b = raster(spark, sf_dir).where(f"alt > {VOID}").selectExpr("r", "c", "int(alt) % 256 AS v")
    return b.select("r", "c", (2 * F.least(F.floor(F.sum("v").over(w) / F.count("*").over(w)), F.lit(127))).cast("int").alias("v"))


def distance(spark, sf_dir, reach: int = 3) -> DataFrame:
    """Distance of every post to the nearest land (over 400), saturating: land is dealt out to the posts in reach."""
    own = raster(spark, sf_dir)
    land = own.where("alt >= 400").select("r", "c")
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = land.withColumn("dr", F.explode(span)).withColumn("dc", F.explode(span)).selectExpr("r+dr AS r", "c+dc AS c", "sqrt(dr*dr+dc*dc) AS d").groupBy("r", "c").agg(F.min("d").alias("d"))
    return own.select("r", "c").join(near, ["r", "c"], "left").select("r", "c", F.least(F.coalesce("d", F.lit(float(reach))), F.lit(float(reach))).alias("d"))


DIST = ", dist AS (SELECT v.r, v.c, least(3.0e0, coalesce(min(sqrt((n.r-v.r)^2+(n.c-v.c)^2)), 3.0e0)) AS d FROM raster v LEFT JOIN raster n ON n.alt >= 400 AND abs(n.r-v.r) <= 3 AND abs(n.c-v.c) <= 3 GROUP BY v.r, v.c) "


@query(R + DIST + "SELECT r, c, round(d, 5) AS d FROM dist")
def wn11_distance_to_land(spark, sf_dir):
    return distance(spark, sf_dir).select("r", "c", F.round("d", 5).alias("d"))


MAX5 = "max({v}) OVER (PARTITION BY {a} ORDER BY {b} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(R + DIST + f", a AS (SELECT r, c, d, {MAX5.format(v='d', a='r', b='c')} AS m FROM dist), b AS (SELECT r, c, d, {MAX5.format(v='m', a='c', b='r')} AS m FROM a) SELECT r, c, round((1-d/nullif(m, 0))^2, 5) AS fade FROM b")
def wn12_local_max(spark, sf_dir):
    most = lambda n, a, b: F.max(n).over(Window.partitionBy(a).orderBy(b).rowsBetween(-2, 2))
    m = distance(spark, sf_dir).withColumn("m", most("d", "r", "c")).withColumn("m", most("m", "c", "r"))
    return m.select("r", "c", F.round(F.pow(1 - F.col("d") / F.nullif(F.col("m"), F.lit(0.0)), 2), 5).alias("fade"))


LADDER = ((0.0, 255), (1.0, 180), (1.5, 120), (2.5, 60))


@query(R + DIST + f"SELECT r, c, CAST(CASE {' '.join(f'WHEN d <= {t} THEN {v}' for t, v in LADDER)} ELSE 0 END AS INT) AS value FROM dist")
def wn13_step_mask(spark, sf_dir):
    """The ladder is a table of a few fixed steps, so it is broadcast."""
    ladder = spark.createDataFrame([(t, v) for t, v in LADDER], "most double, v int")
    d = distance(spark, sf_dir).join(F.broadcast(ladder), F.col("d") <= F.col("most"), "left")
    return d.groupBy("r", "c").agg(F.coalesce(F.min_by("v", "most"), F.lit(0)).alias("value"))


# Rectangles of cells, bounds counted in, on maps of 300 by 240; one in 50 is out of the map, so its bounds cross.
VIEWS["rects"] = (
    "customer",
    [
        "c_custkey AS id", "CAST(floor(c_custkey/200) AS BIGINT) AS map", "CASE WHEN c_custkey%3=0 THEN 'airport' ELSE 'coast' END AS kind", "(c_custkey*37)%280 AS x0",
        "CASE WHEN c_custkey%50=7 THEN (c_custkey*37)%280-3 ELSE (c_custkey*37)%280+5+c_custkey%20 END AS x1", "(c_custkey*53)%230 AS y0", "(c_custkey*53)%230+3+c_custkey%7 AS y1",
    ],
)


def painted(rects: DataFrame, by: str, kinds: list[str]) -> DataFrame:
    """(by, x0, x1, y0, y1, and each kind's count): the cells that rectangles cover, as rectangles of equal counts, open at their far ends.

    ``rects``: by, kind, x0, x1, y0, y1, whole numbers, bounds counted in; those whose bounds cross are dropped. A
    two-dimensional difference array as rows: four corners a rectangle, equal corners summed up; running sums along
    each row give steps; steps are cut at the columns where any step of their map begins or ends, and running sums
    down each such column give the counts. Work follows the rectangles' upper and lower edges, not their areas.
    """
    corner = F.expr("explode(array(struct(x0 AS x, y0 AS y, 1L AS d), struct(x1+1 AS x, y0 AS y, -1L AS d), struct(x0 AS x, y1+1 AS y, -1L AS d), struct(x1+1 AS x, y1+1 AS y, 1L AS d)))")
    marks = rects.where("x0 <= x1 AND y0 <= y1").select(by, "kind", corner.alias("c")).groupBy(by, "c.x", "c.y").agg(*(F.sum(F.when(F.col("kind") == k, F.col("c.d")).otherwise(0)).alias(k) for k in kinds))
    marks = written(marks, "corners")
    row = Window.partitionBy(by, "y").orderBy("x")
    upto = lambda w, k: F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k)
    steps = marks.select(by, "y", F.col("x").alias("x0"), F.lead("x").over(row).alias("x1"), *(upto(row, k) for k in kinds)).where(" OR ".join(f"{k} <> 0" for k in kinds))
    edges = marks.select(by, "x").distinct().groupBy(by).agg(F.sort_array(F.collect_list("x")).alias("edges"))  # as many as a map has columns
    cut = steps.join(edges, by).withColumn("x", F.explode(F.filter("edges", lambda e: (e >= F.col("x0")) & (e < F.col("x1")))))
    cut = cut.withColumn("to", F.element_at(F.filter("edges", lambda e: e > F.col("x")), 1))
    column = Window.partitionBy(by, "x").orderBy("y")
    sums = cut.groupBy(by, "x", "to", "y").agg(*(F.sum(k).alias(k) for k in kinds))
    out = sums.select(by, F.col("x").alias("x0"), F.col("to").alias("x1"), F.col("y").alias("y0"), F.lead("y").over(column).alias("y1"), *(upto(column, k) for k in kinds))
    return out.where(" OR ".join(f"{k} > 0" for k in kinds))


#: Weights of cells that airports or coasts cover; a coast's counts where it is the greater.
AIRPORT_WEIGHT, COAST_WEIGHT = 15.0, 5.0


# The sum over a weight's cells of 31 x + 17 y tells where they are.
@query(cte("rects") + f""", c AS (SELECT map, kind, unnest(range(x0, x1+1)) AS x, y FROM (SELECT *, unnest(range(y0, y1+1)) AS y FROM rects)), w AS (SELECT map, x, y, greatest(CASE WHEN bool_or(kind = 'airport') THEN {AIRPORT_WEIGHT} ELSE 1 END, CASE WHEN bool_or(kind = 'coast') THEN {COAST_WEIGHT} ELSE 0 END)::DOUBLE AS weight FROM c GROUP BY ALL)
SELECT map, weight, count(*) AS cells, CAST(sum(31*x+17*y) AS BIGINT) AS places FROM w GROUP BY ALL""")
def wn17_rect_union(spark, sf_dir):
    """Cells by weight: airports' rectangles set theirs, coasts' count where they are greater."""
    p = painted(view(spark, sf_dir, "rects"), "map", ["airport", "coast"])
    weight = F.greatest(F.when(F.col("airport") > 0, AIRPORT_WEIGHT).otherwise(1.0), F.when(F.col("coast") > 0, COAST_WEIGHT).otherwise(0.0))
    places = F.expr("(x1-x0) * (y1-y0) * (31*(x0+x1-1) + 17*(y0+y1-1)) div 2")
    return p.withColumn("weight", weight).groupBy("map", "weight").agg(F.sum(F.expr("(x1-x0) * (y1-y0)")).alias("cells"), F.sum(places).alias("places"))


@query(R + "SELECT a.r*3+i AS r, a.c*3+j AS c, round((a.alt*(1-j/3e0)+b.alt*j/3e0)*(1-i/3e0)+(d.alt*(1-j/3e0)+e.alt*j/3e0)*i/3e0, 4) AS alt FROM raster a JOIN raster b ON b.r=a.r AND b.c=a.c+1 JOIN raster d ON d.r=a.r+1 AND d.c=a.c JOIN raster e ON e.r=a.r+1 AND e.c=a.c+1, range(0, 3) p(i), range(0, 3) q(j) WHERE least(a.alt, b.alt, d.alt, e.alt) > -32768")
def ar13_resample(spark, sf_dir):
    """Posts three times as close, bilinear between four that have data."""
    own = raster(spark, sf_dir).where(f"alt > {VOID}")
    corner = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("r - k div 2 AS r", "c - k % 2 AS c", "k", "alt")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("alt")))
    q = corner.groupBy("r", "c").agg(*(at(k).alias(f"z{k}") for k in range(4)), F.count("*").alias("n")).where("n = 4")
    q = q.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return q.selectExpr("r*3+i AS r", "c*3+j AS c", "round((z0*(1-j/3D)+z1*j/3D)*(1-i/3D)+(z2*(1-j/3D)+z3*j/3D)*i/3D, 4) AS alt")


@query(R + "SELECT r, c, count(*) AS tiles, round(avg(alt), 5) AS alt FROM (SELECT r, c, alt::DOUBLE AS alt FROM raster UNION ALL SELECT r, c, alt+1 FROM raster WHERE r%10=0 AND r > 0 UNION ALL SELECT r, c, alt+2 FROM raster WHERE c%10=0 AND c > 0 UNION ALL SELECT r, c, alt+3 FROM raster WHERE r%10=0 AND c%10=0 AND r > 0 AND c > 0) GROUP BY ALL")
def ar14_shared_border(spark, sf_dir):
    """A border post is the mean of the two to four tiles that carry it."""
    own = raster(spark, sf_dir)
    side = [own, *(own.where(w).withColumn("alt", F.col("alt") + k) for k, w in ((1, "r%10=0 AND r > 0"), (2, "c%10=0 AND c > 0"), (3, "r%10=0 AND c%10=0 AND r > 0 AND c > 0")))]
    return reduce(DataFrame.unionByName, side).groupBy("r", "c").agg(F.count("*").alias("tiles"), F.round(F.avg("alt"), 5).alias("alt"))


@query(R + "SELECT CAST(tr AS BIGINT) AS tr, CAST(tc AS BIGINT) AS tc, count(*) AS posts, sum(alt)::DOUBLE AS total FROM raster, range(0, 6) a(tr), range(0, 6) b(tc) WHERE r BETWEEN tr*10-2 AND tr*10+11 AND c BETWEEN tc*10-2 AND tc*10+11 AND EXISTS (SELECT 1 FROM raster q WHERE q.r//10 = tr AND q.c//10 = tc) GROUP BY ALL")
def ar15_mosaic(spark, sf_dir):
    """Tiles of ten posts with two of their neighbours': posts are keyed by every tile they serve; none is copied by hand."""
    own = raster(spark, sf_dir)
    serve = lambda n: F.array_distinct(F.transform(F.array(F.lit(-2), F.lit(0), F.lit(2)), lambda d: F.floor((F.col(n) + d) / 10)))
    tiles = own.selectExpr("r div 10 AS tr", "c div 10 AS tc").distinct()
    p = own.withColumn("tr", F.explode(serve("r"))).withColumn("tc", F.explode(serve("c")))
    return p.groupBy("tr", "tc").agg(F.count("*").alias("posts"), F.sum("alt").alias("total")).join(tiles, ["tr", "tc"], "left_semi")


#: Share of lamps that are out; share lit where nobody lives, and the density from which all are; light of a lamp in the country; share of white roads.
LAMPS_OUT, LIT_SHARE_MIN, LIT_FULL, LAMP_COUNTRY, WHITE_SHARE = 0.08, 0.2, 0.12, 0.5, 0.3
#: Pixels of a texture's side.
LIT_SIDE = 64


def drawn(*parts: Column | str) -> Column:
    """A number in [0, 1) that a seed and what it is for always give alike."""
    text = F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _drawn(*parts: str) -> str:
    return f"(CAST('0x'||substr(md5({'||'.join(parts)}), 1, 8) AS BIGINT)/{1 << 32}e0)"


def night_lamps(points: DataFrame, density: DataFrame, textures: float) -> DataFrame:
    """(way, nth, white, level, tx, ty, px, py) of the lamps that burn: one each spacing along a road from a start drawn for it.

    ``points``: way, pos, node, x, y, spacing, bright, and rows and columns, the posts to a length of 1; ``density``: r, c, d
    by posts, read between four, 0 where one is missing: the four are one row, so a lamp looks once. A share of lamps is out by
    the draw, and more the fewer people live there; a lamp's light is drawn and grows with them. ``textures``: how many
    there are to a length of 1.
    """
    w = Window.partitionBy("way").orderBy("pos", "node")
    far = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)), F.lit(0.0))
    p = points.withColumn("far", far).withColumn("along", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("to", F.lead("along").over(w)).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).where("to > along")
    p = p.withColumn("offset", drawn("start", F.col("way")) * F.col("spacing"))
    first = lambda k: F.greatest(F.ceil((F.col(k) - F.col("offset")) / F.col("spacing")), F.lit(0))
    p = p.where(first("to") > first("along")).withColumn("nth", F.explode(F.sequence(first("along"), first("to") - 1)))
    g = (F.col("offset") + F.col("nth") * F.col("spacing") - F.col("along")) / (F.col("to") - F.col("along"))
    lamp = p.where(drawn("out", F.col("way"), F.col("nth")) > LAMPS_OUT).select("way", "nth", "bright", "rows", "columns", (F.col("x") + g * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + g * (F.col("y2") - F.col("y"))).alias("y"))
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    z = lambda i, j: F.max(F.when((F.col("q.i") == i) & (F.col("q.j") == j), F.col("d"))).alias(f"_z{i}{j}")
    squares = density.select("r", "c", "d", corner.alias("q")).groupBy((F.col("r") - F.col("q.i")).alias("_r"), (F.col("c") - F.col("q.j")).alias("_c")).agg(*(z(i, j) for i in (0, 1) for j in (0, 1)), F.count("*").alias("_k")).where("_k = 4").drop("_k")
    at = lamp.withColumn("_y", F.col("y") * F.col("rows")).withColumn("_x", F.col("x") * F.col("columns"))
    at = at.withColumn("_r", F.floor("_y").cast("long")).withColumn("_c", F.floor("_x").cast("long"))
    part = lambda n, side: F.col(n) - F.floor(n) if side else 1 - F.col(n) + F.floor(n)
    between = reduce(lambda a, b: a + b, (F.col(f"_z{i}{j}") * part("_y", i) * part("_x", j) for i in (0, 1) for j in (0, 1)))
    lit = at.join(squares, ["_r", "_c"], "left").withColumn("d", F.coalesce(between, F.lit(0.0)))
    lit = lit.where(drawn("lit", F.col("way"), F.col("nth")) < LIT_SHARE_MIN + (1 - LIT_SHARE_MIN) * F.least(F.col("d") / LIT_FULL, F.lit(1.0)))
    level = F.col("bright") * (0.35 + 0.45 * drawn("light", F.col("way"), F.col("nth"))) * (LAMP_COUNTRY + 2 * (1 - LAMP_COUNTRY) * F.col("d"))
    cell = lambda n: F.floor(F.col(n) * textures)
    pixel = lambda n: F.floor((F.col(n) * textures - cell(n)) * LIT_SIDE)
    return lit.select("way", "nth", (drawn("white", F.col("way")) < WHITE_SHARE).alias("white"), level.alias("level"), cell("x").alias("tx"), cell("y").alias("ty"), pixel("x").alias("px"), pixel("y").alias("py"))


_P = "SELECT DISTINCT w.way, w.pos, w.node, n.x, n.y FROM ways w JOIN nodes n ON n.id = w.node"


@query(cte("ways", "nodes", "raster") + f""", p AS ({_P}), a AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)^2+(y-lag(y) OVER w)^2), 0) AS far FROM p WINDOW w AS (PARTITION BY way ORDER BY pos, node)),
b AS (SELECT *, sum(far) OVER (PARTITION BY way ORDER BY pos, node ROWS UNBOUNDED PRECEDING) AS along FROM a),
s AS (SELECT *, lead(along) OVER w AS nxt, lead(x) OVER w AS x2, lead(y) OVER w AS y2, 1/(10e0+way%3*5) AS spacing, {_drawn("'start/'", 'way')}/(10e0+way%3*5) AS off FROM b WINDOW w AS (PARTITION BY way ORDER BY pos, node)),
l AS (SELECT way, nth, x+(off+nth*spacing-along)/(nxt-along)*(x2-x) AS x, y+(off+nth*spacing-along)/(nxt-along)*(y2-y) AS y FROM (SELECT *, unnest(range(CAST(greatest(ceil((along-off)/spacing), 0) AS BIGINT), CAST(greatest(ceil((nxt-off)/spacing), 0) AS BIGINT))) AS nth FROM s WHERE nxt > along) WHERE {_drawn("'out/'", 'way', "'/'", 'nth')} > {LAMPS_OUT}),
d AS (SELECT way, nth, count(*) AS k, sum(alt/500e0*(1-abs(y*38-r))*(1-abs(x*48-c))) AS d FROM l JOIN raster ON r BETWEEN floor(y*38) AND floor(y*38)+1 AND c BETWEEN floor(x*48) AND floor(x*48)+1 AND alt > -32768 GROUP BY way, nth HAVING count(*) = 4),
m AS (SELECT l.*, coalesce(d.d, 0) AS d FROM l LEFT JOIN d USING (way, nth)),
q AS (SELECT *, {_drawn("'white/'", 'way')} < {WHITE_SHARE} AS white, (1+way%2)*(0.35e0+0.45e0*{_drawn("'light/'", 'way', "'/'", 'nth')})*({LAMP_COUNTRY}+{2 * (1 - LAMP_COUNTRY)}*d) AS level FROM m WHERE {_drawn("'lit/'", 'way', "'/'", 'nth')} < {LIT_SHARE_MIN}+{1 - LIT_SHARE_MIN}*least(d/{LIT_FULL}, 1)),
t AS (SELECT CAST(floor(x*40) AS BIGINT) AS tx, CAST(floor(y*40) AS BIGINT) AS ty, floor((x*40-floor(x*40))*{LIT_SIDE}) AS px, floor((y*40-floor(y*40))*{LIT_SIDE}) AS py, white, max(level) AS level, count(*) AS n FROM q GROUP BY ALL)
SELECT tx, ty, CAST(sum(n) AS BIGINT) AS lamps, count(*) FILTER (white) AS white_pixels, count(*) FILTER (NOT white) AS sodium_pixels, round(sum(level), 4) AS light FROM t GROUP BY ALL""")
def ag41_night_lamps(spark, sf_dir):
    """Lamps by texture: how many, on how many pixels of either colour, and their light, the brightest of a pixel."""
    from .maps import track

    roads = track(spark, sf_dir).select("way", "pos", "node", "x", "y").distinct().selectExpr("*", "1/(10D+way%3*5) AS spacing", "1D+way%2 AS bright", "38D AS rows", "48D AS columns")
    people = raster(spark, sf_dir).where(f"alt > {VOID}").select("r", "c", (F.col("alt") / 500).alias("d"))
    t = night_lamps(roads, people, 40.0).groupBy("tx", "ty", "px", "py", "white").agg(F.max("level").alias("level"), F.count("*").alias("n"))
    return t.groupBy("tx", "ty").agg(F.sum("n").alias("lamps"), F.count_if("white").alias("white_pixels"), F.count_if(~F.col("white")).alias("sodium_pixels"), F.round(F.sum("level"), 4).alias("light"))


@query("SELECT cell, path, points FROM (SELECT p_partkey%100 AS cell, p_name||'.'||p_partkey AS path, p_size AS points, row_number() OVER (PARTITION BY p_partkey%100 ORDER BY p_size DESC, CASE WHEN p_brand < 'Brand#3' THEN 0 ELSE 1 END, p_name||'.'||p_partkey) AS rn FROM part) WHERE rn = 1")
def ag45_finest_file(spark, sf_dir):
    """The candidate with most points, then by kind, then by path."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey%100 AS cell", "concat(p_name, '.', p_partkey) AS path", "p_size AS points", "CASE WHEN p_brand < 'Brand#3' THEN 0 ELSE 1 END AS kind")
    return p.groupBy("cell").agg(F.min(F.struct(-F.col("points"), "kind", "path", "points")).alias("b")).select("cell", "b.path", "b.points")


# Areas with seven corners, not all of them convex, on the raster; posts stand on whole numbers, corners never do.
_RADIUS = "(3+c_custkey%4)*CASE WHEN {k}%3=1 THEN 0.55e0 ELSE 1e0 END"
VIEWS["areas"] = (
    "customer",
    ["c_custkey AS area", "(c_custkey*29)%430/10e0+0.0317e0 AS cy", "(c_custkey*71)%520/10e0+0.0171e0 AS cx", *(f"{_RADIUS.format(k=k)}*{f}({k}*2*pi()/7) AS {n}{k}" for k in range(7) for n, f in (("u", "cos"), ("v", "sin")))],
)
AREA_EDGES = [(k, (k + 1) % 7) for k in range(7)]
#: Of posts one in so many each way is a sample; samples of a block each way; metres above which a post is land.
STRIDE, BLOCK, LAND_M = 4, 4, 250.0


def ring_of_area() -> tuple[str, str]:
    return (f"array({', '.join(f'{c}+{n}{k}' for k in range(7))})" for c, n in (("cx", "u"), ("cy", "v")))


#: Whether a point (px, py) lies in a ring of corners xs, ys: it does if an odd number of edges pass on its east.
IN_RING = "aggregate(sequence(0, size(xs)-1), 0, (n, i) -> n + CASE WHEN (ys[i] > {py}) <> (ys[(i+1)%size(xs)] > {py}) AND {px} < (xs[(i+1)%size(xs)]-xs[i])*({py}-ys[i])/(ys[(i+1)%size(xs)]-ys[i])+xs[i] THEN 1 ELSE 0 END) % 2 = 1"


def land_shares(areas: DataFrame, posts: DataFrame, land_m: float, stride: int = STRIDE, block: int = BLOCK) -> DataFrame:
    """(area, posts, land): of the sampled posts inside each area how many there are, and how many are land.

    ``areas``: area, xs, ys (corners of a ring, in raster units); ``posts``: r, c, alt without voids. One post in
    ``stride`` each way is sampled. Samples are summed up by blocks first; a block that no edge's box touches lies
    wholly inside or outside and counts as one row; only samples of the other blocks are tested. An area without
    samples gives no row.
    """
    side = stride * block
    s = posts.where(f"r % {stride} = 0 AND c % {stride} = 0").withColumn("br", F.floor(F.col("r") / side)).withColumn("bc", F.floor(F.col("c") / side))
    sums = s.groupBy("br", "bc").agg(F.count("*").alias("n"), F.count_if(F.col("alt") > land_m).alias("land"), F.collect_list(F.struct("r", "c", (F.col("alt") > land_m).alias("land"))).alias("own"))
    sums = sums.selectExpr("*", f"double(bc*{side}) AS w", f"double(br*{side}) AS s", f"double(bc*{side}+{side - stride}) AS e", f"double(br*{side}+{side - stride}) AS n2")
    a = areas.selectExpr("*", "array_min(xs) AS aw", "array_min(ys) AS as_", "array_max(xs) AS ae", "array_max(ys) AS an")
    j = box_join(a, sums, float(side), ("aw", "as_", "ae", "an"), ("w", "s", "e", "n2"))
    near = "exists(sequence(0, size(xs)-1), i -> least(xs[i], xs[(i+1)%size(xs)]) <= e AND greatest(xs[i], xs[(i+1)%size(xs)]) >= w AND least(ys[i], ys[(i+1)%size(xs)]) <= n2 AND greatest(ys[i], ys[(i+1)%size(xs)]) >= s)"
    j = j.withColumn("near", F.expr(near))
    whole = j.where("NOT near").where(F.expr(IN_RING.format(px="w", py="s"))).select("area", "n", "land")
    tested = j.where("near").select("area", "xs", "ys", F.explode("own").alias("p")).where(F.expr(IN_RING.format(px="p.c", py="p.r"))).selectExpr("area", "1L AS n", "CASE WHEN p.land THEN 1L ELSE 0L END AS land")
    return whole.unionByName(tested).groupBy("area").agg(F.sum("n").alias("posts"), F.sum("land").alias("land"))


@query(cte("areas", "raster") + f""", g AS (SELECT area, unnest([{', '.join(f'cx+u{i}' for i, _ in AREA_EDGES)}]) AS x1, unnest([{', '.join(f'cy+v{i}' for i, _ in AREA_EDGES)}]) AS y1, unnest([{', '.join(f'cx+u{k}' for _, k in AREA_EDGES)}]) AS x2, unnest([{', '.join(f'cy+v{k}' for _, k in AREA_EDGES)}]) AS y2 FROM areas),
h AS (SELECT area, r, c, any_value(alt) AS alt FROM g JOIN raster ON (y1 > r) <> (y2 > r) AND c < (x2-x1)*(r-y1)/(y2-y1)+x1 WHERE r%{STRIDE}=0 AND c%{STRIDE}=0 AND alt > -32768 GROUP BY area, r, c HAVING count(*)%2 = 1)
SELECT area, count(*) AS posts, round(avg(CASE WHEN alt > {LAND_M} THEN 1e0 ELSE 0 END), 5) AS share FROM h GROUP BY area""")
def ag46_land_share(spark, sf_dir):
    """The share of land among the sampled posts inside each area, voids left out."""
    xs, ys = ring_of_area()
    areas = view(spark, sf_dir, "areas").selectExpr("area", f"{xs} AS xs", f"{ys} AS ys")
    s = land_shares(areas, raster(spark, sf_dir).where(f"alt > {VOID}"), LAND_M)
    return s.select("area", "posts", F.round(F.col("land") / F.col("posts"), 5).alias("share"))


@query(R + "SELECT r//13 AS br, c//13 AS bc, count(*) AS posts, min(alt)::DOUBLE AS low, max(alt)::DOUBLE AS high FROM raster WHERE r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 40 GROUP BY ALL")
def src6_read_elevation_window(spark, sf_dir):
    """Blocks written by block, then only those read that meet a box: the filter prunes folders."""
    from ..operators.joins import shared_dir

    own = raster(spark, sf_dir).selectExpr("*", "r div 13 AS br", "c div 13 AS bc")
    path = shared_dir(own, "blocks")
    own.repartition("br", "bc").write.partitionBy("br", "bc").parquet(path)
    box = spark.read.parquet(path).where("br BETWEEN 0 AND 2 AND bc BETWEEN 0 AND 3 AND r BETWEEN 5 AND 30 AND c BETWEEN 8 AND 40")
    return box.groupBy(F.col("br").cast("long").alias("br"), F.col("bc").cast("long").alias("bc")).agg(F.count("*").alias("posts"), F.min("alt").alias("low"), F.max("alt").alias("high"))
