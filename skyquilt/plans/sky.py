"""Clouds: finding blobs, judging and ranking sources, laying clouds into textures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, view
from ..operators.joins import box_join, connected_components, written
from ..registry import query

VIEWS["clouds"] = ("supplier", ["s_suppkey AS cloud", "CAST((s_suppkey*37)%97 AS DOUBLE) AS w", "CAST((s_suppkey*53)%89 AS DOUBLE) AS s", "CAST((s_suppkey*37)%97 AS DOUBLE)+1.5e0+s_suppkey%4 AS e", "CAST((s_suppkey*53)%89 AS DOUBLE)+1.25e0+s_suppkey%3 AS n"])
VIEWS["answers"] = ("embeddings", ["label AS cloud", "concat('S', CAST(vec_id%9 AS VARCHAR(4))) AS source", "CASE vec_id%4 WHEN 0 THEN 'clear' WHEN 1 THEN 'cloudy' ELSE 'other' END AS answer", "CAST(vec_id%17 AS DOUBLE) AS blur", "CAST((vec_id*7)%23 AS DOUBLE) AS fit"])


@query(cte("pixels") + """, j AS (SELECT cloud, px%3 AS source, count(*) AS n, avg(CASE WHEN have THEN 1.0e0 ELSE 0 END) AS coverage, corr(here, src) FILTER (have AND core) AS r, stddev_pop(here) FILTER (have) / nullif(stddev_pop(src) FILTER (have), 0) AS gain, avg(here) FILTER (have) AS mh, avg(src) FILTER (have) AS ms FROM pixels GROUP BY 1, 2)
SELECT cloud, source, round(coverage, 5) AS coverage, round(r, 5) AS r, round(gain, 5) AS gain, round(mh - gain*ms, 3) AS shift, CASE WHEN coverage < 0.5e0 THEN 'none' WHEN r >= 0.9e0 THEN 'same' WHEN r >= 0.1e0 THEN 'clear' ELSE 'cloudy' END AS fit FROM j""")
def ag33_judge_source(spark, sf_dir):
    """Coverage, likeness under the core, and the linear change that brings a source to the photo round it."""
    p = view(spark, sf_dir, "pixels").withColumn("source", F.expr("px%3"))
    have = lambda c: F.when(F.col("have"), F.col(c))
    core = F.col("have") & F.col("core")
    j = p.groupBy("cloud", "source").agg(
        F.avg(F.col("have").cast("double")).alias("coverage"), F.corr(F.when(core, F.col("here")), F.when(core, F.col("src"))).alias("r"),
        (F.stddev_pop(have("here")) / F.nullif(F.stddev_pop(have("src")), F.lit(0.0))).alias("gain"), F.avg(have("here")).alias("mh"), F.avg(have("src")).alias("ms"),
    )
    fit = F.when(F.col("coverage") < 0.5, "none").when(F.col("r") >= 0.9, "same").when(F.col("r") >= 0.1, "clear").otherwise("cloudy")
    return j.select("cloud", "source", F.round("coverage", 5).alias("coverage"), F.round("r", 5).alias("r"), F.round("gain", 5).alias("gain"), F.round(F.expr("mh - gain*ms"), 3).alias("shift"), fit.alias("fit"))


@query(cte("answers") + "SELECT DISTINCT cloud, source, answer FROM answers WHERE answer <> 'other' AND blur < 12")
def fl18_quality_answers(spark, sf_dir):
    return view(spark, sf_dir, "answers").where("answer <> 'other' AND blur < 12").select("cloud", "source", "answer").distinct()


@query(cte("answers") + ", d AS (SELECT cloud, source, min(CASE answer WHEN 'clear' THEN 0 WHEN 'cloudy' THEN 1 ELSE 2 END) AS a, min(blur) AS blur, min(fit) AS fit FROM answers GROUP BY ALL) SELECT cloud, source, row_number() OVER (PARTITION BY cloud ORDER BY a, blur, fit, source) AS rank FROM d")
def wn22_rank_sources(spark, sf_dir):
    order = F.when(F.col("answer") == "clear", 0).when(F.col("answer") == "cloudy", 1).otherwise(2)
    d = view(spark, sf_dir, "answers").groupBy("cloud", "source").agg(F.min(order).alias("a"), F.min("blur").alias("blur"), F.min("fit").alias("fit"))
    return d.select("cloud", "source", F.row_number().over(Window.partitionBy("cloud").orderBy("a", "blur", "fit", "source")).alias("rank"))


@query(cte("clouds") + "SELECT cloud, round((e-w)*(n-s), 4) AS area FROM clouds WHERE (e-w)*(n-s) > 2 ORDER BY area DESC, cloud LIMIT 200")
def tk10_largest_clouds(spark, sf_dir):
    c = view(spark, sf_dir, "clouds").select("cloud", F.round(F.expr("(e-w)*(n-s)"), 4).alias("area"))
    return c.where("area > 2").orderBy(F.desc("area"), "cloud").limit(200)


#: Longest run of cells in a row.
RUN = 256


def cell_components(cells: DataFrame) -> DataFrame:
    """Cells (x, y) with the number of their blob, joined over edges and corners.

    Cells side by side in a row are a run, named by its first; runs end at multiples of RUN, so no task sorts a row.
    Two runs of neighbouring rows touch if a cell of the upper one is below the next one's first cell or a step to its
    side, or a cell of the lower one above the step before the upper's first, so a run looks at five places however
    many cells it has, and the links are between runs.
    """
    w = Window.partitionBy("y", "_block").orderBy("x")
    own = cells.select("x", "y", F.floor(F.col("x") / RUN).alias("_block")).withColumn("_run", F.col("x") - F.row_number().over(w))
    own = own.withColumn("id", F.min("x").over(Window.partitionBy("y", "_block", "_run"))).select("x", "y", F.expr("y*4294967296 + id + 2147483648").alias("id"), (F.col("x") == F.col("id")).alias("first"))  # both in one number, also below 0
    own = written(own, "runs")
    places = F.expr("explode(array(named_struct('dx', -1, 'dy', 0), named_struct('dx', -1, 'dy', -1), named_struct('dx', 0, 'dy', -1), named_struct('dx', 1, 'dy', -1), named_struct('dx', -1, 'dy', 1)))")
    looks = own.where("first").select("id", "x", "y", places.alias("d")).selectExpr("id AS a", "x+d.dx AS x", "y+d.dy AS y")
    links = looks.join(own.select(F.col("id").alias("b"), "x", "y"), ["x", "y"]).select("a", "b")
    roots = connected_components(links)
    return own.join(roots, own["id"] == roots["node"], "left").select("x", "y", F.coalesce("root", "id").alias("blob"))


def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the cells within a radius."""
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span if dx * dx + dy * dy <= radius * radius]


def spread(cells: DataFrame, radius: int) -> DataFrame:
    """Every cell (x, y) dealt out to all cells within the radius; other columns go with it."""
    offsets = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in disc(radius)))
    own = [c for c in cells.columns if c not in ("x", "y")]
    return cells.withColumn("d", F.explode(offsets)).select(*own, (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"))


def grown(cells: DataFrame, radius: int) -> DataFrame:
    return spread(cells.select("x", "y"), radius).distinct()


def shrunk(cells: DataFrame, radius: int) -> DataFrame:
    """Cells all of whose neighbours within the radius are there: each cell votes for those around it."""
    return spread(cells.select("x", "y"), radius).groupBy("x", "y").count().where(F.col("count") == len(disc(radius))).select("x", "y")


def cloud_areas(cells: DataFrame, least: int, grow: int = 2, close: int = 3, reach: int = 4, whole: float = 2.0) -> DataFrame:
    """(area, clouds, shadows, west, east, south, north): clouds with the shadows beside them.

    ``cells``: x, y, kind ('cloud' or 'shadow'). Cloud cells are grown, gaps are closed, and cells that touch over
    edges or corners make a blob; one of fewer than ``least`` cloud cells goes. Shadow cells within reach of a blob
    and outside it are its shadow; a whole shade that any of them belongs to is, unless it is over ``whole`` times as
    large as the cloud. Blobs that share a shadow cell, through any chain, are one area, so a shadow has one owner.
    An area is named by its smallest blob, a blob by its smallest cell. Cells are joined by place alone: dilation deals
    a cell out to the disc around it, so work grows with the cells that are there.
    """
    cells = written(cells, "sky-cells")
    cloud, shadow = (cells.where(F.col("kind") == k).select("x", "y") for k in ("cloud", "shadow"))
    blobs = written(cell_components(written(shrunk(grown(grown(cloud, grow), close), close), "grown")), "blobs")
    size = blobs.join(cloud, ["x", "y"]).groupBy("blob").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    blobs = written(blobs.join(size, "blob"), "large-blobs")
    shades = written(cell_components(shadow).withColumnRenamed("blob", "shade"), "shades")
    touched = spread(shades.selectExpr("x", "y", "x AS sx", "y AS sy"), reach).join(blobs.select("x", "y", "blob"), ["x", "y"])
    outside = shades.join(blobs.select("x", "y", F.col("blob").alias("own")), ["x", "y"], "left")
    beside = touched.select("blob", F.col("sx").alias("x"), F.col("sy").alias("y")).distinct().join(outside, ["x", "y"]).where("own IS NULL OR own <> blob").select("blob", "x", "y", "shade")
    beside = written(beside, "beside")
    sizes = shades.groupBy("shade").agg(F.count("*").alias("m"))
    taken = beside.select("blob", "shade").distinct().join(sizes, "shade").join(size, "blob").where(F.col("m") <= whole * F.col("n")).select("blob", "shade")
    owned = written(beside.select("blob", "x", "y").unionByName(taken.join(shades, "shade").select("blob", "x", "y")).distinct(), "owned")
    first = owned.groupBy("x", "y").agg(F.min("blob").alias("b"))
    roots = connected_components(owned.join(first, ["x", "y"]).select(F.col("blob").alias("a"), "b"))
    area = size.join(roots, size["blob"] == roots["node"], "left").select("blob", "n", F.coalesce("root", "blob").alias("area"))
    area = written(area, "areas")
    cores = blobs.join(cloud, ["x", "y"]).join(area.select("blob", "area"), "blob").select("area", "x", "y", F.lit(1).alias("cloud"))
    dark = owned.join(area.select("blob", "area"), "blob").select("area", "x", "y").distinct().withColumn("cloud", F.lit(0))
    box = (f(c).alias(n) for f, c, n in ((F.min, "x", "west"), (F.max, "x", "east"), (F.min, "y", "south"), (F.max, "y", "north")))
    return cores.unionByName(dark).groupBy("area").agg(F.sum("cloud").alias("clouds"), F.sum(1 - F.col("cloud")).alias("shadows"), *box)


# Fifteen hundred keys share a picture of 80 by 80 cells; pictures stand apart from each other.
VIEWS["sky"] = ("part", ["CAST(floor(p_retailprice) AS BIGINT)*7%80 + CAST(floor(p_partkey/1500) AS BIGINT)*1000 AS x", "(p_partkey*31+p_size*7)%80 AS y", "CASE WHEN p_size >= 47 THEN 'cloud' ELSE 'shadow' END AS kind", "p_size"])
DISC = {k: "(VALUES " + ", ".join(map(str, disc(k))) + f") d{k}(dx, dy)" for k in (2, 3, 4)}
BLOBS = "{r}(x, y, root) AS (SELECT x, y, y*4294967296 + x + 2147483648 FROM {c} UNION SELECT c.x, c.y, r.root FROM {r} r JOIN {c} c ON abs(c.x-r.x) <= 1 AND abs(c.y-r.y) <= 1)"


@query("WITH RECURSIVE " + cte("sky").removeprefix("WITH ") + f""", cell AS (SELECT DISTINCT x, y, kind FROM sky WHERE p_size >= 47 OR p_size <= 4), cl AS (SELECT x, y FROM cell WHERE kind = 'cloud'), sh AS (SELECT x, y FROM cell WHERE kind = 'shadow'),
g2 AS (SELECT DISTINCT x+dx AS x, y+dy AS y FROM cl, {DISC[2]}), g3 AS (SELECT DISTINCT x+dx AS x, y+dy AS y FROM g2, {DISC[3]}), g AS (SELECT x+dx AS x, y+dy AS y FROM g3, {DISC[3]} GROUP BY 1, 2 HAVING count(*) = {len(disc(3))}),
{BLOBS.format(r='r', c='g')}, {BLOBS.format(r='q', c='sh')},
b0 AS (SELECT x, y, min(root) AS blob FROM r GROUP BY ALL), size AS (SELECT blob, count(*) AS n FROM b0 JOIN cl USING (x, y) GROUP BY blob HAVING count(*) >= 3), b AS (SELECT b0.* FROM b0 JOIN size USING (blob)),
s AS (SELECT x, y, min(root) AS shade FROM q GROUP BY ALL), m AS (SELECT shade, count(*) AS m FROM s GROUP BY ALL),
t AS (SELECT DISTINCT b.blob, s.x, s.y, s.shade FROM s, {DISC[4]} JOIN b ON b.x = s.x+dx AND b.y = s.y+dy), beside AS (SELECT t.* FROM t LEFT JOIN b o ON o.x = t.x AND o.y = t.y WHERE o.blob IS NULL OR o.blob <> t.blob),
own AS (SELECT blob, x, y FROM beside UNION SELECT k.blob, s.x, s.y FROM (SELECT DISTINCT blob, shade FROM beside) k JOIN m USING (shade) JOIN size USING (blob) JOIN s USING (shade) WHERE m <= 2*n),
lk AS (SELECT DISTINCT a.blob AS a, b.blob AS b FROM own a JOIN own b USING (x, y)), w(blob, area) AS (SELECT blob, blob FROM size UNION SELECT lk.b, w.area FROM w JOIN lk ON lk.a = w.blob), ar AS (SELECT blob, min(area) AS area FROM w GROUP BY blob),
e AS (SELECT area, x, y, 1 AS cloud FROM b JOIN cl USING (x, y) JOIN ar USING (blob) UNION ALL SELECT DISTINCT area, x, y, 0 FROM own JOIN ar USING (blob))
SELECT area, CAST(sum(cloud) AS BIGINT) AS clouds, CAST(sum(1-cloud) AS BIGINT) AS shadows, min(x) AS west, max(x) AS east, min(y) AS south, max(y) AS north FROM e GROUP BY area""")
def it7_label_blobs(spark, sf_dir):
    """Clouds of three cells at least, grown, grouped and with their shadows."""
    return cloud_areas(view(spark, sf_dir, "sky").where("p_size >= 47 OR p_size <= 4").select("x", "y", "kind").distinct(), 3)


@query(cte("clouds") + ", tex AS (SELECT DISTINCT CAST(floor(w/4) AS BIGINT) AS tx, CAST(floor(s/4) AS BIGINT) AS ty FROM clouds) SELECT cloud, tx, ty, round(greatest(w, tx*4)-tx*4, 4) AS left_px, round(greatest(s, ty*4)-ty*4, 4) AS low_px FROM clouds JOIN tex ON w <= tx*4+4 AND e >= tx*4 AND s <= ty*4+4 AND n >= ty*4")
def jn38_clouds_in_textures(spark, sf_dir):
    """Each cloud in every texture that its box reaches, in the texture's own measure."""
    c = view(spark, sf_dir, "clouds")
    t = c.select(F.floor(F.col("w") / 4).alias("tx"), F.floor(F.col("s") / 4).alias("ty")).distinct().selectExpr("*", "double(tx*4) AS tw", "double(ty*4) AS ts", "double(tx*4+4) AS te", "double(ty*4+4) AS tn")
    hit = box_join(c, t, 4.0, ("w", "s", "e", "n"), ("tw", "ts", "te", "tn"))
    return hit.select("cloud", "tx", "ty", F.round(F.greatest("w", "tw") - F.col("tw"), 4).alias("left_px"), F.round(F.greatest("s", "ts") - F.col("ts"), 4).alias("low_px"))


LIST = "SELECT CAST(floor(w/8) AS BIGINT) AS tx, CAST(floor(s/8) AS BIGINT) AS ty, sha256(string_agg(cloud, ',' ORDER BY cloud)) AS d FROM clouds WHERE {} GROUP BY 1, 2"


@query(cte("clouds") + f"SELECT tx, ty, a.d IS NULL AS gone, b.d IS NULL AS fresh FROM ({LIST.format('cloud%5 <> 0')}) a FULL JOIN ({LIST.format('cloud%7 <> 0')}) b USING (tx, ty) WHERE a.d IS DISTINCT FROM b.d")
def jn39_textures_to_redo(spark, sf_dir):
    """Textures whose set of clouds, as a digest free of order, is not the one they show."""

    def digest(where: str, name: str) -> DataFrame:
        ids = F.array_join(F.transform(F.sort_array(F.collect_list("cloud")), lambda v: v.cast("string")), ",")
        return view(spark, sf_dir, "clouds").where(where).groupBy(F.floor(F.col("w") / 8).alias("tx"), F.floor(F.col("s") / 8).alias("ty")).agg(F.sha2(ids, 256).alias(name))

    j = digest("cloud%5 <> 0", "a").join(digest("cloud%7 <> 0", "b"), ["tx", "ty"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("tx", "ty", F.col("a").isNull().alias("gone"), F.col("b").isNull().alias("fresh"))


@query(cte("clouds") + ", o AS (SELECT a.cloud AS found, b.cloud AS listed, row_number() OVER (PARTITION BY a.cloud ORDER BY b.cloud) AS rn FROM clouds a JOIN clouds b ON a.cloud%2 = 0 AND b.cloud%2 = 1 AND a.w < b.e AND b.w < a.e AND a.s < b.n AND b.s < a.n), m AS (SELECT found, listed FROM (SELECT *, row_number() OVER (PARTITION BY listed ORDER BY found) AS k FROM o WHERE rn = 1) WHERE k = 1) SELECT cloud, CASE WHEN m.found IS NOT NULL THEN 'updated' ELSE 'new' END AS state, m.listed AS other FROM clouds LEFT JOIN m ON found = cloud WHERE cloud%2 = 0 UNION ALL SELECT cloud, 'dropped', NULL FROM clouds WHERE cloud%2 = 1 AND cloud NOT IN (SELECT listed FROM m) AND cloud%3 <> 0")
def jn33_same_or_new(spark, sf_dir):
    """Found clouds against listed ones, one to one: updated, new, or dropped where nothing holds them."""
    c = view(spark, sf_dir, "clouds")
    found, listed = c.where("cloud%2 = 0"), c.where("cloud%2 = 1").toDF("listed", "w2", "s2", "e2", "n2")
    pairs = box_join(found, listed, 4.0, ("w", "s", "e", "n"), ("w2", "s2", "e2", "n2")).where("w < e2 AND w2 < e AND s < n2 AND s2 < n")
    first = pairs.groupBy("cloud").agg(F.min("listed").alias("listed"))
    m = first.groupBy("listed").agg(F.min("cloud").alias("found"))
    left = found.join(m, F.col("cloud") == F.col("found"), "left").select("cloud", F.when(F.col("found").isNotNull(), "updated").otherwise("new").alias("state"), F.col("listed").alias("other"))
    gone = listed.where("listed%3 <> 0").join(m.select("listed"), "listed", "left_anti").select(F.col("listed").alias("cloud"), F.lit("dropped").alias("state"), F.lit(None).cast("long").alias("other"))
    return left.unionByName(gone)


@query(cte("clouds", "chunks") + ", t AS (SELECT provider, x//64 AS tx, y//64 AS ty, 10+max(ln) AS zl FROM chunks GROUP BY ALL) SELECT cloud, provider, least(max(zl), 16) AS top FROM clouds JOIN t ON tx BETWEEN floor(w/2) AND floor(e/2) AND ty BETWEEN floor(s/2) AND floor(n/2) GROUP BY ALL")
def ag44_source_tops(spark, sf_dir):
    """The sharpest level of a source under a cloud."""
    t = view(spark, sf_dir, "chunks").groupBy("provider", F.expr("x div 64").alias("tx"), F.expr("y div 64").alias("ty")).agg((10 + F.max("ln")).alias("zl"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 2), F.floor(F.col(b) / 2)))
    c = view(spark, sf_dir, "clouds").withColumn("tx", span("w", "e")).withColumn("ty", span("s", "n"))
    return c.join(t, ["tx", "ty"]).groupBy("cloud", "provider").agg(F.least(F.max("zl"), F.lit(16)).alias("top"))
