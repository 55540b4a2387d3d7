"""Mesh tables: corners, types, edges, crossings, buckets, smoothing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, view
from ..functions import geo
from ..operators.joins import box_join, cells, connected_components, written
from ..registry import query

def corners(spark, sf_dir) -> DataFrame:
    """Triangles with their corners' coordinates; corners without a node drop the triangle."""
    t, nodes = view(spark, sf_dir, "triangles"), view(spark, sf_dir, "nodes")
    for i in (1, 2, 3):
        t = t.join(nodes.select(F.col("id").alias(f"v{i}"), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"), F.col("z").alias(f"z{i}")), f"v{i}")
    return t


def sums(spark, sf_dir, axes: str) -> DataFrame:
    """Triangles (v1, v2, v3, n) with the sums of their corners' coordinates: each join adds to them, so no shuffle carries more than one corner's."""
    t, nodes = view(spark, sf_dir, "triangles").select("v1", "v2", "v3", "n"), view(spark, sf_dir, "nodes")
    for i in (1, 2, 3):
        corner = nodes.select(F.col("id").alias(f"v{i}"), *(F.col(k).alias(f"_{k}") for k in axes))
        t = t.join(corner, f"v{i}").select("v1", "v2", "v3", "n", *((F.col(f"s{k}") + F.col(f"_{k}") if i > 1 else F.col(f"_{k}")).alias(f"s{k}") for k in axes))
    return t


CORNERS = ", corners AS (SELECT t.*, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, c.x AS x3, c.y AS y3, c.z AS z3 FROM triangles t JOIN nodes a ON a.id=t.v1 JOIN nodes b ON b.id=t.v2 JOIN nodes c ON c.id=t.v3) "
MESH = cte("triangles", "nodes") + CORNERS
TYPE = "CASE WHEN attr & 7 = 0 THEN 0 WHEN attr & 7 > 1 THEN 2 ELSE 1 END"


@query(MESH + "SELECT v1, v2, v3, n, round(x1+x2+x3, 5) AS sx, round(y1+y2+y3, 5) AS sy, round(z1+z2+z3, 5) AS sz FROM corners")
def jn3_triangle_corners(spark, sf_dir):
    return sums(spark, sf_dir, "xyz").select("v1", "v2", "v3", "n", *(F.round(f"s{k}", 5).alias(f"s{k}") for k in "xyz"))


@query(MESH + ", cells AS (SELECT CAST(floor(x*50) AS BIGINT) AS cx, CAST(floor(y*50) AS BIGINT) AS cy, min(id) AS texture FROM nodes GROUP BY 1, 2) SELECT v1, n, texture FROM corners JOIN cells ON cx = floor((x1+x2+x3)/3*50) AND cy = floor((y1+y2+y3)/3*50)")
def jn4_assign_textures(spark, sf_dir):
    """Barycentre to cell to texture."""
    cells = view(spark, sf_dir, "nodes").groupBy(F.floor(F.col("x") * 50).alias("cx"), F.floor(F.col("y") * 50).alias("cy")).agg(F.min("id").alias("texture"))
    mid = lambda k: F.floor(F.col(f"s{k}") / 3 * 50)
    return sums(spark, sf_dir, "xy").select("v1", "n", mid("x").alias("cx"), mid("y").alias("cy")).join(cells, ["cx", "cy"]).select("v1", "n", "texture")


@query(MESH + f""", w AS (SELECT v1, n, {TYPE} AS type, (x1+x2+x3)/3*20 AS mx, (y1+y2+y3)/3*20 AS my FROM corners),
d AS (SELECT v1, n, type, floor(mx)+dx AS cx, floor(my)+dy AS cy FROM w, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)
  WHERE type > 0 AND (dx = 0 OR (dx = -1 AND mx-floor(mx) < 0.25) OR (dx = 1 AND mx-floor(mx) >= 0.75)) AND (dy = 0 OR (dy = -1 AND my-floor(my) < 0.25) OR (dy = 1 AND my-floor(my) >= 0.75)))
SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, count(*) FILTER (type = 2) AS sea, count(*) FILTER (type = 1) AS inland FROM d GROUP BY ALL HAVING count(*) FILTER (type = 2) > 0""")
def ag6_water_by_cell(spark, sf_dir):
    """Water triangles by mask cell; those in an outer quarter count in the neighbours too; cells without sea go."""
    mid = lambda k: (F.col(f"{k}1") + F.col(f"{k}2") + F.col(f"{k}3")) / 3 * 20
    w = corners(spark, sf_dir).select(geo.triangle_type("attr").alias("type"), mid("x").alias("bx"), mid("y").alias("by")).where("type > 0")
    near = lambda b: F.array_compact(F.array(F.floor(b), F.when(b - F.floor(b) < 0.25, F.floor(b) - 1), F.when(b - F.floor(b) >= 0.75, F.floor(b) + 1)))
    w = w.withColumn("cx", F.explode(near(F.col("bx")))).withColumn("cy", F.explode(near(F.col("by"))))
    return w.groupBy("cx", "cy").agg(F.count_if(F.col("type") == 2).alias("sea"), F.count_if(F.col("type") == 1).alias("inland")).where("sea > 0")


DOUBLE_AREA = "abs((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))"
LONGEST = "greatest((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1), (x3-x2)*(x3-x2)+(y3-y2)*(y3-y2), (x1-x3)*(x1-x3)+(y1-y3)*(y1-y3))"


@query(MESH + f""", t AS (SELECT {TYPE} AS type, {DOUBLE_AREA} AS a, {LONGEST} AS l FROM corners),
fan AS (SELECT type, max(k) AS fan FROM (SELECT type, v, count(*) AS k FROM (SELECT {TYPE} AS type, unnest([v1, v2, v3]) AS v FROM corners) GROUP BY ALL) GROUP BY type)
SELECT CAST(type AS INT) AS type, count(*) AS triangles, round(sum(a)/2, 4) AS area, count(*) FILTER (a < 0.05*l) AS needles, max(fan) AS max_fan FROM t JOIN fan USING (type) GROUP BY type""")
def ag7_mesh_measures(spark, sf_dir):
    """Areas, needles and the widest fan by type; triangles meet their corners once, for both aggregates."""
    t = corners(spark, sf_dir).withColumn("type", geo.triangle_type("attr"))
    t = written(t.select("type", "v1", "v2", "v3", F.expr(DOUBLE_AREA).alias("a"), F.expr(f"{DOUBLE_AREA} < 0.05*{LONGEST}").alias("needle")), "measured")
    fan = t.select("type", F.explode(F.array("v1", "v2", "v3")).alias("v")).groupBy("type", "v").count().groupBy("type").agg(F.max("count").alias("max_fan"))
    own = t.groupBy("type").agg(F.count("*").alias("triangles"), F.round(F.sum("a") / 2, 4).alias("area"), F.count_if("needle").alias("needles"))
    return own.join(fan, "type")


@query(cte("triangles") + f"SELECT v AS node, CAST(bit_or(1 << {TYPE}) AS INT) AS bits, bit_or(1 << {TYPE}) & 1 = 1 AND bit_or(1 << {TYPE}) > 1 AS coast FROM (SELECT attr, unnest([v1, v2, v3]) AS v FROM triangles) GROUP BY v")
def ag10_node_types(spark, sf_dir):
    """OR of the type bits of a node's triangles; a coast node has land and water."""
    bits = F.bit_or(F.pow(F.lit(2), geo.triangle_type("attr")).cast("int"))
    t = view(spark, sf_dir, "triangles").select("attr", F.explode(F.array("v1", "v2", "v3")).alias("node"))
    return t.groupBy("node").agg(bits.alias("bits")).withColumn("coast", (F.col("bits").bitwiseAND(1) == 1) & (F.col("bits") > 1))


EDGES = f", tri AS (SELECT v1*10+n AS tri, 1 << {TYPE} AS bit, v1 AS a, v2+20000 AS b, v3+30000 AS c FROM triangles), halves AS (SELECT tri, bit, 'ab' AS side, a AS p, b AS q FROM tri UNION ALL SELECT tri, bit, 'bc', b, c FROM tri UNION ALL SELECT tri, bit, 'ca', c, a FROM tri), edges AS (SELECT least(p, q) AS u, greatest(p, q) AS v, CAST(bit_or(bit) AS INT) AS bits, count(*) AS uses, min(tri) AS first FROM halves GROUP BY 1, 2) "


def halves(spark, sf_dir) -> DataFrame:
    t = view(spark, sf_dir, "triangles").select(F.expr("v1*10+n").alias("tri"), F.pow(F.lit(2), geo.triangle_type("attr")).cast("int").alias("bit"), F.col("v1").alias("a"), (F.col("v2") + 20000).alias("b"), (F.col("v3") + 30000).alias("c"))
    return t.select("tri", "bit", F.expr("stack(3, 'ab', a, b, 'bc', b, c, 'ca', c, a) AS (side, p, q)")).select("*", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))


def edge_types(half: DataFrame) -> DataFrame:
    return half.groupBy("u", "v").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("uses"), F.min("tri").alias("first"))


@query(cte("triangles") + EDGES + "SELECT u, v, bits, uses, first FROM edges")
def ag11_edge_types(spark, sf_dir):
    return edge_types(halves(spark, sf_dir))


CASES = {
    "": ["a-b-c"],
    "ab": ["a-ab-c", "ab-b-c"],
    "bc": ["a-b-bc", "a-bc-c"],
    "ca": ["a-b-ca", "ca-b-c"],
    "ab,bc": ["ab-b-bc", "a-ab-c", "ab-bc-c"],
    "ab,ca": ["a-ab-ca", "ab-b-c", "ca-ab-c"],
    "bc,ca": ["ca-bc-c", "a-b-ca", "ca-b-bc"],
    "ab,bc,ca": ["a-ab-ca", "ab-b-bc", "ca-bc-c", "ab-bc-ca"],
}


@query(cte("triangles") + EDGES + f""", cut AS (SELECT h.tri, coalesce(string_agg(side, ',' ORDER BY side) FILTER (bits & 1 = 1 AND bits > 1), '') AS sides FROM halves h JOIN edges e ON e.u = least(p, q) AND e.v = greatest(p, q) WHERE bit > 1 GROUP BY h.tri)
SELECT tri, sides, unnest(CASE sides {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CASES.items())} END) AS part FROM cut""")
def ag12_recut_coast(spark, sf_dir):
    """Water triangles split at the edges they share with land: one more part than cut edges."""
    half = halves(spark, sf_dir)
    cut = F.when((F.col("bits").bitwiseAND(1) == 1) & (F.col("bits") > 1), F.col("side"))
    t = half.where("bit > 1").join(edge_types(half).select("u", "v", "bits"), ["u", "v"]).groupBy("tri").agg(F.array_join(F.sort_array(F.collect_list(cut)), ",").alias("sides"))
    table = F.create_map(*[x for k, v in CASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return t.select("tri", "sides", F.explode(F.element_at(table, F.col("sides"))).alias("part"))


@query(cte("nodes") + "SELECT pool, lo, hi, CASE WHEN hi-lo < 64 THEN 'fine' WHEN hi-lo < 256 THEN 'middle' ELSE 'coarse' END AS scale FROM (SELECT id//500 AS pool, CAST(floor(min(z)) AS BIGINT) AS lo, CAST(ceil(max(z)) AS BIGINT) AS hi FROM nodes GROUP BY 1)")
def ag13_pool_scales(spark, sf_dir):
    p = view(spark, sf_dir, "nodes").groupBy(F.expr("id div 500").alias("pool")).agg(F.floor(F.min("z")).alias("lo"), F.ceil(F.max("z")).alias("hi"))
    return p.withColumn("scale", F.expr("CASE WHEN hi-lo < 64 THEN 'fine' WHEN hi-lo < 256 THEN 'middle' ELSE 'coarse' END"))


@query(cte("triangles") + "SELECT least(v1, v2) AS u, greatest(v1, v2) AS v, bit_or(attr) AS marker, count(*) AS uses FROM triangles GROUP BY 1, 2")
def ag14_edge_markers(spark, sf_dir):
    return view(spark, sf_dir, "triangles").groupBy(F.least("v1", "v2").alias("u"), F.greatest("v1", "v2").alias("v")).agg(F.bit_or("attr").alias("marker"), F.count("*").alias("uses"))


def boxed(df: DataFrame, suffix: str = "") -> DataFrame:
    """Segments with their boxes, columns named with a suffix."""
    return df.select(*(F.col(n).alias(n + suffix) for n in df.columns), *(f("x1" if k in "we" else "y1", "x2" if k in "we" else "y2").alias(f"{k}{suffix}") for k, f in (("w", F.least), ("s", F.least), ("e", F.greatest), ("n", F.greatest))))


#: Side of the grid cells: about a box, so that a cell holds little else than what may meet.
CELL = 0.005
CROSS = "((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1))"


@query(cte("segments") + f""", p AS (SELECT a.id, b.id AS other, ((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/nullif({CROSS}, 0) AS t, ((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/nullif({CROSS}, 0) AS u, a.x1, a.x2, a.y1, a.y2, a.z1, a.z2
 FROM segments a JOIN segments b ON a.id < b.id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2))
SELECT id, other, round(x1+t*(x2-x1), 6) AS x, round(y1+t*(y2-y1), 6) AS y, round(z1+t*(z2-z1), 4) AS z FROM p WHERE t > 1e-9 AND t < 1-1e-9 AND u > 1e-9 AND u < 1-1e-9""")
def jn14_crossing_pairs(spark, sf_dir):
    """Pairs of segments that cross inside both; the height is that of the lower id.

    Segments are laid on the grid once, and the cells meet themselves, so one shuffle serves both sides. A pair that
    shares several cells is kept in the one of its common south-west corner.
    """
    s = view(spark, sf_dir, "segments")
    low, high = (lambda k: F.least(f"{k}1", f"{k}2")), (lambda k: F.greatest(f"{k}1", f"{k}2"))
    laid = s.withColumn("cx", F.explode(cells(low("x"), high("x"), CELL))).withColumn("cy", F.explode(cells(low("y"), high("y"), CELL)))
    west, south = "greatest(least(a.x1, a.x2), least(b.x1, b.x2))", "greatest(least(a.y1, a.y2), least(b.y1, b.y2))"
    meet = f"a.cx = b.cx AND a.cy = b.cy AND a.id < b.id AND {west} <= least(greatest(a.x1, a.x2), greatest(b.x1, b.x2)) AND {south} <= least(greatest(a.y1, a.y2), greatest(b.y1, b.y2))"
    p = laid.alias("a").join(laid.alias("b"), F.expr(f"{meet} AND floor({west}/{CELL}) = a.cx AND floor({south}/{CELL}) = a.cy"))
    cross = "nullif((a.x2-a.x1)*(b.y2-b.y1)-(a.y2-a.y1)*(b.x2-b.x1), 0)"
    p = p.selectExpr("a.*", "b.id AS other", f"((b.x1-a.x1)*(b.y2-b.y1)-(b.y1-a.y1)*(b.x2-b.x1))/{cross} AS t", f"((b.x1-a.x1)*(a.y2-a.y1)-(b.y1-a.y1)*(a.x2-a.x1))/{cross} AS u")
    p = p.where("t > 1e-9 AND t < 1-1e-9 AND u > 1e-9 AND u < 1-1e-9")
    return p.select("id", "other", F.expr("round(x1+t*(x2-x1), 6)").alias("x"), F.expr("round(y1+t*(y2-y1), 6)").alias("y"), F.expr("round(z1+t*(z2-z1), 4)").alias("z"))


TOL = 0.0008


def near_edges(points: DataFrame, edges: DataFrame, tol: float) -> DataFrame:
    """Points (pid, px, py) with edges closer than ``tol``, and the distance."""
    grown = points.select("*", *(F.expr(e).alias(k) for k, e in (("pw", f"px-{tol}"), ("ps", f"py-{tol}"), ("pe", f"px+{tol}"), ("pn", f"py+{tol}"))))
    p = box_join(grown, boxed(edges), CELL, ("pw", "ps", "pe", "pn"), ("w", "s", "e", "n"))
    p = p.withColumn("t", F.expr("greatest(0D, least(1D, ((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1))))"))
    return p.withColumn("d", F.expr("sqrt(power(px-x1-t*(x2-x1), 2)+power(py-y1-t*(y2-y1), 2))")).where(F.col("d") < tol)


NEAR = f"""FROM segments p JOIN segments e ON p.id <> e.id AND p.x1-{TOL} <= e.x2 AND e.x1 <= p.x1+{TOL} AND p.y1-{TOL} <= greatest(e.y1, e.y2) AND least(e.y1, e.y2) <= p.y1+{TOL}"""
DIST = "sqrt((p.x1-e.x1-t*(e.x2-e.x1))^2+(p.y1-e.y1-t*(e.y2-e.y1))^2)"
TT = "greatest(0, least(1, ((p.x1-e.x1)*(e.x2-e.x1)+(p.y1-e.y1)*(e.y2-e.y1))/((e.x2-e.x1)^2+(e.y2-e.y1)^2)))"


@query(cte("segments") + f"SELECT * FROM (SELECT p.id AS node, e.id AS edge, round({DIST.replace('t*', TT + '*')}, 7) AS d {NEAR} AND {DIST.replace('t*', TT + '*')} < {TOL})")
def jn15_near_nodes(spark, sf_dir):
    s = view(spark, sf_dir, "segments")
    p = near_edges(s.selectExpr("id AS pid", "x1 AS px", "y1 AS py"), s, TOL).where("pid <> id")
    return p.select(F.col("pid").alias("node"), F.col("id").alias("edge"), F.round("d", 7).alias("d"))


@query(cte("segments") + f"SELECT DISTINCT p.id AS node {NEAR} AND p.id%3 = 0 AND e.id%11 = 0 AND {DIST.replace('t*', TT + '*')} < {TOL}")
def jn16_near_shore(spark, sf_dir):
    s = view(spark, sf_dir, "segments")
    return near_edges(s.where("id%3 = 0").selectExpr("id AS pid", "x1 AS px", "y1 AS py"), s.where("id%11 = 0"), TOL).where("pid <> id").select(F.col("pid").alias("node")).distinct()


BOX = "a.x1 < b.x1+0.004 AND b.x1 < a.x1+0.004 AND a.y1 < b.y1+0.003 AND b.y1 < a.y1+0.003"


def overlaps(spark, sf_dir) -> DataFrame:
    """Pairs of small boxes whose interiors meet, once each."""
    b = view(spark, sf_dir, "segments").selectExpr("id", "x1 AS w", "y1 AS s", "x1+0.004 AS e", "y1+0.003 AS n")
    pairs = box_join(b, b.toDF(*(f"{n}2" for n in b.columns)), CELL, ("w", "s", "e", "n"), ("w2", "s2", "e2", "n2"))
    return pairs.where("id < id2 AND w < e2 AND w2 < e AND s < n2 AND s2 < n").select(F.col("id").alias("a"), F.col("id2").alias("b"))


@query(cte("segments") + f"SELECT a.id AS a, b.id AS b FROM segments a JOIN segments b ON a.id < b.id AND {BOX}")
def jn13_overlap_pairs(spark, sf_dir):
    return overlaps(spark, sf_dir)


@query("WITH RECURSIVE segments AS (SELECT " + ", ".join(VIEWS["segments"][1]) + f" FROM orders), l AS (SELECT a.id AS a, b.id AS b FROM segments a JOIN segments b ON a.id <> b.id AND {BOX}), r(node, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) <> node")
def it1_connected_components(spark, sf_dir):
    return connected_components(overlaps(spark, sf_dir))


# A mesh over unit squares of a hundred by a hundred posts, none quite in its place: two triangles a cell, cut along
# either diagonal; one cell in 97 has a triangle with two corners in one place. Ten thousand keys make a square.
_COL, _ROW = "o_orderkey%100", "CAST(floor(o_orderkey%10000/100) AS BIGINT)"
VIEWS["posts"] = (
    "orders",
    ["o_orderkey AS id", f"floor(o_orderkey/10000)*2 + ({_COL} + (o_orderkey*613%1009)*0.0003e0)/100e0 AS x", f"({_ROW} + (o_orderkey*389%997)*0.0003e0)/100e0 AS y", "o_totalprice/1000e0 AS z"],
)
_K = "o_orderkey"
VIEWS["faces"] = (
    "orders",
    [
        "o_orderkey AS cell", f"{_COL} < 99 AND {_ROW} < 99 AS whole", f"{_K}%3=0 AS turned",
        f"{_K} AS a1", f"CASE WHEN {_K}%97=0 THEN {_K} ELSE {_K}+1 END AS a2", f"CASE WHEN {_K}%3=0 THEN {_K}+101 ELSE {_K}+100 END AS a3",
        f"CASE WHEN {_K}%3=0 THEN {_K} ELSE {_K}+1 END AS b1", f"{_K}+101 AS b2", f"{_K}+100 AS b3", f"{_K}%5=0 AS wet",
    ],
)
FACES = "tri AS (SELECT cell*2 AS tri, a1 AS v1, a2 AS v2, a3 AS v3, wet FROM faces WHERE whole UNION ALL SELECT cell*2+1, b1, b2, b3, wet FROM faces WHERE whole)"
#: Side of the grid cells on which points meet triangles: a few of a triangle's box, since a triangle is wider as a row than a point.
FACE_CELL = 0.04


def faces(spark, sf_dir) -> DataFrame:
    """(tri, v1, v2, v3, wet)."""
    f = view(spark, sf_dir, "faces").where("whole")
    return f.selectExpr("stack(2, cell*2, a1, a2, a3, wet, cell*2+1, b1, b2, b3, wet) AS (tri, v1, v2, v3, wet)")


def with_corners(triangles: DataFrame, nodes: DataFrame, columns: Iterable[str] = "xyz") -> DataFrame:
    """Triangles with x1 ... z3 for their v1, v2 and v3, joined by id; a triangle without all its nodes goes."""
    for i in (1, 2, 3):
        triangles = triangles.join(nodes.select(F.col("id").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in columns)), f"v{i}").drop(f"v{i}")
    return triangles


#: Twice the area, and the weights of the first two corners at a point (px, py); a point on an edge counts in, to a billionth.
DET = "((y2-y3)*(x1-x3)+(x3-x2)*(y1-y3))"
W1, W2 = f"((y2-y3)*(px-x3)+(x3-x2)*(py-y3))/{DET}", f"((y3-y1)*(px-x3)+(x1-x3)*(py-y3))/{DET}"
HELD = f"{DET} <> 0 AND {W1} >= -1e-9 AND {W2} >= -1e-9 AND 1-{W1}-{W2} >= -1e-9"
HEIGHT = f"{W1}*z1+{W2}*z2+(1-{W1}-{W2})*z3"
XS, YS = "x1, x2, x3", "y1, y2, y3"


def located(points: DataFrame, triangles: DataFrame, key: list[str], cell: float, also: list[str] | None = None, every: bool = False) -> DataFrame:
    """Of each point (key, px, py) that lies on a triangle the lowest such, its height there, and ``also`` of the triangle: key, tri, height.

    ``triangles``: tri and their corners x1 ... z3. Both are laid on a grid, triangles by their box; triangles without
    an area hold nothing. A point on a shared edge goes to the lower triangle. ``every``: points that lie on none come
    too, with nulls. A point has one cell, so its triangles meet where it is and no shuffle follows the join's.
    """
    laid = lambda low, high: F.explode(F.sequence(F.expr(f"floor((least({low}) - 1e-9) / {cell}D)"), F.expr(f"floor((greatest({high}) + 1e-9) / {cell}D)")))
    t = triangles.select("tri", *(f"{c}{i}" for i in (1, 2, 3) for c in "xyz"), *(also or [])).withColumn("_cx", laid(XS, XS)).withColumn("_cy", laid(YS, YS))
    p = points.selectExpr(*key, "px", "py", f"floor(px / {cell}D) AS _cx", f"floor(py / {cell}D) AS _cy")
    t = t.withColumnsRenamed({"_cx": "_tx", "_cy": "_ty"})
    hit = p.join(t, F.expr(f"_cx = _tx AND _cy = _ty AND {HELD}"), "left" if every else "inner")
    on = F.struct("tri", F.expr(HEIGHT).alias("height"), *(also or []))
    first = hit.groupBy("_cx", "_cy", *key).agg(F.min(F.when(F.col("tri").isNotNull(), on)).alias("m"))
    return first.select(*key, "m.tri", "m.height", *(F.col(f"m.{a}").alias(a) for a in also or []))


# One point in ten is a post, so it lies on several triangles; the others are spread over the square and a little beyond it.
SPOT = "SELECT id AS point, CASE WHEN id%10=0 THEN x ELSE floor(id/10000)*2 + (id*7919%10007)/9900e0 END AS px, CASE WHEN id%10=0 THEN y ELSE (id*4099%9973)/9900e0 END AS py FROM posts"


@query(cte("posts", "faces") + f""", {FACES}, c AS (SELECT tri, wet, a.x AS x1, a.y AS y1, a.z AS z1, b.x AS x2, b.y AS y2, b.z AS z2, c.x AS x3, c.y AS y3, c.z AS z3, CAST(floor(a.x/2) AS BIGINT) AS sq, CAST(floor(a.y*20) AS BIGINT) AS band FROM tri JOIN posts a ON a.id=v1 JOIN posts b ON b.id=v2 JOIN posts c ON c.id=v3),
p AS ({SPOT}), b AS (SELECT *, CAST(floor(px/2) AS BIGINT) AS sq, CAST(floor(py*20) AS BIGINT) + unnest([-1, 0, 1]) AS band FROM p), h AS (SELECT point, tri, {HEIGHT} AS z FROM b JOIN c USING (sq, band) WHERE {HELD})
SELECT point, min(tri) AS tri, round(arg_min(z, tri), 6) AS height FROM p LEFT JOIN h USING (point) GROUP BY point""")
def jn27_locate(spark, sf_dir):
    """The triangle that holds each point, the lowest on shared edges, and the height on it; null where none does."""
    nodes = view(spark, sf_dir, "posts")
    p = nodes.selectExpr(*(x.strip() for x in SPOT.removeprefix("SELECT ").removesuffix(" FROM posts").split(", ")))
    hit = located(p, with_corners(faces(spark, sf_dir), nodes), ["point"], FACE_CELL, every=True)
    return hit.select("point", "tri", F.round("height", 6).alias("height"))


LEVELS = 8


@query(cte("segments") + f""", q AS (SELECT id, CAST(floor(x1*{1 << LEVELS}) AS BIGINT) AS qx, CAST(floor(y1*{1 << LEVELS}) AS BIGINT) AS qy FROM segments),
l AS (SELECT id, k, (qx >> ({LEVELS}-k)) AS cx, (qy >> ({LEVELS}-k)) AS cy FROM q, range(0, {LEVELS}+1) t(k)),
c AS (SELECT k, cx, cy, count(*) AS n FROM l GROUP BY ALL), o AS (SELECT id, k, cx, cy, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM l JOIN c USING (k, cx, cy) WHERE n <= 100 OR k = {LEVELS})
SELECT k AS level, cx, cy, count(*) AS points FROM o WHERE rn = 1 GROUP BY ALL""")
def it8_quadtree_buckets(spark, sf_dir):
    """Each point goes to the shallowest cell with at most 100 points; counts of all levels come from one aggregate of the finest."""
    q = view(spark, sf_dir, "segments").select(*(F.floor(F.col(k) * (1 << LEVELS)).alias(n) for k, n in (("x1", "qx"), ("y1", "qy"))))
    finest = q.groupBy("qx", "qy").agg(F.count("*").alias("n"))
    up = lambda n: F.expr(f"shiftright({n}, {LEVELS} - level)")
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("cx", up("qx")).withColumn("cy", up("qy"))
    sizes = levels.groupBy("level", "cx", "cy").agg(F.sum("n").alias("all"))
    first = levels.join(sizes, ["level", "cx", "cy"]).where(f"all <= 100 OR level = {LEVELS}").groupBy("qx", "qy").agg(F.min(F.struct("level", "cx", "cy")).alias("c"), F.max("n").alias("n"))
    return first.groupBy(F.col("c.level").alias("level"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy")).agg(F.sum("n").alias("points"))


SMOOTH = """{name} AS (SELECT v AS id, avg(m) AS z FROM (SELECT unnest([v1, v2, v3]) AS v, (a.z+b.z+c.z)/3 AS m FROM {tri} t JOIN {prev} a ON a.id=t.v1 JOIN {prev} b ON b.id=t.v2 JOIN {prev} c ON c.id=t.v3) GROUP BY v)"""
#: Passes over inland water.
PASSES = 4


def mean_passes(corners: DataFrame, z: DataFrame, passes: int) -> DataFrame:
    """(id, z) of the corners (t, id) of whole triangles after some passes in which each takes the mean of its triangles' means; free of order by design."""
    for _ in range(passes):
        means = corners.join(z, "id").groupBy("t").agg(F.avg("z").alias("m"), F.count("*").alias("k")).where("k = 3")
        z = corners.join(means, "t").groupBy("id").agg(F.avg("m").alias("z"))
    return z


def water_smooth(nodes: DataFrame, water: DataFrame, sea: DataFrame, known: DataFrame, passes: int, mode: str) -> DataFrame:
    """(id, z) of all nodes (id, z): inland water levelled, then the sea (``mode``: 'zero', 'mean' or 'clamp', which lifts what lies below 0), then the known altitudes (id, alt) put in.

    ``water`` and ``sea``: t, id of the triangles' corners.
    """
    over = lambda z, new, f: z.join(new.withColumnRenamed("z", "_new"), "id", "left").select("id", f.alias("z"))
    z = over(nodes, mean_passes(water, nodes, passes), F.coalesce("_new", "z"))
    if mode == "mean":
        z = over(z, mean_passes(sea, z, 1), F.coalesce("_new", "z"))
    else:
        level = F.lit(0.0) if mode == "zero" else F.greatest("z", F.lit(0.0))
        z = over(z, sea.select("id").distinct().withColumn("z", F.lit(1.0)), F.when(F.col("_new").isNotNull(), level).otherwise(F.col("z")))
    return over(z, known.select("id", F.col("alt").alias("z")), F.coalesce("_new", "z"))


_CHAIN = ", ".join(SMOOTH.format(name=f"p{i}", tri="wet", prev=f"p{i - 1}" if i > 1 else "h") for i in range(1, PASSES + 1))


# Heights are taken 200 m lower, so that some sea lies below 0; one node in 29 has a known altitude, of which one in seven is empty.
@query(cte("triangles", "nodes") + f""", h AS (SELECT id, z-200 AS z FROM nodes), t AS (SELECT *, {TYPE} AS type FROM triangles WHERE v1 IN (SELECT id FROM nodes) AND v2 IN (SELECT id FROM nodes) AND v3 IN (SELECT id FROM nodes)), wet AS (SELECT * FROM t WHERE type = 1), sea AS (SELECT * FROM t WHERE type = 2),
{_CHAIN}, w AS (SELECT h.id, coalesce(p.z, h.z) AS z FROM h LEFT JOIN p{PASSES} p USING (id)), {SMOOTH.format(name='sm', tri='sea', prev='w')}, s AS (SELECT DISTINCT unnest([v1, v2, v3]) AS id FROM sea),
m AS (SELECT 'zero' AS mode, id, CASE WHEN id IN (SELECT id FROM s) THEN 0 ELSE z END AS z FROM w UNION ALL SELECT 'clamp', id, CASE WHEN id IN (SELECT id FROM s) THEN greatest(z, 0) ELSE z END FROM w UNION ALL SELECT 'mean', w.id, coalesce(sm.z, w.z) FROM w LEFT JOIN sm USING (id))
SELECT mode, id, round(CASE WHEN id%29=0 AND id%7<>0 THEN (id%500)/3e0 ELSE z END, 6) AS z FROM m""")
def it10_water_smooth(spark, sf_dir):
    """Every node's height in the three modes for the sea."""
    nodes = view(spark, sf_dir, "nodes").selectExpr("id", "z - 200 AS z")
    t = view(spark, sf_dir, "triangles")
    for v in ("v1", "v2", "v3"):
        t = t.join(nodes.select(F.col("id").alias(v)), v, "left_semi")
    t = t.select(F.monotonically_increasing_id().alias("t"), geo.triangle_type("attr").alias("type"), F.array("v1", "v2", "v3").alias("v")).where("type > 0")
    ends = written(t.select("t", "type", F.explode("v").alias("id")), "water-corners")
    known = nodes.where("id%29 = 0 AND id%7 <> 0").selectExpr("id", "(id%500)/3D AS alt")
    out = [water_smooth(nodes, ends.where("type = 1").drop("type"), ends.where("type = 2").drop("type"), known, PASSES, m).select(F.lit(m).alias("mode"), "id", F.round("z", 6).alias("z")) for m in ("zero", "clamp", "mean")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(cte("triangles") + "SELECT v3 AS pool, v2 AS id, dense_rank() OVER (PARTITION BY v3 ORDER BY p) - 1 AS rank FROM (SELECT v3, v2, min(v1*10+n) AS p FROM triangles GROUP BY ALL)")
def wn7_first_seen_rank(spark, sf_dir):
    seen = view(spark, sf_dir, "triangles").groupBy(F.col("v3").alias("pool"), F.col("v2").alias("id")).agg(F.min(F.expr("v1*10+n")).alias("p"))
    return seen.select("pool", "id", (F.dense_rank().over(Window.partitionBy("pool").orderBy("p")) - 1).alias("rank"))


@query(cte("triangles") + "SELECT pool, id, place, place >= 400 AS overflow FROM (SELECT v3 AS pool, v1 AS id, row_number() OVER (PARTITION BY v3 ORDER BY min(v1*10+n), v1) - 1 AS place FROM triangles GROUP BY v3, v1)")
def wn8_position_in_pool(spark, sf_dir):
    seen = view(spark, sf_dir, "triangles").groupBy(F.col("v3").alias("pool"), F.col("v1").alias("id")).agg(F.min(F.expr("v1*10+n")).alias("p"))
    at = F.row_number().over(Window.partitionBy("pool").orderBy("p", "id")) - 1
    return seen.select("pool", "id", at.alias("place")).withColumn("overflow", F.col("place") >= 400)
