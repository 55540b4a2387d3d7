"""Coasts of a tile: rings by winding, open chains joined along the border to closed loops, faults as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import VIEWS, cte, view
from ..operators.joins import ranked, written
from ..registry import query

#: How far from the tile's side an open end may stand.
TOLERANCE = 1e-6


def _at(n: str) -> tuple[str, str]:
    """x and y of a node by its number in the tile; numbers with a place stand on the border, clockwise from the south-west."""
    place = f"(CASE WHEN {n}%3=1 THEN CASE WHEN tile%7=4 AND {n}=13 THEN 1 ELSE 2*floor(({n}-10)/3)+1 END ELSE 2*((floor(({n}-10)/3)+tile%3)%3) END+0.5e0)*4/6e0+tile%5*0.01e0"
    on = f"WHEN tile%7=2 AND {n}=15 THEN 0.5e0 WHEN {n}%3=2 THEN"
    x = f"CASE WHEN {n} IN (0, 3) THEN 0.4e0 WHEN {n} IN (1, 2) THEN 0.6e0 WHEN {n}=30 THEN 0.7e0 WHEN {n}=31 THEN 0.75e0 {on} 0.3e0+{n}*0.01e0 WHEN {place} < 1 THEN 0e0 WHEN {place} < 2 THEN {place}-1 WHEN {place} < 3 THEN 1e0 ELSE 4-({place}) END"
    y = f"CASE WHEN {n} IN (0, 1) THEN 0.4e0 WHEN {n} IN (2, 3) THEN 0.6e0 WHEN {n} >= 30 THEN 0.7e0 {on} 0.2e0+{n}*0.01e0 WHEN {place} < 1 THEN {place} WHEN {place} < 2 THEN 1e0 WHEN {place} < 3 THEN 3-({place}) ELSE 0e0 END"
    return x, y


# Twelve ways a tile: a ring of four, three chains of two from border to border, a ring of two; by tile%7 a third way at
# a node, an end inside the tile, a chain turned round, two chains that begin at one place.
_I, _J = "(o_orderkey%12)", "CAST(floor((o_orderkey%12-4)/2) AS BIGINT)"
_A = f"CASE WHEN {_I} < 4 THEN {_I} WHEN {_I} < 10 THEN 10+3*{_J}+o_orderkey%2 WHEN {_I} = 11 THEN 31 ELSE 30 END"
_B = f"CASE WHEN {_I} < 4 THEN ({_I}+1)%4 WHEN {_I} < 10 THEN 11+3*{_J}+o_orderkey%2 WHEN {_I} = 11 THEN 30 ELSE 31 END"
_TURNED = f"({_I} < 4 AND tile%2=1 OR {_I} IN (8, 9) AND tile%7=3)"
VIEWS["coast"] = (
    "orders",
    [
        "CAST(floor(o_orderkey/12) AS BIGINT) AS tile", "o_orderkey AS way", f"CASE WHEN {_I} = 10 AND tile%7=1 THEN 11 WHEN {_TURNED} THEN {_B} ELSE {_A} END AS na", f"CASE WHEN {_TURNED} THEN {_A} ELSE {_B} END AS nb",
        "tile*100+na AS a", "tile*100+nb AS b", *(f"{e} AS {c}{k}" for k in "ab" for c, e in zip("xy", _at(f"n{k}"))),
    ],
)

#: Place on the border, clockwise from the south-west corner, in [0, 4).
PLACE = "CASE WHEN x <= least(1-y, y, 1-x) THEN y WHEN 1-y <= least(y, 1-x) THEN 1+x WHEN 1-x <= y THEN 3-y ELSE 3+(1-x) END"
OFF = "least(abs(x), abs(1-x), abs(y), abs(1-y))"
#: Twice the area that a way along the border from place p to q adds: the part of it on the north and east sides.
SIDE = "(greatest(0, least(q, 3)-greatest(p, 1)) + greatest(0, least(q, 7)-greatest(p, 5)))"


def coast_loops(ways: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Closed loops (tile, way, loop, place, kind, area) and faults (tile, way, fault) of directed coasts.

    ``ways``: tile, way, the nodes a and b it leads between, their places xa, ya, xb, yb in the unit square. A way goes
    on where another begins; from an end on the border the loop follows the border clockwise to the next
    beginning. Loops are named by their smallest way and wound by their area: a ring is an island if it runs
    anticlockwise, else a sea inside the land; a loop that uses the border is 'border'.

    Faults: 'open end' (an end off the side), 'triple junction' (a node of three ways, or two chains that begin at
    one place), 'orientation' (two ways that meet head on, or neighbours on the border that both begin or both end
    there), 'degenerate ring' (of fewer than three ways; the rest of the tile stands). A tile with any other fault has
    no loops. Ends are counted by node and put in order by tile; loops are ranked by pointer doubling.
    """
    ways = written(ways, "coast-ways")
    ends = ways.selectExpr("tile", "way", "stack(2, a, xa, ya, true, b, xb, yb, false) AS (node, x, y, out)")
    met = ends.groupBy("tile", "node").agg(F.count("*").alias("n"), F.count_if("out").alias("outs"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.when(F.col("out"), F.col("way"))).alias("to"), F.max(F.when(~F.col("out"), F.col("way"))).alias("from"))
    met = written(met, "coast-nodes")
    crossed = met.where("n > 2 OR n = 2 AND outs <> 1").select("tile", "node", F.when(F.col("n") > 2, "triple junction").otherwise("orientation").alias("fault"))
    faults = ends.join(crossed, ["tile", "node"]).select("tile", "way", "fault")
    single = met.where("n = 1").withColumn("way", F.coalesce("to", "from"))
    faults = faults.unionByName(single.where(f"{OFF} > {tolerance}").select("tile", "way", F.lit("open end").alias("fault")))
    border = single.where(f"{OFF} <= {tolerance}").selectExpr("tile", "way", "outs = 1 AS out", f"round({PLACE}, 9) AS p")
    w = Window.partitionBy("tile").orderBy("p", F.col("out").cast("int"), "way")
    after = F.coalesce(F.lead(F.struct("way", "out", "p")).over(w), F.first(F.struct("way", "out", "p")).over(w))
    border = border.withColumn("next", after)
    wrong = border.where("out = next.out").select("tile", F.explode(F.array("way", "next.way")).alias("way"), F.when(F.expr("out AND p = next.p AND way <> next.way"), "triple junction").otherwise("orientation").alias("fault"))
    faults = written(faults.unionByName(wrong).distinct(), "coast-faults")
    good = lambda df: df.join(faults.select("tile").distinct(), "tile", "left_anti")
    inside = met.where("n = 2").select("tile", F.col("from").alias("node"), F.col("to").alias("next"), F.lit(0.0).alias("side"), F.lit(False).alias("border"))
    along = border.where("NOT out").selectExpr("tile", "way AS node", "next.way AS next", "p", "CASE WHEN next.p < p THEN next.p + 4 ELSE next.p END AS q").selectExpr("tile", "node", "next", f"-{SIDE} AS side", "true AS border")
    links = written(good(inside.unionByName(along)), "coast-links")
    own = ranked(links.select("node", "next")).join(links.drop("next"), "node").withColumnRenamed("node", "way")
    own = written(own.join(ways.selectExpr("way", "xa*yb-xb*ya AS turn"), "way"), "coast-ranked")
    sums = own.groupBy("first").agg(F.count("*").alias("n"), F.bool_or("border").alias("border"), F.round(F.sum(F.col("turn") + F.col("side")) / 2, 6).alias("area"))
    kind = F.when(F.col("border"), "border").when(F.col("n") < 3, "degenerate ring").when(F.col("area") > 0, "island").otherwise("sea")
    named = own.drop("border").join(sums.select("first", "area", kind.alias("kind")), "first")
    small = F.col("kind") == "degenerate ring"
    loops = named.where(~small).select("tile", "way", F.col("first").alias("loop"), "place", "kind", "area")
    return loops, faults.unionByName(named.where(small).select("tile", "way", F.col("kind").alias("fault")))


# Every way walks on until it comes back; the smallest way it meets names the loop.
@query("WITH RECURSIVE " + cte("coast").removeprefix("WITH ") + f""", ends AS (SELECT tile, way, a AS node, xa AS x, ya AS y, true AS out FROM coast UNION ALL SELECT tile, way, b, xb, yb, false FROM coast),
met AS (SELECT tile, node, count(*) AS n, count(*) FILTER (out) AS outs, min(x) AS x, min(y) AS y, max(way) FILTER (out) AS go, max(way) FILTER (NOT out) AS came FROM ends GROUP BY ALL),
bord AS (SELECT tile, coalesce(go, came) AS way, outs = 1 AS out, round({PLACE}, 9) AS p, {OFF} AS off FROM met WHERE n = 1),
nb AS (SELECT *, coalesce(lead(way) OVER w, first_value(way) OVER w) AS nway, coalesce(lead(out) OVER w, first_value(out) OVER w) AS nout, coalesce(lead(p) OVER w, first_value(p) OVER w) AS np FROM bord WHERE off <= {TOLERANCE} WINDOW w AS (PARTITION BY tile ORDER BY p, CAST(out AS INT), way)),
fault AS (SELECT tile, way, CASE WHEN n > 2 THEN 'triple junction' ELSE 'orientation' END AS fault FROM ends JOIN met USING (tile, node) WHERE n > 2 OR (n = 2 AND outs <> 1)
 UNION SELECT tile, way, 'open end' FROM bord WHERE off > {TOLERANCE} UNION SELECT tile, unnest([way, nway]), CASE WHEN out AND p = np AND way <> nway THEN 'triple junction' ELSE 'orientation' END FROM nb WHERE out = nout),
step AS (SELECT tile, came AS way, go AS nxt, 0e0 AS side, false AS border FROM met WHERE n = 2 UNION ALL SELECT tile, way, nway, -{SIDE}, true FROM (SELECT *, CASE WHEN np < p THEN np+4 ELSE np END AS q FROM nb WHERE NOT out)),
link AS (SELECT s.*, xa*yb-xb*ya AS turn FROM step s JOIN coast c USING (way) WHERE s.tile NOT IN (SELECT tile FROM fault)),
r(root, way, k) AS (SELECT way, way, 0 FROM link UNION ALL SELECT r.root, l.nxt, k+1 FROM r JOIN link l ON l.way = r.way WHERE l.nxt <> r.root),
named AS (SELECT way, min(root) AS loop, arg_min(k, root) AS place FROM r GROUP BY way),
sums AS (SELECT loop, count(*) AS n, bool_or(border) AS border, round(sum(turn+side)/2, 6) AS area FROM named JOIN link USING (way) GROUP BY loop),
kind AS (SELECT loop, area, CASE WHEN border THEN 'border' WHEN n < 3 THEN 'degenerate ring' WHEN area > 0 THEN 'island' ELSE 'sea' END AS kind FROM sums)
SELECT tile, way, loop, place, kind, area, NULL AS fault FROM named JOIN kind USING (loop) JOIN link USING (way) WHERE kind <> 'degenerate ring'
UNION ALL SELECT tile, way, NULL, NULL, NULL, NULL, kind FROM named JOIN kind USING (loop) JOIN link USING (way) WHERE kind = 'degenerate ring' UNION ALL SELECT tile, way, NULL, NULL, NULL, NULL, fault FROM fault""")
def it11_coast_topology(spark, sf_dir):
    """Loops way by way, and the faults."""
    loops, faults = coast_loops(view(spark, sf_dir, "coast").drop("na", "nb"))
    return loops.unionByName(faults, allowMissingColumns=True)
