"""Sources and sinks as round trips: a table is written in a format and read back by its reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import cte, table, view
from ..functions import geo
from ..operators.joins import shared_dir, written
from ..registry import query
from . import readers




@query(cte("sites") + "SELECT ident, kind, CAST(id*7 AS INT) AS elev_ft, CASE WHEN id%2=0 THEN 'IC'||id END AS icao, round(lat, 4) AS lat, round(lon, 4) AS lon FROM sites WHERE id%10 <> 9")
def src1_read_airports(spark, sf_dir):
    s = view(spark, sf_dir, "sites")
    code = F.when(F.col("kind") == "land", "1").when(F.col("kind") == "sea", "16").otherwise("17")
    head = F.format_string("%s %d 0 0 %s %s\n", code, F.col("id") * 7, F.col("ident"), F.col("name"))
    meta = F.when(F.expr("id%2=0"), F.concat(F.lit("1302 icao_code IC"), F.col("id").cast("string"), F.lit("\n"))).otherwise("")
    end = lambda k: F.format_string("%s %.6f %.6f 0 0 0 0 0 0", F.lit(k), F.col("lat"), F.col("lon"))
    runway = F.when(F.expr("id%10 <> 9"), F.concat(F.lit("100 30 1 0 0 0 0 0 "), end("09"), F.lit(" "), end("27"), F.lit("\n"))).otherwise("")
    path = shared_dir(s, "apt")
    s.select(F.concat(head, meta, runway, F.lit("99")).alias("value")).write.text(path)
    return readers.read_airports(spark, path + "/part-*").select("ident", "kind", "elev_ft", "icao", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))


#: Ids that one map document, or one flight plan, covers: documents grow in number with the rows, not in size.
LOT = 5_000


def lot():
    return F.floor(F.col("id") / LOT)


def osm_elements(spark, sf_dir):
    n = view(spark, sf_dir, "nodes").selectExpr("'node' AS type", "id", "y AS lat", "x AS lon", "map('k', string(id%7)) AS tags")
    w = view(spark, sf_dir, "ways").groupBy("way").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda v: v["node"]).alias("nodes"))
    return n, w.selectExpr("'way' AS type", "way AS id", "nodes", "map('highway', string(way%5)) AS tags")


@query(cte("nodes", "ways") + "SELECT 'node' AS kind, count(*) AS n, round(sum(x)+sum(y), 3) AS total FROM nodes UNION ALL SELECT 'way', count(DISTINCT way), sum(node)::DOUBLE FROM ways")
def src2_read_osm_json(spark, sf_dir):
    n, w = osm_elements(spark, sf_dir)
    both = n.unionByName(w, allowMissingColumns=True).withColumn("lot", lot())
    path = shared_dir(both, "osm")
    both.groupBy("lot").agg(F.collect_list(F.struct("type", "id", "lat", "lon", "nodes", "tags")).alias("elements")).select("elements").write.json(path)
    t = readers.read_osm_json(spark, path, lines=True)
    nodes = t["nodes"].agg(F.lit("node").alias("kind"), F.count("*").alias("n"), F.round(F.sum("lat") + F.sum("lon"), 3).alias("total"))
    return nodes.unionByName(t["ways"].select("id", F.explode("nodes").alias("v")).agg(F.lit("way").alias("kind"), F.count_distinct("id").alias("n"), F.sum("v").cast("double").alias("total")))


@query(cte("nodes", "ways") + "SELECT 'node' AS kind, count(*) AS n, round(sum(x)+sum(y), 3) AS total FROM nodes UNION ALL SELECT 'way', count(DISTINCT way), sum(node)::DOUBLE FROM ways")
def src3_read_osm_xml(spark, sf_dir):
    n, w = osm_elements(spark, sf_dir)
    node = F.format_string('<node id="%d" lat="%.6f" lon="%.6f"><tag k="k" v="%s"/></node>', "id", "lat", "lon", F.col("tags")["k"])
    refs = F.array_join(F.transform("nodes", lambda v: F.concat(F.lit('<nd ref="'), v.cast("string"), F.lit('"/>'))), "")
    way = F.concat(F.lit('<way id="'), F.col("id").cast("string"), F.lit('">'), refs, F.lit('<tag k="highway" v="1"/></way>'))
    out = n.select(node.alias("value"), lot().alias("lot")).union(w.select(way, lot()))
    path = shared_dir(out, "osmxml")
    whole = out.groupBy("lot").agg(F.concat(F.lit("<osm>\n"), F.array_join(F.collect_list("value"), "\n"), F.lit("\n</osm>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(path)  # a document a file
    t = readers.read_osm_xml(spark, path)
    nodes = t["nodes"].agg(F.lit("node").alias("kind"), F.count("*").alias("n"), F.round(F.sum("lat") + F.sum("lon"), 3).alias("total"))
    return nodes.unionByName(t["ways"].select("id", F.explode("nodes").alias("v")).agg(F.lit("way").alias("kind"), F.count_distinct("id").alias("n"), F.sum("v").cast("double").alias("total")))


@query(cte("zones") + "SELECT 'z'||priority AS id, CAST(zl AS INT) AS zl, CASE WHEN priority%3 > 0 THEN 'BI' END AS provider, CAST(4 AS INT) AS vertices, round(west+south, 6) AS corner FROM zones")
def src4_read_zones(spark, sf_dir):
    ring = F.array(*(F.array(a, b) for a, b in (("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south"))))
    z = view(spark, sf_dir, "zones").select(F.struct(F.expr("concat('z', priority)").alias("id"), F.lit("zone").alias("name"), F.col("zl").cast("int").alias("zl"), F.when(F.expr("priority%3 > 0"), "BI").otherwise("").alias("provider"), ring.alias("polygon")).alias("z"), F.expr("priority%4").alias("lot"))
    path = shared_dir(z, "zones")
    z.groupBy("lot").agg(F.lit("zones-1").alias("format"), F.collect_list("z").alias("zones")).drop("lot").write.json(path)
    return readers.read_zones(spark, path, lines=True).select("id", "zl", "provider", F.size("polygon").alias("vertices"), F.round(F.get(F.get("polygon", 0), 0) + F.get(F.get("polygon", 0), 1), 6).alias("corner"))


@query("SELECT lot, count(*) AS posts, sum(v) AS total FROM (SELECT s AS lot, ((s*31+i*7)%9000)-500 AS v FROM (SELECT s_suppkey AS s FROM supplier), range(0, 169) t(i)) GROUP BY lot")
def src5_read_elevation(spark, sf_dir):
    """Cells of 13 x 13 posts, one file each, by the name of the site they belong to."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("lot"))
    path = shared_dir(s, "cells")
    cell = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(168)), lambda i: F.right(F.concat(F.lit("0000"), F.hex((F.col("lot") * 31 + i * 7) % 9000 - 500)), F.lit(4))), ""))
    # one row a file: the format writes each file's bytes as they are
    files = written(s.select("lot", cell.alias("content")), "cells-table")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for lot, data in zip(batch["lot"].to_pylist(), batch["content"].to_pylist()):
                with store.open_output_stream(f"{root}/{lot}.hgt") as out:
                    out.write(data)
            yield batch.select(["lot"])

    files.mapInArrow(save, "lot long").count()
    z = readers.read_elevation(spark, path)
    return z.groupBy(F.regexp_extract("file", r"(\d+)\.hgt$", 1).cast("long").alias("lot")).agg(F.count("*").alias("posts"), F.sum("alt").alias("total"))


@query(cte("chunks") + "SELECT provider, count(*) AS n, sum(bytes) AS bytes FROM chunks WHERE provider = 'BI' AND x < 500 GROUP BY provider")
def src7_read_chunks(spark, sf_dir):
    """Pieces stored by provider and level, dealt out by ranges of columns: a point query prunes folders and files, and no task sorts a provider."""
    c = view(spark, sf_dir, "chunks").select("provider", "zl", "x", "y", "bytes")
    path = shared_dir(c, "chunks")
    c.repartitionByRange("provider", "zl", "x").sortWithinPartitions("provider", "zl", "x").write.partitionBy("provider", "zl").parquet(path)
    return spark.read.parquet(path).where("provider = 'BI' AND zl = 12 AND x < 500").groupBy("provider").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(cte("chunks") + "SELECT DISTINCT x//256*256 AS x, y//256*256 AS y, provider, CAST(14 AS INT) AS zl FROM chunks")
def src8_read_texture_names(spark, sf_dir):
    """Names alone, as a store lists them: lines of many names a file. What is no name is left out."""
    t = view(spark, sf_dir, "chunks").selectExpr("x div 256 * 256 AS x", "y div 256 * 256 AS y", "provider").distinct()
    path = shared_dir(t, "names")
    name = F.concat(geo.texture_name("x", "y", "provider", F.lit(14)), F.lit(".dds"))
    t.select(F.explode(F.array(name, F.concat(F.lit("preview_"), name))).alias("value")).write.text(path)
    f = spark.read.text(path).withColumn("t", geo.parse_texture_name("value")).where("t IS NOT NULL")
    return f.select("t.x", "t.y", "t.provider", "t.zl").distinct()


#: How far a text's centre may be from its name's, in degrees.
CENTRE_TOLERANCE = 1e-4
#: Fixed first lines of a terrain text, and what follows a key at its first place: behind any three lines, and below that start, where a plain search will do. Lines of blanks alone don't count; no quantifier gives back, so a text is read once however long it is.
BLANK_LINES = r"(?: *\r?\n)*+"
TER_START = r"\A" + r"\r?\n".join(BLANK_LINES + line for line in ("A", "800", "TERRAIN")) + r"(?:\r?\n|\z)"
TER_VALUE = r"{0}( [^\r\n]*+(?:\r(?!\n)[^\r\n]*+)*+)?(?:\r?\n|\z)"
TER_SEARCH = r"\A(?:" + BLANK_LINES + r"[^\n]*+\n){{3}}+(?:(?!{0}(?: |\r?\n|\z))[^\n]*+\n)*+" + TER_VALUE
TER_NAME = r"^(\d+)_(\d+)_([A-Za-z]+)(\d{2})\.ter$"


def read_terrain_files(files: DataFrame) -> DataFrame:
    """(name, til_x, til_y, provider, zl, texture, fault): terrain texts, each checked against its name.

    ``files``: name, text. Faults, the first that holds: 'name', 'header', 'missing' (LOAD_CENTER or
    BASE_TEX_NOWRAP), 'centre' (not four numbers, not the texture's middle, or not 4096), 'texture' (another's). Null if
    there is none. A line is a key and the rest; of equal keys the first counts.
    """
    named, stem = F.rlike("name", F.lit(TER_NAME)), F.replace("name", F.lit(".ter"), F.lit(""))
    headed = F.coalesce(F.startswith("text", F.lit("A\n800\nTERRAIN\n")) | F.rlike("text", F.lit(TER_START)), F.lit(False))
    f = files.select("name", "text", named.alias("named"), F.split(F.substring_index("name", ".", 1), "_").alias("part"), headed.alias("headed"))
    value = lambda key: F.trim(F.nullif(F.when(F.col("headed"), F.regexp_extract("text", r"\n" + TER_VALUE.format(key), 1)).otherwise(F.regexp_extract("text", TER_SEARCH.format(key), 1)), F.lit("")))
    f = f.withColumn("centre", value("LOAD_CENTER")).withColumn("base", value("BASE_TEX_NOWRAP")).withColumn("n", F.split("centre", " +"))
    number = lambda i: F.try_to_number(F.get("n", i), F.lit("S9999990.0000000")).cast("double")
    of_name = lambda v: F.when(F.col("named"), F.expr(v))
    f = f.withColumn("til_x", of_name("try_cast(get(part, 1) AS BIGINT)")).withColumn("til_y", of_name("try_cast(get(part, 0) AS BIGINT)")).withColumn("zl", of_name("try_cast(right(get(part, 2), 2) AS INT)"))
    f = f.withColumn("provider", of_name("left(get(part, 2), length(get(part, 2)) - 2)")).withColumn("provider", F.when(~F.col("named"), "").otherwise(F.col("provider")))
    lat, lon = geo.tile_corner(F.col("til_x") + 8, F.col("til_y") + 8, F.col("zl"))
    off = F.greatest(F.abs(number(0) - lat), F.abs(number(1) - lon))
    good = (F.size("n") == 4) & F.coalesce(off <= CENTRE_TOLERANCE, F.lit(False)) & F.coalesce(number(3) == 4096, F.lit(False))
    same = F.endswith("base", F.concat(F.lit("/"), stem, F.lit(".dds"))) | (F.regexp_extract("base", r"([^/]+)\.\w+$", 1) == stem)
    fault = (
        F.when(F.col("til_x").isNull(), "name").when(~F.col("headed"), "header").when(F.col("centre").isNull() | F.col("base").isNull(), "missing")
        .when(~good, "centre").when(~same, "texture")
    )
    return f.select("name", "til_x", "til_y", "provider", "zl", F.col("base").alias("texture"), fault.alias("fault"))


# One text a texture, as rows of a table; by the texture's column some are broken in one way each.
_TEXTURE = "SELECT DISTINCT til_x, til_y, zl, provider FROM built"
_NAME = "til_y||'_'||til_x||'_'||provider||zl"


@query(cte("built") + f"""SELECT CASE WHEN til_x%176=0 THEN 'x' ELSE '' END||{_NAME}||'.ter' AS name, CASE WHEN til_x%176=0 THEN NULL ELSE til_x END AS til_x, CASE WHEN til_x%176=0 THEN NULL ELSE til_y END AS til_y, CASE WHEN til_x%176=0 THEN '' ELSE provider END AS provider, CASE WHEN til_x%176=0 THEN NULL ELSE zl END AS zl,
CASE WHEN til_x%272=0 THEN NULL WHEN til_x%368=0 THEN '../textures/other.dds' ELSE '../textures/'||{_NAME}||'.dds' END AS texture,
CASE WHEN til_x%176=0 THEN 'name' WHEN til_x%208=0 THEN 'header' WHEN til_x%272=0 THEN 'missing' WHEN til_x%304=0 THEN 'centre' WHEN til_x%368=0 THEN 'texture' END AS fault FROM ({_TEXTURE})""")
def src9_read_terrain_files(spark, sf_dir):
    """Terrain texts of all textures, written and read back."""
    t = view(spark, sf_dir, "built").select("til_x", "til_y", "zl", "provider").distinct()
    stem = F.concat_ws("_", F.col("til_y").cast("string"), F.col("til_x").cast("string"), F.concat("provider", F.col("zl").cast("string")))
    lat, lon = geo.tile_corner(F.col("til_x") + 8, F.col("til_y") + 8, F.col("zl"))
    bad = lambda n: F.col("til_x") % n == 0
    five = lambda v: v.cast("decimal(28,5)").cast("string")
    text = F.concat_ws(
        "\n", F.when(bad(208), "I").otherwise("A"), F.lit("800"), F.lit("TERRAIN"), F.lit(""),
        F.concat(F.lit("LOAD_CENTER "), five(lat + F.when(bad(304), 0.001).otherwise(0.0)), F.lit(" "), five(lon), F.lit(" 4000 4096")),
        F.when(~bad(272), F.concat(F.lit("BASE_TEX_NOWRAP ../textures/"), F.when(bad(368), "other").otherwise(stem), F.lit(".dds"))), F.lit("NO_ALPHA"),
    )
    path = shared_dir(t, "ter")
    t.select(F.concat(F.when(bad(176), "x").otherwise(""), stem, F.lit(".ter")).alias("name"), text.alias("text")).write.parquet(path)
    return read_terrain_files(spark.read.parquet(path))


#: Sites of a plan in the formats that hold many plans a file.
SHORT = 4


@query(cte("sites") + f""", k AS (SELECT *, unnest(['fms', 'json', 'xml']) AS form FROM sites), p AS (SELECT *, id//(CASE form WHEN 'fms' THEN {LOT} ELSE {SHORT} END) AS plan FROM k)
SELECT form, CAST(row_number() OVER w - 1 AS INT) AS pos, ident, round(lat, 4) AS lat, round(lon, 4) AS lon, first_value(ident) OVER w AS first, last_value(ident) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM p WINDOW w AS (PARTITION BY form, plan ORDER BY id)""")
def src10_read_flight_plan(spark, sf_dir):
    """Every site in plans of three formats, each point named twice in a row; the second goes."""
    s = view(spark, sf_dir, "sites")
    points = F.transform(F.sort_array(F.collect_list(F.struct("id", "ident", "name", "lat", "lon"))), lambda x: x)
    twice = lambda row: F.flatten(F.transform("p", lambda x: F.array(row(x), row(x))))
    end = lambda i: F.element_at("p", i)

    fms = s.groupBy(lot().alias("plan")).agg(points.alias("p"))
    head = F.concat(F.lit("I\n1100 Version\nADEP "), end(1)["ident"], F.lit("\nADES "), end(-1)["ident"])
    rows = twice(lambda x: F.format_string("1 %s ADEP 0.000000 %.6f %.6f", x["ident"], x["lat"], x["lon"]))
    texts = fms.select(F.concat(head, F.lit("\n"), F.array_join(rows, "\n")).alias("value"))
    path = shared_dir(s, "plans")
    texts.write.option("maxRecordsPerFile", 1).text(f"{path}/fms")  # a plan a file

    short = s.groupBy(F.floor(F.col("id") / SHORT).alias("plan")).agg(points.alias("p"))
    place = lambda x, code: F.struct(x["ident"].alias(code), x["name"].alias("name"), x["lat"].cast("string").alias("pos_lat"), x["lon"].cast("string").alias("pos_long"))
    short.select(place(end(1), "icao_code").alias("origin"), place(end(-1), "icao_code").alias("destination"), F.struct(twice(lambda x: place(x, "ident")).alias("fix")).alias("navlog")).write.json(f"{path}/json")
    spot = twice(lambda x: F.format_string('<Waypoint><Ident>%s</Ident><Name>%s</Name><Pos Lon="%.6f" Lat="%.6f" Alt="0"/></Waypoint>', x["ident"], x["name"], x["lon"], x["lat"]))
    plans = short.select(F.floor(F.col("plan") * SHORT / LOT).alias("lot"), F.concat(F.lit("<Flightplan><Waypoints>"), F.array_join(spot, ""), F.lit("</Waypoints></Flightplan>")).alias("value"))
    whole = plans.groupBy("lot").agg(F.concat(F.lit("<plans>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</plans>")).alias("value"))
    whole.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/xml")  # a document a file

    read = lambda kind: readers.read_flight_plan(spark, f"{path}/{kind}", kind, lines=True).select(F.lit(kind).alias("form"), F.col("n").alias("pos"), "ident", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "first", "last")
    return read("fms").union(read("json")).union(read("xml"))


@query(cte("frames") + """SELECT 'frames' AS part, run, count(*) AS n, round(sum(frame_ms), 3) AS total FROM frames WHERE seq%50 <> 7 GROUP BY run
UNION ALL SELECT 'system', run, count(*), round(sum(seq*3.0e0), 3) FROM frames WHERE seq%50 <> 7 GROUP BY run
UNION ALL SELECT 'threads', run, count(*), round(sum(frame_ms), 3) FROM frames WHERE seq%50 <> 7 GROUP BY run""")
def src11_read_telemetry(spark, sf_dir):
    """Frames, system and thread tables as CSV with a broken row in fifty, which the readers drop."""
    f = view(spark, sf_dir, "frames")
    path = shared_dir(f, "csv")
    ms = F.when(F.expr("seq%50 = 7"), "broken").otherwise(F.col("frame_ms").cast("string"))
    f.select("run", "seq", ms.alias("frame_ms")).write.csv(f"{path}/frames", header=True)
    disks = F.when(F.expr("seq%50 = 7"), "a=").otherwise(F.format_string("a=%d;b=%d", F.col("seq"), F.col("seq") * 2))
    f.select("run", *(F.lit("1.5").alias(c) for c in readers.SYSTEM[1:5]), F.lit("7").alias("net_in"), disks.alias("disks")).write.csv(f"{path}/system", header=True)
    f.select("path_s", F.col("run").alias("thread"), F.lit("main").alias("name"), ms.alias("cpu_s"), F.lit("R").alias("state")).write.csv(f"{path}/threads", header=True)
    frames = readers.read_telemetry(spark, f"{path}/frames", "run bigint, seq bigint, frame_ms double").select("run", "frame_ms")
    system = readers.read_system(spark, f"{path}/system").select(F.col("wall").cast("bigint"), (F.col("disks")["a"] + F.col("disks")["b"]).cast("double"))
    threads = readers.read_threads(spark, f"{path}/threads").select(F.col("thread").cast("bigint"), "cpu_s")
    part = lambda name, t: t.toDF("run", "v").groupBy(F.lit(name).alias("part"), "run").agg(F.count("v").alias("n"), F.round(F.sum("v"), 3).alias("total"))
    return part("frames", frames).union(part("system", system)).union(part("threads", threads))


@query(cte("loads") + "SELECT CASE event_type WHEN 'signup' THEN 'mark' WHEN 'error' THEN 'end' ELSE 'tile' END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_type NOT IN ('signup', 'error') THEN tlat END) AS BIGINT) AS lats FROM loads GROUP BY 1")
def src12_read_sim_log(spark, sf_dir):
    l = view(spark, sf_dir, "loads")
    clock = F.format_string("%.1f", F.col("event_id") / 10.0)
    line = F.when(F.col("event_type") == "signup", F.concat(clock, F.lit(" pilot mark"))).when(F.col("event_type") == "error", F.concat(clock, F.lit(" scenery loaded in 12.5 s"))).otherwise(F.concat(clock, F.lit(" load "), F.format_string("%+03d%+04d", F.col("tlat").cast("int"), F.col("tlon").cast("int"))))
    path = shared_dir(l, "log")
    l.select(line.alias("value")).write.text(path)
    return readers.read_sim_log(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("lat").alias("lats"))


@query(cte("transfers") + "SELECT code, count(*) AS n, sum(bytes) AS bytes FROM transfers GROUP BY code")
def src13_read_transfers(spark, sf_dir):
    t = view(spark, sf_dir, "transfers").select("event_id", "code", "bytes", "time_total")
    path = shared_dir(t, "tsv")
    t.write.csv(path, sep="\t")
    return spark.read.schema("event_id bigint, code int, bytes bigint, time_total double").csv(path, sep="\t").groupBy("code").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query(cte("ways") + "SELECT CASE WHEN way%2=0 THEN 'POLYGON' ELSE 'SEGMENT' END AS kind, way AS number, count(*) AS points FROM ways GROUP BY way")
def src14_read_overlay_text(spark, sf_dir):
    w = view(spark, sf_dir, "ways").groupBy("way").agg(F.count("*").cast("int").alias("k"))
    kind = F.when(F.expr("way%2=0"), "POLYGON").otherwise("SEGMENT")
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.col("k")), lambda i: F.concat(F.lit("POINT "), i.cast("string"))), "\n")
    path = shared_dir(w, "overlay")
    w.select(F.concat(F.lit("BEGIN_"), kind, F.lit(" "), F.col("way").cast("string"), F.lit("\n"), body, F.lit("\nEND_"), kind).alias("value")).write.text(path)
    return readers.read_overlay_text(spark, path + "/part-*").select("kind", "number", "points")


@query(cte("triangles") + "SELECT v3%10 AS tile, count(*) AS n, sum(attr) AS attrs FROM triangles WHERE v3%10 IN (2, 5) GROUP BY 1")
def src15_read_mesh(spark, sf_dir):
    t = view(spark, sf_dir, "triangles").withColumn("tile", F.expr("v3%10"))
    path = shared_dir(t, "mesh")
    t.write.partitionBy("tile").parquet(path)
    return spark.read.parquet(path).where("tile IN (2, 5)").groupBy(F.col("tile").cast("long").alias("tile")).agg(F.count("*").alias("n"), F.sum("attr").alias("attrs"))


@query(cte("artifacts", "edges") + "SELECT rule, count(*) AS n, sum(params) AS params, count(parent) AS made_of, sum(parent) AS parents, count(*) FILTER (key%101 = 0) AS pinned FROM artifacts LEFT JOIN edges ON child = key GROUP BY rule")
def src16_read_artifact_index(spark, sf_dir):
    """Artifacts, what each was made of, and pins, written as an index and read back; the three are joined by key."""
    a = view(spark, sf_dir, "artifacts")
    path = shared_dir(a, "index")
    recipe = F.to_json(F.struct(F.struct("params", "version").alias("params")))
    a.select("key", "rule", "version", "size", F.col("created_at").cast("string").alias("created_at"), recipe.alias("recipe")).write.json(f"{path}/artifacts")
    view(spark, sf_dir, "edges").select("child", F.lit("base").alias("name"), F.col("parent").alias("parent_key")).write.json(f"{path}/edges")
    a.where("key%101 = 0").select(F.concat(F.lit("tile-"), F.col("key").cast("string")).alias("name"), "key", F.col("created_at").cast("string").alias("pinned_at")).write.json(f"{path}/pins")
    t = readers.read_artifact_index(spark, path)
    made = t["edges"].groupBy(F.col("child").alias("key")).agg(F.count("parent_key").alias("k"), F.sum("parent_key").alias("p"))
    kept = t["pins"].select("key", F.lit(1).alias("pin")).distinct()
    j = t["artifacts"].join(made, "key", "left").join(kept, "key", "left")
    return j.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("params")["params"].cast("bigint")).alias("params"), F.sum("k").alias("made_of"), F.sum("p").alias("parents"), F.count("pin").alias("pinned"))


@query(cte("chunks") + "SELECT DISTINCT x//512 AS tile, provider AS layer FROM chunks")
def src17_read_manifest_index(spark, sf_dir):
    m = view(spark, sf_dir, "chunks").groupBy(F.expr("x div 512").alias("tile")).agg(F.collect_set("provider").alias("layers"))
    path = shared_dir(m, "manifest")
    m.write.json(path)
    return spark.read.schema("tile bigint, layers array<string>").json(path).select("tile", F.explode("layers").alias("layer"))


@query(cte("transfers") + "SELECT user_id, max(event_id) AS report FROM transfers GROUP BY user_id")
def src18_read_build_reports(spark, sf_dir):
    t = view(spark, sf_dir, "transfers").select("user_id", "event_id")
    path = shared_dir(t, "reports")
    t.write.json(path)
    return spark.read.schema("user_id bigint, event_id bigint").json(path).groupBy("user_id").agg(F.max("event_id").alias("report"))


@query(cte("zones") + "SELECT priority AS line, CAST(4 AS BIGINT) AS points, round(west, 3) AS first_lon FROM zones WHERE priority%2=0")
def src20_read_border_lines(spark, sf_dir):
    """Lines of the wanted class, rounded, with repeated points removed."""
    p = lambda x, y: F.array(x, y)
    z = view(spark, sf_dir, "zones").select(F.struct(F.col("priority").alias("line"), F.expr("priority%2").alias("class")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.array(p("west", "south"), p("west", "south"), p("east", "south"), p("east", "north"), p("west", "north")).alias("coordinates")).alias("geometry"))
    path = shared_dir(z, "borders")
    z.write.json(path)
    f = spark.read.schema("properties struct<line:bigint,class:bigint>, geometry struct<type:string,coordinates:array<array<double>>>").json(path).where("properties.class = 0")
    q = f.select("properties.line", F.posexplode("geometry.coordinates").alias("pos", "p")).select("line", "pos", F.round(F.get("p", 0), 3).alias("lon"), F.round(F.get("p", 1), 3).alias("lat"))
    w = Window.partitionBy("line").orderBy("pos")
    q = q.withColumn("same", F.lag("lon").over(w).eqNullSafe(F.col("lon")) & F.lag("lat").over(w).eqNullSafe(F.col("lat"))).where("NOT same")
    return q.groupBy("line").agg(F.count("*").alias("points"), F.min_by("lon", "pos").alias("first_lon"))


@query(cte("points") + "SELECT CAST(floor(lat/30) AS BIGINT) AS tlat, count(*) AS n, sum(CASE WHEN floor(lat/30) = 0 THEN 2 ELSE 1 END) AS written FROM points GROUP BY 1")
def snk1_write_tiled(spark, sf_dir):
    """Partitions replaced as wholes: the second write renews one tile row and leaves the others."""
    p = view(spark, sf_dir, "points").select("id", F.floor(F.col("lat") / 30).alias("tlat"), F.lit(1).alias("gen"))
    path = shared_dir(p, "tiled")
    p.write.partitionBy("tlat").parquet(path)
    p.where("tlat = 0").withColumn("gen", F.lit(2)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("tlat").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("tlat").cast("long").alias("tlat")).agg(F.count("*").alias("n"), F.sum("gen").alias("written"))


@query(cte("built") + "SELECT til_x//2048 AS tile, count(*) AS textures, min(o) AS first FROM built GROUP BY 1")
def snk2_write_texture_manifest(spark, sf_dir):
    b = view(spark, sf_dir, "built").select(F.expr("til_x div 2048").alias("tile"), F.expr("til_y div 256").alias("part"), F.struct("o", "til_x", "til_y", "kind").alias("t"))
    path = shared_dir(b, "manifests")
    b.groupBy("tile", "part").agg(F.sort_array(F.collect_list("t")).alias("textures")).write.json(path)
    m = spark.read.schema("tile bigint, part bigint, textures array<struct<o:bigint>>").json(path)
    return m.groupBy("tile").agg(F.sum(F.size("textures")).alias("textures"), F.min(F.get("textures", 0)["o"]).alias("first"))


@query(cte("built") + "SELECT til_x, til_y, count(*) AS lines FROM (SELECT DISTINCT til_x, til_y, kind FROM built) GROUP BY ALL")
def snk4_write_terrain_text(spark, sf_dir):
    """A text for each texture and kind, in folders of many columns."""
    t = view(spark, sf_dir, "built").select("til_x", "til_y", "kind").distinct()
    path = shared_dir(t, "terrain")
    text = F.concat_ws(" ", F.lit("TEX"), F.col("til_x").cast("string"), F.col("til_y").cast("string"), "kind")
    t.select(F.expr("til_x div 65536").alias("columns"), text.alias("value")).repartition("columns").write.partitionBy("columns").text(path)
    own = lambda i: F.get(F.split("value", " "), i).cast("long")
    r = spark.read.text(path).select(own(1).alias("til_x"), own(2).alias("til_y"))
    return r.groupBy("til_x", "til_y").agg(F.count("*").alias("lines"))


@query(cte("ways") + "SELECT way, string_agg(d, ',' ORDER BY pos, node) AS deltas FROM (SELECT way, pos, node, node - coalesce(lag(node) OVER (PARTITION BY way ORDER BY pos, node), 0) AS d FROM (SELECT DISTINCT way, pos, node FROM ways)) GROUP BY way")
def snk5_write_border_deltas(spark, sf_dir):
    """Chains as differences, which keeps their numbers small."""
    w = Window.partitionBy("way").orderBy("pos", "node")
    d = view(spark, sf_dir, "ways").select("way", "pos", "node").distinct().withColumn("d", F.col("node") - F.coalesce(F.lag("node").over(w), F.lit(0)))
    chains = d.groupBy("way").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node", "d"))), lambda v: v["d"]).alias("deltas"))
    path = shared_dir(chains, "deltas")
    chains.write.json(path)
    return spark.read.schema("way bigint, deltas array<bigint>").json(path).select("way", F.array_join(F.transform("deltas", lambda v: v.cast("string")), ",").alias("deltas"))
