"""Readers of the formats that scenery data comes in, and writers of those it leaves in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Line records: 1, 16 or 17 opens an airport; 1302 is metadata, 100-102 a runway; 99 ends.

    Lines of one file are numbered inside it, and the record of a line is the number of headers up to it.
    A record without a runway gives no row. Columns: file, rec, kind, elev_ft, ident, name, icao, lat, lon.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split(F.regexp_replace("value", "﻿", ""), r"\r?\n")).alias("n", "line"))
    lines = lines.withColumn("f", F.split(F.trim("line"), r"\s+")).withColumn("code", F.get("f", 0))
    head = F.col("code").isin("1", "16", "17")
    rec = F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("rec", rec).where("rec > 0")
    pick = lambda c, i, t: F.min(F.when(c, F.try_element_at("f", F.lit(i + 1)))).cast(t)
    runway = F.col("code").isin("100", "101", "102")
    end = lambda a, b: F.avg(F.when(runway, (F.try_element_at("f", F.lit(a)).cast("double") + F.try_element_at("f", F.lit(b)).cast("double")) / 2))
    a = lines.groupBy("file", "rec").agg(
        pick(head, 0, "string").alias("code"), pick(head, 1, "int").alias("elev_ft"), pick(head, 4, "string").alias("ident"),
        F.min(F.when(head, F.array_join(F.slice("f", 6, 100), " "))).alias("name"),
        F.min(F.when((F.col("code") == "1302") & (F.get("f", 1) == "icao_code"), F.get("f", 2))).alias("icao"), end(10, 19).alias("lat"), end(11, 20).alias("lon"),
    )
    kind = F.when(F.col("code") == "1", "land").when(F.col("code") == "16", "sea").otherwise("heli")
    return a.where("lat IS NOT NULL").select("file", "rec", kind.alias("kind"), "elev_ft", "ident", "name", "icao", "lat", "lon")


ELEMENTS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,members:array<struct<type:string,ref:bigint,role:string>>,tags:map<string,string>>>"


def read_osm_json(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """Nodes, ways and relations of documents with an ``elements`` list; ``lines``: a document a line, not a file."""
    e = spark.read.schema(ELEMENTS).json(path, multiLine=not lines).select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*")
    return {
        "nodes": e.where("type = 'node'").select("id", "lat", "lon", "tags", "pos"),
        "ways": e.where("type = 'way'").select("id", "nodes", "tags", "pos"),
        "relations": e.where("type = 'relation'").select("id", "members", "tags", "pos"),
    }


def read_osm_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same three tables from XML, plain or compressed."""
    tag = "tag array<struct<_k:string,_v:string>>"
    tags = F.coalesce(F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"]))), F.create_map().cast("map<string,string>"))
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(path)
    return {
        "nodes": read("node", f"_id bigint, _lat double, _lon double, {tag}").select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tags.alias("tags")),
        "ways": read("way", f"_id bigint, nd array<struct<_ref:bigint>>, {tag}").select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), tags.alias("tags")),
        "relations": read("relation", f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {tag}").select(F.col("_id").alias("id"), F.col("member").alias("members"), tags.alias("tags")),
    }


def read_zones(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Zones of a document, in their order; a closing vertex is dropped, an empty provider is null."""
    schema = "format string, zones array<struct<id:string,name:string,zl:int,provider:string,polygon:array<array<double>>>>"
    z = spark.read.schema(schema).json(path, multiLine=not lines).select(F.posexplode("zones").alias("priority", "z")).select("priority", "z.*")
    closed = F.get("polygon", 0) == F.element_at("polygon", -1)
    ring = F.when(closed, F.slice("polygon", F.lit(1), F.size("polygon") - 1)).otherwise(F.col("polygon"))
    return z.select("priority", "id", "name", "zl", F.nullif("provider", F.lit("")).alias("provider"), F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, 9))).alias("polygon"))


def read_elevation(spark: SparkSession, path: str, block: int = 256) -> DataFrame:
    """Square big-endian 16-bit cells, north row first, as rows (file, row, col, alt); one task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                z = np.frombuffer(data, ">i2").astype(np.int32)
                side = int(round(len(z) ** 0.5))
                for at in range(0, side, block):
                    part = z[at * side : (at + block) * side]
                    rows = np.repeat(np.arange(at, at + len(part) // side, dtype=np.int32), side)
                    yield pa.RecordBatch.from_pydict({"file": [name] * len(part), "row": rows, "col": np.tile(np.arange(side, dtype=np.int32), len(part) // side), "alt": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, row int, col int, alt int")


def read_texture_names(spark: SparkSession, path: str) -> DataFrame:
    """Textures by the names of files, ``y_x_<provider><level>``, without reading them."""
    from ..functions.geo import parse_texture_name

    f = spark.read.format("binaryFile").load(path).select("path").withColumn("t", parse_texture_name("path"))
    return f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "t.*")


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Terrain files: a line is a key and the rest; one row a file and key."""
    t = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.split("value", " ", 2).alias("p"))
    return t.where(F.size("p") == 2).select("file", F.get("p", 0).alias("key"), F.get("p", 1).alias("value"))


# What marks a point in a text plan.
POINT_TYPES = ["1", "2", "3", "11", "13", "28"]
POINT = "struct<ident:string,name:string,lat:double,lon:double>"


def _point(ident, name, lat, lon):
    """A point of a plan, null if its place is none on earth."""
    lat, lon = (v.try_cast("double") for v in (lat, lon))
    code = F.coalesce(F.nullif(F.left(F.upper(F.trim(ident)), F.lit(8)), F.lit("")), F.lit("?"))
    made = F.struct(code.alias("ident"), F.left(F.trim(F.coalesce(name, F.lit(""))), F.lit(60)).alias("name"), lat.alias("lat"), lon.alias("lon"))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), made)


def _route(plans: DataFrame) -> DataFrame:
    """file, plan, points, first, last to a row a point: no point twice in a row, the ends named by the plan or by its points.

    A point meets the one before it in a window of its plan, so a plan costs what it is long.
    """
    rows = plans.select("file", "plan", "first", "last", F.posexplode("points").alias("at", "p")).where("p IS NOT NULL")
    way = Window.partitionBy("plan").orderBy("at")
    whole = way.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.struct("p.lat", "p.lon")
    rows = rows.withColumn("again", F.coalesce(F.lag(place).over(way) == place, F.lit(False))).where("NOT again")
    end = lambda given, own: F.coalesce(F.nullif(F.left(F.upper(F.trim(given)), F.lit(8)), F.lit("")), own("p.ident").over(whole))
    return rows.select("file", "plan", (F.row_number().over(way) - 1).alias("n"), "p.*", end("first", F.first).alias("first"), end("last", F.last).alias("last"))


def read_flight_plan(spark: SparkSession, path: str, kind: str = "fms", lines: bool = False) -> DataFrame:
    """Points of route plans: file, plan, n, ident, name, lat, lon, first, last; no point twice in a row.

    ``kind``: ``fms`` text (two head lines, ends by name, points ``type ident ... lat lon``; one plan a file),
    ``xml`` waypoints (any number of plans a file), or ``json`` with a navigation log between an origin and a
    destination (one plan a file, or with ``lines`` a line). A point without a place on earth is left out.
    """
    if kind == "xml":
        place = "Waypoint array<struct<Ident:string,Name:string,Pos:struct<_Lat:string,_Lon:string>>>"
        raw = spark.read.format("xml").option("rowTag", "Flightplan").schema(f"Waypoints struct<{place.replace(' ', ':', 1)}>").load(path)
        made = F.transform("Waypoints.Waypoint", lambda w: _point(w["Ident"], w["Name"], w["Pos"]["_Lat"], w["Pos"]["_Lon"]))
        return _route(raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("plan"), made.alias("points"), F.lit(None).cast("string").alias("first"), F.lit(None).cast("string").alias("last")))
    if kind == "json":
        end = "struct<icao_code:string,iata_code:string,name:string,pos_lat:string,pos_long:string>"
        raw = spark.read.schema(f"origin {end}, destination {end}, navlog struct<fix:string>").json(path, multiLine=not lines)
        log = F.when(F.col("navlog.fix").startswith("{"), F.concat(F.lit("["), F.col("navlog.fix"), F.lit("]"))).otherwise(F.col("navlog.fix"))
        fixes = F.coalesce(F.from_json(log, "array<struct<ident:string,name:string,pos_lat:string,pos_long:string>>"), F.array().cast("array<struct<ident:string,name:string,pos_lat:string,pos_long:string>>"))
        code = lambda e: F.coalesce(F.col(f"{e}.icao_code"), F.col(f"{e}.iata_code"))
        ends = [_point(code(e), F.col(f"{e}.name"), F.col(f"{e}.pos_lat"), F.col(f"{e}.pos_long")) for e in ("origin", "destination")]
        made = F.concat(F.array(ends[0]), F.transform(fixes, lambda f: _point(f["ident"], f["name"], f["pos_lat"], f["pos_long"])), F.array(ends[1]))
        return _route(raw.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("plan"), made.alias("points"), code("origin").alias("first"), code("destination").alias("last")))
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("line"))
    words = F.filter(F.transform("line", lambda v: F.split(F.trim(v), r"\s+")), lambda w: F.get(w, F.lit(0)) != "")
    raw = raw.select("file", F.monotonically_increasing_id().alias("plan"), words.alias("w")).where(F.left(F.get(F.get("w", 0), 0), F.lit(1)).isin("I", "A") & F.get(F.get("w", 1), 0).rlike(r"^\d"))
    body = F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(0)))
    end = lambda k: F.get(F.get(F.filter(body, lambda w: (F.get(w, F.lit(0)) == k) & (F.size(w) >= 2)), F.lit(0)), F.lit(1))
    spots = F.filter(body, lambda w: F.get(w, F.lit(0)).isin(POINT_TYPES) & (F.size(w) >= 5))
    made = F.transform(spots, lambda w: _point(F.get(w, F.lit(1)), F.lit(""), F.element_at(w, -2), F.element_at(w, -1)))
    return _route(raw.select("file", "plan", made.alias("points"), end("ADEP").alias("first"), end("ADES").alias("last")))


FRAMES = "run_s double, path_s double, frame_ms double, lat double, lon double, ele_m double, state int"
# Columns of the system table, those that each row must have and those that came later.
SYSTEM = ["wall", "xplane_rss_mb", "xplane_cpu_s", "streamer_rss_mb", "streamer_cpu_s", "net_in", "disks"]
SYSTEM_LATER = ["xplane_footprint_mb", "xplane_read_mb", "xplane_pageins", "mem_free_pct", "pressure", "compressed_mb", "swapped_mb", "heat"]


def read_telemetry(spark: SparkSession, path: str, schema: str = FRAMES) -> DataFrame:
    """CSV by an explicit schema; malformed rows go, whichever columns are asked for."""
    return spark.read.schema(schema).option("columnPruning", False).csv(path, header=True, mode="DROPMALFORMED")


def _texts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in columns)).csv(path, header=True)


def read_system(spark: SparkSession, path: str) -> DataFrame:
    """System samples: ``disks`` (``name=bytes;...``) as a map; a row without its first columns goes, later ones may be null."""
    t = _texts(spark, path, SYSTEM + SYSTEM_LATER)
    numbers = [F.col(c).try_cast("bigint" if c == "net_in" else "double").alias(c) for c in SYSTEM if c != "disks"]
    parts = F.filter(F.split("disks", ";"), lambda d: d != "")
    halves = lambda d, i: F.get(F.split(d, "="), F.lit(i))
    whole = F.forall(parts, lambda d: (F.size(F.split(d, "=")) == 2) & halves(d, 1).try_cast("bigint").isNotNull())
    disks = F.when(whole, F.map_from_entries(F.transform(parts, lambda d: F.struct(halves(d, 0), halves(d, 1).try_cast("bigint")))))
    out = t.select(*numbers, disks.alias("disks"), *(F.col(c).try_cast("double").alias(c) for c in SYSTEM_LATER))
    return out.dropna(subset=SYSTEM)


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Thread samples: wall, thread, name, cpu_s, state; rows without a time or a count of seconds go."""
    t = _texts(spark, path, ["wall", "thread", "name", "cpu_s", "state"])
    text = lambda c, other: F.coalesce(c, F.lit(other)).alias(c)
    out = t.select(F.col("wall").try_cast("double").alias("wall"), text("thread", "?"), "name", F.col("cpu_s").try_cast("double").alias("cpu_s"), text("state", ""))
    return out.dropna(subset=["wall", "cpu_s"])


def read_artifact_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Artifacts with what their recipe says, edges to what each was made of, and pins; folders of JSON lines."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    a = read("artifacts", "key bigint, rule string, version bigint, size bigint, created_at string, recipe string")
    return {
        "artifacts": a.withColumn("params", F.coalesce(F.from_json("recipe", "params map<string,string>")["params"], F.create_map().cast("map<string,string>"))),
        "edges": read("edges", "child bigint, name string, parent_key bigint"),
        "pins": read("pins", "name string, key bigint, pinned_at string"),
    }


def read_sim_log(spark: SparkSession, path: str) -> DataFrame:
    """Typed events of a log: tile loads (lat, lon), marks, and ends of a load with seconds."""
    t = spark.read.text(path)
    load, done = r"^(\d+\.\d+) load ([+-]\d+)([+-]\d+)$", r"^(\d+\.\d+) scenery loaded in (\d+(?:\.\d+)?) s$"
    g = lambda p, i: F.nullif(F.regexp_extract("value", p, i), F.lit(""))
    kind = F.when(F.col("value").rlike(load), "tile").when(F.col("value").rlike(done), "end").when(F.col("value").contains(" mark"), "mark")
    return t.select(kind.alias("kind"), g(r"^(\d+\.\d+)", 1).cast("double").alias("clock"), g(load, 2).cast("int").alias("lat"), g(load, 3).cast("int").alias("lon"), g(done, 2).cast("double").alias("seconds")).where("kind IS NOT NULL")


def read_overlay_text(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between BEGIN and END lines: file, block, kind, number, points.

    A line that begins with BEGIN_ ends the record before it, so a row is a block and a file of any size is read by
    splits. What stands before a file's first block is no block: it is the first record of the file's first split.
    Blocks are numbered from 1 in a file; who doesn't ask for the number doesn't pay for it.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n = None, 0
        for batch in batches:
            kept, places = [], []
            for own in zip(*(batch[c].to_pylist() for c in ("file", "start", "begun"))):
                n = n + 1 if own[:2] == split else 0
                split = own[:2]
                kept.append(n > 0 or own[1] > 0 or own[2])
                places.append(n)
            out = batch.append_column("nth", pa.array(places, pa.int64())).filter(pa.array(kept, pa.bool_()))
            yield out.select(["file", "start", "nth", "kind", "number", "points"])

    lines = spark.read.option("lineSep", "\nBEGIN_").text(path)
    record = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").startswith("BEGIN_").alias("begun"),
        F.regexp_extract("value", r"^(?:BEGIN_)?(\w+)", 1).alias("kind"), F.nullif(F.regexp_extract("value", r"^[^\n]*? (\d+)", 1), F.lit("")).cast("long").alias("number"),
        F.regexp_count("value", F.lit("\nPOINT")).cast("long").alias("points"),
    )
    own = record.mapInArrow(blocks, "file string, start long, nth long, kind string, number long, points long")
    block = F.row_number().over(Window.partitionBy("file").orderBy("start", "nth"))
    return own.select("file", block.alias("block"), "kind", "number", "points")
