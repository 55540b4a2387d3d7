"""Domain tables as views over the base tables: one definition, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    "points": ("customer", ["c_custkey AS id", "CAST((c_custkey*7919)%14000 AS DOUBLE)/100.0-70.0 AS lat", "CAST((c_custkey*10007)%36000 AS DOUBLE)/100.0-180.0 AS lon"]),
    "sites": (
        "supplier",
        [
            "s_suppkey AS id", "concat('AP', lpad(CAST(s_suppkey AS VARCHAR(10)),4,'0')) AS ident", "s_name AS name",
            "CAST((s_suppkey*4099)%12000 AS DOUBLE)/100.0-60.0 AS lat", "CAST((s_suppkey*8191)%34000 AS DOUBLE)/100.0-170.0 AS lon",
            "CASE s_suppkey%3 WHEN 0 THEN 'land' WHEN 1 THEN 'sea' ELSE 'heli' END AS kind",
        ],
    ),
    "zones": (
        "supplier",
        [
            "s_suppkey AS priority", "CAST((s_suppkey*13)%325-150 AS DOUBLE) AS west", "CAST((s_suppkey*7)%100-50 AS DOUBLE) AS south",
            "CAST((s_suppkey*13)%325-150 AS DOUBLE)+1.5+(s_suppkey%4)*0.75 AS east", "CAST((s_suppkey*7)%100-50 AS DOUBLE)+1.25+(s_suppkey%3)*0.5 AS north",
            "12+s_suppkey%5 AS zl",
        ],
    ),
    "fixes": (
        "events",
        [
            "user_id AS aircraft", "ts", "event_id", "CAST((user_id*37)%100 AS DOUBLE)-50.0+CAST((event_id*31)%2000 AS DOUBLE)/1000.0 AS lat",
            "CAST((user_id*71)%340 AS DOUBLE)-170.0+CAST((event_id*17)%3000 AS DOUBLE)/1000.0 AS lon", "value AS gs_ms", "CAST((event_id*13)%9000 AS DOUBLE) AS agl_m",
            "CAST((event_id*29)%60 AS DOUBLE)-40.0 AS vs_ms",
        ],
    ),
    "frames": ("events", ["user_id AS run", "event_id AS seq", "CAST((event_id*7)%36000 AS DOUBLE)/10.0 AS path_s", "value AS frame_ms", "CASE WHEN event_type='error' THEN 1 ELSE 2 END AS state"]),
    "loads": ("events", ["user_id AS run", "ts", "event_id", "CAST(floor(value) AS INT)%6+58 AS tlat", "CAST(event_id%8 AS INT)+8 AS tlon", "event_type"]),
    "transfers": ("events", ["event_id", "user_id", "CASE WHEN event_type='error' THEN 503 ELSE 200 END AS code", "CAST(floor(value) AS BIGINT)*1000 AS bytes", "value/1000.0 AS time_total", "ts"]),
    "chunks": (
        "lineitem",
        [
            "l_orderkey AS o", "l_linenumber AS ln", "CASE l_returnflag WHEN 'A' THEN 'BI' WHEN 'N' THEN 'EOX' ELSE 'Arc' END AS provider",
            "12 AS zl", "(l_partkey*16+l_linenumber)%4096 AS x", "(l_suppkey*16+l_orderkey%16)%4096 AS y",
            "CASE WHEN l_orderkey%11=0 THEN 1 WHEN l_orderkey%13=0 THEN 2 WHEN l_orderkey%29=0 THEN 3 ELSE 0 END AS status",
            "CAST(floor(l_extendedprice) AS BIGINT) AS bytes", "l_shipdate AS fetched_at",
        ],
    ),
    "artifacts": ("orders", ["o_orderkey AS key", "o_orderpriority AS rule", "1+o_custkey%3 AS version", "CAST(floor(o_totalprice) AS BIGINT) AS size", "o_orderdate AS created_at", "o_custkey AS params"]),
    "edges": ("orders", ["o_orderkey AS child", "CAST(floor(o_orderkey/3) AS BIGINT) AS parent"]),
    "raster": ("part", ["CAST(floor(p_partkey/50) AS BIGINT) AS r", "p_partkey%50 AS c", "CASE WHEN p_partkey%17=0 THEN -32768.0 ELSE CAST((p_partkey*29)%500 AS DOUBLE)+p_size END AS alt"]),
    "nodes": ("orders", ["o_orderkey AS id", "CAST((o_orderkey*613)%1000 AS DOUBLE)/1000.0 AS x", "CAST((o_orderkey*389)%1000 AS DOUBLE)/1000.0 AS y", "o_totalprice/1000.0 AS z"]),
    "triangles": ("lineitem", ["l_orderkey AS v1", "l_partkey AS v2", "l_suppkey AS v3", "l_linenumber AS n", "CASE WHEN l_linenumber>4 THEN 0 ELSE l_linenumber END AS attr"]),
    "pixels": ("embeddings", ["label AS cloud", "vec_id AS px", "CAST(vec_id%256 AS INT) AS here", "CAST((vec_id*7+label*3)%256 AS INT) AS src", "vec_id%5<>0 AS have", "vec_id%3=0 AS core"]),
    "tags": ("part", ["p_partkey AS id", "p_brand AS brand", "p_type AS type", "CAST(p_size AS VARCHAR(10)) AS size", "p_name AS name"]),
    # Order lines as the ways of a map: an order's lines in turn name nodes of the same key space.
    "ways": ("lineitem", ["l_orderkey AS way", "l_linenumber AS pos", "(l_orderkey*31+l_linenumber*17)%15000 AS node", "l_shipdate AS at"]),
}

# Short pieces of line and small boxes; each 20,000 keys are spread over a unit square of their own, so density stays.
VIEWS["segments"] = (
    "orders",
    [
        "o_orderkey AS id", "((o_orderkey*613)%10007)/10007e0 + floor(o_orderkey/20000) AS x1", "((o_orderkey*389)%9973)/9973e0 AS y1",
        "((o_orderkey*613)%10007)/10007e0 + floor(o_orderkey/20000) + 0.002e0*(o_orderkey%5+1) AS x2", "((o_orderkey*389)%9973)/9973e0 + 0.0015e0*(o_orderkey%7-3) AS y2",
        "o_totalprice/1000e0 AS z1", "o_totalprice/1000e0 + 1 AS z2",
    ],
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def cte(*names: str) -> str:
    """``WITH`` of these views, for SQL over the base tables."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names) + " "
