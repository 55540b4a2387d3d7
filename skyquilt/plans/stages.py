"""Stages: named steps whose results are kept by a key of their recipe and not made twice."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import cte, view
from ..operators.joins import shared_dir
from ..registry import query
from .maps import KEPT, ar6_simplify, it2_stitch_rings

STAGES: dict[str, Callable] = {}


def recipe_key(name: str, version: int, params: dict, inputs: dict[str, str]) -> str:
    """SHA-256 of the recipe as JSON with sorted names: the same content, the same key."""
    recipe = {"inputs": inputs, "params": params, "rule": name, "version": version}
    return hashlib.sha256(json.dumps(recipe, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def stage(name: str, version: int = 1) -> Callable:
    """Make a function (spark, **inputs, **params) -> DataFrame a stage.

    Called with a store and the keys of its inputs, it returns (key, table, made): the table is read from
    the store if a finished output of that key is there, else made and written.
    """

    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, store: str, inputs: dict[str, tuple[str, DataFrame]], **params) -> tuple[str, DataFrame, bool]:
            key = recipe_key(name, version, params, {k: v[0] for k, v in inputs.items()})
            path = f"{store}/{name}-{key}"
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
            done = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
            if not done:
                f(spark, **{k: v[1] for k, v in inputs.items()}, **params).write.mode("overwrite").parquet(path)
            return key, spark.read.parquet(path), not done

        STAGES[name] = run
        return run

    return keep


@stage("count-by-square", version=2)
def count_by_square(spark, points: DataFrame, size: int) -> DataFrame:
    return points.groupBy(F.floor(F.col("lat") / size).alias("a"), F.floor(F.col("lon") / size).alias("b")).agg(F.count("*").alias("n"))


@query(cte("points") + "SELECT CAST(floor(lat/20) AS BIGINT) AS a, CAST(floor(lon/20) AS BIGINT) AS b, count(*) AS n, true AS first, false AS second FROM points GROUP BY 1, 2")
def ud1_stage(spark, sf_dir):
    """The second call finds what the first one made."""
    points = view(spark, sf_dir, "points")
    store = shared_dir(points, "stages")
    _, _, first = count_by_square(spark, store, {"points": ("points@" + sf_dir, points)}, size=20)
    _, table, second = count_by_square(spark, store, {"points": ("points@" + sf_dir, points)}, size=20)
    return table.select("a", "b", "n", F.lit(first).alias("first"), F.lit(second).alias("second"))


@query(KEPT + ", " + cte("members").removeprefix("WITH ") + "SELECT 'rings' AS kind, count(*) AS n FROM (SELECT rel FROM members WHERE there GROUP BY rel HAVING count(*) = 6) UNION ALL SELECT 'points', count(*) FROM kept")
def ud5_grouped_map(spark, sf_dir):
    """A grouped map for SQL-less work, the kept points of chains, beside the rings that are ranked without one."""
    rings = it2_stitch_rings(spark, sf_dir).where("place = 0").agg(F.lit("rings").alias("kind"), F.count("*").alias("n"))
    return rings.unionByName(ar6_simplify(spark, sf_dir).agg(F.lit("points").alias("kind"), F.count("*").alias("n")))


@query("SELECT CAST(count(*)*169 AS BIGINT) AS posts, count(*) AS cells FROM supplier")
def ud6_binary_decode(spark, sf_dir):
    """Binary cells decoded in Arrow batches."""
    from ..sources.queries import src5_read_elevation

    return src5_read_elevation(spark, sf_dir).agg(F.sum("posts").alias("posts"), F.count("*").alias("cells"))
