"""Artefacts: lineage, reachability, garbage, space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixtures import cte, table, view
from ..operators.joins import first_in_budget, written
from ..registry import query

A = cte("artifacts")
TREE = "WITH RECURSIVE edges AS (SELECT o_orderkey AS child, o_orderkey//3 AS parent FROM orders WHERE o_orderkey > 0), "


def edges(spark, sf_dir) -> DataFrame:
    """(child, parent): what an artefact was made from; no artefact is its own parent."""
    e = view(spark, sf_dir, "edges").where("child <> parent")
    return e.join(view(spark, sf_dir, "artifacts").select(F.col("key").alias("parent")), "parent", "left_semi").select("child", "parent")


#: Levels after which what is reached is written together.
TOGETHER = 8


def reachable(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Keys reached from ``roots`` (key) along child to parent, roots included.

    One join a level; each level is a written table, so plans do not grow and lost executors cost one level. A key is
    written once as new, and once more for each ``TOGETHER`` levels, when the small tables are made one.
    """
    front = written(roots.select("key").distinct(), "roots")
    seen = [front]
    while True:
        every = _joined(seen)
        found = front.join(links, front["key"] == links["child"]).select(F.col("parent").alias("key")).distinct()
        front = written(found.join(every, "key", "left_anti"), "front")
        if front.isEmpty():
            return every
        if len(seen) > TOGETHER:
            seen = [seen[0], written(_joined(seen[1:]), "levels")]
        seen.append(front)


def _joined(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


@query(TREE + "r(key) AS (SELECT o_orderkey FROM orders WHERE o_orderkey%97 = 0 UNION SELECT parent FROM r JOIN edges ON child = key) SELECT key FROM r")
def it4_reachable(spark, sf_dir):
    return reachable(edges(spark, sf_dir), view(spark, sf_dir, "artifacts").where("key%97 = 0"))


@query(TREE + "s(key, ok) AS (SELECT 0::BIGINT, true UNION ALL SELECT child, ok AND child%13 <> 5 FROM s JOIN edges ON parent = key) SELECT key, CASE WHEN ok THEN 'hit' WHEN key%13 = 5 THEN 'build' ELSE 'unknown' END AS status FROM s")
def it5_plan_status(spark, sf_dir):
    """Hit while all ancestors are hits; a missing one must be built, and what depends on it is unknown till then."""
    links = edges(spark, sf_dir)
    front = written(view(spark, sf_dir, "artifacts").where("key = 0").select("key", F.lit(True).alias("ok")), "status")
    levels = [front]
    while True:
        front = written(front.join(links, front["key"] == links["parent"]).select(F.col("child").alias("key"), (F.col("ok") & (F.col("child") % 13 != 5)).alias("ok")), "status")
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("key", F.when(F.col("ok"), "hit").when(F.col("key") % 13 == 5, "build").otherwise("unknown").alias("status"))


@query(TREE + "keep(key) AS (SELECT o_orderkey FROM orders WHERE o_orderkey%101 = 0 UNION SELECT parent FROM keep JOIN edges ON child = key), a AS (SELECT o_orderkey AS key, o_orderpriority AS rule, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS used FROM orders), r AS (SELECT *, sum(size) OVER (PARTITION BY rule ORDER BY used, key ROWS UNBOUNDED PRECEDING) AS freed FROM a WHERE key NOT IN (SELECT key FROM keep)) SELECT rule, key, size FROM r WHERE freed - size < 5000000")
def tk3_gc_lru(spark, sf_dir):
    """What no root needs, least recently used first, until a rule's quota is freed."""
    a = view(spark, sf_dir, "artifacts")
    kept = reachable(edges(spark, sf_dir), a.where("key%101 = 0"))
    free = written(a.join(kept, "key", "left_anti").select("rule", "key", "size", "created_at", F.expr("key div 4096").alias("block")), "free")
    budgets = free.select("rule").distinct().withColumn("budget", F.lit(5_000_000).cast("long"))
    return first_in_budget(free, "rule", ["created_at", "block", "key"], "size", budgets).select("rule", "key", "size")


@query(A + "SELECT rule, params, key, version FROM (SELECT *, row_number() OVER (PARTITION BY rule, params ORDER BY created_at DESC, key DESC) AS rn FROM artifacts WHERE version <= 2) WHERE rn = 1")
def wn21_latest_per_params(spark, sf_dir):
    newest = F.max(F.struct("created_at", "key", "version")).alias("m")
    return view(spark, sf_dir, "artifacts").where("version <= 2").groupBy("rule", "params").agg(newest).select("rule", "params", "m.key", "m.version")


@query(A + "SELECT rule, sum(size) AS bytes, sum(size) FILTER (version <> 3) AS own_bytes, count(*) AS n FROM artifacts GROUP BY ROLLUP (rule)")
def ag23_disk_by_rule(spark, sf_dir):
    return view(spark, sf_dir, "artifacts").rollup("rule").agg(F.sum("size").alias("bytes"), F.sum(F.when(F.col("version") != 3, F.col("size"))).alias("own_bytes"), F.count("*").alias("n"))


@query(A + "SELECT version AS dev, sum(s) AS bytes FROM (SELECT version, params, min(size) AS s FROM artifacts GROUP BY ALL) GROUP BY version")
def ag24_disk_bytes_once(spark, sf_dir):
    """A file with several names counts once: (device, inode) is (version, params)."""
    once = view(spark, sf_dir, "artifacts").groupBy(F.col("version").alias("dev"), F.col("params").alias("inode")).agg(F.min("size").alias("s"))
    return once.groupBy("dev").agg(F.sum("s").alias("bytes"))


#: Weight of a new run, and seconds of a rule that nothing is known of.
ALPHA, UNKNOWN_S = 0.3, 1.0


def ewma_costs(runs: DataFrame) -> DataFrame:
    """(rule, version, cost, n): the exponential mean of a rule's seconds by version, as a weighted sum: the k-th run from the end weighs 0.3 * 0.7^k.

    ``runs``: rule, version, seconds, day, run (which tells runs of a day apart).
    """
    own = Window.partitionBy("rule", "version")
    r = runs.withColumn("n", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("day", "run")))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(1 - ALPHA), F.col("n") - 1)).otherwise(ALPHA * F.pow(F.lit(1 - ALPHA), F.col("n") - F.col("i")))
    return r.groupBy("rule", "version").agg(F.sum(weight * F.greatest(F.col("seconds"), F.lit(0.0))).alias("cost"), F.max("n").cast("long").alias("n"))


def estimates(asked: DataFrame, costs: DataFrame) -> DataFrame:
    """(rule, version, cost, from_version): what a rule of a version will cost: its own mean, else that of the latest version with runs, else the default."""
    latest = costs.groupBy("rule").agg(F.max(F.struct("version", "cost")).alias("l"))
    own = costs.select("rule", "version", "cost", F.col("version").alias("from_version"))
    j = asked.join(own, ["rule", "version"], "left").join(latest, "rule", "left")
    return j.select("rule", "version", F.coalesce("cost", "l.cost", F.lit(UNKNOWN_S)).alias("cost"), F.coalesce("from_version", "l.version").alias("from_version"))


# Rules run at odd versions, and one in ten never; asked for are versions 1 to 6.
RUNS = "SELECT o_orderpriority||'/'||(o_custkey%50) AS rule, 1+CAST(floor(o_custkey/50) AS BIGINT)%2*2+(o_custkey%50)%2*2 AS version, o_totalprice/1000 AS seconds, o_orderdate AS day, o_orderkey AS run FROM orders WHERE o_custkey%10 <> 3"
ASKED = "SELECT DISTINCT o_orderpriority||'/'||(o_custkey%50) AS rule FROM orders"


@query(TREE.replace("RECURSIVE edges", "RECURSIVE e0") + f"""runs AS (SELECT *, row_number() OVER (PARTITION BY rule, version ORDER BY day, run) AS i FROM ({RUNS})),
e(rule, version, i, v) AS (SELECT rule, version, i, seconds FROM runs WHERE i = 1 UNION ALL SELECT r.rule, r.version, r.i, 0.7e0*e.v + 0.3e0*r.seconds FROM e JOIN runs r ON r.rule = e.rule AND r.version = e.version AND r.i = e.i+1),
c AS (SELECT rule, version, arg_max(v, i) AS cost FROM e GROUP BY ALL), q AS (SELECT rule, unnest(range(1, 7)) AS version FROM ({ASKED}))
SELECT q.rule, q.version, round(coalesce(c.cost, (SELECT arg_max(cost, version) FROM c l WHERE l.rule = q.rule), 1e0), 4) AS cost, coalesce(c.version, (SELECT max(version) FROM c l WHERE l.rule = q.rule)) AS from_version FROM q LEFT JOIN c USING (rule, version)""")
def ag29_ewma_costs(spark, sf_dir):
    """Estimates of every rule at versions 1 to 6."""
    o = table(spark, sf_dir, "orders").withColumn("rule", F.expr("concat(o_orderpriority, '/', o_custkey%50)"))
    runs = o.where("o_custkey%10 <> 3").selectExpr("rule", "1 + o_custkey div 50 % 2 * 2 + o_custkey%50%2*2 AS version", "o_totalprice/1000 AS seconds", "o_orderdate AS day", "o_orderkey AS run")
    asked = o.select("rule").distinct().withColumn("version", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long"))))
    e = estimates(asked, ewma_costs(runs))
    return e.select("rule", "version", F.round("cost", 4).alias("cost"), "from_version")


@query(A + "SELECT a.key, b.key AS twin FROM artifacts a JOIN artifacts b ON a.rule = b.rule AND a.size//1000 = b.size//1000 AND a.params = b.params AND a.key <> b.key")
def jn34_digest_twins(spark, sf_dir):
    """Other keys with the same rule and digest (here: size in thousands, and params)."""
    a = view(spark, sf_dir, "artifacts").selectExpr("key", "rule", "size div 1000 AS d", "params")
    b = a.withColumnRenamed("key", "twin")
    return a.join(b, ["rule", "d", "params"]).where("key <> twin").select("key", "twin")


@query(A + ", p AS (SELECT 'p' || params%500 AS path, key, created_at FROM artifacts UNION ALL SELECT 'P' || params%500, key, created_at FROM artifacts WHERE key%7 = 0) SELECT lower(path) AS path, arg_max(key, struct_pack(a := created_at, b := key)) AS key, count(*) AS entries FROM p GROUP BY 1")
def st6_merge_packs(spark, sf_dir):
    """One row a path however it is spelled; the latest wins."""
    a = view(spark, sf_dir, "artifacts")
    path = F.concat(F.lit("p"), F.expr("string(params%500)"))
    both = a.select(path.alias("path"), "key", "created_at").union(a.where("key%7 = 0").select(F.initcap(path), "key", "created_at"))
    return both.groupBy(F.lower("path").alias("path")).agg(F.max(F.struct("created_at", "key"))["key"].alias("key"), F.count("*").alias("entries"))


@query(A + ", f AS (SELECT key + CASE WHEN key%40 = 0 THEN 1000000 ELSE 0 END AS key, size + CASE WHEN key%33 = 0 THEN 1 ELSE 0 END AS size FROM artifacts) SELECT key, 'no file' AS fault FROM artifacts WHERE key NOT IN (SELECT key FROM f) UNION ALL SELECT key, 'no row' FROM f WHERE key NOT IN (SELECT key FROM artifacts) UNION ALL SELECT a.key, 'digest' FROM artifacts a JOIN f USING (key) WHERE a.size <> f.size")
def st7_fsck(spark, sf_dir):
    a = view(spark, sf_dir, "artifacts").select("key", "size")
    f = a.selectExpr("key + CASE WHEN key%40 = 0 THEN 1000000 ELSE 0 END AS key", "size + CASE WHEN key%33 = 0 THEN 1 ELSE 0 END AS file_size")
    joined = a.join(f, "key", "full")
    fault = F.when(F.col("file_size").isNull(), "no file").when(F.col("size").isNull(), "no row").when(F.col("size") != F.col("file_size"), "digest")
    return joined.select("key", fault.alias("fault")).where("fault IS NOT NULL")


@query(A + "SELECT key, 'rule' AS name, rule AS value FROM artifacts UNION ALL SELECT key, 'version', CAST(version AS VARCHAR) FROM artifacts UNION ALL SELECT key, 'params', CAST(params AS VARCHAR) FROM artifacts")
def ar9_params_of(spark, sf_dir):
    """A recipe's names and values, read back from its JSON."""
    recipe = F.to_json(F.struct("rule", F.col("version").cast("string").alias("version"), F.col("params").cast("string").alias("params")))
    a = view(spark, sf_dir, "artifacts").select("key", F.from_json(recipe, "map<string,string>").alias("m"))
    return a.select("key", F.explode("m").alias("name", "value"))


@query(A + ", old AS (SELECT key AS k, params%900 AS lat, version AS lon, created_at AS registered_at, CASE WHEN key%3=0 THEN 'me' END AS owner FROM artifacts WHERE key%2 = 0), new AS (SELECT key AS k, params%900 AS lat, version AS lon, created_at AS registered_at, CASE WHEN key%5=0 THEN 'you' END AS owner FROM artifacts WHERE key%2 = 1), o AS (SELECT lat, lon, arg_min(registered_at, k) AS r, arg_min(coalesce(owner, ''), k) AS w FROM old GROUP BY ALL), n AS (SELECT lat, lon, arg_min(registered_at, k) AS r, arg_min(coalesce(owner, ''), k) AS w FROM new GROUP BY ALL) SELECT lat, lon, coalesce(o.r, n.r) AS registered_at, coalesce(nullif(n.w, ''), o.w, '') AS owner FROM o FULL JOIN n USING (lat, lon)")
def snk3_write_library(spark, sf_dir):
    """An upsert: the first registration stands, and the owner where the caller does not know it."""
    a = view(spark, sf_dir, "artifacts").selectExpr("key", "params%900 AS lat", "version AS lon", "created_at", "coalesce(CASE WHEN key%2=0 AND key%3=0 THEN 'me' WHEN key%2=1 AND key%5=0 THEN 'you' END, '') AS owner")
    side = lambda k, p: a.where(f"key%2 = {k}").groupBy("lat", "lon").agg(F.min(F.struct("key", "created_at", "owner")).alias(p))
    m = side(0, "o").join(side(1, "n"), ["lat", "lon"], "full")
    return m.select("lat", "lon", F.coalesce("o.created_at", "n.created_at").alias("registered_at"), F.coalesce(F.when(F.col("n.owner") != "", F.col("n.owner")), "o.owner", F.lit("")).alias("owner"))


@query(A + "SELECT params%180-90 AS tlat, params%90 AS tlon, string_agg(key, ',' ORDER BY key) AS patches FROM artifacts WHERE key%9 = 0 GROUP BY ALL")
def ag49_patched_tiles(spark, sf_dir):
    """Patch files by the tile that their path names; one artefact in nine is a patch in the test view (``key%9 = 0``)."""
    path = F.format_string("Patches/%+03d%+04d/%d.obj", F.expr("int(params%180-90)"), F.expr("int(params%90)"), F.col("key"))
    p = view(spark, sf_dir, "artifacts").where("key%9 = 0").select(path.alias("path"))
    part = lambda i: F.regexp_extract("path", r"^Patches/([+-]\d+)([+-]\d+)/(\d+)", i).cast("long")
    return p.select(part(1).alias("tlat"), part(2).alias("tlon"), part(3).alias("key")).groupBy("tlat", "tlon").agg(F.array_join(F.transform(F.sort_array(F.collect_list("key")), lambda k: k.cast("string")), ",").alias("patches"))


@query(TREE + "keep(key) AS (SELECT o_orderkey FROM orders WHERE o_orderkey%101 = 0 UNION SELECT parent FROM keep JOIN edges ON child = key) SELECT o_orderpriority AS category, o_orderkey IN (SELECT key FROM keep) AS kept, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) AS bytes FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderkey IN (SELECT key FROM keep))".replace("SELECT o_orderpriority AS category, o_orderkey IN (SELECT key FROM keep) AS kept, count(*) AS n, sum(CAST(floor(o_totalprice) AS BIGINT)) AS bytes FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderkey IN (SELECT key FROM keep))", "SELECT category, kept, count(*) AS n, sum(size) AS bytes FROM (SELECT o_orderpriority AS category, k.key IS NOT NULL AS kept, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders LEFT JOIN keep k ON k.key = o_orderkey) GROUP BY ROLLUP (category, kept)"))
def ag50_space_report(spark, sf_dir):
    a = view(spark, sf_dir, "artifacts")
    kept = reachable(edges(spark, sf_dir), a.where("key%101 = 0")).withColumn("k", F.lit(True))
    return a.join(kept, "key", "left").select(F.col("rule").alias("category"), F.coalesce("k", F.lit(False)).alias("kept"), "size").rollup("category", "kept").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
