"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by (source, hash bucket). A running sum over the buckets of a source finds the bucket
in which its budget ends; only that bucket is cut finer, twelve hash bits a round, until one row is
left in it. The mix is then a filter ``hash < threshold``: nothing is sorted by hash, and the mix for a
smaller budget lies inside the mix for a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits by which one round cuts a bucket, and bits of each hash word; the words that order rows, and a source's edge in them.
STEP, BITS = 12, 60
WORDS, EDGES = ("h1", "h2", "h3"), ("e1", "e2", "e3")
#: A plan of at most this many sources is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def words(text: str | Column) -> Column:
    """Number of words of the text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: str | Column, seed: str = "mix") -> Column:
    """60 bits of md5 over the seed and the id: the same in every engine, so reruns agree."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) -> + target. The row count here is the number of sources, not of documents.

    ``share`` of all words is dealt out by weight; no target passes ``cap`` times its source's size, and
    what is cut off goes to the others by weight. With the sources in order of cap / weight, all before the
    first whose fair share stays below its cap are capped, so the level is found in one pass.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", weight.cast("double").alias("_w"), (F.lit(cap) * F.col("source_size")).alias("_cap"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_cap")).alias("_left"),
        F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("_weights"), F.row_number().over(by_ratio).alias("_place"),
    ).withColumn("_level", F.col("_left") / F.col("_weights"))
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_place", "_level"))).over(every)["_level"]
    return here.withColumn("_level", level).select(
        "source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("_cap"), F.coalesce("_level", F.lit(float("inf"))) * F.col("_w"))).alias("target")
    )


def _key(source: str = "source") -> Column:
    """Sources as join keys that hold for null too."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _prefix(level: int) -> Column:
    """The leading bits of the hash words that round ``level`` tells apart, as a string key."""
    word = level * STEP // BITS
    return F.concat_ws("/", *(F.col(h).cast("string") for h in WORDS[:word]), _bucket(level).cast("string"))


def _bucket(level: int) -> Column:
    word, level = divmod(level, BITS // STEP)
    return F.shiftright(WORDS[word], BITS - STEP * (level + 1))


def text_hash(text: str, seed: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col(text), F.lit(""))), 4)


def row_hash() -> Column:
    """60 bits that tell rows apart. They differ between reads, so they are written before they are used."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 4)


def sized(docs: DataFrame, seed: str = "mix", h3: Column | None = None) -> DataFrame:
    """doc_id, source, size, hashes and key of every row, without the texts.

    ``h1`` orders ids, ``h2`` rows of one id by their texts, and ``h3`` rows that repeat both. Rows that repeat
    both have one size, so which of them ``h3`` puts first changes nothing in a mix but the order of its rows.
    """
    h3 = row_hash() if h3 is None else h3
    return docs.select("doc_id", "source", words("text").alias("size"), id_hash("doc_id", seed).alias("h1"), text_hash("text", seed).alias("h2"), h3.alias("h3"), _key().alias("key"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Where each source's budget ends: (key, e1, e2, e3).

    ``rows``: key, size, h1, h2, h3. ``budgets``: key, budget (words, below the key's sum). A row lies inside the
    budget if its hash words come before the edge; the last row that meets the budget's end is inside if at least
    half of it fits. Each round reads only the rows of the boundary buckets, found by an equi-join on (key,
    prefix), so a source with a third of all rows is spread over its prefixes.
    """
    state, done, rounds = budgets.select("key", F.col("budget").alias("left")), None, len(WORDS) * BITS // STEP
    for level in range(rounds):
        inside = rows if level == 0 else rows.withColumn("prefix", _prefix(level - 1)).join(state.select("key", "prefix"), ["key", "prefix"], "left_semi")
        fixed = [F.min(h).alias(h) for h in WORDS[: level * STEP // BITS]]  # the words before this one, the same in all of a bucket
        counts = inside.groupBy("key", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min(_prefix(level)).alias("prefix"), *fixed)
        running = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = counts.withColumn("upto", F.sum("words").over(running)).join(state.select("key", "left"), "key").where(F.col("upto") > F.col("left"))
        names = ["bucket", "prefix", "words", "n", *WORDS[: len(fixed)]]
        edge = ends.groupBy("key").agg(F.min(F.struct(*names, "upto", "left")).alias("e"))
        state = written(edge.select("key", *(f"e.{n}" for n in names), (F.col("e.left") - F.col("e.upto") + F.col("e.words")).alias("left")), f"mix-{level}")
        over = F.col("bucket") + (2 * F.col("left") >= F.col("words")).cast("long")
        here = F.shiftleft(over, BITS - STEP * (level % (BITS // STEP) + 1))
        words_ = [*map(F.col, WORDS[: len(fixed)]), here, *[F.lit(0).cast("long")] * (len(WORDS) - len(fixed) - 1)]
        single = F.lit(True) if level == rounds - 1 else F.expr("n = 1 OR words = 0")  # equal in all words: taken or left together
        settled = state.where(single).select("key", *(w.alias(e) for w, e in zip(words_, EDGES)))
        done = settled if done is None else done.unionByName(settled)
        state = state.where(~single)
        if state.isEmpty():
            break
    return done


def _inside() -> Column:
    """Whether a row's hash words come before the edge, word by word."""
    before = F.lit(False)
    for h, e in reversed(list(zip(WORDS, EDGES))):
        before = (F.col(h) < F.col(e)) | ((F.col(h) == F.col(e)) & before)
    return F.coalesce(before, F.lit(False))


def planned(rows: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """One row per source: key, source_size, target, whole and where its threshold lies."""
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = written(plan.withColumn("key", _key()).withColumn("whole", whole), "mix-targets")
    budgets = plan.where("source_size > 0").select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    plan = written(plan.join(thresholds(rows, budgets), "key", "left"), "mix-plan").drop("source")
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def _copies() -> Column:
    """Never more than target / source_size, rounded up: documents without words stand before any edge, also one at the budget's start."""
    most = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(0)
    return F.least(F.col("whole") + _inside().cast("long"), most)


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix holds the document: every document floor(target / source_size) times,
    and those inside the source's threshold once more. Null texts have size 0 and are kept in the rows;
    null sources are a source of their own, last in order; repeated rows are each their own row; an empty
    table gives an empty result. A rerun gives the same rows, however the table's files are cut.
    """
    rows = written(sized(docs, seed), "mix-sized")
    return rows.join(planned(rows, share, cap, weights), "key").select("doc_id", "source", "size", "source_size", "target", "h1", _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, seed: str = "mix") -> DataFrame:
    """The mix itself: each row as often as ``mix`` takes it, with the columns of ``docs``.

    Rows are written once with the hash that tells them apart, so sizes and copies are of the same rows,
    also where ids are null or repeat, and packed as one struct, so no column of ``docs`` clashes. Null texts
    have no words and come as often as their source's others; an empty table stays empty. The threshold is a
    filter on each row; no text is shuffled as long as the plan of sources is broadcast.
    """
    own = written(docs.select(F.struct("*").alias("doc"), row_hash().alias("h3")), "mix-docs")
    rows = written(sized(own.select("doc.doc_id", "doc.source", "doc.text", "h3"), seed, F.col("h3")), "mix-sized")
    keyed = own.select("doc", id_hash("doc.doc_id", seed).alias("h1"), text_hash("doc.text", seed).alias("h2"), "h3", _key("doc.source").alias("key"))
    out = keyed.join(planned(rows, share, cap, weights), "key").select("doc", _copies().cast("int").alias("copies")).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS k FROM s),
w AS (SELECT source, source_size, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS i FROM w),
l AS (SELECT a.i, a.w, a.cap,
        ((SELECT 1.5::DOUBLE * sum(source_size) FROM o) - coalesce((SELECT sum(cap) FROM o b WHERE b.i < a.i), 0))
        / (SELECT sum(w) FROM o b WHERE b.i >= a.i) AS level FROM o a),
v AS (SELECT level FROM l WHERE level * w <= cap ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, level * w) END AS target FROM o, v),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT d.doc_id, d.source, d.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
        CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS BIGINT) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, least(whole + CASE WHEN upto <= budget OR (upto - size <= budget AND size > 0 AND 2 * (budget - upto + size) >= size) THEN 1 ELSE 0 END,
        CASE WHEN source_size > 0 THEN CAST(ceil(target / source_size) AS BIGINT) ELSE 0 END) AS copies FROM c)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM e
"""
