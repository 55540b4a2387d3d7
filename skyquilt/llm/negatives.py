"""Hard negatives by slots of scores.

An anchor's positives give upper limits; in order, they cut its scores into disjoint slots. Each task scores a block of
anchors against its rows by matrix products and keeps the best few of each slot, those of all tasks are merged, and
a positive's window is answered from the slots at or below its own limit: a suffix of the slots in descending order,
of which the best few are also the best of the window. Rows are never shuffled, and pairs never leave a task but
for the best of each slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Anchors of a block at most, bytes of a block's vectors at most, rows that are scored at a time.
ANCHORS, BLOCK_BYTES, ROWS = 2_048, 32 << 20, 1_024
#: Vectors shorter than this multiply exactly in double precision: all partial sums stay below 2**52.
NARROW = 2.0**26
#: Rows of the prepared table in a file, so that scoring is dealt out evenly.
FILE_ROWS = 2_048
LEAST = np.iinfo(np.int64).min
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def vectors(table: DataFrame, vec_id: str = "vec_id", label: str | Column = "label", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(row, vec_id, label, v) of rows that take part: v holds floor(scale * x), x as double.

    Rows whose label, vector or any component is null, or with a component that is not finite, take no part.
    """
    x = F.col(embedding)
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = table.where(x.isNotNull() & good)
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    own = kept.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("v")).where("label IS NOT NULL")
    parts = max(1, -(-table.count() // FILE_ROWS))
    return written(written(own, "vector-rows").repartition(parts, "row"), "vectors")


def matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy().astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond 64 bits stay at the limit."""
    wide = np.sqrt((a.astype(float) ** 2).sum(1)) >= NARROW, np.sqrt((b.astype(float) ** 2).sum(1)) >= NARROW
    if not (wide[0].any() or wide[1].any()):
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    i, j = np.flatnonzero(~wide[0]), np.flatnonzero(~wide[1])
    out[np.ix_(i, j)] = products(a[i], b[j])
    most = -int(LEAST) - 1
    for i, j in ((np.flatnonzero(wide[0]), np.arange(len(b))), (i, np.flatnonzero(wide[1]))):
        if len(i) and len(j):
            out[np.ix_(i, j)] = np.clip(a[i].astype(object) @ b[j].T.astype(object), -most - 1, most).astype(np.int64)
    return out


class Best:
    """A combiner: the best ``k`` rows of each group, by score, then id (null last), then row."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor, self.held = k, np.full(groups, LEAST), []
        self.size, self.most = 0, max(1 << 18, 4 * groups * k)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        keep = score >= self.floor[group]
        self.held.append([x[keep] for x in (group, score, ids, null, row)])
        self.size += int(keep.sum())
        if self.size > self.most:
            self.held = [self.best()]
            self.size = len(self.held[0][0])

    def best(self) -> list[np.ndarray]:
        if not self.held:
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]
        group, score, ids, null, row = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort([row, ids, null, ~score, group])
        group = group[order]
        first = np.searchsorted(group, group)
        place = np.arange(len(group)) - first
        order = order[place < self.k]
        group, place = group[place < self.k], place[place < self.k]
        out = [group, score[order], ids[order], null[order], row[order]]
        full = place == self.k - 1
        self.floor[group[full]] = out[1][full]
        return out


def scored(rows: DataFrame, block: dict, k: int, limits: np.ndarray | None, low: np.ndarray | None) -> DataFrame:
    """(anchor, slot, score, vec_id, row): the best ``k`` of each task's rows.

    Without ``limits`` these are the anchors' own labels, in slot 0, but for the anchor itself; with limits (a row of
    falling scores an anchor, and the least score of each limit's window), other labels in the slots that they cut.
    """

    slots = 1 if limits is None else limits.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((block, limits, low))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, limits, low = shared.value
        best = Best(len(anchors["row"]) * slots, k)
        floor = None if limits is None else low.min(1)
        for part in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            row, label = part["row"].to_numpy(), part["label"].to_numpy()
            null = part["vec_id"].is_null().to_numpy(zero_copy_only=False)
            ids = part["vec_id"].fill_null(0).to_numpy()
            v = matrix(part["v"], anchors["v"].shape[1])
            a = anchors["v"] if anchors["v"].shape[1] == v.shape[1] else np.pad(anchors["v"], ((0, 0), (0, v.shape[1] - anchors["v"].shape[1])))
            if limits is None:
                for own in np.intersect1d(label, anchors["label"]):
                    i, j = np.flatnonzero(anchors["label"] == own), np.flatnonzero(label == own)
                    score = products(a[i], v[j])
                    x, y = np.nonzero((score >= best.floor[i][:, None]) & (anchors["row"][i][:, None] != row[j]))
                    best.add(i[x], score[x, y], ids[j[y]], null[j[y]], row[j[y]])
            else:
                score = products(a, v)
                x, y = np.nonzero((score <= limits[:, :1]) & (score >= floor[:, None]) & (anchors["label"][:, None] != label))
                own = score[x, y]
                slot = (limits[x] >= own[:, None]).sum(1) - 1
                good = own >= low[x, slot]
                x, y, own, slot = x[good], y[good], own[good], slot[good]
                best.add(x * slots + slot, own, ids[y], null[y], row[y])
        group, score, ids, null, row = best.best()
        yield pa.RecordBatch.from_arrays([pa.array(group // slots), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(ids, mask=null), pa.array(row)], names=["anchor", "slot", "score", "vec_id", "row"])

    found = rows.select("row", "vec_id", "label", "v").mapInArrow(run, "anchor long, slot int, score long, vec_id long, row long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, share: int = 80, block: int = ANCHORS) -> DataFrame:
    """Of each anchor's first ``positives`` other rows of its label the first ``negatives`` rows of other labels whose score is no more than the positive's, and ``share`` hundredths of it at least.

    ``rows``: what ``vectors`` returns; ``anchors`` tells which of them are anchors. A score is the inner product;
    higher ones come first, ties by smaller id, null ids last. Vectors of different lengths count as filled up with
    zeros. Rows that repeat an id are rows of their own, as anchors too; an anchor's positives leave out that one row
    only. A positive with a negative score has an empty window. Without anchors, or an empty table, no row comes out.

    Blocks of anchors, bounded in rows and bytes, are sent to all tasks one after the other; the rows are read twice a
    block and stay where they are. Each block's result is a written table.
    """
    spark = rows.sparkSession
    chosen = rows.where(anchors)
    width, count = chosen.agg(F.max(F.size("v")), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    block = max(1, min(block, BLOCK_BYTES // (8 * max(width, 1))))
    n = -(-count // block)
    dealt = written(chosen.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n))), "anchors")
    path, done = shared_dir(spark, "negatives"), []
    for number in range(n):
        got = dealt.where(F.col("block") == number).toArrow().combine_chunks()
        if not len(got):
            continue
        got = got.sort_by("row")
        own = {"row": got["row"].to_numpy(), "label": got["label"].to_numpy(), "v": matrix(got["v"].combine_chunks())}
        near = scored(rows, own, positives, None, None).select("anchor", "score", "vec_id", (F.col("place") - 1).alias("place")).toArrow()
        i, place = near["anchor"].to_numpy(), near["place"].to_numpy()
        limits = np.full((len(got), positives), LEAST)
        limits[i, place] = near["score"].to_numpy()
        low = np.where(limits < 0, -LEAST - 1, -((-limits.astype(object) * share) // 100)).astype(np.int64)
        pairs = pa.table({"anchor": near["anchor"], "place": near["place"], "positive_score": near["score"], "positive_id": near["vec_id"], "anchor_id": got["vec_id"].take(near["anchor"]), "low": low[i, place]})
        slots = scored(rows, own, negatives, limits, low)
        key = F.struct((-F.col("score").cast("decimal(20,0)")).alias("a"), F.col("vec_id").isNull().alias("b"), "vec_id", "score", "slot", "row")
        merged = slots.groupBy("anchor").agg(F.array_sort(F.collect_list(key)).alias("all"))
        suffix = F.filter("all", lambda x: (x["slot"] >= F.col("place")) & (x["score"] >= F.col("low")))
        out = spark.createDataFrame(pairs).join(merged, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "x"))
        done.append(f"{path}/block={number}")
        out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score")).write.parquet(done[-1])
    return spark.read.schema(RESULT).parquet(*done)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    return hard_negatives(vectors(table, label=label), F.expr("vec_id % 100 = 0"))


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, row_number() OVER () AS rn
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.rn AS arn, e.vec_id, e.label = a.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM e a JOIN e ON e.rn <> a.rn WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY arn ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.arn, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.arn = s.arn AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY rank <= 5
"""
