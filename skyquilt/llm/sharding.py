"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters rows by a seeded hash into buckets that fit a task's memory, a task's buckets one after the
other. Pass two puts a bucket into a
fixed order, shuffles it by Fisher-Yates with a generator seeded by the bucket's number, and writes it.
Buckets end to end are the shuffled order; eight equal stretches of it are the shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, shared_dir, written

#: Text bytes that a bucket holds on average; a task needs about four times as much memory.
BUCKET_BYTES = 24 << 20
#: Tasks of the scatter at most; each has as many buckets as it takes. Buckets that are summed up as one.
TASKS, BUCKETS_A_LOT = 20_000, 4_096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation: from the end down, each place swaps with one at or before it."""
    picks = np.random.Generator(np.random.PCG64([seed, bucket])).random(n)
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = int(picks[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def write_shuffled(docs: DataFrame, path: str, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, key: str = "doc_id", tasks: int = TASKS) -> DataFrame:
    """Write all rows of ``docs``, shuffled, below ``path``; return (doc, bucket, place), ``doc`` the whole row.

    Rows are scattered in two levels: to at most ``tasks`` tasks, and in a task, by a sort that may spill, to its
    buckets, of which one at a time is in memory. A row's hash is of its key, its text and its number, so rows
    that repeat key and text are spread as well. Inside a bucket rows are put in the order of the key and the
    text's crc before the shuffle: equal rows are alike, and so a task that runs again writes the same. Rows
    are packed as one struct, so no column of theirs clashes; null texts count as empty in the sizes; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    n = max(-(-int(total) // bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    per = -(-n // tasks)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(f"doc.{key}"), "doc.text", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    packed = docs.select(F.struct("*").alias("doc")).select("doc", bucket.alias("bucket"), F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("crc"))

    def shuffled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).drop_columns(["crc"])
        order = fisher_yates(len(table), seed, table["bucket"][0].as_py())
        for at in range(0, len(order), 2_000):
            part = table.take(pa.array(order[at : at + 2_000]))
            yield from part.append_column("place", pa.array(np.arange(at, at + len(part)))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if held and held[-1]["bucket"][0] != batch["bucket"][a]:
                    yield from shuffled(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from shuffled(held)

    kind = T.StructType([*packed.schema.fields[:2], T.StructField("place", T.LongType())])
    dealt = packed.repartitionById(-(-n // per), F.expr(f"bucket div {per}").cast("int")).sortWithinPartitions("bucket", f"doc.{key}", "crc")
    dealt.mapInArrow(run, kind).write.parquet(path)
    return spark.read.schema(kind).parquet(path)


def placed(shuffled: DataFrame, shards: int = 8) -> DataFrame:
    """(doc, shard, slot) of what ``write_shuffled`` returns: counts of the shards are at most one apart, slots run from 0 without gaps.

    Counts are one row a bucket; they are summed up by groups of buckets, so no window holds them all.
    """
    counts = written(shuffled.groupBy("bucket").agg(F.count("*").alias("n")), "bucket-counts").withColumn("lot", F.expr(f"bucket div {BUCKETS_A_LOT}"))
    lots = counts.groupBy("lot").agg(F.sum("n").alias("lot_n"))
    upto = F.coalesce(F.sum("lot_n").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("lot_n").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lots = lots.select("lot", upto.alias("ahead"), every.alias("every"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("lot").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = written(counts.join(lots, "lot").select("bucket", (F.col("ahead") + own).alias("ahead"), "every"), "bucket-offsets")
    at = shuffled.join(offsets, "bucket").select("doc", (F.col("ahead") + F.col("place")).alias("at"), "every").withColumn("shard", F.expr(f"at * {shards} div every"))
    return at.select("doc", F.col("shard").cast("int").alias("shard"), F.expr(f"at - (shard * every + {shards - 1}) div {shards}").alias("slot"))


def shard_rows(shuffled: DataFrame, shards: int = 8) -> DataFrame:
    """The user's columns with shard and slot; these get an underscore behind them where the user has such columns."""
    columns = shuffled.schema["doc"].dataType.names
    return placed(shuffled, shards).select("doc.*", F.col("shard").alias(free_name("shard", columns)), F.col("slot").alias(free_name("slot", columns)))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = placed(write_shuffled(documents(spark, sf_dir), shared_dir(spark, "shards")))
    return out.select(
        "doc.doc_id", (F.coalesce(F.octet_length("doc.text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
