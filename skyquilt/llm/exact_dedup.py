"""Exact dedup by content-defined chunk recipes.

A rolling gear hash cuts a text where its content says so, so texts that share passages share chunks. A
chunk's identifier is its SHA-256, verified by what else is known of it (length and an independent 128-bit
hash): identifiers that stand for more than one such pair are told apart by that pair. A text is then the
ordered list of its identifiers, and two texts are equal if their lists are. Only lists of identifiers are
shuffled, 32 bytes for some kilobytes of text; the texts stay where they were read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, text_chunks, without, written

#: Bytes of a chunk: at least, about, at most.
LEAST, ABOUT, MOST = 2_048, 8_192, 65_536
#: Values of the gear hash, one a byte, made by a rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear%d" % i).digest()[:4], "little") for i in range(256)], np.uint32)
RECIPE = "doc_id long, row long, recipe array<struct<id:binary,size:int,check:binary>>, text_sha256 string"


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks. A cut follows a byte where the gear hash of the last 32 bytes is small."""
    n = len(data)
    if n <= LEAST:
        return [n]
    ends, block, last = [], 1 << 20, 0
    for start in range(0, n, block):
        lead = min(start, 31)
        h = GEAR[np.frombuffer(data, np.uint8, min(n, start + block) - start + lead, start - lead)]
        for shift in (1, 2, 4, 8, 16):  # the sum of GEAR[byte k back] << k, by doubling
            more = h.copy()
            more[shift:] += h[:-shift] << np.uint32(shift)
            h = more
        ends += (np.flatnonzero(h[lead:] < np.uint32((1 << 32) // (ABOUT - LEAST))) + start + 1).tolist()
    out = []
    for end in [*ends, n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n or end == n and end > last:
            out.append(end)
            last = end
    return out


def recipes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row (a number of the row), the text's recipe and its SHA-256; null counts as empty."""
    row = F.monotonically_increasing_id() if row is None else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("id", pa.binary()), ("size", pa.int32()), ("check", pa.binary())]))
        for chunk in text_chunks(batches):
            lists, sums = [], []
            for text in chunk["text"].cast(pa.large_binary()).to_pylist():
                data = text or b""
                at, parts = 0, []
                for end in cut_points(data):
                    part = data[at:end]
                    parts.append({"id": hashlib.sha256(part).digest(), "size": len(part), "check": xxhash.xxh3_128_digest(part)})
                    at = end
                lists.append(parts)
                sums.append(parts[0]["id"].hex() if len(parts) == 1 else hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["row"], pa.array(lists, kind), pa.array(sums)], names=["doc_id", "row", "recipe", "text_sha256"])

    return docs.select("doc_id", row.alias("row"), "text").mapInArrow(run, RECIPE)


def verified(rows: DataFrame) -> DataFrame:
    """Adds ``list``: the recipe by identifiers that stand for one chunk each.

    Chunks are counted by identifier; one that has two sizes or two checks is no identifier, and recipes
    that hold it are written with size and check beside it. As long as there is none, as one expects of
    SHA-256, this is a single small aggregate.
    """
    chunks = rows.select(F.explode("recipe").alias("c")).groupBy("c.id").agg(F.min("c.size").alias("a"), F.max("c.size").alias("b"), F.min("c.check").alias("d"), F.max("c.check").alias("e"))
    clash = chunks.where("a <> b OR d <> e").select("id")
    plain = F.transform("recipe", lambda c: c["id"])
    if clash.isEmpty():
        return rows.withColumn("list", plain)
    held = rows.select("row", F.explode("recipe").alias("c")).select("row", "c.id").join(clash, "id", "left_semi").select("row").distinct().withColumn("_clash", F.lit(True))
    full = F.transform("recipe", lambda c: F.concat(c["id"], c["check"], F.hex(c["size"]).cast("binary")))
    return rows.join(held, "row", "left").withColumn("list", F.when(F.col("_clash"), full).otherwise(plain)).drop("_clash")


def exact_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 of every row.

    Of equal texts the row with the largest doc_id stays (null ids come last); of repeated rows with that
    same id the first read stays alone. Nulls are equal to empty texts. An empty table gives no row.
    Grouping is pre-aggregated in each task; the groups are written, so that both sides of the join back
    come straight from exchanges and the adaptive planner splits a list that a third of all rows share.
    """
    rows = verified(written(recipes(docs, row), "recipes")).select("doc_id", "row", "list", "text_sha256")
    best = F.max(F.struct(F.col("doc_id").alias("id"), (-F.col("row")).alias("r")))
    groups = rows.groupBy("list").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = written(groups.where("group_size > 1"), "recipe-groups")
    out = rows.join(groups, "list", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("best.r") == -F.col("row"))).alias("kept"), "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with the columns of ``docs``, whatever they are called.

    Rows are matched by their numbers, so null and repeated ids and repeated rows are told apart. An empty
    table stays empty.
    """
    own = numbered(docs, "exact-docs")
    groups = exact_groups(own.select("doc.doc_id", "doc.text", "row"), F.col("row"))
    return without(own, groups.where("NOT kept"), "exact-dropped")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
