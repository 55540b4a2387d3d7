"""What the training-data operators share: the shared folder, bounded batches, a few text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing and Spark runs in one local process (tests), a temporary folder
    stands in; on a cluster a missing setting is an error, since executors could not see such files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_skyquilt_tmp", None) or tempfile.mkdtemp(prefix="skyquilt-")
        spark._skyquilt_tmp = root
    return f"{root.rstrip('/')}/skyquilt/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """(doc, row): each row as one struct, so that no column of the user's can clash with one of ours, and its number.

    Numbers would differ between two reads, so both are written once and every later step reads the same.
    """
    return written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), name)


def without(own: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """The rows of a ``numbered`` table without those whose numbers are in ``dropped``, with the user's columns.

    Only numbers are written, so the planner knows their size: few go to the texts, many meet them in a shuffle.
    """
    return own.join(written(dropped.select("row"), name), "row", "left_anti").select("doc.*")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it from clashing with ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(doc_id: str | Column) -> Column:
    """crc32 of the id written as text, unsigned; null ids count as an empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (one longer text makes its own slice)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
