"""Token ids as Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of doc_id and sorted; each task writes the ids of its range, end to end,
as fixed-size lists with a fixed-size mask, always the same number of sequences a batch, so that a mapped
file gives any sequence without copying. Beside it stands an index of its documents. A manifest, written
through Spark, names the files of the attempts that counted, so a task that ran twice does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_dir, text_chunks, written
from .tokens import encoder

#: Ids of a sequence, and sequences of a batch.
LENGTH, ROWS = 1024, 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(width: int, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16() if width == 2 else pa.uint32(), length)), ("mask", pa.list_(pa.bool_(), length))])


def sequence_batch(ids: np.ndarray, schema: pa.Schema, pad_id: int) -> pa.RecordBatch:
    """A batch of whole sequences; the end of the last is padded and masked."""
    length = schema.field("ids").type.list_size
    rows = -(-len(ids) // length)
    data = np.full(rows * length, pad_id, schema.field("ids").type.value_type.to_pandas_dtype())
    data[: len(ids)] = ids
    mask = np.packbits(np.arange(rows * length) < len(ids), bitorder="little")
    masks = pa.Array.from_buffers(pa.bool_(), rows * length, [None, pa.py_buffer(mask)])
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(data), length), pa.FixedSizeListArray.from_arrays(masks, length)], schema=schema)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Write the files below ``path``; return the manifest: part, file, n_docs, n_ids.

    Order is doc_id ascending, null first, then text for repeated ids. Null texts are their end id alone;
    an empty table gives an empty manifest. ``path`` is a URI that all executors reach through Arrow's
    file systems.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder("word_bpe_49k.json", tokenizer)
        width = 2 if own.tokenizer.get_vocab_size() <= 1 << 16 else 4
        schema, step = sequence_schema(width, length), length * ROWS
        store, root = fs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name = f"{root}/ids-{part:08d}-{uuid.uuid4().hex[:12]}"
        out = index = None
        left, n_ids, n_docs = np.zeros(0, np.uint32), 0, 0
        for chunk in text_chunks(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                sink, index_sink = store.open_output_stream(name + ".arrows"), store.open_output_stream(name + ".index.arrows")
                out, index = pa.ipc.new_stream(sink, schema), pa.ipc.new_stream(index_sink, INDEX)
            ids, counts = own.encode(chunk["text"])
            counts = counts + 1
            ends = np.cumsum(counts)
            stream = np.full(int(ends[-1]), end_id, np.uint32)
            keep = np.ones(len(stream), bool)
            keep[ends - 1] = False
            stream[keep] = ids
            index.write_batch(pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(n_ids + ends - counts), pa.array(counts)], schema=INDEX))
            n_ids, n_docs = n_ids + len(stream), n_docs + len(counts)
            stream = np.concatenate([left, stream])
            whole = len(stream) // step * step
            for at in range(0, whole, step):
                out.write_batch(sequence_batch(stream[at : at + step], schema, end_id))
            left = stream[whole:]
        if out is not None:
            if len(left):
                out.write_batch(sequence_batch(left, schema, end_id))
            for x in (out, sink, index, index_sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name.removeprefix(root + "/")], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, file string, n_docs long, n_ids long"), "ids-manifest")


class Sequences:
    """Any sequence of one file, as a view of the mapped file: nothing is read before it is asked for, or copied.

    All batches but the last hold as many sequences, so a batch's place in the file follows from its number.
    """

    def __init__(self, path: str):
        self.file = pa.memory_map(path)
        self.schema = pa.ipc.read_schema(self.file)
        self.length = self.schema.field("ids").type.list_size
        self.head = self.file.tell()
        pa.ipc.read_message(self.file)
        self.step = self.file.tell() - self.head

    def batch(self, number: int) -> pa.RecordBatch:
        self.file.seek(self.head + number * self.step)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)

    def __getitem__(self, i: int) -> np.ndarray:
        """The ids of sequence i, padding included."""
        at = i % ROWS * self.length
        return self.batch(i // ROWS)["ids"].values.to_numpy()[at : at + self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        """Which ids of sequence i are no padding, as bits of the file."""
        return self.batch(i // ROWS)["mask"].values.slice(i % ROWS * self.length, self.length)


def read_ids(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for row in (r for b in batches for r in b.to_pylist()):
            name = f"{root}/{row['file']}"
            with store.open_input_stream(name + ".index.arrows") as f:
                index = pa.ipc.open_stream(f).read_all()
            with store.open_input_file(name + ".arrows") as f:
                sequences = iter(pa.ipc.open_stream(f))
                held, crcs = np.zeros(0, "<u4"), []
                for n in index["n_tokens"].to_pylist():
                    crc, first = 0, True
                    while first or n:
                        if not len(held):
                            batch = next(sequences)
                            held = batch["ids"].flatten().to_numpy()[batch["mask"].flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                        first, take = False, min(n, len(held))
                        crc = zlib.crc32(held[:take].tobytes(), crc)
                        held, n = held[take:], n - take
                    crcs.append(crc)
            for at, part in enumerate(index.to_batches()):
                begin = sum(len(b) for b in index.to_batches()[:at])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part["doc_id"], "start": pa.array(part["start"].to_numpy() + row["before"]), "n_tokens": part["n_tokens"], "ids_crc32": pa.array(crcs[begin : begin + len(part)], pa.int64())}
                )

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"), (F.row_number().over(Window.orderBy("part")) - 1).alias("_n"))
    n = max(1, manifest.count())
    return files.repartitionById(n, F.col("_n").cast("int")).drop("_n").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "ids")
    if "://" not in path and not path.startswith("file:"):
        path = "file://" + path
    return read_ids(write_ids(documents(spark, sf_dir), path), path)
