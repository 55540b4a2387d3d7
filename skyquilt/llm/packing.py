"""Cost-balanced packing of token ids into sequences.

Documents are cut into whole sequences and a rest. The rests, longest first, go to the sequence with the
lowest estimated cost (linear plus quadratic attention) that still has room; a rest that fits nowhere whole
is cut over the sequences with most room. A group of a few million tokens is packed at a time inside a task,
so nothing is shuffled, and the sequences of a group offer exactly its tokens: whole sequences, and a last
stretch laid out in powers of two, so no sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, text_chunks
from .tokens import encoder

#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def layout(total: int, capacity: int) -> list[int]:
    """Lengths of sequences that hold exactly ``total`` tokens: whole ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pack_lengths(lengths: np.ndarray, capacity: int = 1024, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, for documents of these lengths."""
    out, used = [], 0
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[d]) // capacity):
            out.append((d, k * capacity, capacity, used, 0))
            used += 1
    rests = lengths % capacity
    room = np.array(layout(int(rests.sum()), capacity), np.int64)
    filled, cost = np.zeros(len(room), np.int64), np.zeros(len(room))

    def put(d: int, start: int, n: int, s: int) -> None:
        out.append((d, start, n, used + s, int(filled[s])))
        filled[s] += n
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for d in np.argsort(-rests, kind="stable").tolist():
        n = int(rests[d])
        start = int(lengths[d]) - n
        while n:
            fits = np.where(room >= n, cost, np.inf)
            s = int(fits.argmin())
            if fits[s] == np.inf:
                s = int(room.argmax())
            take = min(n, int(room[s]))
            put(d, start, take, s)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no
    piece. Sequence ids are the task's number and a counter, so a task that runs again gives the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder("byte_bpe_50k.json", tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        for chunk in text_chunks(batches):
            ids, counts = own.encode(chunk["text"])
            lengths = counts + 1
            ends = np.cumsum(lengths)
            stream = np.full(int(ends[-1]), end_id, "<u4")
            keep = np.ones(len(stream), bool)
            keep[ends - 1] = False
            stream[keep] = ids
            pieces = pack_lengths(lengths, capacity, linear, quadratic)
            d, start, length, seq, offset = np.array(pieces, np.int64).T
            begin = (ends - lengths)[d] + start
            data = memoryview(stream.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            columns = [chunk["doc_id"].take(pa.array(d)), start, length, np.array(crc, np.int64), lengths[d], seq + sequence, offset]
            sequence += int(seq.max()) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
