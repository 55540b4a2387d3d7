"""Web archives: written as whole-file gzip streams, made into one member a record with a sidecar index, read back.

A crawl writes each archive as a single gzip stream, as many tools do; no record of it can be reached without
inflating all before it. The normaliser inflates a file's stream once, in order and in bounded memory, writes every
record again as a gzip member of its own, and lists offset and length of each in a sidecar. On its way it makes
revisits of records whose payload another record holds already. Payloads move from file to file and are never
shuffled; what is shuffled is a digest a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, text_chunks, written

#: Bytes of payload and records of an archive at most (a larger payload makes its own archive); tasks at most.
FILE_BYTES, FILE_RECORDS, TASKS = 256 << 20, 100_000, 20_000
#: Bytes that are read or inflated at a time.
PIECE = 1 << 18
#: Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
CRAWL = "file string, record long, page_id long, payload_bytes long, sha256 binary"
SIDECAR = pa.schema([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(file: str, record: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{file} {record}'.encode()).digest()[:16], version=4)}>"


def head(fields: Iterable[tuple[str, object]]) -> bytes:
    """A record's header, without the empty line; fields that are None are left out."""
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None)])


class Archive:
    """Records of an archive, inflated once and in order: a single gzip stream, one member a record, or plain bytes."""

    def __init__(self, file):
        self.file, self.held, self.inflater, self.plain = file, bytearray(), None, None

    def more(self) -> bool:
        """Read on; False at the end of the archive."""
        raw = self.inflater.unconsumed_tail if self.inflater else b""
        if self.inflater and self.inflater.eof:
            raw, self.inflater = self.inflater.unused_data, None
        raw = raw or self.file.read(PIECE)
        if self.plain is None and raw:
            self.plain = raw[:1] != b"\x1f"
        if not raw and (self.inflater is None or self.plain):
            return False
        if self.plain:
            self.held += raw
            return True
        if self.inflater is None:
            self.inflater = zlib.decompressobj(31)
        out = self.inflater.decompress(raw, 4 * PIECE)
        if not raw and not out and not self.inflater.eof:
            raise ValueError("the archive ends inside a gzip member")
        self.held += out
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the next ``mark``, which is passed over; None at the end of the archive."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces; take all of them before what follows."""
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part = bytes(self.held[: min(n, PIECE)])
            del self.held[: len(part)]
            n -= len(part)
            if part:
                yield part

    def records(self) -> Iterator[tuple[list[tuple[str, str]], int, Iterator[bytes]]]:
        """Fields in their order, length and pieces of each record's block; a block that is not taken is passed over."""
        while (top := self.until(END)) is not None:
            lines = top.lstrip(b"\r\n").split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("no record begins where one should")
            fields = [(k.strip(), v.strip()) for k, _, v in (x.decode().partition(":") for x in lines[1:])]
            size = int(next(v for k, v in fields if k.lower() == "content-length"))
            block = self.take(size)
            yield fields, size, block
            for _ in block:
                pass
            for part in self.take(len(END)):
                if part.strip(b"\r\n"):
                    raise ValueError("a record is longer than it says")


def http_head(block: Iterator[bytes]) -> tuple[bytes, bytes]:
    """The HTTP header of a block with its empty line, and what of the payload was read with it."""
    held = b""
    for part in block:
        held += part
        if END in held:
            a, _, b = held.partition(END)
            return a + END, b
    raise ValueError("a response has no header")


def member(sink, pieces: Iterable[bytes], level: int = 6) -> int:
    """Write the pieces as one gzip member; its length."""
    own, n = zlib.compressobj(level, zlib.DEFLATED, 31), 0
    for piece in pieces:
        n += sink.write(own.compress(piece))
    return n + sink.write(own.flush())


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a response record below ``path``, each file one gzip stream; (file, record, page_id, payload_bytes, sha256) of the records.

    Null html is an empty payload; null ids and urls are left out of the header, and what a header cannot hold is
    percent-encoded. Files are named anew by every attempt of a task; the table that comes back, written by Spark,
    names those that count. An empty table makes no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        stem, number, sink, n, size = f"crawl-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex[:12]}", 0, None, 0, 0
        for chunk in text_chunks(batches, "html"):
            rows = []
            for page, url, html in zip(chunk["page_id"].to_pylist(), chunk["url"].to_pylist(), chunk["html"].cast(pa.large_binary()).to_pylist()):
                html = html or b""
                if sink and (size + len(html) > file_bytes or n >= FILE_RECORDS):
                    sink.write(own.flush())
                    sink.close()
                    sink = None
                if not sink:
                    name = f"{stem}-{number:06d}.warc.gz"
                    sink, own = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    number, n, size = number + 1, 0, 0
                    info = b"format: WARC File Format 1.1\r\n"
                    sink.write(own.compress(head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", date), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + END + info + END))
                top = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(html) + END
                fields = [
                    ("WARC-Type", "response"), ("WARC-Record-ID", record_id(name, n)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else quote(url, safe=PRINTABLE)), ("Page-ID", page),
                    ("WARC-Payload-Digest", "sha1:" + base32_sha1(hashlib.sha1(html).digest())), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(top) + len(html)),
                ]
                sink.write(own.compress(head(fields) + END + top))
                sink.write(own.compress(html))
                sink.write(own.compress(END))
                rows.append({"file": name, "record": n, "page_id": page, "payload_bytes": len(html), "sha256": hashlib.sha256(html).digest()})
                n, size = n + 1, size + len(html)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("sha256", pa.binary())]))
        if sink:
            sink.write(own.flush())
            sink.close()

    return written(pages.select("page_id", "url", "html").mapInArrow(run, CRAWL), "crawl")


def revisits(crawl: DataFrame, least: int = 0) -> DataFrame:
    """(file, record, first): the records that revisit ``first``, the record of an equal payload of ``least`` bytes or more with the smallest page_id (null last, then by file and place).

    Groups are summed up in each task first, and those of more than one record are written, so that both sides of
    the join back come straight from exchanges and the adaptive planner splits a payload that very many records share.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "record")).alias("first")
    own = crawl.where(F.col("payload_bytes") >= least)
    groups = written(own.groupBy("sha256", "payload_bytes").agg(first, F.count("*").alias("n")).where("n > 1").drop("n"), "payload-groups")
    again = own.join(groups, ["sha256", "payload_bytes"]).where("file <> first.file OR record <> first.record")
    return again.select("file", "record", "first")


def normalise(source, sink, again: dict[int, dict] | None = None, level: int = 6) -> Iterator[tuple]:
    """Write the records of an archive as a member each; (offset, length, type, record_id) of each member.

    ``source`` and ``sink`` are open files; the source's stream is inflated once. ``again``: by the number of a
    response in the file, the record that it revisits (file, record, page_id); of such only the headers stay.
    """
    offset, number = 0, 0
    for fields, size, block in Archive(source).records():
        own = {k.lower(): v for k, v in fields}
        kind = own["warc-type"]
        first = None
        if kind == "response":
            first, number = (again or {}).get(number), number + 1
        if first is None:
            n = member(sink, (x for part in ([head(fields), END], block, [END]) for x in part), level)
        else:
            kind, (top, _) = "revisit", http_head(block)
            refers = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["file"], first["record"])), ("Refers-To-Page-ID", first["page_id"])]
            changed = [(k, {"warc-type": kind, "content-length": len(top)}.get(k.lower(), v)) for k, v in fields]
            n = member(sink, [head([*changed[:-1], *refers, changed[-1]]), END, top, END], level)
        yield offset, n, kind, own["warc-record-id"]
        offset += n


def normalise_archives(crawl: DataFrame, again: DataFrame, path: str, out: str) -> DataFrame:
    """Normalise every file of ``crawl`` below ``path`` to one below ``out`` with a sidecar index; (file, n_records).

    A task takes a file and the revisits in it, a hundred thousand at most. The sidecar is an Arrow stream beside
    the archive. An attempt that ran twice leaves a file that no row names.
    """
    number = F.row_number().over(Window.orderBy("file")) - 1  # one row a file
    files = written(crawl.select("file").distinct().withColumn("number", number.cast("long")), "crawl-files")
    n = files.count()
    tasks = max(1, min(n, TASKS))
    marks = again.join(files, "file").select("number", "file", "record", "first")
    every = marks.unionByName(files.select("number", "file", F.lit(-1).cast("long").alias("record")), allowMissingColumns=True)
    dealt = every.repartitionById(tasks, F.expr(f"number % {tasks}").cast("int")).sortWithinPartitions("number", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        own, below = fs.FileSystem.from_uri(out)
        own.create_dir(below, recursive=True)

        def made(file: str, first: dict[int, dict]) -> pa.RecordBatch:
            name, rows = f"records-{uuid.uuid4().hex}.warc.gz", []
            with store.open_input_stream(f"{root}/{file}", compression=None) as source, own.open_output_stream(f"{below}/{name}", compression=None) as sink:
                rows.extend(normalise(source, sink, first))
            with own.open_output_stream(f"{below}/{name}.index.arrows") as sink, pa.ipc.new_stream(sink, SIDECAR) as index:
                index.write_table(pa.Table.from_arrays([pa.array(x) for x in zip(*rows)], schema=SIDECAR))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(rows)], pa.int64())})

        at, first = None, {}
        for row in (r for b in batches for r in b.to_pylist()):
            if row["record"] < 0:
                if at is not None:
                    yield made(at, first)
                at, first = row["file"], {}
            else:
                first[row["record"]] = row["first"]
        if at is not None:
            yield made(at, first)

    return written(dealt.mapInArrow(run, "file string, n_records long"), "archives")


def read_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP header and payload of one member."""
    fields, _, block = next(Archive(pa.BufferReader(data)).records())
    own = {k.lower(): v for k, v in fields}
    if own["warc-type"] not in ("response", "revisit"):
        return own, b"", b"".join(block)
    top, rest = http_head(block)
    return own, top, rest + b"".join(block)


def read_archives(archives: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, file, offset, length of each record, each member reached by its offset in the sidecar.

    A response's size and digest are computed from its payload, and the digest must be the header's; a revisit has
    both from its headers.
    """
    number = F.row_number().over(Window.orderBy("file")) - 1  # one row a file
    files = written(archives.select("file", number.cast("long").alias("number")), "archive-files")
    tasks = max(1, min(files.count(), TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        kind = pa.schema([(k, pa.string() if t == "string" else pa.int64()) for k, t in (x.split() for x in READ.split(", "))])
        for name in (x for b in batches for x in b["file"].to_pylist()):
            with store.open_input_stream(f"{root}/{name}.index.arrows") as f:
                index = pa.ipc.open_stream(f).read_all()
            wanted = index.filter(pc.is_in(index["type"], pa.array(["response", "revisit"])))
            with store.open_input_file(f"{root}/{name}") as f:
                for part in wanted.to_batches(max_chunksize=2_000):
                    rows = []
                    for at, n in zip(part["offset"].to_pylist(), part["length"].to_pylist()):
                        own, top, payload = read_record(f.read_at(n, at))
                        digest = own["warc-payload-digest"].removeprefix("sha1:")
                        if own["warc-type"] == "response":
                            size = len(payload)
                            if base32_sha1(hashlib.sha1(payload).digest()) != digest:
                                raise ValueError(f"{name} at {at}: the payload's digest is not the header's")
                        else:
                            size = int(next(x for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        page, refers = own.get("page-id"), own.get("refers-to-page-id")
                        rows.append({"page_id": page and int(page), "payload_bytes": size, "payload_digest": digest, "record_type": own["warc-type"], "refers_to": refers and int(refers), "file": name, "offset": at, "length": n})
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.repartitionById(tasks, F.expr(f"number % {tasks}").cast("int")).select("file").mapInArrow(run, READ)


def uri(path: str) -> str:
    """A path as Arrow's file systems take it."""
    return path if "://" in path or path.startswith("file:") else "file://" + path


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, out = uri(shared_dir(spark, "warc-crawl")), uri(shared_dir(spark, "warc"))
    crawl = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw)
    archives = normalise_archives(crawl, revisits(crawl), raw, out)
    return read_archives(archives, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Of the SHA-1 five hexadecimal digits at a time make four of base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM g
"""
