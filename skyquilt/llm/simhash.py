"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints are one node. Nodes within the radius agree on at least ``keep`` of ``radius + keep`` bit
blocks, so each choice of ``keep`` blocks is a key, and rows of one key lie side by side after a shuffle by
key. There bit planes stand vertically: one word holds one bit of 64 rows. Planes shifted by a lag, XORed
with themselves, give the differing bits of 64 pairs at once; carry-save counters add them up, and words in
which all pairs have passed the radius are dropped. A task returns spanning links only, at most one a row, and
compares no pair that is linked already. A key that very many fingerprints share is cut into lots, and each two
of its lots are compared by a task of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import connected_components
from .common import documents, numbered, text_chunks, without, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bytes of text that are shingled at a time; they end at white space.
BLOCK, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints of a lot: a key with more of them is cut into lots of about this many.
LOT = 1 << 14


def shingle_blocks(text: bytes, size: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles, repeats included, by blocks of text; a shorter text is one shingle, an empty one none.

    A block ends at white space and hands its last words on to the next, so memory does not grow with the text.
    """
    at, held, any_ = 0, [], False
    while at < len(text):
        gap = SPACE.search(text, at + block) if len(text) - at > block else None
        end = gap.end() if gap else len(text)
        words = held + text[at:end].lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
        at = end
        if len(words) >= size:
            data = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            shingles = map(data.__getitem__, map(slice, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - size + 1)
            any_ = True
        held = words[len(words) - min(size - 1, len(words)) :]
    if held and not any_:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *shingle_blocks(text, size, seed)])


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: str | bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if more than half of the hashes have it; as a signed 64-bit number."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_blocks(text.encode() if isinstance(text, str) else text or b"", size, seed):
        counts, n = counts + bit_counts(hashes), n + len(hashes)
    bits = 2 * counts > n
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """doc_id, row (its number), fp (signed 64-bit) of every row; null counts as empty, whose fingerprint is zero."""
    row = F.monotonically_increasing_id() if row is None else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            fps = [fingerprint(t, size, seed) for t in chunk["text"].cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["row"], pa.array(fps, pa.int64())], names=["doc_id", "row", "fp"])

    return docs.select("doc_id", row.alias("row"), "text").mapInArrow(run, "doc_id long, row long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane j holds bit j of every fingerprint, 64 fingerprints a word."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little"))
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def shifted(planes: np.ndarray, lag: int) -> np.ndarray:
    """Bit i of the result is bit i + lag."""
    words, bits = divmod(lag, 64)
    out = np.zeros_like(planes)
    width = planes.shape[1] - words
    if width > 0:
        out[:, :width] = planes[:, words:] >> np.uint64(bits)
        if bits and width > 1:
            out[:, : width - 1] |= planes[:, words + 1 :] << np.uint64(64 - bits)
    return out


def within(planes: np.ndarray, lag: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs (i, i + lag) of the ``alive`` differ in at most ``radius`` (under 8) bits, as a bit vector."""
    out = np.zeros_like(alive)
    at = np.flatnonzero(alive)
    mask, differ = alive[at], (planes ^ shifted(planes, lag))[:, at]
    ones, twos, fours, over = (np.zeros_like(mask) for _ in range(4))
    for j in range(0, 64, 8):
        for x in differ[j : j + 8]:
            carry = ones & x
            ones = ones ^ x
            carry2 = twos & carry
            twos = twos ^ carry
            over = over | (fours & carry2)
            fours = fours ^ carry2
        far = over.copy()
        for n in range(radius + 1, 8):  # a count of n as its three digits
            far |= (ones if n & 1 else ~ones) & (twos if n & 2 else ~twos) & (fours if n & 4 else ~fours)
        over |= far
        live = (mask & ~over) != 0
        if not live.any():
            return out
        if live.sum() < 0.7 * len(live):
            at, mask, differ, ones, twos, fours, over = at[live], mask[live], differ[:, live], ones[live], twos[live], fours[live], over[live]
    out[at] = mask & ~over
    return out


def near_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links, as places, among rows of equal key (rows sorted by key) that lie within the radius."""
    n = len(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if n else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [n]]))
    place = np.arange(n) - np.repeat(first, length)
    after = np.repeat(length, length) - place - 1  # rows of the same key behind this one
    rows = np.flatnonzero(np.repeat(length, length) > 1)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, lag, planes, label = [], 1, None, np.arange(n)
    while len(rows):
        if planes is None:
            planes, behind, packed = planes_of(fps[rows]), after[rows], len(rows)
            width = planes.shape[1]
        open_ = behind >= lag
        if not open_.any():
            break
        own = label[rows]
        open_[:-lag] &= own[:-lag] != own[lag:]  # pairs that are linked already need no comparison
        found = False
        if open_.any():
            alive = np.packbits(np.pad(open_, (0, width * 64 - packed)), bitorder="little").view(np.uint64)
            near = within(planes, lag, alive, radius)
            for i in np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")).tolist():
                a, b = int(rows[i]), int(rows[i + lag])
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((a, b))
                    found = True
        if found:
            label = np.array(root)
            while not np.array_equal(label, label[label]):
                label = label[label]
        lag += 1
        keep = behind + place[rows] >= lag  # rows of keys that still have pairs at this lag
        if lag & (lag - 1) == 0:  # now and then: rows of keys that are one component already can go
            apart = np.maximum.reduceat(label, first) != np.minimum.reduceat(label, first)
            keep &= np.repeat(apart, length)[rows]
        if keep.sum() < 0.5 * packed:
            rows, planes = rows[keep], None
    return links


def keep_for(n: int) -> int:
    """Blocks that a key joins: so many that a key is met by few of n unrelated fingerprints."""
    return 2 if n < 1 << 24 else 3 if n < 1 << 30 else 4


def block_keys(fp: str, radius: int, keep: int) -> list:
    """All keys of a fingerprint: a number of the choice of blocks, and the bits of those blocks."""
    blocks = radius + keep
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), keep)):
        key = F.lit(number).cast("long")
        for b in chosen:
            key = F.shiftleft(key, edges[b + 1] - edges[b]).bitwiseOR(part[b])
        keys.append(key)
    return keys


def links_of(nodes: DataFrame, radius: int = RADIUS, keep: int | None = None) -> DataFrame:
    """(a, b): links that join every pair of fingerprints within the radius, directly or in steps."""
    keep = keep or keep_for(nodes.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def flush(upto: int) -> pa.RecordBatch:
            pairs = near_links(keys[:upto], fps[:upto], radius)
            a, b = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[a], fps[b])), pa.array(np.maximum(fps[a], fps[b]))], names=["a", "b"])

        for batch in batches:
            keys, fps = np.concatenate([keys, batch["key"].to_numpy()]), np.concatenate([fps, batch["fp"].to_numpy()])
            if len(keys) >= max(1 << 17, 2 * seen):
                upto = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if upto:
                    yield flush(upto)
                    keys, fps = keys[upto:], fps[upto:]
                seen = len(keys)
        if len(keys):
            yield flush(len(keys))

    keyed = nodes.select(F.explode(F.array(*block_keys("fp", radius, keep))).alias("key"), "fp")
    return in_lots(keyed).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long").distinct()


def in_lots(keyed: DataFrame, lot: int = LOT) -> DataFrame:
    """(key, fp) in which no key has more than about two lots of rows, and rows of one key still meet in some key.

    Keys over ``lot`` rows get a number of lots; their rows fall into lots by hash, and each two lots, and each
    lot alone if it is the only one, get a key of their own, made by hash. Rows of keys that clash by chance are
    compared for nothing, no more.
    """
    large = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > lot), "large-keys")
    if large.isEmpty():
        return keyed
    cut = large.select("key", F.ceil(F.col("n") / lot).cast("int").alias("lots"))
    own = keyed.join(cut, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), "lots").cast("int"))
    tiles = F.transform(F.filter(F.sequence(F.lit(0), F.col("lots") - 1), lambda j: j != F.col("own")), lambda j: F.xxhash64("key", F.least(j, "own"), F.greatest(j, "own")))
    return own.select(F.explode(F.when(F.col("lots").isNull(), F.array("key")).otherwise(tiles)).alias("key"), "fp")


def near_groups(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """doc_id, row, fp, component_id, kept of every row.

    Null, empty and blank texts have fingerprint zero and are linked like any other; repeated rows share
    fingerprint and component; an empty table gives no row. Component ids are the smallest doc_id reached,
    null if all are; one row of each component is ``kept``: of that id, the first read.
    """
    rows = written(fingerprints(docs, size, seed, row), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    nodes = written(rows.groupBy("fp").agg(F.min(first).alias("first")), "fingerprint-nodes")
    roots = connected_components(links_of(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(rooted.groupBy("root").agg(F.min("first").alias("first")), "component-names")
    classes = written(rooted.select("fp", "root").join(named, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.row").alias("own")), "classes")
    return rows.join(classes, "fp").select("doc_id", "row", "fp", "component_id", (F.col("row") == F.col("own")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest id, of repeated ones the first read, with the columns of ``docs``.

    Rows are matched by their numbers, so null and repeated ids are told apart, whatever else the columns are
    called; an empty table stays empty.
    """
    own = numbered(docs, "near-docs")
    groups = near_groups(own.select("doc.doc_id", "doc.text", "row"), row=F.col("row"))
    return without(own, groups.where("NOT kept"), "near-dropped")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
