"""Language identification with a blended-spectrum string kernel.

Two texts are as alike as the n-grams of one to three characters that occur in both, over the root of the
numbers of n-grams in each. Landmark texts span that space (Nyström); one ridge regression a language is fit
on the landmark features, and a batch is scored by two matrix products: presence times landmarks, then
times the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, text_chunks

#: Hashed n-grams, longest n-gram, landmarks, ridge; at most about SAMPLE labelled rows fit the classifier.
BUCKETS, SPECTRUM, LANDMARKS, RIDGE, SAMPLE = 1 << 15, 3, 128, 1e-2, 2_000
UNKNOWN = "und"
#: Rows that are made to a presence matrix at once, and characters whose n-grams are hashed at once.
ROWS, BLOCK = 256, 1 << 20


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(4)) == 2


def presence(texts: pa.Array, buckets: int = BUCKETS, spectrum: int = SPECTRUM, block: int = BLOCK) -> np.ndarray:
    """(rows, buckets) of 0 and 1: which hashed n-grams occur anywhere in the text. Null counts as empty.

    A text is taken in pieces that share ``spectrum`` - 1 characters, so that every n-gram is whole in one of them.
    """
    out = np.zeros((len(texts), buckets), np.uint8)
    held, size = [], 0
    for row, text in enumerate(texts):
        text = (text.as_py() or "").lower()
        for at in range(0, max(len(text), 1), block):
            piece = text[at : at + block + spectrum - 1]
            held.append((row, piece.encode("utf-32-le")))
            size += len(piece)
            if size >= block:
                _mark(held, out, spectrum)
                held, size = [], 0
    _mark(held, out, spectrum)
    return out


def _mark(pieces: list[tuple[int, bytes]], out: np.ndarray, spectrum: int) -> None:
    """Set what occurs in the pieces (row, code points) of texts."""
    buckets = out.shape[1]
    sizes = np.array([len(b) // 4 for _, b in pieces], np.int64)
    points = np.frombuffer(b"".join(b for _, b in pieces), np.uint32).copy()
    plain = np.arange(128)
    letter = (plain >= 97) & (plain <= 122)
    low = points < 128
    points[low] = np.where(letter, plain, 32).astype(np.uint32)[points[low]]
    piece = np.repeat(np.arange(len(pieces)), sizes)
    row = np.repeat(np.array([r for r, _ in pieces], np.int64), sizes)
    flat, shift = out.reshape(-1), np.uint32(32 - (buckets.bit_length() - 1))
    code = np.zeros(len(points), np.uint32)
    for n in range(1, spectrum + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(0x01000193) ^ points[n - 1 :]
        mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        same = piece[:m] == piece[n - 1 :]
        flat[(row[:m] * buckets + ((mixed * np.uint32(0x85EBCA6B)) >> shift))[same]] = 1


class KernelRidge:
    """Landmarks as packed bits, and weights by landmark and language."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray, names: list[str]):
        self.landmarks, self.weights, self.names = landmarks, weights, names

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelRidge:
        """``x``: presence rows, in an order that mixes the languages; ``y``: their languages."""
        names = sorted(set(y))
        turn: dict[str, int] = {}
        order = sorted(range(len(y)), key=lambda i: (turn.__setitem__(y[i], turn.get(y[i], 0) + 1) or turn[y[i]], y[i]))
        chosen = [i for i in order if x[i].any()][:landmarks]
        if not chosen:
            return cls(np.zeros((0, x.shape[1] // 8), np.uint8), np.zeros((0, len(names))), names)
        model = cls(np.packbits(x[chosen], axis=1), np.zeros((len(chosen), len(names))), names)
        k = model.kernel(x).astype(np.float64)
        values, vectors = np.linalg.eigh(k[chosen])
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        features = k @ root
        share = {n: y.count(n) / len(y) for n in names}
        weight = np.array([1 / (len(names) * share[n]) for n in y])  # languages count alike
        target = np.array([[1.0 if n == own else -1.0 for n in names] for own in y])
        gram = (features * weight[:, None]).T @ features / len(y) + ridge * np.eye(features.shape[1])
        model.weights = root @ np.linalg.solve(gram, (features * weight[:, None]).T @ target / len(y))
        return model

    def kernel(self, x: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_dense"):
            bits = np.unpackbits(self.landmarks, axis=1)
            self._used = np.flatnonzero(bits.any(axis=0))
            self._dense = np.ascontiguousarray(bits[:, self._used].T.astype(np.float32))
            self._norm = np.sqrt(np.maximum(bits.sum(axis=1), 1)).astype(np.float32)
        shared = x[:, self._used].astype(np.float32) @ self._dense
        return shared / np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1))[:, None].astype(np.float32) / self._norm

    def __getstate__(self) -> dict:
        return {"landmarks": self.landmarks, "weights": self.weights, "names": self.names}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        margins = self.kernel(x).astype(np.float64) @ self.weights
        best = margins.argmax(axis=1)
        return [self.names[i] for i in best], np.clip((margins[np.arange(len(x)), best] + 1) / 2, 0, 1)


def labelled_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, lang of about ``sample`` labelled rows outside the held-out part, alike by language.

    Rows are counted by language without their texts; a language's share of the sample is then a threshold
    on a hash of the id. Of rows that repeat an id and a language one is taken, so the bound holds for them too.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    each = max(1, sample // max(1, len(counts)))
    if not counts:
        return known.select("doc_id", "text", "lang").limit(0)
    rates = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    drawn = known.where(draw < F.coalesce(F.element_at(rates, F.col("lang")), F.lit(0.0)))
    return drawn.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> KernelRidge:
    """Fit on the driver; of each sampled text only its presence bits (4 kB) travel there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            bits = np.packbits(presence(chunk["text"]), axis=1)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], chunk["lang"], pa.array([b.tobytes() for b in bits], pa.binary())], names=["doc_id", "lang", "bits"])

    rows = labelled_sample(docs, sample).mapInArrow(run, "doc_id long, lang string, bits binary").toPandas()
    rows = rows.sort_values(["doc_id", "lang", "bits"], kind="stable")
    if not len(rows):
        return KernelRidge(np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0)), [])
    x = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in rows["bits"]]), axis=1)
    return KernelRidge.fit(x, rows["lang"].tolist())


def identify(docs: DataFrame, model: KernelRidge) -> DataFrame:
    """doc_id, lang_pred, score of every row.

    Null texts and texts without a letter are ``und`` with score 0; so is every row if there was no labelled
    row to learn from. Repeated rows are scored alike; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            for at in range(0, len(chunk), ROWS):
                part = chunk.slice(at, ROWS)
                texts = part["text"].cast(pa.large_string())
                names, scores = model.predict(presence(texts))
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pc.if_else(letters, pa.array(names, pa.string()), UNKNOWN), pc.if_else(letters, pa.array(scores), 0.0)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: KernelRidge | None = None) -> DataFrame:
    """``docs`` without the rows whose language cannot be told, same columns.

    Those are null texts, texts without a letter, and texts taken for a label that itself is ``und``; the
    score decides nothing. If there was no labelled row to learn from, all texts with a letter stay.
    """
    model = model or fit(docs)
    kind = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            for at in range(0, len(chunk), ROWS):
                part = chunk.slice(at, ROWS)
                names, _ = model.predict(presence(part["text"]))
                letters = pc.fill_null(pc.match_substring_regex(part["text"].cast(pa.large_string()), r"\pL"), False)
                told = pc.not_equal(pa.array(names, pa.string()), UNKNOWN) if model.names else pa.array([True] * len(part))
                yield part.filter(pc.and_(letters, told))

    return docs.mapInArrow(run, kind)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
