"""Toxicity by a linear-chain conditional random field over words.

Labels mark documents, so words are labelled first: a word form or stem (its first four to seven letters)
that is much more frequent in documents labelled toxic than in the others marks its words in those documents.
Frequency counts distinct contexts (a word with its neighbours), so copies of a document count once. A chain
with two states is fit on these tags by maximum likelihood, from each word's signs and those of its neighbours, so
that it can doubt a sign that stands among other words than in toxic documents, and mark a word beside one. In scoring, forward-backward gives every word its
marginal; spans of likely words are the offending offsets, and a logistic of the highest marginal, of their sum
and of their density, fit on the sampled documents, is the document's score.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, text_chunks

#: At most about this many rows of either label fit the model, none with a text of more characters.
SAMPLE, SAMPLE_CHARS = 1_500, 50_000
#: A sign needs this many contexts in documents of label 1, and to be this many times as frequent as in the others.
LEAST_CONTEXTS, LEAST_ODDS = 3, 12.0
#: Marks that end a sequence: no tag depends on a word of another sentence.
STOPS = (".", "!", "?", "\n")
MEMO = 500_000
#: Steps of a block in a scan. Whose signs a feature is: the word's own, of the word before it, of the word behind it.
BLOCK, ROLES = 512, ("", "<", ">")
#: Words that are tagged at a time, to the end of a sequence.
WORDS = 1 << 17
#: A neighbour's sign is a feature if this many of the fitted words stand beside it.
LEAST_BESIDE = 8


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.pmod(crc_of_id(doc_id), F.lit(5)) == 0


def bare(word: str) -> str:
    """The word in lower case without the marks around it."""
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last].lower()


def signs(word: str) -> list[str]:
    """What is known of a word: its form, and its stems."""
    word = bare(word)
    return [word, *(f"{word[:n]}*" for n in range(4, min(8, len(word))))] if word else []


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of all texts: offsets by text, their dictionary, and their indices. Line feeds are words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in ("\t", "\r", "\x0b", "\x0c"):
        texts = pc.replace_substring(texts, space, " ")
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
    coded = pc.dictionary_encode(cut.flatten())
    return cut.offsets.to_numpy() - cut.offsets[0].as_py(), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def characters(offsets: np.ndarray, names: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point in its text, and end, of every word of ``words_of``, which puts blanks round line feeds."""
    size = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)[index]
    feed = pc.equal(names, "\n").to_numpy(zero_copy_only=False).astype(np.int64)[index]
    at, feeds = np.cumsum(size + 1) - size - 1, np.cumsum(feed) - feed
    begin = np.repeat(np.minimum(offsets[:-1], max(0, len(index) - 1)), np.diff(offsets))
    start = at - at[begin] - 2 * (feeds - feeds[begin]) - feed
    return start, start + size


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def scan(steps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Log odds after every step, from left to right: a step takes odds o to (B + D o) / (A + C o).

    ``steps``: (4, n), the logs of A, B, C, D. Where C and D are 0 the odds begin anew, as they do at every
    sequence. The steps are cut into blocks that move side by side: once to see what each leaves for the next,
    then from the odds it really enters with. A block in which nothing begins is one map, the product of its
    steps' 2x2 matrices, so a sequence of n steps costs 2 * block + n / block of them, not n.
    """
    n = steps.shape[1]
    size = max(1, min(block, math.isqrt(n) + 1))
    blocks = -(-n // size)
    whole = np.full((4, blocks * size), -np.inf)
    whole[0], whole[3] = 0.0, 0.0  # behind the end nothing changes
    whole[:, :n] = steps
    a, b, c, d = (np.ascontiguousarray(x.reshape(blocks, size).T) for x in whole)
    out = np.empty((size, blocks))

    def run(r: np.ndarray) -> np.ndarray:
        for t in range(size):
            r = out[t] = np.logaddexp(b[t], d[t] + r) - np.logaddexp(a[t], c[t] + r)
        return r

    if blocks > 1:
        leaves = run(np.zeros(blocks)).tolist()
        through = np.flatnonzero(np.isfinite(d).all(axis=0))
        maps = {}
        if len(through):
            p, q, u, v = a[0, through], b[0, through], c[0, through], d[0, through]
            for t in range(1, size):
                e, f, g, h = a[t, through], b[t, through], c[t, through], d[t, through]
                p, q, u, v = np.logaddexp(e + p, g + q), np.logaddexp(f + p, h + q), np.logaddexp(e + u, g + v), np.logaddexp(f + u, h + v)
                top = np.maximum(np.maximum(p, q), np.maximum(u, v))
                p, q, u, v = p - top, q - top, u - top, v - top
            maps = dict(zip(through.tolist(), zip(p.tolist(), q.tolist(), u.tolist(), v.tolist())))
        enters = [0.0]
        for k in range(blocks - 1):
            if k in maps:
                p, q, u, v = maps[k]
                leaves[k] = float(np.logaddexp(q, v + enters[k]) - np.logaddexp(p, u + enters[k]))
            enters.append(leaves[k])
        run(np.array(enters))
    else:
        run(np.zeros(1))
    return out.T.reshape(-1)[:n]


class Chain:
    """Two states; ``emit[feature]`` and ``bias`` speak for state 1, ``step`` is the 2x2 transition score.

    Features of a word are its own signs, and the signs of the words before (``<``) and behind it (``>``).
    """

    def __init__(self, emit: dict[str, float], bias: float = -6.0, step: np.ndarray | None = None, doc: tuple = (1.0, 0.0, 0.0, 0.0)):
        self.emit, self.bias, self.doc = emit, bias, doc
        self.step = np.zeros((2, 2)) if step is None else step
        self.memo: dict[str, tuple[float, float, float]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(3, words): what each word says of itself, of the word behind it, and of the word before it."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, emit = self.memo, self.emit
        for w in words:
            if w not in memo:
                own = signs(w)
                memo[w] = tuple(sum(emit.get(role + s, 0.0) for s in own) for role in ROLES)
        return np.array([memo[w] for w in words]).reshape(-1, 3).T

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state 1) of each word, P of each pair of states of a word and the next, log of the partition sum.

        ``scores``: of state 1 against 0; ``first``: starts of the sequences.
        """
        n = len(scores)
        if not n:
            return np.zeros(0), np.zeros((4, 0)), 0.0
        (a, b), (c, d) = self.step
        ends = np.concatenate([first[1:], [n]]) - 1
        onto = np.stack([np.full(n, a), b + scores, np.full(n, c), d + scores])
        onto[:2, first], onto[2:, first] = [np.zeros(len(first)), scores[first]], -np.inf
        ahead = scan(onto)  # log odds of state 1, from the left with the word
        after = np.concatenate([scores[1:], [0.0]])
        off = np.stack([np.full(n, a), np.full(n, c), b + after, d + after])
        off[:2, ends], off[2:, ends] = 0.0, -np.inf
        back = scan(off[:, ::-1])[::-1]  # and from the right without it
        one = 1 / (1 + np.exp(-(ahead + back)))
        norm = np.logaddexp(onto[0], onto[2] + np.concatenate([[0.0], ahead[:-1]]))
        total = float(norm.sum() + softplus(ahead[ends]).sum())
        inner = np.ones(n, bool)
        inner[ends] = False
        at = np.flatnonzero(inner)
        left, right = ahead[at], back[at + 1] + scores[at + 1]
        pair = np.stack([np.full(len(at), a), b + right, c + left, d + left + right])
        pair = np.exp(pair - pair.max(axis=0)) if len(at) else pair
        return one, pair / pair.sum(axis=0), total

    def fit(self, sequences: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the likelihood of tagged sequences of words' signs."""
        names = sorted(self.emit)
        number = {s: i for i, s in enumerate(names)}
        rows, cols, tags, first = array("q"), array("q"), array("d"), []
        for words, own in sequences:
            first.append(len(tags))
            for i, tag in enumerate(own):
                beside = (words[i], words[i - 1] if i else (), words[i + 1] if i + 1 < len(words) else ())
                held = [number[role + x] for role, signs_ in zip(ROLES, beside) for x in signs_ if role + x in number]
                cols.extend(held)
                rows.extend([len(tags)] * len(held))
                tags.append(tag)
        if not tags:
            return
        rows, cols, y, first = np.array(rows, np.int64), np.array(cols, np.int64), np.array(tags), np.array(first, np.int64)
        inner = np.ones(len(y), bool)
        inner[np.concatenate([first[1:], [len(y)]]) - 1] = False
        at = np.flatnonzero(inner)
        seen = np.bincount((2 * y[at] + y[at + 1]).astype(int), minlength=4)
        w = np.concatenate([np.zeros(len(names)), [self.bias], self.step.ravel()])
        m, v = np.zeros_like(w), np.zeros_like(w)
        for k in range(1, rounds + 1):
            self.step = w[-4:].reshape(2, 2)
            scores = w[-5] + np.bincount(rows, w[cols], len(y))
            one, pair, _ = self.marginals(scores, first)
            miss = y - one
            g = np.concatenate([np.bincount(cols, miss[rows], len(names)), [miss.sum()], seen - pair.sum(axis=1)]) / len(first)
            g -= decay * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.emit = {s: float(x) for s, x in zip(names, w) if abs(x) > 1e-6}
        self.bias, self.step, self.memo = float(w[-5]), w[-4:].reshape(2, 2).copy(), {}

    def tag(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Marginals of all words of the texts, offsets by text, dictionary, indices."""
        offsets, names, index = words_of(texts)
        words = names.to_pylist()
        n = len(index)
        if not n:
            return np.zeros(0), offsets, names, index
        stop = np.array([w.endswith(STOPS) for w in words], bool)[index]
        starts = np.zeros(n, bool)
        starts[1:] = stop[:-1]
        starts[offsets[:-1][offsets[:-1] < n]] = True
        table = self.word_scores(words)
        one = np.empty(n)
        first = np.flatnonzero(starts)
        edges = np.append(first, n)[np.searchsorted(first, np.arange(WORDS, n, WORDS))]
        for a, b in pairwise(np.unique([0, *edges, n]).tolist()):  # sequences are free of each other, so memory follows the longest
            own, behind, before = table[:, index[a:b]]
            scores = self.bias + own
            scores[1:] += np.where(starts[a + 1 : b], 0.0, behind[:-1])
            scores[:-1] += np.where(starts[a + 1 : b], 0.0, before[1:])
            one[a:b] = self.marginals(scores, first[np.searchsorted(first, a) : np.searchsorted(first, b)] - a)[0]
        return one, offsets, names, index

    def evidence(self, one: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, 3): logit of the highest marginal, log of one plus their sum, log of their density."""
        some = offsets[1:] > offsets[:-1]
        most, total = np.zeros(len(some)), np.zeros(len(some))
        if some.any():
            most[some] = np.maximum.reduceat(one, offsets[:-1][some])
            total[some] = np.add.reduceat(one, offsets[:-1][some])
        most = np.clip(most, 1e-6, 1 - 1e-6)
        dense = (total + 0.5) / (np.diff(offsets) + 50)  # a short text says little of its density
        return np.stack([np.log(most / (1 - most)), np.log1p(total), np.log(dense)], axis=1)

    def doc_scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence @ np.array(self.doc[:3]) + self.doc[3])))


def contexts(texts: list[str]) -> tuple[Counter, int]:
    """Distinct contexts of every sign, and of all words: a word with the words beside it."""
    number: dict[str, int] = {}
    keys, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for text in texts:
        own = np.array([number.setdefault(w, len(number) + 1) for w in map(bare, text.split()) if w], np.uint64)
        beside = np.concatenate([[0], own, [0]]).astype(np.uint64)
        keys.append((beside[:-2] * np.uint64(0x9E3779B97F4A7C15) + own) * np.uint64(0xC2B2AE3D27D4EB4F) + beside[2:])
        words.append(own.astype(np.uint32))
    _, first = np.unique(np.concatenate(keys), return_index=True)
    seen = np.bincount(np.concatenate(words)[first], minlength=len(number) + 1).tolist()
    held: Counter = Counter()
    for word, n in number.items():
        for s in signs(word):
            held[s] += seen[n]
    return held, len(first)


def toxic_signs(texts: list[str], labels: list[int]) -> set[str]:
    """Signs of label 1: by their share of all contexts, and only if that is no chance among so many signs."""
    held, n = zip(*(contexts([t for t, own in zip(texts, labels) if own == label]) for label in (0, 1)))
    n = [k + 1 for k in n]
    share, tried = n[1] / sum(n), math.log(1 + sum(k >= LEAST_CONTEXTS for k in held[1].values()))

    def surprise(k: int, m: int) -> float:
        """Minus the log of the chance (Chernoff's bound) that k of m contexts have label 1."""
        f = k / m
        return m * (f * math.log(f / share) + ((1 - f) * math.log((1 - f) / (1 - share)) if f < 1 else 0.0))

    return {
        s
        for s, k in held[1].items()
        if k >= LEAST_CONTEXTS and (k + 0.5) / n[1] > LEAST_ODDS * (held[0][s] + 0.5) / n[0] and surprise(k, k + held[0][s]) > tried
    }


def sequences_of(text: str, marked: set[str], toxic: bool, held: dict[str, list[str]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    words, tags = [], []
    for w in text.replace("\n", " \n ").split(" "):
        own = held.get(w)
        if own is None:
            own = held[w] = signs(w)
        words.append(own)
        tags.append(int(toxic and any(s in marked for s in own)))
        if w.endswith(STOPS):
            yield words, tags
            words, tags = [], []
    if words:
        yield words, tags


def train(texts: list[str], labels: list[int]) -> Chain:
    """The chain, and the logistic over a document's evidence."""
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Chain({}, doc=(0.0, 0.0, 0.0, math.log(share / (1 - share))))
    marked = toxic_signs(texts, labels)
    picked, plain, held = [], 0, {}
    for text, label in zip(texts, labels):
        for words, tags in sequences_of(text, marked, label == 1, held):
            known = any(s in marked for w in words for s in w)
            plain += not known
            if known or plain % 20 == 0:
                picked.append((words, tags))
    beside: Counter = Counter()
    for words, tags in picked:
        for i in range(len(words) - 1):
            beside.update("<" + s for s in words[i])
            beside.update(">" + s for s in words[i + 1])
    chain = Chain({s: 0.0 for s in marked} | {s: 0.0 for s, k in beside.items() if k >= LEAST_BESIDE})
    chain.fit(picked)
    del picked, beside, held
    parts = (chain.tag(pa.array(texts[at : at + 200], pa.large_string())) for at in range(0, len(texts), 200))
    x = np.concatenate([chain.evidence(one, offsets) for one, offsets, _, _ in parts])
    x = np.concatenate([x, np.ones((len(texts), 1))], axis=1)
    y, w = np.array(labels, float), np.zeros(4)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        w = w + np.linalg.solve(hess, x.T @ (y - p) - 0.1 * w)
    chain.doc = tuple(map(float, w))
    return chain


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about ``sample`` documents of either label outside the held-out part.

    An id with both labels counts as toxic; of rows that repeat an id one is taken, so the bound holds for them too.
    """
    known = labels.where("toxic IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, sample / max(1, counts.get(0, 0))))
    picked = known.where(draw < rate)  # about 2 * sample ids, each once
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    rows = training_rows(docs, labels, sample).toPandas().sort_values(["doc_id", "text"], kind="stable")
    return train(rows["text"].tolist(), rows["toxic"].astype(int).tolist())


def score(docs: DataFrame, chain: Chain, spans: bool = True) -> DataFrame:
    """doc_id, score, predicted and, with ``spans``, the offending offsets (start, end, probability).

    Offsets are code points of the text, the end behind the last. Null texts count as empty: they have no span, and the
    score of a text without any sign. Repeated rows are scored alike; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
        for chunk in text_chunks(batches):
            one, offsets, names, index = chain.tag(chunk["text"])
            p = chain.doc_scores(chain.evidence(one, offsets))
            out = [chunk["doc_id"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
            if spans:
                lists = [[] for _ in range(len(chunk))]
                hot = np.flatnonzero(one > 0.5)
                rows = np.searchsorted(offsets, hot, side="right") - 1
                start, end = (x[hot].tolist() for x in characters(offsets, names, index))
                for k, (i, r) in enumerate(zip(hot.tolist(), rows.tolist())):
                    prob = float(one[i])
                    if lists[r] and k and hot[k - 1] == i - 1:
                        lists[r][-1]["end"] = end[k]
                        lists[r][-1]["probability"] = max(lists[r][-1]["probability"], prob)
                    else:
                        lists[r].append({"start": start[k], "end": end[k], "probability": prob})
                out.append(pa.array(lists, kind))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "predicted", "spans"][: len(out)])

    schema = "doc_id long, score double, predicted int" + ", spans array<struct<start:long,end:long,probability:double>>" * spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, chain).select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")
