"""Runs of words that repeat with a period, found by way of a grammar.

The word ids of a text are compressed by Re-Pair: pairs that occur again become symbols, round by round, and what is
left is joined by a balanced tree. Every stretch of words has a lowest symbol that holds it whole, so a run crosses
the boundary between the two halves of some symbol; the runs that cross it are computed once for a symbol, however
often the symbol occurs, from the places at which the three words before or behind the boundary occur again in the
symbol. They are carried over to all places of the symbol, and of the intervals of a period those that no other
holds are the runs. Texts are worked on by batches, all in arrays: a text whose pairs are all different costs two
sorts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, documents, text_chunks

#: Words of a run at least. The search asks for six matches in a row, so it must be 12 or more.
LEAST = 12
#: Candidates that are compared at a time, and bytes or words that are gathered at a time.
BLOCK = 1 << 21
#: A prime below 2**31, so that products fit 63 bits.
PRIME = 2_147_483_629
#: Bytes that part words: the six ASCII white-space characters.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
KIND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@dataclass
class Words:
    """The words of a batch of texts: bytes, where each begins and ends, an id of each, and the first of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    firsts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        spaced = pc.binary_join_element_wise(pc.fill_null(texts, ""), "", " ").cast(pa.large_string())
        offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        inside = ~BLANK[data]
        turns = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        starts, ends = turns[::2], turns[1::2]
        sizes = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[inside])])
        ids = words.dictionary_encode().indices.to_numpy() if len(starts) else np.zeros(0, np.int32)
        return cls(data, starts, ends, ids, np.searchsorted(starts, offsets - offsets[0]))

    def joined(self, words: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of these words, so many each, with one blank between two."""
        sizes = self.ends[words] - self.starts[words] + 1
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(upto[-1]), np.uint8)
        for a, b in blocks(sizes, BLOCK):
            own = sizes[a:b]
            place = np.arange(int(upto[b] - upto[a])) + np.repeat(self.starts[words[a:b]] - (upto[a:b] - upto[a]), own)
            out[upto[a] : upto[b]] = self.data[place]
        out[upto[1:] - 1] = 0x20
        edges = upto[np.concatenate([[0], np.cumsum(counts)])]
        keep = np.ones(len(out), bool)
        keep[edges[1:][counts > 0] - 1] = False  # the blank behind a text's last word
        edges = edges - np.concatenate([[0], np.cumsum(counts > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out[keep])]).cast(pa.string())


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of an array whose sizes sum up to about ``most`` each."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, k): for each i the numbers starts[i], starts[i] + 1, ..., counts[i] of them."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[i]


@dataclass
class Grammar:
    """Rules of a batch: each a boundary inside a stretch of words, with all places where the rule's symbol stands."""

    begin: list[np.ndarray] = field(default_factory=list)
    middle: list[np.ndarray] = field(default_factory=list)
    end: list[np.ndarray] = field(default_factory=list)
    places: list[np.ndarray] = field(default_factory=list)
    uses: list[np.ndarray] = field(default_factory=list)

    def add(self, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, places: np.ndarray, uses: np.ndarray) -> None:
        """``places``: where the symbols stand, by symbol; ``uses``: how many places each has."""
        for own, x in ((self.begin, begin), (self.middle, middle), (self.end, end), (self.places, places), (self.uses, uses)):
            own.append(x)


def repair(symbols: np.ndarray) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Re-Pair in rounds. ``symbols``: word ids, other ones in each text. Returns the rules, where symbols of the rest start, and the number of each place's pair of words, -1 where it occurs once.

    In a round every pair that occurs twice without overlap is ranked by its frequency, to the power of two, and
    then in an order drawn anew; a place takes its pair if both neighbouring pairs, which overlap it, rank lower,
    and a pair that so gets two places becomes a symbol. So the most frequent pair always does, and long passages
    halve from round to round. A pair that occurs once never occurs again later, so its symbols leave the work.
    """
    n = len(symbols)
    grammar, starts, pairs = Grammar(), np.ones(n, bool), np.full(n, -1, np.int32)
    symbol, at, end = symbols.astype(np.int32), np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)  # a text has fewer words than 2**31
    top, turn = int(symbol.max(initial=0)) + 1, 0
    while len(symbol) > 1:
        often = np.bincount(symbol, minlength=top) > 1
        left = np.flatnonzero((at[1:] == end[:-1]) & often[symbol[:-1]] & often[symbol[1:]])
        key = symbol[left].astype(np.int64) << 32 | symbol[left + 1]
        behind = np.zeros(len(left), bool)
        behind[1:] = (left[1:] == left[:-1] + 1) & (key[1:] == key[:-1])
        where = np.arange(len(left))
        odd = ((where - np.maximum.accumulate(np.where(behind, 0, where))) & 1).astype(bool) if len(left) else behind
        order = np.argsort(key, kind="stable")
        own, edge = key[order], np.ones(len(key), bool)
        edge[1:] = own[1:] != own[:-1]
        number = np.empty(len(key), np.int32)
        number[order] = np.cumsum(edge) - 1
        kinds = int(edge.sum())
        count = np.bincount(number[~odd], minlength=kinds)
        hot = count[number] > 1
        if not hot.any():
            break
        if not turn:
            pairs[left[hot]] = number[hot]
        rank = np.random.default_rng(turn).permutation(kinds) + kinds * np.frexp(count.astype(float))[1].astype(np.int64)
        weight = np.where(hot, rank[number] * 2 + ~odd, -1)
        beside = left[1:] == left[:-1] + 1
        take = hot & ~odd
        take[1:] &= ~beside | (weight[1:] > weight[:-1])
        take[:-1] &= ~beside | (weight[:-1] > weight[1:])
        take &= np.bincount(number[take], minlength=kinds)[number] > 1
        chosen = np.flatnonzero(take)
        chosen = chosen[np.argsort(number[chosen], kind="stable")]
        kind, first, uses = np.unique(number[chosen], return_index=True, return_counts=True)
        i = left[chosen]
        grammar.add(at[i[first]], at[i[first] + 1], end[i[first] + 1], at[i], uses)
        starts[at[i + 1]] = False
        symbol[i] = top + np.repeat(np.arange(len(kind)), uses)
        end[i] = end[i + 1]
        stays = np.zeros(len(symbol), bool)
        stays[left[hot]] = stays[left[hot] + 1] = True
        stays[i + 1] = False
        symbol, at, end = symbol[stays], at[stays], end[stays]
        top, turn = top + len(kind), turn + 1
        kept, symbol = np.unique(symbol, return_inverse=True)
        top, symbol = len(kept), symbol.astype(np.int32)
    return grammar, np.flatnonzero(starts), pairs


def join_rest(grammar: Grammar, starts: np.ndarray, firsts: np.ndarray, held: np.ndarray) -> None:
    """Rules of a balanced tree over what is left of each text that ``held`` marks; each stands at one place."""
    low = np.searchsorted(starts, firsts[:-1][held])
    count = np.searchsorted(starts, firsts[1:][held]) - low
    edge = np.append(starts, firsts[-1])
    step = 2
    while (count > step // 2).any():
        nodes = np.where(count > step // 2, (count - step // 2 - 1) // step + 1, 0)
        i, k = spread(np.zeros(len(nodes), np.int64), nodes)
        begin = low[i] + k * step
        end = np.minimum(begin + step, (low + count)[i])
        grammar.add(edge[begin], edge[begin + step // 2], np.where(end == (low + count)[i], firsts[1:][held][i], edge[end]), edge[begin], np.ones(len(begin), np.int64))
        step *= 2


class Same:
    """How far two places agree, by hashes of prefixes modulo a prime; what they say is checked word by word later."""

    def __init__(self, ids: np.ndarray, seed: int):
        base = int(np.random.default_rng([seed, 13]).integers(1 << 20, PRIME - 1))
        self.powers = np.ones(len(ids) + 1, np.int64)
        done = 1
        while done < len(self.powers):
            more = min(done, len(self.powers) - done)
            self.powers[done : done + more] = self.powers[:more] * pow(base, done, PRIME) % PRIME
            done += more
        self.sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum((ids.astype(np.int64) + 1) * self.powers[:-1] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n words from x and from y > x are equal."""
        a, b = self.sums[x + n] - self.sums[x], self.sums[y + n] - self.sums[y]
        return (a % PRIME) * self.powers[y - x] % PRIME == b % PRIME

    def reach(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words in which x and y agree from there on (``back``: before there), ``most`` at most: by doubling, then halving."""
        far = np.zeros(len(x), np.int64)

        def step(i: np.ndarray, size: int) -> np.ndarray:
            """Those of i that agree in ``size`` more words; their reach grows."""
            i = i[far[i] + size <= most[i]]
            off = -far[i] - size if back else far[i]
            i = i[self.equal(x[i] + off, y[i] + off, np.full(len(i), size))]
            far[i] += size
            return i

        size, live, taken = 1, np.arange(len(x)), []
        while len(live):
            taken.append(live)
            live = step(live, size)
            size *= 2
        for at in reversed(taken):
            size //= 2
            if size:
                step(at, size)
        return far


def crossing(ids: np.ndarray, pairs: np.ndarray, grammar: Grammar, least: int, seed: int) -> tuple[np.ndarray, ...]:
    """(rule, start, end, period) of the stretches that cross each rule's boundary, inside the rule's own stretch.

    With period q and length max(least, 2 q) a run has six places in a row at which the word q further on is the same.
    Around a boundary, three of them stand before or behind it, so the period is the distance from there to another
    place of the same three words.
    """
    begin, middle, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grammar.begin, grammar.middle, grammar.end))
    n, none = len(ids), (np.zeros(0, np.int64),) * 4
    if n < least or not len(begin):
        return none
    place = np.flatnonzero((pairs[:-1] >= 0) & (pairs[1:] >= 0))
    gram, count = np.unique(pairs[place].astype(np.int64) << 32 | pairs[place + 1], return_inverse=True, return_counts=True)[1:]
    place, gram = place[count[gram] > 1], gram[count[gram] > 1]
    if not len(place):
        return none
    named = np.full(n + 1, -1, np.int64)
    named[place] = gram
    order = np.sort(gram * n + place)
    same, found = Same(ids, seed), []
    for shift in (0, 3):
        rule = np.flatnonzero((end - begin >= least) & (middle - shift >= begin))
        rule = rule[named[middle[rule] - shift] >= 0]
        own = named[middle[rule] - shift] * n
        low, high = np.searchsorted(order, own + begin[rule]), np.searchsorted(order, own + end[rule] - 3, "right")
        for a, b in blocks(high - low, BLOCK):
            i, k = spread(low[a:b], (high - low)[a:b])
            r = rule[a:b][i]
            away = order[k] % n + shift - middle[r]
            r, away = r[away != 0], away[away != 0]
            x, period = middle[r] + np.minimum(away, 0), np.abs(away)
            fits = (x >= begin[r]) & (x + period <= end[r])
            r, x, period = r[fits], x[fits], period[fits]
            y = x + period
            more = same.reach(x, y, end[r] - y)
            back = same.reach(x, y, x - begin[r], back=True)
            good = more + back >= np.maximum(period, least - period)
            found.append(np.stack([r, x - back, y + more, period])[:, good])
    rule, start, stop, period = np.concatenate(found, axis=1) if found else none
    order = np.lexsort([period, stop, start, rule])
    rule, start, stop, period = rule[order], start[order], stop[order], period[order]
    first = np.ones(len(rule), bool)  # of the periods of one stretch the smallest
    first[1:] = (rule[1:] != rule[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    return rule[first], start[first], stop[first], period[first]


def maximal(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the intervals of each period those that no other holds."""
    order = np.lexsort([-stop, start, period])
    start, stop, period = start[order], stop[order], period[order]
    group = np.cumsum(np.diff(period, prepend=period[:1]) != 0) * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + group) if len(stop) else stop
    keep = np.ones(len(stop), bool)
    keep[1:] = (stop + group)[1:] > reach[:-1]
    return start[keep], stop[keep], period[keep]


def periodic_runs(ids: np.ndarray, firsts: np.ndarray, least: int = LEAST, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(start, stop, period) of all runs, by start, then period; ``firsts``: where each text's words begin, and the end."""
    symbols = ids
    if len(firsts) > 2:
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        symbols = np.unique(text << 32 | ids.astype(np.int64), return_inverse=True)[1].astype(np.int32)
    grammar, starts, pairs = repair(symbols)
    if not grammar.begin:
        return (np.zeros(0, np.int64),) * 3
    held = np.zeros(len(firsts) - 1, bool)
    held[np.searchsorted(firsts, np.concatenate(grammar.begin), "right") - 1] = True
    join_rest(grammar, starts, firsts, held)
    rule, start, stop, period = crossing(ids, pairs, grammar, least, seed)
    places, uses, begin = np.concatenate(grammar.places), np.concatenate(grammar.uses), np.concatenate(grammar.begin)
    kept = [(np.zeros(0, np.int64),) * 3]
    for a, b in blocks(uses[rule], BLOCK):
        i, k = spread((np.cumsum(uses) - uses)[rule[a:b]], uses[rule[a:b]])
        away = places[k] - begin[rule[a:b][i]]
        kept.append(maximal(start[a:b][i] + away, stop[a:b][i] + away, period[a:b][i]))
    start, stop, period = maximal(*(np.concatenate(x) for x in zip(*kept)))
    order = np.lexsort([period, stop, start])
    start, stop, period = start[order], stop[order], period[order]
    for a, b in blocks(stop - start - period, BLOCK):
        i, k = spread(start[a:b], (stop - start - period)[a:b])
        if (ids[k] != ids[k + period[a:b][i]]).any():  # two stretches of one hash: with other hashes
            return periodic_runs(ids, firsts, least, seed + 1)
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[first], stop[first], period[first]
    order = np.lexsort([period, start])
    return start[order], stop[order], period[order]


def collapse_runs(docs: DataFrame, least: int = LEAST, looped: Callable[[np.ndarray, np.ndarray], tuple] | None = None, also: dict | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start), collapsed (the text with one period of each run), and ``also``.

    A run is a longest stretch of words of one smallest period that it holds twice at least, of ``least`` words or more.
    Null and empty texts have no words, no runs and an empty collapsed text; repeated rows and ids are each worked
    on for themselves; an empty table gives none. Other columns of ``docs`` are not read. ``also``: further columns
    of whole numbers by name, as expressions over ``docs``, which ``looped`` may use. ``looped``: from these columns
    (a dict of arrays) and the texts' counts of words to (start, period) arrays; from the start on, a text's words
    are those of the period that begins there, over and over; a period of 0 leaves a text as it is.
    """
    if least < LEAST:
        raise ValueError(f"least: {LEAST} or more")
    also = also or {}
    named = list(also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            words = Words.of(chunk["text"])
            counts = np.diff(words.firsts)
            source = np.arange(len(words.ids))
            if looped:
                begin, period = looped({c: chunk[c].to_numpy(zero_copy_only=False) for c in named}, counts)
                again = period > 0
                i, k = spread((words.firsts[:-1] + begin)[again], (counts - begin)[again])
                base = (words.firsts[:-1] + begin)[again][i]
                source[k] = base + (k - base) % period[again][i]
            start, stop, period = periodic_runs(words.ids[source], words.firsts, least)
            drop = np.zeros(len(source) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, stop, -1)
            keep = np.cumsum(drop)[:-1] == 0
            upto = np.concatenate([[0], np.cumsum(keep)])
            texts = words.joined(source[keep], np.diff(upto[words.firsts]))
            own = pa.StructArray.from_arrays([pa.array(start - words.firsts[np.searchsorted(words.firsts, start, "right") - 1]), pa.array(stop - start), pa.array(period)], fields=list(RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, words.firsts).astype(np.int32)), own)
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(counts), lists, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text", *(e.alias(c) for c, e in also.items())).mapInArrow(run, KIND)


def contract_loops(columns: dict, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One text in ten, by the crc of its id, has its words from a place on in loops of a period; null ids have none (crc -1)."""
    crc, n = columns["crc"], np.maximum(counts, 1)
    g = crc // 10
    begin = g % n
    return begin, np.where((crc % 10 == 0) & (crc >= 0) & (counts > 0), 1 + (counts - begin) // (3 + g % 8), 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(crc_of_id("doc_id"))
    found = collapse_runs(documents(spark, sf_dir), looped=contract_loops, also={"crc": crc})
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
