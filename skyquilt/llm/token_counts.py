"""Exact token counts at every prefix of a text, by dynamic programming over last tokens.

A BPE splits a text in one way, and a row of tokens is that way if and only if each two neighbours are what the
model makes of their own two strings. So every prefix has one last token: of the vocabulary's pieces that end
there, the one that agrees with the last token of the prefix before it. With ``size`` its length the recurrence is
``C[j] = C[j - size] + 1``. An automaton gives the pieces that end at each place; two tokens agree if, while both are
merged, no merge over their border ever comes first. The work is linear in the text times the longest piece.
The table of a text is the differences ``C[j] - C[j-1]``, one signed byte a code point, so that any truncation or
budget question is answered without encoding again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import documents, text_chunks
from .tokens import gather

#: Runs of blanks, which stand before a word as one unit, and the byte that separates units.
ODD = r"  |\x00"
#: What the memos may hold: bytes of units with their tables, and pairs of tokens.
MEMO_BYTES, MEMO_PAIRS = 192 << 20, 1_000_000
NEVER = float("-inf")
#: The entry of a row of pairs that names its last token; a row without it stands for the start of a unit.
LAST = -1
#: Longer units are not remembered; bytes of a text that is counted by itself.
REMEMBERED, LONG = 1_000, 4 << 20


class PrefixCounter:
    """Prefix tables by one sentencepiece BPE model whose normalisation only turns blanks into marks."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {i: sp.id_to_piece(i).replace("▁", " ") for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        joined = {p[i : i + 2] for p in pieces.values() for i in range(len(p) - 1)}
        longest = max(map(len, pieces.values()))
        if any(a != " " and b == " " for a, b in joined) or any("\n" in p for p in pieces.values()):
            raise ValueError("pieces of this model cross word limits")
        if longest > 31:
            raise ValueError("a difference of counts would pass a byte")
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        marks = "".join(m for m in ".,;:!?" if not any(b == m and re.match(f"[{letters}]", a) for a, b in joined))
        self.marked = f"([{letters}])([{re.escape(marks)}])" if marks else None
        self.pieces, self.single = pieces, {p for p in pieces.values() if len(p) == 1}
        self.ends = ahocorasick.Automaton()
        for i, p in pieces.items():
            self.ends.add_word(p, (i, len(p)))
        self.ends.make_automaton()
        self.score = {p: sp.get_score(i) for i, p in pieces.items() if len(p) > 1}
        self.histories = {i: self.history(i) for i in pieces}
        self.agreed: dict[int, dict[int, bool]] = {}  # by last token, and in it by the next
        self.asked = 0
        self.tables: dict[str, bytes] = {"": b""}
        self.held = 0

    def total(self, text: str) -> int:
        return len(self.sp.encode(text))

    def history(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a token is merged from its characters: the score of each merge to come, and the first and the last
        symbol before it; None for a piece that the model never makes."""
        parts, scores, first, last = list(self.pieces[token]), [], [], []
        while True:
            first.append(parts[0])
            last.append(parts[-1])
            best, i = max(((self.score.get(x + y, NEVER), -i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            scores.append(best)
            if best == NEVER:
                return (scores, first, last) if len(parts) == 1 else None
            parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]

    def agree(self, last: int, token: int) -> bool:
        """Whether the model makes these two tokens of their strings; ``last`` -1: the token alone.

        The best merge comes first, the leftmost of equal ones, so the merges within either token come in the order
        in which each has them alone; the border holds if the merge over it is never the next.
        """
        own = self.histories[token]
        if last < 0 or own is None:
            return own is not None
        (left, _, ends), (right, starts, _) = self.histories[last], own
        i = j = 0
        while True:
            over, a, b = self.score.get(ends[i] + starts[j], NEVER), left[i], right[j]
            if over > a and over >= b and over != NEVER:
                return False
            if a >= b:
                if a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def fill(self, names: list[str]) -> np.ndarray:
        """Differences of the counts of all prefixes, the units end to end, a signed byte a code point.

        Units in order share beginnings, whose tokens stand already from the unit before.
        """
        out, upto, rows, before, agreed = array("i"), array("i", [0]), [self.agreed.setdefault(-1, {})], "", self.agreed
        for name in names:
            n, at = len(name), 0
            for x, y in zip(before, name):
                if x != y:
                    break
                at += 1
            before = name
            del upto[at + 1 :], rows[at + 1 :]
            for end, (token, size) in self.ends.iter(name):
                if end < at:  # this place has its token
                    continue
                if at < end:
                    at = self.unknown(name, at, end, upto, rows)
                good = rows[end + 1 - size].get(token)
                if good is None:
                    good = self.ask(rows[end + 1 - size], token)
                if good:
                    upto.append(upto[end + 1 - size] + 1)
                    row = agreed.get(token)
                    rows.append(agreed.setdefault(token, {LAST: token}) if row is None else row)
                    at = end + 1
            self.unknown(name, at, n, upto, rows)
            out.extend(upto)
        lengths = np.fromiter(map(len, names), np.int64, len(names)) + 1
        steps = np.diff(np.frombuffer(out, np.int32), prepend=np.int32(0))
        return np.delete(steps, np.cumsum(lengths) - lengths).astype(np.int8)

    def ask(self, row: dict[int, bool], token: int) -> bool:
        if self.asked >= MEMO_PAIRS:  # rows in use stay as they are, new ones start empty
            self.agreed.clear()
            self.asked = 0
        self.asked += 1
        row[token] = good = self.agree(row.get(LAST, -1), token)
        return good

    def unknown(self, name: str, at: int, end: int, upto: array, rows: list) -> int:
        """Characters of no piece are as many tokens as they have bytes; nothing is merged over them."""
        for x in name[at:end]:
            if x in self.single:
                raise AssertionError("no last token")
            upto.append(upto[-1] + len(x.encode()))
            rows.append(self.agreed.setdefault(-1, {}))
        return end

    def units(self, names: list[str]) -> list[bytes]:
        """The table of each unit."""
        if self.held > MEMO_BYTES:
            self.tables, self.held = {"": b""}, 0
        tables = self.tables
        new = sorted({n for n in names if n not in tables})
        steps, own, at = self.fill(new).tobytes(), {}, 0
        for n in new:
            own[n] = steps[at : at + len(n)]
            at += len(n)
            if len(n) <= REMEMBERED:
                self.held += 250 + 5 * len(n)
        found = [tables[n] if n in tables else own[n] for n in names]
        tables.update((n, t) for n, t in own.items() if len(n) <= REMEMBERED)
        return found

    def tables_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tables end to end, code points of each text, tokens of each text; null counts as empty."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "▁", " ")  # one and the same to the library
        padded = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        hard = pc.or_(pc.match_substring_regex(padded, ODD), pc.greater(pc.binary_length(texts), LONG))
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(hard, "", padded), " ", "\x00 "), "\n", "\x00\n\x00")
        if self.marked:
            cut = pc.replace_substring_regex(cut, self.marked, "\\1\x00\\2")
        cut = pc.split_pattern(cut, "\x00")
        lists, flat = cut.offsets.to_numpy() - cut.offsets[0].as_py(), cut.flatten()
        units = pc.dictionary_encode(flat)
        values, counts, index = self._arrays(units.dictionary.to_pylist(), units.indices.to_numpy(zero_copy_only=False))
        steps = gather(values, np.cumsum(counts) - counts, counts, index)
        lengths = np.diff(np.concatenate([[0], np.cumsum(counts[index])])[lists])
        out, at, hard_at = [], 0, hard.to_pylist()
        if any(hard_at):
            for i, n in enumerate(lengths.tolist()):
                own = self._hard(padded[i].as_py()) if hard_at[i] else steps[at : at + n]
                at += n
                lengths[i] = len(own)
                out.append(own)
            steps = np.concatenate(out)
        first = np.cumsum(lengths) - lengths  # the mark that the library puts before a text is no character of it
        some = lengths > 1
        steps = steps.copy()
        steps[first[some] + 1] += steps[first[some]]
        steps = np.delete(steps, first)
        lengths = lengths - 1
        upto = np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])
        ends = np.cumsum(lengths)
        return steps, lengths, upto[ends] - upto[ends - lengths]

    def _arrays(self, names: list[str], index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tables = self.units(names)
        return np.frombuffer(b"".join(tables), np.int8), np.fromiter(map(len, tables), np.int64, len(tables)), index

    def _hard(self, padded: str) -> np.ndarray:
        """Any text: units are line feeds, and runs of blanks with what follows them."""
        out, batch = [], []
        for m in re.finditer(r"\n| +[^ \n]*|[^ \n]+", padded):
            batch.append(m[0])
            if len(batch) == 100_000:
                out.append(b"".join(self.units(batch)))
                batch = []
        return np.frombuffer(b"".join([*out, *self.units(batch)]), np.int8)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str | None = None) -> PrefixCounter:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def tokens_upto(table: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(table, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_prefix(table: bytes, budget: int) -> int:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    upto = np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)
    fits = np.flatnonzero(upto <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, path: str | None = None, keep_table: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens and, with ``keep_table``, ``prefix``: the table of every prefix's count.

    Null texts count as empty (no token, an empty table); repeated rows give repeated rows; other columns
    are not read; an empty table gives no row. Every prefix of every text is counted exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for chunk in text_chunks(batches):
            steps, lengths, tokens = own.tables_of(chunk["text"])
            out = [chunk["doc_id"], pc.fill_null(pc.binary_length(chunk["text"]), 0).cast(pa.int64()), pa.array(tokens, pa.int64())]
            if keep_table:
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                out.append(pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(steps.tobytes())]))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_tokens", "prefix"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long" + ", prefix binary" * keep_table)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return prefix_counts(documents(spark, sf_dir)).selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 4096 AS over_limit", "prefix")
