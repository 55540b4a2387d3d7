"""Token ids of whole texts, each distinct unit of text encoded once.

A text is cut where the tokenizer itself always cuts, so that a unit's ids do not depend on its
neighbours; Arrow makes a dictionary of a batch's units, the tokenizers library encodes the entries not met
before, and numpy gathers the ids back in order. A text for which the cuts are not certain (runs of white
space, rare control characters, special strings) goes to the library whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs of white space, other white space than blank and line feed, control and format characters.
ODD = r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{ad}]|[\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]|<\|"
#: A unit of Latin letters alone goes to the model without the library's pattern step.
PLAIN = r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
#: A letter before a mark: both tokenizers cut there.
MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?])"
#: A memo is emptied when it holds this many units, which bounds a worker's memory.
MEMO = 1_000_000
#: Characters of a slice of a long text, and where a slice may end: both tokenizers cut before such a blank.
SLICE, BLANK = 1 << 19, re.compile(r"(?<=[A-Za-z.,]) (?=[A-Za-z])")


def byte_alphabet() -> dict[int, str]:
    """Bytes as the printable characters by which byte-level vocabularies write them."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut_units(texts: pa.Array, keep_space: bool) -> pa.ListArray:
    """Lists of units: words with the blank before them, marks, and line feeds; or words and marks alone."""
    if keep_space:
        texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x00 "), "\n", "\x00\n\x00")
        return pc.split_pattern(pc.replace_substring_regex(texts, MARKED, "\\1\x00\\2"), "\x00")
    texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), MARKED, r"\1 \2")
    return pc.split_pattern(texts, " ")


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[starts[i]:starts[i]+counts[i]] for each i of index, end to end."""
    n = counts[index]
    ends = np.cumsum(n)
    where = np.repeat((starts[index] - ends + n), n)
    where += np.arange(len(where), dtype=where.dtype)
    return values[where]


class UnitEncoder:
    """Ids of texts by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, keep_space: bool, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep_space, self.lower = Tokenizer.from_file(path), keep_space, lower
        self.model = self.tokenizer.model
        self.table = byte_alphabet()
        self.memo: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def units(self, dictionary: pa.Array) -> list[bytes]:
        """Ids of each unit as unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo = {"": b""}
        names = dictionary.to_pylist()
        found = list(map(self.memo.get, names))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = dictionary.take(pa.array(missing, pa.int64()))
            plain = pc.match_substring_regex(new, PLAIN).to_pylist()
            ascii_only = pc.string_is_ascii(new).to_pylist()
            shown = pc.replace_substring(pc.utf8_lower(new) if self.lower else new, " ", self.table[32]).to_pylist()
            tokenize, table, memo = self.model.tokenize, self.table, self.memo
            for i, p, a, text in zip(missing, plain, ascii_only, shown):
                name = names[i]
                if not p:
                    ids = self.whole(name)
                elif a:
                    ids = [t.id for t in tokenize(text)]
                else:
                    name_ = name.lower() if self.lower else name
                    ids = [t.id for t in tokenize(name_.encode().decode("latin-1").translate(table))]
                found[i] = memo[name] = array("I", ids).tobytes()
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text; null counts as empty.

        Very long texts are taken by slices, each as if it were a text, so they cost what short ones do.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if len(texts) and pc.max(pc.binary_length(texts)).as_py() > SLICE:
            cut = [slices(t.as_py()) for t in texts]
            ids, counts = self.short(pa.array([s for own in cut for s in own], pa.large_string()))
            return ids, np.add.reduceat(counts, np.cumsum([0, *map(len, cut)])[:-1])
        return self.short(texts)

    def short(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD)
        odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = cut_units(pc.if_else(odd, "", texts), self.keep_space)
        units = pc.dictionary_encode(cut.flatten())
        ids = self.units(units.dictionary)
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(counts) - counts
        values = np.frombuffer(b"".join(ids), np.uint32)
        index = units.indices.to_numpy(zero_copy_only=False)
        out = gather(values, starts, counts, index)
        upto = np.concatenate([[0], np.cumsum(counts[index])])
        lengths = np.diff(upto[cut.offsets.to_numpy() - cut.offsets[0].as_py()])
        if len(odd_at):
            own = {int(i): np.array(self.whole(texts[int(i)].as_py()), np.uint32) for i in odd_at}
            pieces, at = [], 0
            for i, n in enumerate(lengths):
                pieces.append(own[i] if i in own else out[at : at + n])
                at += n
            out, lengths = np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)
        return out, lengths


def slices(text: str) -> list[str]:
    """A text cut before single blanks between letters, about SLICE characters each; one with a special string stays whole."""
    if len(text) <= SLICE or "<|" in text:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + SLICE
        m = BLANK.search(text, end) if end < len(text) else None
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


_encoders: dict[tuple, UnitEncoder] = {}


def encoder(name: str, path: str | None = None) -> UnitEncoder:
    """One encoder in each worker process; ``path`` None: the public file of that name."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    word = name.startswith("word")
    if (path, word) not in _encoders:
        _encoders[path, word] = UnitEncoder(path, keep_space=not word, lower=word)
    return _encoders[path, word]
