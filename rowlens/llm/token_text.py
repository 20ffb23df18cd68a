"""Exact tokenizer output at word speed.

Byte-pair tokenizers cut a text into pre-tokens and encode each one alone, so
a text may be cut beforehand wherever a pre-token must end anyway. Natural
text repeats its words, so most pieces have been encoded before; a bounded
per-worker table answers those and the library encodes the rest in batches.

Two tokenizer files are served, each with its own rule for safe cuts:

* byte-level BPE: a single space or line feed between two characters that are
  no white space. A space joins the word after it, a lone line feed is a
  pre-token of its own. White space in longer runs stays inside its piece.
* word BPE: white space is dropped by the pre-tokenizer, so any run of ASCII
  white space separates. Letters in the Latin blocks below U+0180 have no
  combining forms and are lower-cased one to one (but for U+0130), so such
  texts are folded first.

In both, one full stop or comma after an ASCII letter at the end of a piece is
a pre-token of its own.
"""

from __future__ import annotations

import os
import re

import numpy as np

_LONE = re.compile(r"(?<=\S)([ \n])(?=\S)")
_ODD = re.compile(r"[^\S \n]")
#: Where any script may be cut: at a single space, or between a letter and a mark that ends a clause.
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=[^\W\d_\u0130])(?=[.,;:!?\u061b\u061f\u060c\u0964\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
_BLANKS = re.compile(r"[ \t\n\r]+")
_OTHER = re.compile(r"[^\x00-\x7f]|[\t\r\x0b\x0c\x1c-\x1f]")
_ENDS = {".", ","}
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Entries that a worker's table keeps.
TABLE_ENTRIES = 600_000
#: Characters of unseen pieces that go to the library in one call.
CALL_CHARS = 1 << 16

_loaded: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, once in each Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _stem(w: str) -> str:
    """The word without one closing full stop or comma that stands alone."""
    return w[:-1] if len(w) > 1 and w[-1] in _ENDS and w[-2] in _LETTERS else w


class _Table(dict):
    """piece -> what the library gives for it.

    Entries stay up to TABLE_ENTRIES; beyond, those of one call go after it.
    Pieces of letters alone go to the library joined, since their tokens show
    where each piece begins (a space mark) or ends (an end-of-word mark); the
    others go one by one.
    """

    def __init__(self, path: str, dtype=None):
        super().__init__()
        self.path, self.dtype, self.marks = path, dtype, None
        self.hits = self.asked = 0

    def of_ids(self, ids):
        return len(ids) if self.dtype is None else np.array(ids, self.dtype).tobytes()

    def marked(self):
        if self.marks is None:
            vocab = load(self.path).get_vocab()
            self.marks = np.zeros(max(vocab.values()) + 1, bool)
            for token, i in vocab.items():
                self.marks[i] = token.startswith("\u0120") if self.dtype is None else token.endswith("</w>")
        return self.marks

    def joined(self, pieces: list[str]) -> bool:
        """Learn pieces of letters by one call; False if they can't be told apart."""
        by_start = self.dtype is None
        ids = np.array(load(self.path).encode(("" if by_start else " ").join(pieces), add_special_tokens=False).ids, np.int64)
        at = np.flatnonzero(self.marked()[ids])
        if len(at) != len(pieces):
            return False
        if not by_start and ids.max() > np.iinfo(self.dtype).max:
            raise OverflowError(f"token id {ids.max()} is too large for {self.dtype}")
        if by_start:
            self.update(zip(pieces, np.diff(at, append=len(ids)).tolist(), strict=True))
        else:
            raw, wide = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
            ends = ((at + 1) * wide).tolist()
            self.update(zip(pieces, map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        return True

    def learn(self, pieces) -> None:
        one, runs, run, chars = [], [], [], 0
        for p in pieces:
            if p in self:
                continue
            word = p[1:] if self.dtype is None and p[0] == " " else p
            if word.isalpha() and max(word) < "\u0180" and (self.dtype is not None or p is not word):
                run.append(p)
                chars += len(p)
                if chars >= CALL_CHARS:
                    runs.append(run)
                    run, chars = [], 0
            else:
                one.append(p)
        for run in [*runs, run] if run else runs:
            if not self.joined(run):
                one.extend(run)
        t = load(self.path)
        for i in range(0, len(one), 1000):
            part = one[i : i + 1000]
            for q, e in zip(part, t.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self[q] = self.of_ids(e.ids)

    def look_up(self, cut: list[list[str]], add) -> list:
        """add(values of the pieces) for each list of pieces."""
        asked = set().union(*cut)
        new = {p for p in asked if p not in self}
        self.hits, self.asked = self.hits + len(asked) - len(new), self.asked + len(asked)
        if len(self) > TABLE_ENTRIES // 2 and self.asked > TABLE_ENTRIES and self.hits < self.asked // 4:
            self.clear()  # the texts have changed
            self.hits = self.asked = 0
            new = asked
        stems = {w: _stem(w) for w in new}
        was = len(self)
        self.learn({*stems.values(), *_ENDS})
        for w, s in stems.items():
            if w != s:
                self[w] = self[s] + self[w[-1]]
        out = [add(map(self.__getitem__, pieces)) for pieces in cut]
        if len(self) > TABLE_ENTRIES:
            for w in [*self][max(was, TABLE_ENTRIES // 2) :]:
                del self[w]
        return out


_tables: dict = {}


def _table(path: str, dtype=None) -> _Table:
    key = path, dtype and np.dtype(dtype).str
    if key not in _tables:
        _tables[key] = _Table(path, dtype)
    return _tables[key]


def _lone_gaps(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters."""
    if not text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return text[0] not in " \n" and text[-1] not in " \n" and not _ODD.search(text)


def byte_pieces(text: str) -> list[str]:
    """Pieces of a text for byte-level BPE; joined they are the text."""
    if _lone_gaps(text):
        out = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                out.append("\n")
            out.append(first)
            out.extend([" " + w for w in rest])
        return out
    parts = _LONE.split(text)
    out = [parts[0]]
    for gap, piece in zip(parts[1::2], parts[2::2], strict=True):
        out.extend((" " + piece,) if gap == " " else ("\n", piece))
    return out


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Numbers of tokens of texts under a byte-level BPE file."""
    return _table(path).look_up([byte_pieces(t) if t else [] for t in texts], sum)


def word_pieces(text: str) -> list[str]:
    """Pieces of a text for word BPE; what lies between them is dropped."""
    if "<|" not in text and _PLAIN.fullmatch(text):
        return text.lower().split()
    return [w for w in _BLANKS.split(text) if w]


def encode_ids(texts: list[str], path: str, dtype) -> list[bytes]:
    """Token ids of texts under a word BPE file, as little-endian bytes."""
    return _table(path, dtype).look_up([word_pieces(t) if t else [] for t in texts], b"".join)


def slabs(sizes: list[int], most: int):
    """Runs of rows of about `most` bytes each: (first, end)."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def segments(text: str, most: int):
    """A long text in parts of about `most` characters; shorter texts whole.

    Cuts are where a pre-token ends for every tokenizer here: before a single
    space between other characters, and between a letter of any script and a
    full stop, comma or the like after it (but U+0130, which ends in a combining
    mark in lower case). A part goes on where there is none:
    a longer run of letters is one pre-token and can't be cut exactly.
    """
    if len(text) <= most:
        yield text
        return
    start, n = 0, len(text)
    while n - start > most:
        m = _CUT.search(text, start + most)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]
