"""A backtracking encoder for byte-level BPE vocabularies.

Theorem used: a sequence of tokens is the BPE encoding of its bytes exactly if each two neighbours,
encoded alone, stay those two tokens.  So a piece is encoded from left to right with the longest
token that matches (found by one Aho-Corasick scan) and is compatible with the token before it;
where none fits, the last token is taken back for the next shorter one.  Positions that failed are
marked, so each is left at most once and the work stays linear.  Ids decode by one table of bytes
with offsets.
"""

from __future__ import annotations

import base64
import itertools
import os
import re

import numpy as np
import regex

TOKENIZERS = os.environ.get("CORPUSMILL_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how the vocabulary's public definition splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 1 << 20
CACHE_CHARS = 64


class Encoder:
    """Exact encoder and decoder of a ``.tiktoken`` file of ranks (ids are the ranks)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import ahocorasick

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.auto = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.auto.add_word(token.decode("latin-1"), (len(token), i))
        self.auto.make_automaton()
        self.fits: dict[int, bool] = {}
        self.pieces = _Cache(lambda p: self.piece(p.encode()))
        self.bare = _Cache(lambda c: self._lines(c, self.bare) if "\n" in c else self.chunk(c))
        self.spaced = _Cache(lambda c: self._lines(c, self.spaced) if "\n" in c else self.chunk(" " + c))
        size = max(self.bytes_of) + 1
        self.offsets = np.zeros(size + 1, np.int64)
        self.offsets[1:] = np.cumsum([len(self.bytes_of.get(i, b"")) for i in range(size)])
        self.blob = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)

    # -- pairs ---------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition, for the short strings of a pair: merge the lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((self.ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(itertools.pairwise(parts))))
            if best == 1 << 62:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together."""
        key = left << 32 | right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) > 1 << 21:
                self.fits.clear()
            got = self.fits[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    # -- pieces --------------------------------------------------------------------------------

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece of the pre-split."""
        whole = self.ranks.get(data)
        if whole is not None and len(data) < 2:
            return [whole]
        n = len(data)
        at_start: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for last, hit in self.auto.iter(data.decode("latin-1")):
            at_start[last - hit[0] + 1].append(hit)  # in order of length
        failed = bytearray(n + 1)
        tokens: list[int] = []
        choice: list[int] = []  # of each token, how many shorter ones are left at its start
        at, left = 0, len(at_start[0])
        while at < n:
            before = tokens[-1] if tokens else -1
            while left:
                left -= 1
                length, token = at_start[at][left]
                if not failed[at + length] and (before < 0 or self.compatible(before, token)):
                    tokens.append(token), choice.append(left)
                    at += length
                    left = len(at_start[at]) if at < n else 0
                    break
            else:
                # No token fits here after the one before: give that one back.
                failed[at] = 1
                at -= len(self.bytes_of[tokens.pop()])
                left = choice.pop()
        return tokens

    def _lines(self, chunk: str, first: _Cache) -> list[int]:
        """A chunk with line ends inside: of each run of them the last is a piece, the others are one."""
        head, *rest = chunk.split("\n")
        out, run = list(first[head]), 0
        for line in rest:
            run += 1
            if line:
                if run > 1:
                    out.extend(self.pieces["\n" * (run - 1)])
                out.extend(self.pieces["\n"])
                out.extend(self.bare[line])
                run = 0
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.split.findall(text):
            out.extend(self.pieces[p])
        return tuple(out)

    # -- texts ---------------------------------------------------------------------------------

    def _parts(self, text: str):
        """The ids of the text in runs.

        A single space, or a run of line ends, between characters that are not white space always
        begins a piece, so a text with no other white space is cut there and the chunks, most of
        which recur, are looked up.  Any other text is split by the pattern itself.
        """
        if "  " in text or "\n " in text or " \n" in text or text[0].isspace() or text[-1].isspace() or _RARE.search(text):
            return map(self.pieces.__getitem__, self.split.findall(text))
        first, *rest = text.split(" ")
        return itertools.chain((self.bare[first],), map(self.spaced.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts give no ids."""
        return list(itertools.chain.from_iterable(self._parts(text))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self._parts(text))) if text else 0

    def decode(self, ids) -> str:
        if not len(ids):
            return ""
        ids = np.asarray(ids, np.int64)
        start, length = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) - np.repeat(ends - length, length) + np.repeat(start, length)
        return self.blob[index].tobytes().decode("utf-8", "replace")


#: White space other than spaces and line feeds.
_RARE = re.compile(r"[^\S \n]")


class _Cache(dict):
    """Ids by string, computed when first asked for; long strings are not kept, a full cache is emptied."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str):
        got = self.make(text)
        if len(text) <= CACHE_CHARS and "\n" not in text:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[text] = got
        return got


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once a worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
