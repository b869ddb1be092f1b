"""Cutting texts into pieces that byte-level BPE can encode one by one.

A pre-token of the public pattern never crosses the place before a space that a visible character follows: the space
joins that character's run, and white space before it ends there. So a text whose spaces are all followed by visible
characters may be cut at its spaces, which is many times faster than running the pattern, and the pattern or the
encoder need run once for each distinct piece only. Other texts (doubled or trailing spaces, a space before a line end)
are cut by the pattern itself.
"""

from __future__ import annotations

import itertools
import re

import numpy as np

ODD_SPACE = re.compile(r" (?=\s|\Z)")


def may_cut(text: str) -> bool:
    """Whether cutting the text at its spaces is exact."""
    return not ODD_SPACE.search(text)


def cut(text: str) -> list[str] | None:
    """The text between its spaces, or nothing where that would not be exact."""
    return text.split(" ") if may_cut(text) else None


class Numbered(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def numbered_words(texts: list[str], number: Numbered) -> tuple[np.ndarray, np.ndarray]:
    """The number of each piece between the texts' spaces, in text order, and the texts' bounds."""
    ends = np.cumsum([text.count(" ") + 1 for text in texts], dtype=np.int64)
    codes = itertools.chain.from_iterable(map(number.__getitem__, text.split(" ")) for text in texts)
    return np.fromiter(codes, np.int32, int(ends[-1]) if len(ends) else 0), np.append(np.int64(0), ends)


def split_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces between the texts' spaces, the number of each piece in text order, and the texts' bounds."""
    number = Numbered()
    codes, offsets = numbered_words(texts, number)
    return list(number), codes, offsets


class KnownPieces:
    """Numbers of pieces, known by a hash of 128 bits, in an open table: 16 bytes and two to four slots of 4 a piece."""

    def __init__(self):
        self.keys = np.zeros((1024, 2), np.uint64)  # by number
        self.slots = np.full(4096, -1, np.int32)
        self.count = self.placed = 0

    def numbers(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of distinct pieces, and which of them are new; new ones are numbered on in their order."""
        import xxhash

        raw = b"".join(map(xxhash.xxh3_128_digest, pieces))
        keys = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        out = self._found(keys)
        new = np.flatnonzero(out < 0)
        out[new] = self.added(len(new))
        self.keys[out[new]] = keys[new]
        if 2 * (self.placed + len(new)) > len(self.slots):
            held = self.slots[self.slots >= 0]
            size = len(self.slots)
            while 2 * (self.placed + len(new)) > size:
                size *= 2
            self.slots = np.full(size, -1, np.int32)
            self._place(held)
        self._place(out[new])
        self.placed += len(new)
        return out, new

    def added(self, n: int) -> np.ndarray:
        """Numbers for ``n`` pieces more, which need not be known again."""
        self.count += n
        if self.count > len(self.keys):
            room = np.zeros((max(self.count, len(self.keys) * 3 // 2), 2), np.uint64)
            room[:len(self.keys)] = self.keys
            self.keys = room
        return np.arange(self.count - n, self.count)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys[:, 0] & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for those not known: the slots from each key's first one on, up to an empty one."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            here = self.slots[at]
            same = (self.keys[here] == keys[left]).all(1) & (here >= 0)
            out[left[same]] = here[same]
            on = (here >= 0) & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def _place(self, numbers: np.ndarray) -> None:
        """Put numbers of keys not in the table into the next empty slots."""
        at = self._first(self.keys[numbers])
        while len(numbers):
            free = self.slots[at] < 0
            self.slots[at[free]] = numbers[free]  # of several for one slot, the last stays
            on = self.slots[at] != numbers
            numbers, at = numbers[on], (at[on] + 1) & (len(self.slots) - 1)


def gather(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[c]:starts[c] + sizes[c]]`` of all codes, one after the other."""
    return runs(starts[codes], sizes[codes], values)


def runs(starts: np.ndarray, n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values[s:s + k]`` of all pairs of ``starts`` and ``n``, one after the other."""
    before = np.cumsum(n, dtype=np.int64) - n
    return values[np.repeat(starts - before, n) + np.arange(int(n.sum(dtype=np.int64)))]


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each consecutive run of ``values``; runs may be empty."""
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - counts]
