"""Recompression of word sequences with names that are the same everywhere, and the symbols that stand for windows of words.

A round replaces runs of one symbol by a name made of the symbol and the run's length, then pairs of a left and a right symbol by a
name made of both; a hash of the symbol and the round deals symbols to the left or the right. Names need no table: the same symbols
get the same name in every document and task. What a symbol hangs on is an interval of words: its own and those of the neighbours
that kept it from growing. Wherever the interval's words stand, the symbol stands too. Both bounds grow from symbol to symbol.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Rounds after which symbols are about three words long and hang on about ten.
ROUNDS = 4
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


#: White space is \x20 and \x09 to \x0D, each a byte of its own in UTF-8.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words named at a time, which bounds the 64-bit arrays that there are of each byte.
NAMED_WORDS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTES = np.where(_SPACE, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * _A) | np.uint64(1))


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name, document) of every word of texts that lie side by side in UTF-8, cut at ``offsets`` (from 0 to the end)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    names = np.empty(len(begin), np.uint64)
    for i in range(0, len(begin), NAMED_WORDS):
        b, e = begin[i : i + NAMED_WORDS], end[i : i + NAMED_WORDS]
        place = np.repeat(b, np.append(b[1:], e[-1]) - b)
        powers = np.full(int((e - b).max()) + 1, _C)
        powers[0] = _A
        np.cumprod(powers, out=powers)
        values = _BYTES[data[b[0] : e[-1]]] * powers[np.minimum(np.arange(b[0], e[-1]) - place, len(powers) - 1)]
        names[i : i + NAMED_WORDS] = mix(np.add.reduceat(values, b - b[0]) + (e - b).astype(np.uint64))
    return names, np.searchsorted(offsets, begin, "right") - 1


class Symbols(NamedTuple):
    """Name, words [lo, hi) and words [first, last) that the symbol hangs on; a bound beyond its document hangs on the document's end."""

    name: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _runs(s: Symbols, words: np.ndarray, doc: np.ndarray) -> Symbols:
    n = len(s.name)
    differs = np.ones(n, bool)
    differs[1:] = (s.name[1:] != s.name[:-1]) | (doc[s.lo[1:]] != doc[s.lo[:-1]])
    # where neighbours begin (or end) with the same word, telling them apart takes the whole neighbour
    alike_l = np.zeros(n, bool)
    alike_l[1:] = words[s.hi[1:] - 1] == words[s.hi[:-1] - 1]
    alike_r = np.zeros(n, bool)
    alike_r[:-1] = words[s.lo[:-1]] == words[s.lo[1:]]
    first, last = s.first.copy(), s.last.copy()
    first[1:] = np.where(alike_l[1:], s.first[:-1], s.first[1:])
    last[:-1] = np.where(alike_r[:-1], s.last[1:], s.last[:-1])
    begin = np.flatnonzero(differs)
    end = np.append(begin[1:], n) - 1
    long = (end - begin + 1).astype(np.uint64)
    name = np.where(long > 1, mix(s.name[begin] * _A + mix(long + _B)), s.name[begin])
    return Symbols(name, s.lo[begin], s.hi[end], first[begin], last[end])


def _pairs(s: Symbols, doc: np.ndarray, turn: int) -> Symbols:
    left = (mix(s.name + np.uint64((turn + 1) * int(_A) % 2**64)) & np.uint64(1)).astype(bool)
    same = doc[s.lo[1:]] == doc[s.lo[:-1]]
    first, last = s.first.copy(), s.last.copy()
    last[:-1] = np.where(left[:-1] & same, s.last[1:], s.last[:-1])
    first[1:] = np.where(~left[1:] & same, s.first[:-1], s.first[1:])
    joins = np.zeros(len(s.name), bool)  # with the next
    joins[:-1] = left[:-1] & ~left[1:] & same
    begin = np.ones(len(s.name), bool)
    begin[1:] = ~joins[:-1]
    begin = np.flatnonzero(begin)
    end = begin + joins[begin]
    name = np.where(joins[begin], mix(mix(s.name[begin] + _C) * _A + s.name[end]), s.name[begin])
    return Symbols(name, s.lo[begin], s.hi[end], first[begin], last[end])


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> Symbols:
    """Symbols of documents side by side: ``words`` are 64-bit names, ``doc`` numbers the document of each word, ascending."""
    at = np.arange(len(words))
    s = Symbols(words, at, at + 1, at - 1, at + 2)
    for turn in range(rounds if len(words) else 0):
        s = _pairs(_runs(s, words, doc), doc, turn)
    return s


def anchors(s: Symbols, starts: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` words from a start the symbol that stands for it, -1 for none.

    It is the longest of those that hang on the window's words alone, then that of the greatest hash, then the first. Equal windows
    have equal symbols at equal places, so the choice hangs on the window's words too.
    """
    low = np.searchsorted(s.first, starts, "left")
    high = np.searchsorted(s.last, starts + n, "right")
    rank = (np.minimum(s.hi - s.lo, 15).astype(np.uint64) << np.uint64(60)) | (mix(s.name + _B) >> np.uint64(4))
    best = np.where(high > low, low, -1)
    top = rank[np.minimum(low, len(rank) - 1)] if len(rank) else np.zeros(0, np.uint64)
    for step in range(1, int((high - low).max(initial=0))):
        at = low + step
        more = np.flatnonzero(at < high)
        more = more[rank[at[more]] > top[more]]
        best[more], top[more] = at[more], rank[at[more]]
    return best


def hung_names(words: np.ndarray, s: Symbols) -> np.ndarray:
    """Names of all words that each symbol hangs on: more than its own, so fewer symbols of one name stand where nothing is repeated."""
    powers, back = (np.cumprod(np.append(np.uint64(1), np.full(len(words), p, np.uint64))) for p in (_A, np.uint64(pow(int(_A), -1, 2**64))))
    sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1]))
    first, last = np.clip(s.first, 0, len(words)), np.clip(s.last, 0, len(words))
    return mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64))


def window_names(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits naming the ``n`` words from each start: 64 and 32."""
    a = np.zeros(len(starts), np.uint64)
    b = np.zeros(len(starts), np.uint64)
    for k in range(n):
        w = words[starts + k]
        a = a * _A + w
        a ^= a >> np.uint64(29)
        b = (b ^ w) * _C
        b ^= b >> np.uint64(32)
    return mix(a), mix(b) >> np.uint64(32)
