"""Locally consistent parsing of token sequences by recompression, as numpy passes over many texts at once.

A round names every maximal run of one symbol, then names every pair of a left symbol and a right symbol that stand side by side; one bit
of a symbol's name says which it is. Names are 64-bit hashes of what they stand for, so that equal runs and pairs get equal names in every
task without any exchange. What a symbol depends on is kept with it: a symbol whose dependence lies inside a window of words is there,
under that name, wherever the window's words are.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(0xBF58476D1CE4E5B9)
_TWO = np.uint64(0x94D049BB133111EB)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, window: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """A hash of each `window` consecutive words, document ends not heeded; shorter than words by window - 1."""
    n = max(0, len(words) - window + 1)
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out = out * odd + words[k : k + n]
    return mix(out)


def _neighbours(low: np.ndarray, high: np.ndarray, same: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where what each symbol depends on begins and ends if its left, or its right, neighbour counts; beyond the text at its ends."""
    left = np.r_[starts[:1] - 1, np.where(same, low[:-1], starts[1:] - 1)]
    right = np.r_[np.where(same, high[1:], ends[:-1] + 1), ends[-1:] + 1]
    return left, right


def parse(words: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, rounds: int) -> tuple[np.ndarray, ...]:
    """name, first word, last word + 1, where dependence begins and ends, text of each symbol after `rounds` rounds."""
    doc = np.repeat(np.arange(len(doc_starts)), doc_ends - doc_starts)
    name, lo = words, np.arange(len(words))
    hi = lo + 1
    dl, dr = lo, hi
    for turn in range(rounds):
        if not len(name):
            break
        # runs
        same = doc[1:] == doc[:-1]
        left, right = _neighbours(dl, dr, same, doc_starts[doc], doc_ends[doc])
        first = np.r_[True, ~(same & (name[1:] == name[:-1]))]
        at = np.flatnonzero(first)
        last = np.r_[at[1:], len(name)] - 1
        length = (last - at + 1).astype(np.uint64)
        name = np.where(length > 1, mix(name[at] + length * _ODD), name[at])
        lo, hi, dl, dr, doc = lo[at], hi[last], left[at], right[last], doc[at]
        # pairs
        same = doc[1:] == doc[:-1]
        left, right = _neighbours(dl, dr, same, doc_starts[doc], doc_ends[doc])
        is_right = (mix(name + np.uint64((turn + 1) * int(_ODD) % (1 << 64))) & np.uint64(1)).astype(bool)
        pair = np.r_[same & ~is_right[:-1] & is_right[1:], False]
        keep = np.flatnonzero(~np.r_[False, pair[:-1]])
        paired, follow = pair[keep], np.minimum(keep + 1, len(name) - 1)
        dl = np.where(paired | ~is_right[keep], dl[keep], left[keep])
        dr = np.where(paired, dr[follow], np.where(is_right[keep], dr[keep], right[keep]))
        hi = np.where(paired, hi[follow], hi[keep])
        name = np.where(paired, mix(mix(name[keep]) * _ODD + name[follow]), name[keep])
        lo, doc = lo[keep], doc[keep]
    return name, lo, hi, dl, dr, doc


def anchors(words: np.ndarray, doc_starts: np.ndarray, doc_ends: np.ndarray, window: int, rounds: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(window's first word, anchor) for each window of `window` words inside a text.

    Runs of symbols that cover `reach` words or more are the candidates; a window's anchor is the candidate of least name among those that
    depend on nothing outside it, and its own hash where there is none. Equal windows have equal anchors.
    """
    counts = np.maximum(doc_ends - doc_starts - window + 1, 0)
    first = np.repeat(doc_starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    if not len(first):
        return first, np.zeros(0, np.uint64)
    name, lo, hi, dl, dr, doc = parse(words, doc_starts, doc_ends, rounds)
    last = np.minimum(np.searchsorted(hi, lo + reach), len(name) - 1)
    whole = (doc[last] == doc) & (hi[last] - lo >= reach)
    span, block = last - np.arange(len(name)), np.zeros(len(name), np.uint64)
    inside = np.flatnonzero(whole)
    for k in range(int(span.max()) + 1):
        inside = inside[span[inside] >= k]
        block[inside] = block[inside] * _ODD + name[inside + k]
    block = mix(block + (hi[last] - lo).astype(np.uint64) * _TWO)
    block = np.where(whole, block, _NONE)
    right = np.where(whole, dr[last], doc_ends[doc] + 1)
    a = np.searchsorted(dl, first)
    b = np.searchsorted(right, first + window, side="right") - 1
    best = np.full(len(first), _NONE)
    for k in range(int(np.maximum(b - a, -1).max()) + 1):
        best = np.where(a + k <= b, np.minimum(best, block[np.minimum(a + k, len(block) - 1)]), best)
    alone = best == _NONE
    if alone.any():
        best[alone] = mix(window_hashes(words, window)[first[alone]] + _TWO)
    return first, best
