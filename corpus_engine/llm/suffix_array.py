"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for S suffixes (smaller than the next one); the last is S."""
    n = len(s)
    rising = np.empty(n, dtype=np.int8)
    rising[:-1] = np.sign(s[1:] - s[:-1])
    rising[-1] = 1
    # equal neighbours take the type of the next unequal pair
    last = np.where(rising != 0, np.arange(n), n)
    return rising[np.minimum.accumulate(last[::-1])[::-1]] > 0


def _induce(before_l: list[int], before_s: list[int], s: list[int], counts: np.ndarray, seeds: list[int]) -> list[int]:
    """Sort all suffixes from sorted LMS seeds: L suffixes from the left, S suffixes from the right."""
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    ends = (tails - 1).tolist()
    order = [-1] * len(s)
    at = list(ends)
    for p in reversed(seeds):
        c = s[p]
        order[at[c]] = p
        at[c] -= 1
    # both loops read places that they have filled before
    for p in order:
        c = before_l[p]
        if c >= 0:
            i = heads[c]
            order[i] = p - 1
            heads[c] = i + 1
    for p in reversed(order):
        c = before_s[p]
        if c >= 0:
            i = ends[c]
            order[i] = p - 1
            ends[c] = i - 1
    return order


def _letters_before(s: np.ndarray, is_s: np.ndarray) -> tuple[list[int], list[int]]:
    """The letter before each position if an L (an S) suffix starts at it, else -1; position -1 has none."""
    both = []
    for kind in (~is_s, is_s):
        letters = np.full(len(s) + 1, -1)
        letters[1:-1] = np.where(kind[:-1], s[:-1], -1)
        both.append(letters.tolist())
    return both[0], both[1]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the sorted suffixes of ``s``, non-negative integers that end in a unique smallest one.

    Suffixes are classified, the leftmost-smaller (LMS) substrings are sorted by
    induction and named, the string of names is sorted recursively, and its order
    induces the whole array; all in linear time.
    """
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    counts = np.bincount(s)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    before_l, before_s = _letters_before(s, is_s)
    text = s.tolist()

    order = np.array(_induce(before_l, before_s, text, counts, lms.tolist()))
    rank_of = np.full(n, -1)
    rank_of[lms] = np.arange(len(lms))
    by_substring = order[rank_of[order] >= 0]
    ends = np.append(lms[1:], n - 1)
    size = ends[rank_of[by_substring]] - by_substring + 1
    same = size[1:] == size[:-1]
    alive, d = np.flatnonzero(same), 0
    while len(alive):  # neighbours that agree so far
        a, b = by_substring[alive], by_substring[alive + 1]
        equal = s[a + d] == s[b + d]
        same[alive[~equal]] = False
        d += 1
        alive = alive[equal & (size[alive] > d)]
    names = np.concatenate([[0], np.cumsum(~same)])
    reduced = np.empty(len(lms), dtype=np.int64)
    reduced[rank_of[by_substring]] = names
    if names[-1] + 1 == len(lms):
        sorted_lms = by_substring
    else:
        sorted_lms = lms[suffix_array(reduced)]
    return np.array(_induce(before_l, before_s, text, counts, sorted_lms.tolist()))


def permuted_common_prefixes(s: np.ndarray, order: np.ndarray, step: int = 16) -> np.ndarray:
    """For each position in text order, its common prefix with the suffix sorted just before it.

    Where the letters before the two suffixes are equal, the prefix is that of the
    position before, less one. Only the other prefixes are compared; they are short in
    sum (at most 2 n log n letters).
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    here = np.flatnonzero(before >= 0)
    inner = here[(here > 0) & (before[here] > 0)]
    compared = np.zeros(n, dtype=bool)
    compared[here] = True
    compared[inner[s[inner - 1] == s[before[inner] - 1]]] = False

    start = np.flatnonzero(compared)
    padded = np.concatenate([s, np.full(step, -1, dtype=s.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, step)
    size = np.zeros(n, dtype=np.int64)
    alive, done = start, 0
    while len(alive):
        differ = windows[alive + done] != windows[before[alive] + done]
        ends = differ.any(1)
        size[alive[ends]] = done + differ[ends].argmax(1)
        alive, done = alive[~ends], done + step
    # the smallest suffix has none before it; every other position follows a compared one
    known = np.maximum.accumulate(np.where(compared | (before < 0), np.arange(n), 0))
    return np.where(compared | (before < 0), size, size[known] - (np.arange(n) - known))


def repeated_windows(strings: list[bytes], rank: np.ndarray, length: int) -> list[np.ndarray]:
    """Per string a mask over its windows of ``length`` bytes: True where an equal window ranks earlier.

    ``rank`` holds the rank of every window, string after string; all strings have
    ``length`` bytes at least.
    """
    sizes = np.array([len(x) for x in strings])
    # bytes become 2..257, strings end in 1, the whole in 0
    joined = np.frombuffer(b"\0".join(strings) + b"\0\0", dtype=np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes + 1) - 1
    joined[ends], joined[-1] = 1, 0
    order = suffix_array(joined)
    common = permuted_common_prefixes(joined, order)

    window = np.full(len(joined), -1, dtype=np.int64)
    starts = np.repeat(ends - sizes, sizes - length + 1)
    widths = sizes - length + 1
    offset = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    window[starts + offset] = np.arange(widths.sum())

    whole = window[order] >= 0
    group = np.cumsum(common[order] < length)[whole]
    members = window[order][whole]
    first = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, rank[members])
    repeated = np.zeros(len(members), dtype=bool)
    repeated[members] = rank[members] > first[group]
    return np.split(repeated, np.cumsum(widths)[:-1])
