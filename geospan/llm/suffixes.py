"""Suffix arrays by induced sorting, and permuted common prefixes, on byte arrays.

The classical linear scheme, bucket by bucket so that each step is an array
operation: suffixes are classified as larger or smaller than their successor;
the leftmost smaller ones are sorted by inducing from their unsorted order,
named, and sorted among each other as a string of names by the same scheme, which
goes on until all names differ; from their order the whole array is induced. With
few bytes the induction goes bucket by bucket; with many names, of which most
come a few times, it goes by runs of larger or smaller suffixes at once.
"""

from __future__ import annotations

import numpy as np

#: Pairs of places compared at once.
AT_ONCE = 1 << 16


def classify(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the end counts as smallest."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    change = np.flatnonzero(text[1:] != text[:-1])
    rises = text[change + 1] > text[change]
    lengths = np.diff(np.r_[-1, change])
    out[: change[-1] + 1 if len(change) else 0] = np.repeat(rises, lengths)
    return out


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Positions of smaller suffixes that follow a larger one."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _deal(found: list[np.ndarray], text: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their bytes, in order."""
    p = found[0] if len(found) == 1 else np.concatenate(found)
    if not len(p):
        return
    c = text[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(p)].tolist(), strict=True):
        buckets[c[a]].append(p[a:b])


def induce(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array that an order of the leftmost smaller suffixes induces.

    Returns it with a mark at the smaller suffixes.
    """
    none = np.empty(0, starts.dtype)
    joined = lambda parts: none if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts)
    given: list[list[np.ndarray]] = [[] for _ in range(256)]
    _deal([starts], text, given)
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    n = len(text)
    larger[text[n - 1]].append(np.array([n - 1], starts.dtype))
    for c in range(256):
        on, front = [], joined(larger[c])
        while len(front):
            p = front[front > 0] - 1
            b = text[p]
            on.append(p[b > c])
            front = p[b == c]
            if len(front):
                larger[c].append(front)
        if given[c]:
            on.append(joined(given[c]) - 1)
        if on:
            _deal(on, text, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]  # from the largest down
    for c in range(255, -1, -1):
        on, front = [], joined(smaller[c])
        while len(front):
            p = front[front > 0] - 1
            b = text[p]
            on.append(p[b < c])
            front = p[b == c]
            if len(front):
                smaller[c].append(front)
        if larger[c]:
            back = joined(larger[c])[::-1]
            p = back[back > 0] - 1
            on.append(p[text[p] < c])
        if on:
            _deal(on, text, smaller)
    parts, marks = [], []
    for c in range(256):
        for part, mark in ((joined(larger[c]), False), (joined(smaller[c])[::-1], True)):
            if len(part):
                parts.append(part)
                marks.append(np.full(len(part), mark))
    return joined(parts), np.concatenate(marks) if marks else np.empty(0, bool)


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number; zeros follow the end."""
    n = len(text)
    padded = np.zeros(n + 15, np.uint8)
    padded[:n] = text
    out = np.empty((n + 7) // 8 * 8, np.uint64)
    raw = padded.tobytes()
    for i in range(8):
        part = np.frombuffer(raw, "<u8", len(out) // 8 if i == 0 else min(len(out) // 8, (len(raw) - i) // 8), i)
        out[i::8][: len(part)] = part
    return out[:n]


def _same(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from a and from b agree; a part at a time, so that what lies between stays small."""
    if len(a) > AT_ONCE:
        return np.concatenate([_same(words, *(x[at : at + AT_ONCE] for x in (a, b, size))) for at in range(0, len(a), AT_ONCE)])
    out = np.ones(len(a), bool)
    todo, at = np.arange(len(a)), 0
    n = len(words)
    while len(todo):
        left = size[todo] - at
        todo, left = todo[left > 0], left[left > 0]
        if not len(todo):
            break
        x = words[np.minimum(a[todo] + at, n - 1)] ^ words[np.minimum(b[todo] + at, n - 1)]
        short = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        x = np.where(left >= 8, x, x & ((np.uint64(1) << (short % np.uint64(64))) - np.uint64(1)))
        out[todo[x != 0]] = False
        todo = todo[x == 0]
        at += 8
    return out


def _ranked(symbols: np.ndarray, which: np.ndarray, last: np.ndarray, doubling: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The positions ``which`` in the order of their strings, and ranks that only equal strings share.

    A position's string is the symbols from it to ``last``. Ranks by one symbol are
    joined to ranks by two, four and so on, for which ``which`` must hold every
    position of the strings; without ``doubling`` to one symbol after the other.
    Only members of ties are looked at again.
    """
    n, step = len(symbols), 1
    begins = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    differs = lambda x: np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))
    order = which[np.argsort(symbols[which])]
    sorted_key = symbols[order]
    rank = np.full(n, -1)
    rank[order] = begins(differs(sorted_key))
    next_one, most = (rank, n + 1) if doubling else (symbols + 1, int(symbols.max()) + 3)
    at, place = np.arange(len(order)), order
    while True:
        tied = sorted_key[1:] == sorted_key[:-1]
        again = np.flatnonzero(np.concatenate((tied, [False])) | np.concatenate(([False], tied)))
        at, place = at[again], place[again]
        goes_on = place + step <= last[place]
        if not goes_on.any():
            return order, rank
        key = rank[place] * most + np.where(goes_on, next_one[np.minimum(place + step, n - 1)] + 1, 0)
        by_key = np.argsort(key)
        place, sorted_key = place[by_key], key[by_key]
        order[at] = place
        rank[place] = at[begins(differs(sorted_key))]
        step = 2 * step if doubling else step + 1


def _induced(names: np.ndarray, smaller: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a string of names that an order of the leftmost smaller ones induces.

    A larger suffix is its names down to the next leftmost smaller suffix, whose
    place is known, or to the end; a smaller one is its names up to the next larger
    suffix. Of suffixes that begin with the same name the larger ones come first.
    """
    n, every = len(names), np.arange(len(names))
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = is_start[n] = True
    # Larger ones: a symbol for each name, then one for each leftmost smaller suffix behind those of its name; the end before all.
    first = names[starts]
    symbols = np.empty(n + 1, np.int64)
    symbols[:n] = (names + 1) * (n + 2)
    symbols[starts] = (first + 1) * (n + 2) + 1 + np.arange(len(starts))
    symbols[n] = 0
    stops = np.flatnonzero(is_start)
    last = np.empty(n + 1, np.int64)
    last[:n] = stops[np.searchsorted(stops, every)]
    last[n] = n
    order, _ = _ranked(symbols, np.flatnonzero(np.concatenate((~smaller, [True])) | is_start), last)
    larger = order[(order < n) & ~is_start[order]]
    # Smaller ones: the larger suffixes are told apart by their places, and come first.
    symbols = (names + 1) * (2 * n + 2) + n + 1
    symbols[larger] = (names[larger] + 1) * (2 * n + 2) + np.arange(len(larger))
    stops = np.flatnonzero(~smaller)
    order, _ = _ranked(symbols, every, stops[np.searchsorted(stops, every)])
    return order


def sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by the same scheme on numbers: classified, leftmost smaller substrings
    sorted and named, their string of names sorted by this very function, and the rest induced from it."""
    n = len(names)
    order = np.argsort(names)
    if n < 2 or (names[order[1:]] != names[order[:-1]]).all():
        return order
    smaller = classify(names)
    starts = leftmost_smaller(smaller)
    if len(starts) > 1:
        # Substrings reach to the next start, which counts with its name only; the last one to the end, which no other has.
        last = np.append(starts[1:], n)[np.maximum(np.searchsorted(starts, np.arange(n), "right") - 1, 0)]
        last[starts] = np.append(starts[1:], n)
        symbols = np.append(names.astype(np.int64) * 2 + smaller, -1)
        _, rank = _ranked(symbols, starts, np.append(last, n), doubling=False)
        starts = starts[sort_names(np.unique(rank[starts], return_inverse=True)[1].reshape(-1))]
    return _induced(names.astype(np.int64), smaller, starts)


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of bytes."""
    text = np.ascontiguousarray(text, np.uint8)
    n = len(text)
    if n < 2:
        return np.arange(n)
    index = np.int32 if n < 2**31 - 1 else np.int64
    starts = leftmost_smaller(classify(text)).astype(index)
    if len(starts) > 1:
        words = words_at(text) if words is None else words
        rough, mark = induce(text, starts)
        is_start = np.zeros(n, bool)
        is_start[starts] = True
        rough = rough[mark]
        rough = rough[is_start[rough]]
        # Names: leftmost smaller substrings, up to and with the next one's first byte.
        number = np.empty(n, index)
        number[starts] = np.arange(len(starts), dtype=index)
        size = np.empty(len(starts), np.int64)
        size[:-1] = starts[1:] - starts[:-1] + 1
        size[-1] = n - starts[-1] + 1  # with the end of the text, which no other has
        own = size[number[rough]]
        equal = np.concatenate(([False], (own[1:] == own[:-1]) & (number[rough][1:] != len(starts) - 1) & (number[rough][:-1] != len(starts) - 1)))
        at = np.flatnonzero(equal)
        equal[at] = _same(words, rough[at - 1].astype(np.int64), rough[at].astype(np.int64), own[at])
        names = np.empty(len(starts), np.int64)
        names[number[rough]] = np.cumsum(~equal) - 1
        starts = starts[sort_names(names)]
    return induce(text, starts)[0]


def common_with_previous(words: np.ndarray, array: np.ndarray, size: int) -> np.ndarray:
    """By rank: whether ``size`` bytes agree with the suffix before it; ``array`` may leave suffixes out.

    The common prefixes are found in the order of the text (permuted), where
    neighbours in the text look at neighbours in memory.
    """
    n = len(words)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    there = np.flatnonzero(before >= 0)
    there = there[(there + size <= n) & (before[there] + size <= n)]
    same = np.zeros(n, bool)
    same[there] = _same(words, there, before[there], np.full(len(there), size))
    return same[array]
