"""Suffix arrays of many short texts at once by induced sorting, and permuted common prefixes.

The texts are lanes of one matrix and advance in step: each round of a scan moves one
rank of every lane, so the sequential method runs as array operations. The work is
linear in the length of the longest lane times the lanes; callers group lanes of like length.

Symbols are small integers. Each lane ends with one 0, which occurs nowhere else in it.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that follows it (S); the padding counts as S."""
    smaller = np.ones(text.shape, bool)
    less, equal = text[:-1] < text[1:], text[:-1] == text[1:]
    for i in range(len(text) - 2, -1, -1):
        np.logical_and(equal[i], smaller[i + 1], out=smaller[i])
        np.logical_or(less[i], smaller[i], out=smaller[i])
    return smaller


def _induce(ranks: np.ndarray, before: np.ndarray, slots: np.ndarray, step: int) -> None:
    """One scan: every suffix places the one before it in the next slot of that one's bucket.

    ``before`` holds the bucket of the preceding suffix where this scan places it, else -1.
    ``step`` is +1 for larger suffixes from the left, -1 for smaller ones from the right.
    """
    rows, lanes = ranks.shape
    flat, move = ranks.reshape(-1), step * lanes
    for i in range(rows) if step > 0 else range(rows - 1, -1, -1):
        at = ranks[i]
        bucket = before[at]
        chosen = np.flatnonzero(bucket >= 0)
        if len(chosen):
            bucket = bucket[chosen]
            slot = slots[bucket]
            flat[slot] = at[chosen] - lanes
            slots[bucket] = slot + move


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Start positions of each lane's suffixes in order; rows beyond a lane's length are meaningless.

    text: symbols, [position, lane], zero beyond the end. lengths: of each lane, its closing 0 included.
    """
    rows, lanes = text.shape
    lane = np.arange(lanes)
    nowhere = rows * lanes
    smaller = _types(text)
    leftmost = np.zeros(text.shape, bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    leftmost[lengths - 1, lane] = True  # also in a lane of nothing else
    inside = np.arange(rows)[:, None] < lengths
    symbols = int(text.max()) + 1
    bucket = text.astype(np.int64) * lanes + lane
    counts = np.bincount(bucket[inside], minlength=symbols * lanes).reshape(symbols, lanes)
    ends = np.cumsum(counts, axis=0)
    starts = ends - counts
    # Buckets of the suffix before each one, for the scan that places it; the last row stands for empty ranks.
    larger_before = np.full((rows + 1, lanes), -1, np.int64)
    smaller_before = np.full((rows + 1, lanes), -1, np.int64)
    previous = bucket[:-1]
    larger_before[1:rows] = np.where(smaller[:-1], -1, previous)
    smaller_before[1:rows] = np.where(smaller[:-1] & inside[1:], previous, -1)
    larger_before, smaller_before = larger_before.reshape(-1), smaller_before.reshape(-1)
    heads = (starts * lanes + lane).reshape(-1)
    tails = ((ends - 1) * lanes + lane).reshape(-1)

    def induced(places: np.ndarray, positions: np.ndarray) -> np.ndarray:
        ranks = np.full((rows, lanes), nowhere, np.int64)
        ranks.reshape(-1)[places] = positions
        _induce(ranks, larger_before, heads.copy(), 1)
        _induce(ranks, smaller_before, tails.copy(), -1)
        return ranks

    # Leftmost-smaller suffixes in any order at the ends of their buckets sort leftmost-smaller substrings.
    found = np.flatnonzero(leftmost)
    of = bucket.reshape(-1)[found]
    order = np.argsort(of, kind="stable")
    of, found = of[order], found[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    within = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
    ranks = induced(tails[of] - within * lanes, found)
    is_leftmost = np.append(leftmost.reshape(-1), np.zeros(lanes, bool))
    by_rank = ranks.T
    ordered = by_rank[is_leftmost[by_rank]]  # lane after lane, by rank
    owner = ordered % lanes
    many = np.bincount(owner, minlength=lanes)
    base = np.cumsum(many) - many

    names = _names(text, leftmost, ordered, owner, base)
    repeated = names[base + many - 1] < many - 1
    in_text = np.flatnonzero(leftmost.T)  # lane after lane, by position
    in_text = in_text % rows * lanes + in_text // rows
    if repeated.any():
        name_of = np.empty(rows * lanes, np.int64)
        name_of[ordered] = names
        again = np.flatnonzero(repeated)
        part = np.zeros((int(many[again].max()), len(again)), np.int64)
        for column, k in enumerate(again):
            part[: many[k], column] = name_of[in_text[base[k] : base[k] + many[k]]]
        below = suffix_arrays(part, many[again])
        for column, k in enumerate(again):
            ordered[base[k] : base[k] + many[k]] = in_text[base[k] + below[: many[k], column]]
    # In their final order they take the last slots of their buckets, and both scans induce the rest.
    of = bucket.reshape(-1)[ordered]
    held = np.bincount(of, minlength=symbols * lanes).reshape(symbols, lanes)
    less = (np.cumsum(held, axis=0) - held).reshape(-1)
    rank = np.arange(len(ordered)) - base[owner]
    slot = (ends - held).reshape(-1)[of] + rank - less[of]
    return induced(slot * lanes + owner, ordered) // lanes


def _names(text, leftmost, ordered, owner, base) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings, equal for equal ones, counted from 0 in each lane."""
    rows, lanes = text.shape
    following = np.full((rows + 1, lanes), rows, np.int64)
    for i in range(rows - 1, -1, -1):
        following[i] = np.where(leftmost[i], i, following[i + 1])
    at = ordered // lanes
    size = np.minimum(following[np.minimum(at + 1, rows), owner], rows - 1) - at + 1
    new = np.ones(len(ordered), bool)
    pairs = np.flatnonzero((owner[1:] == owner[:-1]) & (size[1:] == size[:-1])) + 1
    flat, offset = text.reshape(-1), 0
    while len(pairs):
        same = flat[ordered[pairs] + offset * lanes] == flat[ordered[pairs - 1] + offset * lanes]
        pairs = pairs[same]
        offset += 1
        done = size[pairs] == offset
        new[pairs[done]] = False
        pairs = pairs[~done]
    number = np.cumsum(new)
    return number - number[base][owner]


def common_prefixes(text: np.ndarray, lengths: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes: of each suffix with the one before it in order, and where that one starts.

    Both are by position, [position, lane]; the least suffix has length 0 and predecessor -1.
    Only positions whose preceding symbols differ are compared; every other one is one less than
    the position before it.
    """
    rows, lanes = text.shape
    row, lane = np.nonzero(np.arange(1, rows)[:, None] < lengths)
    before = np.full((rows, lanes), -1, np.int64)
    before[suffixes[row + 1, lane], lane] = suffixes[row, lane]
    inside = (before >= 0).T.reshape(-1)
    # Lane after lane, with room to read beyond the last one.
    line = np.concatenate([text.T.reshape(-1).astype(np.uint64), np.zeros(4, np.uint64)])
    words = line[:-3] | line[1:-2] << np.uint64(16) | line[2:-1] << np.uint64(32) | line[3:] << np.uint64(48)
    start = np.repeat(np.arange(lanes) * rows, rows)
    here = np.arange(rows * lanes)
    other = np.where(inside, before.T.reshape(-1) + start, 0)
    fresh = inside & ((here == start) | (other == start) | (line[here - 1] != line[other - 1]))
    a = np.flatnonzero(fresh)
    b = other[a]
    stop = (start + np.repeat(lengths, rows))[a]
    length = np.zeros(rows * lanes, np.int64)
    open_ = np.arange(len(a))
    offset = 0
    while len(open_):  # a lane's closing 0 differs from all else in it, so equal words end within the lane
        same = words[a[open_] + offset] == words[b[open_] + offset]
        same &= (a[open_] + offset + 4 <= stop[open_]) & (b[open_] + offset + 4 <= stop[open_])
        ended = open_[~same]
        for step in range(4):
            x, y = a[ended] + offset + step, b[ended] + offset + step
            inner = (x < stop[ended]) & (y < stop[ended])
            inner[inner] = line[x[inner]] == line[y[inner]]
            ended = ended[inner]
            length[a[ended]] += 1
        open_ = open_[same]
        length[a[open_]] += 4
        offset += 4
    last = np.maximum.accumulate(np.where(fresh, here, -1))
    length = np.where(inside & ~fresh, length[last] - (here - last), length)
    return length.reshape(lanes, rows).T, before
