"""Quality rules: repetition found with suffix arrays.

The words of many documents are sorted at once by prefix doubling; the document
number leads each key, so suffixes of different documents never tie. Adjacent
suffixes give longest common prefixes, their intervals the maximal repeated word
sequences, and the union of the occurrences the words that lie in a repeat.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import struct_column
from lodestone.llm.text import free_name

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionRules:
    """Limits. A repeat is a sequence of at least ``min_repeat`` words found twice in one text.

    ``longest_share`` bounds the longest repeat by a share of the text's words,
    and only where it has more than ``longest_free`` words.
    """

    min_words: int = 10
    min_repeat: int = 5
    covered_percent: int = 20
    longest_free: int = 50
    longest_share: float = 0.10


@dataclass
class Repeats:
    covered: np.ndarray  # words in a repeat, by document
    longest: np.ndarray  # words of the longest repeat
    maximal: np.ndarray  # maximal repeated sequences


def suffix_array(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the sorted width; only the ranks of the last width are held."""
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
    order = np.argsort(key, kind="stable")
    ranks = np.empty(n, np.int32)
    sa, width, part, sorted_key = order, 1, np.arange(n), key[order]
    while True:
        # A rank is the first slot of the group of equal prefixes.
        first = np.ones(len(part), bool)
        first[1:] = sorted_key[1:] != sorted_key[:-1]
        ranks[sa[part]] = np.maximum.accumulate(np.where(first, part, 0))
        alone = first & np.append(first[1:], True)
        part = part[~alone]
        if not len(part):
            return sa
        at = sa[part]
        after = at + width
        inside = after < n
        after[~inside] = 0
        inside &= doc[after] == doc[at]
        second = np.where(inside, ranks[after], -1).astype(np.int64)
        key = ranks[at].astype(np.int64) * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        sa[part], sorted_key = at[order], key[order]
        width *= 2


def _shared_words(words: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b share inside their document: together first, the longest ones by slices."""
    n, shared, open_ = len(words), np.zeros(len(a), np.int64), np.arange(len(a))
    for offset in range(n):
        if len(open_) <= 64 and offset >= 64:
            break
        x, y = a[open_] + offset, b[open_] + offset
        inside = np.maximum(x, y) < n
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        open_ = open_[inside & (words[x] == words[y]) & (doc[x] == doc[y]) & (doc[x] == doc[a[open_]])]
        shared[open_] += 1
        if not len(open_):
            return shared
    for k in open_.tolist():
        x, y, size = int(a[k] + shared[k]), int(b[k] + shared[k]), 1_024
        stop = int(np.searchsorted(doc, doc[a[k]], side="right"))
        while True:
            length = min(size, stop - max(x, y))
            differ = np.flatnonzero(words[x : x + length] != words[y : y + length])
            if len(differ) or length < size:
                shared[k] += int(differ[0]) if len(differ) else max(length, 0)
                break
            shared[k] += length
            x, y, size = x + length, y + length, 2 * size
    return shared


def common_prefixes(sa: np.ndarray, words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose suffix shares at least ``least`` words with the slot before, and how many.

    In the order of the text a prefix is at most one word shorter than the one before it, and exactly
    one shorter where the preceding words agree, so only the others are compared.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    same = doc[sa[1:]] == doc[sa[:-1]]
    before[sa[1:][same]] = sa[:-1][same]
    at = np.arange(n)
    held = before >= 0
    other = np.where(held, before, 0)
    opens = (at == 0) | (doc != doc[at - 1])
    fresh = held & (opens | opens[other] | (words[at - 1] != words[other - 1]))
    start = np.flatnonzero(fresh)
    prefix = np.zeros(n, np.int64)
    prefix[start] = _shared_words(words, doc, start, other[start])
    last = np.maximum.accumulate(np.where(fresh, at, -1))
    prefix = np.where(held & ~fresh, prefix[last] - (at - last), prefix)
    shared = prefix[sa]
    slots = np.flatnonzero(shared >= least)
    return slots, shared[slots]


def maximal_intervals(slots: np.ndarray, shared: np.ndarray, differs: np.ndarray) -> list[tuple[int, int]]:
    """(first slot, words) of each interval of common prefixes that no word before extends.

    ``differs``: running count, by slot, of suffixes preceded by another word than the slot before.
    """
    found = []
    stack: list[tuple[int, int]] = []  # (left slot, words)

    def close(until: int, last: int) -> None:
        while stack and stack[-1][1] > until:
            left, words = stack.pop()
            if differs[last] > differs[left]:
                found.append((left, words))

    before = -2
    for slot, words in zip(slots.tolist(), shared.tolist()):
        if slot != before + 1:
            close(0, before)
            stack.clear()
        left = slot - 1
        while stack and stack[-1][1] > words:
            left = stack[-1][0]
            close(stack[-1][1] - 1, slot - 1)
        if not stack or stack[-1][1] < words:
            stack.append((left, words))
        before = slot
    close(0, before)
    return found


def repeats(words: np.ndarray, lengths: np.ndarray, least: int) -> Repeats:
    """Repeats of at least ``least`` words inside each of the concatenated documents."""
    docs = len(lengths)
    doc = np.repeat(np.arange(docs), lengths)
    out = Repeats(*(np.zeros(docs, np.int64) for _ in range(3)))
    n = len(words)
    if n == 0:
        return out
    sa = suffix_array(words, doc)
    slots, shared = common_prefixes(sa, words, doc, least)
    if not len(slots):
        return out
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, sa[slots], shared)
    np.maximum.at(reach, sa[slots - 1], shared)
    starts = np.flatnonzero(reach)
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + reach[starts], -1)
    out.covered = np.bincount(doc[np.cumsum(delta[:-1]) > 0], minlength=docs)
    np.maximum.at(out.longest, doc[starts], reach[starts])
    before = np.where(sa > 0, words[sa - 1], -1).astype(np.int64)
    opens = (sa == 0) | (doc[sa] != doc[sa - 1])
    before[opens] = -1 - sa[opens]
    differs = np.zeros(n, np.int64)
    differs[1:] = np.cumsum(before[1:] != before[:-1])
    intervals = maximal_intervals(slots, shared, differs)
    if intervals:
        out.maximal = np.bincount(doc[sa[[left for left, _ in intervals]]], minlength=docs)
    return out


def measured(texts: list[bytes], rules: RepetitionRules) -> list:
    split = [t.split() for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(
        map(numbers.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum())
    )
    found = repeats(words, lengths, rules.min_repeat)
    characters = [sum(map(len, map(bytes.decode, w))) if not t.isascii() else sum(map(len, w)) for t, w in zip(texts, split)]
    symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    repeated_lines = []
    for text in texts:
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        repeated_lines.append(len(lines) - len(set(lines)))
    failed = (lengths < rules.min_words) | (100 * found.covered > rules.covered_percent * lengths)
    long = (found.longest > rules.longest_free) & (found.longest > rules.longest_share * lengths)
    return [
        lengths, characters, symbols, repeated_lines, found.covered, found.longest, found.maximal,
        failed, ~(failed | long),
    ]


MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "longest_repeat bigint, n_maximal_repeats bigint, base_failed boolean, kept boolean"
)


def with_repetition(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """Add the measures and the verdict ``kept`` to every row; no shuffle.

    Null and empty texts have no words and fail. Columns named like a measure are
    replaced. A repeated row is judged like the first. Any text length works;
    memory follows the longest text and slices of a few megabytes.
    """
    rules = rules or RepetitionRules()
    measure = struct_column(MEASURES, lambda texts: measured(texts, rules))
    names = [part.split()[0] for part in MEASURES.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    made = free_name(docs, "measured")
    return docs.select(*kept, measure(F.col(text)).alias(made)).select(*kept, *(F.col(made)[n].alias(n) for n in names))


def reject_repetition(docs: DataFrame, text: str = "text", rules: RepetitionRules | None = None) -> DataFrame:
    """The rows that pass, with their own columns."""
    rules = rules or RepetitionRules()
    measure = struct_column(MEASURES, lambda texts: measured(texts, rules))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    made = free_name(docs, "measured")
    return docs.select(*columns, measure(F.col(text)).alias(made)).where(F.col(made)["kept"]).select(*columns)
