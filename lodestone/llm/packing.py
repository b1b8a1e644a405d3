"""Order-preserving packing of documents into sequences of bounded length.

Documents keep the order of their partition. A run of them is cut into windows of
at most 2,048 tokens by dynamic programming over allowed cuts: ends of documents,
ends of sentences, and, at a higher penalty, places inside long sentences. The
cost is padding plus a penalty for each cut inside a document. Padding falls
linearly with the window's length, so the best predecessor is a sliding minimum,
which a monotone queue holds. A sequence whose length is a power of two needs no
padding; the end of a run may be closed by such sequences.

Each partition is packed on its own, in runs of bounded size, so nothing is
shuffled and a lost task is packed again alone.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import byte_slices

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
SLICE_BYTES = 4 << 20
PIECES = (
    "start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
)
CACHED_WORDS = 250_000
#: Letters that normalisation only lower-cases. A word of them is one token run, and so is a mark behind it.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = f"^[{LETTERS}]+[.,]?$"


@dataclass(frozen=True)
class PackingRules:
    """Penalties are in tokens of padding."""

    window: int = 2_048
    end_id: int = 1
    sentence_cut: float = 8.0
    other_cut: float = 16.0
    short_sequence: float = 32.0
    other_every: int = 16
    run_tokens: int = 1 << 20


class Lookup(dict):
    """A bounded dictionary that makes what it lacks; it is emptied when it is full."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        made = self[key] = self.make(key)
        return made


def laid_out(pool: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``pool``, whose lengths are ``sizes``, in the given order."""
    length = sizes[order]
    after = np.cumsum(length, dtype=np.int64)
    # A slice holds far fewer than 2**31 ids; one giant text may not.
    kind = np.int32 if not len(after) or after[-1] < 2**31 else np.int64
    begins = np.cumsum(sizes, dtype=np.int64) - sizes
    place = np.repeat((begins[order] - (after - length)).astype(kind), length)
    place += np.arange(len(place), dtype=kind)
    return pool[place]


class WordTokens:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The tokenizer never joins across spaces, so only the different words of a slice
    matter. Plain words are lower-cased letters, perhaps with a mark behind them, and
    either part goes to the tokenizer's model directly; others go through all of it. What
    is known is kept; ids are laid out by array operations. Added tokens such as
    ``<|endoftext|>`` are found as the tokenizer finds them; with ``special_as_text``
    they are read as text like any other.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            if re.search(r"""[.!?]["')\]]*(</w>)?$""", token):
                self.ends_sentence[number] = True
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {
            ord(c): byte_level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100)) if re.match(f"[{LETTERS}]", c)
        }
        self.stems = Lookup(self.stem_ids, cached)
        self.others = Lookup(self.other_ids, cached // 4)

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()

    def stem_ids(self, stem: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(stem if stem.isascii() else stem.translate(self.bytes_of))])

    def other_ids(self, word: str) -> bytes:
        return self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def different(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words in a row, and the number of ids of each."""
        plain = pc.match_substring_regex(words, PLAIN)
        stems = pc.utf8_lower(pc.utf8_rtrim(words.filter(plain), characters=".,")).dictionary_encode()
        made = [self.stems[s] for s in stems.dictionary.to_pylist()]
        known = len(made)
        made += [self.others[w] for w in words.filter(pc.invert(plain)).to_pylist()]
        marks = len(made)
        made += [b"", self.stems["."], self.stems[","]]
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // 4
        pool = np.frombuffer(b"".join(made), "<u4")
        is_plain = plain.to_numpy(zero_copy_only=False)
        parts = np.full((len(words), 2), marks, np.int32)
        parts[is_plain, 0] = stems.indices.to_numpy(zero_copy_only=False)
        parts[~is_plain, 0] = known + np.arange(marks - known)
        for k, mark in enumerate(".,"):
            ends = pc.ends_with(words, mark).to_numpy(zero_copy_only=False)
            parts[is_plain & ends, 1] = marks + 1 + k
        parts = parts.ravel()
        return laid_out(pool, sizes, parts), sizes[parts].reshape(-1, 2).sum(axis=1)

    def encoded(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each closed by ``end_id``, and the number of ids of each. Null is empty."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), pattern="\n", replacement=" ")
        split = pc.split_pattern(spaced, pattern=" ")
        coded = split.flatten().dictionary_encode()
        pool, sizes = self.different(coded.dictionary)
        pool, sizes = np.append(pool, np.uint32(end_id)), np.append(sizes, 1)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(sizes) - 1)
        totals = np.cumsum(sizes[order], dtype=np.int64)[ends + np.arange(len(ends))]
        return laid_out(pool, sizes, order), np.diff(totals, prepend=0)


def allowed_cuts(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, rules: PackingRules):
    """Positions where a window may end, in order, and what each costs. The last is the end of the run."""
    total = len(ids)
    sentence = np.flatnonzero(ends_sentence[ids]) + 1
    places = np.concatenate([[0], doc_ends, sentence])
    costs = np.concatenate([np.zeros(1 + len(doc_ends)), np.full(len(sentence), rules.sentence_cut)])
    at = np.unique(places)
    gaps = np.diff(at)
    steps = np.maximum(gaps - 1, 0) // rules.other_every
    before = np.cumsum(steps) - steps
    step = np.arange(steps.sum()) - np.repeat(before, steps) + 1
    inside = np.repeat(at[:-1], steps) + rules.other_every * step
    # The end of the run can be closed by sequences whose lengths are powers of two.
    rest, place, closing = total % rules.window, total, []
    for power in range(rules.window.bit_length() - 1):
        if rest >> power & 1:
            place -= 1 << power
            closing.append(place)
    others = np.concatenate([inside, np.array([p for p in closing if p > 0], np.int64)])
    places = np.concatenate([places, others])
    costs = np.concatenate([costs, np.full(len(others), rules.other_cut)])
    # The cheapest reason for each place.
    order = np.lexsort((costs, places))
    places, costs = places[order], costs[order]
    first = np.append(True, places[1:] != places[:-1])
    return places[first], costs[first]


def best_windows(cuts: np.ndarray, penalties: np.ndarray, rules: PackingRules) -> np.ndarray:
    """Positions of the cuts of the cheapest windows, from 0 to the end of the run."""
    places, extra = cuts.tolist(), penalties.tolist()
    window, total = rules.window, places[-1]
    best = [0.0] * len(places)
    before = [0] * len(places)
    queue: deque[int] = deque()  # predecessors by growing best + place
    reach: deque[float] = deque()
    index = {p: i for i, p in enumerate(places) if p >= total - 2 * window}
    for j in range(1, len(places)):
        value = best[j - 1] + places[j - 1]
        while reach and reach[-1] >= value:
            reach.pop()
            queue.pop()
        queue.append(j - 1)
        reach.append(value)
        least = places[j] - window
        while places[queue[0]] < least:
            queue.popleft()
            reach.popleft()
        cost, source = reach[0] - least, queue[0]
        if least + 2 * window > total:
            for power in range(window.bit_length() - 1):
                i = index.get(places[j] - (1 << power))
                if i is not None and best[i] + rules.short_sequence < cost:
                    cost, source = best[i] + rules.short_sequence, i
        best[j], before[j] = cost + extra[j], source
    at, taken = len(places) - 1, []
    while at:
        taken.append(places[at])
        at = before[at]
    return np.array([0, *reversed(taken)], np.int64)


def packed_run(lengths: np.ndarray, ids: np.ndarray, ends_sentence: np.ndarray, rules: PackingRules):
    """Piece columns of one run: document index, start, length, sequence (from 0), offset; piece bounds; sequences."""
    ends = np.cumsum(lengths)
    windows = best_windows(*allowed_cuts(ids, ends, ends_sentence, rules), rules)
    bounds = np.union1d(windows, np.append(0, ends))
    begin = bounds[:-1]
    doc = np.searchsorted(ends, begin, side="right")
    sequence = np.searchsorted(windows, begin, side="right") - 1
    start = begin - (ends - lengths)[doc]
    return doc, start, np.diff(bounds), sequence, begin - windows[sequence], bounds, len(windows) - 1


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str | None = None) -> WordTokens:
    """The tokenizer of a path, or the installed one, unmodified; made once in each worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def _packer(path: str | None, rules: PackingRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        first = TaskContext.get().partitionId() << 40
        names: list[pa.Array] = []
        counts: list[np.ndarray] = []
        parts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal first
            lengths, ids = np.concatenate(counts), np.concatenate(parts).astype("<u4", copy=False)
            doc, start, length, sequence, offset, bounds, used = packed_run(lengths, ids, tokens.ends_sentence, rules)
            wide = 4 * len(ids) > 2**31 - 1
            binary = pa.large_binary() if wide else pa.binary()
            ends = pa.py_buffer((bounds * 4).astype(np.int64 if wide else np.int32))
            pieces = pa.Array.from_buffers(binary, len(doc), [None, ends, pa.py_buffer(ids)])
            named = pa.concat_arrays(names).take(pa.array(doc))
            numbers = map(pa.array, (start, length, lengths[doc], sequence + first, offset))
            first += used
            for held in (names, counts, parts):
                held.clear()
            return pa.RecordBatch.from_arrays([named, *numbers, pieces], names=COLUMNS)

        for batch in batches:
            for piece in byte_slices(batch, 1, SLICE_BYTES):
                ids, lengths = tokens.encoded(piece.column(1), rules.end_id)
                names.append(piece.column(0))
                counts.append(lengths)
                parts.append(ids)
                if sum(map(len, parts)) >= rules.run_tokens:
                    yield flush()
            pa.default_memory_pool().release_unused()
        if parts:
            yield flush()

    return run


def packed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_path: str | None = None,
    rules: PackingRules | None = None,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    Every id of every document, and the end id behind it, lies in exactly one
    piece. Null and empty texts are one end id. Repeated rows are packed as often
    as they occur; null ids are kept; other columns are ignored. An empty table
    gives no rows. ``tokenizer_path`` must exist on every executor; without it
    the installed public tokenizer is used.
    """
    rules = rules or PackingRules()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(
        _packer(tokenizer_path, rules), f"doc_id {kind}, {PIECES}"
    )
