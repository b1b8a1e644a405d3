import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import suffix_dedup
from lodestone.llm.induced_sorting import common_prefixes, suffix_arrays


def lanes(texts):
    lengths = np.array([len(t) + 1 for t in texts])
    symbols = np.zeros((lengths.max(), len(texts)), np.int64)
    for k, text in enumerate(texts):
        symbols[: len(text), k] = text
    return symbols, lengths


@pytest.mark.parametrize("alphabet", [1, 2, 3, 30])
def test_induced_sorting_and_common_prefixes(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        texts = [[rng.randint(1, alphabet) for _ in range(rng.randint(0, 50))] for _ in range(rng.randint(1, 6))]
        symbols, lengths = lanes(texts)
        order = suffix_arrays(symbols, lengths)
        common, before = common_prefixes(symbols, lengths, order)
        for k, text in enumerate(texts):
            text = [*text, 0]
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert order[: len(text), k].tolist() == want
            for i, j in zip(want[1:], want):
                shared = next(n for n in range(len(text)) if text[i + n] != text[j + n])
                assert (before[i, k], common[i, k]) == (j, shared)


def expected(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for i in range(len(text) - length + 1):
            if seen[text[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if text else b""
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(120), prose(60)
    texts = [None, "", "x" * 399, "x" * 400, "y" * 3000, "ab" * 900, prose(300)]
    texts += [prose(rng.randint(0, 60)) + passage + prose(rng.randint(0, 60)) for _ in range(80)]  # a frequent anchor
    texts += [prose(40) + passage[i : i + 420] + other for i in range(5)]
    texts += [texts[6], texts[6], prose(20_000) + passage]
    near = prose(400).split()
    for i in range(40):
        copy = list(near)
        copy[i * 9] = "changed"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("length", [400, 100])
def test_repeats_match_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 30_000)  # the longest text is read in pieces
    texts = corpus()
    docs = spark.createDataFrame(
        [(i, t, "r", i, 1) for i, t in enumerate(texts)], "id long, `text` string, `rest` string, bytes long, `a.b` int"
    )
    found = suffix_dedup.with_repeats(docs, length=length)
    assert found.columns[:5] == ["id", "text", "rest", "bytes", "a.b"]
    rows = {r["id"]: r for r in found.collect()}
    want = expected([(t or "").encode() for t in texts], length)
    for i, w in enumerate(want):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w, i
        assert (r["text"], r["bytes"], r["a.b"]) == (texts[i], i, 1)
        assert sum(s["end"] - s["begin"] for s in r["removed"]) == r["n_removed"]
    cut = {r["id"]: r["text"] for r in suffix_dedup.without_repeats(docs, length=length).collect()}
    assert cut[0] is None and cut[1] == "" and cut[2] == texts[2] if length == 400 else cut[2] != texts[2]
    for i, w in enumerate(want):
        if w[1] == 0:
            assert cut[i] == texts[i]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.with_repeats(docs).count() == 0
