"""The operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from lodestone.llm import (
    components,
    decontamination,
    hosts,
    licenses,
    packing,
    repetition,
    secrets,
    sharding,
    simhash,
    token_totals,
    warc,
)
from lodestone.llm.license_rules import GATES, rules
from lodestone.llm.queries import ORACLES, QUERIES
from test_near_copies import brute_kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = "/root/testdata/sf0.001"
CLASH = "n_words string, kept string, hash string, words string, fingerprint string, component_id string, shard string, " \
        "spans string, score string, ids string, _id string, _hash string, window string, list string"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "Straße", "été", "ÉTÉ", "x", "delta.", "epsilon,", "zeta!", "12", "it's"]
    prose = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    line = "one two three four five six seven eight nine ten eleven twelve\n"
    near = " ".join(f"w{i}" for i in range(300))
    return [
        None, "", " \n\t ", "one", *prose, prose[3], prose[3], line * 5, near, near.replace("w17 ", "v17 "), near + " tail",
        "x " * 30_000, "a b c d", "\x0b\x0c mixed\x0bwhite\x1cspace \x85 \xa0 here", "password = hunter22x and AKIA" + "A1" * 10,
        "k = 'Zx81kQ9pLm22'\npassword = k\n", "licensed under the MIT License", "gnu general public license " * 3, "😀 emoji 😀 emoji 😀",
    ]


@pytest.fixture(scope="module")
def rows():
    made = [(i, t) for i, t in enumerate(texts())]
    made += [(None, "no id at all"), (None, None), (5, texts()[5]), (5, texts()[5]), (9, "another text under a used id")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for column in CLASH.split(", "):
        frame = frame.withColumn(column.split()[0], F.lit("own"))
    return frame.cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def bag(rows_):
    return Counter(tuple(r) for r in rows_)


# Quality rules


def repeated_words(words: list[str], width: int = 5) -> int:
    places = defaultdict(list)
    for i in range(len(words) - width + 1):
        places[tuple(words[i : i + width])].append(i)
    hit = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(width)}
    return len(hit)


def quality(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = repeated_words(words)
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, failed
    )


def test_repetition_matches_brute_force(docs, rows):
    got = repetition.with_repetition(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert bag(got.collect()) == Counter((i, *quality(t)) for i, t in rows)
    kept = repetition.with_repetition(docs)
    assert kept.where("kept AND base_failed").isEmpty()
    assert set(kept.columns) >= set(docs.columns)


def test_suffix_arrays_and_maximal_repeats():
    rng = random.Random(3)
    for _ in range(60):
        documents = [[rng.randint(0, 2) for _ in range(rng.randint(0, 24))] for _ in range(rng.randint(1, 4))]
        lengths = np.array([len(d) for d in documents])
        words = np.array([w for d in documents for w in d], np.int64)
        found = repetition.repeats(words, lengths, 3)
        for k, d in enumerate(documents):
            subs = defaultdict(list)
            for i in range(len(d)):
                for j in range(i + 3, len(d) + 1):
                    subs[tuple(d[i:j])].append(i)
            twice = {s: at for s, at in subs.items() if len(at) > 1}
            assert found.longest[k] == max(map(len, twice), default=0)
            maximal = 0
            for s, at in twice.items():
                left = {d[i - 1] if i else None for i in at}
                right = {d[i + len(s)] if i + len(s) < len(d) else None for i in at}
                maximal += len(left) > 1 and len(right) > 1
            assert found.maximal[k] == maximal
            assert found.covered[k] == len({i + x for s, at in twice.items() for i in at for x in range(len(s))})


def test_long_repeats_are_rejected(spark):
    block = " ".join(f"u{i}" for i in range(60))
    filler = [" ".join(f"{p}{i}" for i in range(250)) for p in "abc"]
    frame = spark.createDataFrame([(1, f"{filler[0]} {block} {filler[1]} {block} {filler[2]}"), (2, " ".join(filler))], "doc_id long, text string")
    loose = repetition.RepetitionRules(covered_percent=100, longest_share=0.05)
    kept = {r.doc_id: (r.kept, r.longest_repeat) for r in repetition.with_repetition(frame, rules=loose).collect()}
    assert kept == {1: (False, 60), 2: (True, 0)}


# SimHash


def fingerprint(text: str | None) -> int:
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values: list[int], bits: int = 4) -> dict[int, int]:
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {v: root(v) for v in distinct}


def simhash_rows(rows_):
    prints = [fingerprint(t) for _, t in rows_]
    roots = linked(prints)
    least: dict[int, int] = {}
    for (i, _), p in zip(rows_, prints):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    return [(i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows_, prints)]


def test_simhash_matches_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).drop("text_hash")
    assert bag(got.collect()) == Counter(simhash_rows(rows))


def test_keep_first_keeps_one_id_of_each_component(docs, rows):
    want = Counter(i for i, _, c in simhash_rows(rows) if i is None or i <= c)
    kept = simhash.keep_first(docs)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert kept.columns == docs.columns


@pytest.mark.parametrize("block", [2_048, 7])
def test_links_connect_what_all_links_connect(spark, block):
    rng = random.Random(block)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values[:20]):
        for _ in range(rng.randint(1, 8)):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                v ^= 1 << bit
            values.append(v)
    values = sorted(set(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fingerprint long").repartition(4)
    links = simhash.near_links(frame, 4, block).collect()
    groups = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    unsigned = {v - (1 << 64) if v >> 63 else v: v for v in values}
    want, got = defaultdict(set), defaultdict(set)
    for v, r in linked(values).items():
        want[r].add(v)
    for s, v in unsigned.items():
        got[groups.get(s, s)].add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(i, 200) for i in range(201, 260)] + [(7, 7), (3, 5), (5, 4), (4, 3), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 260)} == {200}
    assert got[5] == got[4] == got[3] == 3 and got[7] == 7 and len(got) == 41 + 60 + 4


# Decontamination


def hits(text: str | None, items: list[tuple], window: int = 10):
    words = ALNUM.findall(lower(text or ""))
    covered, found = set(), set()
    for item, item_text in items:
        own = ALNUM.findall(lower(item_text or ""))
        n = min(window, len(own))
        for j in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[j : j + n]:
                    covered |= set(range(i, i + n))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(covered), sorted(found), bool(covered)


ITEMS = [(2, "Short ITEM"), (10, " ".join(f"w{i}" for i in range(100, 125))), (3, None), (4, "..."), (10, "x x x x x x x x x x x"),
         (None, "mixed white"), (12, "short item")]


def test_contamination_matches_brute_force(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = rows + [(100, "a SHORT item, and a short-item; shorter item")]
    frame = docs.select("doc_id", "text", "words", "hash").unionByName(
        spark.createDataFrame(more[-1:], "doc_id long, text string"), allowMissingColumns=True
    )
    want = Counter((i, *map(lambda x: tuple(x) if isinstance(x, list) else x, hits(t, ITEMS))) for i, t in more)
    for limit in (64 << 20, 2_000):
        got = decontamination.contamination(frame, items, broadcast_bytes=limit)
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect()) == want
    left = decontamination.remove_contaminated(frame, items)
    assert Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_, dirty in want.elements() if not dirty)
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(frame, items).collect()}
    assert cut[100] == "a , and a ; shorter item" and cut[3] == "one"


def test_contamination_without_items_or_documents(spark, docs, nothing):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, items).where("contaminated").isEmpty()
    assert decontamination.contamination(nothing, spark.createDataFrame(ITEMS, "item_id long, text string")).isEmpty()


# Licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text: str | None):
    words = ALNUM.findall(lower(text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_matches_brute_force(spark, docs, rows):
    extra = [(200, "MIT\n\nlicense mit license; CC-BY 4.0 cc by-sa. Apache License, Version 2.0 gnu GENERAL public license v3"),
             (201, "submit license, cc bye, apache licenses"), (202, "mit license " * 400)]
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = licenses.with_licenses(frame)
    assert bag(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == Counter(
        (i, *license_base(t)) for i, t in rows + extra
    )
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in got.where("doc_id >= 200").collect()}
    assert labels[200] == "apache,apache-2.0,cc-by,cc-by-4.0,cc-by-sa,gpl,gpl-3.0,mit" and labels[201] == ""


def test_rank_and_containment_suppress(spark):
    frame = spark.createDataFrame([(1, "SPDX-License-Identifier: GPL-2.0-or-later"), (2, "GNU Lesser General Public License v2.1")], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.with_licenses(frame).collect()}
    assert labels == {1: "gpl-2.0-or-later", 2: "lgpl-2.1"}


def test_every_rule_is_gated_by_its_keyword():
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    assert len(rules()) > 200
    for rule in rules():

        def check(match):
            if re.fullmatch("[a-z0-9 ]+", match):
                assert set(match.split()) & set(GATES), (rule, match)
                assert rule.keyword in f" {match} ", (rule, match)

        pattern = rule.expression.replace("[^ ]", "[a-z]")
        given(st.from_regex(pattern, fullmatch=True))(
            settings(max_examples=5, database=None, deadline=None, suppress_health_check=list(HealthCheck))(check)
        )()


# Secrets

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text: str | None):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest())


def test_secret_base_matches_brute_force(spark, docs, rows):
    extra = [
        (300, "😀 Password: 'abc' PASSWD=\"longenough1\" api_key = deadbeefdeadbeefdeadbeef00 ApiKey:x token=" + "f" * 24),
        (301, "AKIAAKIA" + "B" * 30 + " AKIAshort paſſword=abcdefgh secret=toKen=abcdefg passwordpassword=123456"),
    ]
    frame = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    got = secrets.with_secrets(frame).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert bag(got.collect()) == Counter((i, *secret_base(t)) for i, t in rows + extra)


def test_literals_are_judged_by_the_names_they_reach():
    find = lambda text: [text[a:b] for a, b, k, _ in secrets.secret_spans(text.encode(), secrets.SecretRules()) if k == 3]
    assert find("k = 'Zx81kQ9pLm22'\nm = k\ndb_passphrase = m\n") == ["Zx81kQ9pLm22"]
    assert find('{"client_key": "q9W8e7R6t5Y4", "title": "q9W8e7R6t5Y4u3"}') == ["q9W8e7R6t5Y4"]
    assert find("pwd := changeme\npwd = your_value_here\nbearer = aaaaaaaaaaaa") == []
    assert find("the token: something quite ordinary; passphrase: nothing") == []


def test_masking_keeps_clean_rows(spark):
    frame = spark.createDataFrame(
        [(1, "a password=abcdef12 b", 21), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long"
    )
    assert [tuple(r) for r in secrets.mask_secrets(frame).orderBy("doc_id").collect()] == [
        (1, "a [SECRET] b", 12), (2, "clean", 5), (3, None, None)
    ]


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    return made


def check_pieces(pieces, wanted: Counter, padding: float):
    """wanted: ids of documents as a bag of (doc_id, ids)."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p.length
        sequences[p.sequence_id].append((p["offset"], p.length))
        documents[p.doc_id].append((p.start, p.doc_tokens, ids))
    padded = 0
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= padding * sum(p.length for p in pieces)
    total = Counter()
    for (i, ids), n in wanted.items():
        total[i] += n * len(ids)
        assert all(d == len(ids) for _, d, _ in documents[i]) or sum(k == i for k, _ in wanted) > 1
    assert {i: sum(len(x) for _, _, x in held) for i, held in documents.items()} == dict(total)
    for (i, ids), n in wanted.items():
        if n == 1 and sum(k == i for k, _ in wanted) == 1:
            assert [x for _, _, part in sorted(documents[i]) for x in part] == list(ids)


def test_packing_loses_nothing(docs, rows, tokenizer):
    wanted = Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 1)) for i, t in rows)
    check_pieces(packing.packed(docs).collect(), wanted, 0.05)


def test_words_are_encoded_as_in_their_texts(tokenizer):
    words = packing.WordTokens(public_tokenizers.path(packing.TOKENIZER), cached=50)
    import pyarrow as pa

    odd = ["Hello <|endoftext|> cafe\u0301 x\u0301 it's  \t\n\n O'K 12 345...", "İ Σας ΣΑΣ ǅ K \u212a ﬁ ª µ a×b b,. c.. É.", "\x01 \x85c\u2028d", None, ""]
    held = odd + [t for t in texts() if t]
    ids, lengths = words.encoded(pa.array(held), 1)
    ends = np.cumsum(lengths)
    for text, a, b in zip(held, ends - lengths, ends):
        assert ids[a:b].tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_windows_are_the_cheapest():
    rng = random.Random(5)
    limits = packing.PackingRules(window=16, sentence_cut=2, other_cut=5, short_sequence=3, other_every=4)
    for _ in range(80):
        total = rng.randint(1, 90)
        places = sorted({0, total, *(p for p in range(1, total) if rng.random() < 0.4), *range(0, total, 8)})
        penalties = [0.0] + [float(rng.choice([0, 2, 5])) for _ in places[1:]]
        best = {0: 0.0}
        for j in range(1, len(places)):
            options = []
            for i in range(j):
                length = places[j] - places[i]
                if length <= 16:
                    options.append(best[i] + 16 - length)
                    if length in (1, 2, 4, 8) and places[j] - 16 + 32 > total:
                        options.append(best[i] + 3)
            best[j] = min(options) + penalties[j]
        windows = packing.best_windows(np.array(places), np.array(penalties), limits)
        cost = 0.0
        for a, b in zip(windows, windows[1:]):
            length = int(b - a)
            short = length in (1, 2, 4, 8) and b + 16 > total
            cost += min(16 - length, 3 if short else 99) + penalties[places.index(b)]
        assert cost == best[len(places) - 1] and windows[-1] == total


# Sharding


def test_sharding_keeps_groups_and_sizes(docs, rows):
    got = sharding.sharded(docs, shards=4).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    of_text = defaultdict(set)
    for r in got:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 or crc == 0 for crc, s in of_text.items())


def test_best_fit_matches_a_plain_search(monkeypatch):
    monkeypatch.setattr(sharding.RoomTree, "LEAF", 4)
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(20, 60)
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 120))), reverse=True)
        rooms, placed = [], []
        for size in sizes:
            fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
            if fits:
                at = min(fits)[1]
            else:
                rooms.append(capacity)
                at = len(rooms) - 1
            rooms[at] -= size
            placed.append(at)
        assert sharding.best_fit_decreasing(sizes, capacity) == placed


def test_shards_come_out_even_beside_a_giant():
    sizes = sorted([5_000, *(random.Random(2).randint(1, 40) for _ in range(2_000))], reverse=True)
    loads = Counter()
    for size, shard in zip(sizes, sharding.pack_items(sizes, 10, None)):
        loads[shard] += size
    rest = [load for load in loads.values() if load != 5_000]
    assert len(rest) == 9 and max(rest) - min(rest) <= 40
    with pytest.raises(ValueError):
        sharding.pack_items([50, 1], None, 40)


def test_capacity_bounds_every_shard(docs):
    got = sharding.sharded(docs, shards=None, capacity=70_000, expected_shards=4)
    assert got.groupBy("shard").agg(F.sum("size").alias("s")).where("s > 70000").isEmpty()


# URLs


def test_hosts_paths_and_rules(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/x?y#z"), (2, "http://example.net"), (3, "http://example.net?q=/en/"), (4, "http://notexample.com/de/1"),
        (5, "x://shop.example.com/de/"), (6, "http://EXAMPLE.org/fr/a://b"), (7, None), (8, "no scheme"), (None, "http://a.org/FR/"), (10, "http://n.net/en/"),
        (10, "http://n.net/en/"), (11, "a\nb://h.net/p"),
    ]
    rules_ = [hosts.UrlRule("block", "net"), hosts.UrlRule("allow", "example.net", "/en/"), hosts.UrlRule("block", "example.com", "/de/"), hosts.UrlRule("allow", "org", "/fr/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("own")).withColumn("blocked", F.lit("own"))
    none = spark.createDataFrame([], "page_id long, bad int")
    got = Counter(tuple(r)[:5] for r in hosts.judge_urls(pages, none, rules_).collect())
    assert got == Counter([
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "", None, "allow"), (3, "example.net", "", None, "allow"),
        (4, "notexample.com", "/de/1", None, "allow"), (5, "shop.example.com", "/de/", "example.com/de/", "block"),
        (6, "example.org", "/fr/a://b", "org/fr/", "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"),
        (None, "a.org", "/FR/", None, "allow"), (10, "n.net", "/en/", "net/", "block"), (10, "n.net", "/en/", "net/", "block"), (11, "h.net", "/p", "net/", "block"),
    ])


def test_reputation_shrinks_small_hosts(spark):
    rows_ = [("bad.a.com", 1)] * 60 + [("good.a.com", 0)] * 60 + [("one.b.com", 1)] + [("c.org", 0)] * 40 + [("c.org", 1)] * 2 + [(None, 1), ("d.org", None)]
    got = {r.host: r for r in hosts.host_reputation(spark.createDataFrame(rows_, "host string, bad int")).collect()}
    assert {h for h, r in got.items() if r.blocked} == {"bad.a.com"}
    assert got["bad.a.com"].posterior > 0.9 > got["one.b.com"].posterior > 0.1 and "d.org" not in got


# WARC


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 80
    tricky = "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 6
    pages = [(5, "http://h/a?b", long), (3, "http://h/b", long), (9, None, long), (1, "http://h/c", "short"), (2, "u", "short"), (4, "http://x", None),
             (6, "http://x\r\ny", ""), (7, "http://t", tricky), (8, "http://t", tricky), (8, "http://t", tricky), (None, "http://n", long), (10, "http://big", "z" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("own")).withColumn("type", F.lit("own"))
    warc.write_archives(frame, f"{tmp_path}/w")
    read = warc.read_records(spark, f"{tmp_path}/w")
    assert read.count() == 3 * len(pages)
    assert Counter(bytes(r.payload) for r in read.where("type = 'response'").collect())[tricky.encode()] == 1
    whole = warc.transactions(read)
    assert whole.count() == len(pages) and whole.where("request IS NULL OR metadata IS NULL").isEmpty()
    got = Counter(tuple(r) for r in warc.captures_with_origin(whole).collect())
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    want = Counter()
    for i, _, html in pages:
        raw = (html or "").encode()
        again = len(raw) >= 100 and i != least[html or ""]
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", least[html or ""] if again else None)] += 1
    assert got == want


def test_no_pages_give_no_captures(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert warc.captures_with_origin(warc.transactions(warc.read_records(spark, f"{tmp_path}/none"))).isEmpty()


def test_damaged_archives_are_refused():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.records(record * 2)] == [b"abc", b"abc"]
    for broken in (record[:-5], b"x" + record, record.replace(b": 3", b": 4")):
        with pytest.raises(ValueError):
            list(warc.records(broken))


# Token totals


def test_counts_of_texts(spark, tokenizer):
    frame = spark.createDataFrame([(t,) for t in texts()], "text string").select(
        "text", token_totals.bpe_count(F.col("text")).alias("ids"), token_totals.word_count(F.col("text")).alias("words"), token_totals.word_and_mark_count(F.col("text")).alias("marks")
    )
    for r in frame.collect():
        text = r.text or ""
        assert r.ids == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert r.words == len(WORD.findall(text))
        assert r.marks == len(ALNUM.findall(lower(text))) + sum("!" <= c <= "~" and not c.isalnum() for c in text)


def test_rollups_follow_inserts_revisions_and_deletes(spark, tmp_path):
    rollup = token_totals.TokenTotals(spark, f"{tmp_path}/r")
    schema = "doc_id long, version string, source string, lang string, tokens long, deleted boolean"
    assert rollup.totals().isEmpty()
    assert rollup.apply("1", spark.createDataFrame([(1, "a", "s", "en", 10, False), (1, "a", "s", "en", 10, None), (2, "a", None, "en", 5, False), (1, "b", "s", "en", 7, False)], schema))
    second = spark.createDataFrame([(1, "a", "t", "fr", 12, False), (2, "a", None, None, None, True), (99, "a", "s", "en", None, True)], schema)
    assert rollup.apply("2", second) and not rollup.apply("2", second)
    assert not rollup.apply("1", second)
    assert rollup.apply("3", spark.createDataFrame([], schema))
    assert bag(rollup.totals().collect()) == Counter([("t", "fr", "a", 1, 12), ("s", "en", "b", 1, 7)])
    assert bag(rollup.ledger().collect()) == Counter([(1, "a", "t", "fr", 12), (1, "b", "s", "en", 7)])
    odd = [(None, "a", "s", "en", 1, False), (None, "a", "s", "en", 1, False), (None, "a", "s", "en", None, True), (7, None, "s", "en", 4, False), (8, "a", None, None, None, False)]
    assert rollup.apply("4", spark.createDataFrame(odd, schema))
    assert rollup.apply("5", spark.createDataFrame([(7, None, "s", "en", 6, False)], schema))
    assert bag(rollup.totals().collect()) == Counter(
        [("t", "fr", "a", 1, 12), ("s", "en", "b", 1, 7), ("s", "en", "a", 2, 2), ("s", "en", None, 1, 6), (None, None, "a", 1, 0)]
    )


# Whole queries


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    relation = duck.sql(ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    picked = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert bag(frame.select(columns).collect()) == Counter(picked)


def test_every_operator_is_registered():
    names = contract.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_simhash_query(spark, table):
    plain = [(r.doc_id, r.text) for r in table.collect()]
    assert bag(QUERIES["op7_simhash"](spark, SMALL).collect()) == Counter(simhash_rows(plain))


def test_license_secret_and_quality_queries(spark, table):
    plain = [(r.doc_id, r.text) for r in table.collect()]
    got = QUERIES["op2_licenses"](spark, SMALL).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert bag(got.collect()) == Counter((i, *license_base(t)) for i, t in plain)
    got = QUERIES["op8_secrets"](spark, SMALL).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    assert bag(got.collect()) == Counter((i, *secret_base(t)) for i, t in plain)
    got = QUERIES["op10_suffix_repetition"](spark, SMALL).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert bag(got.collect()) == Counter((i, *quality(t)) for i, t in plain)


def test_packing_and_sharding_queries(spark, table, tokenizer):
    got = QUERIES["op9_packing"](spark, SMALL).collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in table.collect()}
    for p in got:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part) and p.doc_tokens == len(ids[p.doc_id])
    assert sum(p.length for p in got) == sum(map(len, ids.values()))
    loads = defaultdict(int)
    for r in QUERIES["op4_sharding"](spark, SMALL).collect():
        loads[r.shard] += r["size"]
    assert set(loads) == set(range(40))


def longest_repeat(words: list[str]) -> int:
    """Words of the longest sequence that starts at two places."""
    low, high = 0, len(words)
    while low < high:
        width = (low + high + 1) // 2
        runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
        low, high = (width, high) if len(set(runs)) < len(runs) else (low, width - 1)
    return low


def kept_by_quality(text: str | None) -> bool:
    words = WORD.findall(text or "")
    longest = longest_repeat(words)
    return not quality(text)[5] and not (longest > 50 and longest > 0.10 * len(words))


def test_kept_matches_brute_force(spark, docs, rows, table):
    extra = [(1000 + k, " ".join(f"w{j % n}" for j in range(300))) for k, n in enumerate((300, 240, 245, 260, 120))]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    frame = frame.unionByName(table.select("doc_id", "text"))
    got = repetition.with_repetition(frame).select("doc_id", "kept", "longest_repeat")
    every = [(r.doc_id, r.text) for r in frame.collect()]
    want = Counter()
    for i, t in every:
        longest = longest_repeat(WORD.findall(t or ""))
        want[i, kept_by_quality(t), longest if longest >= 5 else 0] += 1
    assert bag(got.collect()) == want


def plain_secrets(text: str) -> list[tuple[int, int]]:
    """Places that the base patterns find, and values of sensitive names in the plain forms that the table holds."""
    found = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return found + [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_pipeline_matches_brute_force(spark, table, tokenizer):
    kept = [(r.doc_id, r.text) for r in table.collect() if kept_by_quality(r.text)]
    left = brute_kept(kept)
    kept = [(i, t) for i, t in kept if left[i is None, i or 0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not hits(t, items)[3]]
    wanted = Counter()
    for i, t in kept:
        spans = plain_secrets(t)
        for a, b in sorted(set(spans), reverse=True):
            if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in spans):
                t = t[:a] + "[SECRET]" + t[b:]
        wanted[i, (*tokenizer.encode(t, add_special_tokens=False).ids, 1)] += 1
    check_pieces(corpus_pipeline.run(spark, SMALL).collect(), wanted, 0.05)


#: Names that operators use inside, and names with a dot.
CLASHING = ["id", "_id", "_hash", "row", "found", "made", "measured", "masked", "spans", "raw", "gaps", "own_id", "own_text", "a.b",
            "__found", "__masked", "__measured", "__row", "__words", "__line", "__base", "__made", "cut", "rest", "bytes"]


def test_clashing_names_and_nulls(spark):
    rows_ = [
        (1, "password = hunter2secret and " + " ".join(f"w{k}" for k in range(12))), (2, None), (3, ""), (None, "x y"), (1, "mit license"),
        (1, "mit license"),
    ]
    wide = [(i, t, *CLASHING) for i, t in rows_]
    kinds = "doc_id long, text string, " + ", ".join(f"`{name}` string" for name in CLASHING)
    frame = spark.createDataFrame(wide, kinds)
    items = spark.createDataFrame([(7, "w1 w2 w3")], "item_id long, text string")

    def own(made):
        """The rows' clashing columns, as far as no result took their place."""
        results = {"spans"} if "n_assign" in made.columns else set()
        held = [c for c in CLASHING if c not in results]
        assert all(tuple(r[c] for c in held) == tuple(held) for r in made.collect())
        return made.count()

    made = [
        secrets.with_secrets(frame), secrets.mask_secrets(frame), repetition.with_repetition(frame), licenses.with_licenses(frame),
        simhash.with_fingerprint(frame), decontamination.remove_spans(frame, items),
    ]
    assert [own(x) for x in made] == [6] * 6
    assert own(decontamination.remove_contaminated(frame, items)) == 5
    assert own(repetition.reject_repetition(frame)) == 1
    assert own(corpus_pipeline.near_dedup(spark, frame, "")) == 4
    cut = {r.doc_id: r.text for r in made[5].where("doc_id <> 1 OR text LIKE 'pass%'").collect()}
    assert cut[2] is None and cut[3] == "" and "w1 w2" not in cut[1] and "w0" in cut[1]


def test_one_very_long_text(spark):
    """Shingles and repeats of a text of several pieces agree with plain counting."""
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(700_000)]
    text = "  ".join(words + words[:300])
    assert len(text.encode()) > 5 << 20
    assert fingerprint(text) == int(simhash.fingerprints([text.encode()])[0].view(np.uint64)[0])
    found = repetition.measured([text.encode()], repetition.RepetitionRules())
    assert found[4][0] >= 600 and found[5][0] == 300


def test_stages_keep_the_columns(spark, nothing):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nothing, SMALL).columns == nothing.columns and stage(spark, nothing, SMALL).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, SMALL).isEmpty()


def test_empty_tables(spark, nothing):
    for made in (
        repetition.with_repetition(nothing), simhash.near_duplicates(nothing), licenses.with_licenses(nothing), secrets.with_secrets(nothing),
        packing.packed(nothing), sharding.sharded(nothing),
    ):
        assert made.isEmpty()
