"""The near-dedup stage of the pipeline against brute-force Jaccard similarity."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lodestone.llm import near_copies, simhash


def shingles(text: str | None) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words)


def brute_kept(rows) -> Counter:
    """(doc_id, text) of the row that stays in each component."""
    sets = [shingles(t) for _, t in rows]
    component = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0:
                low, high = sorted((component[i], component[j]))
                component = [low if c == high else c for c in component]
    groups = {}
    for c, row in zip(component, rows):
        groups.setdefault(c, []).append(row)
    return Counter(min((i is None, i or 0) for i, _ in held) for held in groups.values())


def edited(words: list[str], rng: random.Random, changes: int) -> str:
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def test_stage_matches_brute_force_jaccard(spark):
    rng = random.Random(5)
    rows, number = [], 1000
    for _ in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 400))]
        for changes in (0, 0, 1, len(base) // 80, len(base) // 50, len(base) // 45, len(base) // 30, len(base) // 12):
            rows.append((number, edited(base, rng, changes)))
            number -= 1
    rows += [(None, "no id but the same words as another row here")] * 3
    rows += [(2000, "an id that is kept and its repeated rows")] * 3 + [(2000, "another text under the same id, wholly")]
    rows += [(3000, None), (3001, ""), (3002, " \n ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, frame, "").collect()
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in got) == brute_kept(rows)
    # The fingerprints of the op7 contract leave most of these pairs apart.
    assert simhash.keep_first(frame).count() > len(got) + 50


def test_blocks_link_the_same_components(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(base, rng, rng.randint(0, 5))) for k in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = []
    for block in (7, 512):
        found = near_copies.with_component(frame, "doc_id", "text", 5, 0.8, block).collect()
        groups = {}
        for r in found:
            groups.setdefault(r.component, set()).add(r.doc_id)
        ids.append(sorted(map(sorted, groups.values())))
    assert ids[0] == ids[1]
    assert Counter((False, held[0]) for held in ids[0]) == brute_kept(rows)


def test_exact_sets_decide():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 9])]
    assert list(near_copies.similar(sets, None, 0.8, simhash.Forest(), [10, 11, 12], [])) == [(10, 11)]


def test_lists_of_a_template_are_not_closed_before_they_are_compared(spark):
    """Pages of one template at similarity 0.5 share bands by chance; only their lists are compared."""
    rng = random.Random(8)
    head = [f"t{k}" for k in range(80)]
    rows = [(k, " ".join(head + [f"p{k}x{j}" for j in range(36)])) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(20)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_copies.with_component(frame, "doc_id", "text", 5, 0.8).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, []).append(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted([[k, 1000 + k] for k in range(20)] + [[k] for k in range(20, 300)])


def test_known_components_are_not_compared_again():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [50])]
    forest = simhash.Forest()
    forest.join(10, 11)
    assert list(near_copies.similar(sets, None, 0.8, forest, [10, 11, 12, 13], [])) == [(10, 12)]


def test_fingerprints_propose_pairs_for_the_exact_check(spark, monkeypatch):
    """Close copies reach the exact check by the index of fingerprints too, not by bands alone."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words + ["end"]), " ".join(f"x{i}" for i in range(50)), "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes, _, prints = near_copies.signatures([(t or "").encode() for t in texts], 5)
    assert prints[:3] == simhash.fingerprints([t.encode() for t in texts[:3]], 5)[0].tolist()
    assert (prints[0] ^ prints[1]).bit_count() <= 4 and prints[3:] == [None, None]
    star, seen = near_copies.star_links, []

    def spied(members, *rest):
        seen.append({(r["a"], r["node"]) for r in members.where("node <> a").collect()})
        return star(members, *rest)

    rays = near_copies.fingerprint_rays(spark.createDataFrame(list(zip(nodes, prints)), "node long, fingerprint long"))
    assert [(r["a"], r["node"]) for r in rays.collect()] == [(min(nodes[:2]), max(nodes[:2]))]
    monkeypatch.setattr(near_copies, "star_links", spied)
    monkeypatch.setattr(near_copies, "fingerprint_rays", lambda _: rays.unionByName(spark.createDataFrame([(nodes[0], nodes[2])], "a long, node long")))
    found = near_copies.with_component(frame, "doc_id", "text", 5, 0.8).collect()
    assert (nodes[0], nodes[2]) in seen[0]
    same = {r["doc_id"]: r["component"] for r in found}
    assert same[0] == same[1] != same[2] and same[3] == same[4]
