import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lodestone.llm import prefix_trie
from lodestone.llm.radix_tree import RadixTree, _Direct, _Indexed, _Sorted


def test_radix_tree_layouts_and_paths():
    rng = random.Random(1)
    for width in (2, 4):
        for alphabet in (2, 12, 40, 256):
            keys = {bytes(rng.randrange(alphabet) for _ in range(width * rng.randrange(4))) for _ in range(2_000)}
            tree = RadixTree()
            for key in rng.sample(sorted(keys), len(keys)):
                tree.insert(key, key)
            found, layouts, stack = [], set(), [(b"", tree.root)]
            while stack:
                head, node = stack.pop()
                head += node.path
                if node.value is not None:
                    assert node.value == head
                    found.append(head)
                children = list(node.items())
                assert [b for b, _ in children] == sorted(b for b, _ in children)
                layouts.add((type(node.children), getattr(node.children, "size", 0)))
                stack.extend((head + bytes([b]), child) for b, child in reversed(children))
            assert found == sorted(keys)
            if alphabet == 256 and width == 2:
                assert layouts >= {(_Direct, 0), (_Sorted, 4)}
            if alphabet == 40:
                assert (_Indexed, 0) in layouts


def expected(conversations):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        path = tuple(turns)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved, rows = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        size = len(p[-1][1].encode()) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * size
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        parent = min(members[p[:-1]]) if p else -1
        rows.append((min(members[p]), len(p), parent, len(members[p]), len(children[p]), leaves[p], saved[p], digest))
    return sorted(rows)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).fillna(-1, ["parent_conv_id"]).collect())


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "UNIT_BYTES", 400)  # many small trees, so most paths are merged
    rng = random.Random(5)
    turn = lambda n: (rng.choice(["user", "bot", ""]), "é" * rng.randrange(n))
    conversations = {}
    for c in range(600):
        shared = [("user", "hello"), ("bot", "hi there")][: rng.choice([0, 1, 2, 2, 2])]
        conversations[c] = shared + [turn(3) for _ in range(rng.randrange(5))]
    conversations[700] = [("user", "hello")] + [turn(4) for _ in range(300)]  # long
    conversations[701] = conversations[700][:250]
    for c in range(800, 1000):
        conversations[c] = conversations[5]  # copies
    rows = [(c, [(f"{prefix(r, t)}", len(t.encode())) for r, t in turns]) for c, turns in conversations.items()]
    frame = spark.createDataFrame(rows, "conv_id long, turns array<struct<id: string, bytes: int>>")
    assert nodes(prefix_trie.prefix_trie(prefix_trie.keyed(frame))) == expected(conversations)


def prefix(role, text):
    sized = "".join(f"{len(x.encode())}:{x}" for x in (role, text))
    return hashlib.md5(sized.encode()).hexdigest()


def test_turn_order_nulls_and_extra_columns(spark):
    rows = [
        (1, 2, "user", "c", 0), (1, None, None, "a", 0), (1, 1, "user", None, 0), (1, 1, "user", None, 0),
        (None, 1, "user", "lost", 0), (2, None, "", "a", 0),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `turns.id` int")
    ordered = prefix_trie.ordered_turns(frame)
    want = {1: [("", "a"), ("user", ""), ("user", ""), ("user", "c")], 2: [("", "a")]}
    got = {r.conv_id: [(t.id, t.bytes) for t in r.turns] for r in ordered.collect()}
    assert got == {c: [(prefix(*t), len(t[1].encode())) for t in turns] for c, turns in want.items()}
    assert nodes(prefix_trie.prefix_trie(prefix_trie.keyed(ordered))) == expected(want)
    assert prefix_trie.prefix_trie(prefix_trie.keyed(ordered.where(F.lit(False)))).count() == 0
