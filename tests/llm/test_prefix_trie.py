import hashlib
import random
import zlib
from collections import defaultdict

from strandline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string, n long, hash string"


def brute(rows):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of every node; turns as (role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
            if d:
                children[tuple(seq[: d - 1])].add(tuple(seq[:d]))
        ends[tuple(seq)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, m in members.items()
    )


def key(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], str(r)))


def check(spark, rows, parts=5):
    table = spark.createDataFrame([(*r, 9, "p", 3, "h") for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.digest(table).collect()
    assert key(tuple(r)[:8] for r in out) == key(brute(rows))
    by_rank = {r["preorder"]: r for r in out}
    assert sorted(by_rank) == list(range(len(out)))
    for r in out:  # an interval holds its children's intervals, and the root's holds all
        assert r["preorder"] <= r["subtree_end"] < len(out)
        inside = [by_rank[i] for i in range(r["preorder"] + 1, r["subtree_end"] + 1)]
        assert all(x["depth"] > r["depth"] and x["subtree_end"] <= r["subtree_end"] for x in inside)
        assert sum(x["depth"] == r["depth"] + 1 for x in inside) == r["n_children"]
    return out


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in [*range(-7, 60), *r.sample(range(100, 10**9), 40)]:
        for turn in range(r.randrange(0, 14)):
            rows.append((c, r.choice([turn, turn, turn, None, 3]), r.choice(["user", "assistant", None, ""]), r.choice(["hi", "hello", "ü", None, "", "hi there"]) if turn < 9 else r.choice("ab")))
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (70, 1, "a", "bc"), (71, 1, "ab", "c"), (75, None, None, None)] + [(72, 5, "user", "again")] * 6
    check(spark, rows)


def test_one_long_conversation_and_its_copies(spark):
    """A conversation with most rows lies in several tasks, others part from it at many depths; a group of copies ends at one node."""
    r = random.Random(4)
    long = [("user", str(r.random())) for _ in range(700)]
    rows = [(1000, i, *t) for i, t in enumerate(long)]
    for k in range(30):
        cut = r.randrange(5, 60)
        rows += [(2000 + 5 * k, i, *t) for i, t in enumerate(long[:cut] + [("user", f"other {k % 3}")] * r.randrange(3))]
    rows += [(5000 + k, i, "user", f"copy {i}") for k in range(700) for i in range(2)]
    out = check(spark, rows)
    assert max(r["n_convs"] for r in out if r["depth"] == 1) > 300 and max(r["depth"] for r in out) == 700


def test_repeated_rows_of_one_conversation(spark):
    check(spark, [(8, 1, "user", "same")] * 300 + [(9, 1, "user", "same")])


def test_no_digest_is_left_out_of_a_path(spark):
    """Runs without branches share a path; its length follows the number of branching ancestors alone."""
    rows = [(c, i, "user", f"{i}" if i != c else f"x{c}") for c in (101, 102, 103) for i in range(110)]
    check(spark, rows)


def test_empty(spark):
    assert prefix_trie.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.digest(spark.createDataFrame([(None, 1, "a", "b", 1, "", 1, "")], SCHEMA)).collect() == []
