import hashlib
import random
import zlib
from collections import defaultdict

from aerotrace.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def plain(rows):
    """The contract word by word, for turns that are all different within a conversation."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)


def got(df):
    cols = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in cols) for r in df.collect())


def conversations(seed=7):
    rng, rows = random.Random(seed), []
    for c in [*range(0, 40), 100, 101, 150, 305]:  # 300 is absent
        n = rng.randint(1, 9)
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"]), f"say {rng.randint(0, 2)} {t}" if rng.random() < 0.8 else None))
    for c in range(40, 70):  # a third are copies
        rows += [(c, t, "user", f"copy {t}") for t in range(7)]
    long = [(c, t if t else None, None if t == 5 else "user", f"long {t % 4} {t}") for c in (77, 78) for t in range(23 + c % 2)]
    return rows + long + [(None, 1, "user", "nobody")]


def test_equals_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = conversations()
    assert got(prefix_trie.build(table(spark, rows), unit=4)) == plain(rows)  # three tiers


def test_one_tier_and_repeated_rows(spark):
    rows = [(c, None, "user", "same") for c in (1, 2) for _ in range(7)] + [(100, 0, "a", "b")]
    assert got(prefix_trie.build(table(spark, rows))) == plain(rows)


def test_no_conversations(spark):
    assert prefix_trie.build(table(spark, [], 1)).count() == 0
    assert prefix_trie.build(table(spark, [(None, 1, "user", "x")], 1)).count() == 0
    one = prefix_trie.build(table(spark, [(3, 1, "user", "x")], 1)).collect()  # loses its only turn if more than one is replaced
    assert {r["depth"] for r in one} == ({0, 1} if zlib.crc32(b"3") % 6 == 0 else {0})
