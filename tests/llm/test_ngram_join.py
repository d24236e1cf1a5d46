import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerotrace.llm import ngram_join, word_hash
from aerotrace.llm.word_hash import words

SCHEMA = "doc_id long, text string, lang string, score double, component long, `set` string"


def grams(text, n):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(ids) if ids else None) for i in members]
    return Counter(out)


def family(rng, base, copies, most):
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [None, "", "  \n ", "One", "one", "one two three", "ONE two\tthree", "one two three four", "a" * 5000]
    for size, copies, most in ((40, 60, 3), (150, 150, 12), (7, 30, 1), (400, 40, 20)):
        texts += list(family(rng, rng.choices(vocabulary, k=size), copies, most))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 90))) + " " + passage for _ in range(120)]
    texts += rng.choices(texts, k=80)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (3, "one"), (None, "one two three four"), (None, "alone in the world it is")]


@pytest.mark.parametrize(("n", "percent", "block", "steered"), [(4, 85, 2048, False), (5, 80, 2048, True), (4, 85, 16, True)])
def test_components_equal_all_pairs(spark, monkeypatch, n, percent, block, steered):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", 0.5, 1, "x") for i, t in rows], SCHEMA).repartition(5)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n, percent, steered).collect())
    assert got == brute(rows, n, percent)


def test_near_copies_without_ids_of_their_own(spark):
    """Sets that only rows without an id hold, as pivot and as member, and many texts under one id."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    copy, *near = (list(family(rng, rng.choices(vocabulary, k=90), 12, 2)))
    rows = [(None, copy), (None, copy), (5, near[0]), *[(None, t) for t in near[1:6]]]
    rows += [(9, t) for t in family(rng, rng.choices(vocabulary, k=60), 40, 2)] + [(9, near[6])] * 3
    rows += [(None, t) for t in family(rng, rng.choices(vocabulary, k=50), 10, 1)]
    df = spark.createDataFrame([(i, t, "en", 0.5, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect())
    assert got == brute(rows, 4, 85)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 85, 95]), st.integers(0, 10**6), st.floats(0, 1))
def test_linked_sets_share_an_entry(size, lost, added, percent, seed, share):
    """The index loses no link: sets that differ in few enough hashes have an entry in common."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[min(lost, len(a) - 1):], rng.integers(0, 1 << 63, added, dtype=np.uint64))))
    common = len(np.intersect1d(a, b))
    frequent = np.sort(rng.choice(np.union1d(a, b), int(share * len(a)), replace=False)) if rng.random() < 0.8 else None
    keys, owner = ngram_join.index_keys(np.concatenate((a, b)), np.array([len(a), len(b)]), percent, frequent)
    if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


@pytest.mark.parametrize("pairs", [7, 1 << 22])
def test_overlaps_follow_from_differences(monkeypatch, pairs):
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    pivot = np.unique(rng.integers(0, 1 << 40, 50, dtype=np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(pivot, 40, replace=False), rng.integers(0, 60, 8, dtype=np.uint64)))) for _ in range(40)]
    rows = [(len(s), len(np.intersect1d(s, pivot)), np.flatnonzero(~np.isin(pivot, s)).astype("<u4").tobytes(), np.setdiff1d(s, pivot).astype("<u8").tobytes()) for s in sets]
    got = ngram_join.overlaps(rows[:15], rows[15:], len(pivot))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]


def test_words_across_blocks(monkeypatch):
    texts = ["", "ab cd", "e", "", "fghij klmno\n\npq  r", "stuvwxyz", " ", "A1 b2"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    start = np.concatenate(([0], end[:-1]))
    whole = words(raw, start, end)
    want = [(i, w.lower()) for i, t in enumerate(texts) for w in t.split()]
    assert [(int(r), bytes(raw[a:b]).decode().lower()) for r, a, b in zip(whole.row, whole.start, whole.end, strict=True)] == want
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(word_hash, "BLOCK", size)
        part = words(raw, start, end)
        assert all(np.array_equal(getattr(whole, k), getattr(part, k)) for k in ("row", "start", "end", "hash"))


def test_word_hashes_do_not_depend_on_place():
    raw = np.frombuffer(b"Foo  bar\nfoo\tBAR baz" + b"foo", np.uint8)
    w = words(raw, np.array([0, 20, 20]), np.array([20, 20, 23]))
    assert w.row.tolist() == [0, 0, 0, 0, 0, 2]
    assert w.hash[0] == w.hash[2] == w.hash[5] and w.hash[1] == w.hash[3] and len(set(w.hash.tolist())) == 3
