import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerotrace.llm import pitman_yor

SCHEMA = "doc_id long, text string, lang string, held string, score string, block string"


def held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", "h", "s", "b") for i, t in rows], SCHEMA).repartition(parts)


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]


def corpus(seed=1):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["Ünï", "A B", "THE"]
    rows = [(i, " ".join(rng.choices(names, [1 / (k + 1) for k in range(63)], k=rng.randint(0, 60)))) for i in range(200)]
    rows += [(i, "the the the the") for i in range(300, 380)]  # a word that a third repeats
    return rows + [(None, "w1\tw2\nw3 nobody"), (500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (7, "again w1"), (503, "new words only here")]


def test_counts_and_base_score(spark):
    import zlib

    rows = corpus()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out(i), len(words(t)), sum(w in c for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    got = pitman_yor.score(table(spark, rows), held()).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert any(r["held_out"] for r in got) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_blocks_do_not_change_scores(spark):
    rows = corpus()
    a, b = (sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in pitman_yor.score(table(spark, rows, p), held()).collect()) for p in (1, 7))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-9)


def test_closed_form_where_every_dish_has_one_customer(spark):
    rows = [(1, "a b c d"), (2, "b d zz")]  # d follows c only, and so on: all seatings are known
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score(table(spark, rows, 2), F.col("doc_id") == 2, (0.6, 0.7), (2.0, 3.0)).collect()}
    v = 5
    base = 1 / (v + 1)
    root = lambda w: ((0.4 if w != "zz" else 0) + (2 + 0.6 * v) * base) / (2 + v)
    follows = {(None, "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", None)}
    p = lambda u, w: root(w) if u == "zz" else ((0.3 if (u, w) in follows else 0) + (3 + 0.7) * root(w)) / (3 + 1)
    for i, text in rows:
        w = words(text)
        assert got[i] == pytest.approx(sum(math.log10(p(u, x)) for u, x in zip([None, *w], w)), abs=1e-5)
    for u in ("a", "d", None, "zz"):
        assert sum(p(u, w) for w in ("a", "b", "c", "d", None, "zz")) == pytest.approx(1)


def test_seating_follows_the_posterior():
    c, d, opening, many = 5, 0.5, 0.8, 20000
    # partitions of c customers by number of tables, weighted by the process
    weight = Counter()

    def seatings(sizes, left, w):
        if not left:
            weight[len(sizes)] += w
            return
        for k, s in enumerate(sizes):
            seatings([*sizes[:k], s + 1, *sizes[k + 1:]], left - 1, w * (s - d))
        seatings([*sizes, 1], left - 1, w * opening)

    seatings([1], c - 1, opening)
    total = sum(weight.values())
    parent = np.full(many, opening / (1 + d * 10))
    mean, last = pitman_yor.seat(np.full(many, c), np.zeros(many, int), parent, d, 1.0, 12, np.random.default_rng(0), tables=10)
    for t in range(1, c + 1):
        assert (last == t).mean() == pytest.approx(weight[t] / total, abs=0.02)
    assert mean.mean() == pytest.approx(sum(t * w for t, w in weight.items()) / total, abs=0.1)


@pytest.mark.parametrize("c, opening, d, sweeps", [(70, 1.0, 0.8, 2), (400, 150.0, 0.8, 2), (700, 0.8, 0.8, 6), (520, 3.0, 0.3, 12)])
def test_every_customer_of_a_large_dish_moves(c, opening, d, sweeps):
    many = 400
    log_weight = np.full(c + 2, -np.inf)  # of seatings of n customers by number of tables
    log_weight[1], t = 0.0, np.arange(c + 2)
    for n in range(1, c):
        stay = np.where(t <= n, log_weight + np.log(np.maximum(n - d * t, 1e-300)), -np.inf)
        log_weight = np.logaddexp(stay, np.concatenate(([-np.inf], log_weight[:-1])))
    weight = np.exp(log_weight + t * math.log(opening) - (log_weight + t * math.log(opening)).max())
    weight /= weight.sum()
    want = (weight * t).sum()
    spread = math.sqrt((weight * t * t).sum() - want ** 2)
    parent = np.full(many, opening / (1 + d * 10))
    _, last = pitman_yor.seat(np.full(many, c), np.zeros(many, int), parent, d, 1.0, sweeps, np.random.default_rng(3), tables=10)
    assert last.mean() == pytest.approx(want, abs=5 * spread / math.sqrt(many))


def test_parties_keep_the_posterior():
    d, opening, many = 0.4, 1.3, 20000
    fresh = pitman_yor._fresh(np.array([opening]), d, 2)[0]
    s, seen, rng = np.array([3]), Counter(), np.random.default_rng(5)
    for _ in range(many):
        s = pitman_yor._reseated(s, fresh, d, rng)
        assert s.sum() == 3
        seen[tuple(sorted(s.tolist()))] += 1
    weight = {(3,): opening * (1 - d) * (2 - d), (1, 2): 3 * opening ** 2 * (1 - d), (1, 1, 1): opening ** 3}
    for sizes, w in weight.items():
        assert seen[sizes] / many == pytest.approx(w / sum(weight.values()), abs=0.02)


def test_neighbours_help_on_held_out_text(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"x{k} y{k}" for k in rng.choices(range(50), k=30))) for i in range(300)]
    got = [r for r in pitman_yor.score(table(spark, rows), held()).collect() if r["held_out"]]
    assert got and all(r["score"] > 0.7 * r["base_score"] for r in got)


def test_no_documents_and_no_training_text(spark):
    assert pitman_yor.score(table(spark, [], 1), held()).count() == 0
    (r,) = pitman_yor.score(table(spark, [(1, "a b")], 1), F.lit(True)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0) and r["score"] == 0.0
