import numpy as np
from pyspark.sql import functions as F

from aerotrace.llm import hamming_index, topk_search, vector_blocks

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string"


def vectors(spark, n=700, dim=16, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype("f4")
    x[50:60] = x[40]  # ties
    rows = [(i, v.tolist(), 1, "s", "b") for i, v in enumerate(x)]
    odd = [(n, None, 1, "s", "b"), (n + 20, [], 1, "s", "b"), (n + 40, [1.0, None] + [0.0] * (dim - 2), 1, "s", "b"), (n + 60, [float("nan")] * dim, 1, "s", "b"),
           (n + 80, [float("inf")] * dim, 1, "s", "b"), (n + 100, [0.0] * dim, 1, "s", "b"), (n + 120, [1.0, 2.0, 3.0], 1, "s", "b"), (40, x[40].tolist(), 1, "s", "b")]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(4), x


def test_exact_top_k(spark, monkeypatch):
    df, x = vectors(spark)
    monkeypatch.setattr(vector_blocks.search, "__defaults__", (200, 16))
    got = topk_search.nearest(df, F.col("vec_id") % 20 == 0).collect()
    z = np.vstack((np.floor(64 * x.astype(float)), np.zeros((1, 16)))).astype(int)
    ids = np.append(np.arange(700), 800)
    for q in [*range(0, 700, 20), 800]:
        s = z @ z[ids == q][0]
        best = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["rank"], r["vec_id"], r["score"]) for r in mine] == [(k + 1, ids[i], s[i]) for k, i in enumerate(best)]
    assert {r["query_id"] for r in got} == {*range(0, 700, 20), 800}


def test_large_components_stay_exact():
    v = np.random.default_rng(1).integers(-2**30, 2**30, (90, 3))
    kind = topk_search.number_type(v, v)
    lists = topk_search.SortedLists(np.arange(90), v, kind)
    for q, (found, score) in zip(range(90), lists.top(np.arange(90), v, 5), strict=True):
        s = [int(sum(int(a) * int(b) for a, b in zip(v[q], w, strict=True))) for w in v]
        want = sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:5]
        assert found.tolist() == want and score.tolist() == [s[i] for i in want]


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(i, [float(i + 1), 1.0], 0, "", "") for i in range(3)], SCHEMA)
    assert topk_search.nearest(df, F.col("vec_id") == 0).count() == 2
    assert hamming_index.nearest(df, F.col("vec_id") == 0).count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert topk_search.nearest(empty, F.col("vec_id") == 0).collect() == [] == hamming_index.nearest(empty, F.col("vec_id") == 0).collect()


def test_multi_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[:300] = codes[0] ^ np.where(rng.random((300, 4)) < 0.5, 1 << rng.integers(0, 16, (300, 4)), 0).astype(np.uint16)
    index = hamming_index.MultiIndex(codes)
    for r in (0, 3, 7, 12, 20, 64):
        assert index.within(codes[5], r).tolist() == np.flatnonzero(hamming_index.hamming(codes, codes[5]) <= r).tolist()


def test_nearest_neighbours_recall(spark, monkeypatch):
    df, x = vectors(spark, 1500)
    monkeypatch.setattr(vector_blocks.search, "__defaults__", (400, 16))
    got, hit = hamming_index.nearest(df, F.col("vec_id") % 50 == 0).collect(), 0
    x = x.astype(float)
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert len(mine) == 10 and [r["rank"] for r in mine] == list(range(1, 11)) and all(r["score"] == d[r["vec_id"]] for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(best))
    assert hit >= 0.9 * 10 * 30
    assert 1600 not in {r["vec_id"] for r in got}  # the zero vector
