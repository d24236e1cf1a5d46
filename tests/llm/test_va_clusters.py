import hashlib

import numpy as np

from aerotrace.llm import va_clusters

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, k string"


def plain(rows, k, rounds, scale=256, seed=2):
    """Assignment and floored means by all distances."""
    v = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in e]) for i, e in rows]
    order = sorted(v, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = np.array([e for _, e in order[:k]], object)
    x = np.array([e for _, e in v], object)
    for step in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        who = d.argmin(1)
        if step == rounds:
            return [(i, int(w), int(d[n, w])) for n, ((i, _), w) in enumerate(zip(v, who))], c
        c = np.array([[sum(col) // len(col) for col in zip(*x[who == j].tolist())] if (who == j).any() else list(c[j]) for j in range(len(c))], object)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, e, 7, "x", "y") for i, e in rows], SCHEMA).repartition(parts)


def test_equals_plain_clustering(spark, monkeypatch):
    monkeypatch.setattr(va_clusters, "BLOCK", 64)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype("f4")
    x[:150] = x[0]  # a vector that a third of the rows repeat
    rows = [(i % 390, e.tolist()) for i, e in enumerate(x)] + [(None, x[5].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] * 8), (905, [float("-inf")] * 8)]
    want, c = plain(rows, 10, 5)
    for bits in (2, 4, 8):
        got = va_clusters.cluster(table(spark, rows + odd), 10, dim=8, bits=bits)
        assert sorted(map(tuple, got.rows.collect()), key=str) == sorted(want, key=str) and got.centroids.tolist() == c.tolist()
    out = va_clusters.with_inertia(got).collect()
    assert {r["inertia"] for r in out} == {sum(d for _, _, d in want)}
    for r in out:
        assert r["cluster_inertia"] == sum(d for _, w, d in want if w == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[r["cluster"]])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    got = va_clusters.cluster(table(spark, rows, 1))
    assert sorted(r["distance"] for r in got.rows.collect()) == [0, 0, 0]
    assert va_clusters.cluster(table(spark, [(1, None)], 1)) is None


def test_intervals_enclose_distances():
    rng = np.random.default_rng(4)
    v, c = rng.integers(-300, 300, (500, 6)), rng.integers(-300, 300, (9, 6))
    marks = np.sort(rng.integers(-250, 250, (6, 3)), 1)
    low = np.column_stack((v.min(0), marks))
    high = np.column_stack((marks, v.max(0) + 1)) - 1
    cells = np.stack([np.searchsorted(low[d, 1:], v[:, d], side="right") for d in range(6)], 1)
    near, far = va_clusters.intervals(low, high, c)
    d = ((v[:, None] - c[None]) ** 2).sum(2)
    lower, upper = (sum(t[k][cells[:, k]] for k in range(6)) for t in (near, far))
    assert (lower <= d).all() and (d <= upper).all()
    assert va_clusters.candidates(cells, near, far)[np.arange(500), d.argmin(1)].all()
