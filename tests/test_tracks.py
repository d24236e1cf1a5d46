import numpy as np
import pandas as pd
import pytest

from aerotrace.operators import identity_pass as ip
from aerotrace.operators import tracks as tk


def iou(a, b):
    return float(tk.overlap_matrix(np.array(a, float), np.array(b, float))[0, 0])


def clip(seed=0, frames=160, people=6):
    rng = np.random.default_rng(seed)
    rows, start = [], rng.uniform(0, 400, (people, 2))
    for f in range(frames):
        for p in range(people):
            if rng.random() < 0.15 or (p == 2 and 40 < f < 60):
                continue
            x, y = start[p] + f * np.array([0.6, 0.2]) * (p % 3)
            rows.append(("m", f, f * 100 + p, x, y, x + 30.0, y + 30.0))
    return pd.DataFrame(rows, columns=["mission_id", "frame", "det_id", "x1", "y1", "x2", "y2"])


def greedy_model(pdf, thr=0.25, gap=3):
    tracks, label, nxt = [], {}, 1
    for f in range(int(pdf.frame.min()), int(pdf.frame.max()) + 1):
        dets = pdf[pdf.frame == f].sort_values("det_id")
        boxes = dets[["x1", "y1", "x2", "y2"]].to_numpy().tolist()
        pairs = sorted(((iou(t["box"], b), i, j) for i, t in enumerate(tracks) for j, b in enumerate(boxes)), reverse=True)
        ut, ub = set(), set()
        for s, i, j in pairs:
            if s < thr or i in ut or j in ub:
                continue
            ut.add(i)
            ub.add(j)
            tracks[i].update(box=boxes[j], last=f)
            label[int(dets.det_id.iloc[j])] = tracks[i]["tid"]
        for j, b in enumerate(boxes):
            if j not in ub:
                tracks.append({"tid": nxt, "box": b, "last": f})
                label[int(dets.det_id.iloc[j])] = nxt
                nxt += 1
        tracks = [t for t in tracks if f - t["last"] <= gap]
    return label


@pytest.mark.parametrize("chunk", [20_000, 60])
def test_greedy_tracking_is_exact_for_any_chunk(spark, chunk):
    pdf = clip()
    got = {r.det_id: r.tid for r in tk.track_greedy(spark.createDataFrame(pdf), chunk=chunk).collect()}
    assert got == greedy_model(pdf)


def strict_model(pdf, buffer=60, least=15):
    tracks, out, flushed, nxt = {}, {}, [], 1
    for f in range(int(pdf.frame.min()), int(pdf.frame.max()) + 1):
        dets = pdf[pdf.frame == f].sort_values("det_id")
        order = list(tracks)
        heads = [tracks[t][-1][1] for t in order]
        taken, todo = set(), []
        for r in dets.itertuples():
            p = [(r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, r.x2 - r.x1]
            v = [float(tk.square_overlap_matrix(np.array(p), np.array(h))[0, 0]) for h in heads]
            if not v or max(v) < 0.25:
                todo.append((r.det_id, p, None))
            elif sum(x > max(v) * 0.9 for x in v) > 1 or int(np.argmax(v)) in taken:
                out[r.det_id] = None
            else:
                taken.add(int(np.argmax(v)))
                todo.append((r.det_id, p, order[int(np.argmax(v))]))
        for d, p, t in todo:
            if t is None:
                t, nxt = nxt, nxt + 1
                tracks[t] = []
            tracks[t].append((f, p, d))
            out[d] = t
        for t in list(tracks):
            if f - tracks[t][0][0] + 1 >= buffer:
                if len(tracks[t]) < least:
                    del tracks[t]
                else:
                    flushed.append((t, f, len(tracks[t])))
                    tracks[t] = tracks[t][-1:]
    return out, flushed


@pytest.mark.parametrize("chunk", [20_000, 90])
def test_strict_tracking_and_buffers(spark, chunk):
    pdf = clip(3)
    df = spark.createDataFrame(pdf)
    want, flushed = strict_model(pdf)
    assert {r.det_id: r.tid for r in tk.track_strict(df, chunk=chunk).collect()} == want
    got = tk.flush_buffers(df, chunk=chunk).filter("kind = 'flush'").groupBy("tid", "flush_frame").count().collect()
    assert sorted((r.tid, r.flush_frame, r["count"]) for r in got) == sorted(flushed) and flushed


def entries(tid, flush, lat, n=16, kind="flush"):
    return [("m", kind, tid, flush, flush - i, 0.5 + i / 100, 100.0 + i, lat, 77.0) for i in range(n)]


def test_identity_rules(spark):
    far, metre = 28.8, 1 / 111194.9
    rows = (entries(1, 60, 28.7) + entries(2, 60, far) + entries(1, 120, 28.7 + 30 * metre)     # a continuing track keeps its identity
            + entries(1, 200, 28.7, 1, "delete") + entries(3, 260, 28.7 + 29 * metre) + entries(4, 260, far + 5.001 * metre)
            + entries(5, 400, 28.9) + entries(6, 400, 28.9) + [("m", "delete", t, 450, 450, None, None, None, None) for t in (5, 6)] + entries(7, 500, 28.9))
    df = spark.createDataFrame(rows, "mission_id string, kind string, tid bigint, flush_frame bigint, frame bigint, conf double, sharpness double, lat double, lon double")
    for parts in (1, 5):
        got = {(r.tid, r.flush_frame): (r.gid, r.event) for r in ip.assign_identities(df.repartition(parts)).collect()}
        assert got[(1, 60)] == (1, "new") and got[(2, 60)] == (2, "new") and got[(1, 120)] == (1, "merge")
        assert got[(4, 260)] == (4, "new") or got[(4, 260)] == (3, "new")       # the live identity 2 is excluded, and 5 m is no match
        assert {got[(5, 400)][1], got[(6, 400)][1]} == {"new"}                  # two at once are compared with stored ones only
        assert got[(7, 500)] == (None, "unassigned")                            # two matches leave the buffer out


def plain_identities(pdf):
    """All buffers of a mission in order against all identities."""
    model, out = ip.ByPlace(), []
    for flush, part in pdf.groupby("flush_frame", sort=True):
        rows = []
        for (kind, tid), e in part.groupby(["kind", "tid"], sort=True):
            g = ip.gallery(e.sort_values("frame")[["frame", "conf", "sharpness", "lat", "lon"]].to_numpy(float)) if kind == "flush" else np.empty((0, 5))
            rows.append((kind, tid, g, ip.place(g) if len(g) else None))
        out += model.decide(flush, rows)
    return {(r[1], r[0]): (None if r[2] is None else r[2] + 1, *r[3:]) for r in out}


def test_components_decide_as_one_pass_and_rounds_do_not_grow(spark, monkeypatch):
    from aerotrace.operators import clusters, ordered, runtime

    rounds = []
    for module in (ip, clusters, ordered):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", lambda d: (rounds.append(1), runtime.cut(d))[1])
    used = {}
    for buffers in (60, 600):  # ten times as long a mission
        rng, rows = np.random.default_rng(8), []
        homes = rng.uniform(0, 0.01, (30, 2))
        for k in range(buffers):
            tid, home = k // 2 + 1, homes[rng.integers(30)] if k % 2 == 0 else home
            for i in range(4):
                at = home + rng.normal(scale=1e-6, size=2)
                rows.append(("m", "flush", tid, 60 * k, 60 * k - i, 0.5 + i / 10, 50.0 + i, float(28 + at[0]) if rng.random() < 0.9 else None, float(77 + at[1])))
            if k % 2:
                rows.append(("m", "delete", tid, 60 * k + 30, None, None, None, None, None))
        pdf = pd.DataFrame(rows, columns=["mission_id", "kind", "tid", "flush_frame", "frame", "conf", "sharpness", "lat", "lon"])
        df = spark.createDataFrame(rows, "mission_id string, kind string, tid bigint, flush_frame bigint, frame bigint, conf double, sharpness double, lat double, lon double")
        rounds.clear()
        got = {(r.tid, r.flush_frame): (r.gid, r.event, r.n, r.lat, r.lon) for r in ip.assign_identities(df).collect()}
        used[buffers] = len(rounds)
        assert got == plain_identities(pdf) and len({g[0] for g in got.values()}) > 20
    assert used[600] <= used[60] + 4  # the component search may take a contraction more


def test_weighted_cloud_equals_all_points():
    rng = np.random.default_rng(1)
    pts, cloud = np.empty((0, 2)), ip.Cloud()
    for _ in range(6):
        new = np.round(rng.uniform(0, 0.0005, (9, 2)), 4) + [28, 77]
        cloud.add(new)
        pts = np.vstack((pts, new))
        cost = ip.arcs(pts, pts).sum(1)
        np.testing.assert_allclose(ip.arcs(cloud.centre()[None], pts).sum(), cost.min())
        np.testing.assert_allclose(cloud.weight.sum(), len(pts))


def test_throttle_matches_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"mission_id": "m", "t": np.concatenate([np.arange(0, 60, 0.1), 60 + np.sort(rng.uniform(0, 60, 400))])})
    kept, last = [], None
    for t in pdf["t"]:
        if last is None or t - last >= 0.25:
            kept.append(t)
            last = t
    got = sorted(r.t for r in tk.throttle(spark.createDataFrame(pdf), 4.0, width=3.0).collect())
    assert got == kept


def test_fusion_agrees_with_a_loop(spark):
    from aerotrace.operators import detections as dt

    rng = np.random.default_rng(2)
    base = rng.uniform(0, 300, (5, 2))
    rows = []
    for f in range(6):
        for k in range(14):
            x, y = base[k % 5] + rng.normal(scale=4, size=2)
            rows.append(("m", f, k, x, y, x + 40, y + 50, float(np.round(rng.uniform(0.05, 0.9), 3)), "person", int(rng.integers(1, 5))))
    pdf = pd.DataFrame(rows, columns=["mission_id", "frame", "det_id", "x1", "y1", "x2", "y2", "conf", "label", "cover"])
    got = dt.fuse_boxes(spark.createDataFrame(pdf)).toPandas()
    for f, g in pdf.groupby("frame"):
        g = g.sort_values(["conf", "det_id"], ascending=[False, True])
        used, want = set(), []
        for i in g.index:
            if i in used:
                continue
            mem = [j for j in g.index if j not in used and iou(g.loc[i, ["x1", "y1", "x2", "y2"]].tolist(), g.loc[j, ["x1", "y1", "x2", "y2"]].tolist()) >= 0.55]
            used |= set(mem)
            m = g.loc[mem]
            rest = max(m.conf[m.conf >= 0.2].sum() - m.conf.max(), 0) * 2.0 / max(max(m.cover.iloc[0], 1) - 1, 1)
            p = m.conf.max() if m.conf.max() < 0.15 else m.conf.max() + (1 - m.conf.max()) * (1 - np.exp(-0.55 * rest))
            want.append(((m.x1 * m.conf).sum() / m.conf.sum(), min(p, 0.999), len(m)))
        have = got[got.frame == f]
        np.testing.assert_allclose(sorted(want), sorted(zip(have.x1, have.conf, have.n_views)))
