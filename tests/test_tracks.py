from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drovera.operators import anomaly as A
from drovera.operators import tracks as T
from drovera.session import sized

TR = "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, track_id BIGINT, cx DOUBLE, cy DOUBLE"
KF = "flight_id BIGINT, frame_id BIGINT, kf_seq BIGINT, ts_us BIGINT, h ARRAY<DOUBLE>"


def herd(seed, keyframes=60, n_tracks=7, stride=6, p=0.75):
    """Random visibility; also keyframes nobody is seen in."""
    rnd = random.Random(seed)
    rows, kf = [], []
    for f in (1, 2):
        for k in range(keyframes):
            h = rnd.choice([None, [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 0, 3, 0, 1, -2, 0, 0, 1], [1.01, 0.01, 2, 0, 0.98, 1, 1e-5, 2e-5, 1]])
            kf.append((f, k * stride + f, k, k * 1000, h and [float(v) for v in h]))
            if rnd.random() < 0.05:
                continue
            for t in range(n_tracks if f == 1 else 2):
                if rnd.random() < p:
                    rows.append((f, k * stride + f, k, t, float(rnd.randint(0, 40)), float(rnd.randint(0, 30))))
    return rows, kf


def warp(h, x, y):
    if h is None:
        return x, y
    d = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / d, (h[3] * x + h[4] * y + h[5]) / d


def brute(rows, kf, max_age, k_near, size):
    """Per-keyframe simulation: (flight, kf, track) -> (visible, features, consecutive rows so far)."""
    out = {}
    for f in sorted({r[0] for r in kf}):
        live = {}
        for _, _, k, _, h in [x for x in kf if x[0] == f]:
            now = sorted((r[3], r[4], r[5]) for r in rows if r[0] == f and r[2] == k)
            vel = {}
            for t, x, y in now:
                old = live.get(t)
                if old and k - old["seen"] - 1 <= max_age:
                    wx, wy = warp(h, *old["at"])
                    vel[t] = (x - wx, y - wy)
                else:
                    vel[t] = (0.0, 0.0)
                    live.pop(t, None)
            for t, x, y in now:
                d = sorted(((x - u) ** 2 + (y - v) ** 2, s, u, v) for s, u, v in now if s != t)[:k_near]
                vx, vy = vel[t]
                sp = math.hypot(vx, vy)
                if d:
                    m = lambda g: sum(map(g, d)) / len(d)
                    feat = [vx, vy, vx - m(lambda q: vel[q[1]][0]), vy - m(lambda q: vel[q[1]][1]), sp,
                            sp - m(lambda q: math.hypot(*vel[q[1]])), x - m(lambda q: q[2]), y - m(lambda q: q[3]), m(lambda q: math.sqrt(q[0]))]
                else:
                    feat = [vx, vy, 0, 0, sp, 0, 0, 0, 0]
                run = live[t]["run"] if t in live else 0
                live[t] = {"seen": k, "at": (x, y), "feat": [v / size for v in feat], "run": run}
            for t in list(live):
                if k - live[t]["seen"] > max_age:
                    del live[t]
                    continue
                live[t]["run"] += 1
                out[f, k, t] = (live[t]["seen"] == k, live[t]["feat"], live[t]["run"])
    return out


@pytest.mark.parametrize("seed,max_age,one_level", [(1, 3, 64), (2, 0, 2), (3, 1, 0)])
def test_features_and_bridging_match_a_simulation(spark, seed, max_age, one_level):
    rows, kf = herd(seed)
    tr, k = spark.createDataFrame(rows, TR), spark.createDataFrame(kf, KF)
    v = T.world_velocity(tr, k, max_age=max_age, block=8)
    f = T.knn_features(v, k=3, width=64, height=36, one_level=one_level)
    b = T.bridge_gaps(f, k, max_age=max_age, block=8).collect()
    want = brute(rows, kf, max_age, 3, 64)
    assert len(b) == len(want)
    for r in b:
        visible, feat, _ = want[r.flight_id, r.kf_seq, r.track_id]
        assert r.is_visible == visible
        np.testing.assert_allclose([r[c] for c in T.FEATURES], feat, atol=1e-5)
        assert r.frame_id == r.kf_seq * 6 + r.flight_id


def test_segments(spark):
    rows, _ = herd(4, p=0.4)
    got = {(r.flight_id, r.kf_seq, r.track_id): r.segment
           for r in T.track_segments(spark.createDataFrame(rows, TR), max_age=1, block=8).collect()}
    last = {}
    for f, _, k, t, *_ in sorted(rows, key=lambda r: r[2]):
        pk, seg = last.get((f, t), (-99, 0))
        seg += k - pk - 1 > 1
        assert got[f, k, t] == seg
        last[f, t] = (k, seg)


def test_nearest_by_cells_in_a_dense_cluster(spark):
    rng = np.random.default_rng(7)
    pts = np.r_[rng.normal(100, 0.4, (300, 2)), rng.random((60, 2)) * 1200, np.tile([[5.0, 5.0]], (40, 1)), [[1279.0, 719.0]]]
    rows = [(1, 0, 0, i, float(x), float(y), float(i % 7), float(i % 5)) for i, (x, y) in enumerate(pts)]
    df = spark.createDataFrame(rows, TR + ", vx DOUBLE, vy DOUBLE")
    check_neighbours(T.knn_features(df, k=5), rows)
    check_neighbours(T.knn_features(df, k=5, one_level=1000), rows)


def check_neighbours(features, rows, k=5):
    """Against a brute force: all distances of a track, sorted by (distance, id)."""
    got = {r.track_id: [r[c] for c in T.FEATURES] for r in features.collect()}
    assert len(got) == len(rows)
    p, v = (np.array([[np.nan if x is None else x for x in r[a:a + 2]] for r in rows], float) for a in (4, 6))
    ok = np.isfinite(p).all(axis=1)
    ids, speed = np.array([r[3] for r in rows]), np.hypot(*v.T)
    for i in range(0, len(rows), max(1, len(rows) // 800)):
        want = [*v[i], 0, 0, speed[i], 0, 0, 0, 0]
        with np.errstate(invalid="ignore"):
            d2 = np.where(ok & (ids != ids[i]), ((p - p[i]) ** 2).sum(axis=1), np.inf)
        if ok[i] and np.isfinite(d2).any():
            near = np.lexsort((ids, d2))[: min(k, int(np.isfinite(d2).sum()))]
            want = [*v[i], *(v[i] - v[near].mean(axis=0)), speed[i], speed[i] - speed[near].mean(),
                    *(p[i] - p[near].mean(axis=0)), np.sqrt(d2[near]).mean()]
        np.testing.assert_allclose(got[int(ids[i])], np.array(want) / 1280, rtol=1e-5, atol=1e-5)


@pytest.mark.parametrize("n", [1, 3, 600, 50_000])
def test_neighbours_in_keyframes_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    rows = [(1, 0, 0, i, float(x), float(y), float(i % 7), float(i % 5)) for i, (x, y) in enumerate(rng.random((n, 2)) * 3000)]
    check_neighbours(T.knn_features(spark.createDataFrame(rows, TR + ", vx DOUBLE, vy DOUBLE"), k=5), rows)


def test_tiles_settle_even_keyframes_and_leave_bunched_and_lonely_tracks_open(spark):
    rng = np.random.default_rng(3)
    even = [(1, 0, 0, i, float(x), float(y), 1.0, 2.0) for i, (x, y) in enumerate(rng.integers(0, [1280, 720], (6000, 2)))]
    lump = [(1, 0, 1, i, 500 + float(x), 500 + float(y), 1.0, 2.0) for i, (x, y) in enumerate(rng.normal(0, 0.5, (3000, 2)))]
    lump += [(1, 0, 1, 5000 + i, 1270.0 - 300 * i, 700.0, 1.0, 2.0) for i in range(4)]
    df = spark.createDataFrame(even + lump, TR + ", vx DOUBLE, vy DOUBLE")
    done, left = T._in_tiles(df, ["flight_id", "kf_seq"], ["frame_id"], 5)
    open_rows = [(r.kf_seq, r.track_id) for r in left.collect()]
    assert done.count() + len(open_rows) == 9004 and len(set(open_rows)) == len(open_rows)
    assert sum(k == 0 for k, _ in open_rows) <= 6 and {(1, 5000), (1, 0)} <= set(open_rows)
    features = T.knn_features(df, k=5)
    check_neighbours(features.filter("kf_seq = 0"), even)
    check_neighbours(features.filter("kf_seq = 1"), lump)


def test_each_tile_is_searched_once(spark, tmp_path, monkeypatch):
    search, log = T._tile_search, str(tmp_path / "calls")

    def counted(*args):
        work = search(*args)

        def logged(table):
            with open(log, "a") as f:
                f.write("x")
            return work(table)

        return logged

    monkeypatch.setattr(T, "_tile_search", counted)
    rng = np.random.default_rng(5)
    rows = [(1, 0, 0, i, float(x), float(y), 1.0, 2.0) for i, (x, y) in enumerate(rng.integers(0, 500, (200, 2)))]
    df = spark.createDataFrame(rows, TR + ", vx DOUBLE, vy DOUBLE")
    assert len(T.knn_features(df, k=5, one_level=0).collect()) == 200
    assert (tmp_path / "calls").read_text() == "x"


@pytest.mark.parametrize("one_level", [0, 64])
def test_neighbours_of_far_and_unknown_positions(spark, one_level):
    xs = [1_048_560.0 + 7 * i for i in range(12)] + [-3e9, 4e12, float("nan"), None, float("inf")]
    rows = [(1, 0, 0, i, x, 5.0, 1.0, float(i)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, TR + ", vx DOUBLE, vy DOUBLE")
    check_neighbours(T.knn_features(df, k=5, one_level=one_level), rows)


def test_neighbours_need_no_job_to_be_planned(spark):
    df = spark.range(9).selectExpr("1L flight_id", "0L frame_id", "0L kf_seq", "id track_id", "id * 1d cx", "0d cy", "0d vx", "0d vy")
    spark.sparkContext.setJobGroup("plan", "plan")
    T.knn_features(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext.setJobGroup("rest", "rest")


@pytest.mark.parametrize("length,window,duration,both", [(3, 4, 3, False), (2, 5, 2, True), (1, 1, 1, False)])
def test_states_and_events_match_a_simulation(spark, length, window, duration, both):
    rows, kf = herd(5, keyframes=90, p=0.85)
    kf = [r for r in kf if r[0] == 1]
    rows = [r for r in rows if r[0] == 1]
    sim = brute(rows, kf, 2, 3, 64)
    rnd = random.Random(9)
    score = {}
    for key in sorted(sim, key=lambda q: (q[2], q[1])):
        f, k, t = key
        base = 4.0 if (k // 11 + t) % 2 else 1.0
        score[key] = (base + rnd.random(), 2 * base + rnd.random() - (t == 3) * 20)
    data = [(f, t, k, k * 6 + 1, k * 1000, sim[f, k, t][0], *score[f, k, t]) for f, k, t in sim]
    df = spark.createDataFrame(data, "flight_id BIGINT, track_id BIGINT, kf_seq BIGINT, frame_id BIGINT, ts_us BIGINT, is_visible BOOLEAN, ae DOUBLE, soc DOUBLE")
    st = A.score_states(df, length=length, window=window, min_duration=duration, require_both=both, block=16)
    ev = A.anomaly_events(st, spark.createDataFrame(kf, KF), min_duration=duration, block=16)
    got = {(r.flight_id, r.kf_seq, r.track_id): r for r in st.collect()}

    done, live, hist = [], {}, {}
    last_kf = max(r[2] for r in kf)
    for k in range(last_kf + 1):
        for t in range(7):
            key = (1, k, t)
            if key not in sim:
                hist.pop(t, None)
                if t in live:
                    done.append(live.pop(t))
                continue
            r = got[key]
            eligible = sim[key][2] >= length
            assert r.eligible == eligible
            if not eligible:
                assert r.state == "unscored" and r.ae_smooth is None
                hist.pop(t, None)
                if t in live:
                    done.append(live.pop(t))
                continue
            h = hist.setdefault(t, [])
            h.append(score[key])
            del h[:-window]
            a, s = (sum(v[i] for v in h) / len(h) for i in (0, 1))
            assert r.ae_smooth == pytest.approx(a) and r.soc_smooth == pytest.approx(s)
            up = (a > 2.75, s > 5.0)
            if all(up) if both else any(up):
                frame = k * 6 + 1
                if t not in live:
                    live[t] = {"t": t, "k0": k, "f0": frame, "n": 0, "ma": a, "ms": s, "as": [], "ups": set()}
                e = live[t]
                e["n"] += 1
                if e["n"] > 1:
                    span = frame - e["f0"] + 1
                    e["ma"] += (a - e["ma"]) / span
                    e["ms"] += (s - e["ms"]) / span
                e["k1"] = k
                e["as"].append((a, s))
                e["ups"] |= {n for n, u in zip(("ae", "social"), up) if u}
            elif t in live:
                done.append(live.pop(t))
            sure = t in live and live[t]["n"] >= duration
            kind = "both" if all(up) else "ae" if up[0] else "soc"
            assert r.state == ("ok" if not any(up) else f"{'confirmed' if sure else 'elevated'}_{kind}")
    want = {(e["t"], e["k0"]): (e, False) for e in done if e["n"] >= duration}
    want |= {(e["t"], e["k0"]): (e, True) for e in live.values()}
    events = ev.collect()
    assert {(r.track_id, r.start_kf) for r in events} == set(want)
    assert any(r.end_kf // 16 > r.start_kf // 16 for r in events)  # some cross a block border
    for r in events:
        e, is_open = want[r.track_id, r.start_kf]
        assert (r.end_kf, r.keyframe_count, r.is_open) == (e["k1"], e["n"], is_open)
        assert r.triggered_by == ("both" if len(e["ups"]) == 2 else e["ups"].pop())
        assert r.mean_ae == pytest.approx(e["ma"]) and r.mean_social == pytest.approx(e["ms"])
        assert r.avg_ae == pytest.approx(np.mean([v[0] for v in e["as"]]))
        assert r.max_social == pytest.approx(max(v[1] for v in e["as"]))


@pytest.mark.parametrize("alpha", [0.042, 0.95, 1.0])
def test_herd_ema_across_blocks(spark, alpha):
    rng = np.random.default_rng(3)
    n = 900
    counts, x = rng.integers(3, 9, n), rng.random((n, 2))
    counts[:4] = 2
    rows = [(1, i, int(counts[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    df = spark.createDataFrame(rows, "flight_id BIGINT, kf_seq BIGINT, n_tracks BIGINT, mean_a DOUBLE, var_a DOUBLE")
    got = {r.kf_seq: r for r in A.herd_ema(df, alpha=alpha, cols=("a",), block=50).collect()}
    state, updates = None, 0
    for i in range(n):
        if counts[i] >= 5:
            state = x[i] if state is None else (1 - alpha) * state + alpha * x[i]
            updates += 1
        assert got[i].n_updates == updates
        if state is None:
            assert got[i].mean_a is None
        else:
            np.testing.assert_allclose([got[i].mean_a, got[i].var_a], state, atol=1e-12)


def test_social_score_waits_for_warm_statistics(spark):
    f = spark.createDataFrame([(1, k, t, float(t), 1.0) for k in range(4) for t in range(5)],
                              "flight_id BIGINT, kf_seq BIGINT, track_id BIGINT, a DOUBLE, b DOUBLE")
    batches = A.herd_batch_stats(f, cols=("a", "b"))
    ema = A.herd_ema(batches, cols=("a", "b"))
    s = A.social_score(f, ema, cols=("a", "b"), min_updates=3).collect()
    assert all((r.soc == 0.0) == (r.kf_seq < 2 or r.track_id == 2) for r in s)
    assert next(r.soc for r in s if r.kf_seq == 3 and r.track_id == 4) == pytest.approx(2 / math.sqrt(2 + 1e-8))


def test_interpolation_groups(spark):
    # 0,1 before the first keyframe; group of 2; group of 0; no common tracks; tail
    flags = [0, 0, 1, 0, 0, 1, 1, 0, 1, 0]
    frames = spark.createDataFrame([(1, i * 2, i, bool(k)) for i, k in enumerate(flags)], "flight_id BIGINT, frame_id BIGINT, ts_us BIGINT, is_keyframe BOOLEAN")
    box = lambda f, t, x: (1, f, t, x, 0.0, x + 10, 5.0, 0.5 + t / 10, t)
    tr = [box(4, 1, 0.0), box(4, 2, 50.0), box(10, 1, 30.0), box(10, 3, 9.0), box(12, 7, 1.0), box(16, 8, 2.0)]
    tracks = spark.createDataFrame(tr, "flight_id BIGINT, frame_id BIGINT, track_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, confidence DOUBLE, class_id INT")
    got = sorted((r.frame_id, r.track_id, r.x1 and round(r.x1, 6), r.confidence) for r in T.interpolate_tracks(frames, tracks, block=3).collect())
    assert got == [(6, 1, 10.0, 0.6), (8, 1, 20.0, 0.6), (14, None, None, None)]
    tail = [r for r in T.interpolate_tracks(frames, tracks, flush_tail=True, block=3).collect() if r.frame_id == 18]
    assert [(r.track_id, r.x1) for r in tail] == [(8, 2.0)]


def test_keyframes_count_arrivals(spark):
    ids = [3, 4, 9, 20, 21, 22, 40]
    df = spark.createDataFrame([(1, i) for i in ids], "flight_id BIGINT, frame_id BIGINT")
    got = {r.frame_id: (r.is_keyframe, r.kf_seq) for r in T.keyframe_sampling(df, skip=2, block=5).collect()}
    assert got == {f: (i % 3 == 0, i // 3) for i, f in enumerate(ids)}


def test_tracks_are_not_shuffled_for_the_sizes_of_their_keyframes(spark):
    rows = [(1, kf, 6 * kf, t, float(37 * t % 1280), float(91 * t % 720), 1.0, 0.0) for kf in range(3) for t in range(300)]
    df = spark.createDataFrame(rows, "flight_id long, kf_seq long, frame_id long, track_id long, cx double, cy double, vx double, vy double")
    df = df.crossJoin(spark.range(1 << 20).filter("id = 5")).drop("id")  # Spark takes these tracks for large
    shuffles = lambda f: f._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(flight_id")
    extents = sized(T.keyframe_extents(df))
    assert extents.select("_n", "_held").distinct().collect() == [(300, 300)]
    given = T.knn_features(df, extents=extents)
    assert shuffles(given) < shuffles(T.knn_features(df))
    assert sorted(given.collect()) == sorted(T.knn_features(df).collect())
