"""Manifest proofs, whitening and personal data against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from drovera.llm import linededup, manifest, pii, pii_examples, queries, store, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASH = ("id", "grp", "pos", "tree", "path", "part", "seq", "place", "size", "x", "c", "d", "n", "spans", "kind", "root", "leaf", "digest")


def clashing(df):
    for name in CLASH:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def run(monkeypatch, query, spark, df):
    monkeypatch.setattr(queries, "table", lambda *_: clashing(df))
    return query(spark, "")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    values = (row[0], row[1], row[2], None if row[3] is None else row[3] + add, row[4])
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha(*found[-1][i : i + 2]) for i in range(0, len(found[-1]), 2)])
    return found


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def proofs(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [levels_of([leaf_of(r) for r in groups[g]]) for g in names]
    top = levels_of([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path_of(trees[k], i) + path_of(top, k)
            h = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for right, s in steps:
                h = sha(s or "", h) if right else sha(h, s or "")
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[k][-1][0], root, sha(*[s for _, s in steps if s]), h, h == root))
    return sorted(out, key=lambda t: tuple((x is not None, x) for x in t))


def some_rows():
    rng = random.Random(4)
    langs = ["en"] * 6 + ["é", None, "à", ""]
    return {
        "none": [],
        "one": [(5, "s", "en", 3, "abc")],
        "nulls": [(None, None, None, None, None)],
        "odd": [(i, "s", "en" if i % 2 else None, i, "t" * i) for i in range(9)]
        + [(None, None, "é", 2**63 - 1, ""), (None, None, "é", 4, ""), (3, "s", "en", 3, "ttt"), (3, "s", "en", 3, "ttt"), (0, "s", "z", 2**63 - 1, "q")],
        "long": [(i, "s", "en", 1, "wörd " * 40_000) for i in range(3)],
        "one group": [(i, "s", "en", 1, "x") for i in range(5)],
        "many groups": [(rng.randrange(2500), "s", rng.choice([*langs, f"g{rng.randrange(30)}"]), i, "t" * (i % 5)) for i in range(2500)],
    }


@pytest.mark.parametrize("name", list(some_rows()))
def test_manifest_proofs(spark, monkeypatch, name):
    rows = some_rows()[name]
    got = run(monkeypatch, queries.op11_merkle_manifest, spark, spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((tuple(r) for r in got), key=lambda t: tuple((x is not None, x) for x in t)) == proofs(rows)


def test_manifest_over_high_trees(spark):
    rows = [(i, "s", random.Random(i).choice(["a", "b", "b", "b", "b"]), 1, "x") for i in range(700)]
    df = spark.createDataFrame(rows, DOCS)
    found = manifest.manifest(df, df.columns, levels=2)  # several rounds of runs, and copies of ancestors
    got = found.select("id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")), manifest.folded(F.col("leaf"), F.col("proof")))
    want = [(*r[:5], r[3]) for r in proofs(rows)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_manifest_sql(spark):
    con = connect(SF)
    assert compare(queries.op11_merkle_manifest(spark, SF), con, queries.ORACLES["op11_merkle_manifest"]) is None


def test_discard_removes_only_own_stages(spark, tmp_path):
    mine, other = store.stage(spark.range(5), "mine"), str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    store.discard(mine, spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 3
    with pytest.raises(Exception, match="(?i)exist|not find|not found"):
        mine.count()


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 24):
        x = rng.integers(-40, 40, (300, d)).astype(float)
        x[50:120] = x[0]
        if d == 5:
            x[:, 2] = x[:, 1]
        s = whitening.Spectrum(d)
        for part in np.array_split(x, 3):  # combined from parts
            own = whitening.Spectrum(d)
            for v, k in zip(*np.unique(part, axis=0, return_counts=True)):
                own.add(v, k)
            s.merge(own)
        scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
        assert np.allclose(s.vectors * s.values @ s.vectors.T, scatter, atol=1e-11 * np.abs(scatter).max())
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-12)
        assert s.count == 300 and np.allclose(s.mean, x.mean(axis=0))


def test_secular_roots_are_exact():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 40):
        d = np.sort(rng.normal(size=k) * 10 ** rng.integers(-6, 6, k).astype(float))
        z = rng.normal(size=k) * 10 ** rng.integers(-3, 3, k).astype(float)
        origin, tau = whitening.secular_roots(d, z, 0.7)
        want = np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z))
        assert np.allclose(origin + tau, want, rtol=1e-9, atol=1e-12 * np.abs(want).max())


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def whitened(rows, k=32):
    """Sign-free brute force: values, shares and the products of projections."""
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)) + 1_000_000 for v in rows])
    n, away = len(x), x - x.sum(axis=0) / len(x)
    e, u = np.linalg.eigh(away.T @ away / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, away @ u, e, (away**2).sum() / n, [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(axis=0)))) for r in x]


@pytest.mark.parametrize("dims, rows", [(40, 200), (3, 50), (5, 4)])
def test_whitening_against_numpy(spark, monkeypatch, dims, rows):
    rng = np.random.default_rng(dims)
    data = [(i, (rng.normal(size=dims) * (1 + np.arange(dims))).tolist()) for i in range(rows)]
    data += [data[0]] * (rows // 2)
    odd = [(None, None), (900, [None] * dims), (901, [float("nan")] * dims), (902, [float("inf")] * dims), (903, [1.0])]
    monkeypatch.setattr(whitening, "BLOCK", 16)
    df = vectors_of(spark, data + odd)
    got = whitening.whiten(clashing(df), block=16).collect()
    n, projected, e, trace, deviation = whitened([v for _, v in data])
    k = min(32, dims)
    assert len(got) == len(data) * k and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    live = e > 1e-9 * trace
    for c in range(1, k + 1):
        values = [by[i][c].whitened for i, _ in data]
        assert abs(by[0][c].explained - e[c - 1] / trace) < 1e-9
        if live[c - 1]:
            want = projected[:, c - 1] / np.sqrt(e[c - 1])
            sign = np.sign(np.dot(values, want))
            assert np.allclose(np.array(values) * sign, want, atol=1e-6)
        else:
            assert all(v is None for v in values)
    assert [by[i][1].deviation for i, _ in data] == deviation
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(clashing(vectors_of(spark, []))).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, []), (2, None)])).collect() == []
    same = whitening.whiten(vectors_of(spark, [(None, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(same, key=lambda r: (r.vec_id or 0, r.component))] == [
        (None, 1, 0, None, None, None), (None, 2, 0, None, None, None), (3, 1, 0, None, None, None), (3, 2, 0, None, None, None)
    ]
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None} and len(huge) == 6


def test_whitening_query(spark):
    got = queries.op12_whitening(spark, SF)
    data = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = got.orderBy("vec_id", "component").collect()
    n, projected, e, trace, deviation = whitened(data)
    found = np.array([r.whitened for r in rows]).reshape(n, 32)
    want = projected / np.sqrt(e)
    assert np.allclose(found * np.sign((found * want).sum(axis=0)), want, atol=1e-8)
    assert [r.deviation for r in rows[::32]] == deviation and rows[0].identity_error < 1e-10


LUHN = lambda g: sum((lambda v: v - 9 * (v > 9))(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(g))) % 10 == 0


def plain_patterns(t):
    o = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    o += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    o += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and LUHN(digits(m))]
    return o + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_patterns_against_plain_expressions():
    rng = random.Random(5)
    for _ in range(5000):
        t = "".join(rng.choice("0123456789..@@ a-+%()é\n") for _ in range(rng.randrange(1, 60)))
        assert pii.patterns(t) == plain_patterns(t)
    for t in ("1" * 200_000, "1.1" * 60_000, "a@" * 60_000, "+1 " + "(" * 60_000, "x" * 200_000 + "@"):
        pii.patterns(t)  # linear


def test_viterbi_and_likelihood_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(1, 5, 6)
        sc, st, s0, y = rng.normal(size=(sizes.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.integers(0, 3, sizes.sum())
        path, a, want = pii.viterbi(sc, sizes, st, s0), 0, 0.0
        for n in sizes.tolist():
            e = sc[a : a + n]
            value = lambda q, e=e, n=n: s0[q[0]] + sum(e[i][q[i]] for i in range(n)) + sum(st[q[i - 1], q[i]] for i in range(1, n))
            ways = list(itertools.product(range(3), repeat=n))
            assert max(ways, key=value) == tuple(path[a : a + n])
            want += value(y[a : a + n]) - np.log(sum(np.exp(value(q)) for q in ways))
            a += n
        f, by_word, by_step, by_start = pii.likelihood(sc, sizes, st, s0, y)
        assert abs(f - want) < 1e-9
        h = 1e-6
        for array, grad, at in ((sc, by_word, (2, 1)), (st, by_step, (1, 2)), (s0, by_start, (0,))):
            old = array[at]
            array[at] = old + h
            assert abs((pii.likelihood(sc, sizes, st, s0, y)[0] - f) / h - grad[at]) < 1e-4
            array[at] = old


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(pii_examples.examples(spark))


def test_field_on_held_out_sentences(model):
    rows = pii_examples.sentences(1500, seed=77)
    hit = made = want = 0
    for (_, spans), got in zip(rows, model.label([t for t, _ in rows])):
        true = set(pii.parse_spans(spans))
        hit, made, want = hit + len(true & set(got)), made + len(got), want + len(true)
    assert hit / made > 0.97 and hit / want > 0.97


def test_personal_data_query(spark, monkeypatch):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rank = ["email", "ip", "card", "phone"]
    for r in queries.op13_pii_crf(spark, SF).collect():
        base = sorted(plain_patterns(texts[r.doc_id]), key=lambda s: (s[1], rank.index(s[0])))
        names = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in rank]
        found = [s for s in r.spans.split(",") if s]
        assert set(names) <= set(found)
        for kind, a, b in pii.parse_spans(",".join(s for s in found if s not in names)):
            value = texts[r.doc_id][a:b]  # only keys, and numbers that run into their neighbours in the patterns
            assert kind == "key" and re.fullmatch("[0-9a-fA-F]{40}", value) or kind in ("card", "phone")


def test_personal_data_in_odd_rows(spark, model):
    long = "word " * 50_000 + "Dr. Anna Keller, a.b@c.de" + " 12" * 40_000
    ids = [1, 1, 2, None, 3, 4]
    texts = ["Mr. Paul Weber paid with 4532015112830366", "Mr. Paul Weber paid with 4532015112830366", None, "", long, "Ünï +1 (555) 555-1234 𝒳 x@y.z"]
    df = clashing(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    got = [(r.doc_id, [(s.kind, s.start, s.end, s.exact) for s in r.spans]) for r in pii.find_personal(df, model).collect()]
    by = {i: s for i, s in got}
    assert len(got) == 6 and by[None] == [] and by[2] == []
    assert by[1] == [("person", 4, 14, False), ("card", 25, 41, True)]
    assert by[4] == [("phone", 4, 21, True), ("email", 24, 29, True)]
    assert ("person", 250_004, 250_015, False) in by[3] and any(k == "email" for k, *_ in by[3])
    assert pii.find_personal(df.limit(0), model).count() == 0
    nothing = pii.fit(spark.createDataFrame([(None, "email:0:3"), ("plain words", None)], "text string, spans string"))
    assert [s.kind for r in pii.find_personal(df.where("doc_id = 1"), nothing).collect() for s in r.spans] == ["card", "card"]


def test_near_duplicate_stage_decides_by_row(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, e = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, e), (None, e), (None, a), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, "s", "en", 1, t) for i, t in rows], DOCS)
    docs = store.stage(docs, "docs")
    step = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = step(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in kept.collect())
    assert got == sorted([(1, a), (2, b), (3, c), (3, e), (4, None)], key=lambda t: (t[0], t[1] or ""))
    assert step(spark, docs.limit(0), SF).count() == 0


def test_steps_free_what_earlier_steps_staged(spark):
    made = []

    def keep(spark, docs, sf_dir):
        made.append(store.stage(docs.withColumn("k", F.lit(len(made))), "inner"))
        return made[-1]

    step = store.chained(keep)
    first = step(spark, spark.range(3), "")
    second = step(spark, first, "")  # not written: its files must stay
    assert second.count() == 3 and made[0].count() == 3
    step(spark, spark.range(1), "")
    for df in made[:2]:
        with pytest.raises(Exception, match="(?i)exist|not find|not found"):
            df.count()
    assert made[2].count() == 1


def test_one_kind_of_label_tells_that_kind():
    from drovera.llm import quality

    x = np.random.default_rng(0).normal(size=(20, quality.FEATURES))
    for kind in (False, True):
        ranking = quality.fit_ranking(x, np.full(20, kind))
        assert ((ranking.score(x) >= quality.CUT) == kind).all()
    assert (quality.fit_ranking(x[:0], np.zeros(0, bool)).score(x) >= quality.CUT).all()


def test_line_runs_of_the_query_are_compacted(spark, monkeypatch):
    kept, add = [], linededup.LineRuns.add
    monkeypatch.setattr(linededup.LineRuns, "add", lambda self, lines: (add(self, lines), kept.append(sorted(k for k, v in self.levels.items() if v))))
    queries.op2_line_dedup(spark, "/root/testdata/sf0.001")
    assert kept[0] == [0] and [0, 1] in kept
