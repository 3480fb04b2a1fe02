"""The corpus operators against brute force, the tokenizer library and DuckDB."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from drovera.llm import brown, components, decontam, hostrules, licenses, linededup, merkle, packing, quality, queries, simhash, tokens
from drovera.llm.bpe import WordBpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def frame(spark, texts, ids=None, extra=False):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
    out = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("fp", "node", "bucket", "h1", "rid", "uid", "word", "score", "shard", "keeper", "label", "host"):
            out = out.withColumn(name, F.lit("clash"))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(60)]
    base = [prose(rng, 300) for _ in range(3)]
    for t in base:  # near copies, from one word changed to twelve
        for k in range(40):
            w = t.split()
            for _ in range(k % 12):
                w[rng.randrange(len(w))] = "Z"
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "A b", "a  B"] + texts[:5]
    got = {r.doc_id: r for r in simhash.simhash_groups(frame(spark, texts)).collect()}

    def print_of(t):
        w = words_of(lower(t))
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [print_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(texts)
    for i, fp in enumerate(fps):
        assert got[i].fingerprint == f"{fp:016x}"
        assert got[i].component_id == find(i)


def test_dense_buckets_lose_no_link(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"))
    rows = links.collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in rows)
    got = dict(components.connected_components(links).collect())
    near = defaultdict(set)
    for a in signed:
        for b in signed:
            if a != b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                near[a].add(b)
    seen = {}
    for a in sorted(near):
        if a in seen:
            continue
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = a
                todo += near[x]
    assert got == seen


def test_flipped_probes_find_lone_members(spark):
    """28 fingerprints share one part and differ in two bits by pairs: the thresholds leave that part out."""
    rng = random.Random(11)
    shared = rng.getrandbits(22)
    pairs = []
    for _ in range(14):
        p = rng.getrandbits(42) << 22 | shared
        a, b = rng.sample(range(22, 64), 2)
        pairs.append((p, p ^ (1 << a) ^ (1 << b)))
    signed = [[x - (1 << 64) if x >> 63 else x for x in pair] for pair in pairs]
    links = simhash.link_fingerprints(spark.createDataFrame([(x,) for pair in signed for x in pair], "fp long")).collect()
    assert {frozenset(r) for r in links} == {frozenset(pair) for pair in signed}


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(0)
    cost = rng.random((50, 3, 3)).cumsum(axis=2)
    cost[:, :, 0] = 0
    t = simhash.allocate(cost, 3)
    assert ((t + 1).sum(axis=1) == 3).all()
    for row, own in zip(cost, t):
        best = min(row[0, a] + row[1, b] + row[2, c] for a in range(3) for b in range(3) for c in range(3) if a + b + c == 3)
        assert np.isclose(sum(row[i, k + 1] for i, k in enumerate(own)), best)


def test_near_duplicates_find_similar_texts(spark):
    rng = random.Random(9)
    texts = [prose(rng, 250, 5000) for _ in range(150)]
    for i in range(40):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 100 + ["", None, "  "]
    many = texts[1].split()
    for k in range(150):  # a dense group
        w = list(many)
        w[rng.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    got = dict(simhash.near_duplicates(frame(spark, texts)).collect())
    want = {i: i for i in range(150)} | {150 + i: i for i in range(40)} | {i: 0 for i in range(190, 290)}
    want |= {290: 290, 291: 290, 292: 290} | {i: 1 for i in range(293, 443)}
    assert sum(got[i] != want[i] for i in want) == 0


def test_near_duplicates_are_found_by_fingerprint(spark, monkeypatch):
    """Without any bucket the SimHash search alone finds near copies, and the sets decide."""
    whole = simhash.shingle_sets
    rng = random.Random(12)
    texts = [prose(rng, 250, 5000) for _ in range(40)]
    texts += [" ".join([*t.split(), "end"]) for t in texts]
    texts += [" ".join([*texts[0].split(), f"e{k}"]) for k in range(100)]
    prints = [simhash.majority_bits(simhash.shingle_digests(t.encode(), 5, distinct=True)) for t in texts]
    near = [i for i in range(40) if (prints[i] != prints[40 + i]).sum() <= 2]
    assert len(near) > 10
    monkeypatch.setattr(simhash, "shingle_sets", lambda *a: whole(*a).withColumn("buckets", F.array().cast("array<long>")))
    got = dict(simhash.near_duplicates(frame(spark, texts)).collect())
    assert all(got[40 + i] == got[i] == i for i in near) and all(got[i] == i for i in range(40))
    monkeypatch.setattr(simhash, "shingle_sets", lambda *a: whole(*a).withColumns({"buckets": F.array().cast("array<long>"), "fp": F.lit(5).cast("long")}))
    got = dict(simhash.near_duplicates(frame(spark, texts[:40])).collect())
    assert got == {i: i for i in range(40)}


def test_near_duplicates_with_passages_near_the_limit(spark):
    """Passages put in or taken out: shingle similarity 400/499 or 400/500 is a near copy, 400/501 is none."""
    texts = []
    for k in range(120):
        word = iter(f"p{k}w{i}" for i in range(505))
        own = [next(word) for _ in range(404)]
        other = own + [next(word) for _ in range((99, 100, 101, 101)[k % 4])]
        texts += [" ".join(x) for x in ((own, other) if k % 3 else (other, own))]
    got = dict(simhash.near_duplicates(frame(spark, texts)).collect())
    assert got == {i: i - (i % 2 if i // 2 % 4 < 2 else 0) for i in range(240)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_line_runs_compact(spark):
    line = "x" * 45
    texts = [f"  {line.upper() if i % 2 else line}\t\nown line {i}\n{line}" for i in range(7)] + [f"{'y' * 40}\n"] * 4
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, texts), batches=5).collect()}
    assert [got[i].n_dropped for i in range(11)] == [2] * 6 + [0] * 5
    assert got[0].kept_text == "own line 0" and got[6].kept_text == texts[6] and got[7].n_lines == 2
    runs = linededup.LineRuns(2)
    for k in range(4):
        runs.add(spark.createDataFrame([(k, 1, 1), (k, k + 2, 0)], "doc_id long, h1 long, h2 long"))
    assert runs.frequent(4).collect() == [(1, 1, 3)] and runs.frequent(1).count() == 5


def test_class_model(spark, sample):
    learn = lambda i: queries.remainder(i, 7) != 2
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in brown.score_documents(docs, learn).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in sample}
    tok = {i: [*words_of(lower(r.text)), None] for i, r in sample.items()}
    c = Counter(w for i, t in tok.items() if not held[i] for w in t)
    total = sum(c.values())
    for i, t in tok.items():
        base = sum(np.log10((c[w] + 1) / (total + len(c) + 1)) for w in t)
        assert (got[i].learn, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (not held[i], len(t), sum(c[w] > 0 for w in t), total)
        assert np.isclose(got[i].base_score, base)
    assert sum(got[i].score for i in held if held[i]) > sum(got[i].base_score for i in held if held[i])


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(2)
    n = rng.integers(0, 9, (12, 12)).astype(float)
    cls, k = np.arange(12) % 4, 4
    table_of = lambda cls: np.array([[n[np.ix_(cls == a, cls == b)].sum() for b in range(k)] for a in range(k)])
    table = table_of(cls)
    for u in range(12):
        other = np.arange(12) != u
        right = np.bincount(cls[other], n[u, other], minlength=k)
        left = np.bincount(cls[other], n[other, u], minlength=k)
        to, gain = brown.best_class(right, left, n[u, u], int(cls[u]), table)
        moved = [brown.likelihood(table_of(np.where(np.arange(12) == u, c, cls))) - brown.likelihood(table) for c in range(k)]
        assert np.isclose(gain, max(moved)) and np.isclose(moved[to], gain)


def test_best_classes_agree_with_one_at_a_time():
    rng = np.random.default_rng(5)
    k, m = 4, 30
    n = rng.integers(0, 3, (m, m)).astype(float)
    cls = rng.integers(0, k, m)
    table = np.zeros((k, k))
    np.add.at(table, (cls[:, None], cls[None, :]), n)
    rest = ~np.eye(m, dtype=bool)
    right = np.stack([np.bincount(cls[rest[u]], n[u, rest[u]], minlength=k) for u in range(m)])
    left = np.stack([np.bincount(cls[rest[u]], n[rest[u], u], minlength=k) for u in range(m)])
    right[:3], left[2:4] = 0, 0
    to, gain = brown.best_classes(right, left, n.diagonal().copy(), cls, table)
    for u in range(m):
        want = brown.best_class(right[u], left[u], n[u, u], int(cls[u]), table)
        assert to[u] == want[0] and np.isclose(gain[u], want[1])


def test_rare_words_have_classes_of_their_own(spark):
    """Two words of one ending, length and count: texts that tell them apart by context are not scored alike."""
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        texts.append(" ".join(f"the {rng.choice(['red', 'blue'])} mapxo the {rng.choice(['red', 'blue'])}" for _ in range(3)))
        texts.append(" ".join(f"we {rng.choice(['run', 'go'])} solxo we {rng.choice(['run', 'go'])}" for _ in range(3)))
    texts += ["the red mapxo the blue", "the red solxo the blue", "we run solxo we go", "we run mapxo we go"]
    docs = frame(spark, texts)
    learn = lambda i: i < 120
    got = {r.doc_id: r.score for r in brown.score_documents(docs, learn, classes=4, rate=0.11).collect()}
    assert got[120] > got[121] + 0.1 and got[122] > got[123] + 0.1


def test_model_probabilities_sum_to_one():
    units = brown.Units([b"a", b"b"], np.array([5, 3, 2, 7, 0]), np.array([1, 1, 1, 3, 0]), 17, 6)
    model = brown.smooth(units, np.array([0, 1, 0, 1, 1]), np.array([[4.0, 2.0], [3.0, 8.0]]))
    assert np.allclose((10**model.transition).sum(1), 1)
    word = lambda c, u: 10 ** model.words(np.array([c]), np.array([u]))[0]
    rare = word(4, 3) + word(2, 3) + word(1, 3) + word(0, 3)
    assert np.isclose(word(3, 1) + rare + word(0, 4), 1) and np.isclose(word(5, 0) + word(2, 2), 1)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_tokens_equal_the_library(sample):
    bpe, lib, rng = WordBpe(queries.vocabulary()), library(), random.Random(1)
    alphabet = [*"aAbeinthrsS'dΣςİıßéÉñ 12٣!!==-#\n\t\x0b\x1c\x85\xa0　́​你😀<|>ﬁK\x00_", "<|endoftext|>", "<|startoftext|>", "'re", "aaaa"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [r.text for r in sample.values()] + ["a" * 9000, "=" * 9001, "ab" * 3000 + "abc" * 3000, ""]
    for text, ids in zip(texts, bpe.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_token_memory_is_bounded_by_bytes(sample):
    bpe, lib, rng = WordBpe(queries.vocabulary()), library(), random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1200)) for _ in range(40)]
    texts += [f"{w}{i}, {w}!?" for i in range(40) for w in ("flock", "x" * 50, "Weide")] + [r.text for r in sample.values()][:40]
    bpe.MEMORY, bpe.BATCH, most = 100_000, 5_000, 0
    for text in texts:
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        kept = [c for c in bpe.chunks if len(c) <= bpe.LONGEST]
        assert bpe.held == sum(len(c) + len(bpe.chunks[c]) + bpe._ENTRY for c in kept)
        assert len(bpe.chunks) - len(kept) == len(bpe.passing) <= len(text) and bpe.held <= bpe.MEMORY + 300 * len(text)
        most = max(most, bpe.held)
    assert most > bpe.MEMORY  # it was emptied on the way
    bpe.encode("")
    assert not bpe.passing and all(len(c) <= bpe.LONGEST for c in bpe.chunks)


def test_packing(spark, sample):
    got = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet"), queries.vocabulary()).collect()
    lib, by_doc, by_seq = library(), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, row in sample.items():
        ids = np.array([*lib.encode(row.text, add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(by_doc.pop(i), key=lambda r: r.piece)):
            own = ids[2048 * k : 2048 * k + 2048]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, 2048 * k, len(own), zlib.crc32(own.tobytes()))
        assert 2048 * (k + 1) >= len(ids)
    assert not by_doc
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in got) // 2048) + 2


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    rng = random.Random(4)
    sizes = {i: rng.randrange(1, 700) for i in range(1000)}
    got = packing.pack_items(spark.createDataFrame(list(sizes.items()), "rid long, length int")).collect()
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += sizes[r.rid]
    assert len({r.rid for r in got}) == len(got) == 1000 and max(fill.values()) <= 2048
    assert len(fill) <= -(-sum(sizes.values()) // 2048) + 3


def edits(a, b):
    """Least edit distance of ``a`` to a part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1)
    return min(row)


def test_leaks_against_edit_distance(spark):
    rng = random.Random(8)
    letters = "abcdefgh "
    items = ["".join(rng.choice(letters) for _ in range(rng.randrange(50, 120))) for _ in range(6)] + ["short", "", None, "What is the capital of France?", "new york"]
    texts = []
    for k in range(60):
        body = list(decontam.normal(items[k % 6]))
        for _ in range(rng.randrange(14)):
            at = rng.randrange(len(body))
            body[at : at + 1] = rng.choice([[], ["z"], ["z", body[at]]])
        texts.append(prose(rng, 20) + " " + "".join(body).upper() + "! " + prose(rng, 20))
    texts += [None, "", "short", "Quiz: what is\nthe capital of FRANCE? Paris.", "thewhat is the capital of france", "new york"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.find_leaks(frame(spark, texts), bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            n = decontam.normal(item)
            if len(n) >= decontam.MIN_BYTES and (d := edits(n, decontam.normal(t))) <= int(len(n) * decontam.ERROR_RATE):
                want[i, j] = d
            elif decontam.MIN_WORDS <= len(n.split()) and f" {n} " in f" {decontam.normal(t)} ":
                want[i, j] = 0
    assert (63, 9) in want and (64, 9) not in want and got == want and 5 < len(want) < 60
    flags = frame(spark, texts).select("doc_id", decontam.contaminated(bench, F.col("text")).alias("hit")).collect()
    assert {r.doc_id for r in flags if r.hit} == {i for i, _ in want}


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) >= 0.97 * len(labels)


def test_license_base(spark, sample):
    phrases = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = [r.text for r in sample.values()] + [
        "THE MIT LICENSE the mit license", "the MIT-license", "cc-by... \n\n nc cc by nc", "aThe MIT License é the mit license é", "", None,
        "Apache License, Version 2.0 and Apache License", "SPDX-License-Identifier: LGPL-2.1-or-later", "licensed under the Affero General Public License v3",
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        at = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        want = (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert {x for _, x in at} <= set(got[i].labels.split(",")) and 0 <= got[i].score <= 1
    assert got[len(texts) - 2].labels == "lgpl" and got[len(texts) - 1].labels == "agpl-3"
    assert len(licenses.rules()) > 300


def test_license_places_of_a_text_with_many_matches(spark):
    n = 64_000
    began = time.monotonic()
    row = licenses.scan_licenses(frame(spark, ["the mit license\n" * n + "cc by nc"])).first()
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (3 * n + 3, n + 1, 0, 3 * n)
    assert (row.base_labels, row.labels) == ("cc-by-nc,mit", "cc-by-nc,mit")
    assert time.monotonic() - began < 60


def test_short_license_names_and_bodies(spark):
    want = {
        "// SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: ISC": "isc", "# SPDX-License-Identifier: MPL-2.0": "mpl-2",
        "SPDX-License-Identifier: EPL-2.0": "epl-2", "SPDX-License-Identifier: Zlib": "zlib", "SPDX-License-Identifier: (MIT OR Apache-2.0)": "apache-2,mit",
        "SPDX-License-Identifier: BSL-1.0": "boost", "SPDX-License-Identifier: OFL-1.1": "ofl", "Licensed under MIT.": "mit", "released under the ISC": "isc",
        "dual licensed MIT/Apache-2.0": "apache-2,mit", "licensed under the GPL": "gpl", '{"license": "MIT"}': "mit", "SPDX-License-Identifier: Python-2.0": "python",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "In no event will the authors be held liable for any damages arising from the use of this software.": "zlib",
        "She studied at MIT and read the ISC notes.": "", "the commit was under review at zlib": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(frame(spark, list(want))).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


def test_rules_of_documents(spark, sample):
    texts = [r.text for r in sample.values()] + ["a b c d e f g h i " * 4, "x\nx\n \n \nx", "é# <|>", "", None, "one\x1cword\x85here " * 30]
    got = {r.doc_id: r for r in hostrules.apply_host_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, t = words_of(t), t or ""
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if many[x] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t))
        assert (r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(lines) - len(set(lines)), len(covered), failed)
        assert r.kept <= (not failed)


def test_bad_host_goes_and_small_host_is_shrunk(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "a b " * 40
    rows = [(i, good, "ok") for i in range(200)] + [(1000 + i, bad, "spam") for i in range(190)] + [(1190 + i, good, "spam") for i in range(10)]
    rows += [(2000, bad, "tiny"), (2001, good, "tiny"), (2002, good, None)]
    got = {r.doc_id: r.kept for r in hostrules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(200)) and got[2001] and got[2002]


def test_merkle_audit_and_warc(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 7)) for i in range(3000)] + [(5, "http://h/5", "again"), (None, None, None)]
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    good = pages.select("id", merkle.record_bytes(F.col("url"), F.col("html")).alias("record"))
    other = good.where("id is null or id not in (17, 2999)").withColumn(
        "record", F.when(F.col("id").isin(5, 1024), F.concat("record", F.lit("!"))).otherwise(F.col("record"))
    ).unionAll(spark.createDataFrame([(4000, "new")], "id long, record string"))
    got = {r.id: r for r in merkle.audit(good, other).collect()}
    assert {i: r.status for i, r in got.items()} == {5: "changed", 1024: "changed", 17: "missing", 2999: "missing", 4000: "extra"}
    sizes = {r.id: 0 for r in good.collect()}
    for r in good.collect():
        sizes[r.id] += len(r.record.encode())
    assert got[17].offset_a == sum(sizes[i] for i in range(17)) and got[1024].offset_a == 0
    assert merkle.audit(good, good).count() == 0 and merkle.audit(good.limit(0), good.limit(0)).count() == 0
    (tmp_path / "a.warc").write_bytes("".join(r.record for r in good.where("id < 5").orderBy("id").collect()).encode() + b"WARC/1.1\r\nContent-Length: 9\r\n\r\ncut")
    read = merkle.read_warc(spark, str(tmp_path / "a.warc")).orderBy("offset").collect()
    assert [r.url for r in read] == [f"http://h/{i}" for i in range(5)] and read[1].block.endswith(b"<p>1</p>")


def _all_operators(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "x" * 60), (None, "y" * 60), (2, None)], "item_id long, text string")
    v = queries.vocabulary()
    return {
        "simhash": simhash.simhash_groups(docs), "near": simhash.near_duplicates(docs), "lines": linededup.dedup_lines(docs),
        "lm": brown.score_documents(docs, lambda i: queries.remainder(i, 7) != 2), "tokens": tokens.count_tokens(docs, v),
        "quality": quality.score_quality(docs, labels, lambda i: F.lit(True)), "packing": packing.pack_documents(docs, v).where("piece = 0"),
        "licenses": licenses.scan_licenses(docs), "rules": hostrules.apply_host_rules(docs),
        "leaks": decontam.find_leaks(docs, bench),
    }


def test_odd_rows(spark):
    long = prose(random.Random(2), 60_000) + "\n" + "z" * 200_000
    texts = [None, "", " ", "same text here", "same text here", long, "only", "é́ ß 你 <|endoftext|>", "same text here"]
    ids = [0, 1, 2, 3, 3, 4, None, 5, None]
    docs = frame(spark, texts, ids, extra=True)
    for name, out in _all_operators(spark, docs).items():
        rows = out.collect()
        if name != "leaks":
            assert Counter(r.doc_id for r in rows) == Counter(ids), name
    empty = frame(spark, [], [], extra=True)
    for name, out in _all_operators(spark, empty).items():
        assert out.count() == 0, name


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = docs.where("doc_id = 0").first().text
    own = frame(spark, [clean, clean, f"{clean[:200]} {item} {clean[300:500]}", "ALL CAPS!! " * 90, None], [10_000, 10_001, 10_002, 10_003, None])
    rows = docs.unionByName(own)
    steps = {}
    for name, step in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        step(spark, rows, SF).write.parquet(out)
        rows = spark.read.parquet(out)
        steps[name] = {r.doc_id for r in rows.select("doc_id").collect()}
        assert name == "best_fit_packing" or rows.columns == docs.columns
    assert 10_003 not in steps["quality_classifier"] and {0, 10_000, 10_002} <= steps["quality_classifier"]
    assert {10_000, 10_001}.isdisjoint(steps["simhash_near_dedup"]) and 0 in steps["simhash_near_dedup"]
    assert 10_002 in steps["simhash_near_dedup"] and 10_002 not in steps["benchmark_decontamination"]
    assert 0 in steps["best_fit_packing"]
