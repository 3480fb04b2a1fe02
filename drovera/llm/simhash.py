"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints are cut into parts of correlated bits. Two fingerprints at distance d or less must, for
any thresholds t_i with sum(t_i + 1) = d + 1, differ by at most t_i in some part i. Each fingerprint
gets its own thresholds: a dynamic programme takes those with the fewest expected candidates, from
histograms of half parts. It then probes its neighbourhood in each part that has a threshold, and
candidates are verified on all bits.

Buckets above ``DENSE`` members never meet pairwise. There a member is listed under every value that
differs from it by one bit or none outside the part: two members are within two bits exactly if they
share such a value, and at most 65 distinct fingerprints share one.

``near_duplicates`` finds candidates by this search and decides by the shingle sets themselves; similar sets
whose fingerprints lie further apart are found by their least digests.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import discard, free_shuffles, stage

BITS = 64
#: Near copies by similarity: buckets of ROWS least shingle digests each. Sets of Jaccard similarity
#: 0.8 share none of them with the chance (1 - 0.8 ** ROWS) ** BANDS, 8 in a million.
BANDS, ROWS = 64, 8
_ODD = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MAX_DISTANCE = 2
PARTS = 3
#: Members from which a bucket is searched by shared neighbours instead of by pairs.
DENSE = 32
_CHUNK = 1 << 14
#: Bits of a half part at most, so that all histograms together have 2 * PARTS * 2^11 cells.
_HALF = 11


def shingle_digests(raw: bytes, n: int, seed: int = 42, distinct: bool = False) -> bytes:
    """XXH64 of each n-word shingle, eight big-endian bytes each; fewer words count as one shingle."""
    words = raw.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return b""
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= n:
        return digest(joined, seed)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    found = [joined[a:b] for a, b in zip((ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
    return b"".join([digest(s, seed) for s in (set(found) if distinct else found)])


def majority_bits(digests: bytes) -> np.ndarray:
    """The 64 bits set in over half the digests, most significant first."""
    count, total = np.zeros(BITS, np.int64), len(digests) // 8
    rows = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for i in range(0, total, _CHUNK):
        count += np.unpackbits(rows[i : i + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return 2 * count > total


def fingerprint(raw: bytes | None, n: int = 3, seed: int = 42) -> int:
    bits = majority_bits(shingle_digests(raw or b"", n, seed))
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """One row ``(doc_id, fp)`` per document; null and wordless texts get 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "fp": np.fromiter((fingerprint(r, ngram) for r in b["raw"]), np.int64, len(b)),
            })

    return rows.mapInPandas(work, "doc_id long, fp long")


def _unpack(fp: pd.Series) -> np.ndarray:
    """0/1 matrix of a column of longs or of equally long arrays of longs."""
    rows = np.stack(fp.to_numpy()) if fp.dtype == object and len(fp) else fp.to_numpy()
    return np.unpackbits(rows.astype(">i8").reshape(len(fp), -1).view(np.uint8), axis=1)


def bit_counts(distinct: DataFrame, size: int = BITS) -> tuple[int, np.ndarray]:
    """Rows, and how many rows have bits i and j both set: size x size numbers whatever the input."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((size, size))
        for b in batches:
            if len(b):
                x = _unpack(b["fp"]).astype(np.float32)
                n, both = n + len(x), both + (x.T @ x)
        i, j = np.divmod(np.arange(size * size), size)
        yield pd.DataFrame({"i": [*i, -1], "j": [*j, -1], "n": [*both.ravel(), float(n)]})

    rows = distinct.select("fp").mapInPandas(work, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both, total = np.zeros((size, size)), 0
    for i, j, n in rows.collect():
        if i < 0:
            total = int(n)
        else:
            both[i, j] = n
    return total, both


def group_bits(total: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    size = len(both)
    left, groups = set(range(size)), []
    for k in range(parts):
        want = (size - sum(map(len, groups))) // (parts - k)
        rest = sorted(left)
        own = [max(rest, key=lambda b: corr[b, rest].sum())]
        while len(own) < want:
            own.append(max((b for b in rest if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        left -= set(own)
        groups.append(own)
    return groups


def _value(bits: np.ndarray, of: list[int]) -> np.ndarray:
    return bits[:, of].astype(np.int64) @ (1 << np.arange(len(of), dtype=np.int64))


def _halves(groups: list[list[int]]) -> list[list[int]]:
    return [h for g in groups for h in (g[: len(g) // 2], g[len(g) // 2 :])]


def half_histograms(distinct: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How often each value of each half part occurs: a bounded number of cells."""
    halves = _halves(groups)
    if max(map(len, halves)) > _HALF:
        raise ValueError("too few parts for bounded histograms")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist = [np.zeros(1 << len(h), np.int64) for h in halves]
        for b in batches:
            if not len(b):
                continue
            bits = _unpack(b["fp"])
            for h, of in zip(hist, halves):
                h += np.bincount(_value(bits, of), minlength=len(h))
        for k, h in enumerate(hist):
            v = np.flatnonzero(h)
            yield pd.DataFrame({"k": k, "v": v, "n": h[v]})

    out = [np.zeros(1 << len(h)) for h in halves]
    for k, v, n in distinct.select("fp").mapInPandas(work, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n")).collect():
        out[k][v] = n
    return out


def _near(hist: np.ndarray) -> np.ndarray:
    """Per value, the count of values one bit away."""
    v = np.arange(len(hist))
    return sum((hist[v ^ (1 << b)] for b in range(len(hist).bit_length() - 1)), np.zeros(len(hist)))


def expected_candidates(bits: np.ndarray, groups: list[list[int]], hist: list[np.ndarray], total: int) -> np.ndarray:
    """(rows, parts, 3): cost of threshold -1, 0 and 1, halves of a part taken as independent.

    A probe itself counts as one candidate.
    """
    cost = np.zeros((len(bits), len(groups), 3))
    near = [_near(h) for h in hist]
    for i, (a, b) in enumerate(zip(_halves(groups)[::2], _halves(groups)[1::2])):
        va, vb = _value(bits, a), _value(bits, b)
        ha, hb, na, nb = hist[2 * i][va], hist[2 * i + 1][vb], near[2 * i][va], near[2 * i + 1][vb]
        cost[:, i, 1] = 1 + ha * hb / max(total, 1)
        cost[:, i, 2] = len(groups[i]) + cost[:, i, 1] + (ha * nb + na * hb) / max(total, 1)
    return cost


def allocate(cost: np.ndarray, need: int) -> np.ndarray:
    """Per row the thresholds (-1, 0 or 1 per part) with sum(t + 1) = need of least cost."""
    rows, parts, _ = cost.shape
    best = np.full((parts + 1, need + 1, rows), np.inf)
    best[0, 0] = 0
    pick = np.zeros((parts + 1, need + 1, rows), np.int8)
    for i in range(parts):
        for used in range(need + 1):
            for t in range(min(2, used) + 1):
                c = best[i, used - t] + cost[:, i, t]
                better = c < best[i + 1, used]
                best[i + 1, used][better] = c[better]
                pick[i + 1, used][better] = t
    out, used = np.empty((rows, parts), np.int8), np.full(rows, need)
    for i in range(parts - 1, -1, -1):
        t = pick[i + 1, used, np.arange(rows)]
        out[:, i] = t - 1
        used = used - t
    return out


def _masks(groups: list[list[int]]) -> list[int]:
    """Signed 64-bit mask of each part; bit 0 of an unpacked row is the most significant."""
    return [int(np.uint64(sum(1 << (63 - b) for b in g)).astype(np.int64)) for g in groups]


def link_fingerprints(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)``, each once, to links ``(a, b)`` that join all fingerprints within two bits.

    Links of sparse buckets are all pairs within two bits; of dense ones a star for each shared
    neighbour. Every link is within two bits, and any two fingerprints within two bits are connected.
    Candidates of a sparse bucket are at most ``DENSE`` for each probe, so work grows with the input.
    """
    total, both = bit_counts(distinct)
    groups = group_bits(total, both)
    hist = half_histograms(distinct, groups)
    masks = _masks(groups)
    index = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "v"))
    counts = index.groupBy("part", "v").agg(F.count("*").alias("n"))
    dense = counts.where(F.col("n") > DENSE).select("part", "v")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            t = allocate(expected_candidates(_unpack(b["fp"]), groups, hist, total), MAX_DISTANCE + 1)
            parts = []
            for i, (mask, g) in enumerate(zip(masks, groups)):
                own = fp[t[:, i] >= 0]
                parts.append((i, own, own & mask, np.zeros(len(own), np.int64)))
                wide = fp[t[:, i] >= 1]
                for bit in g if len(wide) else ():
                    flip = np.uint64(1 << (63 - bit)).astype(np.int64)
                    parts.append((i, wide, (wide & mask) ^ flip, np.full(len(wide), flip)))
            yield pd.DataFrame({
                "part": np.concatenate([np.full(len(f), i, np.int32) for i, f, _, _ in parts]),
                "v": np.concatenate([v for _, _, v, _ in parts]),
                "q": np.concatenate([f for _, f, _, _ in parts]),
                "flip": np.concatenate([x for _, _, _, x in parts]),
            })

    probes = distinct.select("fp").mapInPandas(probe, "part int, v long, q long, flip long")
    # Buckets of one member too: a probe with a flipped bit asks for another fingerprint's value.
    sparse = index.join(dense, ["part", "v"], "left_anti")
    pairs = (
        probes.alias("p").join(sparse.alias("i"), ["part", "v"])
        .where("q <> fp and bit_count(q ^ fp) <= %d" % MAX_DISTANCE)
        .select(F.col("q").alias("a"), F.col("fp").alias("b"))
    )
    members = index.join(dense, ["part", "v"], "left_semi")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(int(np.uint64(1 << k).astype(np.int64))) for k in range(BITS)])
    listed = (
        members.withColumn("mask", F.element_at(F.array(*map(F.lit, masks)), F.col("part") + 1))
        .select("part", "fp", F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("mask")) == 0)).alias("x"))
        .select("part", F.col("fp").bitwiseXOR(F.col("x")).alias("z"), "fp")
    )
    guests = probes.where("flip <> 0").join(dense, ["part", "v"], "left_semi").select(
        "part", F.col("q").bitwiseXOR(F.col("flip")).alias("z"), F.col("q").alias("fp")
    )
    stars = (
        listed.unionAll(guests).groupBy("part", "z").agg(F.collect_set("fp").alias("who")).where(F.size("who") > 1)
        .select(F.array_min("who").alias("b"), F.explode("who").alias("a")).where("a <> b").select("a", "b")
    )
    return pairs.unionAll(stars)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents whose fingerprints differ in two bits or fewer are linked; ``component_id`` is the
    smallest id reachable. Null and empty texts have fingerprint zero and link like others. Repeated
    rows each come back. A null id is never a component's id unless it has no other. An empty table
    gives no rows. Other columns are not read.
    """
    prints = stage(fingerprints(docs, id_col, text_col, ngram), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = connected_components(link_fingerprints(distinct.select("fp")))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _minima(digests: np.ndarray) -> np.ndarray:
    """Smallest of the digests under each of ``BANDS * ROWS`` odd multipliers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(digests), 256):
        low = np.minimum(low, (_ODD[:, None] * digests[None, i : i + 256]).min(axis=1))
    return low


def shingle_sets(docs: DataFrame, ngram: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, k1, k2, fp, shingles, buckets)``: the set of shingle digests, 128 bits of it, its fingerprint, its buckets.

    Two sets share a given bucket with the chance ``J ** ROWS`` of their Jaccard similarity J,
    whatever the edit that lies between their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, max(len(batch), 1), 1000):
                b = batch.iloc[at : at + 1000]
                sets = [np.unique(np.frombuffer(shingle_digests(r or b"", ngram, distinct=True), ">u8").astype(np.uint64)) for r in b["raw"]]
                keys = [np.frombuffer(xxhash.xxh128_digest(x.tobytes()), np.int64) for x in sets]
                bands = [(_minima(x) * _ODD).reshape(BANDS, ROWS).sum(axis=1).view(np.int64) if len(x) else np.empty(0, np.int64) for x in sets]
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].astype("Int64").to_numpy(object, na_value=None), "k1": [int(k[0]) for k in keys],
                    "k2": [int(k[1]) for k in keys],
                    "fp": [int(np.packbits(majority_bits(x.astype(">u8").tobytes())).view(">i8")[0]) for x in sets],
                    "shingles": [x.view(np.int64) for x in sets], "buckets": bands,
                })

    return rows.mapInPandas(work, "doc_id long, k1 long, k2 long, fp long, shingles array<long>, buckets array<long>")


def _similar(a: str, b: str, similarity: float) -> str:
    """SQL that tells whether sets ``a`` and ``b`` have this Jaccard similarity; sizes first, as they are cheap."""
    share = Fraction(similarity).limit_denominator(10**6)
    up, down = share.numerator, share.denominator
    return (
        f"size({a}) * {down}L >= size({b}) * {up}L and size({b}) * {down}L >= size({a}) * {up}L and "
        f"size(array_intersect({a}, {b})) * {down + up}L >= (size({a}) + size({b})) * {up}L"
    )


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(node, shingles)`` are similar; sets without a pair are not shuffled."""
    pairs = stage(pairs, "pairs")
    met = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    sets = sets.join(met, "node", "left_semi")
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .where(_similar("x", "y", similarity)).select("a", "b")
    )


def link_close(prints: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``prints(node, fp)`` to links ``(a, b)`` of similar sets whose fingerprints are within two bits.

    Each fingerprint has a head, its smallest node. Nodes meet the head of their own fingerprint, and
    heads meet along the links of the search; each link is checked on the whole sets.
    """
    heads = stage(prints.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    close = link_fingerprints(heads.select("fp")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b"
    ).select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = prints.join(heads, "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return stage(_checked(across.unionAll(same), sets, similarity), "close")


def link_similar(nodes: DataFrame, sets: DataFrame, similarity: float, close: DataFrame) -> DataFrame:
    """``nodes(node, buckets)`` and their ``sets(node, shingles)`` to links ``(a, b)`` of similar sets.

    Links connect all sets of this similarity that share a bucket; each link is checked on the whole
    sets. ``close`` are links known before. First every member meets one head of its bucket. Members that
    hang together need not meet, so the rest of the search is pairs of different groups in buckets that
    hold several. What is needed of ``sets`` is copied, then the stage they come from is deleted.
    """
    known = stage(connected_components(close), "known")
    listed = nodes.select("node", F.explode(F.array_distinct("buckets")).alias("bucket"))
    heads = listed.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("head")).where("n > 1")
    shared = stage(listed.join(heads.select("bucket", "head"), "bucket"), "shared")
    free_shuffles(sets.sparkSession)
    own = stage(sets.join(shared.select("node").distinct(), "node", "left_semi"), "sets")
    spark = sets.sparkSession
    discard(sets)
    free_shuffles(spark)
    met = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    apart = (
        met.join(known.select(F.col("node").alias("a"), F.col("root").alias("p")), "a", "left")
        .join(known.select(F.col("node").alias("b"), F.col("root").alias("q")), "b", "left")
        .where("not coalesce(p = q, false)").select("a", "b")
    )
    first = stage(_checked(apart, own, similarity), "links").unionAll(close)
    free_shuffles(spark)
    labelled = stage(
        shared.select("bucket", "node").join(connected_components(first), "node", "left")
        .select("bucket", "node", F.coalesce("root", "node").alias("root")),
        "labelled",
    )
    discard(shared)
    free_shuffles(spark)
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rest = stage(labelled.join(mixed.select("bucket"), "bucket", "left_semi").join(own, "node"), "rest")
    discard(labelled, own)
    free_shuffles(spark)
    second = stage(
        rest.alias("p").join(rest.alias("i"), F.expr(
            "p.bucket = i.bucket and p.root < i.root and " + _similar("p.shingles", "i.shingles", similarity)
        )).select(F.col("p.node").alias("a"), F.col("i.node").alias("b")),
        "links",
    )
    discard(rest)
    free_shuffles(spark)
    return first.unionAll(second)


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, ngram: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row ``(doc_id, keeper)`` per document; ``keeper`` is the smallest id of its group.

    Documents are linked when the sets of their ``ngram``-word shingles have a Jaccard similarity of
    ``similarity`` or more; groups are what links connect. Candidates are sets whose SimHash fingerprints
    are within two bits; those that lie further apart, as after block edits, share a bucket of least
    digests. A pair at 0.8 shares none about 8 times in a million. Texts of fewer words are linked when their words are the
    same, texts without words with each other. Null ids are never keepers unless a group has no
    other. Repeated rows each come back; an empty table gives no rows; other columns are not read.
    """
    prints = stage(shingle_sets(docs, ngram, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sets")
    nodes = stage(prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("low"), F.min("row").alias("node"), F.min("fp").alias("fp")), "nodes")
    # The sets are deleted once the search has copied what it needs.
    keys = stage(prints.select("doc_id", "k1", "k2"), "keys")
    named = prints.select(F.col("row").alias("node"), "buckets").join(nodes.select("node"), "node", "left_semi")
    sets = prints.select(F.col("row").alias("node"), "shingles")
    close = link_close(nodes.select("node", "fp"), sets, similarity)
    free_shuffles(docs.sparkSession)
    roots = connected_components(link_similar(named, sets, similarity, close))
    classes = nodes.join(roots, "node", "left").select("k1", "k2", "low", F.coalesce("root", "node").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("keeper"))
    return keys.join(
        classes.join(lowest, "root").select("k1", "k2", "keeper"), ["k1", "k2"]
    ).select("doc_id", "keeper")
