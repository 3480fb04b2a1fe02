"""Class-based bigram language model with classes from exchange clustering.

Words above a share of the corpus are units of their own, the others begin in units shared by their
ending and length, so there are at most ``1 / UNIT_RATE + ENDINGS + 1`` units whatever the corpus.
Exchange clustering moves units between classes wherever that raises the likelihood of the class
bigrams. Then every rare word, however many there are, is moved on its own by the same rule: its
contexts by class are counted in the texts, and the words are dealt over tasks. Only words that no
learnt text holds stay in the class of their unit. The probability of a word is that of its class after
the previous word's class, times that of the word in its class, each smoothed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, free_shuffles, stage

UNIT_RATE = 1e-4
ENDINGS = 1024
CLASSES = 64
ROUNDS = 8
#: Taken off each count of a rare word for words not seen.
DISCOUNT = 0.75
#: Weight of the class frequencies against the counted transitions.
PRIOR = 50.0
#: Bytes of text that share one dictionary.
CHUNK_BYTES = 32_000_000
#: Bytes of text whose codes are handed on together, and tokens whose bigrams are counted together.
_FLUSH_BYTES, _SLICE = 4_000_000, 1_000_000
#: Groups in which units look for their classes.
_BUCKETS = 64
#: Rare words that one task moves, and how many of them at once.
_RARE_WORDS, _AT_ONCE = 100_000, 2048
#: Stands for the end of a text; no word holds a line break.
END = b"\n"


def encode(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    """Texts as places in the dictionary of their chunk, and the dictionaries.

    Rows with ``codes`` are documents, rows with ``word`` dictionary entries with their count in
    learnt documents. ``uid`` names the chunk.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), learn.alias("learn"), F.col(text_col).cast("binary").alias("raw")
    )
    columns = ["uid", "doc_id", "learn", "codes", "idx", "word", "n"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk = TaskContext.get().partitionId() << 24, 0
        places: dict[bytes, int] = {END: 0}
        counts, size = np.zeros(1 << 16, np.int64), 0

        def dictionary() -> Iterator[pd.DataFrame]:
            words = list(places)
            for i in range(0, len(words), 50_000):
                own = words[i : i + 50_000]
                yield pd.DataFrame({
                    "uid": part + chunk, "doc_id": None, "learn": None, "codes": None,
                    "idx": np.arange(i, i + len(own)), "word": own, "n": counts[i : i + len(own)],
                })[columns]

        def coded(rows_out: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows_out, columns=columns[:4])
            return out.assign(doc_id=out["doc_id"].astype("Int64"), idx=None, word=None, n=None)[columns]

        for b in batches:
            docs_out, held = [], 0
            for doc, learnt, raw in zip(b["doc_id"].astype("Int64"), b["learn"], b["raw"]):
                words = (raw or b"").lower().split()
                for w in set(words):
                    if w not in places:
                        places[w] = len(places)
                codes = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
                if len(places) > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), len(places)), np.int64)])
                if learnt:
                    np.add.at(counts, codes, 1)
                    counts[0] += 1
                docs_out.append((part + chunk, doc, bool(learnt), codes.tobytes()))
                size += len(raw or b"")
                held += len(raw or b"")
                if held > _FLUSH_BYTES:
                    yield coded(docs_out)
                    docs_out, held = [], 0
                if size > CHUNK_BYTES:
                    yield from dictionary()
                    places, size, chunk = {END: 0}, 0, chunk + 1
                    counts = np.zeros(1 << 16, np.int64)
            yield coded(docs_out)
        if size or len(places) > 1 or counts[0] or chunk == 0:
            yield from dictionary()

    return rows.mapInPandas(work, "uid long, doc_id long, learn boolean, codes binary, idx int, word binary, n long")


def _ending(word: Column) -> Column:
    length = F.least(F.octet_length(word), F.lit(12))
    return F.pmod(F.xxhash64(F.substring(word, -2, 2), F.floor(length / 3)), F.lit(ENDINGS)).cast("int")


@dataclass(frozen=True)
class Units:
    """Training counts of the units, frequent words first, then the end, then endings."""

    frequent: list[bytes]
    count: np.ndarray
    kinds: np.ndarray
    tokens: int
    types: int

    @property
    def end(self) -> int:
        return len(self.frequent)

    @property
    def rare(self) -> int:
        return len(self.frequent) + 1


def count_units(vocab: DataFrame, rate: float = UNIT_RATE) -> Units:
    """Units of ``vocab(word, c)``, whose words all occur in learnt texts."""
    tokens, types = vocab.agg(F.sum("c"), F.count("*")).first()
    tokens, types = int(tokens or 0), int(types)
    # At most 1 / rate words can have so large a share.
    least = max(1, int(np.ceil(tokens * rate)))
    often = vocab.where((F.col("c") >= least) & (F.col("word") != F.lit(END))).collect()
    often = sorted(((int(r.c), bytes(r.word)) for r in often), key=lambda x: (-x[0], x[1]))
    rest = vocab.where((F.col("c") < least) & (F.col("word") != F.lit(END)))
    endings = rest.groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("c"), F.count("*")).collect()
    ends = vocab.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    count = np.zeros(len(often) + 1 + ENDINGS, np.int64)
    kinds = np.zeros(len(count), np.int64)
    count[: len(often)], kinds[: len(often)] = [n for n, _ in often], 1
    count[len(often)], kinds[len(often)] = ends, 1
    for e, n, k in endings:
        count[len(often) + 1 + e], kinds[len(often) + 1 + e] = n, k
    return Units([w for _, w in often], count, kinds, tokens, types)


def resolve(words: DataFrame, vocab: DataFrame, units: Units) -> DataFrame:
    """Per chunk one row with the count, unit and rare word's number of each dictionary entry, in order of place.

    The number (``ids``) is -1 for frequent words, the end and words that no learnt text holds.
    """
    spark = words.sparkSession
    table = pd.DataFrame({"word": units.frequent, "unit": np.arange(len(units.frequent), dtype=np.int32)})
    named = spark.createDataFrame(table, "word binary, unit int")
    found = words.select("uid", "idx", "word").join(vocab, "word", "left").join(F.broadcast(named), "word", "left")
    found = found.select(
        "uid", "idx", F.coalesce("c", F.lit(0)).alias("c"),
        F.when(F.col("word") == F.lit(END), F.lit(units.end)).otherwise(
            F.coalesce("unit", F.lit(units.rare) + _ending(F.col("word")))
        ).cast("int").alias("unit"),
        F.when((F.col("word") != F.lit(END)) & F.col("unit").isNull(), F.col("id")).alias("id"),
    ).withColumn("id", F.coalesce("id", F.lit(-1)))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        c, unit, ids = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64)
        c[rows["idx"]], unit[rows["idx"]], ids[rows["idx"]] = rows["c"], rows["unit"], rows["id"]
        return pd.DataFrame({"uid": [rows["uid"].iloc[0]], "c": [c.tobytes()], "unit": [unit.tobytes()], "ids": [ids.tobytes()]})

    return found.groupBy("uid").applyInPandas(work, "uid long, c binary, unit binary, ids binary")


def unit_bigrams(texts: DataFrame, dictionaries: DataFrame, units: Units) -> DataFrame:
    """``(a, b, n)``: how often unit b follows unit a in learnt texts; a text starts after an end."""
    total = len(units.count)

    def work(docs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(entries):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        unit = np.frombuffer(entries["unit"].iloc[0], np.int32)
        counted = []
        stream, held = [unit[:1]], 1
        for k, codes in enumerate(docs["codes"], 1):
            own = unit[np.append(np.frombuffer(codes, np.int32), np.int32(0))]
            stream.append(own)
            held += len(own)
            if held > _SLICE or k == len(docs):
                seq = np.concatenate(stream).astype(np.int64)
                counted.append(np.unique(seq[:-1] * total + seq[1:], return_counts=True))
                stream, held = [unit[:1]], 1
        keys, n = np.concatenate([x[0] for x in counted]), np.concatenate([x[1] for x in counted])
        return pd.DataFrame({"a": keys // total, "b": keys % total, "n": n})

    pairs = texts.where("learn").select("uid", "codes").groupBy("uid").cogroup(dictionaries.groupBy("uid")).applyInPandas(
        work, "a int, b int, n long"
    )
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def class_table(bigrams: DataFrame, classes: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """k x k counts of class bigrams."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(k * k, np.int64)
        for x in batches:
            np.add.at(table, classes[x["a"].to_numpy(np.int64)] * k + classes[x["b"].to_numpy(np.int64)], x["n"].to_numpy(np.int64))
        cell = np.flatnonzero(table)
        yield pd.DataFrame({"cell": cell, "n": table[cell]})

    out = np.zeros(k * k)
    for cell, n in bigrams.mapInPandas(work, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(k, k)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(table: np.ndarray) -> float:
    """What of the log likelihood depends on the classes."""
    return float(_g(table).sum() - _g(table.sum(0)).sum() - _g(table.sum(1)).sum())


def best_class(right: np.ndarray, left: np.ndarray, self_n: float, own: int, table: np.ndarray) -> tuple[int, float]:
    """Class in which a unit raises the likelihood most, and the gain over its own.

    ``right`` and ``left`` are its counts before and after each class, without itself.
    """
    base = table.copy()
    base[own, :] -= right
    base[:, own] -= left
    base[own, own] -= self_n
    rows, cols = base.sum(1) + left, base.sum(0) + right  # others keep what they have beside the unit
    gain = (_g(base + right) - _g(base)).sum(1) + (_g(base + left[:, None]) - _g(base)).sum(0)
    d = np.diag(base)
    gain += _g(d + right + left + self_n) - _g(d + right) - _g(d + left) + _g(d)
    gain -= _g(rows + right.sum() + self_n) - _g(rows) + _g(cols + left.sum() + self_n) - _g(cols)
    to = int(np.argmax(gain))
    return to, float(gain[to] - gain[own])


def _mover(classes: np.ndarray, table: np.ndarray, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Best class of each unit whose contexts ``(u, way, o, n)`` are given."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("u", kind="stable")
        u, o, way = (rows[c].to_numpy(np.int64) for c in ("u", "o", "way"))
        n = rows["n"].to_numpy(float)
        cuts = np.flatnonzero(np.diff(u)) + 1
        out = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(u)]):
            one, other, after = int(u[a]), o[a:b] != u[a], way[a:b] == 0
            cls, m = classes[o[a:b]], n[a:b]
            right = np.bincount(cls[other & after], m[other & after], minlength=k)
            left = np.bincount(cls[other & ~after], m[other & ~after], minlength=k)
            to, gain = best_class(right, left, float(m[~other & after].sum()), int(classes[one]), table)
            out.append((one, to, gain))
        return pd.DataFrame(out, columns=["u", "to", "gain"])

    return work


def exchange(bigrams: DataFrame, units: Units, k: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the units and the class table, after ``rounds`` of exchange.

    Each round moves units of one half (by number) that gain against the table of the round's start;
    the best classes seen are kept.
    """
    total = len(units.count)
    classes = np.empty(total, np.int64)
    classes[np.argsort(-units.count, kind="stable")] = np.arange(total) % k
    ways = stage(
        bigrams.select(F.col("a").alias("u"), F.lit(0).alias("way"), F.col("b").alias("o"), "n").unionAll(
            bigrams.select(F.col("b").alias("u"), F.lit(1).alias("way"), F.col("a").alias("o"), "n")
        ),
        "contexts",
    )
    table = class_table(bigrams, classes, k)
    best = (likelihood(table), classes, table)
    for turn in range(rounds):
        # One row per unit, so a bounded number.
        moves = ways.where(F.pmod("u", F.lit(2)) == turn % 2).groupBy(F.pmod("u", F.lit(_BUCKETS)).alias("bucket")).applyInPandas(
            _mover(classes.copy(), table, k), "u int, to int, gain double"
        )
        moved = moves.where("gain > 1e-9").collect()
        if moved:
            classes = classes.copy()
            for u, to, _ in moved:
                classes[u] = to
            table = class_table(bigrams, classes, k)
            value = likelihood(table)
            if value > best[0]:
                best = (value, classes, table)
    discard(ways)
    return best[1], best[2]


def best_classes(
    right: np.ndarray, left: np.ndarray, self_n: np.ndarray, own: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """``best_class`` of many words, each a row of ``right`` and ``left``, at a cost by their contexts."""
    every, gain = np.arange(len(own)), np.zeros(right.shape)
    for near, far, counts in ((right, left, table), (left, right, table.T)):
        w, j = np.nonzero(near)
        if not len(w):
            continue
        x, o = near[w, j], own[w]
        base = counts.T[j]  # what each class has with the context, without the word
        base[np.arange(len(w)), o] -= x
        same = np.flatnonzero(j == o)
        base[same] -= far[w[same]]
        base[same, o[same]] -= self_n[w[same]]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(_g(base + x[:, None]) - _g(base), starts, axis=0)
    s = self_n[:, None]
    d = np.repeat(np.diag(table)[None, :], len(own), axis=0)
    d[every, own] -= right[every, own] + left[every, own] + self_n
    gain += _g(d + right + left + s) - _g(d + right) - _g(d + left) + _g(d)
    for near, total in ((right, table.sum(1)), (left, table.sum(0))):
        n = near.sum(1) + self_n
        rest = np.repeat(total[None, :], len(own), axis=0)
        rest[every, own] -= n
        gain -= _g(rest + n[:, None]) - _g(rest)
    to = gain.argmax(1)
    return to, gain[every, to] - gain[every, own]


def survey(texts: DataFrame, placed: DataFrame, buckets: int, half: int, k: int = CLASSES) -> DataFrame:
    """Class bigrams of learnt texts, and the contexts by class of the rare words of one ``half`` (by number).

    ``placed(uid, ids, cls)`` are dictionaries with the class of each entry. Rows of bucket -1 hold a
    chunk's k x k counts (``n``). The others hold, for a chunk and bucket, places, numbers and classes
    of entries, how many contexts each has (none in a chunk that holds the word in other texts only),
    and these: the class after, k + the class before, or 2 k for the word itself, with a count.
    """
    columns, wide = ["bucket", "uid", "idx", "id", "cls", "held", "key", "n"], 2 * k + 1

    def work(docs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return pd.DataFrame([], columns=columns)
        uid = int(entries["uid"].iloc[0])
        ids, cls = np.frombuffer(entries["ids"].iloc[0], np.int64), np.frombuffer(entries["cls"].iloc[0], np.int16).astype(np.int64)
        asked = (ids >= 0) & (ids % 2 == half)
        table, found = np.zeros(k * k, np.int64), []
        stream, held = [np.zeros(1, np.int32)], 1
        for at, codes in enumerate(docs["codes"], 1):
            own = np.append(np.frombuffer(codes, np.int32), np.int32(0))
            stream.append(own)
            held += len(own)
            if held > _SLICE or at == len(docs):
                seq = np.concatenate(stream)
                a, b = seq[:-1], seq[1:]
                table += np.bincount(cls[a] * k + cls[b], minlength=k * k)
                after, before = asked[a], asked[b] & (a != b)
                keys = [
                    a[after].astype(np.int64) * wide + np.where(a[after] == b[after], 2 * k, cls[b[after]]),
                    b[before].astype(np.int64) * wide + k + cls[a[before]],
                ]
                found.append(np.unique(np.concatenate(keys), return_counts=True))
                stream, held = [np.zeros(1, np.int32)], 1
        key = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
        n = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
        if len(found) > 1:
            key, at = np.unique(key, return_inverse=True)
            n = np.bincount(at, n, minlength=len(key)).astype(np.int64)
        entry = np.flatnonzero(asked)
        bucket = ids[entry] // 2 % buckets
        order = np.argsort(bucket, kind="stable")
        entry, bucket = entry[order], bucket[order]
        rank = np.zeros(len(ids), np.int64)
        rank[entry] = np.arange(len(entry))
        by = np.argsort(rank[key // wide], kind="stable")
        sizes = np.bincount(rank[key // wide], minlength=len(entry)) if len(entry) else np.zeros(0, np.int64)
        context, n = (key[by] % wide).astype(np.int16), n[by].astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = [(-1, uid, b"", b"", b"", b"", b"", table.tobytes())]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(entry))):
            e, c = entry[lo:hi], slice(ends[lo], ends[hi])
            out.append((
                int(bucket[lo]), uid, e.astype(np.int32).tobytes(), ids[e].tobytes(), cls[e].astype(np.int16).tobytes(),
                sizes[lo:hi].astype(np.int32).tobytes(), context[c].tobytes(), n[c].tobytes(),
            ))
        return pd.DataFrame(out, columns=columns)

    return texts.where("learn").select("uid", "codes").groupBy("uid").cogroup(placed.groupBy("uid")).applyInPandas(
        work, "bucket int, uid long, idx binary, id binary, cls binary, held binary, key binary, n binary"
    )


def _rare_mover(table: np.ndarray, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Classes of a bucket's rare words, by chunk and place; a row without ``uid`` counts words by class, before and after."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)
        words, at = np.unique(joined("id", np.int64), return_inverse=True)
        own = np.zeros(len(words), np.int64)
        own[at] = joined("cls", np.int16)
        of, key, n = np.repeat(at, joined("held", np.int32)), joined("key", np.int16), joined("n", np.int32)
        by = np.argsort(of, kind="stable")
        of, key, n = of[by], key[by], n[by]
        new = own.copy()
        for lo in range(0, len(words), _AT_ONCE):
            hi = min(lo + _AT_ONCE, len(words))
            a, b = np.searchsorted(of, [lo, hi])
            m = np.bincount((of[a:b] - lo) * (2 * k + 1) + key[a:b], n[a:b], minlength=(hi - lo) * (2 * k + 1)).reshape(hi - lo, -1)
            to, gain = best_classes(m[:, :k], m[:, k : 2 * k], m[:, 2 * k], own[lo:hi], table)
            new[lo:hi] = np.where(gain > 1e-9, to, own[lo:hi])
        placed = new[at].astype(np.int16)
        ends = np.cumsum([len(x) // 4 for x in rows["idx"]])
        kinds = np.concatenate([np.bincount(x, minlength=k) for x in (own, new)])
        return pd.DataFrame({
            "uid": pd.Series([*rows["uid"], None], dtype="Int64"), "idx": [*rows["idx"], b""],
            "cls": [*(x.tobytes() for x in np.split(placed, ends[:-1])), kinds.astype(np.int64).tobytes()],
        })

    return work


def place_words(
    texts: DataFrame, dictionaries: DataFrame, units: Units, classes: np.ndarray, table: np.ndarray, k: int = CLASSES
) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Dictionaries with the class of each entry (``cls``), the class table and the rare words by class.

    Rare words begin in the class of their unit. Each half of them moves once, every word to the class
    that raises the likelihood most against the table of the turn's start; a turn that lowers the
    likelihood as a whole is taken back, as in ``exchange``.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "cls": [classes[np.frombuffer(u, np.int32)].astype(np.int16).tobytes() for u in b["unit"]]})

    def moved(entries: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
        if not len(entries):
            return pd.DataFrame({"uid": [], "cls": []})
        cls = np.frombuffer(entries["cls"].iloc[0], np.int16).copy()
        for idx, c in zip(moves["idx"], moves["cls"]):
            cls[np.frombuffer(idx, np.int32)] = np.frombuffer(c, np.int16)
        return pd.DataFrame({"uid": entries["uid"], "cls": [cls.tobytes()]})

    buckets = int(units.kinds[units.rare :].sum()) // (2 * _RARE_WORDS) + 1
    at = stage(dictionaries.select("uid", "unit").mapInPandas(first, "uid long, cls binary"), "placed")
    with_class = lambda at: dictionaries.join(at, "uid")
    kinds = np.zeros(k, np.int64)

    def counted(seen: DataFrame) -> np.ndarray:
        out = np.zeros(k * k, np.int64)
        for (n,) in seen.where("bucket = -1").select("n").toLocalIterator():
            out += np.frombuffer(n, np.int64)
        return out.reshape(k, k).astype(float)

    seen = stage(survey(texts, with_class(at).select("uid", "ids", "cls"), buckets, 0, k), "survey")
    for half in (0, 1):
        moves = stage(seen.where("bucket >= 0").groupBy("bucket").applyInPandas(_rare_mover(table, k), "uid long, idx binary, cls binary"), "moves")
        own = np.zeros((2, k), np.int64)
        for (x,) in moves.where("uid is null").select("cls").toLocalIterator():
            own += np.frombuffer(x, np.int64).reshape(2, k)
        after = stage(
            at.groupBy("uid").cogroup(moves.where("uid is not null").groupBy("uid")).applyInPandas(moved, "uid long, cls binary"), "placed"
        )
        discard(seen, moves)
        free_shuffles(texts.sparkSession)
        # The other half is asked for with the classes as they are now, which the next turn takes as its start.
        seen = stage(survey(texts, with_class(after).select("uid", "ids", "cls"), buckets, 1 - half, k), "survey")
        value = counted(seen)
        if likelihood(value) >= likelihood(table):
            at, table, kinds = after, value, kinds + own[1]
        else:
            kinds = kinds + own[0]
            if half == 0:
                seen = stage(survey(texts, with_class(at).select("uid", "ids", "cls"), buckets, 1, k), "survey")
    discard(seen)
    return with_class(at), table, kinds


@dataclass(frozen=True)
class ClassModel:
    """Smoothed log10 probabilities; ``mass`` is what the words of each class share."""

    units: Units
    classes: np.ndarray
    transition: np.ndarray
    mass: np.ndarray

    def words(self, c: np.ndarray, unit: np.ndarray, cls: np.ndarray | None = None) -> np.ndarray:
        """log10 P(word | its class) for words of count ``c``; all unseen words of a unit are one event.

        Without ``cls`` words are in the class of their unit.
        """
        rare = unit >= self.units.rare
        part = np.where(
            rare, np.where(c > 0, c - DISCOUNT, DISCOUNT * self.units.kinds[unit] + 0.5), self.units.count[unit] + 0.5
        )
        return np.log10(part) - np.log10(self.mass[self.classes[unit] if cls is None else cls])


def smooth(units: Units, classes: np.ndarray, table: np.ndarray, rare: tuple[np.ndarray, np.ndarray] | None = None) -> ClassModel:
    """The model; ``rare`` gives tokens and words by class of the rare words, which else are in their units' classes."""
    k, n = len(table), units.rare
    share = (table.sum(0) + 1) / (table.sum() + k)
    transition = (table + PRIOR * share) / (table.sum(1, keepdims=True) + PRIOR)
    if rare is None:
        rare = tuple(np.bincount(classes[n:], x[n:], minlength=k) for x in (units.count, units.kinds))
    mass = np.bincount(classes[:n], units.count[:n] + 0.5, minlength=k)
    mass += np.bincount(classes[n:], DISCOUNT * units.kinds[n:] + 0.5, minlength=k)
    mass += rare[0] - DISCOUNT * rare[1]
    return ClassModel(units, classes, np.log10(transition), mass)


def _score(texts: DataFrame, dictionaries: DataFrame, model: ClassModel) -> DataFrame:
    units = model.units
    spread = units.tokens + units.types + 1

    def work(docs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(docs) or not len(entries):
            return pd.DataFrame({"doc_id": [], "learn": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
        c = np.frombuffer(entries["c"].iloc[0], np.int64)
        unit = np.frombuffer(entries["unit"].iloc[0], np.int32)
        cls = np.frombuffer(entries["cls"].iloc[0], np.int16).astype(np.int64)
        word = model.words(c, unit, cls)
        base, known = np.log10((c + 1) / spread), (c > 0).astype(np.int64)
        out = []
        for doc, learn, codes in zip(docs["doc_id"].astype("Int64"), docs["learn"], docs["codes"]):
            seq = np.append(np.frombuffer(codes, np.int32), np.int32(0))
            at = cls[seq]
            before = np.append(cls[:1], at[:-1])
            out.append((
                doc, learn, len(seq), int(known[seq].sum()), float(base[seq].sum()),
                float(word[seq].sum() + model.transition[before, at].sum()),
            ))
        res = pd.DataFrame(out, columns=["doc_id", "learn", "n_tokens", "n_known", "base_score", "score"])
        return res.astype({"doc_id": "Int64"})

    return texts.select("uid", "doc_id", "learn", "codes").groupBy("uid").cogroup(dictionaries.groupBy("uid")).applyInPandas(
        work, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double"
    )


def score_documents(
    docs: DataFrame, learn: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text",
    classes: int = CLASSES, rounds: int = ROUNDS, rate: float = UNIT_RATE,
) -> DataFrame:
    """One row per document: ``doc_id learn n_tokens n_known train_tokens base_score score``.

    Tokens are the words, A-Z lower-cased, and one end. The model learns from documents whose id
    ``learn`` admits (null counts as admitted); ``base_score`` is the add-one unigram score, ``score``
    the class model's log10 probability of the text, in which unseen words of a unit are one event as
    in the base. Null and empty texts are an end alone. Repeated rows each count and come back; an
    empty table gives no rows; without learnt documents all counts are zero. Other columns are not
    read. Only dictionaries are joined by word, never single tokens, so a frequent word is one row
    per chunk of ``CHUNK_BYTES``. Every learnt word has a class of its own choice.
    """
    chosen = F.coalesce(learn(F.col(id_col).cast("long")), F.lit(True))
    coded = stage(encode(docs, chosen, id_col, text_col), "coded")
    texts, words = coded.where(F.col("codes").isNotNull()), coded.where(F.col("word").isNotNull())
    vocab = stage(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")).withColumn("id", F.monotonically_increasing_id()), "vocab")
    units = count_units(vocab, rate)
    dictionaries = stage(resolve(words, vocab, units), "dictionaries")
    bigrams = stage(unit_bigrams(texts, dictionaries, units), "bigrams")
    unit_classes, table = exchange(bigrams, units, classes, rounds)
    discard(bigrams)
    free_shuffles(docs.sparkSession)
    placed, table, kinds = place_words(texts, dictionaries, units, unit_classes, table, classes)
    n = units.rare
    tokens = table.sum(0) - np.bincount(unit_classes[:n], units.count[:n], minlength=classes)
    model = smooth(units, unit_classes, table, (tokens, kinds))
    return _score(texts, placed, model).withColumn("train_tokens", F.lit(units.tokens).cast("long"))
