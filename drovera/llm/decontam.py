"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of k edits is cut into k + 1 pieces. Wherever a text comes within k edits of
it, one piece stands there unchanged. Pieces are found exactly by an automaton; each hit is verified
on the text around it with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.08
#: Items of fewer normalised bytes have no budget: they must stand there exactly, on word borders.
MIN_BYTES = 40
#: Short items of fewer words ("yes", "new york") are no evidence and never found.
MIN_WORDS = 3
#: Bytes of items that one pass over the documents looks for; more items make more passes.
BLOCK_BYTES = 4_000_000
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normal(text: str | None) -> str:
    """Lower-cased, each run of ASCII characters other than letters and digits one blank; one char per byte."""
    return b" ".join((text or "").lower().encode().translate(_TABLE).split()).decode("latin-1")


def _masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the part of ``text`` nearest to the pattern, the first of equals (Myers)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for at, c in enumerate(text, 1):
        x = get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
            if score < best:
                best, end = score, at
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = hn | (full & ~(d0 | hp)), hp & d0
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE) -> None:
        self.items = [
            (i, t, int(len(t) * rate) if len(t) >= MIN_BYTES else 0)
            for i, t in items if len(t) >= MIN_BYTES or t.count(" ") + 1 >= MIN_WORDS
        ]
        self.rate = rate
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, t, k) in enumerate(self.items):
            for p in range(k + 1):
                a, e = p * len(t) // (k + 1), (p + 1) * len(t) // (k + 1)
                pieces[t[a:e]].append((at, a))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, owners in pieces.items():
                self.automaton.add_word(piece, (len(piece), owners))
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item within its budget, nearest place.

        ``first``: stop at the first item found.
        """
        if self.automaton is None:
            return []
        text = normal(text)
        tried: dict[int, int] = {}
        best: dict[int, tuple[int, int]] = {}
        for e, (size, owners) in self.automaton.iter(text):
            for at, a in owners:
                start = e - size + 1 - a
                _, t, k = self.items[at]
                if len(t) < MIN_BYTES:
                    if at not in best and text[start - 1 : start] in ("", " ") and text[e + 1 : e + 2] in ("", " "):
                        best[at] = (0, e + 1)
                        if first:
                            break
                    continue
                # Places up to k away were inside the last window.
                if at in tried and abs(start - tried[at]) <= k:
                    continue
                tried[at] = start
                low = max(0, start - 2 * k)
                masks = self.masks.get(at) or self.masks.setdefault(at, _masks(t))
                d, end = nearest(masks, len(t), text[low : start + len(t) + 2 * k])
                if d <= k and (at not in best or d < best[at][0]):
                    best[at] = (d, low + end)
                    if first:
                        break
            if first and best:
                break
        return [(self.items[at][0], d, end) for at, (d, end) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of bytes at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull()
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        yield sorted((r.item, normal(r.text)) for r in own.toLocalIterator())


def contaminated(benchmark: DataFrame, text: Column, item_col: str = "item_id", text_col: str = "text") -> Column:
    """Whether ``text`` holds an item within its budget; null and empty texts hold none.

    Short items count as in ``find_leaks``; repeated items are as one, and an empty benchmark gives false.
    """
    spark = benchmark.sparkSession
    out = F.lit(False)
    for items in _blocks(benchmark, item_col, text_col):
        out = out | _holds(spark.sparkContext.broadcast(items))(text)
    return out


def _holds(items: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value)
        for s in texts:
            yield pd.Series([bool(matcher.find(t, first=True)) for t in s], dtype=bool)

    return hit


def _leaks(items: Broadcast, error_rate: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(items.value, error_rate)
        budget = {i: k for i, _, k in matcher.items}
        for b in batches:
            found = [
                (doc, item, d, budget[item], end)
                for doc, text in zip(b["doc_id"].astype("Int64"), b["text"])
                for item, d, end in matcher.find(text)
            ]
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "budget", "end"]).astype("Int64")

    return work


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE,
) -> DataFrame:
    """One row per document and item it holds: ``doc_id item_id distance budget end``.

    An item of n normalised bytes may differ by ``int(n * error_rate)`` edits. ``distance`` is of its
    nearest place, ``end`` where that ends in the normalised text. Items of under
    ``MIN_BYTES`` must stand there unchanged between words; of those, items under ``MIN_WORDS`` words
    are never found, nor are items without id or text. Null and empty texts hold nothing. Repeated documents and
    items each come back; empty tables give no rows; other columns are not read. Items are taken in
    blocks of ``BLOCK_BYTES``, so what is broadcast is bounded; texts are not shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, distance int, budget int, end long"
    out = None
    for items in _blocks(benchmark, item_col, item_text_col):
        own = rows.mapInPandas(_leaks(spark.sparkContext.broadcast(items), error_rate), schema)
        out = own if out is None else out.unionAll(own)
    return out
