"""Quality rules judged per host, with rates shrunk by an empirical beta prior."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stage

WINDOW = 8
MIN_WORDS = 20
#: Documents of a host whose shrunken rate of a rule's failures exceeds this do not stay.
MAX_RATE = 0.6
#: A host needs so much evidence: the rate less this many posterior deviations must exceed the limit.
DEVIATIONS = 2.0
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_RULES = ("short", "repeats", "symbols", "lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window found twice or more, each counted once."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    # Equal keys are candidates; the words decide.
    starts = np.flatnonzero(often).tolist()
    spans = [tuple(words[i : i + window]) for i in starts]
    counts = Counter(spans)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, s in zip(starts, spans):
        if counts[s] > 1:
            cover[i] += 1
            cover[i + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def measures(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of a text."""
    raw = raw or b""
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUATION))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def document_rules(docs: DataFrame, host_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of each document, and per rule whether it fails."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.col(text_col).cast("binary").alias("raw"),
    )
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([measures(r) for r in b["raw"]], columns=names, dtype="int64")
            out.insert(0, "host", b["host"].to_numpy())
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield out.astype({"doc_id": "Int64"})

    found = rows.mapInPandas(work, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))
    return found.select(
        "*",
        (F.col("n_words") < MIN_WORDS).alias("short"),
        (100 * F.col("n_repeat_words") > 30 * F.col("n_words")).alias("repeats"),
        (10 * F.col("n_symbols") > 3 * F.col("n_words")).alias("symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("lines"),
    )


def host_verdicts(rules: DataFrame) -> DataFrame:
    """``(host, bad)``: hosts of which some rule's failure rate is too high for certain.

    A host's rate is the mean of its beta posterior. The prior of a rule has the mean and spread of
    the hosts' own rates (moments, hosts weighing alike), so a host with few documents is drawn to
    what hosts are like.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in _RULES])
    hosts = stage(hosts, "hosts")
    prior = hosts.agg(
        F.avg(1 / F.col("n")).alias("inv"),
        *[F.avg(F.col(r) / F.col("n")).alias(f"m_{r}") for r in _RULES],
        *[F.var_pop(F.col(r) / F.col("n")).alias(f"v_{r}") for r in _RULES],
    ).first()
    bad = F.lit(False)
    for r in _RULES:
        m = min(max(prior[f"m_{r}"] or 0.0, 1e-4), 1 - 1e-4)
        # What the hosts' rates differ by beyond chance, in (0, m(1-m)).
        spread = min(max((prior[f"v_{r}"] or 0.0) - m * (1 - m) * (prior["inv"] or 0.0), 1e-6), 0.99 * m * (1 - m))
        weight = m * (1 - m) / spread - 1
        alpha, total = F.col(r) + F.lit(m * weight), F.col("n") + F.lit(weight)
        rate = alpha / total
        bad = bad | (rate - DEVIATIONS * F.sqrt(rate * (1 - rate) / (total + 1)) > MAX_RATE)
    return hosts.select("host", bad.alias("bad"))


def apply_host_rules(
    docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: its measures, ``base_failed`` and ``kept``.

    A document fails by itself with under ``MIN_WORDS`` words or over 30 % repeated words; it also
    goes if its host's verdict is bad. Null texts have no words. Documents without a host are one
    host. Repeated rows each count and come back; an empty table gives no rows; other columns are
    not read. Hosts are counted before the shuffle, so one that holds most documents is one row.
    """
    rules = stage(document_rules(docs, host_col, id_col, text_col), "rules")
    verdicts = host_verdicts(rules)
    failed = F.col("short") | F.col("repeats")
    joined = rules.alias("r").join(verdicts.alias("v"), F.col("r.host").eqNullSafe(F.col("v.host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.col("bad")).alias("kept"),
    )
