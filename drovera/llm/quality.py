"""Quality classifier: Bradley-Terry strengths learnt from preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a fit uses; above it a fixed hash of the id decides.
SAMPLE = 20_000
#: Score at which a document counts as good.
CUT = 0.3
_PAIRS_EACH = 12
_RIDGE = 1e-3

_BYTES = np.zeros((10, 256), np.float32)
for _row, _set in enumerate((
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\x0c\r", b".,;:",
    b"!", b"?", b"#*$%&|<>", b"\n", bytes(range(128, 256)),
)):
    _BYTES[_row, list(_set)] = 1
FEATURES = 22


def features(raw: bytes | None) -> np.ndarray:
    """Shape of a text as numbers near 0 to 3; the empty text is all zero but the bias of length."""
    raw = raw or b""
    n = max(len(raw), 1)
    upper, lower, digit, blank, stop, bang, ask, symbol, line, high = (
        _BYTES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float32)
    ).tolist()
    words = raw.split()
    count = max(len(words), 1)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    filled = [x for x in lines if x.strip()]
    heads = len({x[:24] for x in filled})
    rows = max(len(filled), 1)
    letters = max(upper + lower, 1)
    return np.array([
        np.log1p(len(words)) / 4, (n - blank) / count / 6, upper / letters, digit / n * 10, blank / n * 3,
        min(stop / count * 5, 3), min(bang / count * 3, 3), min(ask / count * 10, 3), min(symbol / count * 3, 3), high / n * 5,
        distinct / count, np.log1p(count) * distinct / count / 4, 1 - heads / rows, np.log1p(len(filled)) / 4,
        np.log1p(n / rows) / 5, float(symbol > 0.1 * count), float(bang > 0.1 * count), float(upper > 0.4 * letters),
        float(stop < 0.01 * count), float(len(words) < 20), float(len(words) < 5), min(line / count * 10, 3),
    ])


@dataclass(frozen=True)
class Ranking:
    """Weights of the strength, and the strength at which documents count as good."""

    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with strength, ``CUT`` at the cut."""
        z = self.slope * (x @ self.weights - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_ranking(x: np.ndarray, good: np.ndarray, seed: int = 7) -> Ranking:
    """Strengths from pairs of a good and a bad document by logistic loss on feature differences.

    Each document stands in at least ``_PAIRS_EACH`` pairs. The cut is the quantile of the strengths
    of the bad and good rows that errs least. With one class only, every score tells that class;
    without rows every score is above ``CUT``.
    """
    a, b = x[good], x[~good]
    if not len(a) or not len(b):
        return Ranking(np.zeros(x.shape[1] if x.ndim == 2 else FEATURES), 1.0 if len(b) else -1.0, 1.0)
    rng = np.random.default_rng(seed)
    n = _PAIRS_EACH * max(len(a), len(b))
    fill = lambda k: np.concatenate([rng.permutation(k) for _ in range(-(-n // k))])[:n]
    d = a[fill(len(a))] - b[fill(len(b))]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / n + _RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / n + _RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    order = np.argsort(s, kind="stable")
    # Rows below the cut that are good, and above it that are bad, for a cut before each rank.
    wrong = np.r_[0, np.cumsum(good[order])] + np.r_[(~good).sum(), (~good).sum() - np.cumsum(~good[order])]
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    edge = np.r_[s[order][0] - 1, s[order], s[order][-1] + 1]
    return Ranking(w, float((edge[k] + edge[k + 1]) / 2), float(3 / max(s.std(), 1e-9)))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, learn: Callable[[Column], Column],
    id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled documents that ``learn(id)`` admits, at most about ``sample``."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).where(
        F.col("good").isNotNull() & F.col("doc_id").isNotNull() & learn(F.col("doc_id"))
    )
    total = marks.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    # The sample is bounded by its parameter, so it may go to every executor.
    rows = rows.join(F.broadcast(chosen), "doc_id").select("raw", "good")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [features(r).tolist() for r in b["raw"]], "good": b["good"].astype("int32")})

    found = rows.mapInPandas(work, "x array<double>, good int").collect()
    return np.array([r.x for r in found]).reshape(len(found), FEATURES), np.array([r.good > 0 for r in found], bool)


def scorer(ranking: Ranking) -> Callable[[Column], Column]:
    """A column function from a text to its score."""

    @F.pandas_udf("double")
    def score(raw: pd.Series) -> pd.Series:
        x = np.array([features(r) for r in raw]).reshape(len(raw), FEATURES)
        return pd.Series(ranking.score(x))

    return lambda text: score(text.cast("binary"))


def score_quality(
    docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column],
    id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE,
) -> DataFrame:
    """One row per document: ``doc_id``, ``score`` from 0 to 1 and ``predicted`` (1 from ``CUT`` on).

    Only documents whose id ``learn`` admits are learnt from. Null and empty texts are scored as
    having no words. Null labels are ignored, several labels of a document all count. With
    labels of one kind every document gets that kind, without labels every document is good. Repeated rows each come back; other columns are
    not read; an empty table gives no rows.
    """
    ranking = fit_ranking(*training_rows(docs, labels, label, learn, id_col, text_col, sample))
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), scorer(ranking)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
