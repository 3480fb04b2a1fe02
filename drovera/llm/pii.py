"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table by its likelihood (forward-backward, quasi-Newton
steps) and decoded by Viterbi for many stretches of words at once. A stretch is what lies within
``REACH`` words of a marked word: one with a digit or an ``@``, or a cue such as a title. Training
and decoding cut texts the same way; words outside all stretches are nobody's data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii_examples import luhn

#: In this order spans of one start are listed; the first four have patterns.
KINDS = ("email", "ip", "card", "phone", "key", "person", "iban")
#: Labelled rows that a fit reads at most; above it a fixed hash of the text decides.
SAMPLE = 5_000
#: Words on either side of a marked word that the field looks at.
REACH = 4
#: Words that Viterbi decodes at once.
BATCH = 100_000

STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
CUES = {
    "title": "mr mrs ms dr herr frau monsieur madame mme señor señora sr sra".split(),
    "name": "name nom nombre appelle m'appelle heiße llamo".split(),
    "phone": "phone tel telefon téléphone teléfono mobile fax call dial".split(),
    "card": "card visa karte carte tarjeta".split(),
    "key": "token api_key secret password key apikey".split(),
    "bank": "iban konto cuenta account".split(),
}
_CUE = {w: k for k, words in CUES.items() for w in words}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]|(?<![^\W_])(?:" + "|".join(sorted(_CUE)) + r")(?![^\W_])", re.IGNORECASE)
_OPEN, _CLOSE = "\"'([{<=", "\"')]}>.,;:!?%$#&*|"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long runs without one cost nothing."""
    done, low = 0, 0
    at = text.find("@")
    while at >= 0:
        if at >= done:
            low = max(low, done)
            start = low + len(text[low:at].rstrip(_LOCAL))
            host = _DOMAIN.match(text, at + 1) if start < at else None
            if host:
                yield start, host.end()
                done = host.end()
        low = at + 1
        at = text.find("@", at + 1)


def patterns(text: str) -> list[tuple[str, int, int]]:
    """The spans of the four exact kinds, each leftmost and apart within its kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def shape(word: str) -> str:
    """Letters as ``A`` and ``a``, digits as ``0``, runs shortened to their length up to four and ``+``."""
    out, last, run = [], "", 0
    for c in word[:48] + "\0":
        kind = "0" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if kind == last:
            run += 1
            continue
        if last:
            out.append(last + (str(run) if run < 5 else "+") if last in "0Aa" else last)
        last, run = kind, 1
    return "".join(out[:14])


def core(word: str) -> tuple[int, int]:
    """Start and end of a word without brackets, quotes and stops around it."""
    a = len(word) - len(word.lstrip(_OPEN))
    return a, max(a, len(word.rstrip(_CLOSE)))


def _token(text: str, a: int, b: int) -> str:
    """A word, after a line end if one stands before it."""
    return text[a - 1 : b] if a and text[a - 1] == "\n" else text[a:b]


def word_features(token: str) -> list[str]:
    """What the field sees of one word."""
    word = token.removeprefix("\n")
    a, b = core(word)
    body = word[a:b]
    key = body.rpartition("=")[2].strip("\"'") if "=" in body else body
    digits = sum("0" <= c <= "9" for c in body)
    lead = body.partition("=")[0].lower()
    out = ["bias", f"shape={shape(body)}", f"cue={_CUE.get(body.lower()) or (_CUE.get(lead, '-') if '=' in body else '-')}", f"digits={min(digits, 20)}", f"size={min(len(body), 24) // 3}"]
    if word is not token:
        out.append("new-line")
    if word[:a]:
        out.append(f"open={word[a - 1]}")
    if word[b:]:
        out.append(f"close={word[b]}")
    if body[:1].isupper() and body[1:2].islower():
        out.append("capital")
    if "@" in body:
        out.append("at")
        if _DOMAIN.fullmatch(body.rpartition("@")[2]):
            out.append("at-host")
    if len(key) >= 16 and key.isalnum() and digits >= 3 and any(c.isalpha() for c in key):
        out.append("dense")
    if digits == len(body) and digits >= 12:
        out.append("checked" if digits <= 19 and luhn(body) else "unchecked")
    parts = body.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        out.append("quad" if all(len(p) <= 3 and int(p) <= 255 for p in parts) else "big-quad")
    if re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{0,30}", body):
        out.append("bank")
    return out


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) of each stretch of a text."""
    marks = [m.start() for m in _MARK.finditer(text)]
    if not marks:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    at = np.searchsorted(np.array([a for a, _ in words]), np.array(marks), side="right") - 1
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(at - REACH, 0), 1)
    np.add.at(near, np.minimum(at + REACH + 1, len(words)), -1)
    inside = np.diff(np.r_[0, (np.cumsum(near[:-1]) > 0).astype(np.int8), 0])
    return [words[a:b] for a, b in zip(np.flatnonzero(inside == 1), np.flatnonzero(inside == -1))]


def _batches(lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Groups of sequences, longest first: their numbers, first rows, and how many reach each step."""
    first = np.r_[0, np.cumsum(lengths)][:-1]
    order = np.argsort(-lengths, kind="stable")
    a = 0
    while a < len(order):
        size, b = 0, a
        while b < len(order) and (b == a or size + lengths[order[b]] <= BATCH):
            size += lengths[order[b]]
            b += 1
        chosen = order[a:b]
        live = np.searchsorted(-lengths[chosen], -np.arange(lengths[chosen[0]]), side="left")
        yield chosen, first[chosen], live.tolist()
        a = b


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best states of sequences whose word scores stand one after the other in ``scores``."""
    path = np.zeros(len(scores), np.int64)
    for chosen, first, live in _batches(lengths):
        best, back = scores[first] + start, []
        for t, n in enumerate(live[1:], 1):
            ways = best[:n, :, None] + steps
            back.append(ways.argmax(axis=1))
            # Shorter sequences have ended and keep their last scores.
            best = np.concatenate([ways.max(axis=1) + scores[first[:n] + t], best[n:]])
        state = best.argmax(axis=1)
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            path[first[:n] + t] = state[:n]
            if t:
                state[:n] = back[t - 1][np.arange(n), state[:n]]
    return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def likelihood(
    scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, start: np.ndarray, states: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of ``states``, and its gradient by word scores, steps and starts."""
    k = scores.shape[1]
    total, by_word, by_step, by_start = 0.0, np.zeros_like(scores), np.zeros((k, k)), np.zeros(k)
    hot = np.eye(k)
    for _, first, live in _batches(lengths):
        fore, back = [scores[first] + start], [None] * len(live)
        for t, n in enumerate(live[1:], 1):
            fore.append(_logsum(fore[-1][:n, :, None] + steps, 1) + scores[first[:n] + t])
        back[-1] = np.zeros((live[-1], k))
        for t in range(len(live) - 2, -1, -1):
            n, more = live[t], live[t + 1]
            back[t] = np.zeros((n, k))
            back[t][:more] = _logsum(steps + (scores[first[:more] + t + 1] + back[t + 1])[:, None, :], 2)
        whole = _logsum(fore[0] + back[0], 1)
        true = states[first]
        total += (scores[first, true] + start[true]).sum() - whole.sum()
        by_start += (hot[true] - np.exp(fore[0] + back[0] - whole[:, None])).sum(axis=0)
        for t, n in enumerate(live):
            rows = first[:n] + t
            by_word[rows] = hot[states[rows]] - np.exp(fore[t] + back[t] - whole[:n, None])
            if t:
                was, now = states[rows - 1], states[rows]
                total += (scores[rows, now] + steps[was, now]).sum()
                pair = fore[t - 1][:n, :, None] + steps + (scores[rows] + back[t])[:, None, :] - whole[:n, None, None]
                by_step -= np.exp(pair).sum(axis=0)
                np.add.at(by_step, (was, now), 1)
    return float(total), by_word, by_step, by_start


def maximise(value, x: np.ndarray, rounds: int = 150, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton ascent; ``value(x)`` gives the function and its gradient."""
    f, g = value(x)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, scale = g.copy(), []
        for s, y in reversed(kept):
            scale.append((s @ way) / (y @ s))
            way -= scale[-1] * y
        if kept:
            s, y = kept[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), c in zip(kept, reversed(scale)):
            way += s * (c - (y @ way) / (y @ s))
        rise, size = g @ way, 1.0 if kept else 1 / max(np.abs(g).sum(), 1.0)
        for _ in range(30):
            new, grad = value(x + size * way)
            if new >= f + 1e-4 * size * rise:
                break
            size /= 2
        else:
            return x
        s, y = size * way, g - grad
        x, g = x + s, grad
        if s @ y > 1e-10:
            kept = [*kept, (s, y)][-memory:]
        if abs(new - f) < 1e-7 * max(1.0, abs(f)):
            return x
        f = new
    return x


@dataclass
class Field:
    """Weights of features by state for a word itself and its neighbours, of steps and of starts."""

    features: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray
    seen: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)

    #: Words kept with their scores; long ones never are.
    MEMORY = 20_000

    def _scores_of(self, word: str) -> np.ndarray:
        """Scores that a word gives itself, the next word, the word before and the one after next: (4, states)."""
        at = self.seen.get(word)
        if at is not None:
            return self.rows[at]
        names = word_features(word)
        out = np.stack([self.weights[[self.features[p + n] for n in names if p + n in self.features]].sum(axis=0) for p in ("", "-", "+", "--")])
        if len(word) <= 40:
            if len(self.seen) >= self.MEMORY:
                self.seen.clear()
                self.rows.clear()
            self.seen[word] = len(self.rows)
            self.rows.append(out)
        return out

    def label(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Spans of each text."""
        whose, sequences = [], []
        for i, text in enumerate(texts):
            for words in stretches(text):
                whose.append(i)
                sequences.append(words)
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not sequences:
            return found
        lengths = np.array([len(s) for s in sequences])
        own = np.stack([self._scores_of(_token(texts[i], a, b)) for i, s in zip(whose, sequences) for a, b in s])
        scores = own[:, 0].copy()
        ends = np.cumsum(lengths)
        begin = np.zeros(len(scores), bool)
        begin[np.r_[0, ends[:-1]]] = True
        later = np.flatnonzero(~begin)
        scores[later] += own[later - 1, 1]
        scores[later - 1] += own[later, 2]
        third = later[~begin[later - 1]]
        scores[third] += own[third - 2, 3]
        path = viterbi(scores, lengths, self.steps, self.start)
        for i, words, states in zip(whose, sequences, np.split(path, ends[:-1])):
            if states.any():
                found[i].extend(_spans(texts[i], words, states.tolist()))
        return found


def _spans(text: str, words: list[tuple[int, int]], states: list[int]) -> Iterator[tuple[str, int, int]]:
    """Runs of one kind; a run starts at B, or where the kind changes."""
    at = 0
    while at < len(words):
        kind, end = (states[at] + 1) // 2, at + 1
        if not kind:
            at = end
            continue
        while end < len(words) and states[end] == 2 * kind:
            end += 1
        first, last = text[slice(*words[at])], text[slice(*words[end - 1])]
        a, b = words[at][0] + core(first)[0], words[end - 1][0] + core(last)[1]
        if end - at > 1 and a > words[at][0] and text[a - 1] == "(" and ")" in first:
            a -= 1  # the bracket closes within the span
        if KINDS[kind - 1] == "key" and "=" in first:
            a = max(a, words[at][0] + first.rindex("=") + 1)
            a += len(text[a:b]) - len(text[a:b].lstrip(_OPEN))
        if a < b:
            yield KINDS[kind - 1], a, b
        at = end


def parse_spans(spans: str | None) -> list[tuple[str, int, int]]:
    """``kind:start:end,...``; kinds that are not known are left out."""
    cut = [s.split(":") for s in (spans or "").split(",") if s]
    return [(k, int(a), int(b)) for k, a, b in cut if k in KINDS]


def train(rows: list[tuple[str, str]], ridge: float = 0.3) -> Field:
    """The field of labelled ``(text, spans)``; without rows nothing is ever found."""
    names: dict[str, int] = {}
    where, words_of, states, lengths = [], [], [], []
    for text, spans in rows:
        marks = parse_spans(spans)
        for words in stretches(text):
            lengths.append(len(words))
            before = None
            for a, b in words:
                hit = next((s for s in marks if a < s[2] and s[1] < b), None)
                states.append(0 if hit is None else 2 * KINDS.index(hit[0]) + (2 if hit is before else 1))
                before = hit
            own = [word_features(_token(text, a, b)) for a, b in words]
            for i, f in enumerate(own):
                full = [*f, *("-" + n for n in own[i - 1] if i), *("+" + n for n in (own[i + 1] if i + 1 < len(own) else ())), *("--" + n for n in (own[i - 2] if i > 1 else ()))]
                where.extend([len(words_of)] * len(full))
                words_of.append([names.setdefault(n, len(names)) for n in full])
    k = len(STATES)
    if not lengths:
        return Field({}, np.zeros((0, k)), np.zeros((k, k)), np.zeros(k))
    y, sizes = np.array(states), np.array(lengths)
    row, col = np.array(where), np.concatenate([np.array(x) for x in words_of])
    starts = np.r_[0, np.cumsum([len(x) for x in words_of])][:-1]
    order = np.argsort(col, kind="stable")
    heads = np.searchsorted(col[order], np.arange(len(names)))
    n = len(names) * k

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, steps, start = x[:n].reshape(-1, k), x[n : n + k * k].reshape(k, k), x[n + k * k :]
        f, by_word, by_step, by_start = likelihood(np.add.reduceat(w[col], starts, axis=0), sizes, steps, start, y)
        by_feature = np.add.reduceat(by_word[row[order]], heads, axis=0)
        return f - ridge / 2 * float(x @ x), np.r_[by_feature.ravel(), by_step.ravel(), by_start] - ridge * x

    x = maximise(value, np.zeros(n + k * k + k))
    return Field(names, x[:n].reshape(-1, k), x[n : n + k * k].reshape(k, k), x[n + k * k :])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Field:
    """Train on a table ``(text, spans)``; rows with null texts are left out, at most about ``sample`` are read."""
    rows = labelled.select("text", "spans").where("text is not null")
    share = int(min(1.0, sample / max(rows.count(), 1)) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).collect()
    return train(sorted((r["text"], r["spans"] or "") for r in chosen))


def find_personal(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of ``(kind, start, end, exact)``.

    Exact spans come from the patterns. The field's spans are added where no exact one overlaps
    them; positions are code points, ends exclusive. Spans ascend by start, then by ``KINDS``. Null
    and empty texts have none; texts of any length are read whole. Repeated rows and null ids each
    come back; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rank = {k: i for i, k in enumerate(KINDS)}

    def spans_of(texts: list[str]) -> list[list[dict]]:
        out = []
        for text, more in zip(texts, model.label(texts)):
            exact = patterns(text)
            ends = sorted((a, b) for _, a, b in exact)
            found = [(k, a, b, True) for k, a, b in exact]
            if more:
                lows, highs = np.array([a for a, _ in ends]), np.maximum.accumulate([b for _, b in ends]) if ends else None
                for k, a, b in more:
                    below = int(np.searchsorted(lows, b)) if ends else 0
                    if not below or highs[below - 1] <= a:
                        found.append((k, a, b, False))
            found.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
            out.append([dict(zip(("kind", "start", "end", "exact"), s)) for s in found])
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                texts = [t if isinstance(t, str) else "" for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "spans": spans_of(texts)})

    as_text = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = as_text.mapInPandas(work, "doc_id string, spans array<struct<kind: string, start: long, end: long, exact: boolean>>")
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")
