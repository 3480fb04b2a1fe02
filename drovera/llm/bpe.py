"""Exact tokens of the public word-level BPE vocabulary, without per-merge Python.

Pre-tokens that are not yet known are encoded together: a batch is one flat array of symbol ids with
a sequence number each, and every round applies, in all sequences at once, the sequence's pair of
lowest rank. What survives are the tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex

#: What the vocabulary file declares (fixed values).
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
END_OF_WORD = "</w>"
_SPACE = r"[\t-\r \x85\xa0  -     　]"
#: Blanks to str.split() that are not white space to the vocabulary's normaliser.
_ODD = regex.compile("[\x1c-\x1f]")
_SPLIT_SPACE = regex.compile(_SPACE + "+")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")  # chunks hold no white space
_SPECIAL = regex.compile("|".join(map(regex.escape, SPECIALS)))
_NO_RANK = np.int64(1) << 40
_SHIFT = np.uint64(44)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


class WordBpe:
    """Encoder with a bounded memory of known chunks; one per process and file.

    Chunks of up to ``LONGEST`` characters are remembered until they take about ``MEMORY`` bytes, then
    all are forgotten; longer ones, which rarely return, only for the texts that are encoded together.
    """

    MEMORY = 128_000_000
    LONGEST = 40
    BATCH = 1_000_000
    _ENTRY = 200  # bytes of an entry besides its characters and ids, about

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + END_OF_WORD] for s in symbols], np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in map(tuple, merges)], np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        self.keys, self.made = keys, pairs[:, 2]
        self.tables = self._hashed(keys)
        # A merge whose product has a pair of lower rank must not run ahead of that pair.
        first = np.full(self.width, len(pairs), np.int64)
        for side in (0, 1):
            np.minimum.at(first, pairs[:, side], np.arange(len(pairs)))
        self.ahead = first[self.made] > np.arange(len(pairs))
        self.chunks: dict[str, bytes] = {}
        self.held = 0
        self.passing: list[str] = []

    def _remember(self, chunks: list[str], ids: list[bytes]) -> None:
        """Chunks that are not known yet, with their ids."""
        self.chunks.update(zip(chunks, ids))
        long = [c for c in chunks if len(c) > self.LONGEST]
        self.passing += long
        gone = sum(len(c) + len(self.chunks[c]) + self._ENTRY for c in long)
        self.held += sum(map(len, chunks)) + sum(map(len, ids)) + self._ENTRY * len(chunks) - gone

    def _forget(self) -> None:
        """Long chunks of earlier texts go, and all chunks where they take too much memory."""
        for c in self.passing:
            del self.chunks[c]
        self.passing.clear()
        if self.held > self.MEMORY:
            self.chunks.clear()
            self.held = 0

    @staticmethod
    def _hashed(keys: np.ndarray) -> list[tuple[np.uint64, np.ndarray]]:
        """Tables from a hash of a key to its rank; a key that loses its cell stands in the next table."""
        tables, rest, rng = [], np.arange(len(keys)), np.random.default_rng(1)
        while len(rest):
            by = np.uint64(rng.integers(1 << 62, dtype=np.int64) * 2 + 1)
            cell = (keys[rest].astype(np.uint64) * by) >> _SHIFT
            table = np.zeros(1 << (64 - int(_SHIFT)), np.int32)
            table[cell] = rest
            tables.append((by, table))
            rest = rest[table[cell] != rest]
        return tables

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; no rank for pairs that never merge."""
        key = left * self.width + right
        out = np.full(len(key), _NO_RANK)
        for by, table in self.tables:
            at = table[(key.view(np.uint64) * by) >> _SHIFT]
            fits = self.keys[at] == key
            out[fits] = at[fits]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Token ids of each non-empty piece as little-endian unsigned 32-bit bytes."""
        raw = [p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        last = np.cumsum(size) - 1
        seq, ids = np.repeat(np.arange(len(raw)), size), self.inner[data]
        ids[last] = self.final[data[last]]
        rank = np.full(len(ids), _NO_RANK)  # of the pair that starts here
        same = np.flatnonzero(seq[:-1] == seq[1:])
        rank[same] = self._ranks(ids[same], ids[same + 1])
        done_seq, done_ids = [], []
        while len(ids):
            new = np.empty(len(seq), bool)
            new[0], new[1:] = True, seq[1:] != seq[:-1]
            starts = np.flatnonzero(new)
            low = np.minimum.reduceat(rank, starts)
            low_of = np.repeat(low, np.diff(starts, append=len(seq)))
            live = low_of < _NO_RANK
            if not live.all():
                done_seq.append(seq[~live])
                done_ids.append(ids[~live])
                seq, ids, rank, low_of = seq[live], ids[live], rank[live], low_of[live]
                if not len(ids):
                    break
                live = np.ones(len(ids), bool)
            hit = np.flatnonzero(rank == low_of)
            # In a run of overlapping places every other one merges, from the left.
            head = np.diff(hit, prepend=-2) > 1
            run = np.maximum.accumulate(np.where(head, hit, 0))
            opens = np.diff(seq[hit], prepend=-1) != 0
            hit = hit[((hit - run) % 2 == 0) & (self.ahead[rank[hit]] | opens)]
            ids[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            # Only pairs that touch a product have a new rank.
            at = np.cumsum(live)[hit] - 1
            seq, ids, rank = seq[live], ids[live], rank[live]
            touched = np.concatenate([at, at[at > 0] - 1])
            within = touched + 1 < len(seq)
            within[within] = seq[touched[within]] == seq[touched[within] + 1]
            rank[touched] = _NO_RANK
            pairs = touched[within]
            rank[pairs] = self._ranks(ids[pairs], ids[pairs + 1])
        order = np.argsort(np.concatenate(done_seq), kind="stable")
        flat = np.concatenate(done_ids)[order].astype("<u4").tobytes()
        counts = np.bincount(np.concatenate(done_seq), minlength=len(raw))
        return [flat[e - 4 * c : e] for e, c in zip((np.cumsum(counts) * 4).tolist(), counts.tolist())]

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks (runs without white space, normalised) that are not known."""
        cut = [
            [c] if c.isalpha() else [c[:-1], c[-1]] if c[-1] in ".,;:!?" and c[:-1].isalpha() else _PIECES.findall(c)
            for c in chunks
        ]
        # A piece is a chunk too, and its own only piece.
        fresh = list(set().union(*cut).difference(self.chunks))
        for i in range(0, len(fresh), 100_000):
            self._remember(fresh[i : i + 100_000], self.encode_pieces(fresh[i : i + 100_000]))
        whole = [(c, ps) for c, ps in zip(chunks, cut) if len(ps) > 1 and c not in self.chunks]
        self._remember([c for c, _ in whole], [b"".join([self.chunks[p] for p in ps]) for _, ps in whole])

    @staticmethod
    def _words(text: str) -> list[str]:
        """Normalised runs without white space of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [w for w in _SPLIT_SPACE.split(text) if w] if _ODD.search(text) else text.split()

    def _segments(self, text: str) -> list[list[str]]:
        """Words of a text; a special string is a segment of its own with an empty first word."""
        if "<|" not in text:
            return [self._words(text)]
        out, at = [], 0
        for m in _SPECIAL.finditer(text):
            out += [self._words(text[at : m.start()]), ["", m[0]]]
            at = m.end()
        return [*out, self._words(text[at:])]

    def _ids(self, words: list[str]) -> bytes:
        if words and not words[0]:
            return int(self.specials[words[1]]).to_bytes(4, "little")
        return b"".join(map(self.chunks.__getitem__, words))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each whole text in turn, four little-endian bytes each.

        Texts are taken a few million characters at a time, so that what is new in them is merged
        together; special strings are one token each; None and empty texts have no ids.
        """
        i = 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and size < self.BATCH:
                group.append(self._segments(texts[i] or ""))
                size += len(texts[i] or "")
                i += 1
            self._forget()
            words = set().union(*(ws for segments in group for ws in segments if ws and ws[0]))
            self._learn(list(words.difference(self.chunks)))
            for segments in group:
                yield self._ids(segments[0]) if len(segments) == 1 else b"".join(map(self._ids, segments))

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    return WordBpe(path)
