"""Spans of many image rows cut into runs of one raster cell, and what a fence holds of them, as numpy arrays.

Per-row expressions on lists are interpreted for every element; here a batch of spans is one
calculation. Every span is a row of the arrays ``x0, x1`` (inclusive); runs name their span by number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LONG = 9.2e18
#: Bits that count the spans of one mask open at a pixel; a slice has far fewer spans.
_COUNT = 21


def floored(v: np.ndarray) -> np.ndarray:
    """Floor as the JVM casts it to a long: NaN is 0, what lies beyond the range is its end."""
    f = np.floor(v)
    if not np.isfinite(f).all() or (len(f) and max(f.max(), -f.min()) > _LONG):
        f = np.clip(np.nan_to_num(f, nan=0.0), -_LONG, _LONG)
    return f.astype(np.int64)


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the owner and place within it, for ``counts`` entries of each owner."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def cut_at_cells(
    x0: np.ndarray, x1: np.ndarray, lines: tuple[tuple[np.ndarray, np.ndarray], ...]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(span, first, last)`` between the pixels where one of ``lines`` enters another cell.

    A line ``(start, step)`` is a cell coordinate, linear along the image row. Where it passes a cell or more in
    a pixel every pixel is a run, so there are never more runs than pixels.
    """
    length = np.maximum(x1 - x0 + 1, 1)
    base = np.cumsum(length) - length
    marks = [base]
    for start, step in lines:
        at0, at1 = floored(start + step * x0), floored(start + step * x1)
        lo = np.minimum(at0, at1)
        met = np.abs(at1.astype(np.float64) - at0.astype(np.float64))
        every = met >= length
        counts = np.where(every, length, met).astype(np.int64)
        span, i = _each(counts)
        with np.errstate(all="ignore"):
            x = (lo[span] + 1 + i - start[span]) / step[span]
            x = np.where(step[span] > 0, np.ceil(x), np.floor(x) + 1)
        x = np.where(every[span], x0[span] + i, x)
        ok = (x > x0[span]) & (x <= x1[span])
        marks.append(base[span[ok]] + (x[ok].astype(np.int64) - x0[span[ok]]))
    at = np.sort(np.concatenate(marks))
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    # every span begins with a mark
    span = np.repeat(np.arange(len(base)), np.diff(np.append(np.searchsorted(at, base), len(at))))
    first = x0[span] + (at - base[span])
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    ends = np.append(span[1:] != span[:-1], True) if len(span) else np.zeros(0, dtype=bool)
    last[ends] = x1[span[ends]]
    return span, first, last


def edges_of(fence: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which spans have a fence, how many edges, and the edges' ``ax ay bx by`` one span after the other."""
    counts = fence.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    names = [f.name for f in fence.type.value_type]
    parts = dict(zip(names, fence.flatten().flatten()))
    ends = [parts[n].to_numpy(zero_copy_only=False).astype(np.float64) for n in ("ax", "ay", "bx", "by")]
    return fence.is_valid().to_numpy(zero_copy_only=False), counts, ends


def inside_fence(
    span: np.ndarray, first: np.ndarray, last: np.ndarray, *, y: np.ndarray, of: np.ndarray, edges: tuple[np.ndarray, list[np.ndarray]], width: int
) -> np.ndarray:
    """Pixels of each run inside the fence, as ``geo.inside_runs`` cuts the image row; ``of`` is the fence of each span."""
    counts, ends = edges
    owner, place = _each(counts[of])
    at = (np.cumsum(counts) - counts)[of[owner]] + place
    ax, ay, bx, by = (v[at] for v in ends)
    yc = y[owner] + 0.5
    hit = (ay > yc) != (by > yc)
    owner, yc, ax, ay, bx, by = (v[hit] for v in (owner, yc, ax, ay, bx, by))
    with np.errstate(all="ignore"):
        cut = -floored(-(ax + (yc - ay) * (bx - ax) / (by - ay) - 0.5))
    order = np.lexsort((cut, owner))
    owner, cut = owner[order], cut[order]
    # the crossings of a row pair up: even ones open, odd ones close
    _, place = _each(np.bincount(owner, minlength=len(of)))
    opens = (place % 2 == 0) & np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, dtype=bool)
    at = np.nonzero(opens)[0]
    held, s, e = owner[at], np.maximum(cut[at], 0), np.minimum(cut[at + 1], width)
    # every fence run meets the runs of its span, which lie together
    runs = np.bincount(span, minlength=len(of))
    begin = np.cumsum(runs) - runs
    pair, i = _each(runs[held])
    run = begin[held[pair]] + i
    shared = np.maximum(np.minimum(e[pair], last[run] + 1) - np.maximum(s[pair], first[run]), 0)
    return np.bincount(run, weights=shared, minlength=len(span)).astype(np.int64)


#: A span as ``swept`` packs it: image row, first and last pixel, and a bit for every mask that covers it.
SPAN = np.dtype([("y", "<i4"), ("x0", "<i4"), ("x1", "<i4"), ("on", "<i4")])


def groups_of(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Number of the stretch of equal ``by`` values that each row lies in."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for n in by:
        column = batch.column(n)
        code = pa.array(column.dictionary_encode().indices if not pa.types.is_dictionary(column.type) else column.indices)
        code = code.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.cumsum(new)


def drawn(x: np.ndarray, y: np.ndarray, r: np.ndarray, *, top: np.ndarray, bottom: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Rows ``top..bottom`` of filled circles as ``(circle, y, x0, x1)``, clipped to the frame's width."""
    circle, i = _each(np.maximum(bottom - top + 1, 0))
    at = top[circle] + i
    dy, radius = at - y[circle], r[circle]
    half = np.floor(np.sqrt((radius * radius - dy * dy).astype(np.float64))).astype(np.int64)
    x0, x1 = np.maximum(x[circle] - half, 0), np.minimum(x[circle] + half, width - 1)
    ok = x0 <= x1
    return circle[ok], at[ok], x0[ok], x1[ok]


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and their places before; both are sorted as one number where they fit in one."""
    bits = len(key).bit_length()
    if 0 <= key.min() and key.max() < 2 ** (62 - bits):
        both = np.sort((key << bits) | np.arange(len(key)))
        return both >> bits, both & (2**bits - 1)
    order = np.argsort(key)
    return key[order], order


def parted(
    group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, on: np.ndarray, *, masks: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap parted into disjoint ones of the same masks, by group and row; ``on`` has a bit for every mask."""
    if not len(group):
        return group, y, x0, x1, on
    low, rows, left = y.min(), y.max() - y.min() + 1, x0.min()
    wide = x1.max() + 2 - left
    base = (group * rows + (y - low)) * wide - left
    key, order = _sorted(np.concatenate([base + x0, base + x1 + 1]))
    last = np.append(key[1:] != key[:-1], True)
    at, state = key[last], np.zeros(np.count_nonzero(last), dtype=np.int64)
    for k in range(0, masks, 3):
        # a span opens and closes every mask it belongs to; the counts of three masks are summed as one number
        step = (on >> k) & 1
        for i in range(1, min(3, masks - k)):
            step = step | ((on >> (k + i)) & 1) << (_COUNT * i)
        count = np.cumsum(np.concatenate([step, -step])[order])[last]
        for i in range(min(3, masks - k)):
            state |= ((count >> (_COUNT * i)) & (2**_COUNT - 1) > 0).astype(np.int64) << (k + i)
    turn = np.nonzero(np.append(state[0] != 0, state[1:] != state[:-1]))[0]
    first, state = at[turn], state[turn]
    end = np.append(first[1:], first[-1:]) - 1
    held = state != 0
    first, end, state = first[held], end[held], state[held]
    line, x = first // wide, first % wide
    return line // rows, line % rows + low, x + left, end % wide + left, state
