"""Small numpy helpers on one sequence, for tasks that would otherwise explode it into a row per letter."""
from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

import numpy as np
import pyarrow as pa

COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def letters(text: str) -> np.ndarray:
    """Code points, one byte each where all are ASCII."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def distinct_kmers(text: str, k: int, step: int = 1, canonical: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Distinct k-mers at every `step`-th start in ascending order, and how often each stands there.

    Short alphabets are numbered, so that a k-mer is one integer; others are counted as strings.
    """
    n = len(text) - k + 1
    if n <= 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    both = set(text) | (set(text.translate(COMPLEMENT)) if canonical else set())
    alphabet = "".join(sorted(both))
    a = len(alphabet)
    if not alphabet.isascii() or a ** k >= 2 ** 62:
        pieces = (text[i:i + k] for i in range(0, n, step))
        c = Counter(min(p, p[::-1].translate(COMPLEMENT)) for p in pieces) if canonical else Counter(pieces)
        names = sorted(c)
        return pa.array(names, pa.string()), np.array([c[x] for x in names], np.int64)
    number = np.zeros(128, np.int64)
    number[letters(alphabet)] = np.arange(a)
    x = _numbers(number[letters(text)], k, n, a, range(k))
    if canonical:
        x = np.minimum(x, _numbers(number[letters(text.translate(COMPLEMENT))], k, n, a, reversed(range(k))))
    x, cnt = np.unique(x[::step], return_counts=True)
    spelled = letters(alphabet)[x[:, None] // a ** np.arange(k - 1, -1, -1) % a]
    ends = np.arange(0, len(x) * k + 1, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(x), pa.py_buffer(ends.tobytes()), pa.py_buffer(spelled.tobytes())), cnt


def _numbers(digits: np.ndarray, k: int, n: int, base: int, order) -> np.ndarray:
    x = np.zeros(n, np.int64)
    for j in order:
        x = x * base + digits[j:j + n]
    return x


def rising_edges(text: str, scale: Mapping[str, float], width: int, cut: float) -> tuple[int, float]:
    """How often the mean of `width` letters rises above `cut`, and the largest mean."""
    c = letters(text)
    top = int(c.max()) + 1
    table = np.zeros(top)
    for x, h in scale.items():
        if ord(x) < top:
            table[ord(x)] = h
    h = table[c]
    n = len(h) - width + 1
    total = np.zeros(n)
    for j in range(width):
        total += h[j:j + n]
    mean = total / width
    high = mean > cut
    return int(high[0]) + int((high[1:] & ~high[:-1]).sum()), float(mean.max())


def stems_and_loops(bases: str, brackets: str) -> list[int]:
    """Length and GC count of the first four stems, of the loops in the second, third and fourth, and of those between
    the third and the fourth; 0 where there is none."""
    c = letters(brackets)
    m = len(c)
    b = np.zeros(m, bool)
    base = letters(bases)[:m]
    b[:len(base)] = (base == ord("G")) | (base == ord("C"))
    up, down = c == ord(">"), c == ord("<")
    s = np.cumsum(up.astype(np.int64) - down)
    floor = np.minimum.accumulate(np.minimum(s, 0))  # a close on an empty stack is ignored
    before = np.concatenate([np.zeros(1, np.int64), floor[:-1]])[:m]
    at = np.nonzero(up | (down & (floor == before)))[0]
    level = (s - floor + down)[at]
    order = np.argsort(level, kind="stable")
    i, level = at[order], level[order]
    pair = np.nonzero(down[i[1:]] & (level[1:] == level[:-1]))[0]
    first, last = i[pair], i[pair + 1]
    order = np.argsort(first)
    first, last = first[order], last[order]
    stem = np.cumsum(np.concatenate([np.ones(min(1, len(first)), np.int64), np.diff(first) != 1]))
    out, ends = [], []
    for k in range(1, 5):
        lo, hi = np.searchsorted(stem, [k, k + 1])
        f, z = first[lo:hi], last[lo:hi]
        out += [2 * len(f), int(b[f].sum() + b[z].sum())]
        ends.append((int(f[0]), int(f[-1]), int(z.min()), int(z.max())) if len(f) else None)
    if ends[3] is None:
        return out + [0] * 8
    dot = np.concatenate([[0], (c == ord(".")).astype(np.int8), [0]])
    start, stop = np.nonzero(np.diff(dot) == 1)[0], np.nonzero(np.diff(dot) == -1)[0]
    gc = np.concatenate([[0], np.cumsum(b)])
    size, gcs = stop - start, gc[stop] - gc[start]
    for _, end5, start3, _ in ends[1:]:
        inside = np.nonzero((start > end5) & (stop <= start3))[0][:1]
        out += [int(size[inside].sum()), int(gcs[inside].sum())]
    between = (start >= ends[2][3]) & (stop <= ends[3][0])
    return out + [int(size[between].sum()), int(gcs[between].sum())]
