"""Sums over all pairs of two sets of places, formed by boxes of places instead of pair by pair.

The places of a chunk are halved along their widest side into a tree of boxes. Pairs of a box and a place that all have one
weight (or lie in one distance class) are summed as a whole; only boxes that a border crosses are met place by place, so these
sums are those of all pairs. The weight 1/(d + e) has no border: it is interpolated on Chebyshev nodes of boxes that
lie `APART` times their half width away, which leaves a relative error below 1e-12, and near boxes are met place by place.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Chebyshev nodes of a side, their largest number in a box (two sides), and how many half widths away a box is interpolated.
NODES, MOST_NODES, APART = 16, 512, 3.0
#: Places of the smallest boxes: for interpolated sums and for sums with borders.
SMOOTH_LEAF, BORDER_LEAF = 512, 64
#: Numbers of one intermediate array.
STRIP = 1 << 17
_T = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
_W = (-1.0) ** np.arange(NODES) * np.sin(np.pi * (np.arange(NODES) + 0.5) / NODES)


class Boxes:
    """Tree of boxes: `order` of the places, `x` in that order, and per level where boxes begin and their corners."""

    def __init__(self, p: np.ndarray, size: int):
        order, starts = np.arange(len(p)), [np.array([0, len(p)])]
        while np.diff(starts[-1]).max() > size:
            s = starts[-1]
            m = (s[:-1] + s[1:]) // 2
            for a, b, c in zip(s[:-1], m, s[1:]):
                r = order[a:c]
                order[a:c] = r[np.argpartition(p[r, int(np.ptp(p[r], axis=0).argmax())], b - a)]
            starts.append(np.sort(np.concatenate([s, m])))
        self.order, self.starts, self.x = order, starts, p[order]
        low, high = np.minimum.reduceat(self.x, starts[-1][:-1]), np.maximum.reduceat(self.x, starts[-1][:-1])
        self.corners = [(low, high)]
        for _ in starts[1:]:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            self.corners.insert(0, (low, high))

    def leaves(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        s = self.starts[-1].tolist()
        for i, (low, high) in enumerate(zip(*self.corners[-1])):
            yield slice(s[i], s[i + 1]), low, high

    def meet(self, low: np.ndarray, high: np.ndarray, judge: Callable) -> np.ndarray:
        """Smallest boxes that are left when judge(level, boxes, least, largest distance to the box low..high) has settled others."""
        left = np.zeros(1, np.int64)
        for level, (lo, hi) in enumerate(self.corners):
            gap = np.sqrt((np.maximum(0, np.maximum(lo[left] - high, low - hi[left])) ** 2).sum(1))
            span = np.sqrt((np.maximum(hi[left] - low, high - lo[left]) ** 2).sum(1))
            left = left[~judge(level, left, gap, span)]
            if not len(left):
                break
            if level + 1 < len(self.corners):
                left = np.concatenate([2 * left, 2 * left + 1])
        return np.sort(left)

    def members(self, leaves: np.ndarray) -> np.ndarray:
        s = self.starts[-1]
        n = s[leaves + 1] - s[leaves]
        return np.repeat(s[leaves] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _grid(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sides = [(a + b) / 2 + (b - a) / 2 * _T if b > a else np.array([a]) for a, b in zip(low, high)]
    return np.stack([g.ravel() for g in np.meshgrid(*sides, indexing="ij")], axis=1)


def _basis(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Value of every node's polynomial at every place."""
    out = np.ones((len(x), 1))
    for j in np.flatnonzero(high > low):
        d = (2 * x[:, j] - low[j] - high[j])[:, None] / (high[j] - low[j]) - _T
        on = d == 0
        w = _W / np.where(on, 1.0, d)
        w /= w.sum(1, keepdims=True)
        hit = on.any(1)
        w[hit] = on[hit]
        out = (out[:, :, None] * w[:, None, :]).reshape(len(x), -1)
    return out


def _nodes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Number of nodes per box."""
    return float(NODES) ** (high > low).sum(1)


def _inverse(x: np.ndarray, y: np.ndarray, e: float, q: np.ndarray, q2: np.ndarray, own: bool = False) -> np.ndarray:
    """Sums of q times 1/(d + e) and of q2 times its square over y for every row of x; `own`: x is y and a row does not meet itself."""
    out = np.empty((len(x), q.shape[1] + q2.shape[1]))
    step = max(1, STRIP // max(1, len(y)))
    cols = y.T.copy()
    for i in range(0, len(x), step):
        w = np.zeros((len(x[i:i + step]), len(y)))
        for j, c in enumerate(cols):
            t = x[i:i + step, j, None] - c
            t *= t
            w += t
        np.sqrt(w, out=w)
        w += e
        np.reciprocal(w, out=w)
        if own:
            w[np.arange(len(w)), i + np.arange(len(w))] = 0.0
        out[i:i + step, :q.shape[1]] = w @ q
        w *= w
        out[i:i + step, q.shape[1]:] = w @ q2
    return out


def inverse_sums(a: Boxes, b: Boxes, e: float, q: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Per place of a (as it came): sums over the places of b of q / (d + e) and of q2 / (d + e)^2; with b the same object
    as a, places do not meet themselves."""
    charges, k = np.hstack([q, q2])[b.order], q.shape[1]
    packed: list[list] = []  # per level and box: nodes and their charges, where they are fewer than the places
    dense = [(_nodes(*c) <= MOST_NODES) & (_nodes(*c) < np.diff(s)) for c, s in zip(b.corners, b.starts)]
    for level in range(len(b.corners) - 1, -1, -1):
        (low, high), s, row = b.corners[level], b.starts[level], []
        for i in range(len(low)):
            if not dense[level][i]:
                row.append((b.x[s[i]:s[i + 1]], charges[s[i]:s[i + 1]]) if s[i + 1] - s[i] <= MOST_NODES * 4 else None)
                continue
            if level == len(b.corners) - 1 or packed[0][2 * i] is None or packed[0][2 * i + 1] is None:
                x, c = b.x[s[i]:s[i + 1]], charges[s[i]:s[i + 1]]
            else:
                (x1, c1), (x2, c2) = packed[0][2 * i], packed[0][2 * i + 1]
                x, c = np.concatenate([x1, x2]), np.concatenate([c1, c2])
            total = sum(_basis(x[j:j + 4096], low[i], high[i]).T @ c[j:j + 4096] for j in range(0, len(x), 4096))
            row.append((_grid(low[i], high[i]), total))
        packed.insert(0, row)
    half = [(high - low).max(1) / 2 for low, high in b.corners]
    out = np.zeros((len(a.x), charges.shape[1]))
    own = b is a
    for at, low, high in a.leaves():
        m = float(NODES) ** int((high > low).sum())
        fold = m <= MOST_NODES and m < at.stop - at.start
        width = (high - low).max() / 2 if fold else 0.0
        far: list[tuple] = []

        def judge(level, boxes, gap, span):
            on = dense[level][boxes] & (gap > 0) & (gap >= APART * np.maximum(half[level][boxes], width))
            far.extend(packed[level][i] for i in boxes[on].tolist())
            return on

        near = b.meet(low, high, judge)
        x = a.x[at]
        if own:
            near = near[b.starts[-1][near] != at.start]
            out[at] += _inverse(x, x, e, charges[at, :k], charges[at, k:], True)
        if len(near):
            of = b.members(near)
            out[at] += _inverse(x, b.x[of], e, charges[of, :k], charges[of, k:])
        if far:
            y, c = np.concatenate([f[0] for f in far]), np.concatenate([f[1] for f in far])
            if fold:
                out[at] += _basis(x, low, high) @ _inverse(_grid(low, high), y, e, c[:, :k], c[:, k:])
            else:
                out[at] += _inverse(x, y, e, c[:, :k], c[:, k:])
    back = np.empty_like(out)
    back[a.order] = out
    return back


def within_sums(a: Boxes, b: Boxes, radius: float, qa: np.ndarray, qb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place of a (as it came) the sum of qb over the places of b with 0 < d <= radius, and per place of b that of qa
    over the places of a."""
    qa, qb = qa[a.order], qb[b.order]
    totals = [np.add.reduceat(qb, s[:-1]) for s in b.starts]
    out, other = np.zeros((len(a.x), qb.shape[1])), np.zeros((len(b.x), qa.shape[1]))
    met = [np.zeros((len(s) - 1, qa.shape[1])) for s in b.starts]  # what boxes of b meet as a whole
    for at, low, high in a.leaves():
        whole, mine = np.zeros(qb.shape[1]), qa[at].sum(0)

        def judge(level, boxes, gap, span):
            on = (gap > 0) & (span < radius * (1 - 1e-9))
            whole[:] += totals[level][boxes[on]].sum(0)
            met[level][boxes[on]] += mine
            return on | (gap > radius * (1 + 1e-9))

        of = b.members(b.meet(low, high, judge))
        out[at] = whole
        step = max(1, STRIP * 4 // (at.stop - at.start))
        for j in range(0, len(of), step):
            d = _distances(a.x[at], b.x[of[j:j + step]])
            w = ((d > 0) & (d <= radius)).astype(float)
            out[at] += w @ qb[of[j:j + step]]
            other[of[j:j + step]] += w.T @ qa[at]
    for s, m in zip(b.starts, met):
        other += np.repeat(m, np.diff(s), axis=0)
    back = np.empty_like(out), np.empty_like(other)
    back[0][a.order], back[1][b.order] = out, other
    return back


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        t = x[:, j, None] - y[None, :, j]
        t *= t
        d += t
    return np.sqrt(d, out=d)


def class_sums(a: Boxes, b: Boxes, edges: np.ndarray, ca: np.ndarray, sa: np.ndarray, cb: np.ndarray, sb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ca cb and of sa sb over all pairs of a place of a and one of b, per class (edges[c], edges[c + 1]] of their
    distance; with b the same object as a, over all ordered pairs of two different places."""
    k, own = len(edges) - 1, b is a
    ca, sa, cb, sb = ca[a.order], sa[a.order], cb[b.order], sb[b.order]
    totals = [np.add.reduceat(np.column_stack([cb, sb]), s[:-1]) for s in b.starts]
    out = np.zeros((2, k + 2))  # before, within and behind the classes
    for at, low, high in a.leaves():
        whole = np.zeros((k + 2, 2))

        def judge(level, boxes, gap, span):
            c = np.searchsorted(edges, gap * (1 - 1e-9), side="left")
            on = (gap > 0) & (c == np.searchsorted(edges, span * (1 + 1e-9), side="left"))
            np.add.at(whole, c[on], totals[level][boxes[on]])
            return on

        of = b.members(b.meet(low, high, judge))
        out[0] += ca[at].sum() * whole[:, 0]
        out[1] += sa[at].sum() * whole[:, 1]
        step = max(1, STRIP // (at.stop - at.start))
        for j in range(0, len(of), step):
            to = of[j:j + step]
            d = _distances(a.x[at], b.x[to])
            c = np.zeros(d.shape, np.int16 if k > 120 else np.int8)
            for edge in edges:
                c += d > edge
            n, zz = ca[at, None] * cb[to], sa[at, None] * sb[to]
            if own:
                n[to == np.arange(at.start, at.stop)[:, None]] = 0.0
                zz[to == np.arange(at.start, at.stop)[:, None]] = 0.0
            c = c.ravel().astype(np.intp)
            out[0] += np.bincount(c, n.ravel(), minlength=k + 2)
            out[1] += np.bincount(c, zz.ravel(), minlength=k + 2)
    return out[0, 1:k + 1], out[1, 1:k + 1]


def z_order(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places near each other mostly get near numbers: bits of the coordinates in turn; rows that are not finite come last."""
    d = x.shape[1]
    bits = max(1, 62 // d)
    on = np.isfinite(x).all(1)
    scale = np.where(high > low, high - low, 1.0)
    t = np.clip((np.where(on[:, None], x, low) - low) / scale, 0, 1)
    cell = np.minimum(t * 2.0 ** bits, 2.0 ** bits - 1).astype(np.int64)
    code = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for j in range(min(d, 62)):
            code = code << 1 | (cell[:, j] >> bit & 1)
    return np.where(on, code, np.iinfo(np.int64).max)
