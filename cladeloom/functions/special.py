"""Tail probabilities on numpy arrays; applied to small aggregated tables only."""
from __future__ import annotations

import math

import numpy as np



def lgamma(x):
    """log gamma of positive numbers: those below 16 are moved up by 16, where Stirling's series is exact to rounding."""
    x = np.asarray(x, float)
    small = x < 16
    product = np.ones_like(x)
    if small.any():
        low = np.where(small, x, 1.0)
        for i in range(16):
            product = product * (low + i)
        product = np.where(small, product, 1.0)
    y = np.where(small, x + 16, x)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y - np.log(product)


_erfc = np.vectorize(math.erfc, otypes=[float])
TINY = 1e-300


def _beta_cf(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, 20000):
        m2 = 2 * m
        for num in (m * (b - m) * x / ((a + m2 - 1) * (a + m2)),
                    -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < TINY, TINY, c)
            delta = d * c
            h = h * delta
        if np.all(np.abs(delta - 1.0) < 1e-14):
            break
    return h


def _log_inverse_beta(a, b):
    """log Gamma(a + b) / (Gamma(a) Gamma(b)); the larger parameter enters by a difference of Stirling's series, so that
    log gammas of millions do not cancel."""
    p, q = np.maximum(a, b), np.minimum(a, b)
    big = p >= 16
    s = np.where(big, p, 16.0)
    rest = lambda y: (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * y * y)) / (y * y)) / (y * y)) / (y * y)) / y
    return np.where(big, (s + q - 0.5) * np.log1p(q / s) + q * np.log(s) - q + rest(s + q) - rest(s), lgamma(p + q) - lgamma(p)) - lgamma(q)


def betainc(a, b, x, rest=None):
    """Regularised incomplete beta I_x(a, b); `rest` is 1 - x where the caller has it without cancellation."""
    a, b, x, rest = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x, 1 - np.asarray(x, float) if rest is None else rest)))
    inside = (x > 0) & (rest > 0)
    out = np.where(rest <= 0, 1.0, 0.0)
    if inside.any():
        ai, bi, xi, ri = a[inside], b[inside], x[inside], rest[inside]
        swap = xi > (ai + 1) / (ai + bi + 2)
        p, q = np.where(swap, bi, ai), np.where(swap, ai, bi)
        y, z = np.where(swap, ri, xi), np.where(swap, xi, ri)
        log = lambda u, v: np.where(u < 0.5, np.log(u), np.log1p(-np.minimum(v, 0.75)))  # u + v = 1
        front = np.exp(_log_inverse_beta(p, q) + p * log(y, z) + q * log(z, y)) / p
        val = front * _beta_cf(p, q, y)
        out = out.copy()
        out[inside] = np.where(swap, 1 - val, val)
    return np.clip(out, 0.0, 1.0)


def gammaincc(a, x):
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    for i in np.ndindex(a.shape):
        ai, xi = float(a[i]), float(x[i])
        if not (xi > 0):
            out[i] = 1.0 if xi == 0 else np.nan
            continue
        lead = math.exp(-xi + ai * math.log(xi) - math.lgamma(ai))
        if xi < ai + 1:
            term = total = 1.0 / ai
            k = ai
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= xi / k
                total += term
            out[i] = 1.0 - total * lead
        else:
            b = xi + 1 - ai
            c = 1 / TINY
            d = 1 / b
            h = d
            for k in range(1, 100000):
                an = -k * (k - ai)
                b += 2
                d = 1 / (an * d + b)
                c = b + an / c
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = lead * h
    return np.clip(out, 0.0, 1.0)


def norm_sf2(z):
    """Two-sided normal tail."""
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def t_sf2(t, df):
    """Two-sided Student tail."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isfinite(t), betainc(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t)), 0.0)


def f_sf(f, d1, d2):
    """Upper F tail."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    up = d1 * np.maximum(f, 0)
    return np.where(np.isfinite(f), betainc(d2 / 2, d1 / 2, d2 / (d2 + up), up / (d2 + up)), 0.0)


def chi2_sf(x, df):
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def chi2_1_isf(p: float) -> float:
    """Upper quantile of chi-square with one degree of freedom, by bisection."""
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if math.erfc(math.sqrt(mid / 2)) > p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def log_factorial(k):
    """log k!, by one way for every size."""
    return lgamma(np.asarray(k) + 1.0)


#: Terms of a sum that are formed at a time, and the share of a sum below which its terms are left out.
TERMS, SMALL = 32, 1e-18


def _outward(start, up, ratio, powers: int = 1):
    """Sums of w(k), (k - start) w(k), ... over k = start, start + 1, ... (or downwards), w(start) being 1; `ratio(k)` is
    the quotient of the next weight and w(k). Terms are followed until they vanish, for all rows together."""
    out = np.zeros((powers, len(start)))
    out[0] = 1
    live, k, w, far = np.arange(len(start)), start.astype(float), np.ones(len(start)), np.zeros(len(start))
    step = np.arange(TERMS) * (1.0 if up else -1.0)
    while len(live):
        w = w[:, None] * np.cumprod(ratio(live, k[:, None] + step), axis=1)
        dist = far[:, None] + step + (1 if up else -1)
        for j in range(powers):
            out[j, live] += (w * dist ** j).sum(1)
        go = (w[:, -1] > 0) & (np.abs(w[:, -1] * dist[:, -1] ** (powers - 1)) > SMALL * np.abs(out[powers - 1, live]))
        live, k, w, far = live[go], k[go] + (TERMS if up else -TERMS), w[go, -1], dist[go, -1]
    return out


def _away(start, rising, up, down):
    """Sums from `start` upwards where `rising`, else downwards."""
    out = np.empty(len(start))
    for which, way, ratio in ((rising, True, up), (~rising, False, down)):
        of = np.flatnonzero(which)
        out[of] = _outward(start[of], way, lambda i, k: ratio(of[i], k))[0]
    return out


def _two_sided(seen, mode, lo, hi, logw, up, down):
    """Share of the outcomes no likelier than the one seen, for weights that fall on both sides of the mode.

    All sums start at their largest term, relative to the mode's or the seen outcome's weight, so neither the length of the
    support nor a tiny p matters; the outcome across the mode is found by bisection."""
    total = _outward(mode, True, up)[0] + _outward(mode, False, down)[0] - 1
    level = logw(seen) - logw(mode)
    right = seen >= mode
    # the outcome across the mode that is nearest to it and no likelier
    a, b = np.where(right, lo - 1, mode), np.where(right, mode, hi + 1)
    while (b - a > 1).any():
        mid = np.floor((a + b) / 2)
        fits = logw(np.clip(mid, lo, hi)) - logw(mode) <= level + 1e-7
        a, b = np.where(right == fits, mid, a), np.where(right == fits, b, mid)
    across = np.where(right, a, b)
    there = (across >= lo) & (across <= hi)
    across = np.clip(across, lo, hi)
    other = np.where(there, _away(across, ~right, up, down) * np.exp(logw(across) - logw(mode)), 0.0)
    p = (_away(seen, right, up, down) * np.exp(level) + other) / total
    return np.where(level >= -1e-7, 1.0, np.minimum(p, 1.0))


class _Tables:
    """2x2 tables with fixed margins: weights of the top-left cell."""

    def __init__(self, a, b, c, d):
        self.r1, self.c1, self.n = a + b, a + c, a + b + c + d
        self.free = self.n - self.r1 - self.c1
        self.lo, self.hi = np.maximum(0, -self.free), np.minimum(self.r1, self.c1)
        self.mode = np.clip(np.floor((self.r1 + 1) * (self.c1 + 1) / (self.n + 2)), self.lo, self.hi)

    def logw(self, k):
        f = log_factorial
        return -(f(k) + f(self.r1 - k) + f(self.c1 - k) + f(self.free + k))

    def up(self, i, k, tilt=None):
        r = np.maximum(self.r1[i, None] - k, 0) * np.maximum(self.c1[i, None] - k, 0) / np.maximum((k + 1) * (self.free[i, None] + k + 1), 1)
        return r if tilt is None else r * tilt[i, None]

    def down(self, i, k, tilt=None):
        r = np.maximum(k, 0) * np.maximum(self.free[i, None] + k, 0) / np.maximum((self.r1[i, None] - k + 1) * (self.c1[i, None] - k + 1), 1)
        return r if tilt is None else r / tilt[i, None]


def _odds_ratio(t: _Tables, a):
    """Conditional maximum-likelihood odds ratio: the tilt under which the mean of the cell is the one seen, by Newton steps
    in its logarithm, of at most three standard deviations of the cell."""
    out = np.where(t.lo == t.hi, np.nan, np.where(a == t.lo, 0.0, np.inf))
    inside = np.flatnonzero((a > t.lo) & (a < t.hi))
    if not len(inside):
        return out
    s = _Tables.__new__(_Tables)
    s.r1, s.c1, s.free = t.r1[inside], t.c1[inside], t.free[inside]
    a = a[inside]
    x = np.log((a + 0.5) * (s.free + a + 0.5) / ((s.r1 - a + 0.5) * (s.c1 - a + 0.5)))
    for _ in range(200):
        e = np.exp(x)
        w = _outward(a, True, lambda i, k: s.up(i, k, e), 3) + _outward(a, False, lambda i, k: s.down(i, k, e), 3)
        off = w[1] / (w[0] - 1)  # mean minus the cell seen
        var = np.maximum(w[2] / (w[0] - 1) - off ** 2, 1e-12)
        move = np.clip(off / var, -3 / np.sqrt(var), 3 / np.sqrt(var))
        x = x - move
        if (np.abs(move) < 1e-12 * (1 + np.abs(x))).all():
            break
    out[inside] = np.exp(x)
    return out


def fisher_tables(a, b, c, d):
    """(conditional maximum-likelihood odds ratios, two-sided p) of many 2x2 tables, repeated ones computed once."""
    cells, of = np.unique(np.column_stack([np.asarray(v, float) for v in (a, b, c, d)]), axis=0, return_inverse=True)
    t = _Tables(*cells.T)
    seen = cells[:, 0]
    p = np.where(t.lo == t.hi, 1.0, _two_sided(seen, t.mode, t.lo, t.hi, t.logw, t.up, t.down)) if len(cells) else np.zeros(0)
    ratio = _odds_ratio(t, seen) if len(cells) else np.zeros(0)
    return ratio[of.ravel()], p[of.ravel()]


def fisher_exact(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """(conditional maximum-likelihood odds ratio, two-sided p)."""
    ratio, p = fisher_tables([a], [b], [c], [d])
    return float(ratio[0]), float(p[0])


def binom_tests(k, n, p0):
    """Exact two-sided binomial p of many counts: outcomes no more likely than the observed one."""
    cells, of = np.unique(np.column_stack(np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, p0)))), axis=0, return_inverse=True)
    k, n, p0 = cells.T
    out = np.where(n == 0, 1.0, np.where(k == n * p0, 1.0, 0.0))
    i = np.flatnonzero((n > 0) & (p0 > 0) & (p0 < 1))
    if len(i):
        k, n, q = k[i], n[i], p0[i] / (1 - p0[i])
        logw = lambda x: x * np.log(q) - log_factorial(x) - log_factorial(n - x)
        up = lambda j, x: np.maximum(n[j, None] - x, 0) / np.maximum(x + 1, 1) * q[j, None]
        down = lambda j, x: np.maximum(x, 0) / np.maximum(n[j, None] - x + 1, 1) / q[j, None]
        mode = np.clip(np.floor((n + 1) * p0[i]), 0, n)
        out[i] = _two_sided(k, mode, np.zeros(len(i)), n, logw, up, down)
    return out[of.ravel()]


def binom_two_sided(k: int, n: int, p0: float) -> float:
    return float(binom_tests([k], [n], [p0])[0])
