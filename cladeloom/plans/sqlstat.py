"""Tail probabilities as plain SQL (Simpson quadrature), so p-values have an independent check."""
from __future__ import annotations

_N = 4000
_W = f"(case when i = 0 or i = {_N} then 1 when i % 2 = 1 then 4 else 2 end)"


def _simpson(lo: str, hi: str, f: str) -> str:
    """Integral over [lo, hi]; `f` is written in terms of {x}."""
    x = f"(({lo}) + (({hi}) - ({lo})) * i / {_N}.0e0)"
    return f"((({hi}) - ({lo})) / {3 * _N}.0e0 * list_sum(list_transform(range(0, {_N + 1}), lambda i: {_W} * ({f.format(x=x)}))))"


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper F tail: beta density in the angle whose squared sine is d1 F / (d1 F + d2)."""
    lo = f"asin(sqrt(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2}))))"
    const = f"lgamma((({d1}) + ({d2})) / 2.0e0) - lgamma(({d1}) / 2.0e0) - lgamma(({d2}) / 2.0e0)"
    body = f"exp({const} + (({d1}) - 1) * ln(greatest(sin({{x}}), 1e-300)) + (({d2}) - 1) * ln(greatest(cos({{x}}), 1e-300)))"
    hi = f"least(pi() / 2, {lo} + sqrt(({d1}) / (1.0e0 * ({d2}))) + 14.0e0 / sqrt(({d2})))"
    return f"(2 * {_simpson(lo, hi, body)})"


def t_tail(t: str, df: str) -> str:
    return f_tail(f"(({t}) * ({t}))", "1", df)


def chi2_tail(x: str, df: str) -> str:
    """Upper chi-square tail in the square root of the variable."""
    lo = f"sqrt(({x}))"
    const = f"ln(2.0e0) - ({df}) / 2.0e0 * ln(2.0e0) - lgamma(({df}) / 2.0e0)"
    return _simpson(lo, f"({lo} + 9.0e0)", f"exp({const} + (({df}) - 1) * ln(greatest({{x}}, 1e-300)) - {{x}} * {{x}} / 2)")


def norm_tail(z: str) -> str:
    return chi2_tail(f"(({z}) * ({z}))", "1")


def fisher_tail(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact p by summing hypergeometric weights no larger than the observed one."""
    r1, c1, n = f"(({a}) + ({b}))", f"(({a}) + ({c}))", f"(({a}) + ({b}) + ({c}) + ({d}))"
    lg = lambda x: f"lgamma(({x}) + 1.0e0)"
    lp = lambda k: (f"({lg(r1)} - {lg(k)} - {lg(f'{r1} - {k}')} + {lg(f'{n} - {r1}')} - {lg(f'{c1} - {k}')} - {lg(f'{n} - {r1} - {c1} + {k}')}"
                    f" - {lg(n)} + {lg(c1)} + {lg(f'{n} - {c1}')})")
    rng = f"range(cast(greatest(0, {c1} - ({n} - {r1})) as bigint), cast(least({r1}, {c1}) as bigint) + 1)"
    return (f"least(1.0e0, list_sum(list_transform({rng}, lambda k: case when {lp('k')} <= {lp(f'({a})')} + 1e-7 then exp({lp('k')}) else 0 end)))")


def binom_tail(k: str, n: str, p: str = "0.5") -> str:
    lg = lambda x: f"lgamma(({x}) + 1.0e0)"
    lp = lambda j: f"({lg(n)} - {lg(j)} - {lg(f'({n}) - {j}')} + ({j}) * ln({p}) + (({n}) - {j}) * ln(1 - {p}))"
    return f"least(1.0e0, list_sum(list_transform(range(0, cast({n} as bigint) + 1), lambda j: case when {lp('j')} <= {lp(f'({k})')} + 1e-7 then exp({lp('j')}) else 0 end)))"


def norm_quantile(p: str) -> str:
    """Lower-tail normal quantile of 0 < p < 0.5: bisection on the complementary tail, by Newton steps from a rational start."""
    start = f"(-sqrt(-2 * ln({p})) + (2.515517 + 0.802853 * sqrt(-2 * ln({p})) - 0.010328 * 2 * ln({p})) / (1 + 1.432788 * sqrt(-2 * ln({p})) - 0.189269 * 2 * ln({p}) + 0.001308 * pow(-2 * ln({p}), 1.5)))"
    # lower tail by quadrature below x, the density as slope; list_reduce repeats the step
    tail = _simpson("(x - 12.0e0)", "x", "exp(-{x} * {x} / 2) / sqrt(2 * pi())")
    return f"list_reduce([{start}, 0.0e0, 0.0e0, 0.0e0], lambda x, step: x - ({tail} - {p}) / (exp(-x * x / 2) / sqrt(2 * pi())))"


def draw(*key: str, seed: int = 42) -> str:
    """The seeded hash number of `functions.arith.draw`."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(key)}, {seed})), 1, 13))::bigint"
