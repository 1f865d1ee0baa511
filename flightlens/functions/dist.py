"""Tail probabilities and quantiles for test statistics (driver-side scalars).

Each statistic is one number computed from aggregated sums, so plain Python
is enough: normal via erfc, chi-square via the regularised incomplete gamma
function, F via the regularised incomplete beta function (continued
fractions), inverse normal via ``statistics.NormalDist``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

_N01 = NormalDist()
F_LIMIT_DF = 1e9


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    return _N01.inv_cdf(p)


# Wichura's algorithm AS 241 (PPND16), Applied Statistics 37 (1988); numerators and
# denominators by rising power, for |p - 1/2| <= 0.425, then sqrt(-ln p) <= 5, then beyond.
_AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def norm_ppf_sql(u: str) -> str:
    """The inverse normal of SQL expression ``u`` in (0, 1) as an SQL expression (built-ins only)."""
    def ratio(k: int, x: str) -> str:
        def poly(c):
            out = f"CAST({c[-1]!r} AS DOUBLE)"
            for a in reversed(c[:-1]):
                out = f"({out} * {x} + CAST({a!r} AS DOUBLE))"
            return out
        return f"{poly(_AS241[k][0])} / {poly(_AS241[k][1])}"
    q = f"({u} - CAST(0.5 AS DOUBLE))"
    r = f"sqrt(-ln(least({u}, 1 - {u})))"
    near = f"{q} * {ratio(0, f'(CAST(0.180625 AS DOUBLE) - {q} * {q})')}"
    mid, far = ratio(1, f"({r} - CAST(1.6 AS DOUBLE))"), ratio(2, f"({r} - 5)")
    return (f"CASE WHEN abs({q}) <= CAST(0.425 AS DOUBLE) THEN {near} "
            f"ELSE sign({q}) * CASE WHEN {r} <= 5 THEN {mid} ELSE {far} END END")


def _gammainc_lower_series(a: float, x: float) -> float:
    term = 1.0 / a
    total = term
    n = a
    for _ in range(10_000):
        n += 1.0
        term *= x / n
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    else:
        raise ArithmeticError("incomplete gamma series did not converge")
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gammainc_upper_cf(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError("incomplete gamma fraction did not converge")
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gammainc_lower_series(a, x)
    return _gammainc_upper_cf(a, x)


def chi2_sf(x: float, df: float) -> float:
    return gammaincc(df / 2.0, x / 2.0)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 10_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError("incomplete beta fraction did not converge")
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if d2 > F_LIMIT_DF:          # there lgamma differences lose more digits than the limit does
        return chi2_sf(d1 * f, d1)
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))
