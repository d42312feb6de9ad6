"""Special functions that Spark lacks, in numpy (there is no SciPy), and as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def lgamma(x):
    return _lgamma(np.asarray(x, float))


def log_factorial(n):
    return lgamma(np.asarray(n, float) + 1)


def erf(x):
    return _erf(np.asarray(x, float))


def normal_cdf(x):
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def gamma_p(a, x, terms: int = 500):
    """Regularised lower incomplete gamma: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    scale = np.exp(np.where(x > 0, -x + a * np.log(np.where(x > 0, x, 1)) - lgamma(a), -np.inf))
    low = (x < a + 1) & (x > 0)
    term = np.where(low, 1 / a, 0.0)
    total = term.copy()
    for n in range(1, terms):
        term = term * x / (a + n)
        total += np.where(low, term, 0)
        if (np.abs(term[low]) <= 1e-17 * np.abs(total[low])).all():
            break
    out[low] = (total * scale)[low]
    high = x >= a + 1
    tiny = 1e-300
    b = x + 1 - a
    c = np.full(a.shape, 1 / tiny)
    d = 1 / np.where(b == 0, tiny, b)
    h = d.copy()
    for i in range(1, terms):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + an / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        step = c * d
        h = h * np.where(high, step, 1)
        if (np.abs(step[high] - 1) < 1e-16).all():
            break
    out[high] = (1 - scale * h)[high]
    return out


def gamma_quantile(p, shape, steps: int = 200):
    """Quantile of the gamma distribution with scale 1, by bisection."""
    p, a = np.broadcast_arrays(np.asarray(p, float), np.asarray(shape, float))
    lo, hi = np.zeros(p.shape), np.maximum(10.0, a * 10 + 100)
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = gamma_p(a, mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def chi2_quantile(p, df):
    return 2 * gamma_quantile(p, np.asarray(df, float) / 2)


def chi2_tail(x, df):
    return 1 - gamma_p(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def inverse_normal(p, steps: int = 60):
    """Quantile of the normal distribution: bisection, then Newton steps."""
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = normal_cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    x = (lo + hi) / 2
    for _ in range(2):
        x = x - (normal_cdf(x) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-300)
    return x


def lambert_w(x, steps: int = 60):
    """Principal branch, by Halley's method."""
    x = np.asarray(x, float)
    w = np.where(x > 1, np.log(np.maximum(x, 1e-300)) - np.log(np.maximum(np.log(np.maximum(x, 1.0001)), 1e-300)) * (x > math.e), np.maximum(x, -0.3678794411714423) * 0.5)
    for _ in range(steps):
        e = np.exp(w)
        f = w * e - x
        w1 = w + 1
        w = w - f / np.where(np.abs(e * w1 - (w + 2) * f / (2 * np.where(w1 == 0, 1e-12, w1))) < 1e-300, 1e-300, e * w1 - (w + 2) * f / (2 * np.where(w1 == 0, 1e-12, w1)))
    return w


def gamma_rates(alpha: float, categories: int) -> np.ndarray:
    """Mean rates of equally likely categories of a gamma distribution with mean 1."""
    cuts = gamma_quantile(np.arange(1, categories) / categories, alpha) / alpha
    upper = np.concatenate([gamma_p(alpha + 1, cuts * alpha), [1.0]])
    return categories * np.diff(np.concatenate([[0.0], upper]))


def laguerre_rates(alpha: float, categories: int) -> tuple[np.ndarray, np.ndarray]:
    """Rates and weights of generalised Gauss-Laguerre quadrature for a gamma distribution with mean 1."""
    i = np.arange(categories)
    j = np.diag(2 * i + alpha) + np.diag(np.sqrt(i[1:] * (i[1:] + alpha - 1)), 1) + np.diag(np.sqrt(i[1:] * (i[1:] + alpha - 1)), -1)
    x, v = np.linalg.eigh(j)
    return x / alpha, v[0] ** 2


def romberg(f, a: float, b: float, levels: int = 12) -> float:
    """Integral by extrapolated trapezoids."""
    row = [0.5 * (b - a) * (f(a) + f(b))]
    n = 1
    for k in range(1, levels):
        h = (b - a) / (2 * n)
        new = [row[0] / 2 + h * sum(f(a + (2 * i + 1) * h) for i in range(n))]
        for m in range(1, k + 1):
            new.append(new[-1] + (new[-1] - row[m - 1]) / (4**m - 1))
        if k > 3 and abs(new[-1] - row[-1]) <= 1e-12 * abs(new[-1]):
            return new[-1]
        row, n = new, n * 2
    return row[-1]


def mittag_leffler(alpha: float, x, terms: int = 400):
    """E_alpha(x) for 0 < alpha <= 1 and x <= 0: its series near 0, else the integral of its spectral density."""
    x = np.asarray(x, float)
    if alpha == 1:
        return np.exp(x)
    k = np.arange(terms)
    near = np.abs(x) <= 1
    series = np.sum(np.where(near[..., None], x[..., None], 0.0) ** k * np.exp(-lgamma(alpha * k + 1)), -1)
    t = np.maximum(-x, 1e-12) ** (1 / alpha)
    s, w = np.polynomial.legendre.leggauss(400)
    u = (s + 1) / 2
    r = (u / (1 - u))[None, :]  # the alpha-th power of the rate, over which the density is smooth
    density = math.sin(alpha * math.pi) / (alpha * math.pi) / (r * r + 2 * r * math.cos(alpha * math.pi) + 1)
    integral = np.sum(np.exp(-(r ** (1 / alpha)) * t.reshape(-1, 1)) * density / (1 - u) ** 2 * w / 2, 1).reshape(x.shape)
    return np.where(near, series, integral)


def lgamma_col(x: Column | str) -> Column:
    """Logarithm of the gamma function for x > 0: eight steps up, then its asymptotic series."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    y = x + 8
    r = F.lit(1.0) / (y * y)
    series = F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * (F.lit(1 / 1188) - r * F.lit(691 / 360360)))))
    steps = x
    for i in range(1, 8):
        steps = steps * (x + i)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series / y - F.log(steps)


def gamma_p_col(a: Column, x: Column, steps: int = 200) -> Column:
    """Regularised lower incomplete gamma by row: a series below a + 1, a continued fraction from its far end above, both of
    ``steps`` terms, which is enough for a up to some hundreds."""
    a, x = a.cast("double"), x.cast("double")
    front = F.exp(a * F.log(x) - x - lgamma_col(a))
    first = F.lit(1.0) / a

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(first.alias("term"), first.alias("total")), add, lambda s: s["total"])
    fraction = F.aggregate(F.sequence(F.lit(steps), F.lit(1)), x + F.lit(2.0 * steps + 1) - a, lambda b, n: x + n * 2 - 1 - a - n * (n - a) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x < a + 1, front * series).otherwise(F.lit(1.0) - front / fraction)


def erf_col(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.signum(x) * gamma_p_col(F.lit(0.5), x * x)


def normal_cdf_col(x: Column | str) -> Column:
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return (erf_col(x / F.lit(math.sqrt(2))) + 1) / 2


_EULER = 0.57721566490153286061


def digamma_col(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for x > 0: eight steps up, then its asymptotic series."""
    y = x.cast("double") + 8
    r = F.lit(1.0) / (y * y)
    series = F.log(y) - F.lit(0.5) / y - r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * (F.lit(1 / 240) - r * F.lit(1 / 132)))))
    return series - sum((F.lit(1.0) / (x + i) for i in range(1, 8)), F.lit(1.0) / x)


def trigamma_col(x: Column) -> Column:
    """The derivative of ``digamma_col`` for x > 0."""
    y = x.cast("double") + 8
    r = F.lit(1.0) / (y * y)
    series = F.lit(1.0) / y + r / 2 + r / y * (F.lit(1 / 6) - r * (F.lit(1 / 30) - r * (F.lit(1 / 42) - r * (F.lit(1 / 30) - r * F.lit(5 / 66)))))
    return series + sum((F.lit(1.0) / ((x + i) * (x + i)) for i in range(1, 8)), F.lit(1.0) / (x * x))


def harmonic_col(n: Column, power: int = 1) -> Column:
    """Sum of 1 / k^power, power 1 or 2, for k from 1 to n - 1, by polygamma functions: as dear for any n."""
    if power not in (1, 2):
        raise ValueError("power 1 or 2")
    m = F.greatest(n.cast("double"), F.lit(1.0))
    total = digamma_col(m) + F.lit(_EULER) if power == 1 else F.lit(math.pi**2 / 6) - trigamma_col(m)
    return F.when(n > 1, total).otherwise(F.lit(0.0))
