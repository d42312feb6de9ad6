"""Prior distributions of parameters: densities as column expressions, truncated draws and quantiles in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import gamma_p, gamma_p_col, gamma_quantile, inverse_normal, lgamma_col, normal_cdf, normal_cdf_col


@dataclass
class Prior:
    """kind: uniform, exponential, gamma, normal or multiplicative; all truncated to [low, high]."""

    kind: str = "uniform"
    low: float = 0.0
    high: float = 0.1
    mean: float = 0.01
    sd: float = 1.0
    alpha: float = 1.0

    def cdf(self, x):
        """Of the distribution before truncation (of multiplicative: between the bounds, in logarithms)."""
        x = np.asarray(x, float)
        if self.kind == "uniform":
            return (x - self.low) / (self.high - self.low)
        if self.kind == "exponential":
            return 1 - np.exp(-np.maximum(x, 0) / self.mean)
        if self.kind == "gamma":
            return gamma_p(self.alpha, np.maximum(x, 0) * self.alpha / self.mean)
        if self.kind == "normal":
            return normal_cdf((x - self.mean) / self.sd)
        low = max(self.low, 1e-12)
        return np.log(np.maximum(x, low) / low) / math.log(self.high / low)

    def quantile(self, p):
        """Of the truncated distribution."""
        a, b = self.cdf(self.low), self.cdf(self.high)
        q = a + np.asarray(p, float) * (b - a)
        if self.kind == "uniform":
            x = self.low + q * (self.high - self.low)
        elif self.kind == "exponential":
            x = -self.mean * np.log1p(-np.minimum(q, 1 - 1e-16))
        elif self.kind == "gamma":
            x = gamma_quantile(q, self.alpha) * self.mean / self.alpha
        elif self.kind == "normal":
            x = self.mean + self.sd * inverse_normal(q)
        else:
            low = max(self.low, 1e-12)
            x = low * (self.high / low) ** q
        return np.clip(x, self.low, self.high)

    def draw(self, rng: np.random.Generator, size=None):
        return self.quantile(rng.random(size))

    def log_density(self, x):
        """Normalised over the bounds; -inf outside."""
        x = np.asarray(x, float)
        inside = (x >= self.low) & (x <= self.high)
        y = np.where(inside, x, self.low if self.low > 0 else self.high)
        mass = math.log(max(float(self.cdf(self.high) - self.cdf(self.low)), 1e-300))
        if self.kind == "uniform":
            d = np.full(x.shape, -math.log(self.high - self.low)) if x.shape else -math.log(self.high - self.low)
        elif self.kind == "exponential":
            d = -y / self.mean - math.log(self.mean) - mass
        elif self.kind == "gamma":
            r = self.alpha / self.mean
            d = self.alpha * math.log(r) + (self.alpha - 1) * np.log(np.maximum(y, 1e-300)) - r * y - math.lgamma(self.alpha) - mass
        elif self.kind == "normal":
            d = -0.5 * ((y - self.mean) / self.sd) ** 2 - math.log(self.sd * math.sqrt(2 * math.pi)) - mass
        else:
            d = -np.log(np.maximum(y, 1e-300)) - math.log(math.log(self.high / max(self.low, 1e-12)))
        return np.where(inside, d, -np.inf)

    def mean_truncated(self, points: int = 4001) -> float:
        x = np.linspace(self.low, self.high, points)
        w = np.exp(self.log_density(x))
        return float(np.sum(x * w) / np.sum(w))


def log_mass_col(kind: Column, low: Column, high: Column, mean: Column, sd: Column | None = None, alpha: Column | None = None) -> Column:
    """Logarithm of a prior's integral between its bounds, without the factors that ``log_density_col`` leaves out too. Null
    for other kinds, for bounds so far in the upper tail that they have no mass in doubles, and for a null argument."""
    sd, alpha = (F.lit(None).cast("double") if c is None else c for c in (sd, alpha))
    rate = alpha / mean
    return (
        F.when(kind == "uniform", F.log(high - low))
        .when(kind == "exponential", F.log(mean) + F.log(F.exp(-low / mean) - F.exp(-high / mean)))
        .when(kind == "gamma", lgamma_col(alpha) - alpha * F.log(rate) + F.log(gamma_p_col(alpha, high * rate) - gamma_p_col(alpha, low * rate)))
        .when(kind == "normal", F.log(sd * F.lit(math.sqrt(2 * math.pi))) + F.log(normal_cdf_col((high - mean) / sd) - normal_cdf_col((low - mean) / sd)))
        .when(kind == "multiplicative", F.log(F.log(high / F.greatest(low, F.lit(1e-12)))))
    )


def log_density_col(value: Column, kind: Column, low: Column, high: Column, mean: Column, sd: Column | None = None, alpha: Column | None = None, log_mass: Column | None = None) -> Column:
    """Log density of a prior by row; -inf outside its bounds, null for other kinds. Many values of one prior can share its
    ``log_mass``, which is computed here otherwise."""
    if log_mass is None:
        log_mass = log_mass_col(kind, low, high, mean, sd, alpha)
    sd, alpha = (F.lit(None).cast("double") if c is None else c for c in (sd, alpha))
    log_value = F.log(F.greatest(value, F.lit(1e-300)))
    z = (value - mean) / sd
    d = (
        F.when(kind == "uniform", F.lit(0.0))
        .when(kind == "exponential", -value / mean)
        .when(kind == "gamma", (alpha - 1) * log_value - value * alpha / mean)
        .when(kind == "normal", z * z * F.lit(-0.5))
        .when(kind == "multiplicative", -log_value)
    )
    return F.when(value.between(low, high), d - log_mass).otherwise(F.lit(float("-inf")))


def truncated_mean_col(kind: Column, low: Column, high: Column, mean: Column, sd: Column, alpha: Column) -> Column:
    """Mean of a prior between its bounds; null where ``log_mass_col`` is."""
    rate = alpha / mean
    lower = F.greatest(low, F.lit(1e-12))
    a, b = F.exp(-low / mean), F.exp(-high / mean)
    above = gamma_p_col(alpha + 1, high * rate) - gamma_p_col(alpha + 1, low * rate)
    x, y = (low - mean) / sd, (high - mean) / sd
    bend = (F.exp(x * x * F.lit(-0.5)) - F.exp(y * y * F.lit(-0.5))) / F.lit(math.sqrt(2 * math.pi))
    return (
        F.when(kind == "uniform", (low + high) / 2)
        .when(kind == "exponential", mean + F.try_divide(low * a - high * b, a - b))
        .when(kind == "gamma", mean * F.try_divide(above, gamma_p_col(alpha, high * rate) - gamma_p_col(alpha, low * rate)))
        .when(kind == "normal", mean + sd * F.try_divide(bend, normal_cdf_col(y) - normal_cdf_col(x)))
        .when(kind == "multiplicative", (high - lower) / F.log(high / lower))
    )


def bin_prior(prior: Prior, bins: int) -> np.ndarray:
    """Density at the middles of equal bins."""
    width = (prior.high - prior.low) / bins
    return np.exp(prior.log_density(prior.low + (np.arange(bins) + 0.5) * width))
