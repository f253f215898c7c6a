"""Tails of common distributions as column expressions, and the same texts for DuckDB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Chebyshev fit of erfc by Press et al., relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = c + t * poly
    return t * F.exp(-x * x + poly)


def duck_erfc(x: str) -> str:
    t = f"(1 / (1 + 0.5 * ({x})))"
    poly = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= z) for z >= 0."""
    return erfc(z / math.sqrt(2))


def duck_two_sided(z: str) -> str:
    return duck_erfc(f"({z}) / {math.sqrt(2)!r}")


def chi2_tail(x: Column, df: int) -> Column:
    """P(chi squared with df degrees of freedom >= x), in closed form."""
    h = x / 2
    if df % 2 == 0:
        return F.exp(-h) * sum((F.pow(h, F.lit(float(k))) / math.factorial(k) for k in range(df // 2)), F.lit(0.0))
    return erfc(F.sqrt(h)) + F.exp(-h) * sum((F.pow(h, F.lit(k - 0.5)) / math.gamma(k + 0.5) for k in range(1, (df - 1) // 2 + 1)), F.lit(0.0))


def duck_chi2_tail(x: str, df: int) -> str:
    h = f"(({x}) / 2)"
    if df % 2 == 0:
        return f"(exp(-{h}) * (" + " + ".join(f"pow({h}, {k}) / {math.factorial(k)}" for k in range(df // 2)) + "))"
    return f"({duck_erfc(f'sqrt({h})')} + exp(-{h}) * (0" + "".join(f" + pow({h}, {k - 0.5}) / {math.gamma(k + 0.5)!r}" for k in range(1, (df - 1) // 2 + 1)) + "))"


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for a whole number of degrees of freedom of at least 1, by the finite trigonometric series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    steps = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    ks = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def series(first: int):
        zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(a: Column, k: Column) -> Column:
            term = a["term"] * c2 * (2 * k - 1 + first) / (2 * k + first)
            return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

        return F.aggregate(ks, zero, step, lambda a: a["total"])

    odd_a = F.when(df == 1, 2 * theta / math.pi).otherwise(2 / math.pi * (theta + F.sin(theta) * F.cos(theta) * series(1)))
    return F.greatest(1 - F.when(odd, odd_a).otherwise(F.sin(theta) * series(0)), F.lit(0.0))


def log_choose(n: Column, k: Column) -> Column:
    """ln of the number of ways to choose k of n, by a running sum; n up to some thousands."""
    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long")))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(ks, F.lit(0.0), lambda a, i: a + F.log((n - k + i).cast("double")) - F.log(i.cast("double")))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) for n fair trials; null for n <= 0."""
    n_, k_ = n.cast("long"), k.cast("long")
    terms = F.aggregate(
        F.when(n_ >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(n_, F.lit(1).cast("long")))).otherwise(F.array().cast("array<long>")),
        F.struct((-n_ * math.log(2)).alias("ln"), F.when(k_ <= 0, F.exp(-n_ * math.log(2))).otherwise(0.0).alias("total")),
        lambda a, i: F.struct((a["ln"] + F.log((n_ - i + 1).cast("double")) - F.log(i.cast("double"))).alias("ln"), (a["total"] + F.when(i >= k_, F.exp(a["ln"] + F.log((n_ - i + 1).cast("double")) - F.log(i.cast("double")))).otherwise(0.0)).alias("total")),
        lambda a: F.least(a["total"], F.lit(1.0)),
    )
    return F.when(n_ > 0, terms)
