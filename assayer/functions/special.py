"""Special functions as column expressions: log-gamma, the incomplete beta function, Student's t and the normal distribution.

Series and continued fractions run as folds over a sequence of steps, so they stay in the engine; each takes a fixed number of
steps, enough for double precision in the ranges named."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: coefficients of the Lanczos approximation with g = 7 (fixed values)
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
_STEPS, _HALVINGS, _TERMS = 200, 64, 120


def _fold(steps: int, start: Column, step, finish=None) -> Column:  # noqa: ANN001
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, finish) if finish else F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 1/2 and more."""
    z = x.cast("double") - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from its front (modified Lentz); converges for x below (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    first = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))

    def turn(s: Column, numerator: Column) -> Column:
        d = 1.0 / safe(1.0 + numerator * s["d"])
        c = safe(1.0 + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, k: Column) -> Column:
        # odd and even turns alternate
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(s, F.when(k % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(_STEPS)), start, step, lambda s: s["h"])


def beta_regularised(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of x in [0, 1]."""
    a, b, x = (v.cast("double") for v in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    low = front * _fraction(a, b, x) / a
    high = 1.0 - front * _fraction(b, a, 1.0 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1.0) / (a + b + 2.0), low).otherwise(high)


def t_upper(t: Column, df: Column) -> Column:
    """The chance that Student's t with `df` degrees of freedom exceeds `t`."""
    df, t = df.cast("double"), t.cast("double")
    tail = 0.5 * beta_regularised(df / 2.0, F.lit(0.5), df / (df + t * t))
    return F.when(t >= 0, tail).otherwise(1.0 - tail)


def t_quantile(p: float, df: Column) -> Column:
    """The quantile of Student's t at p above 1/2, by halving a bracket of df / (df + t * t), whose distribution is a beta."""
    df = df.cast("double")
    wanted = 2.0 * (1.0 - p)
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        below = beta_regularised(df / 2.0, F.lit(0.5), mid) < wanted
        return F.struct(F.when(below, mid).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi"))

    x = _fold(_HALVINGS, start, step, lambda s: (s["lo"] + s["hi"]) / 2.0)
    return F.sqrt(df * (1.0 - x) / x)


def normal_upper(z: Column) -> Column:
    """The chance that a standard normal variable exceeds z: a series of positive terms near 0, a continued fraction in the tail."""
    z = z.cast("double")
    a = F.abs(z)
    density = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi)
    # z + z^3 / 3 + z^5 / (3 * 5) + ...
    start = F.struct(a.alias("term"), a.alias("sum"))
    series = _fold(_TERMS, start, lambda s, k: F.struct((s["term"] * a * a / (2.0 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2.0 * k + 1)).alias("sum")), lambda s: s["sum"])
    # a + 1 / (a + 2 / (a + 3 / ...)), from its end
    tail = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), a, lambda v, k: a + k / v)
    upper = F.when(a < 3.5, 0.5 - density * series).otherwise(density / tail)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)
