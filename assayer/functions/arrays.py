"""Numeric functions over ARRAY<DOUBLE> columns: probabilities, spectra, distances and attention statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVE = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def softmax(x: Column, epsilon: float = 0.0) -> Column:
    """exp(v - max) over their sum plus epsilon; null for an empty array."""
    shifted = lambda m: F.transform(x, lambda v: F.exp(v - m))
    return F.when(F.size(x) > 0, let(shifted(F.array_max(x)), lambda e: let(total(e) + epsilon, lambda s: F.transform(e, lambda v: v / s))))


def spectrum(x: Column) -> Column:
    """Cleaned: missing and infinite values as 0, negative ones as 0, largest first."""
    return F.reverse(F.array_sort(F.transform(x, lambda v: F.when(F.abs(v) < F.lit(float("inf")), F.greatest(v, F.lit(0.0))).otherwise(0.0))))


def active(x: Column, share: float = ACTIVE) -> Column:
    """The values of a cleaned spectrum above a share of the largest."""
    return let(spectrum(x), lambda s: F.filter(s, lambda v: (v > 0) & (v > share * F.get(s, F.lit(0)))))


def entropy(x: Column) -> Column:
    """Of the active spectrum as probabilities, over the log of their number; 0 for one or none."""
    h = lambda a: let(total(a), lambda s: -total(F.transform(a, lambda v: v / s * F.log(v / s))))
    return let(active(x), lambda a: F.when(F.size(a) > 1, F.least(F.greatest(h(a) / F.log(F.size(a).cast("double")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))


def effective_rank(x: Column) -> Column:
    """exp of the entropy of the active spectrum; 0 when empty."""
    h = lambda a: let(total(a), lambda s: -total(F.transform(a, lambda v: v / s * F.log(v / s))))
    return let(active(x), lambda a: F.when(F.size(a) > 0, F.exp(h(a))).otherwise(0.0))


def participation(x: Column) -> Column:
    """(sum)^2 / sum of squares of the active spectrum; 0 when empty."""
    return let(active(x), lambda a: F.when(F.size(a) > 0, total(a) * total(a) / total(F.transform(a, lambda v: v * v))).otherwise(0.0))


def tail_log_volume(x: Column, r: int) -> Column:
    """The sum of logs of the active spectrum beyond its r largest values."""
    return let(active(x), lambda a: F.when(F.size(a) > r, total(F.transform(F.slice(a, r + 1, F.size(a)), lambda v: F.log(v)))).otherwise(0.0))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def cosine_distance(x: Column, y: Column, epsilon: float = 1e-12) -> Column:
    return 1 - dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)) + epsilon)


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def rms_norm(x: Column, epsilon: float = 1e-6) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + epsilon), lambda s: F.transform(x, lambda v: v / s))


def fisher_diagonal(p: Column, d: Column) -> Column:
    """sum p d^2."""
    return total(F.zip_with(p, d, lambda a, b: a * b * b))


def fisher_full(p: Column, d: Column, floor: float = 1e-10) -> Column:
    """sqrt(sum p d^2 - (sum p d)^2), at least sqrt(floor)."""
    return F.sqrt(F.greatest(fisher_diagonal(p, d) - dot(p, d) * dot(p, d), F.lit(floor)))


def top_k(x: Column, k: int) -> Column:
    """Positions of the k largest values; of equal ones the earlier."""
    order = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["i"])


def fisher_top(p: Column, d: Column, k: int, floor: float = 1e-10) -> Column:
    """`fisher_full` over the k largest of p (of equal ones the earlier), made to sum to 1."""
    places = lambda x, at: F.transform(at, lambda i: F.get(x, i))
    share = lambda q: let(total(q) + floor, lambda s: F.transform(q, lambda v: v / s))
    return let(top_k(p, k), lambda at: let(share(places(p, at)), lambda q: let(places(d, at), lambda z: fisher_full(q, z, floor))))


def js_radius(rows: Column) -> Column:
    """The mean divergence of distributions (rows of equal length) from their mean, in nats: a Jensen-Shannon radius."""
    n = F.size(rows)
    mean = F.transform(F.get(rows, F.lit(0)), lambda _, i: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, i)) / n)
    kl = lambda p, m: total(F.zip_with(p, m, lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)))
    return F.when(n > 0, let(mean, lambda m: F.aggregate(rows, F.lit(0.0), lambda a, r: a + kl(r, m)) / n))


def without_first(rows: Column) -> Column:
    """Distributions without their first place, made to sum to 1 again; one that had all its mass there is left out."""
    rest = F.transform(rows, lambda r: F.slice(r, 2, F.size(r)))
    return F.transform(F.filter(rest, lambda r: total(r) > 0), lambda r: let(total(r), lambda s: F.transform(r, lambda v: v / s)))


def first_mass(rows: Column) -> Column:
    """The mean mass at the first place."""
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, F.lit(0))) / F.size(rows)


def mean_entropy(rows: Column) -> Column:
    """The mean entropy of distributions, in nats."""
    one = lambda r: -total(F.transform(r, lambda v: F.when(v > 0, v * F.log(v)).otherwise(0.0)))
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + one(r)) / F.size(rows)


def grouped_means(rows: Column, groups: int) -> Column:
    """Rows averaged within equal consecutive groups."""
    per = F.floor(F.size(rows) / groups).cast("int")
    one = lambda g: let(F.slice(rows, g * per + 1, per), lambda m: F.transform(F.get(m, F.lit(0)), lambda _, i: F.aggregate(m, F.lit(0.0), lambda a, r: a + F.get(r, i)) / per))
    return F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), one)


def complete_mean(x: Column, places: Column) -> Column:
    """The mean of the values at some places; null unless all are there."""
    held = F.filter(F.transform(places, lambda i: F.get(x, i)), lambda v: v.isNotNull())
    return F.when((F.size(places) > 0) & (F.size(held) == F.size(places)), total(held) / F.size(held))


def late_window(blocks: Column) -> Column:
    """Places of the last quarter of blocks, rounded up, from 0."""
    return F.sequence((blocks - F.ceil(blocks / 4.0)).cast("int"), blocks.cast("int") - 1)
