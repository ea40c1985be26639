"""Leave-one-model-out selection, transfer between tasks, meta-analysis and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.functions import special


def pooled_without(ranked: DataFrame, keys: list[str], holdout: str, buckets: int = 1) -> DataFrame:
    """For each key and holdout, the area of `rank01` pooled over all other values of `holdout`, and `auc`, that of its own rows.

    `ranked` has a row for each sample, with `label`, or for each rank, with counts `w1` and `w0` of labels. Twice the pairs that the
    rest wins are those of all, less those with the holdout on either side, plus those inside it: sums over each holdout's own ranks,
    so that nothing is multiplied by the holdouts. Ranks are spread evenly over 0 to 1, so `buckets` ranges of equal width share a
    key's rows, but for ties.
    """
    counts = ranked if "w1" in ranked.columns else ranked.where("label is not null").withColumn("w1", F.col("label")).withColumn("w0", 1 - F.col("label"))
    part = F.least(F.floor(F.col("v") * buckets), F.lit(buckets - 1)).cast("int")
    own = counts.where("rank01 is not null and w1 + w0 > 0").withColumn("v", F.round("rank01", 12)).groupBy(*keys, part.alias("_part"), holdout, "v").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    every, mine = W.partitionBy(*keys, "_part").orderBy("v"), W.partitionBy(*keys, "_part", holdout).orderBy("v")
    upto = lambda c, w: 2 * F.sum(c).over(w) - F.sum(c).over(w.rangeBetween(W.currentRow, W.currentRow))
    placed = own.select("*", upto("w0", every).alias("_all0"), upto("w1", every).alias("_all1"), upto("w0", mine).alias("_own0"))
    of = [*keys, "_part", holdout]
    sums = placed.groupBy(*of).agg(F.sum("w1").alias("_n1"), F.sum("w0").alias("_n0"), *(F.sum(F.col(a) * F.col(b)).alias(c) for a, b, c in (("w1", "_all0", "_right"), ("w0", "_all1", "_left"), ("w1", "_own0", "_in"))))
    # a few rows for each holdout and range: what the ranges below and above add
    order = W.partitionBy(*keys).orderBy("_part")
    below = lambda c, w: F.sum(c).over(w) - F.sum(c).over(w.rangeBetween(W.currentRow, W.currentRow))
    whole = W.partitionBy(*keys)
    n1, n0 = F.col("_n1"), F.col("_n0")
    wide = sums.select(*keys, holdout, "_n1", "_n0", "_right", "_left", "_in", below("_n0", order).alias("_b0"), below("_n1", order).alias("_b1"), below("_n0", W.partitionBy(*keys, holdout).orderBy("_part")).alias("_m0"), F.sum("_n1").over(whole).alias("_t1"), F.sum("_n0").over(whole).alias("_t0"))
    each = wide.groupBy(*keys, holdout, "_t1", "_t0").agg(
        F.sum("_n1").alias("_n1"), F.sum("_n0").alias("_n0"),
        F.sum(F.col("_right") + 2 * n1 * F.col("_b0")).alias("_right"), F.sum(2 * n0 * (F.col("_t1") - F.col("_b1")) - F.col("_left")).alias("_left"), F.sum(F.col("_in") + 2 * n1 * F.col("_m0")).alias("_in"),
    )
    wins = F.sum("_right").over(whole) - F.col("_right") - F.col("_left") + F.col("_in")
    area = lambda w, a, b: F.when((a > 0) & (b > 0), w / (2.0 * a * b))
    rest = each.select(*keys, holdout, (F.col("_t1") - n1).alias("n1"), (F.col("_t0") - n0).alias("n0"), wins.alias("_wins"), area(F.col("_in"), n1, n0).alias("auc"))
    return rest.select(*keys, holdout, "n1", "n0", area(F.col("_wins"), F.col("n1"), F.col("n0")).alias("pool_auc"), "auc")


def selected_without(pooled: DataFrame, keys: list[str], holdout: str) -> DataFrame:
    """For each key and holdout: the cell that wins in the pool, its sign, and the holdout's own area under that sign.

    `pooled` has keys, holdout, cell, cell_idx, pool_auc and auc.
    """
    best = F.max_by(F.struct("cell", "cell_idx", "pool_auc", "auc"), F.struct(F.abs(F.col("pool_auc") - 0.5).alias("d"), (-F.col("cell_idx")).alias("o"))).alias("b")
    won = pooled.where("pool_auc is not null").groupBy(*keys, holdout).agg(best).select(*keys, holdout, "b.*")
    sign = F.when(F.col("pool_auc") >= 0.5, 1).otherwise(-1)
    return won.select(*keys, holdout, "cell", sign.alias("sign"), "pool_auc", F.when(sign == 1, F.col("auc")).otherwise(1 - F.col("auc")).alias("holdout_auc"))


def random_effects(studies: DataFrame, keys: list[str], small: int = 10) -> DataFrame:
    """DerSimonian-Laird pooling of (effect, se) with an interval and a one-sided p of an effect at or below 0.

    Below `small` studies the interval is the modified Knapp-Hartung one: Student's t, and a scale that is never below 1, so that it
    is not narrower than the plain one; otherwise it is the normal one. One study stands alone, without interval. Studies without a
    finite effect and a positive standard error do not count; a key that has only such studies keeps its row, with k = 0.
    """
    ok = (F.abs(F.col("effect")) < float("inf")) & (F.col("se") > 0) & (F.col("se") < float("inf"))
    held = studies.withColumn("_y", F.when(ok, F.col("effect").cast("double"))).withColumn("_s2", F.when(ok, F.col("se") * F.col("se")))
    w, y = 1.0 / F.col("_s2"), F.col("_y")
    first = held.groupBy(*keys).agg(F.count("_y").alias("k"), F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.sum(w * y).alias("_wy"), F.sum(w * y * y).alias("_wyy"))
    q = F.col("_wyy") - F.col("_wy") * F.col("_wy") / F.col("_w")
    c = F.col("_w") - F.col("_ww") / F.col("_w")
    tau = first.select(*keys, "k", q.alias("q"), F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / c)).when(F.col("k") > 0, 0.0).alias("tau2"))
    v = 1.0 / (F.col("_s2") + F.col("tau2"))
    second = held.join(tau, keys).groupBy(*keys, "k", "q", "tau2").agg(F.sum(v).alias("_v"), F.sum(v * y).alias("_vy"), F.sum(v * y * y).alias("_vyy"))
    k, mean, se = F.col("k"), F.col("pooled"), F.col("se")
    spread = F.greatest(F.lit(0.0), F.col("_vyy") - F.col("_vy") * F.col("_vy") / F.col("_v"))
    scaled = F.when(k > 1, F.sqrt(F.greatest(F.lit(1.0), spread / (k - 1)) / F.col("_v")))
    out = second.select(*keys, "k", "q", "tau2", (F.col("_vy") / F.col("_v")).alias("pooled"), F.sqrt(1.0 / F.col("_v")).alias("se"), scaled.alias("se_t"))
    few = (k > 1) & (k < small)
    # the inverse runs once for each k, not for each key
    quantiles = out.where(few).select("k").distinct().withColumn("_t", special.t_quantile(0.975, k - 1))
    reach = F.when(few, F.col("_t") * F.col("se_t")).when(k > 1, 1.96 * se)
    p = F.when(few, special.t_upper(mean / F.col("se_t"), k - 1)).when(k > 1, special.normal_upper(mean / se))
    method = F.when(few, "knapp_hartung_t").when(k > 1, "normal").when(k == 1, "one_study").otherwise("none")
    return out.join(quantiles, "k", "left").select(*keys, "k", "q", "tau2", "pooled", "se", "se_t", (mean - reach).alias("ci_lo"), (mean + reach).alias("ci_hi"), p.alias("p_le_zero"), method.alias("method"))


def family_verdict(pairs: DataFrame, keys: list[str], family: str, effects: list[tuple[str, str]], bar: float, alone: str) -> DataFrame:
    """(keys, n_positive, n_families, verdict): a pair counts where every effect reaches `bar` and its lower bound is above 0.

    Two pairs of two families are eligible for a general claim; pairs of the family `alone` only are a rescue of that family."""
    positive = F.lit(True)
    for diff, lo in effects:
        positive = positive & (F.col(diff) >= bar) & F.coalesce(F.col(lo) > 0, F.lit(False))
    hit = F.coalesce(positive, F.lit(False))
    m = pairs.groupBy(*keys).agg(F.count_if(hit).alias("n_positive"), F.count_distinct(F.when(hit, F.col(family))).alias("n_families"), F.max(F.when(hit, F.col(family))).alias("_f"))
    general = (F.col("n_positive") >= 2) & (F.col("n_families") >= 2)
    rescue = (F.col("n_families") == 1) & (F.col("_f") == alone)
    return m.select(*keys, "n_positive", "n_families", F.when(general, "general").when(rescue, "one_family").otherwise("none").alias("verdict"))


def claim(metas: list[DataFrame], verdicts: DataFrame, brittle: DataFrame, keys: list[str], bar: float) -> DataFrame:
    """(keys, passes, claim): all pooled effects reach `bar` with intervals above 0, and no upper bound in `brittle` (keys, hi) fails."""
    out = verdicts
    passes = F.lit(True)
    for i, m in enumerate(metas):
        out = out.join(m.select(*keys, F.col("pooled").alias(f"_m{i}"), F.col("ci_lo").alias(f"_lo{i}")), keys, "left")
        passes = passes & F.coalesce(F.col(f"_lo{i}") > 0, F.lit(False)) & F.coalesce(F.col(f"_m{i}") >= bar, F.lit(False))
    worst = brittle.groupBy(*keys).agg(F.max("hi").alias("_hi"))
    out = out.join(worst, keys, "left").withColumn("passes", passes & F.coalesce(F.col("_hi") < 0.75, F.lit(True)))
    go = F.when(F.col("passes") & (F.col("verdict") == "general"), "go_general").when(F.col("passes") & (F.col("verdict") == "one_family"), "go_one_family").otherwise("no_go")
    return out.select(*keys, "n_positive", "n_families", "verdict", "passes", go.alias("claim"))


def holm(tests: DataFrame, keys: list[str], p: str, order: str) -> DataFrame:
    """Adds Holm's step-down adjusted p-values: a running maximum of p times the tests still open, at most 1."""
    w = W.partitionBy(*keys).orderBy(p, order)
    open_ = F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.row_number().over(w) + 1
    stepped = tests.withColumn("_a", F.col(p) * open_)
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("_a").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))).drop("_a")


def residualised(df: DataFrame, keys: list[str], y: str, x: str, least: int = 3) -> DataFrame:
    """Adds intercept, slope and residual of y on x within each key; null below `least` pairs or without spread."""
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(pair, F.col(x)), F.when(pair, F.col(y))
    m = df.groupBy(*keys).agg(F.count(a).alias("_n"), F.regr_slope(b, a).alias("b1"), F.regr_intercept(b, a).alias("b0"))
    ok = F.col("_n") >= least
    return df.join(m, keys).select(*df.columns, F.when(ok, F.col("b0")).alias("b0"), F.when(ok, F.col("b1")).alias("b1"), F.when(ok, F.col(y) - (F.col("b0") + F.col("b1") * F.col(x))).alias("residual"))


def weighted_slope(df: DataFrame, keys: list[str], y: str, x: str, w: str) -> DataFrame:
    """Weighted least squares of y on x: slope, intercept and the slope's standard error for known variances 1 / w."""
    s = lambda e: F.sum(F.col(w) * e)
    m = df.groupBy(*keys).agg(s(F.lit(1.0)).alias("s"), s(F.col(x)).alias("sx"), s(F.col(y)).alias("sy"), s(F.col(x) * F.col(x)).alias("sxx"), s(F.col(x) * F.col(y)).alias("sxy"))
    det = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    return m.select(*keys, F.when(det > 0, slope).alias("slope"), F.when(det > 0, (F.col("sy") - slope * F.col("sx")) / F.col("s")).alias("intercept"), F.when(det > 0, F.sqrt(F.col("s") / det)).alias("se"))


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: str) -> DataFrame:
    """The correlation of x and y given z."""
    m = df.groupBy(*keys).agg(F.corr(x, y).alias("xy"), F.corr(x, z).alias("xz"), F.corr(y, z).alias("yz"))
    left = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    return m.select(*keys, F.when(left > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(left)).alias("partial"), F.col("xy").alias("plain"))


def warnings(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in rules)))


def deployability(coverage: Column) -> Column:
    """Advice about a calibration, from columns n, share, auroc, ci_lo, ci_hi, oob_median and stability, missing ones giving none.

    `coverage` is an array of (cell, n): cells that were scored for less than four fifths of the samples are named. Fixed values:
    20 samples; shares of 0.3 to 0.7; areas of 0.65, and 0.6 out of the bag; intervals of 0.3; a gap of 0.15; a stability of 0.7."""
    c = F.col
    before = warnings((c("n") < 20, "small_n"), ((c("share") < 0.3) | (c("share") > 0.7), "imbalance"), (c("auroc") < 0.65, "low_auroc"), (c("ci_hi") - c("ci_lo") > 0.3, "wide_interval"))
    sparse = F.transform(F.filter(coverage, lambda x: x["n"] < 0.8 * c("n")), lambda x: F.concat(F.lit("coverage:"), x["cell"]))
    after = warnings((c("oob_median") < 0.6, "low_out_of_bag"), (c("auroc") - c("oob_median") > 0.15, "optimistic"), (c("stability") < 0.7, "unstable"))
    return F.concat(before, F.coalesce(sparse, F.array().cast("array<string>")), after)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided p of a 2 x 2 table [[a, b], [c, d]]: the chance of `a` or more with its margins, as hypergeometric terms."""
    log = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))
    fixed = log(a + b) + log(c + d) + log(a + c) + log(b + d) - log(a + b + c + d)
    one = lambda x: F.exp(fixed - log(x) - log(a + b - x) - log(a + c - x) - log(d - a + x))
    return F.aggregate(F.sequence(a.cast("int"), F.least(a + b, a + c).cast("int")), F.lit(0.0), lambda s, x: s + one(x))
