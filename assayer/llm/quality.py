"""Quality rules: the log-likelihood ratio of hashed n-grams between trusted and raw text, built-in functions only.

Words and pairs of words are hashed into `CELLS` cells. Two multinomials over the cells are estimated: one from all documents, and
one from trusted documents with the first as its prior, worth `PRIOR` n-grams, so that few trusted documents decide little. A
document's score is the mean over its n-grams of the log of their ratio (as in data selection by importance resampling, Xie et al.,
2023, but with a threshold for every document instead of sampling). Documents below the threshold, or that fail the base rules, are not kept.

The multinomials have a fixed size, so they reach every task as one array of literals; counting sums up n-grams before the shuffle,
and scoring shuffles nothing.

Where rejected documents are given, too, the threshold is set from labelled rows: texts are dealt into `FOLDS` by their hash, so that
copies stay together; fold `CALIBRATION` sets the threshold, fold `HELD_OUT` is left for evaluation, and only trusted rows of the other
folds estimate the target. The threshold is the one with the least sum of the share of clean texts lost and the share of rejected texts
kept, among texts that pass the base rules and thresholds that lose at most `MOST_LOST` of the clean; of equal ones the lowest. With fewer than `LEAST` texts of a kind, `threshold` holds and
all trusted rows estimate the target.

Defined cases: a null or empty text has no words and fails the base rules; without trusted documents all scores are 0; a doc_id that
is both trusted and rejected sets no threshold; repeated
rows each get their row and count each; texts of any length are scored whole, by a task that holds the longest one and its words; a
score that equals the threshold is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from assayer.llm._store import forget, stored

CELLS, PRIOR = 10_000, 1000.0
#: natural log of the ratio for each n-gram, below which a document goes; clean documents of a small corpus, many of whose n-grams
#: no trusted document holds, come down to -0.2
THRESHOLD = -0.25
#: parts of the labelled texts; the one that sets the threshold and the one that nothing is fitted on
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1
#: trusted and rejected texts in the calibration fold, each, from which the threshold is set; share of the trusted that it may lose
LEAST, MOST_LOST = 10, 0.01
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _cells(w: Column, cells: int) -> Column:
    """The cells of a document's words and word pairs."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(cells)).cast("int"))
    pairs = F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.pmod(F.xxhash64(F.element_at(w, i + 1), x), F.lit(cells)).cast("int"))
    return F.concat(one, pairs)


def _repeated(w: Column) -> Column:
    """Words inside windows of five words that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        order = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return _let(order, marked)

    def marked(o: Column) -> Column:
        n = F.size(o)
        near = lambda x, i: F.when(
            ((i > 0) & (F.get(o, i - 1)["w"] == x["w"])) | ((i < n - 1) & (F.get(o, i + 1)["w"] == x["w"])), x["i"]
        )
        at = F.sort_array(F.filter(F.transform(o, near), lambda x: x.isNotNull()))
        step = lambda acc, p: F.struct((p + 5).alias("end"), (acc["n"] + F.least(F.lit(5), p + 5 - acc["end"])).alias("n"))
        return F.aggregate(at, F.struct(F.lit(-5).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def windows(of: Callable[..., Column]) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 4, F.lit(0))), lambda x, i: of(x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))

    # equal windows have equal hashes, so the windows themselves are needed only where hashes repeat
    repeats = _let(windows(F.xxhash64), lambda v: F.size(F.array_distinct(v)) < F.size(v))
    found = F.when(repeats, covered(windows(lambda *x: F.concat_ws(" ", *x)))).otherwise(0)
    return F.when(F.size(w) > 5, found).otherwise(0).cast("long")


def fold(text: Column) -> Column:
    """The part of the labelled texts that a text belongs to."""
    return F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(FOLDS)).cast("int")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def _logs(docs: DataFrame, trusted: DataFrame, cells: int, prior: float, apart: bool) -> list[float]:
    """For each cell, the log of its share of trusted n-grams over its share of all; `apart` leaves out the folds that fit nothing."""
    fits = docs.where(~fold(F.col("text")).isin(HELD_OUT, CALIBRATION)) if apart else docs

    def counts(rows: DataFrame) -> dict[int, int]:
        # two projections, so that a text is hashed once and not carried beside each n-gram; the outer form keeps the planner from
        # testing for empty arrays first, for which it would make the n-grams twice
        held = rows.select(_let(words(F.col("text")), lambda w: _cells(w, cells)).alias("cells")).select(F.explode_outer("cells").alias("cell")).where("cell is not null")
        return {r["cell"]: r["n"] for r in held.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    # all texts are counted where they are read; only those that may fit the target are dealt by doc_id, at every size alike
    raw, target = counts(docs), counts(fits.join(_listed(trusted).hint("shuffle_hash"), "doc_id", "left_semi"))
    n, m = sum(raw.values()), sum(target.values())
    logs = [0.0] * cells  # of cells that no document has, too
    for cell, count in raw.items():
        share = count / n
        logs[cell] = math.log((target.get(cell, 0) + prior * share) / (m + prior)) - math.log(share)
    return logs


def _calibration(docs: DataFrame, trusted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(label, text) of the different labelled texts of the calibration fold."""
    labels = _listed(trusted).withColumn("label", F.lit(1)).union(_listed(rejected).withColumn("label", F.lit(0)))
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    held = docs.where(fold(F.col("text")) == CALIBRATION).join(labels.hint("shuffle_hash"), "doc_id")
    return held.groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("label", "text")


def best_threshold(scores: list[tuple[int, float]]) -> float:
    """The threshold with the least sum of the shares of clean (1) texts lost and rejected (0) ones kept, none that loses over `MOST_LOST`; the lowest of equal ones."""
    n = [sum(label == k for label, _ in scores) for k in (0, 1)]
    order = sorted((s, label) for label, s in scores)
    kept, lost = n[0], 0
    best, at = 1.0, order[0][0]
    for i, (s, label) in enumerate(order):
        kept, lost = kept - (label == 0), lost + (label == 1)
        more = order[i + 1][0] if i + 1 < len(order) else math.inf
        if more > s and lost <= MOST_LOST * n[1] and kept / n[0] + lost / n[1] < best:
            best, at = kept / n[0] + lost / n[1], (s + more) / 2
    return at


def _set_threshold(known: DataFrame) -> float | None:
    """`best_threshold` of all rows of `known` (label, score), found where they are: counts by distinct score, running sums by ranges of
    scores, and one row to the driver. None where a label is missing."""
    counts = known.groupBy("score").agg(F.sum("label").alias("c1"), F.sum(1 - F.col("label")).alias("c0"))
    below = stored(counts, "scores")
    n1, n0, rows = below.agg(F.sum("c1"), F.sum("c0"), F.count(F.lit(1))).first()
    if not n1 or not n0:
        forget(below)
        return None
    ranges = below.repartitionByRange(max(1, -(-rows // (1 << 20))), "score").withColumn("_part", F.spark_partition_id())
    held = stored(ranges, "ranges")
    of = held.groupBy("_part").agg(F.sum("c1").alias("s1"), F.sum("c0").alias("s0"), F.min("score").alias("_least"))
    # one row a range of 2^20 scores
    order = W.orderBy("_part")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    starts = of.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("s1", "b1"), ("s0", "b0"))), F.lead("_least").over(order).alias("_after"))
    inside = W.partitionBy("_part").orderBy("score")
    each = held.join(starts, "_part").select("score", F.coalesce(F.lead("score").over(inside), "_after").alias("more"), (F.col("b1") + F.sum("c1").over(inside)).alias("lost"), (F.lit(n0) - F.col("b0") - F.sum("c0").over(inside)).alias("kept"))
    cost = F.col("kept") / F.lit(float(n0)) + F.col("lost") / F.lit(float(n1))
    best = each.where(F.col("lost") <= MOST_LOST * n1).select(cost.alias("cost"), "score", "more").where("cost < 1").orderBy("cost", "score").first()
    low = below.agg(F.min("score")).first()[0]
    forget(held)
    forget(below)
    if best is None:
        return low
    return math.inf if best["more"] is None else (best["score"] + best["more"]) / 2


def _found(own: DataFrame, logs: list[float], cells: int, keys: list[str]) -> DataFrame:
    """`keys` with the base counts, the score and whether the base rules fail."""
    literal, text = F.lit(logs), F.col("text")

    def measured(w: Column) -> Column:
        score = _let(_cells(w, cells), lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + F.get(literal, x)) / F.size(c)).otherwise(F.lit(0.0)))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words"), score.alias("score"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.when(F.rlike(text, F.lit(_SYMBOLS)), F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).otherwise(0)
    found = own.select(
        *keys,
        _let(words(text), measured).alias("m"),
        symbols.cast("long").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.select(*keys, "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words", "m.score").withColumn("base_failed", failed)


def ruled(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, cells: int = CELLS, prior: float = PRIOR, rejected: DataFrame | None = None) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): base counts, the score and whether the document is kept.

    `trusted` has the doc_id of trusted documents, `rejected` those of known junk, which set the threshold.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = None
    if rejected is not None:
        rows = stored(_calibration(own, trusted, rejected), "calibration")
        n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if min(n.get(0, 0), n.get(1, 0)) < LEAST:
            forget(rows)
            rows = None
    logs = _logs(own, trusted, cells, prior, rows is not None)
    if rows is not None:
        found = _set_threshold(_found(rows, logs, cells, ["label"]).where(~F.col("base_failed")).select("label", "score"))
        forget(rows)
        threshold = threshold if found is None else found
    return _found(own, logs, cells, ["doc_id"]).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
