"""Bootstraps, permutations and folds as set operations.

A resample is a table of multiplicities: draws are counted by (replicate, unit) and joined to the samples, of which the unpicked
keep multiplicity 0 and are out of the bag. All replicates of a sample travel in one vector (`functions.vectors`). Draws come from MD5 of `seed:replicate:key:slot`, the same in any engine and on any
executor, so a recomputed task draws the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from assayer.functions import vectors
from assayer.functions.numbers import draw, finite
from assayer.operators.auroc import LEAST, running
from assayer.operators.ordering import hash_places, ranges_needed
from assayer.sources import scratch

#: rows of one key and cell that a task takes at most as one range, but for ties, and multiplicities that they may have together
RANGE_ROWS, RANGE_WEIGHTS = 1 << 15, 1 << 23
#: rows of a key that a task sorts by their hashes at once, about
CELL_ROWS = 1 << 15


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Each row n times, with `rep` from 0."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _numbered(samples: DataFrame, keys: list[str], unit: str, buckets: int) -> DataFrame:
    """`samples` with `_pos`, the number of the unit in the key, and `_units`, how many it has; rows without unit are left out."""
    if buckets > 1:
        units = samples.select(*keys, unit, F.lit(1).alias("_one")).distinct()
        sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_units"))
        numbered = running(units, keys, unit, {"_pos": "_one"}, buckets).join(sizes, keys).drop("_one")
        return samples.join(numbered, [*keys, unit])
    of = W.partitionBy(*keys)
    placed = samples.withColumn("_pos", F.dense_rank().over(of.orderBy(unit)).cast("long") - 1)
    return placed.withColumn("_units", F.max("_pos").over(of) + 1).where(F.col(unit).isNotNull())


def _chunk(n: int) -> int:
    """Units whose multiplicities one task takes at once."""
    return max(1024, min(1 << 17, RANGE_WEIGHTS // n))


def _with_draws(numbered: DataFrame, samples: DataFrame, keys: list[str], dealt: DataFrame, n: int) -> DataFrame:
    by = [*keys, "_chunk"]
    placed = numbered.select(*samples.columns, "_pos", F.expr(f"_pos div {_chunk(n)}").alias("_chunk"))
    schema = T.StructType([*samples.schema.fields, T.StructField("_draws", T.BinaryType())])
    return placed.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(vectors.counted(samples.columns, n, _chunk(n)), schema)


def packed_multiplicities(samples: DataFrame, keys: list[str], unit: str, n: int, seed: int, buckets: int = 1) -> DataFrame:
    """`samples` (keys, unit, ...) with `_draws`, how often the row's unit was drawn in each of `n` replicates, a byte each: a unit that
    is drawn 256 times in one replicate fails the query, and a draw has one in expectation.

    Units are drawn whole: rows that share one have the same multiplicity. With unique units this is the plain bootstrap. With
    `buckets` above 1, numeric units are numbered in that many ranges a key, so that a key may hold any share of the rows.
    A task deals its picks to chunks of units, four bytes a pick; a chunk's picks and samples meet in one task.
    """
    numbered = _numbered(samples, keys, unit, buckets)
    tag = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    pick = lambda rep: draw(F.col("_units"), F.lit(seed), rep, tag, F.col("_pos"))
    picks = F.array(*(pick(F.lit(rep)) for rep in range(n))) if n <= 32 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), pick)
    # a unit is a short row that makes n draws: dealt by number of tasks, not by size
    spread = numbered.select(*keys, "_pos", "_units").repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_pos").distinct()
    schema = T.StructType([*(samples.schema[k] for k in keys), T.StructField("_chunk", T.LongType()), T.StructField("_codes", T.BinaryType())])
    dealt = spread.select(*keys, picks.alias("_picks")).mapInArrow(vectors.dealt(keys, n, _chunk(n)), schema)
    return _with_draws(numbered, samples, keys, dealt, n)


def streamed_multiplicities(samples: DataFrame, keys: list[str], unit: str, order: str, n: int, seed: int) -> DataFrame:
    """`packed_multiplicities` by the sequential stream of `numpy.random.RandomState(seed)`, which begins anew in each key; units count by
    first occurrence in `order`. A task draws a key's stream, in which no place can be skipped, and holds a number for each unit;
    samples and counts meet by chunks."""
    first = samples.withColumn("_first", F.min(order).over(W.partitionBy(*keys, unit)))
    of = W.partitionBy(*keys)
    numbered = first.withColumn("_pos", F.dense_rank().over(of.orderBy("_first", unit)).cast("long") - 1).drop("_first")
    sizes = samples.groupBy(*keys).agg(F.count_distinct(unit).alias("_units"))
    # a row stands for a whole stream
    spread = sizes.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    schema = T.StructType([*(samples.schema[k] for k in keys), T.StructField("_chunk", T.LongType()), T.StructField("_rep", T.IntegerType()), T.StructField("_counts", T.BinaryType())])
    return _with_draws(numbered, samples, keys, spread.mapInArrow(vectors.streamed(keys, n, _chunk(n), seed), schema), n)


def multiplicities(samples: DataFrame, keys: list[str], unit: str, n: int, seed: int, buckets: int = 1) -> DataFrame:
    """`samples` for each replicate `rep` with `w`, how often its unit was drawn, 0 if it was not. A row for each sample and
    replicate: statistics of resamples are better taken from `packed_multiplicities`."""
    each = replicates(packed_multiplicities(samples, keys, unit, n, seed, buckets), n)
    w = F.conv(F.hex(F.substring("_draws", F.col("rep") + 1, F.lit(1))), 16, 10)
    return each.withColumn("w", w.cast("long")).drop("_draws")


def replicate_sums(packed: DataFrame, keys: list[str], values: dict[str, Column], n: int, out_of_bag: bool = False) -> DataFrame:
    """For each key and replicate: the sum of each value times the row's multiplicity, or over the rows that were not drawn.

    `packed` comes from `packed_multiplicities`. A task adds up its own rows as vectors over replicates, so that the shuffle carries
    rows for keys and replicates, not for samples. Null values count as 0."""
    held = packed.select(*keys, F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values.values())).alias("_values"), "_draws")
    names = list(values)
    schema = T.StructType([*(held.schema[k] for k in keys), *(T.StructField(v, T.ArrayType(T.DoubleType())) for v in names)])
    parts = held.mapInArrow(vectors.partial_sums(keys, names, n, out_of_bag), schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("rep", "_v"))
    return each.groupBy(*keys, "rep").agg(*(F.sum(f"_v.{v}").alias(v) for v in names))


def _bounds(rows: DataFrame, keys: list[str], sample: str, cells: list[str], range_rows: int) -> dict[tuple, list[float]]:
    """Lower ends of the ranges of scores of each key and cell with more than about `range_rows` rows: quantiles of the rows whose hash is
    least, the same in every run; a bound stands for that many rows."""
    each = rows.select(*keys, sample, F.inline("_cells")).withColumn("score", finite(F.col("score"))).where("score is not null")
    share = min(1.0, 64 / range_rows)  # about 64 sampled values a range
    chosen = F.pmod(F.xxhash64("score", sample), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    held = each.where(chosen).groupBy(*keys, *cells).agg(F.array_sort(F.collect_list("score")).alias("_v"))
    held = held.withColumn("_n", F.ceil(F.size("_v") / F.lit(range_rows * share)).cast("int")).where("_n > 1")
    at = lambda i: F.element_at("_v", (F.floor(i * F.size("_v") / F.col("_n")) + 1).cast("int"))
    found = held.select(*keys, *cells, F.transform(F.sequence(F.lit(1), F.col("_n") - 1), at).alias("_q")).collect()
    return {tuple(r[: len(keys) + len(cells)]): r["_q"] for r in found}


def bag_areas(scores: DataFrame, packed: DataFrame, keys: list[str], sample: str, cells: list[str], n: int, range_rows: int | None = None, labels: list[str] | None = None) -> DataFrame:
    """For each key, replicate and cell: area in the bag (by multiplicity) and out of it, with the counts behind them.

    `packed` comes from `packed_multiplicities`. A task sorts its scores by key, cell and label, adds up equal ones and sends them on by
    range, each with one vector over replicates. A key and cell with more than `range_rows` rows (by default as many as
    `RANGE_WEIGHTS` allow with `n` replicates) is cut into ranges of scores, whose pairs of labels are counted apart and across: no row stands for a sample, a cell and a replicate.

    `scores` has a row for each sample and cell, or for each sample, with `_cells`, an array of (cells, score); if `packed` has that
    array, too, nothing is joined.

    With `labels`, columns of `packed` that tell alternative labels of the same samples apart, `packed` has the label, and the areas
    are taken for each of them, on the same draws.
    """
    every = _bags(scores, packed, keys, sample, cells, n, range_rows, labels)
    return every.select(*keys, *(labels or []), "rep", *cells, "in_bag", "out_of_bag", "n_in", "n_out")


def _bags(scores: DataFrame, packed: DataFrame, keys: list[str], sample: str, cells: list[str], n: int, range_rows: int | None = None, labels: list[str] | None = None, rest: bool = False) -> DataFrame:
    """`bag_areas` with `o1` and `o0`, the labels out of the bag; with `rest` also a row without cell, for all samples."""
    alternatives = labels or []
    range_rows = range_rows or min(RANGE_ROWS, max(1024, RANGE_WEIGHTS // n))
    together = lambda df: df if "_cells" in df.columns else df.withColumn("_cells", F.array(F.struct(*cells, F.col("score").cast("double").alias("score"))))
    bounds = _bounds(together(scores), keys, sample, cells, range_rows)
    if "_cells" in packed.columns:
        rows = packed
    else:
        own = together(scores)
        rows = packed.select(*keys, sample, *alternatives, "_draws", *(["label"] if labels or "label" not in own.columns else [])).join(own.select(*keys, sample, "_cells", *([] if labels or "label" not in own.columns else ["label"])), [*keys, sample])
    rows = rows.where("label is not null")
    kinds = {f.name: f.dataType for f in rows.schema["_cells"].dataType.elementType}
    if rest:
        # a cell that is 0 for all samples: its counts are theirs
        one = F.array(F.struct(*(F.lit(0.0).alias(c) if c == "score" else F.lit(None).cast(k).alias(c) for c, k in kinds.items())))
        if "_cells" in packed.columns:
            rows = rows.withColumn("_cells", F.concat("_cells", one))
        else:
            rows = rows.unionByName(packed.where("label is not null").select(*(one.alias("_cells") if c == "_cells" else c for c in rows.columns)))
    rows = rows.select(*keys, *alternatives, F.col("label").cast("int").alias("label"), "_draws", "_cells")
    keys = [*keys, *alternatives]
    group = [*keys, *cells]
    by = [*group, "_range"]
    fields = [*(rows.schema[c] for c in keys), *(T.StructField(c, kinds[c]) for c in cells), T.StructField("_range", T.IntegerType())]
    dealt = rows.mapInArrow(vectors.dealt_scores(keys[: len(keys) - len(alternatives)], alternatives, cells, n, bounds), T.StructType([*fields, T.StructField("label", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("s", "bag", "rest"))]))
    longs = T.ArrayType(T.LongType())
    parts = dealt.groupBy(*by).applyInArrow(vectors.pairs_won(by, n), T.StructType([*fields, *(T.StructField(v, longs) for v in vectors.PARTS)]))
    each = parts.select(*by, F.posexplode(F.arrays_zip(*vectors.PARTS)).alias("rep", "_v")).select(*by, "rep", "_v.*")
    below = running(each, [*group, "rep"], "_range", {"ci": "i0", "co": "o0"})
    sums = below.groupBy(*group, "rep").agg(
        *(F.sum(c).alias(c) for c in ("i1", "i0", "o1", "o0")),
        F.sum(F.col("iw") + 2 * F.col("i1") * F.col("ci")).alias("_wi"),
        F.sum(F.col("ow") + 2 * F.col("o1") * F.col("co")).alias("_wo"),
    )
    area = lambda w, a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(w) / (2.0 * F.col(a) * F.col(b)))
    return sums.select(*group, "rep", area("_wi", "i1", "i0").alias("in_bag"), area("_wo", "o1", "o0").alias("out_of_bag"), (F.col("i1") + F.col("i0")).alias("n_in"), (F.col("o1") + F.col("o0")).alias("n_out"), "o1", "o0")


def nested_selection(scores: DataFrame, samples: DataFrame, keys: list[str], sample: str, unit: str, n: int, seed: int, least: int = LEAST, buckets: int = 1) -> DataFrame:
    """For each key and replicate: the cell that wins in the bag, its sign, and its area out of the bag under that sign.

    `scores` has cell and cell_idx; of equal distances from one half the lower cell_idx wins. A replicate whose unpicked samples
    are fewer than `least` or of one class is skipped; a winner counts even where its own unpicked scores do not suffice.
    """
    return selected(scores, packed_multiplicities(samples, keys, unit, n, seed, buckets), keys, sample, n, least)


def selected(scores: DataFrame, packed: DataFrame, keys: list[str], sample: str, n: int, least: int = LEAST, labels: list[str] | None = None) -> DataFrame:
    """`nested_selection` on given draws; `labels` as in `bag_areas`."""
    areas = _bags(scores, packed, keys, sample, ["cell", "cell_idx"], n, labels=labels, rest=True)
    keys = [*keys, *(labels or [])]
    every = F.col("cell").isNull()
    usable = F.max(every & (F.col("n_out") >= least) & (F.col("o1") > 0) & (F.col("o0") > 0))
    distance = F.when(~every & (F.col("n_in") >= least), F.abs(F.col("in_bag") - 0.5))
    best = F.max_by(F.struct("cell", "cell_idx", "in_bag", "out_of_bag", "n_out"), F.when(distance.isNotNull(), F.struct(distance.alias("d"), (-F.col("cell_idx")).alias("o"))))
    won = areas.groupBy(*keys, "rep").agg(best.alias("b"), usable.alias("_usable")).where("_usable and b.cell is not null")
    sign = F.when(F.col("b.in_bag") >= 0.5, 1).otherwise(-1)
    locked = F.when(sign == 1, F.col("b.out_of_bag")).otherwise(1 - F.col("b.out_of_bag"))
    return won.select(*keys, "rep", F.col("b.cell").alias("cell"), F.col("b.cell_idx").alias("cell_idx"), sign.alias("sign"), F.when(F.col("b.n_out") >= least, locked).alias("oob_auroc"))


def selection_summary(winners: DataFrame, keys: list[str], bar: float = 0.5) -> DataFrame:
    """Modal winner (ties to the lowest cell), its share, and percentiles of the areas out of the bag; deployable above `bar`."""
    counts = winners.groupBy(*keys, "cell", "cell_idx").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy(*keys).agg(F.max_by("cell", F.struct("c", (-F.col("cell_idx")).alias("o"))).alias("winner"), (F.max("c") / F.sum("c")).alias("winner_stability"))
    spread = winners.groupBy(*keys).agg(
        F.count("oob_auroc").alias("n_used"),
        F.percentile("oob_auroc", F.lit(0.5)).alias("oob_median"),
        F.percentile("oob_auroc", F.lit(0.025)).alias("ci_lo"),
        F.percentile("oob_auroc", F.lit(0.975)).alias("ci_hi"),
    )
    return modal.join(spread, keys).withColumn("deployable", F.coalesce(F.col("ci_lo") > bar, F.lit(False)))


def weighted_areas(scores: DataFrame, samples: DataFrame, keys: list[str], sample: str, cells: list[str], n: int, seed: int) -> DataFrame:
    """The in-bag area of each replicate and cell, all cells on the same draws."""
    return bag_areas(scores, packed_multiplicities(samples, keys, sample, n, seed), keys, sample, cells, n)


def weighted_correlation(packed: DataFrame, keys: list[str], x: str, y: str, n: int) -> DataFrame:
    """Pearson's correlation of each key and replicate from weighted moments; null without spread. `packed` comes from
    `packed_multiplicities` and has both columns; rows without one of them do not count."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    one, a, b = (F.when(both, v.cast("double")) for v in (F.lit(1), F.col(x), F.col(y)))
    m = replicate_sums(packed, keys, {"s": one, "sx": a, "sy": b, "sxx": a * a, "syy": b * b, "sxy": a * b}, n)
    vx, vy = F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("s") * F.col("syy") - F.col("sy") * F.col("sy")
    return m.select(*keys, "rep", F.when((vx > 0) & (vy > 0), (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).alias("r"))


def permuted(samples: DataFrame, keys: list[str], sample: str, value: str, seed: Column, into: str = "permuted") -> DataFrame:
    """Adds `value` of another row of the key: rows in one hash order take the values in another."""
    hashed = lambda *parts: F.md5(F.concat_ws(":", *parts, F.col(sample).cast("string")))
    taking = hash_places(samples, keys, hashed(seed.cast("string")), sample, "_to")
    values = hash_places(samples.select(*keys, sample, F.col(value).alias(into)), keys, hashed(F.lit("values")), sample, "_to")
    return taking.join(values.drop(sample), [*keys, "_to"]).drop("_to")


def permuted_counts(samples: DataFrame, keys: list[str], sample: str, seeds: list[str]) -> DataFrame:
    """(keys, sample, `_m`, `_c0`, `_c1`, ...): how many rows the sample has, and how many of them get label 1 by `permuted` with each seed.

    `samples` has `label`, 0 or 1, and whole numbers as `sample`, none missing; a sample with more than 4,095 rows in a key fails the query. Rows are not copied
    for each seed: a task hashes its rows for all seeds and deals them to cells by the first bits, at most about `CELL_ROWS` in each, as
    packed vectors. Cells are sorted and written; labels meet them by ranges of places."""
    spark = samples.sparkSession
    bits = (ranges_needed(samples, keys, CELL_ROWS) - 1).bit_length()
    by = [*keys, "_rep", "_cell"]
    at = [*(samples.schema[k] for k in keys), T.StructField("_rep", T.IntegerType()), T.StructField("_cell", T.IntegerType())]

    def ordered(value: str, firsts: list[str], kind: type) -> DataFrame:
        hashes = F.concat(*(F.unhex(F.md5(F.concat_ws(":", F.lit(first), F.col(sample).cast("string")))) for first in firsts))
        rows = samples.select(*keys, F.col(value).cast("long").alias("_value"), hashes.alias("_hash"))
        dealt = rows.mapInArrow(vectors.dealt_hashes(keys, len(firsts), bits), T.StructType([*at, *(T.StructField(c, T.BinaryType()) for c in ("_hash", "_values"))]))
        cells = dealt.groupBy(*by).applyInArrow(vectors.in_hash_order(by, kind), T.StructType([*at, T.StructField("_values", T.BinaryType()), T.StructField("_n", T.LongType())]))
        path = scratch.folder(spark, "order")
        cells.write.parquet(path)
        held = spark.read.parquet(path)
        starts = held.select(*by, "_n").withColumn("_start", F.sum("_n").over(W.partitionBy(*keys, "_rep").orderBy("_cell")) - F.col("_n"))
        return held.drop("_n").join(starts, by)

    places, labels = ordered(sample, seeds, np.int64), ordered("label", ["values"], np.uint8)
    block = lambda first, n: F.explode(F.sequence(F.expr(f"{first} div {CELL_ROWS}"), F.expr(f"({first} + {n} - 1) div {CELL_ROWS}"))).alias("_block")
    wanted = places.select(*by, "_start", "_n", block("_start", "_n"))
    have = labels.select(*keys, F.col("_values").alias("_l"), F.col("_start").alias("_s"), F.col("_n").alias("_k"), block("_start", "_n"))
    first, end = F.greatest("_start", "_s"), F.least(F.col("_start") + F.col("_n"), F.col("_s") + F.col("_k"))
    shared = wanted.join(have, [*keys, "_block"]).where((first < end) & (F.col("_block") == F.floor(first / CELL_ROWS)))
    piece = F.struct(first.alias("at"), F.substring("_l", (first - F.col("_s") + 1).cast("int"), (end - first).cast("int")).alias("l"))
    pieces = shared.groupBy(*by).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    joined = pieces.select(*by, F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["l"])).alias("_labels"))
    schema = T.StructType([*at[:-1], T.StructField("_sample", samples.schema[sample].dataType), T.StructField("_label", T.IntegerType())])
    each = places.select(*by, "_values").join(joined, by).select(*keys, "_rep", "_values", "_labels").mapInArrow(vectors.labelled(keys), schema)
    # five counts of twelve bits in a number
    digit = F.expr("shiftleft(cast(_label as bigint), 12 * (_rep % 5))")
    sums = each.groupBy(*keys, F.col("_sample").alias(sample)).agg(F.count_if(F.col("_rep") == 0).alias("_m"), *(F.sum(F.when(F.expr(f"_rep div 5 = {j}"), digit).otherwise(0)).alias(f"_d{j}") for j in range(-(-len(seeds) // 5))))
    few = F.when(F.col("_m") < 4096, F.col("_m")).otherwise(F.raise_error(F.lit("a sample has more than 4,095 rows in a key")).cast("long"))
    return sums.select(*keys, sample, few.alias("_m"), *(F.expr(f"shiftright(_d{i // 5}, {12 * (i % 5)}) & 4095").alias(f"_c{i}") for i in range(len(seeds))))


def exchanged(samples: DataFrame, keys: list[str], sample: str, stem: str, perms: int, seed: int) -> DataFrame:
    """`samples` for each of `perms` permutations, with `perm`, the permuted `label` and `unit`, what was exchanged.

    The data choose: where stems repeat within a key, labels are swapped within stems, which must be exact {0, 1} pairs or the query
    fails; elsewhere they are permuted over all rows of the key. A null stem stands for its row alone."""
    one = F.coalesce(F.concat(F.lit("s"), F.col(stem).cast("string")), F.concat(F.lit("r"), F.col(sample).cast("string")))
    held = samples.withColumn("_stem", one)
    by = held.groupBy(*keys, "_stem").agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_ones"), F.count_distinct("label").alias("_kinds"))
    kind = by.groupBy(*keys).agg(F.max("_n").alias("_most"), F.max(F.when((F.col("_n") != 2) | (F.col("_kinds") != 2), F.col("_stem"))).alias("_broken"))
    paired = kind.where("_most > 1").withColumn("_ok", F.when(F.col("_broken").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("labels can be swapped within exact pairs of labels only, and this stem is none: "), F.col("_broken")))))
    each = lambda df: df.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    at = F.lit(seed) + F.col("perm")
    # the condition is read, so that it cannot be optimised away
    pairs = each(held.join(paired.where("_ok").select(*keys), keys, "left_semi"))
    swap = swapped(pairs, [*keys], "_stem", at).drop("label").withColumnRenamed("swapped", "label").withColumn("unit", F.lit("stem"))
    rows = each(held.join(kind.where("_most = 1").select(*keys), keys, "left_semi"))
    moved = permuted(rows, [*keys, "perm"], sample, "label", at).drop("label").withColumnRenamed("permuted", "label").withColumn("unit", F.lit("row"))
    return swap.unionByName(moved).drop("_stem")


def shuffled_control(scores: DataFrame, samples: DataFrame, keys: list[str], sample: str, stem: str, n: int, seed: int, perms: int = 3, unit: str | None = None, bar: float = 0.5, tolerated: int = 1) -> DataFrame:
    """The whole nested selection on `perms` permutations of the labels, all on the same draws.

    (keys, perm, unit, winner, n_used, oob_median, ci_lo, ci_hi, excludes, n_excluding, passes): a permutation excludes the null where
    its lower bound is above `bar`, which one in forty does by chance, so a key fails only where more than `tolerated` do. Draws are
    of `unit` (the sample itself by default). Draws are made once; each permutation's labels travel beside them."""
    drawn = packed_multiplicities(samples, keys, unit or sample, n, seed)
    turned = exchanged(samples.select(*keys, sample, "label", F.col(stem).alias("_s")), keys, sample, "_s", perms, seed + 90210)
    labels = turned.select(*keys, sample, "perm", "unit", "label")
    packed = drawn.drop("label").join(labels, [*keys, sample])
    won = selected(scores, packed, keys, sample, n, labels=["perm", "unit"])
    out = selection_summary(won, [*keys, "perm", "unit"], bar).withColumnRenamed("deployable", "excludes")
    over = F.sum(F.col("excludes").cast("int")).over(W.partitionBy(*keys))
    return out.withColumn("n_excluding", over).withColumn("passes", F.col("n_excluding") <= tolerated)


def folds(samples: DataFrame, keys: list[str], sample: str, n_splits: int, repeats: int, seed: int) -> DataFrame:
    """Repeated stratified folds: `fold` by hash order within each label, modulo `n_folds` = min(max(2, n_splits), rarest class)."""
    by = samples.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.least(F.lit(max(2, n_splits)), F.min("_n")).alias("n_folds"))
    each = replicates(samples, repeats)
    order = F.md5(F.concat_ws(":", (F.lit(seed) + 1009 * F.col("rep")).cast("string"), F.col(sample).cast("string")))
    placed = hash_places(each, [*keys, "rep", "label"], order, sample, "_place", by)
    return placed.withColumn("fold", F.pmod(F.col("_place"), F.col("n_folds")).cast("int")).drop("_place")


def budgeted(samples: DataFrame, keys: list[str], sample: str, size: int, seed: int) -> DataFrame:
    """A stratified subsample of about `size` rows: max(2, size * share, rounded half to even) of each label, in hash order."""
    counts = samples.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(W.partitionBy(*keys))
    quotas = counts.select(*keys, "label", F.greatest(F.lit(2), F.bround(F.lit(size) * share, 0).cast("int")).alias("_quota"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(sample).cast("string")))
    placed = hash_places(samples, [*keys, "label"], order, sample, "_place").join(quotas, [*keys, "label"])
    return placed.where("_place < _quota").select(*samples.columns)


def swapped(pairs: DataFrame, keys: list[str], stem: str, seed: Column, into: str = "swapped") -> DataFrame:
    """Labels of exact {0, 1} pairs, exchanged within a stem where its hash bit says so. Every stem keeps one of each label."""
    return pairs.withColumn(into, F.when(draw(F.lit(2), seed, *(F.col(k) for k in keys), F.col(stem)) == 1, 1 - F.col("label")).otherwise(F.col("label")))


def unpaired(rows: DataFrame, keys: list[str], stem: str) -> DataFrame:
    """Stems that are not exact {0, 1} pairs; a swap needs that there are none."""
    by = rows.groupBy(*keys, stem).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.count_distinct("label").alias("labels"))
    return by.where("n <> 2 or labels <> 2")


def budgeted_stems(rows: DataFrame, keys: list[str], stem: str, size: int, seed: int) -> DataFrame:
    """Whole pairs up to an even budget of rows: the first size / 2 stems of each key in hash order."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(stem).cast("string")))
    chosen = hash_places(rows.select(*keys, stem).distinct(), keys, order, stem, "_place").where(F.col("_place") < size // 2)
    return rows.join(chosen.drop("_place"), [*keys, stem], "left_semi")
