"""Multidimensional clustered layout: rows ordered along a Morton curve over equal-depth coordinates, and cut into files.

Each dimension's values are counted; a running sum over the distinct values tells how many rows have a smaller one, and so the
value's coordinate, the share of smaller rows in steps of 1/2**bits. Coordinates join back to the rows, a row's coordinates are
interleaved bit by bit (shift and or) into its z value, and rows are numbered by z, then key. A file is a run of `file_rows`
positions; its bounds are the least and greatest coordinate of each dimension, as a reader's statistics would have them.
`selectivity` asks, for every distinct cell, which files a query around it has to open, and which hold a row of its answer.

How it is distributed. Nothing that grows with the input goes through one task, to the driver or into a broadcast:

* Running sums over distinct values: all dimensions' values are dealt by range over tasks; each task sums its own, and the tasks'
  totals (one row for each task and dimension) give where each task starts.
* A coordinate's values are an interval, so at most 2**bits first values a dimension decide the coordinate of every row. These
  join back as a comparison with each first value instead of a join by value, in which a few values hold most rows.
* Numbers: offsets by z (at most 2**(bits x dimensions) rows) and, inside a z that many rows share, by range of key; rows are
  dealt by (z, key), so a hot cell is spread over tasks.
* Cells and file bounds: bounds join equal on the dimensions whose coordinate the query fixes and by range on the others; files of
  equal bounds are one row with a count before that join.

Defined cases: a null is smaller than every value (the length of a null text is -1, its own value); strings compare by UTF-8 bytes;
an empty table gives no rows; empty and very long texts only count by their length; rows with equal z and key, which agree in all
that is returned but the position, take neighbouring positions in any order; null keys come first within their z; extra columns are
ignored by `laid_out` and kept by `clustered`, whatever their names; all coordinates are 0 where all rows agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored

BITS = 3
FILE_ROWS = 2000


def crc_date(doc_id: Column) -> Column:
    """A stand-in for a date: the unsigned CRC-32 of the decimal id, in days of a year."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 365


def _range_dealt(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """`df` written in ranges of `order`, with the number of its range as `part`."""
    return stored(df.repartitionByRange(*(F.col(x).asc_nulls_first() for x in order)).withColumn("part", F.spark_partition_id()), tag)


def first_values(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> dict[str, list[tuple[int, object]]]:
    """For each dimension the coordinates above 0 that occur and the least value of each: at most 2**bits - 1 pairs."""
    kinds = dict(rows.dtypes)
    # one table of distinct values: a column for each kind keeps each kind's own order
    groups = sorted({kinds[d] for d in dimensions})
    cell = F.explode(F.array(*(F.struct(F.lit(i).alias("d"), *((F.col(d) if kinds[d] == g else F.lit(None)).cast(g).alias(f"v{k}") for k, g in enumerate(groups))) for i, d in enumerate(dimensions))))
    value = [f"v{k}" for k in range(len(groups))]
    counts = rows.select(cell.alias("x")).select("x.*").groupBy("d", *value).agg(F.count(F.lit(1)).alias("n"))
    dealt = _range_dealt(counts, ["d", *value], "distinct")
    parts = dealt.groupBy("d", "part").agg(F.sum("n").alias("n"))
    starts = parts.selectExpr("d", "part", "sum(n) over (partition by d order by part) - n as start", "sum(n) over (partition by d) as rows")
    smaller = f"start + sum(n) over (partition by d, part order by {', '.join(f'{v} nulls first' for v in value)}) - n"
    summed = dealt.join(starts, ["d", "part"]).selectExpr("d", *value, f"{smaller} as smaller", "rows")
    placed = summed.withColumn("c", F.expr(f"int(({1 << bits} * smaller) div rows)")).where("c > 0")
    held = placed.groupBy("d", "c").agg(F.min(F.struct(*value)).alias("least")).collect()
    forget(dealt)
    out: dict[str, list[tuple[int, object]]] = {d: [] for d in dimensions}
    for r in sorted(held, key=lambda r: (r.d, r.c)):
        name = dimensions[r.d]
        out[name].append((r.c, r.least[groups.index(kinds[name])]))
    return out


def _coordinate(name: str, kind: str, firsts: list[tuple[int, object]]) -> Column:
    """The greatest coordinate whose first value is not above the row's; null is below all."""
    out = F.lit(0)
    for c, value in firsts:
        out = F.when(F.col(name) >= F.lit(value).cast(kind), F.lit(c)).otherwise(out)
    return out


def _rounds(dimensions: int, bits: int) -> list[tuple[int, int]]:
    """(dimension, bit) from the highest digit of z down: the last dimension leads each round."""
    return [(d, b) for b in reversed(range(bits)) for d in reversed(range(dimensions))]


def morton(coordinates: list[Column], bits: int = BITS) -> Column:
    """Binary digits of the coordinates interleaved, highest first, each round in the order last to first."""
    at = _rounds(len(coordinates), bits)
    digits = [F.shiftleft(F.shiftright(coordinates[d].cast("long"), b).bitwiseAND(F.lit(1)), len(at) - 1 - i) for i, (d, b) in enumerate(at)]
    return reduce(lambda a, b: a.bitwiseOR(b), digits)


def unmorton(z: Column, dimensions: int, bits: int = BITS) -> list[Column]:
    """The coordinates that `morton` has interleaved."""
    at = _rounds(dimensions, bits)
    out = [F.lit(0).cast("long")] * dimensions
    for i, (d, b) in enumerate(at):
        out[d] = out[d].bitwiseOR(F.shiftleft(F.shiftright(z, len(at) - 1 - i).bitwiseAND(F.lit(1)), b))
    return out


def z_values(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> Column:
    """The z value of each row of `rows`, whose columns `dimensions` are strings or numbers."""
    kinds, firsts = dict(rows.dtypes), first_values(rows, dimensions, bits)
    return morton([_coordinate(d, kinds[d], firsts[d]) for d in dimensions], bits)


def _numbered(cells: DataFrame) -> DataFrame:
    """(key, z, position) for rows (key, z), in the order of both; `cells` is dealt by ranges of both and read again."""
    dealt = _range_dealt(cells, ["z", "key"], "curve")
    counts = dealt.groupBy("z", "part").agg(F.count(F.lit(1)).alias("n"))
    # ranges follow z, so (z, part) in order is the order of the rows; offsets by z first, then by range within a z
    by_z = counts.groupBy("z").agg(F.sum("n").alias("n")).selectExpr("z", "sum(n) over (order by z) - n as z_start")
    starts = counts.selectExpr("z", "part", "sum(n) over (partition by z order by part) - n as part_start").join(F.broadcast(by_z), "z")
    ranked = dealt.selectExpr("*", "row_number() over (partition by z, part order by key nulls first) - 1 as r")
    return ranked.join(F.broadcast(starts), ["z", "part"]).selectExpr("key", "z", "z_start + part_start + r as position")


def selectivity(files: DataFrame, pairs: DataFrame, dimensions: int, fixed: int, bits: int = BITS) -> DataFrame:
    """For every distinct z: how many files a query around its cell touches by their bounds, and how many hold a row of it.

    A query fixes the first `fixed` coordinates and takes the others at most 1 away. `files` has the bounds (low0, high0, ...) of
    each file, `pairs` the distinct (file, z)."""
    every = pairs.select("z").distinct()
    cells = every.select("z", *(c.alias(f"c{d}") for d, c in enumerate(unmorton(F.col("z"), dimensions, bits))))
    bounds = [f"{side}{d}" for d in range(dimensions) for side in ("low", "high")]
    alike = files.groupBy(*bounds).agg(F.count(F.lit(1)).alias("files"))
    for d in range(fixed):  # a file's interval of a fixed coordinate, cell by cell, so that the join can be an equal one
        alike = alike.withColumn(f"c{d}", F.explode(F.sequence(f"low{d}", f"high{d}")))
    near = reduce(lambda a, b: a & b, [(F.col(f"low{d}") <= F.col(f"c{d}") + 1) & (F.col(f"high{d}") >= F.col(f"c{d}") - 1) for d in range(fixed, dimensions)], F.lit(True))
    by = [f"c{d}" for d in range(fixed)]
    alike = alike.drop(*(f"{side}{d}" for d in range(fixed) for side in ("low", "high")))
    met = cells.join(alike, by).where(near).groupBy("z").agg(F.sum("files").alias("files_touched"))
    # each held cell answers the queries of its neighbours, itself included
    around = pairs.select("file", *(c.alias(f"c{d}") for d, c in enumerate(unmorton(F.col("z"), dimensions, bits))))
    top = (1 << bits) - 1
    for d in range(fixed, dimensions):
        around = around.withColumn(f"c{d}", F.explode(F.sequence(F.greatest(F.col(f"c{d}") - 1, F.lit(0)), F.least(F.col(f"c{d}") + 1, F.lit(top)))))
    asked = around.select("file", morton([F.col(f"c{d}") for d in range(dimensions)], bits).alias("z"))
    hold = asked.distinct().groupBy("z").agg(F.count(F.lit(1)).alias("files_matching"))
    return every.join(met, "z", "left").join(hold, "z", "left")


def laid_out(rows: DataFrame, key: str, dimensions: list[str], *, fixed: int = 2, bits: int = BITS, file_rows: int = FILE_ROWS) -> DataFrame:
    """One row for each row of `rows`: (key, z, position, file, files_touched, files_matching, file_bounds).

    The query of a row fixes its first `fixed` coordinates and takes the others at most 1 away."""
    narrow = stored(rows.select(F.col(key).alias("key"), *dimensions), "values")
    n = len(dimensions)
    cells = narrow.select("key", z_values(narrow, dimensions, bits).alias("z"))
    placed = stored(_numbered(cells).withColumn("file", F.expr(f"position div {file_rows}")), "positions")
    coordinates = unmorton(F.col("z"), n, bits)
    sides = [f(c).alias(f"{side}{d}") for d, c in enumerate(coordinates) for side, f in (("low", F.min), ("high", F.max))]
    counts = stored(selectivity(placed.groupBy("file").agg(*sides), placed.select("file", "z").distinct(), n, fixed, bits), "selectivity")
    # the rows of a file are few and lie together; its bounds come from them instead of a join with a table of files
    whole = " over (partition by file)"
    decoded = placed.select("*", *(c.alias(f"c{d}") for d, c in enumerate(coordinates)))
    bounds = F.concat_ws(",", *(F.expr(f"{f}(c{d}){whole}") for d in range(n) for f in ("min", "max")))
    # at most 2**(bits x dimensions) rows
    out = decoded.withColumn("file_bounds", bounds).join(F.broadcast(counts), "z")
    return out.select(F.col("key").alias(key), "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def clustered(rows: DataFrame, key: str, dimensions: list[str], path: str, *, bits: int = BITS, files: int = 200) -> None:
    """Writes `rows`, with all columns, as Parquet in the order of the curve: the layout that `laid_out` describes, in about `files`
    files of equal rows, so that a reader's statistics prune by every dimension."""
    at = max(rows.columns, key=len) + "_z"  # no column has this name
    placed = rows.withColumn(at, z_values(rows, dimensions, bits))
    placed.repartitionByRange(files, at, F.col(key).asc_nulls_first()).sortWithinPartitions(at, F.col(key).asc_nulls_first()).drop(at).write.parquet(path)


def document_dimensions(docs: DataFrame) -> DataFrame:
    """Documents as (doc_id, source, lang, length, date)."""
    length = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), length.alias("length"), crc_date(F.col("doc_id")).alias("date"))
