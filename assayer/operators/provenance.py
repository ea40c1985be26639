"""Checks of manifests, stored results and resumed work as joins of what is declared with what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.texts import safe_path


def verified(declared: DataFrame, present: DataFrame) -> DataFrame:
    """(path, status) of files in a manifest (path, sha256) and files found (path, sha256): ok, unsafe, malformed, missing,
    mismatch or undeclared."""
    both = declared.withColumnRenamed("sha256", "_want").join(present.withColumnRenamed("sha256", "_have"), "path", "full_outer")
    status = (
        F.when(F.col("_want").isNull(), "undeclared").when(~safe_path(F.col("path")), "unsafe").when(~F.rlike("_want", F.lit("^[0-9a-f]{64}$")), "malformed").when(F.col("_have").isNull(), "missing").when(F.col("_have") != F.col("_want"), "mismatch").otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def exit_code(report: DataFrame) -> DataFrame:
    """One row: 2 for a manifest that cannot be trusted, 1 for files that differ, else 0."""
    bad = lambda *names: F.count_if(F.col("status").isin(*names)) > 0
    return report.agg(F.when(bad("unsafe", "malformed"), 2).when(bad("missing", "mismatch"), 1).otherwise(0).alias("code"), F.count(F.lit(1)).alias("files"))


def mismatches(stored: DataFrame, expected: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """For each expected key, the names of fields whose stored value differs, or `absent`."""
    e = expected.select(*keys, *(F.col(f).alias(f"_e_{f}") for f in fields))
    both = e.join(stored.select(*keys, *fields, F.lit(True).alias("_there")), keys, "left")
    names = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_e_{f}")), F.lit(f)) for f in fields)))
    return both.select(*keys, F.when(F.col("_there").isNull(), F.array(F.lit("absent"))).otherwise(names).alias("mismatch"))


def rederived(stored: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Adds whether a recomputed value is within `tolerance` of the stored one; both missing count as equal."""
    both = stored.join(again.withColumnRenamed(value, "_again"), keys, "full_outer")
    same = (F.col(value).isNull() & F.col("_again").isNull()) | F.coalesce(F.abs(F.col(value) - F.col("_again")) <= tolerance, F.lit(False))
    return both.withColumn("same", same).drop("_again")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def inventory(files: DataFrame, group: str) -> DataFrame:
    """One map from path to hash for each group of files (path, sha256), in order of paths."""
    listed = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.groupBy(group).agg(F.map_from_entries(listed).alias("files"), F.count(F.lit(1)).alias("n"))


def module_hashes(package: str) -> dict[str, str]:
    """SHA-256 of each source file of an installed package, on the driver; it records which code made a result."""
    import hashlib
    import importlib
    from pathlib import Path

    root = Path(importlib.import_module(package).__file__).parent
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}


def bitwise_equal(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key and whether both sides hold the same double, or none."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full_outer")
    return both.select(*keys, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))
