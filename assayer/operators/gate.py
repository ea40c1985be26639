"""Data admission: every check of a dataset as one column of a violation aggregate, or observed while rows pass to a sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from assayer.functions.texts import normal_hash


@dataclass(frozen=True)
class Rules:
    """What a dataset must keep; a rule that is None is not checked. Columns that a rule reads need not exist otherwise.

    `n`: rows. `balance`: how far the share of label 1 may lie from one half. `cap`: words at most (`n_words`). `paired`: stems are
    exact {0, 1} pairs. `questions`: every row has `question_id`, and none is among the references'. `splits`: allowed values of
    `split`. `allocation`: rows by (split, label), exactly. `cue`: what a prompt ends with. `models`: the exact keys of the map
    `token_counts`, whose maximum `max_tokens` must be, at most `tokens`."""

    n: int | None = None
    balance: float = 0.1
    cap: int | None = None
    paired: bool = False
    questions: bool = False
    splits: tuple[str, ...] | None = None
    allocation: dict[tuple[str, int], int] | None = field(default=None, hash=False)
    cue: str | None = None
    models: tuple[str, ...] | None = None
    tokens: int | None = None


def _row_checks(rules: Rules) -> dict[str, Column]:
    """Counts that need no other row, by name."""
    held = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = {
        "n": F.count(F.lit(1)),
        "share": F.avg((F.col("label") == 1).cast("double")),
        "n_malformed": F.count_if(F.col("prompt").isNull() | (F.trim("prompt") == "") | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        "n_stemless": F.count_if(F.col("stem_id").isNull()),
    }
    if rules.cap is not None:
        out["longest"] = F.max("n_words")
    if rules.questions:
        out["n_unasked"] = F.count_if(F.coalesce(F.col("question_id").cast("string"), F.lit("")) == "")
    if rules.splits is not None:
        out["n_foreign"] = F.count_if(~F.coalesce(F.col("split").isin(*rules.splits), F.lit(False)))
    if rules.allocation is not None:
        for i, (s, y) in enumerate(rules.allocation):
            out[f"n_part{i}"] = held((F.col("split") == s) & (F.col("label") == y))
    if rules.cue is not None:
        out["n_uncued"] = F.count_if(~F.coalesce(F.endswith(F.rtrim("prompt"), F.lit(rules.cue)), F.lit(False)))
    if rules.tokens is not None:
        out["n_unmeasured"] = F.count_if(F.col("max_tokens").isNull())
        out["n_long"] = held(F.col("max_tokens") > rules.tokens)
    if rules.models is not None:
        counts = F.col("token_counts")
        exact = (F.array_sort(F.map_keys(counts)) == F.array(*(F.lit(m) for m in sorted(rules.models)))) & (F.array_max(F.map_values(counts)) == F.col("max_tokens"))
        out["n_unproven"] = F.count_if(~F.coalesce(exact, F.lit(False)))
    return out


def _row_failures(rules: Rules) -> list[tuple[str, Column]]:
    """The rules over `_row_checks`, in order."""
    out = [("schema", F.col("n_malformed") > 0), ("balance", F.coalesce(F.abs(F.col("share") - 0.5) > rules.balance + 1e-9, F.lit(False))), ("stemless", F.col("n_stemless") > 0)]
    if rules.n is not None:
        out.append(("size", F.col("n") != rules.n))
    if rules.cap is not None:
        out.append(("length", F.col("longest") > rules.cap))
    if rules.questions:
        out.append(("question_schema", F.col("n_unasked") > 0))
    if rules.splits is not None:
        out.append(("split", F.col("n_foreign") > 0))
    if rules.allocation is not None:
        parts = [F.col(f"n_part{i}") != want for i, want in enumerate(rules.allocation.values())]
        wrong = F.col("n") != sum(rules.allocation.values())
        for p in parts:
            wrong = wrong | p
        out.append(("allocation", wrong))
    if rules.cue is not None:
        out.append(("cue", F.col("n_uncued") > 0))
    if rules.tokens is not None:
        out += [("token_schema", F.col("n_unmeasured") > 0), ("token_cap", F.col("n_long") > 0)]
    if rules.models is not None:
        out.append(("token_map", F.col("n_unproven") > 0))
    return out


#: the order in which failures are named
ORDER = ["schema", "size", "balance", "repeated", "overlap", "question_schema", "question_overlap", "stemless", "stem_cap", "pairs", "split", "allocation", "cue", "length", "token_schema", "token_cap", "token_map"]


def admitted(rows: DataFrame, keys: list[str], rules: Rules, references: DataFrame | None = None) -> DataFrame:
    """The whole admission report of each dataset in `rows` (keys, prompt, label, stem_id and what `rules` read).

    `references` (hash, question_id) are prompts and questions that must not occur. `hard_failures` names the rules that fail, in
    `ORDER`, `warnings` soft ones (questions in the prompts that do not occur exactly twice, prompts without one), `passes` is true
    without hard failures. Row counts, prompts, stems and questions are each summed before they are shuffled."""
    hashed = rows.withColumn("_h", normal_hash(F.col("prompt")))
    question = F.trim(F.regexp_extract("prompt", r"(?s)Question:(.*?)(?:Proposed answer:|\Z)", 1))
    known = lambda c: references.where(F.col(c).isNotNull()).select(F.col(c).alias("_k")).distinct().withColumn("_known", F.lit(1))
    none = rows.sparkSession.createDataFrame([], "_k string, _known int")
    prompts = hashed.groupBy(*keys, F.col("_h").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).join(none if references is None else known("hash"), "_k", "left")
    prompts = prompts.groupBy(*keys).agg(F.count_if(F.col("_n") > 1).alias("n_repeated"), F.count("_known").alias("n_overlap"))
    stems = hashed.where("stem_id is not null").groupBy(*keys, "stem_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(F.when(F.col("label").isin(0, 1), F.col("label"))).alias("_labels"))
    stems = stems.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_stems"), F.count_if(F.col("_n") > 2).alias("n_over_cap"), F.count_if((F.col("_n") != 2) | (F.col("_labels") != 2)).alias("n_unpaired"))
    report = hashed.groupBy(*keys).agg(*(c.alias(n) for n, c in _row_checks(rules).items())).join(prompts, keys).join(stems, keys, "left")
    found = [*_row_failures(rules), ("repeated", F.col("n_repeated") > 0), ("overlap", F.col("n_overlap") > 0), ("stem_cap", F.col("n_over_cap") > 0)]
    soft: list[tuple[str, Column]] = []
    if rules.paired:
        found.append(("pairs", F.coalesce(F.col("n_unpaired") > 0, F.lit(True)) & (F.col("n_stemless") == 0)))
    if rules.questions:
        ids = rows.where("question_id is not null").select(*keys, F.col("question_id").cast("string").alias("_k")).distinct()
        ids = ids.join(none if references is None else known("question_id"), "_k", "left").groupBy(*keys).agg(F.count("_known").alias("n_question_overlap"))
        asked = rows.select(*keys, F.when(F.contains("prompt", F.lit("Question:")), question).alias("_q")).groupBy(*keys, "_q").agg(F.count(F.lit(1)).alias("_n"))
        asked = asked.groupBy(*keys).agg(F.sum(F.when(F.col("_q").isNull(), F.col("_n")).otherwise(0)).alias("n_unparsed"), F.count_if(F.col("_q").isNotNull() & (F.col("_n") != 2)).alias("n_odd_questions"))
        report = report.join(ids, keys, "left").join(asked, keys, "left").withColumn("n_question_overlap", F.coalesce("n_question_overlap", F.lit(0)))
        found.append(("question_overlap", F.col("n_question_overlap") > 0))
        soft = [("unparsed", F.col("n_unparsed") > 0), ("odd_questions", F.col("n_odd_questions") > 0)]
    named = lambda rules_: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules_))) if rules_ else F.array().cast("array<string>")
    found.sort(key=lambda x: ORDER.index(x[0]))
    return report.withColumn("hard_failures", named(found)).withColumn("warnings", named(soft)).withColumn("passes", F.size("hard_failures") == 0)


def observed(rows: DataFrame, rules: Rules, name: str = "gate") -> tuple[DataFrame, Observation]:
    """(rows, observation): the checks that need no other row are counted while the rows pass to whatever reads them; nothing is
    read twice. `observed_failures` reads the observation once an action has run."""
    watch = Observation(name)
    return rows.observe(watch, *(c.alias(n) for n, c in _row_checks(rules).items())), watch


def observed_failures(rows: DataFrame, watch: Observation, rules: Rules) -> list[str]:
    """The rules that the rows that passed broke; `rows` only gives the session."""
    got = watch.get
    one = rows.sparkSession.range(1).select(*(F.lit(got.get(n)).alias(n) for n in _row_checks(rules)))
    found = sorted(_row_failures(rules), key=lambda x: ORDER.index(x[0]))
    row = one.select(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in found)).first()
    return [n for n, _ in found if row[n]]


def checked(rows: DataFrame, keys: list[str], references: DataFrame | None = None, n: int | None = None, balance: float = 0.1, cap: int | None = None, paired: bool = False) -> DataFrame:
    """Admission report of each dataset in `rows` (keys, prompt, label, stem_id, n_words).

    `references` has `hash` of prompts that must not occur. Checks: size, schema, label balance (share of label 1 within
    `balance` of one half), repeated prompts, overlap, stems present, at most two rows a stem, exact {0, 1} pairs where `paired`,
    and a cap on length. `hard_failures` names those that fail, in this order; `pass` is true without any.
    """
    hashed = rows.withColumn("_h", normal_hash(F.col("prompt")))
    if references is not None:
        known = references.select(F.col("hash").alias("_h"), F.lit(1).alias("_known")).distinct()
        hashed = hashed.join(known, "_h", "left")
    else:
        hashed = hashed.withColumn("_known", F.lit(None).cast("int"))
    repeats = hashed.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_n"), F.max("_known").alias("_known")).groupBy(*keys)
    prompts = repeats.agg(F.sum(F.col("_n") - 1).alias("n_repeated"), F.sum(F.when(F.col("_known") == 1, F.col("_n")).otherwise(0)).alias("n_overlap"))
    stems = hashed.where("stem_id is not null").groupBy(*keys, "stem_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("label").alias("_labels"))
    by_stem = stems.groupBy(*keys).agg(F.max("_n").alias("most_per_stem"), F.count_if((F.col("_n") != 2) | (F.col("_labels") != 2)).alias("n_unpaired"))
    whole = hashed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("label") == 1).cast("double")).alias("share"),
        F.count_if(F.col("prompt").isNull() | ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("n_malformed"),
        F.count_if(F.col("stem_id").isNull()).alias("n_stemless"),
        F.max("n_words").alias("longest"),
    )
    report = whole.join(prompts, keys).join(by_stem, keys, "left")
    rules: list[tuple[str, Column]] = [
        ("schema", F.col("n_malformed") > 0),
        ("size", F.lit(False) if n is None else F.col("n") != n),
        ("balance", F.abs(F.col("share") - 0.5) > balance),
        ("repeated", F.col("n_repeated") > 0),
        ("overlap", F.col("n_overlap") > 0),
        ("stemless", F.col("n_stemless") > 0),
        ("stem_cap", F.col("most_per_stem") > 2),
        ("pairs", F.coalesce(F.col("n_unpaired") > 0, F.lit(True)) if paired else F.lit(False)),
        ("length", F.lit(False) if cap is None else F.col("longest") > cap),
    ]
    failures = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules)))
    return report.withColumn("hard_failures", failures).withColumn("pass", F.size("hard_failures") == 0)
