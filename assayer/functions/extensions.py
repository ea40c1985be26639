"""Extension points: named builders of column expressions, which queries look up by label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[..., Column]
COMPOSITES: dict[str, Builder] = {}


def composite(name: str) -> Callable[[Builder], Builder]:
    """Registers a builder of a score from other scores."""

    def add(f: Builder) -> Builder:
        COMPOSITES[name] = f
        return f

    return add


@composite("additive")
def _additive(a: Column, b: Column) -> Column:
    return a + b


@composite("gated")
def _gated(a: Column, b: Column) -> Column:
    return a * b


PROMPTS: dict[str, Builder] = {}


def prompt_strategy(name: str) -> Callable[[Builder], Builder]:
    """Registers a builder of what a model is given from a text."""

    def add(f: Builder) -> Builder:
        PROMPTS[name] = f
        return f

    return add


@prompt_strategy("raw")
def _raw(text: Column) -> Column:
    return text


@prompt_strategy("chat")
def _chat(text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>user\n"), text, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


@prompt_strategy("instruct")
def _instruct(text: Column) -> Column:
    return F.concat(F.lit("[INST] "), text, F.lit(" [/INST]"))


def prompted(text: Column, model: Column, strategies: dict[str, str], default: str = "raw") -> Column:
    """`text` as the row's model wants it: by the strategy that `strategies` names for the model, else by the default."""
    if missing := {default, *strategies.values()} - PROMPTS.keys():
        raise KeyError(f"no prompt strategy {sorted(missing)}; there are {sorted(PROMPTS)}")
    out = PROMPTS[default](text)
    for name in dict.fromkeys(strategies.values()):
        out = F.when(model.isin(*(m for m, s in strategies.items() if s == name)), PROMPTS[name](text)).otherwise(out)
    return out


def built(label: str, df: DataFrame) -> Column:
    """The column that a label names: a plain column, or `name(column, column)` of a registered composite."""
    if "(" not in label:
        return df[label]
    name, _, rest = label.rstrip(")").partition("(")
    if name not in COMPOSITES:
        raise KeyError(f"no composite {name!r}; there are {sorted(COMPOSITES)}")
    return COMPOSITES[name](*(df[c.strip()] for c in rest.split(",")))


def register_sql(spark: SparkSession) -> None:
    """Makes the engine's expressions callable from SQL, as functions that Catalyst inlines."""
    spark.sql(r"create or replace temporary function yes_no_bare(t string) returns string return case when t rlike '(?i)^\\s*(yes|no)(?![0-9A-Za-z_])' then upper(regexp_extract(t, '(?i)^\\s*(yes|no)(?![0-9A-Za-z_])', 1)) end")
    spark.sql("create or replace temporary function hash_draw(n bigint, k string) returns bigint return pmod(cast(conv(substr(md5(k), 1, 8), 16, 10) as bigint), n)")


def last_tier(name: str, pattern: str, tiers: dict[str, str]) -> dict[str, str]:
    """Answer tiers with one more, weaker than all others."""
    return {**tiers, name: pattern}


def scored(df: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """Long scores of the labelled composites."""
    return df.select(*keep, F.inline(F.array(*(F.struct(F.lit(x).alias("cell"), built(x, df).cast("double").alias("score")) for x in labels))))
