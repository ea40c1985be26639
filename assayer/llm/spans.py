"""Places of pattern matches in whole texts, with built-in functions only.

`regexp_extract_all` gives the matches from left to right and `split` what lies between them, both by the same search, so the
running sum of their lengths gives each match's place in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
#: items that are folded one by one, and those that are cut out of an array at once: a fold copies what it has so far, and a slice
#: reads the whole array, so long arrays are cut twice and folded block by block
BLOCK, PART = 128, 8192


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(items: Column, size: int) -> Column:
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * size + 1, F.lit(size)))


def _blocks(items: Column) -> Column:
    return F.flatten(F.transform(_cut(items, PART), lambda part: _cut(part, BLOCK)))


def running(items: Column, kind: str, measure: Callable[[Column], Column], combine: Callable[[Column, Column], Column]) -> Column:
    """An array of (x, before): each item and what `combine` has made of the measures of all items before it, from 0.

    Time grows with the number of items: blocks are folded apart, then the blocks' own measures, and each block is moved by what
    lies before it. `kind` is the items' type."""
    start = lambda out: F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return F.struct(combine(acc["at"], measure(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("x"), acc["at"].alias("before")))).alias("out"))

    def next_(acc: Column, block: Column) -> Column:
        return F.struct(combine(acc["at"], block["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def moved(local: Column) -> Column:
        begins = F.aggregate(local, start("array<int>"), next_, lambda acc: acc["out"])
        each = lambda s: F.transform(local, lambda block, i: F.transform(block["out"], lambda y: F.struct(y["x"].alias("x"), combine(F.get(s, i), y["before"]).alias("before"))))
        return F.flatten(bound(begins, each))

    folded = lambda p: F.transform(_blocks(p), lambda block: F.aggregate(block, start(f"array<struct<x:{kind},before:int>>"), one))
    return bound(bound(items, folded), moved)


def matches(text: Column, kind: int, pattern: str | Column) -> Column:
    """Leftmost matches that do not overlap, as an array of (kind, start, end, value), in time that grows with the text. Matches must
    not be empty.

    `pattern` must hold no capturing group; possessive quantifiers keep long runs from overflowing the matcher's stack.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))
    walked = running(pairs, "struct<gap:string,value:string>", size, lambda a, b: a + b)

    def span(y: Column) -> Column:
        at = y["before"] + F.length(y["x"]["gap"])
        return F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(y["x"]["value"])).alias("end"), y["x"]["value"].alias("value"))

    out = F.transform(F.filter(walked, lambda y: y["x"]["value"].isNotNull()), span)
    return F.when(F.rlike(text, pattern), out).otherwise(F.array().cast(SPAN))


def outside(spans: Column, others: Column) -> Column:
    """Those of `spans` (as of `matches`) that overlap none of `others` (start, end), in order.

    Both are put in one order, spans by their ends and others by their starts: a span is free if no other that starts before its end
    ends after its start."""
    item = "struct<kind:int,start:int,end:int,value:string>"
    ends = F.transform(spans, lambda x: F.struct(x["end"].alias("pos"), F.lit(0).alias("reach"), x.cast(item).alias("item")))
    starts = F.transform(others, lambda x: F.struct(x["start"].alias("pos"), x["end"].alias("reach"), F.lit(None).cast(item).alias("item")))
    # at one place ends come first, as their reach of 0 is the least
    order = F.sort_array(F.concat(ends, starts))
    walked = running(order, f"struct<pos:int,reach:int,item:{item}>", lambda x: x["reach"], F.greatest)
    free = F.filter(walked, lambda y: y["x"]["item"].isNotNull() & (y["before"] <= y["x"]["item"]["start"]))
    return F.when(F.size(spans) > 0, F.transform(free, lambda y: y["x"]["item"])).otherwise(F.array().cast(SPAN))


def replaced(text: Column, spans: Column, labels: list[str]) -> Column:
    """`text` with each span (kind, start, end) replaced by its kind's label; of overlapping spans the first one's label stands for all."""
    texts = F.array(*(F.lit(x) for x in labels))
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    end = F.struct(F.length(text).alias("start"), F.lit(-1).alias("kind"), F.length(text).alias("end"))
    walked = running(F.concat(order, F.array(end)), "struct<start:int,kind:int,end:int>", lambda x: x["end"], F.greatest)
    # what lies before each span that begins behind all earlier ones, cut from a part of the text that is cut out once a block
    kept = F.filter(walked, lambda y: y["x"]["start"] >= y["before"])

    def pieces(block: Column) -> Column:
        first = F.get(block, F.lit(0))["before"]
        part = F.substring(text, first + 1, F.element_at(block, -1)["x"]["start"] - first)
        label = lambda y: F.when(y["x"]["kind"] < 0, "").otherwise(F.element_at(texts, F.greatest(y["x"]["kind"], F.lit(0)) + 1))
        return bound(part, lambda u: F.array_join(F.transform(block, lambda y: F.concat(F.substring(u, y["before"] - first + 1, y["x"]["start"] - y["before"]), label(y))), ""))

    return F.when(F.size(spans) > 0, bound(kept, lambda k: F.array_join(F.transform(_blocks(k), pieces), ""))).otherwise(text)


def listed(spans: Column, names: list[str]) -> Column:
    """`kind:start:end` of spans (kind, start, end), by start and then kind, joined by commas."""
    kinds = F.array(*(F.lit(n) for n in names))
    order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
