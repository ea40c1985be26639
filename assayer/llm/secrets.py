"""Secret scanning with corpus-wide ownership frequency, built-in functions only.

Candidates are the base patterns' matches and long mixed tokens. The hash of each candidate's value is aggregated over the
corpus by distinct repositories and owners: a value that many owners hold is a widely copied example, one that a single owner
holds is owner-specific and may be live. Base matches are always reported, with that verdict; a mixed token becomes a span only
where it is owner-specific and lies outside of the base spans.

Copies of a value are made distinct by (hash, repository, owner) before the shuffle, so a value in a third of all rows is as cheap
as any other; the frequencies are joined back on the hash, which adaptive execution splits where a value is hot.

Defined cases: a null text is empty and has no spans; a null repository or owner is one of its own; repeated rows are scanned each
but count once; texts of any length, and with any number of matches, are scanned whole in time that grows with the text, by a task
that holds the longest one a few times; of matches that begin at one place the kinds' order decides in the list of spans; an empty
table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import stored
from assayer.llm.spans import count_of, listed, matches, outside

KINDS = ["assign", "access", "hex", "owned"]
# The base patterns, and the head of an assignment, whose rest is the value
ASSIGN_HEAD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN = ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]++"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: a mixed token: long, with lower and upper case letters and a digit
MIXED = r"(?<![A-Za-z0-9_-])(?=[a-z0-9_-]*[A-Z])(?=[A-Z0-9_-]*[a-z])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+"
#: owners from which on a value is a widely copied example
EXAMPLE_OWNERS = 3


def base_spans(text: Column) -> Column:
    """Assignments with a value of 6 characters or more, access keys and hex strings; starts and ends in code points."""
    value = lambda x: F.regexp_replace(x["value"], "^" + ASSIGN_HEAD, "")
    assign = F.filter(matches(text, 0, ASSIGN), lambda x: F.length(value(x)) >= 6)
    return F.concat(assign, matches(text, 1, ACCESS), matches(text, 2, HEX))


def scanned(docs: DataFrame, repository: Column, owner: Column, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its spans, their kinds and verdicts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        base_spans(text).alias("base"),
        matches(text, 3, MIXED).alias("more"),
    )
    found = found.withColumn("more", outside(F.col("more"), F.col("base")))
    rows = stored(found.withColumn("key", F.monotonically_increasing_id()), "candidates")
    secret = F.when(F.col("c.kind") == 0, F.regexp_replace("c.value", "^" + ASSIGN_HEAD, "")).otherwise(F.col("c.value"))
    each = rows.where(F.size("base") + F.size("more") > 0).select("key", "repository", "owner", F.explode(F.concat("base", "more")).alias("c"))
    each = each.select("key", "repository", "owner", "c.kind", "c.start", "c.end", F.unhex(F.md5(secret.cast("binary"))).alias("hash"))
    held = each.select("hash", "repository", "owner").distinct()
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("owners"))
    places = held.select("hash", "repository").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("repositories"))
    # written, so that the join shuffles the candidates for itself and can split a hash that many hold
    judged = each.join(stored(owners.join(places, "hash"), "frequencies"), "hash")
    live = (F.col("owners") == 1).alias("live")
    reported = judged.where((F.col("kind") < 3) | (F.col("owners") == 1))
    verdicts = reported.groupBy("key").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("all"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("owners") >= example_owners).alias("n_example"),
        F.max("repositories").alias("most_repositories"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(verdicts, "key", "left").select(
        "doc_id",
        *(count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        F.coalesce(listed(F.col("all"), KINDS), F.lit("")).alias("spans"),
        *(F.coalesce(c, zero).alias(c) for c in ("n_live", "n_example", "most_repositories")),
    )
