"""Personal data and the terms that give it away, built-in functions only.

Base entities (mail addresses, IP addresses, payment cards, phone numbers) come from patterns. Each stands for itself and for its
group: a mail address for its domain, an IP address for its network of 16 bits, a card for its issuer's six digits, a phone number
for its first four. Which other terms disclose an entity is estimated from the corpus (Sanchez and Batet, 2016): a term reveals it
by their pointwise mutual information, log2(N c(t,e) / ((n(t) + 1) n(e))), out of the entity's information, log2(N / n(e)). N, n
and c count documents of the whole corpus, all three by whole texts; the one document more is one without the entity, so that few
documents prove little. At least `SUPPORT` different texts must hold both, and groups that more than `COMMON` of the documents hold
identify nobody. Terms are runs of letters and digits outside entities. A term whose share reaches `GENERALISE` is generalised and
one that reaches `REMOVE` is removed, at all its places in every text that holds the entity.

Entities are searched once for a text. Only words that texts hold beside entities are candidates; a term can reach `GENERALISE` only if
enough of its documents hold an entity at all, which leaves few terms to be paired with entities, so the pairs do not grow with the
square of a text. Counts are pre-aggregated before each shuffle.

Defined cases: a null text is empty, has no spans and is not counted, and stays null where texts are sanitised; copies of a text
give no more support than one but count as documents; repeated rows each get their row; a term that discloses several entities
of a text gets the stronger treatment; of spans that begin at the same place the kind that is listed first comes first; an empty table
gives no rows; texts of any length are searched whole, and a task holds its longest one; extra columns are ignored by `detected`
and kept by `sanitised`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm._store import forget, stored
from assayer.llm.spans import count_of, listed, matches, outside, replaced

KINDS = ["email", "ip", "card", "phone", "generalise", "remove"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
# The base patterns. Possessive, and begun only where a run begins, so that long runs take linear time
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BETWEEN = r"[^\p{L}\p{N}]++"
#: stands for an entity where the words around it are told; a letter, so that no word begins or ends inside an entity
_MARK = "\uA015"
#: different texts that must hold a term and an entity together; shares of the entity's information
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: share of the documents from which on a group of entities identifies nobody
COMMON = 0.01
#: bytes of candidate terms that are sent to all tasks; more are joined after counting
SENT_BYTES = 32 << 20
_SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"
_BARE = "array<struct<kind:int,start:int,end:int>>"


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "")
    doubled = F.transform(F.filter(digits, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """Entities in whole texts; starts and ends in code points."""
    small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255)
    ip = F.filter(matches(text, 1, IP), lambda x: F.forall(F.split(x["value"], r"\."), small))
    card = F.filter(matches(text, 2, CARD), lambda x: _luhn(x["value"]))
    phone = F.filter(matches(text, 3, PHONE), lambda x: _digits(x["value"]).between(10, 15))
    none = F.array().cast(_SPANS)
    mail = F.when(F.contains(text, F.lit("@")), matches(text, 0, EMAIL)).otherwise(none)
    return F.concat(mail, F.when(F.rlike(text, F.lit("[0-9]")), F.concat(ip, card, F.when(F.contains(text, F.lit("+")), phone).otherwise(none))).otherwise(none))


def _protected(e: Column) -> Column:
    """What an entity (kind, value) stands for: itself and its group."""
    value, digits = F.lower(e["value"]), F.regexp_replace(e["value"], "[^0-9]", "")
    group = F.when(e["kind"] == 0, F.substring_index(value, "@", -1)).when(e["kind"] == 1, F.substring_index(value, ".", 2)).otherwise(F.when(e["kind"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4)))
    return F.array(F.concat(e["kind"].cast("string"), F.lit(":"), value), F.concat(e["kind"].cast("string"), F.lit("@"), group))


def _terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), BETWEEN)), "")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _corpus_counts(docs: DataFrame, likely: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold each of the terms `likely`, which are sent to all tasks if they are few enough."""
    held = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    size = likely.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        return held.join(F.broadcast(likely.select("term")), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(likely.select("term"), "term", "left_semi")


def disclosing(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(key, terms): for each different text with such terms, their spans (kind 4: to generalise, 5: to remove).

    `docs` has the column text; `found` (key, text, base) its rows with entities, not empty.
    """
    docs = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    total = docs.count()
    texts = stored(found.groupBy("key").agg(F.first("text").alias("text"), F.first("base").alias("base"), F.count(F.lit(1)).alias("copies")), "holders")
    holds = texts.select("key", "copies", F.explode(F.array_distinct(F.flatten(F.transform("base", _protected)))).alias("entity"))
    entities = holds.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count(F.lit(1)).alias("texts")).where((F.col("texts") >= support) & (F.col("n_e") < total))
    entities = entities.where((F.substring("entity", 2, 1) == ":") | (F.col("n_e") <= COMMON * total))
    entities = stored(entities.select("entity", "n_e"), "protected")
    holds = stored(holds.join(entities, "entity"), "holds")
    bare = replaced(F.col("text"), _bare("base"), [_MARK] * len(KINDS))
    own = texts.join(holds.select("key").distinct(), "key", "left_semi").select("key", "copies", F.explode(_terms(bare)).alias("term"))
    own = stored(own.where(~F.contains("term", F.lit(_MARK))), "own")
    likely = stored(own.groupBy("term").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support).select("term", "c"), "likely")
    counts = _corpus_counts(docs, likely).join(likely, "term")
    # no entity has fewer documents than `support`, and no pair more than the term has with all of them
    enough = (support / max(total, support)) ** (1 - generalise) * (1 - 1e-9)
    counts = stored(counts.where(F.col("c") >= enough * (F.col("n_t") + 1)).select("term", "n_t"), "counts")
    rows = stored(own.join(counts.select("term"), "term", "left_semi"), "rows")
    both = rows.join(holds.select("key", "entity"), "key")
    pairs = both.groupBy("term", "entity").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= support)
    share = F.log2(F.lit(float(total)) * F.col("c") / ((F.col("n_t") + 1) * F.col("n_e"))) / F.log2(F.lit(float(total)) / F.col("n_e"))
    chosen = pairs.join(entities, "entity").join(counts, "term").withColumn("share", share).where(F.col("share") >= generalise)
    chosen = stored(chosen.select("term", "entity", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind")), "chosen")
    wanted = rows.join(chosen, "term").join(holds.select("key", "entity"), ["key", "entity"], "left_semi").groupBy("key", "term").agg(F.max("kind").alias("kind"))
    wanted = stored(wanted.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("kinds")), "wanted")
    # only the wanted words of a text are located
    word = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort(F.map_keys("kinds")), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    words = texts.join(wanted, "key").select("key", "kinds", F.explode(outside(matches(F.col("text"), 0, word), F.col("base"))).alias("w"))
    spans = words.select("key", "w.start", "w.end", F.element_at("kinds", F.lower("w.value")).alias("kind")).where("kind is not null")
    out = stored(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("terms")), "terms")
    forget(texts, entities, holds, own, likely, counts, rows, chosen, wanted)
    return out


def _bare(base: str) -> Column:
    return F.transform(base, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def detected(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): base entities and disclosing terms."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), base_spans(text).alias("base"))
    some = F.size("base") > 0
    base = stored(base.select("doc_id", F.when(some, _key(F.col("text"))).alias("key"), F.when(some, F.col("text")).alias("text"), "base"), "entities")
    terms = disclosing(docs, base.where("key is not null").select("key", "text", "base"), support, generalise, remove)
    none = F.array().cast(_BARE)
    return base.select("doc_id", "key", "base").join(terms, "key", "left").select(
        "doc_id",
        *(count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        listed(F.concat(_bare("base"), F.coalesce("terms", none)), KINDS).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sanitised(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """`docs`, all columns, with entities and disclosing terms of `text` replaced, and n_chars, where it has it, set to match."""
    columns = docs.columns
    marked = docs.withColumn("__assayer_base", base_spans(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # written, so that entities are searched once; only texts that hold one are shuffled
    marked = stored(marked.withColumn("__assayer_some", F.size("__assayer_base") > 0), "marked")
    dirty = marked.where("__assayer_some").withColumn("__assayer_key", _key(F.col("text")))
    found = dirty.select(F.col("__assayer_key").alias("key"), F.col("text").cast("string").alias("text"), F.col("__assayer_base").alias("base"))
    terms = disclosing(docs, found, support, generalise, remove).toDF("__assayer_key", "__assayer_terms")
    none = F.array().cast(_BARE)
    dirty = dirty.join(terms, "__assayer_key", "left")
    dirty = dirty.withColumn("text", replaced(F.col("text"), F.concat(_bare("__assayer_base"), F.coalesce("__assayer_terms", none)), LABELS))
    if "n_chars" in columns:
        dirty = dirty.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return marked.where("not __assayer_some").select(*columns).union(dirty.select(*columns))
