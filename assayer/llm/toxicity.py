"""Toxicity scores from a lexicon trie intersected with Levenshtein automata, weighed by context windows.

The lexicon is learned from labelled rows: words and word beginnings that toxic texts hold far more often than others. A beginning
is a stem where it covers clearly more texts than any single word that begins so; it accepts any ending, and the words that it
covers stay in the lexicon beside it. Each word of a text is read by a Levenshtein automaton (a bit-parallel one, a bit mask for
each number of edits) that walks the lexicon's trie, so misspelled words are caught; misspellings that clean training texts hold
are no evidence. A hit between quotation marks within its context window counts as quotation, others as abuse. A logistic model
weighs plain hits, misspelled hits and quoted hits.

Defined cases: null and empty texts have no hits and get the score of a text without any; texts of any length are read whole, and a
task holds its longest one a few times; of equally near words of the lexicon the first in order is the hit; a doc_id with several
labels counts as toxic if one says so; null labels are ignored; without labels of both kinds the lexicon is empty and every score
is the same; extra columns are ignored by `scores` and kept by `without_toxic`, whatever their names; repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.llm._store import forget, stored
from assayer.llm._words import ALNUM, slices

#: labelled rows that the lexicon and the weights are fitted on, at most; those of the least hashes of doc_id
TRAIN_ROWS = 20_000
#: lengths of word beginnings that may become terms
STEMS = (4, 5, 6, 7, 8)
#: a term is this many times as frequent in toxic texts
RATIO = 20.0
#: texts and share of the toxic texts that must hold a term; the share bounds the lexicon, as a text holds only so many words
MIN_TEXTS, MIN_SHARE = 6, 0.01
#: characters before and after a hit that decide whether it is quoted
CONTEXT = 60
#: what a misspelled hit counts of an exact one
MISSPELLED = 0.5

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if ALNUM[c] else 32 for c in range(256))
_QUOTES = ('"', "“", "”", "„", "«", "»")


def _latin(letters: str) -> str:
    """UTF-8 bytes as characters, in which texts are searched; words are compared by letters."""
    return letters.encode().decode("latin-1")


def _folded(text: bytes) -> str:
    """The bytes of a text between two spaces: A to Z in lower case, a space for each byte that is in no word."""
    for q in _QUOTES[1:]:
        if (raw := q.encode()) in text:
            text = text.replace(raw, b" " * len(raw))
    return f" {text.translate(_FOLD).decode('latin-1')} "


def edits(term: str) -> int:
    """Edits, in letters, that a misspelling of the term may have."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Trie:
    """The lexicon. Stems accept any word that begins like them, terms only whole words."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.root: dict = {}
        for kind, words in (("term", terms), ("stem", stems)):
            for w in words:
                node = self.root
                for c in w:
                    node = node.setdefault(c, {})
                node[kind] = w

    def nearest(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term of the lexicon within its number of edits; ties go to the first in order."""
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        end, best = 1 << len(word), None
        todo = [(self.root, 1, 3, 7)]  # states with no, one and two edits: reachable positions in the word
        while todo:
            node, s0, s1, s2 = todo.pop()
            for kind in ("term", "stem"):
                if term := node.get(kind):
                    k = edits(term) if kind == "term" else 0
                    for e, s in ((0, s0), (1, s1), (2, s2))[: k + 1]:
                        if s & end if kind == "term" else s:
                            best = min(best or (e, term), (e, term))
                            break
            for c, child in node.items():
                if len(c) > 1:
                    continue
                m = mask.get(c, 0)
                n0 = (s0 & m) << 1
                n1 = (s1 & m) << 1 | s0 | s0 << 1 | n0 << 1
                n2 = (s2 & m) << 1 | s1 | s1 << 1 | n1 << 1
                if n2 & (2 * end - 1):
                    todo.append((child, n0, n1, n2))
        return best


@dataclass
class Model:
    """What scoring needs; as large as the lexicon and the misspellings of it that clean training texts hold."""

    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = (-2.0, 2.0, 2.0, 0.0)


class Finder:
    """Finds lexicon hits. Pieces of the terms, of which a misspelling keeps one, tell which words the automaton must read."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.trie = Trie(model.terms, model.stems)
        self.known: dict[str, tuple[int, str] | None] = {}
        pieces = {f" {s}" for s in model.stems}
        for t in model.terms:
            n = edits(t) + 1
            cuts = [len(t) * i // n for i in range(n + 1)]
            if n == 1:
                pieces.add(f" {t} ")
            else:  # edits elsewhere leave the first piece at the word's beginning and the last at its end
                pieces |= {f" {t[: cuts[1]]}", f"{t[cuts[-2]:]} ", *(t[cuts[i] : cuts[i + 1]] for i in range(1, n - 1))}
        self.pieces = ahocorasick.Automaton()
        for p in map(_latin, pieces):
            self.pieces.add_word(p, len(p))
        if pieces:
            self.pieces.make_automaton()
        self.any = bool(pieces)

    def words(self, folded: str) -> list[tuple[int, int, str]]:
        """Words that hold a piece: (start and end in bytes, word). `folded` are bytes between two spaces."""
        out, last = [], -1
        if self.any:
            for end, n in self.pieces.iter(folded):
                inner = end if folded[end] != " " else end - 1
                if inner < last:
                    continue
                a, b = folded.rfind(" ", 0, inner + 1) + 1, folded.find(" ", inner)
                if a < b:
                    out.append((a, b, folded[a:b].encode("latin-1").decode("utf-8", "replace")))
                last = b
        return out

    def near(self, word: str) -> tuple[int, str] | None:
        """The nearest term of a word of letters."""
        if word not in self.known:
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[word] = self.trie.nearest(word)
        return self.known[word]

    def counts(self, text: bytes) -> tuple[int, int, int]:
        """Plain exact hits, plain misspelled hits, quoted hits of a whole text."""
        exact = wrong = quoted = 0
        for a, b, word in self.words(_folded(text)):
            hit = self.near(word)
            if hit is None or hit[0] and word in self.model.clean:
                continue
            # places in `text` are one less; a letter has at most four bytes
            before = text[max(0, a - 1 - 4 * CONTEXT) : a - 1].decode("utf-8", "ignore")[-CONTEXT:]
            after = text[b - 1 : b - 1 + 4 * CONTEXT].decode("utf-8", "ignore")[:CONTEXT]
            if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
                quoted += 1
            elif hit[0]:
                wrong += 1
            else:
                exact += 1
        return exact, wrong, quoted


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _pair_hashes(words: Column, seed: int) -> Column:
    return F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.lit(seed)))


def _beginnings(words: Column, n: int) -> Column:
    """The first n letters of longer words, marked by a star."""
    return F.transform(F.filter(words, lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))


def _lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    """(terms, stems) with `RATIO` times the share of toxic texts, by support; copies of a text count once."""
    texts = train.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n1, n0 = texts.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n1 or not n0:
        return [], []
    # words as in `_folded`
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    each = texts.select("toxic", F.split(F.translate("text", upper, lower), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F" + "".join(_QUOTES[1:]) + "]+").alias("w"))
    # near copies would make all their words look toxic: one text stands for those with the same least hash of word pairs
    for seed in (1, 2):
        each = each.groupBy("toxic", F.array_min(_pair_hashes(F.col("w"), seed)).alias("least")).agg(F.min_by("w", F.xxhash64("w")).alias("w")).select("toxic", "w")
    each = stored(each, "clusters")
    n1, n0 = each.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    made = [_beginnings(F.col("w"), n) for n in STEMS]
    terms = each.select("toxic", F.explode(F.array_distinct(F.concat(F.filter("w", lambda x: F.length(x) >= 4), *made))).alias("term"))
    counts = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("df1"), F.count_if(F.col("toxic") == 0).alias("df0"))
    ratio = ((F.col("df1") + 0.5) / (n1 + 1.0)) / ((F.col("df0") + 0.5) / (n0 + 1.0))
    best = counts.where((F.col("df1") >= max(MIN_TEXTS, math.ceil(MIN_SHARE * n1))) & (ratio >= RATIO)).collect()
    forget(each)
    chosen: dict[str, int] = {}
    stems: list[str] = []
    by_term = {r["term"]: r["df1"] for r in best}
    for term in sorted(by_term, key=lambda t: (len(t.rstrip("*")), t)):
        bare = term.rstrip("*")
        if not term.endswith("*"):
            chosen[bare] = by_term[term]
        # a stem must cover clearly more texts than the single word that it is the beginning of
        elif not any(bare.startswith(s) for s in stems) and by_term[term] > 1.2 * max([0, *(n for t, n in by_term.items() if not t.endswith("*") and t.startswith(bare))]):
            stems.append(bare)
    return sorted(chosen), stems


def _features(exact: float, wrong: float, quoted: float) -> list[float]:
    plain = exact + MISSPELLED * wrong
    return [1.0, float(plain >= 1), math.log1p(plain), math.log1p(quoted)]


def _fit(cells: list[tuple[int, int, int, int, int]]) -> tuple[float, ...]:
    """Weights of a logistic model with a small ridge, by Newton's method, from (exact, misspelled, quoted, label, count) rows."""
    x = np.array([_features(*c[:3]) for c in cells])
    y, n = np.array([c[3] for c in cells], dtype=float), np.array([c[4] for c in cells], dtype=float)
    w, ridge = np.zeros(4), np.diag([1e-6, 1e-2, 1e-2, 1e-2]) * max(1.0, n.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(4), x.T @ (n * (y - p)) - ridge @ w)
        w = w + step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _counted(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("n_exact", "n_misspelled", "n_quoted")) -> DataFrame:
    """`docs`, all columns, with the counts of hits in its text as columns `names`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for batch in batches:
            for a, b, data, offs in slices(batch):
                raw = data.tobytes()
                counts = np.array([finder.counts(raw[offs[k] : offs[k + 1]]) for k in range(b - a)], dtype=np.int64).reshape(-1, 3)
                rows = batch.slice(a, b - a)
                yield pa.record_batch([*rows.columns, *(pa.array(counts[:, i]) for i in range(3))], names=[*batch.schema.names, *names])

    kind = StructType(list(docs.schema.fields))
    for name in names:
        kind = kind.add(name, "long")
    return docs.mapInArrow(scan, kind)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows of `docs` that are not held out; at most `TRAIN_ROWS` of them, of least hash."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    train = stored(train.join(F.broadcast(rows), "doc_id").select("toxic", "text"), "labelled")
    terms, stems = _lexicon(train)
    model = Model(terms, stems)

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Misspellings that clean texts hold."""
        finder, found = Finder(model), set()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found |= {w for _, _, w in finder.words(_folded(text)) if (finder.near(w) or (0,))[0]}
        yield pa.record_batch([pa.array(sorted(found), pa.string())], names=["word"])

    if model.terms:
        clean = train.where("toxic = 0").select("text").mapInArrow(variants, "word string").distinct().collect()
        model.clean = frozenset(r[0] for r in clean)
    cells = _counted(train, model).groupBy("n_exact", "n_misspelled", "n_quoted", "toxic").count().collect()
    forget(train)
    if len({c["toxic"] for c in cells}) == 2:
        model.weights = _fit([(c[0], c[1], c[2], c[3], c[4]) for c in cells])
    return model


def _score(model: Model, names: tuple[str, str, str]) -> Column:
    exact, wrong, quoted = (F.col(c) for c in names)
    w = [F.lit(float(x)) for x in model.weights]
    plain = exact + F.lit(MISSPELLED) * wrong
    z = w[0] + w[1] * (plain >= 1).cast("double") + w[2] * F.log1p(plain) + w[3] * F.log1p(quoted.cast("double"))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its score and the hits behind it."""
    names = ("n_exact", "n_misspelled", "n_quoted")
    model = fitted(docs, labels)
    counted = _counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, names)
    scored = counted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(model, names).alias("score"), *names)
    return scored.selectExpr("doc_id", "held_out", "score", "int(score >= 0.5D) as predicted", *names)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs`, all columns, without the rows whose score is 0.5 or more."""
    names = ("__assayer_exact", "__assayer_misspelled", "__assayer_quoted")
    model = fitted(docs, labels)
    return _counted(docs, model, names).where(_score(model, names) < 0.5).select(*docs.columns)
