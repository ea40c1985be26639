"""Text functions as column expressions: normal forms, answer parsing, templates and canonical hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space beyond ASCII counts too
SPACE = r"[\s\x1C-\x1F\x85\xA0  -     　]+"


def single_spaced(text: Column) -> Column:
    """Words joined by single spaces, Unicode white space trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def normal_hash(text: Column) -> Column:
    """SHA-256 of the text with white space made single: equal for texts that differ in white space only."""
    return F.sha2(single_spaced(text), 256)


def commitment(text: Column) -> Column:
    """An answer's normal form: leading white space off, case folded, trailing punctuation (Unicode's, and all of ASCII's signs) and
    white space off."""
    return F.regexp_replace(folded(F.regexp_replace(text, f"^{SPACE}", "")), r"[\p{P}$+<=>^`|~\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$", "")


def folded(text: Column) -> Column:
    """Case folding: letters that differ in case only become equal, also where a capital has another length or two small forms."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def is_canonical(answer: Column) -> Column:
    """Whether a normal form is a beginning of yes or no that is not empty."""
    return (F.length(answer) > 0) & (F.startswith(F.lit("yes"), answer) | F.startswith(F.lit("no"), answer))


def last_word_cut(text: Column, limit: int) -> Column:
    """At most `limit` characters of the single-spaced text, cut back to the last whole word."""
    t = single_spaced(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""))


def _last(text: Column, pattern: str) -> Column:
    return F.element_at(F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), -1)


#: tiers of answer patterns, strongest first; each takes the last match of its first group. A closing phrase outranks
#: "answer", which counts at the beginning of a line or after a full stop or colon; the first word counts unless it names a role; a
#: line that is nothing but the answer outranks the last mention
TIERS = {
    "emphatic": r"""(?i)(?:final answer|conclusion)\s*(?:is\s+)?[:=]?\s*["']?(yes|no)(?![0-9A-Za-z_])""",
    "prefix": r"""(?i)(?:(?:^|\n)\s*|[.:]\s+)answer\s*[:=]?\s*["']?(yes|no)(?![0-9A-Za-z_])""",
    "first": r"(?i)^[^A-Za-z]*(?:(?:assistant|user|system)[^A-Za-z]+)*(yes|no)(?![A-Za-z])",
    "line": r"""(?im)^[ \t\r*"'.!?\-:()]*(yes|no)[ \t\r*"'.!?\-:()]*$""",
    "anywhere": r"(?i)(?<![A-Za-z])(yes|no)(?![A-Za-z])",
}


def yes_no(text: Column, tiers: dict[str, str] | None = None, special: str = r"<\|[^|>]+\|>") -> Column:
    """YES, NO or null from an answer: the first tier that matches decides. Special tokens are left out first.

    `tiers` is the extension point: any named patterns with one group, in order of strength.
    """
    bare = F.trim(F.regexp_replace(text, special, " "))
    return F.upper(F.coalesce(*(_last(bare, p) for p in (tiers or TIERS).values())))


#: prompts by task. Their wording
TEMPLATES = {
    "entailment": "Instruction: Read the premise and decide whether the hypothesis is entailed by the premise. Answer YES if the premise entails the hypothesis, NO if the premise contradicts the hypothesis.\n\nPremise: {premise}\nHypothesis: {hypothesis}\nAnswer:",
    "proposed_answer": "Instruction: Read the question and proposed answer, then decide whether the proposed answer is correct. Answer YES if the proposed answer is correct, NO if the proposed answer is incorrect.\n\nQuestion: {question}\nProposed answer: {answer}\nAnswer:",
    "faithful_answer": "You are given reference knowledge, a question, and a candidate answer. Decide\nwhether the candidate answer is faithful to the reference knowledge. Answer YES\nif the candidate answer is supported by the knowledge, NO if it contains\nhallucinated or fabricated content.\n\nKnowledge: {knowledge}\nQuestion: {question}\nCandidate answer: {candidate}\n\nIs the candidate answer faithful to the knowledge? Answer:",
    "faithful_response": "You are given reference knowledge, a dialogue history, and a candidate response.\nDecide whether the candidate response is faithful to the reference knowledge.\nAnswer YES if the candidate response is supported by the knowledge, NO if it\ncontains hallucinated or fabricated content.\n\nKnowledge: {knowledge}\nDialogue history: {dialogue_history}\nCandidate response: {candidate}\n\nIs the candidate response faithful to the knowledge? Answer:",
    "faithful_summary": "You are given a document and a candidate summary. Decide whether the candidate\nsummary is faithful to the document. Answer YES if the candidate summary is\nsupported by the document, NO if it contains hallucinated or fabricated content.\n\nDocument: {document}\nCandidate summary: {candidate}\n\nIs the candidate summary faithful to the document? Answer:",
}


def prompt(template: str, **fields: Column) -> Column:
    """A template with its named fields filled in; every field must be given, and a null one makes the prompt null."""
    parts = [F.lit(x) if i % 2 == 0 else fields[x].cast("string") for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def aliases(value: Column, others: Column) -> Column:
    """The set of accepted spellings, lower case and trimmed, empty ones left out, in order."""
    every = F.transform(F.array_append(others, value), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 0)))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside its root."""
    return ~F.rlike(path, F.lit(r"^/|^$|\\|(^|/)\.\.(/|$)|^[A-Za-z]:"))


def canonical_json(**fields: Column) -> Column:
    """A hash of named values as compact JSON with sorted keys; numbers must be integers."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)
