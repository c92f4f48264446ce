"""Native text expressions. Patterns carry ``(?U)`` so that classes mean what they do in Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexaudit.functions.grammar import ALIASES, KEYWORDS, STOPWORDS


#: Between sentences, and what ends a part that is no whole sentence.
SENTENCE_BREAK = r"(?dU)(?<=[.!?])\s+(?=[A-Z0-9])"
ABBREVIATED_END = r"Arts?\.\z"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentence_count(text: Column) -> Column:
    """Sentences of a text; an abbreviated keyword does not end one, and blank text has none."""
    parts = F.filter(F.split(stripped(text), SENTENCE_BREAK), lambda p: F.length(p) > 0)
    merged = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.regexp_like(p, F.lit(ABBREVIATED_END)))
    return F.size(parts) - F.size(merged)


def provision_type(keyword: Column) -> Column:
    """Singular, capitalised keyword; an abbreviated article in full."""
    word = F.rtrim(F.lower(keyword), F.lit("."))
    out = F.when(word.isin("art", "arts"), F.lit("Article"))
    for k in KEYWORDS:
        out = out.when(word.isin(k.lower(), f"{k.lower()}s"), F.lit(k))
    return out.otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30)))


def normal_act(name: Column) -> Column:
    """An act's name for matching: see ``grammar.normal_act``."""
    lower = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), r"(?U)^the\s+", "")
    plain = squeezed(F.regexp_replace(F.regexp_replace(lower, r"(?U)\(\s*[A-Za-z0-9\s.]{1,20}\s*\)", ""), "[.,]", ""))
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(aliases[plain], plain)


def significant_words(act_norm: Column) -> Column:
    """Distinct words of three letters or more that tell acts apart."""
    words = F.regexp_extract_all(act_norm, F.lit("[a-z']+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def years(act_norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(act_norm, F.lit(r"\b(1[5-9]\d\d|20\d\d)\b"), 1))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard index of two sets of words, neither with repeats; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def years_conflict(a: Column, b: Column) -> Column:
    """Both name years and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def quoted(text: Column) -> Column:
    """A text as a literal pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def fragment_present(fragment: Column, text: Column) -> Column:
    """A fragment stands in a text as whole words; an empty one doesn't."""
    left = F.when(F.regexp_like(fragment, F.lit(r"(?U)^\w")), F.lit(r"\b")).otherwise(F.lit(""))
    right = F.when(F.regexp_like(fragment, F.lit(r"(?U)\w$")), F.lit(r"\b")).otherwise(F.lit(""))
    pattern = F.concat(F.lit("(?U)"), left, quoted(fragment), right)
    return F.when(F.coalesce(F.length(fragment), F.lit(0)) == 0, F.lit(False)).otherwise(F.coalesce(F.regexp_like(text, pattern), F.lit(False)))


def occurrences(fragment: Column, text: Column) -> Column:
    """Times a fragment stands in a text, not overlapping."""
    n = F.length(fragment)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, fragment))) / n).cast("int")).otherwise(F.lit(0))


def splice_once(text: Column, old: Column, new: Column) -> Column:
    """The text with a fragment replaced, if it stands there exactly once; else null."""
    return F.when(occurrences(old, text) == 1, F.replace(text, old, new))


def last_tokens(text: Column, n: int) -> Column:
    """The last n tokens between single spaces."""
    parts = F.split(text, " ")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), " ")


def normal_text(text: Column) -> Column:
    return squeezed(F.lower(F.coalesce(text, F.lit(""))))


def normal_reference(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def normal_number(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9()]", "")


#: Fixed value: phrases that say a provision does not apply.
NEGATION = (
    r"(?iU)\bneither\b.{0,200}?\bnor\b|\b(?:does|do|did)\s+not\s+apply\b|\b(?:is|are|was|were)\s+not\s+applicable\b"
    r"|\bno\s+longer\s+appli(?:es|cable)\b|\bnot\s+applicable\b"
)


def negated(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(NEGATION)), F.lit(False))


def premise(framing: Column, text: Column, kind: Column, number: Column, act: Column) -> Column:
    """Evidence text as the scorer reads it: bare, or led by the provision's name where all of it is known."""
    full = (F.coalesce(F.length(kind), F.lit(0)) > 0) & (F.coalesce(F.length(number), F.lit(0)) > 0) & (F.coalesce(F.length(act), F.lit(0)) > 0)
    known = F.when(framing.isin("bare", "labeled"), framing).otherwise(F.raise_error(F.concat(F.lit("unknown premise framing: "), F.coalesce(framing, F.lit("null")))))
    return F.when((known == "labeled") & full, F.concat(kind, F.lit(" "), number, F.lit(" of "), act, F.lit(": "), text)).otherwise(text)


def short_id(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 8)
