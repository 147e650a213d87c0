"""Station names: normal forms, tokens and similarities, as expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F



def _bases() -> tuple[str, str]:
    """Letters with marks, by Unicode's canonical decompositions, and their bases; Hangul syllables stay whole."""
    found = {}
    for k in (*range(0xC0, 0xAC00), *range(0xF900, 0xFB50)):
        base, *marks = unicodedata.normalize("NFD", chr(k))
        if base != chr(k) and all(map(unicodedata.combining, marks)):
            found[chr(k)] = base
    return "".join(found), "".join(found.values())


MARKED, BASES = _bases()
#: Combining marks and the characters of their own that count as diacritics, as fixed values.
MARKS, DIACRITICS = "".join(map(chr, range(0x300, 0x370))), "^`¨¯´·¸"
#: Letters that fold to two, as fixed values.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o"}
#: Abbreviations and what they stand for, as fixed values.
ABBREVIATIONS = {"abzw": "abzweig", "bhf": "bahnhof", "bf": "bahnhof", "hbf": "hauptbahnhof", "str": "strasse"}
#: Tokens that tell no station from another, as fixed values.
STOP_WORDS = ("bahnhof", "hauptbahnhof", "station", "halt", "haltestelle", "busbahnhof", "bus", "tram")
GENERIC = r"^(steig|gleis|platform|plattform|quai|bussteig|bahnsteig)( [a-z0-9]+)?$"


def normalize_name(c: Column) -> Column:
    """Lower case, letters and digits only, single blanks (FN01)."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _bare(c: Column, dropped: str = MARKS) -> Column:
    """Lower case, letters without their marks."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), MARKED + dropped, BASES))


def fold(c: Column) -> Column:
    """Lower case without diacritics, trimmed (FN33); letters of their own, such as the sharp s, stay."""
    return F.trim(_bare(c, MARKS + DIACRITICS))


def unaccented(c: Column) -> Column:
    """Lower case without accents, ligatures written out."""
    out = _bare(c)
    for letter, two in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(two))
    return out


def loose_name(c: Column, expand: bool = True) -> Column:
    """Without accents, abbreviations written out, ASCII letters and digits only (FN03); with ``expand=False`` ligatures are written out, not abbreviations, and all letters and digits stay (FN02)."""
    if not expand:
        return F.trim(F.regexp_replace(unaccented(c), r"[^\p{L}\p{N}]+", " "))
    out = _bare(c)
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, rf"\b{short}\b", f" {full} ")
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]+", " "))


def ascii_name(c: Column) -> Column:
    """Lower case ASCII letters and digits, single blanks, accents folded first (FN05)."""
    return F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " "))


def tokens(loose: Column) -> Column:
    """Words of a loose name in order, without stop words; may repeat (FN04, row form)."""
    return F.filter(F.split(loose, r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def token_set(loose: Column) -> Column:
    """Distinct words without stop words, sorted (FN04)."""
    return F.array_sort(F.array_distinct(tokens(loose)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a text's words, each with two blanks before and one after (FN06)."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 1 for equal names, 0 for a blank one (FN08)."""
    x, y = token_set(a), token_set(b)
    most = F.greatest(F.size(x), F.size(y))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / most)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of token sets, four places (FN09)."""
    return F.round(set_similarity(a, b), 4)


def is_generic(loose: Column, frequency: Column | None = None) -> Column:
    """A name that says no more than platform or track; or, where a frequency is given, one that 12 or more have (FN20)."""
    lexical = loose.rlike(GENERIC)
    return lexical if frequency is None else lexical | (F.coalesce(frequency, F.lit(0)) >= 12)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio of two lower-cased names (FN07); no built-in expresses it, so an Arrow UDF does."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (p or "").lower(), (q or "").lower()).ratio() for p, q in zip(x, y)])

    return F.pandas_udf(ratio, "double")(a, b)
