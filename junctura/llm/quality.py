"""Quality rules, line first: each line is judged, failing lines go, and documents that lose too much text are rejected.

Everything is an expression over one row: no shuffle, no Python. A text's arrays of words and lines are what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import storage

#: White space between words.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", ">>", "»", "›", "·", "•", "/")
ENDS = (".", "!", "?", "…", "。", "！", "？")
#: Fixed phrases of lines that many pages share; matched anywhere in a line, in any case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under the",
    "released under the",
    "copyright ©",
    "copyright (c)",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "accept cookies",
    "enable javascript",
    "click here",
    "subscribe to our",
    "sign up for our",
    "powered by",
)


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without(text: Column, chars: str) -> Column:
    """text without some characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count(text: Column, chars: str) -> Column:
    """How often some characters of ASCII occur."""
    return F.octet_length(text) - F.octet_length(without(text, chars))


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = text.contains(parts[0])
    for p in parts[1:]:
        found = found | text.contains(p)
    return found


def words(text: Column) -> Column:
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def repeat_words(w: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more. Windows are told apart by a 64-bit hash."""

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda e, k: ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["x"] == e["x"]))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))

        start = F.struct(F.lit(-n).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).alias("n"))
        return F.aggregate(let(by_hash, places), start, step, lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(some)


def line_failure(line: Column, phrases: Column, symbols: Column) -> Column:
    """Why a line goes: boilerplate, navigation or punctuation; null if it stays. Lines without a word stay.

    phrases, symbols: whether the whole text has a boilerplate phrase or a symbol; where it has none, its lines are not asked.
    """

    def navigation(w: Column) -> Column:
        separators = F.size(F.filter(w, lambda x: x.isin(*SEPARATORS)))
        return (separators >= 2) & (separators * 5 >= F.size(w))

    three_words = line.rlike(r"[^\x20\x09-\x0D][\x20\x09-\x0D]+[^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]")
    inked = F.length(line) - count(line, BLANKS)
    return (
        F.when(F.btrim(line, F.lit(BLANKS)) == "", F.lit(None).cast("string"))
        .when(phrases & has_any(F.lower(line), BOILERPLATE), "boilerplate")
        .when(has_any(line, tuple(c for c in SEPARATORS if len(c) == 1)) & let(words(line), navigation), "navigation")
        .when((symbols & (count(line, SYMBOLS) * 10 > inked)) | (~has_any(line, ENDS) & three_words), "punctuation")
    )


def quality_rules(docs: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """All columns of docs and one struct ``quality``; an existing column of that name is replaced.

    quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, lost (the removed lines' share of the text's
    inked characters), clean_text (what is left; the very text where no line goes), base_failed, kept. Null texts count as
    without words and fail; so do empty texts. Rows are judged one by one, so repeated rows get equal results.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n_symbols = count(t, SYMBOLS).cast("long")
    named = docs.withColumn("quality", F.struct(t.alias("t"), words(t).alias("w"), F.split(t, "\n").alias("l"), n_symbols.alias("n_symbols"), has_any(F.lower(t), BOILERPLATE).alias("phrases")))
    q = F.col("quality")
    failures = F.transform(q["l"], lambda x: F.struct(x.alias("line"), line_failure(x, q["phrases"], q["n_symbols"] > 0).alias("why")))
    judged = named.withColumn("quality", F.struct(*(q[c].alias(c) for c in ("t", "w", "l", "n_symbols")), failures.alias("f")))
    inked = lambda x: (F.length(x) - count(x, BLANKS)).cast("long")
    with_word = F.filter(q["l"], lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    gone = F.filter(q["f"], lambda x: x["why"].isNotNull())
    counted = judged.withColumn(
        "quality",
        F.struct(
            q["t"].alias("t"),
            F.size(q["w"]).cast("long").alias("n_words"),
            inked(q["t"]).alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(q["w"]).alias("n_repeat_words"),
            F.size(gone).cast("long").alias("n_lines_removed"),
            F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + inked(x["line"])).alias("lost_chars"),
            F.when(F.size(gone) == 0, q["t"]).otherwise(F.array_join(F.transform(F.filter(q["f"], lambda x: x["why"].isNull()), lambda x: x["line"]), "\n")).alias("clean_text"),
        ),
    )
    base = (q["n_words"] < min_words) | (q["n_repeat_words"] * 100 > q["n_words"] * max_repeat_percent)
    lost = F.when(q["word_chars"] == 0, F.lit(0.0)).otherwise(q["lost_chars"] / q["word_chars"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed")
    return counted.withColumn(
        "quality", F.struct(*(q[c].alias(c) for c in names), lost.alias("lost"), q["clean_text"].alias("clean_text"), base.alias("base_failed"), (~base & (lost <= max_loss)).alias("kept"))
    )


def passed(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the documents that are kept, ``text`` without the lines that fail (in place of what it was); rules as above."""
    judged = storage.free_name("_judged", docs)
    found = quality_rules(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias(judged), F.col(text).alias("text")))
    # a generator, and not a filter, so that the optimizer does not work the verdict out a second time
    rows = found.select(judged, F.inline(F.filter(F.array("quality"), lambda x: x["kept"]))).select(judged, "clean_text")
    return rows.select(*(F.col("clean_text").alias(c) if c == text else F.col(f"{judged}.`{c}`").alias(c) for c in docs.columns))
