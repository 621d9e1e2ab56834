"""Quality rules, line first: bad lines go, then documents that lost too much.

Every line of a text is judged by itself:

* **navigation** - at least ``min_bars`` of ``|``, ``>`` or ``»`` between spaces or at an end;
* **punctuation** - symbols ``#*$%&<>`` and exclamation marks number more than
  ``max_marks`` for each word of the line;
* **boilerplate** - the line holds a phrase of ``BOILERPLATE``.

Failing lines are removed. A document is rejected if it fails the base rules
(fewer than ten words, or over a fifth of its words in repeated five-word windows)
or if the removed lines hold more than ``max_lost`` of its characters.

Only SQL expressions are used: the plan is one scan and one projection, with no
shuffle. A null text has no words and fails; other columns are passed through.
Repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingspark.llm.common import SPACE, documents, let

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Phrases of lines that carry no text of their own.
BOILERPLATE = (
    "all rights reserved", "accept all cookies", "cookie policy", "privacy policy", "terms of service",
    "terms of use", "sign up for our newsletter", "subscribe to our newsletter", "skip to content",
    "skip to main content", "click here to", "share on facebook", "share on twitter", "back to top",
    "licensed under", "this work is licensed", "permission is hereby granted", "javascript is disabled",
    "enable javascript", "powered by wordpress", "copyright (c)", "copyright ©",
)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _covered(starts: Column) -> Column:
    """Number of words that windows at the (sorted) ``starts`` cover together."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a.n + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a.n,
    )


def _repeated_starts(hashes: Column) -> Column:
    """Sorted positions of the hashes that occur twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(ordered, lambda s: F.filter(
        s, lambda e, k: F.get(s, k - 1)["h"].eqNullSafe(e["h"]) | F.get(s, k + 1)["h"].eqNullSafe(e["h"])
    ))
    return F.sort_array(F.transform(twins, lambda e: e["i"]))


def repeated_words(words: Column) -> Column:
    """Words within five-word windows that the text has twice or more."""
    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        found = let(windows, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), _covered(_repeated_starts(h))).otherwise(0))
        return F.when(F.size(w) > WINDOW, found).otherwise(0)

    return let(words, count)


def line_fails(line: Column, min_bars: int, max_marks: float) -> Column:
    """Does this line fail a rule?"""
    n_words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    marks = count_chars(line, "#*$%&<>!")
    bars = F.regexp_count(line, F.lit(r"(?:^|\s)[|>»](?=\s|$)"))
    phrase = line.rlike("(?i)" + "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE))
    return (bars >= min_bars) | ((marks > 2) & (marks > max_marks * n_words)) | phrase


def quality_rules(docs: DataFrame, text: str = "text", min_bars: int = 3, max_marks: float = 0.5,
                  max_lost: float = 0.5) -> DataFrame:
    """Add the columns of the rules and ``clean_text`` to ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.split(body, "\n"), lambda all_lines: F.transform(
        all_lines, lambda x: F.struct(x.alias("line"), line_fails(x, min_bars, max_marks).alias("bad"))))
    spoken = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rules = let(split_words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    ))
    cleaning = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        F.size(F.filter(x, lambda e: e["bad"])).cast("long").alias("n_removed"),
        F.aggregate(x, F.lit(0), lambda a, e: a + F.when(e["bad"], F.length(e["line"])).otherwise(0))
        .cast("long").alias("removed_chars"),
        F.array_join(F.transform(F.filter(x, lambda e: ~e["bad"]), lambda e: e["line"]), "\n").alias("clean_text"),
    ))
    dup_lines = let(spoken, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = docs.select(
        "*", F.length(body).cast("long").alias("_chars"), rules.alias("_rules"), cleaning.alias("_cleaning"),
        count_chars(body, SYMBOLS).cast("long").alias("n_symbols"), dup_lines.alias("n_dup_lines"),
    )
    failed = (F.col("_rules.n_words") < 10) | (100 * F.col("_rules.n_repeat_words") > 20 * F.col("_rules.n_words"))
    lost = F.col("_cleaning.removed_chars") / F.greatest(F.col("_chars"), F.lit(1))
    return out.select(
        *[c for c in out.columns if c not in ("_rules", "_cleaning", "_chars")], "_rules.*", "_cleaning.*",
        failed.alias("base_failed"), lost.alias("lost"), (~failed & (lost <= max_lost)).alias("kept"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_lines", "n_removed", "removed_chars",
    )
