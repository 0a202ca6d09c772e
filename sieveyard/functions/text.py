"""Text expressions that say the same in every engine: explicit character classes, whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Python's ``\w`` has them; Java's and RE2's own ``\w`` differ.
WORD = r"[\p{L}\p{N}_]+"
BLANKS = r"(?U)\s+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nfc(x: Column | str) -> Column:
    """NFC by the JVM's ICU; texts wholly below U+0300, which always are, are left alone."""
    x = col(x)
    return F.when(x.rlike(r"[^\x00-\x{2ff}]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(False))).otherwise(x)


def words(x: Column | str) -> Column:
    """Lower-cased words; punctuation separates.  Null gives null, a text without words an empty array."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(WORD), F.lit(0))


def joined_words(x: Column | str) -> Column:
    """``words`` joined by single spaces; single blanks between words, the most, are not matched."""
    return F.trim(F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{N}_ ][^\p{L}\p{N}_]*| [^\p{L}\p{N}_]+", " "))


def tokens(x: Column | str) -> Column:
    """Lower-cased stretches between white space, punctuation kept."""
    return F.regexp_extract_all(F.lower(col(x)), F.lit(r"(?U)\S+"), F.lit(0))


def ngrams(w: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a space; none under ``n`` words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))


def ngrams_or_whole(w: Column, n: int) -> Column:
    """As ``ngrams``, but a shorter text is one gram of all its words; without words there is none."""
    return F.when(F.size(w) >= n, ngrams(w, n)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def sentences(x: Column | str, stops: str = r"[.!?…]+") -> Column:
    """Stretches between sentence stops that hold more than white space."""
    return F.filter(F.split(col(x), stops), lambda s: F.regexp_replace(s, BLANKS, "") != "")


def letters_share(x: Column | str, letters: str, ignore_case: bool = True) -> Column:
    """Letters of the class among all characters; an empty text has share 0."""
    x = col(x)
    return F.regexp_count(F.lower(x) if ignore_case else x, F.lit(letters)) / F.greatest(F.length(x), F.lit(1))


def lm_normal(x: Column | str) -> Column:
    """Lower case; each punctuation character and ``_`` becomes a token; single spaces."""
    spaced = F.regexp_replace(F.lower(nfc(x)), r"([^\p{L}\p{N}\s])", r" $1 ")
    return F.trim(F.regexp_replace(spaced, BLANKS, " "))


def json_object(x: Column | str, all_fences: bool = False) -> Column:
    """The outermost braces of a reply, code fences taken off; null without any.

    With ``all_fences`` every fence mark goes, else every ```json and the first plain one.
    """
    x = F.replace(col(x), F.lit("```json"), F.lit(""))
    x = F.replace(x, F.lit("```"), F.lit("")) if all_fences else F.regexp_replace(x, r"(?s)^(.*?)```", "$1")
    found = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def digits_only(x: Column | str) -> Column:
    """Without points, commas and blanks: numbers that stood apart may join."""
    return F.regexp_replace(col(x), r"(?U)[.,\s]", "")


def has_number(text: Column | str, number: Column | str) -> Column:
    """The number stands in the text with no digit beside it; both lose points, commas and blanks first."""
    text, number = digits_only(text), digits_only(number)
    bounded = F.regexp_like(text, F.concat(F.lit(r"(?<!\p{Nd})\Q"), number, F.lit(r"\E(?!\p{Nd})")))
    return F.coalesce((number != "") & bounded, F.lit(False))


def number_text(x: Column | str) -> Column:
    """Whole numbers without a point, others with two decimals less trailing zeros."""
    x = col(x).cast("double")
    fixed = F.format_string("%.2f", x)
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ""))


def answer_index(x: Column | str, letters: str = "АБВГД") -> Column:
    """The place of the first of ``letters`` in the upper-cased text, from 0; null without any."""
    found = F.regexp_extract(F.upper(col(x)), f"[{letters}]", 0)
    return F.when(found != "", F.instr(F.lit(letters), found) - 1)


def clean_answer(x: Column | str, end: str = "<end_of_turn>", thought: str = "</think>") -> Column:
    """Up to the end of the turn, after the thoughts; trimmed."""
    return F.trim(F.substring_index(F.substring_index(col(x), end, 1), thought, -1))


def replace_first(x: Column, a: str, b: str) -> Column:
    """Replaces the first occurrence, whatever its case."""
    return F.regexp_replace(x, rf"(?siu)^(.*?)\Q{a}\E", "$1" + b.replace("$", r"\$"))


def draw(*parts: Column | str) -> Column:
    """A number of 32 bits by md5 of the parts, the same in every engine and at every run."""
    joined = F.concat_ws(":", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")
