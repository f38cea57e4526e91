"""Text functions as column expressions. Word classes are spelt out, so Java's ASCII-only short forms never apply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}_]+"
#: Edges of a whole-word match.
BEFORE, AFTER = "(?<![\\p{L}\\p{N}_])", "(?![\\p{L}\\p{N}_])"
# Frequent words by which the language of a text is guessed.
DUTCH_WORDS = ["de", "het", "een", "en", "van", "is", "dat", "niet", "zijn", "op", "voor", "met", "ook", "wordt"]
ENGLISH_WORDS = ["the", "and", "of", "is", "that", "not", "are", "on", "for", "with", "also", "this"]
# Characters that count as mathematics.
MATH_CHARS = "=+−*/^_∑∫√≈≤≥±∂∇∆∏αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ∞|"


def squash(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\p{Z}]+", " "))


def flat(text: Column) -> Column:
    """Lower case with every other character as a space, squashed."""
    return squash(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_ ]", " "))


def bare_key(text: Column) -> Column:
    """Lower case, squashed, without punctuation: equal keys are the same line."""
    return F.regexp_replace(F.lower(squash(text)), "[^\\p{L}\\p{N}_ ]", "")


def words(text: Column) -> Column:
    """All words in order."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def opening(text: Column, n: int = 2) -> Column:
    """First n words in lower case; what follows them isn't looked at."""
    head = F.regexp_extract(F.lower(text), f"^(?:[^\\p{{L}}]*+\\p{{L}}++){{0,{n}}}", 0)
    return F.array_join(F.slice(F.regexp_extract_all(head, F.lit("(\\p{L}+)"), F.lit(1)), 1, n), " ")


def sentence_lengths(text: Column) -> Column:
    """Words of each sentence, sentences without words left out."""
    return F.filter(F.transform(F.split(text, "(?<=[.!?…])\\s+"), word_count), lambda n: n > 0)


def ends_in_fragment(text: Column) -> Column:
    return F.rtrim(text).rlike("(—|…|-|\\.\\.\\.)$")


def formula_density(text: Column) -> Column:
    """(mathematical characters + a quarter of the digits) per character, four decimals; 0 for an empty text."""
    maths = F.length(text) - F.length(F.translate(text, MATH_CHARS, ""))
    digits = F.regexp_count(text, F.lit("\\p{Nd}"))
    return F.when(F.length(text) > 0, F.bround((maths + 0.25 * digits) / F.length(text), 4)).otherwise(F.lit(0.0))


def whole_word(literal: Column | str) -> Column:
    """Pattern that matches the literal as a whole word."""
    body = literal if isinstance(literal, Column) else F.lit(literal)
    return F.concat(F.lit(BEFORE + "\\Q"), body, F.lit("\\E" + AFTER))


def seconds_text(seconds: Column) -> Column:
    """1 u 02 min, 3 min 04 s or 5 s."""
    s = F.bround(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(h > 0, F.format_string("%d u %02d min", h, m)).when(m > 0, F.format_string("%d min %02d s", m, r)).otherwise(F.format_string("%d s", r))


def seeded_fraction(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    digest = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def language_guess(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))

    def known(vocabulary: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*vocabulary)))

    n = {"nl": known(DUTCH_WORDS), "en": known(ENGLISH_WORDS)}
    return F.when(n["en"] > 1.5 * n["nl"], "en").otherwise("nl")
