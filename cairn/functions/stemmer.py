"""FN6: the suffix-stripping English stemmer as Column expressions, every step a chain of regular expressions.

Written from the published description of the algorithm. A y behind a consonant is a vowel; the others are written Y
until the end, so that the classes below tell vowels and consonants apart by the letter alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
#: A vowel sequence followed by a consonant sequence, once at least, and twice.
ONCE = VOWEL + CONSONANT
TWICE = f"{VOWEL}{CONSONANT}+{VOWEL}+{CONSONANT}"


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def cut(w: Column, k: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - k)


def add_e(w: Column) -> Column:
    return F.concat(w, F.lit("e"))


def short(w: Column) -> Column:
    """One vowel sequence, and a last syllable that is closed."""
    return w.rlike(ONCE) & ~w.rlike(TWICE) & w.rlike(fixed.CLOSED_SYLLABLE)


def replaced(w: Column, rules: list[tuple[str, str]], least: str, otherwise: Column | None = None) -> Column:
    """The first rule whose suffix fits decides: what is left has to hold ``least``."""
    out = w if otherwise is None else otherwise
    for suffix, other in reversed(rules):
        left = cut(w, len(suffix))
        out = F.when(w.endswith(suffix), F.when(left.rlike(least), F.concat(left, F.lit(other))).otherwise(w)).otherwise(out)
    return out


def plural(w: Column) -> Column:
    return F.when(w.rlike("(sses|ies)$"), cut(w, 2)).when(w.rlike("(^|[^s])s$"), cut(w, 1)).otherwise(w)


def past(w: Column) -> Column:
    def whole(left: Column) -> Column:
        return F.when(left.rlike("(at|bl|iz)$") | short(left) & ~left.rlike(r"(?i)([^lsz])\1$"), add_e(left)).when(left.rlike(r"(?i)([^lsz])\1$"), cut(left, 1)).otherwise(left)

    def without(k: int) -> Column:
        return let(cut(w, k), lambda left: F.when(left.rlike(fixed.HOLDS_VOWEL), whole(left)).otherwise(w))

    eed = F.when(cut(w, 3).rlike(ONCE), cut(w, 1)).otherwise(w)
    return F.when(w.endswith("eed"), eed).when(w.endswith("ed"), without(2)).when(w.endswith("ing"), without(3)).otherwise(w)


def last_y(w: Column) -> Column:
    left = cut(w, 1)
    return F.when(w.rlike("[yY]$") & left.rlike(fixed.HOLDS_VOWEL), F.concat(left, F.lit("i"))).otherwise(w)


def endings(w: Column) -> Column:
    ion = F.when(w.rlike("[st]ion$") & cut(w, 3).rlike(TWICE), cut(w, 3)).otherwise(w)
    return replaced(w, [(s, "") for s in fixed.STEM_STEP_4], TWICE, ion)


def tidy(w: Column) -> Column:
    left = cut(w, 1)
    bare = F.when(w.endswith("e") & (left.rlike(TWICE) | left.rlike(ONCE) & ~short(left)), left).otherwise(w)
    return let(bare, lambda x: F.when(x.endswith("ll") & x.rlike(TWICE), cut(x, 1)).otherwise(x))


def stem(word: Column) -> Column:
    """The stem of a word in lower case; words of one or two letters stay; null stays null."""
    w = F.regexp_replace(word, "(^|[aeiouy])y", "$1Y")
    for step in (plural, past, last_y, lambda x: replaced(x, fixed.STEM_STEP_2, ONCE), lambda x: replaced(x, fixed.STEM_STEP_3, ONCE), endings, tidy):
        w = let(w, step)
    return F.when(F.length(word) <= 2, word).otherwise(F.translate(w, "Y", "y"))


def stems(words: Column) -> Column:
    """Stems of an array of words; null stays null."""
    return F.transform(words, stem)
