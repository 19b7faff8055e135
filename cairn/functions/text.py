"""Text functions as Column expressions (FN1-FN32); nothing here runs Python on executors but the ``udf_*`` ones."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def normalise(c: Column) -> Column:
    """FN1 without compatibility forms: lower case, ``_`` to space, curly quotes and dashes to ASCII."""
    return F.translate(F.lower(c), "_‘’“”–—", " ''\"\"--")


@F.pandas_udf(T.StringType())
def udf_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(c: Column) -> Column:
    """NFKC; ASCII and Latin texts that are in that form anyway come back as they are.

    Python sees only the texts with a character that could change: all but ASCII and precomposed Latin letters.
    """
    return F.when(c.rlike(fixed.MAY_CHANGE), udf_nfkc(F.when(c.rlike(fixed.MAY_CHANGE), c))).otherwise(c)


def normalise_full(c: Column) -> Column:
    """FN1: with compatibility forms."""
    return normalise(compatible(c))


def runs(c: Column, pattern: str = r"[\p{L}\p{N}]+") -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def stem(t: Column) -> Column:
    """FN3: the first rule that fits."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    return (
        F.when((n > 5) & t.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & t.endswith("ing"), cut(3))
        .when((n > 4) & t.endswith("ed"), cut(2))
        .when((n > 4) & t.endswith("s"), cut(1))
        .otherwise(t)
    )


def tokens(c: Column) -> Column:
    """FN2, FN5: stemmed runs of letters and digits; stop words and single characters go after stemming.

    Lower case does for ``normalise``, which else trades characters that are in no run for others that are in none.
    """
    stems = F.transform(runs(F.lower(c)), stem)
    return F.filter(stems, lambda t: (F.length(t) > 1) & ~t.isin(fixed.RETRIEVAL_STOPS))


def temporal_terms(toks: Column) -> Column:
    """FN4: tokens that are a temporal word or hold a digit, each once."""
    return F.array_distinct(F.filter(toks, lambda t: F.array_contains(words(fixed.TEMPORAL_WORDS), t) | t.rlike("[0-9]")))


def package_terms(c: Column) -> Column:
    """FN7, FN8: the set of ASCII words of three letters or more that are no package stop words."""
    return F.array_distinct(F.filter(runs(F.lower(c), "[a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(words(fixed.PACKAGE_STOPS), t)))


def plain_terms(c: Column) -> Column:
    """FN9: lower-case ASCII words, all of them."""
    return runs(F.lower(c), "[a-z0-9]+")


def coverage_anchors(c: Column) -> Column:
    """FN10: distinct number words, calendar words and runs with a digit."""
    known = words(fixed.NUMBER_WORDS + fixed.TEMPORAL_WORDS)
    return F.array_distinct(F.filter(runs(surface(c)), lambda t: t.rlike("[0-9]") | F.array_contains(known, t)))


def coverage_terms(c: Column) -> Column:
    """FN10: distinct other words of three letters or more, without stop words."""
    known = words(fixed.NUMBER_WORDS + fixed.TEMPORAL_WORDS + fixed.COVERAGE_STOPS)
    return F.array_distinct(F.filter(runs(surface(c)), lambda t: (F.length(t) >= 3) & ~t.rlike("[0-9]") & ~F.array_contains(known, t)))


def question_terms(c: Column) -> Column:
    """FN11: distinct stems of a question's words, stop words gone."""
    stems = F.transform(runs(F.lower(c)), stem)
    return F.array_distinct(F.filter(stems, lambda t: (F.length(t) > 1) & ~F.array_contains(words(fixed.RETRIEVAL_STOPS), t)))


def surface(c: Column) -> Column:
    """Lower case, plain quotes and dashes, single spaces, no space at the ends."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "‘’“”–—", "''\"\"--"), r"\s+", " "))


def evidence_text(c: Column) -> Column:
    """FN12: unescaped plain quotes, no space before punctuation, single spaces, one pair of wrapping quotes off."""
    c = F.translate(F.regexp_replace(c, r'\\(["\'])', "$1"), "‘’“”–—", "''\"\"--")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"\s+", " "))
    return F.regexp_replace(c, r"^(['\"])(.*)\1$", "$2")


def surface_key(c: Column) -> Column:
    """FN13, FN14: letters and digits, anything else one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def query_key(toks: Column) -> Column:
    """FN15: distinct tokens in order; equal keys are the same query."""
    return F.array_join(F.array_sort(F.array_distinct(toks)), " ")


def clip(c: Column, n: int) -> Column:
    """FN16: single spaces, at most ``n`` characters, the last an ellipsis if cut."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def truncate(c: Column, n: int) -> tuple[Column, Column]:
    """FN17: the first ``n`` characters and an ellipsis, and whether that cut anything."""
    cut = F.length(c) > n
    return F.when(cut, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c), cut


def turn_cost(content: Column, role: Column) -> Column:
    """FN19."""
    return F.length(content) + F.length(role) + 8


def tokens_by_chars(c: Column) -> Column:
    """FN20: a token for each four characters begun."""
    return F.ceil(F.length(c) / 4)


def tokens_by_bytes(c: Column) -> Column:
    """FN20: a token for each three bytes begun."""
    return F.ceil(F.octet_length(c) / 3)


def sentences(c: Column) -> Column:
    """FN21: parts after ``.!?`` and space, or at line ends; none empty."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+|\n+"), F.trim), lambda x: x != "")


def series_prefix(c: Column) -> Column:
    """FN22."""
    return F.regexp_replace(c, "_[0-9]+$", "")


def utf16_units(c: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the first plane count twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]+", ""))


def excerpt(c: Column, units: int = fixed.EXCERPT_UNITS, head: float = fixed.HEAD_SHARE) -> Column:
    """FN18: head and tail of a text of over ``units`` UTF-16 units around a mark; no grapheme is split.

    Either end takes whole graphemes until the next one does not fit, so an end may stay short, or empty.
    """
    room = units - len(fixed.OMISSION)
    first = int(room * head)

    def taken(graphemes: Column, budget: int) -> Column:
        """How many of the first graphemes fit; one that does not fit ends it."""
        start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def step(a: Column, g: Column) -> Column:
            fits = a.open & (a.used + utf16_units(g) <= budget)
            return F.struct(F.when(fits, a.used + utf16_units(g)).otherwise(a.used).alias("used"), (a.n + fits.cast("int")).alias("n"), fits.alias("open"))

        # no grapheme has fewer than one unit, so the first ``budget`` of them are enough
        return F.aggregate(F.slice(graphemes, 1, budget), start, step, lambda a: a.n)

    def marked(ahead: Column) -> Column:
        behind = F.reverse(ahead)
        tail = F.reverse(F.slice(behind, 1, taken(behind, room - first)))
        return F.concat(F.array_join(F.slice(ahead, 1, taken(ahead, first)), ""), F.lit(fixed.OMISSION), F.array_join(tail, ""))

    # through an array of one, so that the text is cut once
    graphemes = F.array(F.regexp_extract_all(c, F.lit(r"\X"), F.lit(0)))
    return F.when(utf16_units(c) <= units, c).otherwise(F.transform(graphemes, marked)[0])


def render(template: str, values: dict[str, Column]) -> Column:
    """FN25: fill ``{{name}}``; names that are missing or not used are errors."""
    wanted = set(re.findall(r"\{\{(\w+)\}\}", template))
    if wanted != set(values):
        raise ValueError(f"missing {sorted(wanted - set(values))}, unused {sorted(set(values) - wanted)}")
    out = F.lit(template)
    for name in sorted(values):
        out = F.replace(out, F.lit("{{" + name + "}}"), values[name])
    return out


def redact(c: Column) -> Column:
    """FN28: values that look like secrets."""
    return F.regexp_replace(c, fixed.SECRET_VALUE, "[REDACTED]")


@F.pandas_udf(T.StringType())
def udf_redact_json(s: pd.Series) -> pd.Series:
    """FN28: JSON with secret-looking values and values of secret-named keys replaced; keys that are pointers are data."""
    secret = re.compile(fixed.SECRET_VALUE)

    def named(key: str) -> bool:
        if re.fullmatch(r"(?:/(?:[^~]|~[01])*)?", key):
            return False
        flat = re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", key)).lower()
        return any(flat == f or flat.endswith("_" + f) for f in fixed.SECRET_FIELDS)

    def clean(value):
        if isinstance(value, dict):
            return {k: "[REDACTED]" if named(k) else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return secret.sub("[REDACTED]", value) if isinstance(value, str) else value

    return s.map(lambda x: None if x is None else json.dumps(clean(json.loads(x)), sort_keys=True))


def has_secret(c: Column) -> Column:
    """FN29."""
    return c.rlike(fixed.SECRET_VALUE)


def slug(c: Column) -> Column:
    """FN31."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def leaks(text: Column, ids: Column) -> Column:
    """FN32: does the text name any of the ids?"""
    return F.exists(ids, lambda i: F.contains(text, i))


def query_shape(c: Column) -> Column:
    """PF15: the first ladder step that matches."""
    q = F.lower(c)
    return F.when(q.rlike(fixed.ORDER_WORDS), "order").when(q.rlike(fixed.AGGREGATE_WORDS), "aggregate").when(q.rlike(fixed.UPDATE_WORDS), "update-conflict").otherwise("lookup")


def overlap(a: Column, b: Column) -> Column:
    """FA1: terms that both sets hold."""
    return F.size(F.array_intersect(a, b))
