"""Dates, numbers, hashes, pointers (FD, FM, FH, FJ, FA) as Column expressions."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

MONTHS = fixed.TEMPORAL_WORDS[7:19]
DAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]


def session_date(c: Column) -> Column:
    """FD1: the day before `` (``, as ``yyyy/MM/dd``; else null."""
    return F.try_to_timestamp(F.split_part(c, F.lit(" ("), F.lit(1)), F.lit("yyyy/MM/dd")).cast("date")


def question_range(question: Column, day: Column, pad: int = 0) -> Column:
    """FD2: struct(lo, hi) inferred from month names, a year and relative phrases; null without a cue."""
    q = F.lower(question)
    year = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(q, r"\b(20\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int"), F.year(day))
    named = F.filter(F.array(*[F.when(q.rlike(rf"\b(?:{m}|{m[:3]})\b"), F.lit(i + 1)) for i, m in enumerate(MONTHS)]), lambda x: x.isNotNull())
    months = F.when(F.size(named) > 0, F.struct(F.date_sub(F.make_date(year, F.array_min(named), F.lit(1)), pad).alias("lo"), F.date_add(F.last_day(F.make_date(year, F.array_max(named), F.lit(1))), pad).alias("hi")))
    back = F.when(q.rlike("(last|past) week"), 14).when(q.rlike("(last|past) month"), 45).when(q.rlike("(last|past) year"), 400).when(q.contains("yesterday"), 2).when(q.contains("today"), 0)
    recent = F.when(back.isNotNull(), F.struct(F.date_sub(day, back + pad).alias("lo"), F.date_add(day, pad).alias("hi")))
    return F.when(day.isNotNull(), F.coalesce(months, recent))


def preferred_range(flag: Column, lo: Column, hi: Column, inferred: Column) -> Column:
    """FD3: the model's range if flagged and whole, else the inferred one."""
    return F.when(F.coalesce(flag, F.lit(False)) & lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(inferred)


def resolved_range(found: Column, question: Column, day: Column, pad: int = 0) -> Column:
    """FD3 over a side table's struct(has_temporal_constraint, start_date, end_date), padded as the inferred range is.

    Dates are read from their first ten characters; a range that is not flagged, not whole or no date gives way to the inferred one.
    """
    read = lambda c: F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return preferred_range(found.has_temporal_constraint, F.date_sub(read(found.start_date), pad), F.date_add(read(found.end_date), pad), question_range(question, day, pad))


def relative_day(phrase: Column, day: Column) -> Column:
    """FD4: today, yesterday, tomorrow, last/next weekday; else null."""
    p = F.lower(F.trim(phrase))
    now = F.dayofweek(day) - 1
    wanted = F.array_position(F.array(*map(F.lit, DAYS)), F.regexp_extract(p, r"^(?:last|next)\s+(\w+)$", 1)).cast("int") - 1
    return (
        F.when(p == "today", day).when(p == "yesterday", F.date_sub(day, 1)).when(p == "tomorrow", F.date_add(day, 1))
        .when((wanted >= 0) & p.startswith("last"), F.date_sub(day, F.pmod(now - wanted + 6, F.lit(7)) + 1))
        .when((wanted >= 0) & p.startswith("next"), F.date_add(day, F.pmod(wanted - now + 6, F.lit(7)) + 1))
    )


def clock_times(c: Column) -> Column:
    """FD5: ``HH:MM`` of each clock time with am or pm."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b\d{1,2}(?::\d{2})?\s*(?:am|pm)\b"), F.lit(0))
    hour = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
    minute = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r":(\d{2})", 1), F.lit("")), F.lit("00"))
    good = F.filter(found, lambda x: hour(x).between(1, 12) & (minute(x) < "60"))
    return F.transform(good, lambda x: F.concat(F.lpad((hour(x) % 12 + F.when(x.endswith("pm"), 12).otherwise(0)).cast("string"), 2, "0"), F.lit(":"), minute(x)))


_NUMBER = r"\d+(?:\.\d+)?|" + "|".join(fixed.NUMBER_WORDS)


def number_value(c: Column) -> Column:
    word = F.array_position(F.array(*map(F.lit, fixed.NUMBER_WORDS)), F.lower(c)).cast("double")
    return F.when(c.rlike("^[0-9]"), c.try_cast("double")).when(word > 0, word)


def _measured(c: Column, tail: str, unit) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"\b(?:{_NUMBER})\s+{tail}"), F.lit(0))
    return F.transform(found, lambda x: F.struct(x.alias("surface"), number_value(F.regexp_extract(x, rf"^({_NUMBER})", 1)).alias("value"), unit(x).alias("unit")))


def durations(c: Column) -> Column:
    """FD6: array of struct(surface, value, unit) of ``three weeks`` and the like, units singular."""
    return _measured(c, r"(?:second|minute|hour|day|week|month|year)s?\b", lambda x: F.regexp_extract(x, r"(second|minute|hour|day|week|month|year)s?$", 1))


def frequencies(c: Column) -> Column:
    """FD6: ``twice``-like counts, ``three times a week``."""
    return _measured(c, r"times?\s+(?:a|per)\s+(?:day|week|month|year)\b", lambda x: F.concat(F.lit("times_per_"), F.regexp_extract(x, r"(day|week|month|year)$", 1)))


def number_ranges(c: Column) -> Column:
    """FD6: array of struct(lo, hi, unit) of ``3-5 days`` and the like; unit may be null."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\b\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*(?:%|(?:second|minute|hour|day|week|month|year)s?)?"), F.lit(0))
    ends = r"^(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*(.*?)s?$"
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, ends, 1).cast("double").alias("lo"), F.regexp_extract(x, ends, 2).cast("double").alias("hi"), F.nullif(F.regexp_extract(x, ends, 3), F.lit("")).alias("unit")))


def bm25_idf(n: Column, df: Column) -> Column:
    """FM1."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def smooth_idf(n: Column, df: Column) -> Column:
    """FM2."""
    return F.ln((n + 1) / (df + 1)) + 1


def ndcg(ranks: Column, n_gold: Column, k: int) -> Column:
    """FM3: binary gain over an array of 1-based ranks, log2 discount; no gold: 0."""
    gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, r: a + 1 / F.log2(r + F.lit(1.0)))
    ideal = gain(F.sequence(F.lit(1), F.least(F.lit(k), F.greatest(n_gold, F.lit(1))).cast("int")))
    return F.when(n_gold > 0, gain(F.filter(ranks, lambda r: r <= k)) / ideal).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """FM6: Euclidean, between arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def quartile(position: Column) -> Column:
    """FM7."""
    return F.least(F.lit(3), F.floor(position * 4).cast("int"))


def handle_order(label: Column, namespace: Column, id_: Column) -> Column:
    """FH1, FH3: the key by which ids are put in a seeded order."""
    return F.sha2(F.concat(label, F.chr(F.lit(0)), namespace, F.chr(F.lit(0)), id_), 256)


def short_handle(id_: Column) -> Column:
    """FH2."""
    return F.substring(F.sha2(id_, 256), 1, 16)


def signal_id(session: Column, turn: Column, sentence: Column, text: Column) -> Column:
    """FH5."""
    folded = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    return F.concat(F.lit("signal_"), F.substring(F.sha2(F.concat_ws("\x00", session, turn.cast("string"), sentence.cast("string"), folded), 256), 1, 16))


@F.pandas_udf(T.StringType())
def udf_canonical_json(s: pd.Series) -> pd.Series:
    """FH4: keys sorted, no spaces; null stays null, text that is no JSON too."""

    def one(x):
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return s.map(one)


@F.pandas_udf(T.StringType())
def udf_uuid5(namespace: pd.Series, name: pd.Series) -> pd.Series:
    """FH6."""
    return pd.Series([None if a is None or b is None else str(uuid.uuid5(uuid.UUID(a), b)) for a, b in zip(namespace, name, strict=True)])


def pointer_escape(c: Column) -> Column:
    """FJ1."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def good_key(c: Column) -> Column:
    """FJ6: snake case, and none of the names that would reach an object's own machinery."""
    return c.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$") & ~c.isin("__proto__", "constructor", "prototype")


def adjacent_turns(role: Column, i: Column, n: Column) -> Column:
    """FA4: a user turn, the next and the one before; else the one before, the turn, the next; in bounds."""
    order = F.when(role == "user", F.array(i, i + 1, i - 1)).otherwise(F.array(i - 1, i, i + 1))
    return F.filter(order, lambda x: x.between(0, n - 1))


def comparable_time(c: Column) -> Column:
    """FD7: milliseconds since 1970 of an ISO time, null for what is none."""
    return F.unix_millis(F.try_to_timestamp(c))
