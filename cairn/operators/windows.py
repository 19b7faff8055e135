"""Index units from turns: windows, role views, notes, claims, session index, signals (DB1-DB12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, text


def sessions(turns: DataFrame) -> DataFrame:
    """One row a session: its turns as an array in order."""
    kept = F.array_sort(F.collect_list(F.struct("turn_index", "role", "content")))
    return turns.groupBy("session_id", "date").agg(kept.alias("turns"))


def window_bounds(n: Column, width: int, stride: int) -> Column:
    """DB1: array of struct(start, end), the last clipped; none starts once one has reached the end."""
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(stride)), lambda s: (s == 0) | (s - stride + width < n))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (F.least(s + width, n) - 1).alias("end")))


def windows(turns: DataFrame, width: int = 4, stride: int = 2, user_only: bool = True) -> DataFrame:
    """DB1, DB2: (doc_id ``session#start-end``, session_id, date, start_turn, end_turn, text)."""
    rows = sessions(turns).select("session_id", "date", "turns", F.explode(window_bounds(F.size("turns"), width, stride)).alias("w"))
    inside = F.slice("turns", F.col("w.start") + 1, F.col("w.end") - F.col("w.start") + 1)
    said = F.filter(inside, lambda t: t.role == "user") if user_only else inside
    lines = F.transform(said, lambda t: F.concat(F.lit("["), t.role, F.lit("] "), t.content))
    return rows.select(
        F.concat(F.col("session_id").cast("string"), F.lit("#"), F.col("w.start").cast("string"), F.lit("-"), F.col("w.end").cast("string")).alias("doc_id"),
        "session_id", "date", F.col("w.start").cast("long").alias("start_turn"), F.col("w.end").cast("long").alias("end_turn"),
        F.array_join(F.concat(F.array(F.concat(F.lit("[session_date] "), "date")), lines), "\n").alias("text"),
    )


def user_windows(turns: DataFrame, width: int, stride: int, repeat: int = 1) -> DataFrame:
    """DB3: windows without a user turn are dropped; user text may be repeated to weigh more."""
    w = windows(turns, width, stride)
    said = w.where(F.contains("text", F.lit("\n[user] ")))
    return said.withColumn("text", F.array_join(F.array_repeat("text", repeat), "\n"))


def role_view(turns: DataFrame, role: str | None) -> DataFrame:
    """DB5: one document a session of one role's turns (None: all), numbered from 0 within the view, under the view's name.

    A session without a turn of the role is a document without lines.
    """
    said = turns if role is None else turns.where(F.col("role") == role)
    lines = F.transform("turns", lambda t, i: F.concat(F.lit("["), t.role, F.lit(" turn "), i.cast("string"), F.lit("] "), t.content))
    text_ = sessions(said).select("session_id", F.array_join(lines, "\n").alias("text"))
    every = turns.select("session_id", "date").distinct().join(text_, "session_id", "left")
    return every.select("session_id", "date", F.concat(F.lit(f"[source_view] {role or 'all'}\n"), F.coalesce("text", F.lit(""))).alias("text"))


def notes_documents(notes: DataFrame, days: DataFrame) -> DataFrame:
    """DB4: id, date, facts, phrases and events of a session as text; ``(empty)`` without notes."""
    bullet = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    some = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    facts, events = F.transform("facts", lambda x: x.text), F.transform("events", lambda x: F.concat(x.text, F.when(x.date_hint != "", F.concat(F.lit(" ("), x.date_hint, F.lit(")"))).otherwise("")))
    joined = days.join(notes, "session_id", "left")
    head = F.array(F.concat(F.lit("[session_id] "), "session_id"), F.concat(F.lit("[session_date] "), "date"))
    none = F.array().cast("array<string>")
    body = F.concat(
        F.when(some(facts), F.concat(F.array(F.lit("[facts]")), bullet(facts))).otherwise(none),
        F.when(some(F.col("keyphrases")), F.array(F.concat(F.lit("[keyphrases] "), F.array_join("keyphrases", "; ")))).otherwise(none),
        F.when(some(events), F.concat(F.array(F.lit("[events]")), bullet(events))).otherwise(none),
    )
    return joined.select("session_id", "date", F.array_join(F.concat(head, F.when(F.size(body) > 0, body).otherwise(F.array(F.lit("[notes] (empty)")))), "\n").alias("text"))


def sentences_of(turns: DataFrame) -> DataFrame:
    """One row a sentence of a turn."""
    return turns.select("session_id", "date", "turn_index", "role", F.posexplode(text.sentences(F.col("content"))).alias("sentence_index", "sentence"))


def claims(turns: DataFrame, min_chars: int = 1) -> DataFrame:
    """DB6: a claim for each different sentence of a turn, numbered within its session in order of appearance."""
    rows = sentences_of(turns).where(F.length("sentence") >= min_chars)
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("session_id", "turn_index", "role", F.lower("sentence")).orderBy("sentence_index"))).where("n = 1")
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index", "sentence_index"))
    return once.select("session_id", number.cast("long").alias("claim_no"), "turn_index", "role", "sentence")


def session_index(turns: DataFrame, top: int = 8, opener_chars: int = 160) -> DataFrame:
    """DB10: each session's first words and its ``top`` terms by tf-idf, tf being user turns with the term."""
    user = turns.where("role = 'user'")
    first = user.where(F.trim("content") != "").groupBy("session_id").agg(F.min_by(text.clip(F.col("content"), opener_chars), "turn_index").alias("opener"))
    tf = user.select("session_id", F.explode(text.package_terms(F.col("content"))).alias("term")).groupBy("session_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = turns.select("session_id").distinct().agg(F.count("*").alias("n"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * dates.smooth_idf(F.col("n"), F.col("df")))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.round("score", 9).desc(), "term"))
    best = scored.withColumn("place", place).where(F.col("place") <= top).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x.term).alias("terms"))
    return turns.select("session_id").distinct().join(first, "session_id", "left").join(best, "session_id", "left").select("session_id", F.coalesce("opener", F.lit("")).alias("opener"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))


def signals(turns: DataFrame) -> DataFrame:
    """DB11: user sentences in the first person with their cues and priority."""
    rows = sentences_of(turns.where("role = 'user'"))
    s = F.col("sentence")
    cues = {name: s.rlike("(?i)" + p) for name, p in fixed.SIGNALS}
    cues["time"] = cues["time"] | s.rlike(r"\bMay\b") | s.rlike(r"\b(?:\d{1,4}[/-]){1,2}\d{1,4}\b|\b\d{1,2}:\d{2}\b")
    weight = sum((F.when(cues[n], w).otherwise(0) for n, w in fixed.SIGNAL_WEIGHTS.items()), F.lit(0))
    rows = rows.select("session_id", "turn_index", "sentence_index", "sentence", *[c.alias(n) for n, c in cues.items()], weight.alias("weight"))
    return rows.where("first_person").withColumn("priority", F.when(F.col("weight") >= fixed.HIGH, "high").when(F.col("weight") >= fixed.MEDIUM, "medium").otherwise("low"))


def evidence_ledger(provenance: DataFrame) -> DataFrame:
    """DB12: ``(session_id, turn_index, excerpt, pointer)`` -> evidence once each, with its pointers in order."""
    rows = provenance.groupBy("session_id", "turn_index", "excerpt").agg(F.array_sort(F.collect_set("pointer")).alias("pointers"))
    return rows.withColumn("temporal", F.lower("excerpt").rlike(fixed.TEMPORAL_QUESTION))


def pair_windows(turns: DataFrame) -> DataFrame:
    """DB9: a user turn with the assistant turn right behind it; other turns stand alone."""
    by = Window.partitionBy("session_id").orderBy("turn_index")
    role_before = F.lag("role").over(by)
    starts = F.when((F.col("role") == "assistant") & (role_before == "user"), 0).otherwise(1)
    rows = turns.withColumn("starts", starts).withColumn("pair", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("session_id", "pair").agg(F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "content"))), lambda x: x.content), "\n").alias("text"))
