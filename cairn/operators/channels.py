"""Several kinds of documents at once: five-channel retrieval, seven-channel fusion, anchors, evidence, focus (DB7-DB8, RK7-RK18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from .rank import best, bm25, ranked, rrf

#: Hits that each channel may give; None: all of its documents.
LIMITS = {"session": 12, "graph_cell": 12, "summary": 4, "coverage_fallback": 4, "tail": None}


def channel_documents(sessions: DataFrame, cells: DataFrame, summaries: DataFrame, fallbacks: DataFrame, tail: DataFrame) -> DataFrame:
    """DB7: (doc_id, channel, session_ids, text) from five tables of (doc_id, session_ids, text).

    A session's text also carries that of the cells and summaries that cite it, gathered by an equi-join.
    """
    cited = cells.unionByName(summaries).select(F.explode("session_ids").alias("session_id"), "doc_id", F.col("text").alias("more"))
    extra = cited.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "more"))), lambda x: x.more), "\n").alias("more"))
    wide = sessions.withColumn("session_id", F.get("session_ids", F.lit(0))).join(extra, "session_id", "left")
    parts = {"session": wide.select("doc_id", "session_ids", F.concat_ws("\n", "text", "more").alias("text")), "graph_cell": cells, "summary": summaries, "coverage_fallback": fallbacks, "tail": tail}
    tagged = [df.select(F.concat(F.lit(name + ":"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(name).alias("channel"), "session_ids", "text") for name, df in parts.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return out


def property_documents(entities: DataFrame, claims: DataFrame, relations: DataFrame) -> DataFrame:
    """DB8: a document for each entity, claim and relation, ids spelled out by entity names."""
    names = entities.select("entity_id", "name")
    c = claims.join(names.withColumnRenamed("name", "subject_name"), claims["subject"] == names["entity_id"])
    a, b = names.select(F.col("entity_id").alias("a"), F.col("name").alias("a_name")), names.select(F.col("entity_id").alias("b"), F.col("name").alias("b_name"))
    r = relations.join(a, "a").join(b, "b")
    return (
        entities.select(F.concat(F.lit("entity:"), "entity_id").alias("doc_id"), F.concat_ws(" ", "kind", "name").alias("text"))
        .unionByName(c.select(F.concat(F.lit("claim:"), "claim_id").alias("doc_id"), F.concat_ws(" ", "subject_name", "predicate", "value").alias("text")))
        .unionByName(r.select(F.concat(F.lit("relation:"), "relation_id").alias("doc_id"), F.concat_ws(" ", "a_name", "kind", "b_name").alias("text")))
    )


def five_channels(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """RK7: BM25 within each channel, its limit each; sessions count once. The tail comes whole, unmatched at 0."""
    parts = []
    for name, limit in LIMITS.items():
        own = docs.where(F.col("channel") == name)
        if limit is None:
            parts.append(own.crossJoin(F.broadcast(queries.select("question_id"))).select("question_id", "doc_id", F.lit(name).alias("channel"), F.lit(0.0).alias("score")))
        else:
            parts.append(bm25(own, queries, limit, 1.2, 0.75).select("question_id", "doc_id", F.lit(name).alias("channel"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, ["question_id", "channel"], [best("score"), F.asc("doc_id")])


def seven_channels(channels: dict[str, DataFrame], k: int = fixed.RRF_K, top: int = 24) -> DataFrame:
    """RK10: named tables (question_id, session_id, score) -> ranks by score and id in each, fused."""
    parts = [ranked(df.select("question_id", "session_id", "score"), ["question_id"], [best("score"), F.asc("session_id")]).select("question_id", "session_id", "rank", F.lit(name).alias("channel")) for name, df in channels.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rrf(out, k, top)


def anchor_refs(turns: DataFrame, queries: DataFrame, noted: DataFrame, top: int = 10) -> DataFrame:
    """RK15: turns by 10 a shared term, 8 for an assistant's question, 3 for a digit, 2 if a note cites the turn.

    Only turns that share a term are ever paired with a question; the best ``top`` of each session count.
    """
    asked = queries.select("question_id", F.explode(text.package_terms(F.col("question"))).alias("term"))
    held = turns.select("session_id", "turn_index", F.explode(text.package_terms(F.col("content"))).alias("term"))
    shared = held.join(asked, "term").groupBy("question_id", "session_id", "turn_index").agg(F.count("*").alias("overlap"))
    facts = turns.select("session_id", "turn_index", ((F.col("role") == "assistant") & F.contains("content", F.lit("?"))).alias("asks"), F.col("content").rlike("[0-9]").alias("digit"))
    cited = noted.select("session_id", "turn_index").distinct().withColumn("cited", F.lit(True))
    rows = shared.join(facts, ["session_id", "turn_index"]).join(cited, ["session_id", "turn_index"], "left")
    value = F.col("overlap") * 10 + F.when(F.col("asks"), 8).otherwise(0) + F.when(F.col("digit"), 3).otherwise(0) + F.when(F.col("cited"), 2).otherwise(0)
    return ranked(rows.select("question_id", "session_id", "turn_index", value.alias("score")), ["question_id", "session_id"], [F.desc("score"), F.asc("turn_index")], top)


def question_evidence(evidence: DataFrame, signals: DataFrame, queries: DataFrame, top: int = 12) -> DataFrame:
    """RK16: canonical evidence by 4 a term in its pointer, 2 in its text, 3 if both are about time, 2 for being canonical;
    unverified signals need two terms, 2 each, and no hypothetical context; a signal that evidence has already is out."""
    asked = queries.select("question_id", "question", F.explode(text.question_terms(F.col("question"))).alias("term"))
    timed = F.lower("question").rlike(fixed.TEMPORAL_QUESTION)
    spots = evidence.select("evidence_id", "session_id", "turn_index", "excerpt", "temporal", F.explode(F.concat(F.transform(text.question_terms(F.array_join("pointers", " ")), lambda t: F.struct(t.alias("term"), F.lit(4).alias("w"))), F.transform(text.question_terms(F.col("excerpt")), lambda t: F.struct(t.alias("term"), F.lit(2).alias("w"))))).alias("s"))
    sure = spots.select("*", "s.*").join(asked, "term").groupBy("question_id", "evidence_id", "session_id", "turn_index").agg((F.sum("w") + F.max(F.when(timed & F.col("temporal"), 3).otherwise(0)) + 2).alias("score"))
    terms = signals.where(~F.lower("sentence").rlike(fixed.UNSAFE_CONTEXT)).select("signal_id", "session_id", "turn_index", "sentence", F.explode(text.question_terms(F.col("sentence"))).alias("term"))
    loose = terms.join(evidence.select("session_id", "turn_index", F.col("excerpt").alias("sentence")), ["session_id", "turn_index", "sentence"], "left_anti")
    loose = loose.join(asked, "term").groupBy("question_id", F.col("signal_id").alias("evidence_id"), "session_id", "turn_index").agg((F.count("*") * 2).alias("score")).where("score >= 4")
    both = sure.withColumn("source", F.lit("canonical")).unionByName(loose.withColumn("source", F.lit("unverified")))
    return ranked(both, ["question_id"], [F.desc("score"), F.asc("source"), F.asc("session_id"), F.asc("turn_index"), F.asc("evidence_id")], top)


def reader_focus(pairs: DataFrame, queries: DataFrame, sessions: int = 21, turns: int = 6) -> DataFrame:
    """RK17: BM25 over pair windows (doc_id, session_id, start_turn, end_turn, text), 3 more for digits where the question
    counts; the best sessions, and of each the best pairs while their turns fit."""
    hits = bm25(pairs, queries, None, keep=("session_id", "start_turn", "end_turn", "digits")).join(queries.select("question_id", "question"), "question_id")
    counts = F.lower("question").rlike(fixed.AGGREGATE_WORDS)
    hits = hits.withColumn("score", F.col("score") + F.when(counts & F.col("digits"), 3.0).otherwise(0.0)).drop("question")
    order = ranked(hits.groupBy("question_id", "session_id").agg(F.max("score").alias("top")), ["question_id"], [best("top"), F.asc("session_id")], sessions, "session_rank")
    rows = ranked(hits.join(order, ["question_id", "session_id"]), ["question_id", "session_id"], [best("score"), F.asc("start_turn")])
    from pyspark.sql import Window

    used = F.sum(F.col("end_turn") - F.col("start_turn") + 1).over(Window.partitionBy("question_id", "session_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= turns).drop("used", "top")


def sibling_score(siblings: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """RK18: siblings (question_id, session_id, best_rank, terms, user_text): (3 a matched term, 1 a user word) * 1000, and up to 500 for rank."""
    asked = queries.select("question_id", text.package_terms(F.col("question")).alias("q"))
    rows = siblings.join(asked, "question_id")
    score = (3 * text.overlap(F.col("q"), F.col("terms")) + text.overlap(F.col("q"), text.package_terms(F.col("user_text")))) * 1000 + F.greatest(F.lit(0), 500 - F.coalesce("best_rank", F.lit(500)))
    return ranked(rows.withColumn("score", score), ["question_id"], [F.desc("score"), F.asc("session_id")], most)
