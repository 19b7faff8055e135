"""What a reader may cite and what is done with its output (PF8-PF14, SP9, FN27, RK9, AG10, AG24, AG30): joins and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from .rank import best, bm25, ranked


def any_term(docs: DataFrame, terms: list[str]) -> DataFrame:
    """PF8: documents that hold any of the terms, case folded; blank terms do not count, and without any nothing matches."""
    given = [t.lower() for t in terms if t.strip()]
    return docs.where(F.exists(F.array(*map(F.lit, given)).cast("array<string>"), lambda t: F.contains(F.lower("text"), t)))


def sanitised_refs(chosen: DataFrame, candidates: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF10: ``chosen(question_id, session_id, turn_index)`` -> the refs that stand, and warnings a session.

    A ref stands if its session is a candidate of the question and exists in ``sizes(session_id, n)`` with that turn;
    repeated refs count once. Sessions of which nothing stands go; one that loses refs is warned of.
    """
    known = candidates.select("question_id", "session_id").distinct().join(sizes, "session_id")
    rows = chosen.join(known, ["question_id", "session_id"], "left").withColumn("valid", F.coalesce(F.col("turn_index").between(0, F.col("n") - 1), F.lit(False)))
    refs = rows.where("valid").select("question_id", "session_id", "turn_index").distinct()
    told = rows.groupBy("question_id", "session_id").agg(F.count("n").alias("found"), F.count("*").alias("given"), F.count_distinct(F.when(F.col("valid"), F.col("turn_index"))).alias("stand"))
    problem = F.when(F.col("found") == 0, "unknown session").when(F.col("stand") == 0, "no valid turn").when(F.col("stand") < F.col("given"), "invalid turns")
    return refs, told.select("question_id", "session_id", problem.alias("problem")).where("problem is not null")


def sanitised_pointers(chosen: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PF10: of ``chosen(question_id, pointer)`` those in ``allowed``, each once; and a warning for each that is not."""
    once, pair = chosen.select("question_id", "pointer").distinct(), ["question_id", "pointer"]
    gone = once.join(allowed.select(*pair), pair, "left_anti")
    return once.join(allowed.select(*pair), pair, "left_semi"), gone.select("question_id", F.concat(F.lit("reader removed unknown graph pointer: "), "pointer").alias("warning"))


def fact_warnings(facts: DataFrame, candidates: DataFrame, pointers: DataFrame, sizes: DataFrame) -> DataFrame:
    """PF10: (question_id, fact_id, warning) for supports that name no known candidate or pointer, and facts left without any.

    ``facts(question_id, fact_id, session_id, pointer)`` has a row a support, and one with neither for a fact without support.
    """
    known = candidates.select("question_id", "session_id").join(sizes.select("session_id"), "session_id", "left_semi").distinct().withColumn("s", F.lit(True))
    rows = facts.distinct().join(known, ["question_id", "session_id"], "left").join(pointers.select("question_id", "pointer", F.lit(True).alias("p")).distinct(), ["question_id", "pointer"], "left")
    said = F.when(F.col("session_id").isNotNull() & F.col("s").isNull(), F.concat(F.lit("reader removed unknown fact session: "), F.col("session_id").cast("string"))).when(F.col("pointer").isNotNull() & F.col("p").isNull(), F.concat(F.lit("reader removed unknown fact pointer: "), "pointer"))
    stray = rows.select("question_id", "fact_id", said.alias("warning")).where("warning is not null")
    bare = rows.groupBy("question_id", "fact_id").agg(F.count_if(F.col("s").isNotNull() | F.col("p").isNotNull()).alias("n")).where("n = 0")
    return stray.unionByName(bare.select("question_id", "fact_id", F.lit("reader removed unsupported evidence fact").alias("warning")))


def sanitised_facts(facts: DataFrame, candidates: DataFrame, pointers: DataFrame) -> DataFrame:
    """PF10: ``facts(question_id, fact_id, session_id, pointer)``, a row a support -> facts with supports that stand.

    A support names a session or a pointer, the other is null. Facts without any support left are not there.
    """
    rows = facts.join(candidates.select("question_id", "session_id", F.lit(True).alias("s")).distinct(), ["question_id", "session_id"], "left")
    rows = rows.join(pointers.select("question_id", "pointer", F.lit(True).alias("p")).distinct(), ["question_id", "pointer"], "left").where("s or p")
    return rows.groupBy("question_id", "fact_id").agg(F.count_distinct("session_id").alias("sessions"), F.count_distinct("pointer").alias("pointers"))


def reader_verdict(plans: DataFrame, refs: DataFrame, facts: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """PF10: a plan of which no ref, no pointer and no fact stands abstains as insufficient; the others keep what they said."""
    found = [refs, facts] if pointers is None else [refs, facts, pointers]
    stands = reduce(DataFrame.union, [df.select("question_id") for df in found]).distinct().withColumn("stands", F.lit(True))
    rows, void = plans.join(stands, "question_id", "left"), F.col("stands").isNull()
    return rows.withColumn("support_status", F.when(void, "insufficient").otherwise(F.col("support_status"))).withColumn("answer_mode", F.when(void, "abstain").otherwise(F.col("answer_mode"))).drop("stands")


def substituted(answers: DataFrame) -> DataFrame:
    """PF13: the fixed sentence stands in for a blank answer that is insufficient, and for nothing else."""
    blank = F.regexp_replace(F.coalesce("hypothesis", F.lit("")), r"\s", "") == ""
    return answers.withColumn("hypothesis", F.when((F.col("support_status") == "insufficient") & blank, fixed.UNAVAILABLE).otherwise(F.coalesce("hypothesis", F.lit(""))))


def around(refs: DataFrame, turns: DataFrame) -> DataFrame:
    """A ref and its neighbours, ``step`` from 0: a user turn before its reply and what came before, a reply between its neighbours."""
    at = turns.select("session_id", "turn_index", "role")
    t = F.col("turn_index")
    order = F.when(F.col("role") == "user", F.array(t, t + 1, t - 1)).otherwise(F.array(t - 1, t, t + 1))
    near = refs.join(at, ["session_id", "turn_index"]).select("*", F.posexplode(order).alias("step", "near")).withColumn("own", F.col("near") == t)
    return near.drop("turn_index", "role").withColumnRenamed("near", "turn_index").join(at.drop("role"), ["session_id", "turn_index"], "left_semi")


def repaired(items: DataFrame, anchors: DataFrame, shapes: DataFrame, turns: DataFrame, most: int = 40) -> DataFrame:
    """PF14: ``items(question_id, position, session_id, turn_index)`` and, where the question gathers or orders or no item
    is valid, the bag's ``anchors`` (same columns, one a session): all with their neighbours, the first of each, ``most``
    a question. ``shapes(question_id, shape)`` says what a question asks for.
    """
    chosen = around(items, turns).select("question_id", F.lit(0).alias("phase"), "position", "step", "session_id", "turn_index", F.when(F.col("own"), "chosen").otherwise("adjacent").alias("why"))
    has = chosen.select("question_id").distinct().withColumn("has", F.lit(True))
    asked = shapes.join(has, "question_id", "left").where(F.col("shape").isin("aggregate", "order") | F.col("has").isNull())
    bag = around(anchors.join(asked, "question_id"), turns)
    own = F.when(F.col("shape").isin("aggregate", "order"), "coverage").otherwise("fallback")
    extra = bag.select("question_id", F.lit(1).alias("phase"), "position", "step", "session_id", "turn_index", F.when(F.col("own"), own).otherwise("adjacent").alias("why"))
    place = [F.asc("phase"), F.asc("position"), F.asc("step"), F.asc("session_id"), F.asc("turn_index")]
    once = ranked(chosen.unionByName(extra), ["question_id", "session_id", "turn_index"], place, 1, "copy").drop("copy")
    return ranked(once, ["question_id"], place, most, "place").select("question_id", "place", "session_id", "turn_index", "why")


def in_package_order(items: DataFrame) -> DataFrame:
    """SP9: selected items before others, then by date, session and turn."""
    return ranked(items, ["question_id"], [(F.col("tier") != "selected").asc(), F.asc("date"), F.asc("session_id"), F.asc("turn_index")], None, "place")


def _quoted(c: Column) -> Column:
    """A string as JSON, through an array of it."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def full_history(turns: DataFrame, case: Column, as_json: bool = False) -> DataFrame:
    """FN27: all sessions of a case as one text, numbered from 1 by date and id, turns as lines or as a JSON list.

    A case's history is one row: a case is what a model reads whole.
    """
    if as_json:
        line = lambda t: F.concat(F.lit('{"role": '), _quoted(t.role), F.lit(', "content": '), _quoted(t.content), F.lit("}"))
    else:
        line = lambda t: F.concat(t.role, F.lit(": "), t.content)
    said = turns.groupBy(case.alias("case_id"), "session_id", "date").agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))).alias("turns"))
    body = F.array_join(F.transform("turns", line), ", " if as_json else "\n")
    body = F.concat(F.lit("["), body, F.lit("]")) if as_json else body
    cases = said.select("case_id", "date", "session_id", body.alias("body")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("date", "session_id", "body"))).alias("sessions"))
    block = lambda s, i: F.concat(F.lit("### Session "), (i + 1).cast("string"), F.lit(":\nSession Date: "), s.date, F.lit("\nSession Content:\n"), s.body)
    return cases.select("case_id", F.array_join(F.transform("sessions", block), "\n\n").alias("history"))


def claim_search(claims: DataFrame, queries: DataFrame, top: int = 30, most: int = 24) -> DataFrame:
    """RK9: BM25 over ``claims(session_id, claim_no, turn_index, role, date, kind, date_hint, sentence)``, ``top`` a question;
    sessions by the sum of 1 / (60 + rank), with the number of claims hit and of claims within a turn of them."""
    head = F.concat(F.lit("[role] "), "role", F.lit("\n[session_date] "), "date", F.lit("\n[event_date] "), "date_hint", F.lit("\n[kind] "), "kind", F.lit("\n"), "sentence")
    docs = claims.select(F.concat_ws("#", "session_id", "claim_no").alias("doc_id"), "session_id", "turn_index", head.alias("text"))
    hits = bm25(docs, queries, top, keep=("session_id", "turn_index"))
    scores = hits.groupBy("question_id", "session_id").agg(F.sum(1 / (fixed.RRF_K + F.col("rank"))).alias("score"), F.count("*").alias("claims"))
    spots = hits.select("question_id", "session_id", F.explode(F.sequence(F.col("turn_index") - 1, F.col("turn_index") + 1)).alias("turn_index")).distinct()
    near = spots.join(claims.select("session_id", "turn_index"), ["session_id", "turn_index"]).groupBy("question_id", "session_id").agg(F.count("*").alias("neighbours"))
    return ranked(scores.join(near, ["question_id", "session_id"]), ["question_id"], [best("score"), F.asc("session_id")], most)


def series(c: Column) -> Column:
    """AG10: a session's name without the number at its end."""
    return F.regexp_replace(c, r"^(.*)_\d+$", "$1")


def routing_recovery(gold: DataFrame, bundle: DataFrame, routed: DataFrame, index: DataFrame) -> DataFrame:
    """AG10: of the gold sessions (question_id, name) that the bundle misses, how many the routed ones or their series' others
    bring back; a row a question with gold. ``index(name)`` lists all sessions."""
    pair = ["question_id", "name"]
    seeds = bundle.select(*pair).union(routed.select(*pair)).select("question_id", series(F.col("name")).alias("series")).distinct()
    reach = gold.join(index.select("name"), "name", "left_semi").withColumn("series", series(F.col("name"))).join(seeds, ["question_id", "series"], "left_semi").select(*pair)
    reach = reach.union(routed.select(*pair)).distinct().withColumn("back", F.lit(True))
    rows = gold.select(*pair).distinct().join(bundle.select(*pair).distinct().withColumn("held", F.lit(True)), pair, "left").join(reach, pair, "left")
    missing = F.col("held").isNull()
    return rows.groupBy("question_id").agg(F.count("*").alias("gold"), F.count_if(missing).alias("missed"), F.count_if(missing & F.col("back")).alias("recovered"))


def mode_report(results: DataFrame, labels: DataFrame) -> DataFrame:
    """AG24: a row a mode of ``results(mode, question_id, ...)``: accuracy, flaws, tokens, cost, and results nobody judged."""
    rows = results.join(labels.select("mode", "question_id", "label"), ["mode", "question_id"], "left")
    tokens = lambda c: F.sum(c).alias(c)
    cost = (F.sum("input_tokens") * fixed.ANSWER_PRICES[0] + F.sum("output_tokens") * fixed.ANSWER_PRICES[1]) / 1_000_000
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY input_tokens)").cast("long").alias("input_p95")
    judged = F.count("label")
    return rows.groupBy("mode").agg(
        judged.alias("judged"), F.count_if("label").alias("correct"), F.round(F.count_if("label") / judged, 6).alias("accuracy"), F.count_if(F.col("label").isNull()).alias("unjudged"),
        F.count_if("restated").alias("restated"), tokens("rejected"), tokens("duplicates"), p95, tokens("input_tokens"), tokens("output_tokens"), F.round(cost, 6).alias("cost"),
    )


def oracle_plan(cases: DataFrame, gold_turns: DataFrame) -> DataFrame:
    """AG30: ``cases(question_id, question_type, session_id)``, a row a gold session (null: none) -> what a perfect reader does.

    A question whose id ends in ``_abs`` abstains. ``lacking``: gold sessions without a gold turn, which is an error.
    """
    held = gold_turns.groupBy("question_id", "session_id").agg(F.count_distinct("turn_index").alias("n"))
    rows = cases.distinct().join(held, ["question_id", "session_id"], "left").groupBy("question_id", "question_type").agg(F.count("session_id").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns"), F.count_if(F.col("session_id").isNotNull() & F.col("n").isNull()).alias("lacking"))
    none, mode = F.col("question_id").endswith("_abs"), F.lit("direct")
    for kind, name in fixed.ANSWER_MODES:
        mode = F.when(F.col("question_type") == kind, name).otherwise(mode)
    zero = lambda c: F.when(none, 0).otherwise(F.col(c)).cast("long").alias(c)
    return rows.select("question_id", F.when(none, "insufficient").otherwise("sufficient").alias("support_status"), F.when(none, "abstain").otherwise(mode).alias("answer_mode"), zero("sessions"), zero("turns"), zero("lacking"))


def notes_search(documents: DataFrame, notes: DataFrame, queries: DataFrame, top: int, most: int = 280) -> DataFrame:
    """RK11: BM25 over notes' texts (doc_id, text), 5, 10 or 20 a question and 10 for any other ``top``; each hit with the
    first three facts and six key phrases of ``notes(doc_id, facts, keyphrases)``, clipped."""
    hits = bm25(documents, queries, top if top in (5, 10, 20) else 10)
    phrases = F.when(F.size("keyphrases") > 0, F.concat(F.lit("keyphrases: "), F.array_join(F.slice("keyphrases", 1, 6), "; ")))
    whole = F.array_join(F.array_compact(F.concat(F.slice("facts", 1, 3), F.array(phrases))), " | ")
    clipped = F.when(F.length("s") <= most, F.col("s")).otherwise(F.concat(F.substring("s", 1, most - 1), F.lit("…")))
    snippets = notes.select("doc_id", whole.alias("s")).select("doc_id", clipped.alias("snippet"))
    return hits.join(snippets, "doc_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("(no notes)")))
