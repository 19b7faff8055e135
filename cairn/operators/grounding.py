"""PF11 with FN23 and FN24: does a reader's plan stand on what it selected, and on the names that the question shows?"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text

ANCHORS = "array<struct<kind:string,text:string,normalized:string>>"


def contraction(t: Column, suffixes: list[str]) -> Column:
    """The base of a word that ends in one of the contractions, normalised; null for other words."""
    base, end = (text.surface_key(F.regexp_extract(t, fixed.CONTRACTED, n)) for n in (1, 2))
    return F.when((base != "") & end.isin(suffixes), base)


def anchors(question: Column) -> Column:
    """FN23: what a question marks as exact: phrases in double quotes, then runs of capitalised words, each kind and text once.

    A single capitalised word counts inside a question, not at its start, unless it is possessive; words that only frame a
    question never count, nor do their contractions. ``question`` should be in compatibility form.
    """
    quoted = F.transform(F.regexp_extract_all(question, F.lit(fixed.QUOTED), F.lit(1)), F.trim)
    phrase = F.transform(quoted, lambda t: F.struct(F.lit("quoted_phrase").alias("kind"), t.alias("text"), text.surface_key(t).alias("normalized")))
    runs = F.regexp_extract_all(question, F.lit(rf"{fixed.CAPITALISED}(?:\s+{fixed.CAPITALISED})*"), F.lit(0))
    first = question.rlike("^" + fixed.CAPITALISED)

    def named(t: Column, i: Column) -> Column:
        several, key = t.rlike(r"\s"), text.surface_key(t)
        framing = F.coalesce(contraction(t, fixed.CONTRACTIONS).isin(fixed.FRAMING_WORDS), F.lit(False))
        owner = F.coalesce(~contraction(t, ["s"]).isin(fixed.FRAMING_WORDS), F.lit(False))
        counts = several | (~framing & (owner | (~((i == 0) & first) & ~key.isin(fixed.FRAMING_WORDS))))
        kind = F.when(counts, F.when(several, "capitalized_phrase").otherwise("capitalized_token"))
        return F.struct(kind.alias("kind"), t.alias("text"), key.alias("normalized"))

    every = F.filter(F.concat(phrase, F.transform(runs, named)), lambda a: a.kind.isNotNull() & (a.normalized != ""))
    key = lambda a: F.concat_ws(":", a.kind, a.normalized)
    return F.filter(every, lambda a, i: ~F.exists(F.slice(every, F.lit(1), i), lambda b: key(b) == key(a))).cast(ANCHORS)


def anchors_of(rows: DataFrame, id_: str, question: str) -> DataFrame:
    """(id, place, kind, text, normalized): a row an anchor of each question, brought to compatibility form first."""
    plain = rows.select(id_, text.compatible(F.col(question)).alias("_question"))
    return plain.select(id_, F.posexplode(anchors(F.col("_question"))).alias("place", "a")).select(id_, "place", "a.*")


def restates(question: Column, statement: Column) -> Column:
    """FN24: is the statement the question again, wrappers, case and punctuation aside?"""
    asked, said = text.surface_key(question), text.surface_key(statement)
    bare = said
    for wrapper in fixed.WRAPPERS:
        bare = F.regexp_replace(bare, wrapper, "")
    return F.coalesce((asked != "") & (said != "") & ((said == asked) | (bare == asked)), F.lit(False))


@dataclass
class Plan:
    """A reader's plans as tables: ``plans(question_id, question, support_status, answer_mode)``, ``selected(question_id, session_id,
    turn_index)`` with a null turn for a session without turns, ``pointers(question_id, pointer)``, ``facts(question_id, fact_id,
    statement)`` and ``supports(question_id, fact_id, session_id, pointer)``, of which one is null."""

    plans: DataFrame
    selected: DataFrame
    pointers: DataFrame
    facts: DataFrame
    supports: DataFrame


def chosen_supports(p: Plan) -> DataFrame:
    """Supports of facts with ``chosen``: is their session or pointer one that the plan selected?"""
    sessions = p.selected.select("question_id", "session_id", F.lit(True).alias("s")).distinct()
    pointers = p.pointers.select("question_id", "pointer", F.lit(True).alias("p")).distinct()
    rows = p.supports.join(sessions, ["question_id", "session_id"], "left").join(pointers, ["question_id", "pointer"], "left")
    return rows.select("question_id", "fact_id", "session_id", "pointer", F.coalesce("s", "p", F.lit(False)).alias("chosen"))


def restated(p: Plan) -> DataFrame:
    asked = p.plans.select("question_id", text.compatible(F.col("question")).alias("question"))
    return p.facts.select("question_id", "fact_id", text.compatible(F.col("statement")).alias("statement")).join(asked, "question_id").where(restates(F.col("question"), F.col("statement"))).select("question_id", "fact_id")


def pruned(p: Plan) -> tuple[Plan, DataFrame]:
    """The plan without stray support and without facts that restate the question or stand on nothing selected; and those facts."""
    pair = ["question_id", "fact_id"]
    supports = chosen_supports(p).where("chosen").drop("chosen").join(restated(p), pair, "left_anti").distinct()
    kept = p.facts.join(supports.select(*pair).distinct(), pair, "left_semi")
    return Plan(p.plans, p.selected, p.pointers, kept, supports), p.facts.select(*pair).join(kept.select(*pair), pair, "left_anti")


def claims(p: Plan) -> DataFrame:
    """Plans that claim evidence: anything but an insufficient abstention."""
    return p.plans.where((F.col("support_status") != "insufficient") | (F.col("answer_mode") != "abstain"))


def matched_anchors(p: Plan, turns: DataFrame, values: DataFrame) -> DataFrame:
    """The anchors of claiming plans (question_id, place, kind, text, normalized) and whether a selected source holds them.

    A source is any turn of a selected session, or the value of a selected pointer (a string as it is, else its JSON); it
    holds an anchor whose normalised text it contains. Turns are normalised once, however many plans select them, and meet
    anchors only by the session that a plan selected.
    """
    asked = anchors_of(claims(p), "question_id", "question")
    used = p.selected.select("session_id").distinct()
    said = turns.join(used, "session_id", "left_semi").select("session_id", text.surface_key(text.compatible(F.col("content"))).alias("said"))
    by_turn = asked.join(p.selected.select("question_id", "session_id").distinct(), "question_id").join(said, "session_id")
    plain = F.when(F.col("type") == "string", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]).otherwise(F.col("value"))
    held = p.pointers.distinct().join(values.select("question_id", "pointer", text.surface_key(text.compatible(plain)).alias("said")), ["question_id", "pointer"])
    hits = by_turn.select("question_id", "place", "normalized", "said").unionByName(asked.join(held.select("question_id", "said"), "question_id").select("question_id", "place", "normalized", "said"))
    found = hits.where(F.contains("said", F.col("normalized"))).select("question_id", "place", F.lit(True).alias("hit")).distinct()
    return asked.join(found, ["question_id", "place"], "left").withColumn("matched", F.coalesce("hit", F.lit(False))).drop("hit")


def issues(p: Plan, turns: DataFrame, values: DataFrame, marked: DataFrame) -> DataFrame:
    """All that is wrong with a plan: (question_id, code, detail), ``marked`` being its ``matched_anchors``."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    picked = p.selected.join(sizes, "session_id", "left")
    session = F.col("session_id").cast("string")
    row = lambda df, code, detail: df.select("question_id", F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    out = row(picked.where("n is null").select("question_id", "session_id").distinct(), "unknown_selected_session", session)
    turn = picked.where("n is not null and turn_index is not null and not turn_index between 0 and n - 1")
    out = out.unionByName(row(turn, "unknown_selected_turn", F.concat_ws(":", session, F.col("turn_index").cast("string"))))
    out = out.unionByName(row(p.pointers.join(values.select("question_id", "pointer"), ["question_id", "pointer"], "left_anti"), "unknown_selected_graph_pointer", F.col("pointer")))
    supports = chosen_supports(p)
    stray = supports.where("not chosen")
    of = lambda c: F.concat_ws(":", F.col("fact_id").cast("string"), c)
    out = out.unionByName(row(stray.where("session_id is not null"), "fact_session_not_selected", of(session))).unionByName(row(stray.where("pointer is not null"), "fact_graph_pointer_not_selected", of(F.col("pointer"))))
    grounded = supports.where("chosen").select("question_id", "fact_id").distinct()
    out = out.unionByName(row(p.facts.join(grounded, ["question_id", "fact_id"], "left_anti"), "fact_has_no_selected_source", F.col("fact_id")))
    out = out.unionByName(row(restated(p), "question_restatement_fact", F.col("fact_id")))
    stands = grounded.join(p.facts.select("question_id", "fact_id"), ["question_id", "fact_id"], "left_semi").select("question_id").distinct()
    out = out.unionByName(row(claims(p).join(stands, "question_id", "left_anti"), "non_abstaining_plan_without_grounded_fact", F.lit(None)))
    return out.unionByName(row(marked.where("not matched"), "unmatched_exact_surface_anchor", F.concat_ws(":", "kind", "normalized")))


@dataclass
class Grounded:
    """``plan``: what stands, empty and abstaining where anything is wrong; ``removed``: facts that were pruned before; ``issues`` of the
    pruned plan; ``anchors`` with whether they are matched."""

    plan: Plan
    removed: DataFrame
    issues: DataFrame
    anchors: DataFrame


def enforced(p: Plan, turns: DataFrame, values: DataFrame) -> Grounded:
    """PF11: stray facts go first, so that one does not discard the others; then a plan with any issue left abstains whole.

    ``turns(session_id, turn_index, content)`` are all there are; ``values(question_id, pointer, value, type)`` what pointers
    lead to (``tree.evaluated``). Every test is a join on the question or the session, with no Python but NFKC. The tables of a
    plan, its anchors and its issues are cached, as each is used several times; they are small beside the turns, which are not.
    """
    kept, removed = pruned(Plan(*[getattr(p, f).persist() for f in ("plans", "selected", "pointers", "facts", "supports")]))
    kept = Plan(kept.plans, kept.selected, kept.pointers, kept.facts.persist(), kept.supports.persist())
    marked = matched_anchors(kept, turns, values).persist()
    wrong = issues(kept, turns, values, marked).persist()
    void = wrong.select("question_id").distinct()
    ok = lambda df: df.join(void, "question_id", "left_anti")
    plans = p.plans.join(void.withColumn("void", F.lit(True)), "question_id", "left")
    plans = plans.withColumn("support_status", F.when(F.col("void"), "insufficient").otherwise(F.col("support_status"))).withColumn("answer_mode", F.when(F.col("void"), "abstain").otherwise(F.col("answer_mode"))).drop("void")
    return Grounded(Plan(plans, ok(kept.selected), ok(kept.pointers), ok(kept.facts), ok(kept.supports)), removed, wrong, marked)
