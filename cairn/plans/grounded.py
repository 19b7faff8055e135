"""Queries over grounding: plans that follow from retrieval, held against what their sessions say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import grounding
from ..sources import tables
from . import retrieval, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = oracle
        return f

    return add


def key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def contracted(x: str) -> str:
    return f"CASE WHEN list_contains({sql.strings(fixed.CONTRACTIONS)}, lower(regexp_extract({x}, {literal(fixed.CONTRACTED)}, 2))) THEN nullif({key(f'regexp_extract({x}, {literal(fixed.CONTRACTED)}, 1)')}, '') END"


FRAMING = sql.strings(fixed.FRAMING_WORDS)
SEQUENCE = literal(rf"{fixed.CAPITALISED}(?:\s+{fixed.CAPITALISED})*")
#: CTE anchors(question_id, kind, text, normalized) of asked(question_id, question).
ANCHORS = f"""caps AS (SELECT question_id, question, unnest(regexp_extract_all(question, {SEQUENCE})) AS t, generate_subscripts(regexp_extract_all(question, {SEQUENCE}), 1) AS i FROM asked),
told AS (SELECT *, regexp_matches(t, '\\s') AS several, {key('t')} AS normalized, {contracted('t')} AS base, ends_with(lower(t), 's') AND regexp_matches(t, '[''’]s$', 'i') AS own FROM caps),
named AS (SELECT question_id, 1000 + i AS place, CASE WHEN several THEN 'capitalized_phrase' ELSE 'capitalized_token' END AS kind, t AS text, normalized FROM told
  WHERE normalized <> '' AND (several OR NOT coalesce(list_contains({FRAMING}, base), false) AND (own AND base IS NOT NULL OR NOT (i = 1 AND starts_with(question, t)) AND NOT list_contains({FRAMING}, normalized)))),
quoted AS (SELECT question_id, i AS place, 'quoted_phrase' AS kind, trim(t) AS text, {key('t')} AS normalized FROM (SELECT question_id, unnest(regexp_extract_all(question, {literal(fixed.QUOTED)}, 1)) AS t, generate_subscripts(regexp_extract_all(question, {literal(fixed.QUOTED)}, 1), 1) AS i FROM asked) WHERE {key('t')} <> ''),
anchors AS (SELECT question_id, kind, normalized, arg_min(text, place) AS text FROM (FROM named UNION ALL FROM quoted) GROUP BY ALL)"""


@query("question_anchors", f"WITH asked AS (SELECT item_id AS question_id, text AS question FROM benchmark), {ANCHORS} SELECT question_id, kind, text, normalized FROM anchors")
def question_anchors(spark, sf_dir):
    return grounding.anchors_of(tables.questions(spark, sf_dir), "question_id", "question").drop("place")


@query("turn_anchors", f"WITH {sql.TURNS}, asked AS (SELECT session_id * 1000 + turn_index AS question_id, content AS question FROM turns), {ANCHORS} SELECT question_id, kind, text, normalized FROM anchors")
def turn_anchors(spark, sf_dir):
    t = tables.turns(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("turn_index")).alias("question_id"), "content")
    return grounding.anchors_of(t, "question_id", "content").drop("place")


def plan(spark, sf_dir) -> tuple[grounding.Plan, object]:
    """For each item: the sessions that routing finds are selected, each fact is the turn of a session that shares most terms with
    the item, over all sessions that the ranking of windows finds, selected or not."""
    q, turns = tables.questions(spark, sf_dir), tables.turns(spark, sf_dir)
    routed = retrieval.session_routing(spark, sf_dir).select("question_id", "session_id", F.lit(0).cast("long").alias("turn_index"))
    best = retrieval.best_turns(spark, sf_dir).where("rank = 1").join(retrieval.session_ranks(spark, sf_dir).select("question_id", "session_id"), ["question_id", "session_id"])
    facts = best.join(turns.select("session_id", F.col("turn_index").alias("line_no"), "content"), ["session_id", "line_no"]).select("question_id", F.col("session_id").alias("fact_id"), F.col("content").alias("statement"))
    supports = facts.select("question_id", "fact_id", F.col("fact_id").alias("session_id"), F.lit(None).cast("string").alias("pointer"))
    plans = q.select("question_id", "question", F.lit("sufficient").alias("support_status"), F.lit("direct").alias("answer_mode"))
    pointers = spark.createDataFrame([], "question_id long, pointer string")
    return grounding.Plan(plans, routed, pointers, facts, supports), turns


@query("grounded_plans", f"""WITH {sql.TURNS}, routed AS ({retrieval.SQL["session_routing"]}), best AS ({retrieval.SQL["best_turns"]}), tops AS ({retrieval.SQL["session_ranks"]}),
facts AS (SELECT b.question_id, b.session_id, t.content FROM best b JOIN tops USING (question_id, session_id) JOIN turns t ON t.session_id = b.session_id AND t.turn_index = b.line_no WHERE b.rank = 1),
asked AS (SELECT item_id AS question_id, text AS question FROM benchmark), {ANCHORS},
wraps AS (SELECT f.question_id, f.session_id, {key('question')} AS asked_key, regexp_replace(regexp_replace({key('content')}, {literal(fixed.WRAPPERS[0])}, ''), {literal(fixed.WRAPPERS[1])}, '') AS bare, {key('content')} AS said FROM facts f JOIN asked USING (question_id)),
kept AS (SELECT question_id, session_id FROM wraps JOIN routed USING (question_id, session_id) WHERE NOT (asked_key <> '' AND said <> '' AND (said = asked_key OR bare = asked_key))),
said AS (SELECT session_id, {key('content')} AS said FROM turns),
hits AS (SELECT DISTINCT a.question_id, a.kind, a.normalized FROM anchors a JOIN routed r USING (question_id) JOIN said s ON s.session_id = r.session_id AND contains(s.said, a.normalized)),
bad AS (SELECT question_id, 'unmatched_exact_surface_anchor' AS code FROM anchors a ANTI JOIN hits h ON h.question_id = a.question_id AND h.kind = a.kind AND h.normalized = a.normalized
  UNION ALL SELECT question_id, 'non_abstaining_plan_without_grounded_fact' FROM asked WHERE question_id NOT IN (SELECT question_id FROM kept)),
n AS (SELECT question_id, count(*) FILTER (WHERE code LIKE 'unmatched%') AS unmatched, bool_or(code LIKE 'non%') AS bare FROM bad GROUP BY ALL)
SELECT question_id, CASE WHEN n.question_id IS NULL THEN 'sufficient' ELSE 'insufficient' END AS support_status, coalesce(unmatched, 0) AS unmatched, coalesce(bare, false) AS no_fact,
(SELECT count(*) FROM facts f WHERE f.question_id = a.question_id) - (SELECT count(*) FROM kept k WHERE k.question_id = a.question_id) AS removed FROM asked a LEFT JOIN n USING (question_id)""")
def grounded_plans(spark, sf_dir):
    p, turns = plan(spark, sf_dir)
    got = grounding.enforced(p, turns, spark.createDataFrame([], "question_id long, pointer string, value string, type string"))
    told = got.issues.groupBy("question_id").agg(F.count_if(F.col("code").startswith("unmatched")).alias("unmatched"), F.bool_or(F.col("code").startswith("non_abstaining")).alias("no_fact"))
    gone = got.removed.groupBy("question_id").agg(F.count("*").alias("removed"))
    rows = got.plan.plans.join(told, "question_id", "left").join(gone, "question_id", "left")
    return rows.select("question_id", "support_status", F.coalesce("unmatched", F.lit(0)).alias("unmatched"), F.coalesce("no_fact", F.lit(False)).alias("no_fact"), F.coalesce("removed", F.lit(0)).alias("removed"))
