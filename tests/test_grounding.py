"""Grounding of a reader's plan: names in a question, restatements, stray facts, sources that hold what is asked."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import grounding

SESSIONS = {
    "matching": ["I reserved the Airbnb in San Francisco while working as a Software Engineer Manager."],
    "nearby-role": ["I lead four engineers as a Senior Software Engineer, and my manager joined us."],
    "nearby-place": ["I reserved an Airbnb in San Francisco three months in advance."],
    "unselected": ["This session was not selected."],
    "context": ["I am planning another visit to Bandung.", "There are many places.", "Which one served the dish?", "Miss Bee served it."],
    "wide": ["We met at the Ｃａｆé Ⅳ."],
}


def named(spark, question):
    return [tuple(a) for a in spark.createDataFrame([(question,)], "q string").select(grounding.anchors(F.col("q")).alias("a")).first().a]


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ('Which option replaced "Plan Alpha" for Rachel?', [("quoted_phrase", "Plan Alpha", "plan alpha"), ("capitalized_phrase", "Plan Alpha", "plan alpha"), ("capitalized_token", "Rachel", "rachel")]),
        ("I'm checking and I've wondered whether We're discussing what What's relevant for Admon.", [("capitalized_token", "Admon", "admon")]),
        ("Rachel's plan replaced GM's schedule after I'm told We're ready.", [("capitalized_token", "Rachel's", "rachel s"), ("capitalized_token", "GM's", "gm s")]),
        ("I'm asking about Software Engineer Manager in San Francisco for Rachel's team.", [("capitalized_phrase", "Software Engineer Manager", "software engineer manager"), ("capitalized_phrase", "San Francisco", "san francisco"), ("capitalized_token", "Rachel's", "rachel s")]),
        ("Where did I go, and did Bob see Bob or “Bob”?", [("quoted_phrase", "Bob", "bob"), ("capitalized_token", "Bob", "bob")]),
        ("Paris is where?", []), (" Paris is where?", [("capitalized_token", "Paris", "paris")]), ("", []), ("no names at all", []), ('"x" is too short', []),
    ],
)
def test_anchors(spark, question, want):
    assert named(spark, question) == want


@pytest.mark.parametrize(
    ("statement", "want"),
    [("When did I go?", True), ('The user asked: "When did I go?"', True), ("User asks when did I go", True), ("The question is: when did I go", True), ("query when did I GO", True), ("I went on Monday", False), ("", False), ("The user asked why", False)],
)
def test_restatements(spark, statement, want):
    assert spark.createDataFrame([("When did I go?", statement)], "q string, s string").select(grounding.restates(F.col("q"), F.col("s")).alias("x")).first().x is want


def test_compatible_form(spark):
    import unicodedata

    texts = ["plain", "é", "é", "Ⅳ ﬁ", "½", "ĳ", None, "", "ａ", "x y", "…"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", text.compatible(F.col("t")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)} | {7: ""}


def plan_of(spark, cases):
    """cases: question -> (question, status, mode, [(session, turn)], [pointers], [(statement, [sessions], [pointers])])."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    facts = [(q, i, f) for q, c in cases.items() for i, f in enumerate(c[5])]
    supports = [(q, i, s, None) for q, i, f in facts for s in f[1]] + [(q, i, None, p) for q, i, f in facts for p in f[2]]
    return grounding.Plan(
        make([(q, *c[:3]) for q, c in cases.items()], "question_id long, question string, support_status string, answer_mode string"),
        make([(q, *s) for q, c in cases.items() for s in c[3]], "question_id long, session_id string, turn_index long"),
        make([(q, p) for q, c in cases.items() for p in c[4]], "question_id long, pointer string"),
        make([(q, i, f[0]) for q, i, f in facts], "question_id long, fact_id long, statement string"),
        make(supports, "question_id long, fact_id long, session_id string, pointer string"),
    )


def test_plans_are_enforced(spark):
    fact = lambda s="It was in San Francisco.", sessions=("matching",), pointers=(): (s, list(sessions), list(pointers))
    role = "/context/employment/current/role"
    asked = "When did I reserve the Airbnb in Sacramento?"
    cases = {
        1: ("Where did I reserve the Airbnb as a Software Engineer Manager in San Francisco?", "sufficient", "direct", [("matching", 0)], [], [fact()]),
        2: ("How many engineers report to me as a Software Engineer Manager?", "sufficient", "direct", [("nearby-role", 0)], [], [fact(sessions=["nearby-role"])]),
        3: (asked, "sufficient", "direct", [("nearby-place", 0)], [], [fact(sessions=["nearby-place"])]),
        4: ("Which restaurant in Bandung served the dish?", "sufficient", "assistant_answer", [("context", 2), ("context", 3)], [], [fact("Miss Bee served it.", ["context"])]),
        5: ("What did I reserve in San Francisco?", "sufficient", "direct", [("matching", 0)], [], [fact(), fact("Unrelated.", ["unselected"])]),
        6: (asked, "sufficient", "direct", [("nearby-place", 0)], [], [fact(f'The user asked: "{asked}"', ["nearby-place"])]),
        7: ("What is my role as Software Engineer Manager?", "sufficient", "direct", [], [role], [fact("A manager.", [], [role])]),
        8: ("What was it?", "sufficient", "direct", [("gone", 0), ("matching", 7)], ["/context/none"], [fact()]),
        9: ("Who is Nobody Known?", "insufficient", "abstain", [], [], []),
        10: ("Who is it?", "partial", "direct", [("matching", 0)], [], []),
        11: ("Did we meet at Café IV there?", "sufficient", "direct", [("wide", None)], [], [fact("Yes.", ["wide"])]),
        12: ("Where is ﬁne Ⅸ Plan?", "sufficient", "direct", [("matching", 0)], [], [fact()]),
    }
    turns = spark.createDataFrame([(s, i, t) for s, ts in SESSIONS.items() for i, t in enumerate(ts)], "session_id string, turn_index long, content string")
    values = spark.createDataFrame([(7, role, '"Software Engineer Manager"', "string")], "question_id long, pointer string, value string, type string")
    got = grounding.enforced(plan_of(spark, cases), turns, values)
    wrong = {}
    for r in got.issues.collect():
        wrong.setdefault(r.question_id, set()).add((r.code, r.detail))
    unmatched, nothing = "unmatched_exact_surface_anchor", ("non_abstaining_plan_without_grounded_fact", None)
    assert wrong == {
        2: {(unmatched, "capitalized_phrase:software engineer manager")}, 3: {(unmatched, "capitalized_token:sacramento")}, 6: {(unmatched, "capitalized_token:sacramento"), nothing},
        8: {("unknown_selected_session", "gone"), ("unknown_selected_turn", "matching:7"), ("unknown_selected_graph_pointer", "/context/none")}, 10: {nothing}, 12: {(unmatched, "capitalized_phrase:ix plan")},
    }
    plans = {r.question_id: (r.support_status, r.answer_mode) for r in got.plan.plans.collect()}
    assert {q for q, p in plans.items() if p == ("insufficient", "abstain")} == {2, 3, 6, 8, 9, 10, 12} and plans[4] == ("sufficient", "assistant_answer")
    assert {tuple(r) for r in got.removed.collect()} == {(5, 1), (6, 0)}
    assert {(r.question_id, r.fact_id) for r in got.plan.facts.collect()} == {(1, 0), (4, 0), (5, 0), (7, 0), (11, 0)}
    assert {r.question_id for r in got.plan.selected.collect()} == {1, 4, 5, 11} and {r.question_id for r in got.plan.pointers.collect()} == {7}
    assert {(r.question_id, r.session_id) for r in got.plan.supports.collect()} == {(1, "matching"), (4, "context"), (5, "matching"), (7, None), (11, "wide")}


def test_issues_of_a_plan_as_given(spark):
    cases = {1: ("What was it?", "sufficient", "direct", [("matching", 0)], [], [("What was it", ["matching", "unselected"], []), ("x", [], ["/context/p"])])}
    p = plan_of(spark, cases)
    turns = spark.createDataFrame([("matching", 0, "x")], "session_id string, turn_index long, content string")
    values = spark.createDataFrame([], "question_id long, pointer string, value string, type string")
    got = {(r.code, r.detail) for r in grounding.issues(p, turns, values, grounding.matched_anchors(p, turns, values)).collect()}
    assert got == {("fact_session_not_selected", "0:unselected"), ("fact_graph_pointer_not_selected", "1:/context/p"), ("fact_has_no_selected_source", "1"), ("question_restatement_fact", "0")}


def test_no_plans(spark):
    empty = plan_of(spark, {})
    turns = spark.createDataFrame([], "session_id string, turn_index long, content string")
    got = grounding.enforced(empty, turns, spark.createDataFrame([], "question_id long, pointer string, value string, type string"))
    assert got.plan.plans.count() == got.issues.count() == got.anchors.count() == got.removed.count() == 0
