"""Literal cases of the reader's guards and formats."""

from pyspark.sql import functions as F

from cairn.operators import reader


def test_refs_and_warnings(spark):
    chosen = spark.createDataFrame([(1, 10, 0), (1, 10, 0), (1, 11, 9), (1, 12, 0), (1, 13, 1)], "question_id long, session_id long, turn_index long")
    candidates = spark.createDataFrame([(1, 10), (1, 11), (1, 13), (2, 12)], "question_id long, session_id long")
    sizes = spark.createDataFrame([(10, 2), (11, 2), (12, 2), (13, 2)], "session_id long, n long")
    refs, warnings = reader.sanitised_refs(chosen, candidates, sizes)
    assert sorted(map(tuple, refs.collect())) == [(1, 10, 0), (1, 13, 1)]
    assert sorted(map(tuple, warnings.collect())) == [(1, 10, "invalid turns"), (1, 11, "no valid turn"), (1, 12, "unknown session")]


def test_verdict_abstains_without_evidence(spark):
    plans = spark.createDataFrame([(1, "sufficient", "direct"), (2, "sufficient", "direct"), (3, "partial", "count")], "question_id long, support_status string, answer_mode string")
    refs = spark.createDataFrame([(1, 10, 0)], "question_id long, session_id long, turn_index long")
    facts = spark.createDataFrame([(3, 1, 1, 0)], "question_id long, fact_id long, sessions long, pointers long")
    got = {r.question_id: (r.support_status, r.answer_mode) for r in reader.reader_verdict(plans, refs, facts).collect()}
    assert got == {1: ("sufficient", "direct"), 2: ("insufficient", "abstain"), 3: ("partial", "count")}


def test_only_blank_insufficient_answers_are_replaced(spark):
    rows = [(1, " \n", "insufficient"), (2, "7", "insufficient"), (3, "", "sufficient"), (4, None, "insufficient")]
    got = {r.question_id: r.hypothesis for r in reader.substituted(spark.createDataFrame(rows, "question_id long, hypothesis string, support_status string")).collect()}
    assert got[1] == got[4] and got[1].startswith("The available") and (got[2], got[3]) == ("7", "")


def test_repair(spark):
    turns = spark.createDataFrame([(s, i, "user" if i % 2 == 0 else "assistant") for s in (10, 11) for i in range(4)], "session_id long, turn_index long, role string")
    columns = "question_id long, position long, session_id long, turn_index long"
    items = spark.createDataFrame([(1, 1, 10, 2), (1, 2, 10, 1), (2, 1, 99, 0)], columns)
    anchors = spark.createDataFrame([(q, n + 1, s, 0) for q in (1, 2) for n, s in enumerate((10, 11))], columns)
    shapes = spark.createDataFrame([(1, "lookup"), (2, "lookup")], "question_id long, shape string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in reader.repaired(items, anchors, shapes, turns).orderBy("question_id", "place").collect()]
    assert got == [
        (1, 10, 2, "chosen"), (1, 10, 3, "adjacent"), (1, 10, 1, "adjacent"), (1, 10, 0, "adjacent"),
        (2, 10, 0, "fallback"), (2, 10, 1, "adjacent"), (2, 11, 0, "fallback"), (2, 11, 1, "adjacent"),
    ]
    counted = reader.repaired(items, anchors, shapes.withColumn("shape", F.lit("order")), turns, most=6).where("question_id = 1").orderBy("place").collect()
    assert [tuple(r)[2:] for r in counted][4:] == [(11, 0, "coverage"), (11, 1, "adjacent")]


def test_gathering_questions_without_items_are_covered(spark):
    turns = spark.createDataFrame([(10, 0, "user")], "session_id long, turn_index long, role string")
    columns = "question_id long, position long, session_id long, turn_index long"
    got = reader.repaired(spark.createDataFrame([], columns), spark.createDataFrame([(1, 1, 10, 0), (2, 1, 10, 0)], columns), spark.createDataFrame([(1, "aggregate"), (2, "lookup")], "question_id long, shape string"), turns)
    assert {(r.question_id, r.why) for r in got.collect()} == {(1, "coverage"), (2, "fallback")}


def test_pointers_stand_and_are_warned_of(spark):
    chosen = spark.createDataFrame([(1, "/context/a"), (1, "/context/a"), (1, "/context/b"), (2, "/context/a")], "question_id long, pointer string")
    kept, told = reader.sanitised_pointers(chosen, spark.createDataFrame([(1, "/context/a")], "question_id long, pointer string"))
    assert [tuple(r) for r in kept.collect()] == [(1, "/context/a")]
    assert {tuple(r) for r in told.collect()} == {(1, "reader removed unknown graph pointer: /context/b"), (2, "reader removed unknown graph pointer: /context/a")}
    plans = spark.createDataFrame([(1, "sufficient", "direct"), (2, "sufficient", "direct")], "question_id long, support_status string, answer_mode string")
    none = spark.createDataFrame([], "question_id long")
    got = {r.question_id: r.answer_mode for r in reader.reader_verdict(plans, none, none, kept).collect()}
    assert got == {1: "direct", 2: "abstain"}


def test_fact_warnings(spark):
    facts = [(1, 1, 10, None), (1, 1, 11, None), (1, 2, None, "/p"), (1, 2, None, "/q"), (1, 3, 12, None), (1, 4, None, None)]
    candidates = spark.createDataFrame([(1, 10), (1, 12)], "question_id long, session_id long")
    got = reader.fact_warnings(spark.createDataFrame(facts, "question_id long, fact_id long, session_id long, pointer string"), candidates, spark.createDataFrame([(1, "/p")], "question_id long, pointer string"), spark.createDataFrame([(10,), (11,)], "session_id long"))
    assert sorted((r.fact_id, r.warning) for r in got.collect()) == [
        (1, "reader removed unknown fact session: 11"), (2, "reader removed unknown fact pointer: /q"), (3, "reader removed unknown fact session: 12"),
        (3, "reader removed unsupported evidence fact"), (4, "reader removed unsupported evidence fact"),
    ]


def test_history_as_text_and_json(spark):
    turns = spark.createDataFrame([(2, 0, "user", 'a "b"', "2023/01/02"), (1, 1, "assistant", "d", "2023/01/03"), (1, 0, "user", "c\n", "2023/01/03")], "session_id long, turn_index long, role string, content string, date string")
    case = F.lit(1)
    text = reader.full_history(turns, case).first().history
    assert text == '### Session 1:\nSession Date: 2023/01/02\nSession Content:\nuser: a "b"\n\n### Session 2:\nSession Date: 2023/01/03\nSession Content:\nuser: c\n\nassistant: d'
    as_json = reader.full_history(turns, case, as_json=True).first().history
    assert as_json.endswith('[{"role": "user", "content": "c\\n"}, {"role": "assistant", "content": "d"}]') and '"a \\"b\\""' in as_json


def test_any_term_without_terms(spark):
    docs = spark.createDataFrame([(1, "Some Text")], "doc_id long, text string")
    assert reader.any_term(docs, [" "]).count() == 0 and reader.any_term(docs, ["TEXT"]).count() == 1


def test_series(spark):
    got = spark.createDataFrame([("a_b_12",), ("a_",), ("7",)], "s string").select(reader.series(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["a_b", "a_", "7"]
