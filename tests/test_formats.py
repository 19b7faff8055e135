"""Formatted texts, bounded excerpts, date ranges of side tables, slices and predictions on literal cases."""

import datetime
import json

from pyspark.sql import functions as F

from cairn.functions import dates, fixed, text
from cairn.operators import formats, sampling
from cairn.sources import tables

ITEM = "struct<session_id:string,date:string,turn_index:int,role:string,why:string,tier:string,text:string>"


def shown(spark, schema, value, make):
    return spark.createDataFrame([(value,)], f"v {schema}").select(make(F.col("v")).alias("t")).first().t


def test_package_text(spark):
    def package(items, status="found"):
        return shown(spark, f"array<{ITEM}>", items, lambda v: formats.package_text(v, F.lit("aggregate"), F.lit("apple counts"), F.lit(status), F.lit("n/a")))

    head = f"queryShape: aggregate\nsetBoundary: apple counts\ncandidateStatus: found\nmissingRisk: n/a"
    one = ("s1", "2023-01-01", 0, "user", "count", "selected", "I bought three apples.")
    more = ("s1", "2023-01-01", 2, "user", None, "supporting", "Then two more.")
    selected = "## SELECTED (matched the question)\n\n### item 2\nsession s1 | date 2023-01-01 | turn 0 | user\nwhy: count\nI bought three apples."
    support = "## SUPPORTING (same sessions; use when they bear on the question)\n\n### item 2\nsession s1 | date 2023-01-01 | turn 2 | user\nThen two more."
    assert package([more, one]) == f"{head}\n\n{selected}\n\n{support}"
    assert package([one]) == f"{head}\n\n{selected}"
    assert package([more]) == f"{head}\n\n## SELECTED (matched the question)\n\n(no selected turns)\n\n{support}"
    none = "\n\n## NO MATCHING TURNS FOUND\n(empty selected set; do not invent members)"
    assert package([]) == package(None) == head + none
    assert package([one], "none_found") == head.replace("found", "none_found") + none


def test_digest_text(spark):
    schema = "struct<f:array<struct<id:string,date:string,session_id:string,turn_index:int,statement:string>>,c:array<struct<entity:string,fact_ids:array<string>,note:string>>,m:array<struct<member:string,date:string,fact_id:string>>,o:string>"
    digest = lambda v: shown(spark, schema, v, lambda x: formats.digest_text(x.f, x.c, x.m, x.o))
    full = digest(([("f1", "2023-01-01", "s1", 0, "Three."), ("f2", "", "s1", None, "Two."), ("f3", None, None, 4, "One.")], [("apples", ["f1", "f2"], "differ")], [("three", "2023-01-01", "f1"), ("two", "", None)], " 　left out \n"))
    assert full == (
        "## FACTS (normalized from the context package)\n\n### f1\ndate 2023-01-01 | session s1 | turn 0\nThree.\n\n### f2\ndate unknown | session s1 | turn ?\nTwo."
        "\n\n### f3\ndate unknown | session unknown\nOne.\n\n## CONFLICTS (same entity, disagreeing claims — do not resolve)\n\n### conflict 1\nentity: apples\nfactIds: f1, f2\nnote: differ"
        "\n\n## SET MEMBERS (candidate members for count/order questions)\n\n1. three (date 2023-01-01 | factId f1)\n2. two (date unknown)\n\n## OMITTED / UNCERTAIN\nleft out"
    )
    empty = digest(([], [], None, "  "))
    assert empty.count("(none flagged)") == 2 and "(no facts extracted)" in empty and "OMITTED" not in empty


def test_spans_catalogue_index_facets_ledger(spark):
    schema = "array<struct<session_id:string,date:string,start_turn:int,end_turn:int,turns:array<struct<turn_index:int,role:string,content:string>>>>"
    spans = [("s1", "2023/01/01", 0, 1, [(0, "user", "a\nb" + "x" * 200), (1, "assistant", "c")]), ("s2", "2023/01/02", 3, 3, [(3, "user", "d")])]
    assert shown(spark, schema, spans, formats.spans_text) == (
        "### session s1 | date 2023/01/01 | turns 0-1\n[user sessionId=s1 turnIndex=0]\na\nb" + "x" * 200 + "\n\n[assistant sessionId=s1 turnIndex=1]\nc\n\n### session s2 | date 2023/01/02 | turns 3-3\n[user sessionId=s2 turnIndex=3]\nd"
    )
    assert shown(spark, schema, spans, formats.select_catalogue).split("\n") == [
        "- sessionId=s1 turnIndex=0 date=2023/01/01 role=user :: a b" + "x" * 157, "- sessionId=s1 turnIndex=1 date=2023/01/01 role=assistant :: c", "- sessionId=s2 turnIndex=3 date=2023/01/02 role=user :: d",
    ]
    assert shown(spark, schema, [], formats.spans_text) == fixed.NO_SPANS
    assert shown(spark, schema, None, formats.select_catalogue) == "(no turns in retrieval bundle)"
    index = [("s1", "2023/01/01", "Hi", ["pear", "plum"]), ("s2", "2023/01/02", "", [])]
    schema = "array<struct<session_id:string,date:string,opener:string,terms:array<string>>>"
    assert shown(spark, schema, index, formats.index_text) == "- sessionId=s1 | date 2023/01/01\n  opener: Hi\n  terms: pear, plum\n- sessionId=s2 | date 2023/01/02\n  opener: \n  terms: n/a"
    assert shown(spark, schema, [], formats.index_text) == "(no sessions)"
    facets = [("f1", "entity", 2, "which pears", ["pear", "fruit"])]
    assert shown(spark, "array<struct<id:string,kind:string,required:int,description:string,terms:array<string>>>", facets, formats.facets_text) == "f1 [entity] required=2: which pears | terms=pear, fruit"
    ledger = [("s2", "", 0.5, ["f1"], ["a", "b", "c", "d", "e"]), ("s1", "2023/01/01", 0.5, ["f1", "f2"], ["z"]), ("s3", None, 2.0, [], ["y"])]
    schema = "array<struct<session_id:string,date:string,score:double,facet_ids:array<string>,excerpts:array<string>>>"
    assert shown(spark, schema, ledger, formats.ledger_text) == "s3 date=(unknown) best_score=2.000 searched_facets=[]\n- y\n\ns1 date=2023/01/01 best_score=0.500 searched_facets=[f1,f2]\n- z\n\ns2 date=(unknown) best_score=0.500 searched_facets=[f1]\n- a\n- b\n- c\n- d"
    assert shown(spark, schema, [], formats.ledger_text) == "(empty)"


def test_excerpts_split_no_grapheme(spark):
    cut = lambda s, n=20: shown(spark, "string", s, lambda v: text.excerpt(v, n))
    assert cut(None) is None and cut("") == "" and cut("x" * 20) == "x" * 20
    # 17 units are left: 11 ahead, 6 behind
    assert cut("abcdefghijklmnopqrstuvwxyz") == "abcdefghijk\n…\nuvwxyz"
    face, accented = "\U0001f600", "é"
    assert cut(face * 10) == face * 10 and cut(face * 11) == face * 5 + "\n…\n" + face * 3
    assert cut(accented * 30) == accented * 5 + "\n…\n" + accented * 3
    # a grapheme that does not fit ends the tail, though what stands before it would
    assert cut("a" * 30 + "e" + "́" * 9) == "a" * 11 + "\n…\n"
    long = shown(spark, "string", "ab" * 5000, lambda v: text.excerpt(v))
    assert len(long) == 600 and long[388:391] == "\n…\n"


def test_ranges_of_files_and_folders(spark, tmp_path):
    entry = {"has_temporal_constraint": True, "start_date": "2023-05-01T00:00", "end_date": "2023-05-09"}
    read = lambda p: {r.question_id: r.found.start_date for r in tables.read_ranges(spark, str(p)).collect()}
    (tmp_path / "one.json").write_text(json.dumps({"ranges": {"q1": entry}}))
    (tmp_path / "two.json").write_text(json.dumps({"q2": entry, "q3": {}}))
    assert read(tmp_path / "one.json") == {"q1": "2023-05-01T00:00"} and read(tmp_path / "two.json") == {"q2": "2023-05-01T00:00", "q3": None}
    for name, indexed in ("a", False), ("b", True):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "q 7.json").write_text(json.dumps(entry))
        (folder / "x.json").write_text(json.dumps(entry | {"question_id": "q8"}))
        (folder / "_notes.json").write_text(json.dumps(entry | {"question_id": "q9"}))
        if indexed:
            (folder / "_index.json").write_text(json.dumps({"ranges": {"q1": entry}}))
        assert set(read(folder)) == ({"q1"} if indexed else {"q 7", "q8"})


def test_resolved_range(spark):
    day = datetime.date(2023, 6, 10)
    rows = [
        ("flagged", (True, "2023-05-01T00:00", "2023-05-09")), ("not flagged", (False, "2023-05-01", "2023-05-09")), ("half", (True, "2023-05-01", None)), ("no date", (True, "soon", "2023-05-09")), ("none", None),
    ]
    got = spark.createDataFrame(rows, f"k string, found {tables.RANGE}").select("k", dates.resolved_range(F.col("found"), F.lit("What about yesterday?"), F.lit(day), 1).alias("r")).collect()
    inferred = (datetime.date(2023, 6, 7), datetime.date(2023, 6, 11))
    want = {k: inferred for k, _ in rows} | {"flagged": (datetime.date(2023, 4, 30), datetime.date(2023, 5, 10))}
    assert {r.k: tuple(r.r) for r in got} == want


def test_slices(spark):
    asked = spark.createDataFrame([(f"q{i}", i, i == 3) for i in range(40)], "question_id string, position int, abstains boolean")
    told = spark.createDataFrame([(f"q{i}", None if i == 5 else 9 if i in (1, 7) else i if i < 30 else 2) for i in range(38)], "question_id string, worst int")
    rows = sampling.slices(asked, told).collect()
    of = lambda name: [r.question_id for r in sorted((r for r in rows if r.slice == name), key=lambda r: (r.part, -(r.worst or 0) if r.part == 0 else 0, r.position))]
    hard = ["q5", *[f"q{i}" for i in range(29, 9, -1)], "q1", "q7", "q9", "q8", "q6"]
    assert of("all") == [f"q{i}" for i in range(40)] and of("answerable") == [f"q{i}" for i in range(40) if i != 3]
    assert of("hard") == hard and of("hard12") == hard[:12]
    assert of("hard50") == hard + ["q0", "q2", "q4", *[f"q{i}" for i in range(30, 38)]]


def test_official_predictions(spark):
    rows = spark.createDataFrame([("q1", "two", 3.0), ("q2", None, 1.0)], "question_id string, hypothesis string, cost double")
    assert [r.value for r in tables.official_predictions(rows).collect()] == ['{"hypothesis":"two","question_id":"q1"}', '{"hypothesis":null,"question_id":"q2"}']
