"""Views and lanes: literal pools, facets, excerpts, the catalogue, terms dealt over tasks."""

from pyspark.sql import functions as F

from cairn.operators import views

TURNS = [("s1", "2025/01/01", 0, "user", "My bike is red"), ("s1", "2025/01/01", 1, "assistant", "Nice   bike"), ("s2", "2025/01/02", 0, "user", "A red house " + "z" * 400), ("s3", "", 0, "assistant", "nothing here")]
NOTES = "session_id string, facts array<struct<text:string,turn_index:long>>, events array<struct<text:string,date_hint:string,turn_index:long>>, keyphrases array<string>"


def inputs(spark):
    turns = spark.createDataFrame(TURNS, "session_id string, date string, turn_index long, role string, content string")
    notes = spark.createDataFrame([("s1", [("owns a red bike", 0)], [("bought it", "May", 0), ("rode", "", 1)], ["bike"])], NOTES)
    questions = spark.createDataFrame([(1, "Which bike is red?"), (2, "Any zebra?")], "question_id long, question string")
    queries = spark.createDataFrame([(1, 1, "red house", ["f2"]), (1, 2, "bike", ["f1", "f3"])], "question_id long, lane long, query string, facet_ids array<string>")
    return turns, notes, views.lanes_of(questions, queries)


def test_documents_of_views(spark):
    turns, notes, _ = inputs(spark)
    docs = {(r.view, r.session_id): r.text for r in views.view_documents(turns, notes).collect()}
    assert len(docs) == 12 and docs["all", "s1"] == "[source_view] all\n[user turn 0] My bike is red\n[assistant turn 1] Nice   bike"
    assert docs["assistant", "s1"] == "[source_view] assistant\n[assistant turn 0] Nice   bike" and docs["user", "s3"] == "[source_view] user\n"
    assert docs["notes", "s1"].endswith("[facts]\n- owns a red bike\n[keyphrases] bike\n[events]\n- bought it (May)\n- rode") and docs["notes", "s2"].endswith("[notes] (empty)")


def test_pool_excerpts_and_catalogue(spark, monkeypatch):
    turns, notes, lanes = inputs(spark)
    assert {(r.question_id, r.lane): r.facet_ids for r in lanes.collect()} == {(1, 0): ["f1", "f2", "f3"], (2, 0): [], (1, 1): ["f2"], (1, 2): ["f1", "f3"]}
    docs = views.view_documents(turns, notes)
    hits = views.lane_hits(docs, lanes).cache()
    ranks = {(r.lane, r.view): [] for r in hits.collect()}
    for r in hits.orderBy("rank").collect():
        ranks[r.lane, r.view].append(r.session_id)
    assert ranks == {(0, "notes"): ["s1"], (0, "user"): ["s1", "s2"], (0, "assistant"): ["s1"], (0, "all"): ["s1", "s2"], (1, "notes"): ["s1"], (1, "user"): ["s2", "s1"], (1, "all"): ["s2", "s1"], (2, "notes"): ["s1"], (2, "user"): ["s1"], (2, "assistant"): ["s1"], (2, "all"): ["s1"]}
    monkeypatch.setattr(views, "HOT", 0)  # every term is dealt over tasks
    same = lambda df: {tuple(r) for r in df.select("question_id", "lane", "view", "session_id", F.round("score", 9), "rank").collect()}
    assert same(views.lane_hits(docs, lanes)) == same(hits)
    pool = views.pooled(hits, lanes)
    rows = pool.orderBy("rank").collect()
    assert [(r.session_id, r.facets) for r in rows] == [("s1", ["f1", "f2", "f3"]), ("s2", ["f1", "f2", "f3"])]
    assert abs(rows[1].score - (1 / 62 + 1 / 62 + 1 / 61 + 1 / 61)) < 1e-12
    said = views.excerpts(hits, lanes, views.lines_of(turns, notes)).cache()
    by = {(r.session_id, r.lane, r.view): r.excerpt for r in said.collect()}
    assert by["s1", 0, "all"] == "all: USER turn 0: My bike is red | ASSISTANT turn 1: Nice bike"
    assert by["s1", 2, "notes"] == "notes: USER turn 0: owns a red bike | keyphrase: bike | USER turn 0 event (May): bought it | USER turn 1 event: rode"
    assert by["s2", 1, "user"] == "user: USER turn 0: A red house " + "z" * 247 + "…"
    text = views.catalogue(pool, said, turns).first().catalogue
    assert text.startswith("candidate 1: s1 date=2025/01/01 fused=0.") and "suggested_facets=[f1,f2,f3]\n- notes: USER turn 0: owns" in text and "\n\ncandidate 2: s2 date=2025/01/02" in text


def test_views_of_nothing(spark):
    turns, notes, lanes = inputs(spark)
    assert views.lane_hits(views.view_documents(turns.limit(0), notes.limit(0)), lanes).count() == 0
    assert views.lane_hits(views.view_documents(turns, notes), lanes.limit(0)).count() == 0
