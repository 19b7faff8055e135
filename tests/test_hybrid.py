"""Five channels of a case: documents, limits, sessions once, tails whole, scores against plain BM25."""

import math
from collections import Counter

from pyspark.sql import functions as F
from test_tree import UPDATES, update

from cairn.functions import text
from cairn.operators import hybrid, tree

SAID = "case_id string, position long, session_id string, date string, text string"


def plain_scores(spark, docs, question):
    """doc_id -> score, by the textbook formula over one index."""
    cut = lambda ts: [r.t for r in spark.createDataFrame(list(enumerate(ts)), "i long, s string").orderBy("i").select(text.tokens(F.col("s")).alias("t")).collect()]
    names, toks = list(docs), cut(list(docs.values()))
    mean, n = sum(map(len, toks)) / len(toks), len(toks)
    df = Counter(t for d in toks for t in set(d))
    out = {}
    for name, d in zip(names, toks, strict=True):
        tf = Counter(d)
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) + 0.15 * any(c.isdigit() for c in t) for t in set(cut([question])[0]) if t in tf)
        if score:
            out[name] = score
    return out


def test_cell_documents(spark):
    rows = [update(1, "m/count", 3, "observe", "measurement", "2025-01-01", session="s1"), update(2, "m/count", 4, "observe", "measurement", "2025-02-01", session="s2"), update(3, "p/name", "Ann", session="s2")]
    done = tree.decisions(spark.createDataFrame(rows, UPDATES))
    excerpts = spark.createDataFrame([("c", "s1", 0, "three of them"), ("c", "s2", 0, "four now")], "case_id string, session_id string, turn_index long, excerpt string")
    got = {r.pointer: r for r in hybrid.cell_documents(tree.cells(done), tree.history(done), tree.provenance(done), excerpts).collect()}
    count = got["/context/m/count"]
    assert count.session_ids == ["s1", "s2"] and count.text.startswith('/context/m/count\n{"kind":"measurement","current":{') and count.text.endswith("\nthree of them\nfour now")
    assert '"history":{"observation_' in count.value and got["/context/p/name"].session_ids == ["s2"] and '"history":{}}' in got["/context/p/name"].value


def inputs(spark):
    said = [("c", i, f"s{i % 14}", "2025/01/01", f"session_id: s{i % 14}\n[user] bike number {i} " + "red " * (i % 4)) for i in range(16)] + [("d", 0, "s0", "", "bike of another case")]
    cells = [("c", f"/context/x{i}", "v", [f"s{i}"], f"/context/x{i}\nred bike {i}") for i in range(15)]
    summaries = [("c", f"w{i}", [f"s{i}", "s13"], f"a red week {i}") for i in range(6)]
    signals = [("c", f"g{i}", f"s{i}", f"red signal {i}", "session_index_fallback" if i % 2 else "graph_covered") for i in range(14)] + [("c", "g1", "s1", "red signal 1", "session_index_fallback")]
    make = spark.createDataFrame
    return (
        make(said, SAID), make(cells, "case_id string, pointer string, value string, session_ids array<string>, text string"), make(summaries, "case_id string, window_id string, session_ids array<string>, summary string"),
        make(signals, "case_id string, signal_id string, session_id string, text string, status string"), make([("c", 12)], "case_id string, count long"),
    )


def test_channels_of_a_case(spark):
    docs = hybrid.documents(*inputs(spark)).cache()
    counts = Counter((r.case_id, r.channel) for r in docs.collect())
    assert counts == {("c", "session"): 16, ("c", "graph_cell"): 15, ("c", "summary"): 6, ("c", "coverage_fallback"): 7, ("c", "tail"): 4, ("d", "session"): 1, ("d", "tail"): 1}
    whole = {r.doc_id: r.text for r in docs.where("case_id = 'c' and channel = 'session'").collect()}
    assert whole["session:000013:s13"].endswith("\n".join(f"summary w{i}: a red week {i}" for i in range(6))) and "/context/x3\nred bike 3" in whole["session:000003:s3"]
    questions = spark.createDataFrame([("c", 1, "Which red bike number 5?"), ("d", 2, "red bike"), ("c", 3, "nothing of that")], "case_id string, question_id long, question string")
    got = {}
    for r in hybrid.candidates(docs, questions).orderBy("rank").collect():
        got.setdefault((r.question_id, r.channel), []).append(r)
    assert {k: len(v) for k, v in got.items()} == {(1, "session"): 12, (1, "graph_cell"): 12, (1, "summary"): 4, (1, "coverage_fallback"): 4, (1, "tail"): 4, (2, "session"): 1, (2, "tail"): 1, (3, "tail"): 4}
    for channel in ("session", "graph_cell", "summary", "coverage_fallback", "tail"):
        plain = plain_scores(spark, {r.doc_id: r.text for r in docs.where(f"case_id = 'c' and channel = '{channel}'").collect()}, "Which red bike number 5?")
        rows = got[1, channel]
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and all(abs(r.score - plain.get(r.doc_id, 0.0)) < 1e-9 for r in rows)
        assert min(r.score for r in rows) >= sorted(plain.values(), reverse=True)[: len(rows)][-1] - 1e-9 or channel in ("session", "tail")
    names = [r.session_ids[0] for r in got[1, "session"]]
    assert len(set(names)) == 12 and [r.doc_id for r in got[3, "tail"]] == ["tail:000012:s12", "tail:000013:s13", "tail:000014:s0", "tail:000015:s1"]


def test_an_empty_case(spark):
    said, cells, summaries, signals, tracked = inputs(spark)
    docs = hybrid.documents(said.limit(0), cells.limit(0), summaries.limit(0), signals.limit(0), tracked)
    questions = spark.createDataFrame([("c", 1, "bike")], "case_id string, question_id long, question string")
    assert docs.count() == 0 and hybrid.candidates(docs, questions).count() == 0
