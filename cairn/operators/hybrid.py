"""RK7, DB7, DB8: what a case holds as documents of five channels, and the candidates that a question finds in its case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .rank import best, ranked
from .views import lane_hits

#: Candidates of each channel; the tail comes whole.
LIMITS = {"session": 12, "graph_cell": 12, "summary": 4, "coverage_fallback": 4}
K1, B = 1.2, 0.75


def cell_documents(cells: DataFrame, history: DataFrame, provenance: DataFrame, excerpts: DataFrame) -> DataFrame:
    """DB8: a document a cell of ``tree.cells``: its pointer, the cell as JSON, and its sources' excerpts; (case_id, pointer,
    value, session_ids, text). ``excerpts(case_id, session_id, turn_index, excerpt)``; sources are those at or below the cell."""
    own = cells.select("case_id", "pointer")
    parts = F.split("pointer", "/")
    above = F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    below = provenance.select("case_id", "session_id", "turn_index", above.alias("pointer")).distinct().join(own, ["case_id", "pointer"])
    said = below.join(excerpts, ["case_id", "session_id", "turn_index"], "left").select("case_id", "pointer", "session_id", "excerpt").distinct()
    who = said.groupBy("case_id", "pointer").agg(F.array_sort(F.collect_set("session_id")).alias("session_ids"), F.transform(F.filter(F.array_sort(F.collect_list(F.struct("session_id", "excerpt"))), lambda x: x.excerpt.isNotNull()), lambda x: x.excerpt).alias("said"))
    past = history.groupBy("case_id", "pointer").agg(F.array_sort(F.collect_list(F.concat(F.lit('"'), "retired_key", F.lit('":'), "retired"))).alias("past"))
    none = F.array().cast("array<string>")
    rows = cells.join(past, ["case_id", "pointer"], "left").join(who, ["case_id", "pointer"], "left")
    value = F.concat(F.lit('{"kind":"'), "kind", F.lit('","current":'), "current", F.lit(',"history":{'), F.array_join(F.coalesce("past", none), ","), F.lit("}}"))
    rows = rows.withColumn("value", value)
    return rows.select("case_id", "pointer", "value", F.coalesce("session_ids", none).alias("session_ids"), F.array_join(F.concat(F.array("pointer", "value"), F.coalesce("said", none)), "\n").alias("text"))


def rendered(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions (case_id, position, session_id, date) with ``text``: id, date and turns in lines."""
    lines = turns.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))), lambda t: F.concat(F.lit("["), t.role, F.lit("] "), t.content)).alias("lines"))
    head = F.array(F.concat(F.lit("session_id: "), F.col("session_id").cast("string")), F.concat(F.lit("date: "), "date"))
    return sessions.join(lines, "session_id", "left").select("case_id", "position", "session_id", "date", F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("text"))


def documents(said: DataFrame, cells: DataFrame, summaries: DataFrame, signals: DataFrame, tracked: DataFrame) -> DataFrame:
    """DB7: (case_id, channel, doc_id, session_ids, text) of the five channels.

    ``said``: ``rendered`` sessions; ``cells``: ``cell_documents``; ``summaries(case_id, window_id, session_ids, summary)``;
    ``signals(case_id, signal_id, session_id, text, status)``, of which the uncovered count, each once; ``tracked(case_id,
    count)``: how many of a case's first sessions its tree has taken in, the others being the tail. A session's document
    carries the cells and summaries that name it, gathered by joins on the session.
    """
    place = F.lpad(F.col("position").cast("string"), 6, "0")
    key = ["case_id", "session_id"]
    more = cells.select("case_id", F.explode("session_ids").alias("session_id"), F.lit(0).alias("part"), F.col("pointer").alias("of"), "text")
    told = F.concat(F.lit("summary "), "window_id", F.lit(": "), "summary")
    more = more.unionByName(summaries.select("case_id", F.explode(F.col("session_ids").cast("array<string>")).alias("session_id"), F.lit(1).alias("part"), F.col("window_id").alias("of"), told.alias("text")))
    extra = more.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "of", "text"))), lambda x: x.text).alias("more"))
    own = said.withColumn("session_id", F.col("session_id").cast("string"))
    wide = own.join(extra, key, "left").select("case_id", F.lit("session").alias("channel"), F.concat(F.lit("session:"), place, F.lit(":"), "session_id").alias("doc_id"), F.array("session_id").alias("session_ids"), F.array_join(F.concat(F.array("text"), F.coalesce("more", F.array().cast("array<string>"))), "\n").alias("text"))
    graph = cells.select("case_id", F.lit("graph_cell").alias("channel"), F.concat(F.lit("graph:"), "pointer").alias("doc_id"), "session_ids", "text")
    ids = F.col("session_ids").cast("array<string>")
    windows = summaries.select("case_id", F.lit("summary").alias("channel"), F.concat(F.lit("summary:"), "window_id").alias("doc_id"), ids.alias("session_ids"), F.concat_ws("\n", "window_id", F.array_join(ids, " "), "summary").alias("text"))
    loose = signals.where("status = 'session_index_fallback'").groupBy("case_id", "signal_id").agg(F.min(F.struct(F.col("session_id").cast("string").alias("session_id"), "text")).alias("s"))
    loose = loose.select("case_id", F.lit("coverage_fallback").alias("channel"), F.concat(F.lit("coverage:"), "signal_id").alias("doc_id"), F.array("s.session_id").alias("session_ids"), F.concat_ws("\n", "s.session_id", "s.text").alias("text"))
    tail = own.join(tracked, "case_id", "left").where(F.col("position") >= F.coalesce("count", F.lit(0)))
    tail = tail.select("case_id", F.lit("tail").alias("channel"), F.concat(F.lit("tail:"), place, F.lit(":"), "session_id").alias("doc_id"), F.array("session_id").alias("session_ids"), "text")
    return wide.unionByName(graph).unionByName(windows).unionByName(loose).unionByName(tail)


def candidates(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """RK7: for ``questions(case_id, question_id, question)`` the candidates of each channel of its case: case_id, question_id,
    channel, doc_id, session_ids, score, matched, rank.

    BM25 within each channel of the case, the best 12 sessions, 12 cells, 4 summaries and 4 uncovered signals; a session that
    has several documents counts once, by its best. The tail comes whole: what matches first, the rest by id at score 0.
    """
    lanes = questions.select("case_id", "question_id", F.lit(0).cast("long").alias("lane"), F.col("question").alias("query"))
    hits = lane_hits(docs.select("case_id", F.col("channel").alias("view"), F.col("doc_id").alias("session_id"), "text"), lanes, None, K1, B, fixed.TEMPORAL_BOOST, ("case_id",))
    hits = hits.select("case_id", "question_id", F.col("view").alias("channel"), F.col("session_id").alias("doc_id"), "score", "matched")
    named = docs.select("case_id", "channel", "doc_id", "session_ids")
    order = [best("score"), F.desc("matched"), F.asc("doc_id")]
    found = hits.where("channel <> 'tail' and score > 0").join(named, ["case_id", "channel", "doc_id"])
    one = Window.partitionBy("case_id", "question_id", "channel", F.when(F.col("channel") == "session", F.get("session_ids", F.lit(0))).otherwise(F.col("doc_id"))).orderBy(*order)
    found = found.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    limit = F.create_map(*[F.lit(x) for pair in LIMITS.items() for x in pair])
    found = ranked(found, ["case_id", "question_id", "channel"], order).where(F.col("rank") <= limit[F.col("channel")])
    tail = named.where("channel = 'tail'").join(questions.select("case_id", "question_id"), "case_id")
    tail = tail.join(hits.where("channel = 'tail'").drop("channel"), ["case_id", "question_id", "doc_id"], "left").withColumns({"score": F.coalesce("score", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(0))})
    columns = ["case_id", "question_id", "channel", "doc_id", "session_ids", "score", "matched", "rank"]
    return found.select(*columns).unionByName(ranked(tail, ["case_id", "question_id", "channel"], order).select(*columns))
