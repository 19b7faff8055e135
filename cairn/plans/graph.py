"""Queries over several kinds of documents at once, and over batches of updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels, ledger, spans, stages, windows
from ..sources import tables
from . import retrieval, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("anchor_refs", f"""WITH {sql.TURNS}, ask AS (SELECT item_id AS question_id, unnest({sql.package_terms('text')}) AS term FROM benchmark),
held AS (SELECT session_id, turn_index, unnest({sql.package_terms('content')}) AS term FROM turns),
s AS (SELECT question_id, session_id, turn_index, count(*) AS overlap FROM held JOIN ask USING (term) GROUP BY ALL),
v AS (SELECT question_id, session_id, turn_index, CAST(overlap * 10 + CASE WHEN role = 'assistant' AND contains(content, '?') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(content, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN turn_index % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS score
  FROM s JOIN turns USING (session_id, turn_index))
SELECT *, row_number() OVER (PARTITION BY question_id, session_id ORDER BY score DESC, turn_index) AS rank FROM v QUALIFY rank <= 10""")
def anchor_refs(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    return channels.anchor_refs(turns, tables.questions(spark, sf_dir), turns.where("turn_index % 4 = 0"))


def evidence(spark, sf_dir):
    rows = tables.turns(spark, sf_dir).select("session_id", "turn_index", F.col("content").alias("excerpt"), F.concat(F.lit("/"), "role").alias("pointer"))
    return windows.evidence_ledger(rows).withColumn("evidence_id", F.concat_ws("#", "session_id", "turn_index"))


@query("question_evidence")
def question_evidence(spark, sf_dir):
    said = windows.sentences_of(tables.turns(spark, sf_dir)).where("role = 'user'")
    signals = said.withColumn("signal_id", F.concat_ws("~", "session_id", "turn_index", "sentence_index"))
    return channels.question_evidence(evidence(spark, sf_dir), signals, tables.questions(spark, sf_dir))


@query("reader_focus")
def reader_focus(spark, sf_dir):
    pairs = windows.pair_windows(tables.turns(spark, sf_dir))
    docs = pairs.select(F.concat_ws("#", "session_id", "start_turn").alias("doc_id"), "session_id", "start_turn", "end_turn", "text", F.col("text").rlike("[0-9]").alias("digits"))
    return channels.reader_focus(docs, tables.questions(spark, sf_dir)).select("question_id", "session_id", "start_turn", "end_turn", F.round("score", 6).alias("score"), "session_rank", "rank")


@query("five_channels")
def five_channels(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    ids = F.array("session_id").alias("session_ids")
    whole = windows.role_view(turns, None).select(F.col("session_id").alias("doc_id"), ids, "text")
    cells = windows.session_index(turns).select(F.col("session_id").alias("doc_id"), ids, F.array_join("terms", " ").alias("text"))
    summaries = windows.session_index(turns).select(F.col("session_id").alias("doc_id"), ids, F.col("opener").alias("text"))
    loose = windows.claims(turns).where("claim_no = 1").select(F.col("session_id").alias("doc_id"), ids, F.col("sentence").alias("text"))
    tail = whole.orderBy(F.desc("doc_id")).limit(5)  # the newest sessions, which no batch has taken in yet
    docs = channels.channel_documents(whole, cells, summaries, loose, tail)
    return channels.five_channels(docs, tables.questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("seven_channels")
def seven_channels(spark, sf_dir):
    asked = tables.questions(spark, sf_dir)
    ranks = retrieval.session_ranks(spark, sf_dir).select("question_id", "session_id", "score")
    routed = retrieval.session_routing(spark, sf_dir).select("question_id", "session_id", F.col("score").cast("double").alias("score"))
    latest = tables.turns(spark, sf_dir).select("session_id").distinct().orderBy(F.desc("session_id")).limit(5).crossJoin(F.broadcast(asked.select("question_id"))).select("question_id", "session_id", F.col("session_id").cast("double").alias("score"))
    return channels.seven_channels({"bm25": ranks, "entity": routed, "latest": latest}).withColumn("score", F.round("score", 6))


@query("source_checks", f"""WITH {sql.TURNS}, u AS (SELECT doc_id AS id, doc_id % 130 AS session_id, doc_id % 8 AS turn_index FROM documents), n AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1)
SELECT id, n IS NOT NULL AND u.session_id % 2 = 0 AND turn_index < n AS accepted, CASE WHEN u.session_id % 2 = 1 OR n IS NULL THEN 'not in batch' WHEN turn_index >= n THEN 'no such turn' ELSE '' END AS reason FROM u LEFT JOIN n USING (session_id)""")
def source_checks(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    d = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 130).alias("session_id"), (F.col("doc_id") % 8).alias("turn_index"))
    return ledger.valid_sources(d, turns, turns.where("session_id % 2 = 0"))


@query("session_audit", """WITH b AS (SELECT DISTINCT conv_id AS s FROM conversations), c AS (SELECT s FROM b WHERE s % 3 = 0 UNION SELECT 100000), i AS (SELECT s FROM b WHERE s % 2 = 0)
SELECT s AS session_id, CASE WHEN s = 100000 THEN 'outside' WHEN s % 6 = 0 THEN 'cited and ignored' ELSE 'missing' END AS warning FROM (SELECT s FROM b UNION SELECT 100000) WHERE s = 100000 OR s % 6 = 0 OR (s % 3 <> 0 AND s % 2 <> 0)""")
def session_audit(spark, sf_dir):
    b = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    cited = b.where("session_id % 3 = 0").unionByName(spark.createDataFrame([(100000,)], "session_id long"))
    return ledger.session_audit(cited, b.where("session_id % 2 = 0"), b)


@query("admission", f"""WITH fused_top AS ({retrieval.FUSION}), r AS (SELECT question_id, session_id, rank FROM fused_top),
want AS (SELECT question_id, session_id, 100 - rank AS position FROM r WHERE question_id % 2 = 0 AND rank % 3 = 0),
v AS (SELECT question_id, session_id, row_number() OVER (PARTITION BY question_id ORDER BY position) AS place FROM want QUALIFY place <= 12)
SELECT question_id, session_id, place, false AS fallback FROM v UNION ALL
SELECT question_id, session_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS place, true FROM r WHERE question_id NOT IN (SELECT question_id FROM v) QUALIFY place <= 12""")
def admission(spark, sf_dir):
    pool = retrieval.fused(spark, sf_dir)
    wanted = pool.where((F.col("question_id") % 2 == 0) & (F.col("rank") % 3 == 0)).select("question_id", "session_id", (100 - F.col("rank")).alias("position"))
    return spans.admit(wanted, pool)


@query("stage_defaults", "SELECT item_id AS question_id, 1 AS n_lanes, text AS query FROM benchmark")
def stage_defaults(spark, sf_dir):
    plan = stages.DEFAULTS["plan"](tables.questions(spark, sf_dir))
    return plan.select("question_id", F.size("lanes").alias("n_lanes"), F.get("lanes", F.lit(0))["query"].alias("query"))
