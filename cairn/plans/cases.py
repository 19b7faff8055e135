"""Queries over cases: ten conversations are one case, with a tree, summaries and a tail; packages and samples of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import canary, hybrid, package, tree, windows
from ..sources import tables
from . import retrieval

QUERIES, SQL = {}, {}


def query(name: str, oracle: str = ""):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def case_of():
    return F.floor(F.col("session_id") / 10).cast("string")


def case_inputs(spark, sf_dir):
    """A case's sessions in order; its tree holds the opener of each session that a batch of three has taken in; each such batch
    has a summary of its sessions' terms; sentences with a number in them are signals, covered if the opener has them."""
    turns = tables.turns(spark, sf_dir)
    by = Window.partitionBy("case_id")
    days = turns.select(case_of().alias("case_id"), "session_id", "date").distinct()
    sessions = days.withColumn("position", F.row_number().over(by.orderBy("session_id")) - 1).withColumn("n", F.count("*").over(by))
    tracked = sessions.select("case_id", (F.col("n") - F.col("n") % 3).alias("count")).distinct()
    index = windows.session_index(turns).join(sessions, "session_id").where(F.col("position") < F.col("n") - F.col("n") % 3).persist()
    batch = F.concat(F.lit("b"), F.floor(F.col("position") / 3).cast("string"))
    name = F.col("session_id").cast("string")
    source = F.array(F.struct(name.alias("session_id"), F.lit(0).cast("long").alias("turn_index"), F.col("date").alias("date"), batch.alias("batch_id")))
    empty = F.lit(None).cast("string")
    updates = index.select(
        "case_id", F.col("session_id").alias("seq"), batch.alias("batch_id"), F.lit("chats").alias("domain"), F.array(F.concat(F.lit("chat_"), name), F.lit("opener")).alias("path"), F.lit("fact").alias("kind"), F.lit("set").alias("mode"),
        F.expr("substr(to_json(array(opener)), 2, length(to_json(array(opener))) - 2)").alias("value"), empty.alias("effective_at"), F.col("date").alias("observed_at"), empty.alias("unit"), F.lit("").alias("reason"), empty.alias("problem"), source.alias("sources"),
    )
    done = tree.decisions(updates).persist()  # a row a session, used for cells, history and provenance
    excerpts = turns.where("turn_index = 0").select(case_of().alias("case_id"), name.alias("session_id"), "turn_index", F.col("content").alias("excerpt"))
    cells = hybrid.cell_documents(tree.cells(done), tree.history(done), tree.provenance(done), excerpts)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("session_id", "terms"))), lambda x: F.concat_ws(" ", x.session_id.cast("string"), F.array_join(x.terms, " ")))
    summaries = index.groupBy("case_id", F.concat_ws(".", "case_id", batch).alias("window_id")).agg(F.array_sort(F.collect_list("session_id")).alias("session_ids"), F.array_join(listed, "; ").alias("summary"))
    said = windows.sentences_of(turns).where(F.col("sentence").rlike("[0-9]")).join(index.select("session_id", "opener"), "session_id")
    signals = said.select(case_of().alias("case_id"), F.concat_ws("~", "session_id", "turn_index", "sentence_index").alias("signal_id"), "session_id", F.col("sentence").alias("text"), F.when(F.contains("opener", F.col("sentence")), "graph_covered").otherwise("session_index_fallback").alias("status"))
    return hybrid.documents(hybrid.rendered(sessions.drop("n"), turns), cells, summaries, signals, tracked)


@query("case_documents")
def case_documents(spark, sf_dir):
    return case_inputs(spark, sf_dir).withColumn("session_ids", F.array_join("session_ids", " "))


@query("case_candidates")
def case_candidates(spark, sf_dir):
    """Each session's first user turn, asked of its case: what the five channels find."""
    first = tables.turns(spark, sf_dir).where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn_index").alias("question"))
    found = hybrid.candidates(case_inputs(spark, sf_dir).persist(), first.select(case_of().alias("case_id"), F.col("session_id").alias("question_id"), "question"))
    return found.select("question_id", "channel", "doc_id", F.array_join("session_ids", " ").alias("session_ids"), F.round("score", 6).alias("score"), "rank")


def chosen(spark, sf_dir) -> tuple[package.Chosen, object]:
    """Routed sessions with their best turns are selected; each best turn is a fact of its session."""
    turns, q = tables.turns(spark, sf_dir), tables.questions(spark, sf_dir)
    routed = retrieval.session_routing(spark, sf_dir).select("question_id", "session_id", F.col("rank").alias("at"))
    best = retrieval.best_turns(spark, sf_dir).join(routed, ["question_id", "session_id"]).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("at", "rank")) - 1).persist()
    selected = best.select("question_id", "place", "session_id", F.when(F.col("rank") == 1, "direct_answer").otherwise("context").alias("purpose"), F.col("line_no").alias("turn_index"))
    facts = best.join(turns.select("session_id", F.col("turn_index").alias("line_no"), "content"), ["session_id", "line_no"]).select("question_id", "place", F.col("content").alias("statement"), F.array(F.col("session_id").cast("string")).alias("session_ids"), F.array().cast("array<string>").alias("pointers"))
    none = lambda schema: spark.createDataFrame([], schema)
    plans = q.select("question_id", F.lit("sufficient").alias("support_status"), F.lit("direct").alias("answer_mode"))
    return package.Chosen(
        plans, selected, none("question_id long, place long, session_id long, turn_index long"), facts, none("question_id long, place long, body string"),
        none("question_id long, place long, pointer string, value string, sources string"),
    ), turns


@query("evidence_packages")
def evidence_packages(spark, sf_dir):
    c, turns = chosen(spark, sf_dir)
    return package.evidence_packages(c, turns, 4000).withColumn("omitted", F.array_join("omitted", " "))


def order_cases(spark, sf_dir):
    """Orders as cases: line items are sessions, returned ones evidence (counted as one, two or more), the priority a kind; an order
    on a Monday abstains."""
    lines, orders = tables.table(spark, sf_dir, "lineitem"), tables.table(spark, sf_dir, "orders")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    at = lines.select("l_orderkey", "l_suppkey", "l_quantity", (F.col("l_returnflag") == "R").alias("hit"), (F.row_number().over(by) - 1).alias("i"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    place = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    of = at.groupBy("l_orderkey").agg(
        F.count("*").cast("double").alias("session_count"), F.sum("l_quantity").cast("double").alias("context_chars"), F.count_distinct("l_suppkey").cast("double").alias("turn_count"), F.least(F.count_if("hit"), F.lit(3)).cast("double").alias("evidence_count"),
        F.avg(F.when(F.col("hit"), place)).alias("evidence_mean_position"), (F.max(F.when(F.col("hit"), place)) - F.min(F.when(F.col("hit"), place))).alias("evidence_span"),
    ).where("evidence_count > 0")
    rows = orders.join(of, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.dayofweek(F.col("o_orderdate").cast("timestamp")) == 2
    return rows.select(
        F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("kind"), day.alias("abstention"), "session_count", "context_chars", "turn_count", "evidence_count", "evidence_mean_position", "evidence_span",
        F.round("o_totalprice").alias("question_chars"), F.col("o_custkey").cast("double").alias("answer_chars"), canary.quartile(F.col("evidence_mean_position")).alias("quartile"),
    )


ORDER_CASES = """placed AS (SELECT l_orderkey, l_suppkey, l_quantity, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"""


@query("case_features", f"""WITH {ORDER_CASES},
f AS (SELECT l_orderkey, count(*) AS sessions, least(count(*) FILTER (WHERE hit), 3) AS evidence, avg(i / greatest(n - 1, 1)) FILTER (WHERE hit) AS mean, max(i / greatest(n - 1, 1)) FILTER (WHERE hit) - min(i / greatest(n - 1, 1)) FILTER (WHERE hit) AS span FROM placed GROUP BY 1 HAVING count(*) FILTER (WHERE hit) > 0)
SELECT o_orderkey AS question_id, CAST(sessions AS DOUBLE) AS session_count, CAST(evidence AS DOUBLE) AS evidence_count, round(mean, 6) AS mean_position, round(span, 6) AS span, dayofweek(o_orderdate) = 1 AS abstention, CAST(least(3, floor(round(mean, 9) * 4)) AS INTEGER) AS quartile FROM f JOIN orders ON o_orderkey = l_orderkey""")
def case_features(spark, sf_dir):
    rows = order_cases(spark, sf_dir)
    return rows.select("question_id", "session_count", "evidence_count", F.round("evidence_mean_position", 6).alias("mean_position"), F.round("evidence_span", 6).alias("span"), "abstention", canary.quartile(F.round("evidence_mean_position", 9)).alias("quartile"))


@query("canary_sample")
def canary_sample(spark, sf_dir):
    """A sample of twelve orders of each priority and two that abstain, as far as that many exist, spread and repaired."""
    cases = order_cases(spark, sf_dir).withColumn("quartile", canary.quartile(F.round("evidence_mean_position", 9)))
    quotas = {(r.kind, r.abstention): min(r["count"], 2 if r.abstention else 12) for r in cases.groupBy("kind", "abstention").count().collect()}
    return canary.canary(cases, quotas, seed="orders").select("question_id", "kind", "abstention", "quartile", "evidence_count")
