"""Queries over ranked and judged tables: spans, budgets, packages, reports, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import rank, reports, sampling, spans, windows
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


def window_hits(spark, sf_dir):
    docs = windows.windows(tables.turns(spark, sf_dir))
    return rank.bm25(docs, tables.questions(spark, sf_dir), 24, keep=("session_id", "start_turn", "end_turn"))


HITS = f"{sql.windows(4, 2)}, {sql.bm25('windows', 24, keep='session_id, start_turn, end_turn,')}"
SPANS = f"""{HITS},
flagged AS (
  SELECT *, CASE WHEN start_turn <= max(end_turn) OVER (PARTITION BY question_id, session_id ORDER BY start_turn, end_turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM hits),
islands AS (SELECT *, sum(new) OVER (PARTITION BY question_id, session_id ORDER BY start_turn, end_turn ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
spans AS (
  SELECT question_id, session_id, min(start_turn) AS start_turn, max(end_turn) AS end_turn, min(rank) AS best_rank, max(score) AS best_score, count(*) AS n_hits
  FROM islands GROUP BY question_id, session_id, island)"""
COSTS = f"""{SPANS}, priced AS (
  SELECT s.question_id, s.session_id, s.start_turn, s.end_turn, s.best_rank,
         CAST(sum(CASE WHEN length(content) > 4000 THEN 4001 ELSE length(content) END + length(role) + 8) AS BIGINT) AS chars
  FROM spans s JOIN turns t ON t.session_id = s.session_id AND t.turn_index BETWEEN s.start_turn AND s.end_turn
  GROUP BY s.question_id, s.session_id, s.start_turn, s.end_turn, s.best_rank)"""


@query("merged_spans", f"WITH {SPANS} SELECT question_id, session_id, start_turn, end_turn, best_rank, round(best_score, 6) AS best_score, n_hits FROM spans")
def merged_spans(spark, sf_dir):
    return spans.merge_intervals(window_hits(spark, sf_dir), ["question_id", "session_id"]).withColumn("best_score", F.round("best_score", 6))


def priced(spark, sf_dir):
    merged = spans.merge_intervals(window_hits(spark, sf_dir), ["question_id", "session_id"]).drop("best_score", "n_hits")
    return spans.span_cost(merged, tables.turns(spark, sf_dir))


@query("span_costs", f"WITH {COSTS} SELECT * FROM priced")
def span_costs(spark, sf_dir):
    return priced(spark, sf_dir)


@query("budgeted_spans", f"""WITH RECURSIVE {COSTS},
pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY best_rank, session_id, start_turn) AS i FROM priced),
walk AS (
  SELECT question_id, i, chars AS used, true AS kept FROM pool WHERE i = 1
  UNION ALL
  SELECT p.question_id, p.i, CASE WHEN w.used + p.chars <= 4000 THEN w.used + p.chars ELSE w.used END, w.used + p.chars <= 4000
  FROM walk w JOIN pool p ON p.question_id = w.question_id AND p.i = w.i + 1)
SELECT p.question_id, session_id, start_turn, end_turn, best_rank, chars FROM walk w JOIN pool p USING (question_id, i) WHERE kept""")
def budgeted_spans(spark, sf_dir):
    return spans.greedy_budget(priced(spark, sf_dir), 4000)


@query("floor_refs", f"""WITH {SPANS}, refs AS (
  SELECT question_id, t.session_id, t.turn_index, role, min(best_rank) AS best_rank, arg_min(best_score, best_rank) AS best_score
  FROM spans s JOIN turns t ON t.session_id = s.session_id AND t.turn_index BETWEEN start_turn AND end_turn GROUP BY ALL)
SELECT question_id, session_id, turn_index, role,
       row_number() OVER (PARTITION BY question_id ORDER BY role <> 'user', best_rank, round(best_score, 9) DESC, session_id, turn_index) AS rank FROM refs QUALIFY rank <= 12""")
def floor_refs(spark, sf_dir):
    merged = spans.merge_intervals(window_hits(spark, sf_dir), ["question_id", "session_id"])
    return spans.floor_refs(merged, tables.turns(spark, sf_dir), 12).select("question_id", "session_id", "turn_index", "role", "rank")


def package_refs(spark, sf_dir):
    """Phase 0: the best turn of the best sessions; 1: floor refs; 2: their neighbours."""
    turns = tables.turns(spark, sf_dir)
    merged = spans.merge_intervals(window_hits(spark, sf_dir), ["question_id", "session_id"])
    floor = spans.floor_refs(merged, turns, 24)
    lines = turns.select("session_id", F.col("turn_index").alias("line_no"), F.col("content").alias("line"))
    top = rank.best_lines(lines, tables.questions(spark, sf_dir), 1).join(retrieval.fused(spark, sf_dir, 6).select("question_id", "session_id", F.col("rank").alias("at")), ["question_id", "session_id"])
    refs = top.select("question_id", F.lit(0).alias("phase"), F.col("at").alias("position"), "session_id", F.col("line_no").alias("turn_index"))
    refs = refs.unionByName(floor.select("question_id", F.lit(1).alias("phase"), F.col("rank").alias("position"), "session_id", "turn_index"))
    near = spans.adjacent(floor, turns).select("question_id", F.lit(2).alias("phase"), F.col("session_id").alias("position"), "session_id", "turn_index")
    cost = turns.select("session_id", "turn_index", text.turn_cost(F.col("content"), F.col("role")).cast("long").alias("chars"))
    return refs.unionByName(near).join(cost, ["session_id", "turn_index"])


@query("context_packages")
def context_packages(spark, sf_dir):
    return spans.context_package(package_refs(spark, sf_dir), 24, 6000)


@query("balanced_packages")
def balanced_packages(spark, sf_dir):
    """The deterministic arm: the fused bag, its best turn a session, neighbours, then breadth."""
    turns = tables.turns(spark, sf_dir)
    bag = retrieval.fused(spark, sf_dir, 12).select("question_id", "session_id", F.col("rank").alias("session_order"))
    lines = turns.select("session_id", F.col("turn_index").alias("line_no"), F.col("content").alias("line"))
    best = rank.best_lines(lines, tables.questions(spark, sf_dir), 1).select("question_id", "session_id", "line_no")
    anchor = bag.join(best, ["question_id", "session_id"], "left").withColumn("line_no", F.coalesce("line_no", F.lit(0).cast("long")))
    all_turns = anchor.join(turns.select("session_id", "turn_index", text.turn_cost(F.col("content"), F.col("role")).cast("long").alias("chars")), "session_id")
    off = F.abs(F.col("turn_index") - F.col("line_no"))
    refs = all_turns.withColumn("round", F.when(off == 0, 0).when(off == 1, 1).otherwise(2)).withColumn("k", F.col("turn_index"))
    return spans.balanced_package(refs, 40, 8000)


@query("facet_cover")
def facet_cover(spark, sf_dir):
    asked = tables.questions(spark, sf_dir).select("question_id", F.explode(text.package_terms(F.col("question"))).alias("facet"))
    held = tables.turns(spark, sf_dir).select("session_id", F.explode(text.package_terms(F.col("content"))).alias("facet")).distinct()
    pool = retrieval.fused(spark, sf_dir)
    facets = held.join(asked, "facet").groupBy("question_id", "session_id").agg(F.collect_set("facet").alias("facets"))
    return spans.set_cover(pool.join(facets, ["question_id", "session_id"]).select("question_id", "session_id", "facets", F.lit(1).alias("weight"), "score"))


GOLD = "gold AS (SELECT item_id AS question_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
METRICS = f"""WITH docs AS (SELECT doc_id, text FROM documents), {sql.bm25('docs', 100)}, {GOLD},
metrics AS (
  SELECT g.question_id, count(*) AS n_gold, count(rank) AS n_found, count(rank) > 0 AS hit, count(rank) = count(*) AS complete, min(rank) AS first_rank,
         CASE WHEN count(rank) = count(*) THEN max(rank) END AS worst_rank, list(rank ORDER BY rank) FILTER (WHERE rank IS NOT NULL) AS ranks
  FROM gold g LEFT JOIN hits h USING (question_id, doc_id) GROUP BY g.question_id)"""


def document_metrics(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return reports.hit_metrics(rank.bm25(docs, tables.questions(spark, sf_dir), 100), tables.gold(spark, sf_dir))


@query("retrieval_metrics", f"{METRICS} SELECT question_id, n_gold, n_found, hit, complete, first_rank, worst_rank FROM metrics")
def retrieval_metrics(spark, sf_dir):
    return document_metrics(spark, sf_dir).drop("ranks")


@query("rank_report", f"""{METRICS}, scored AS (
  SELECT *, len(list_filter(coalesce(ranks, []), lambda r: r <= 5)) / n_gold AS recall5,
         list_sum(list_transform(list_filter(coalesce(ranks, []), lambda r: r <= 5), lambda r: 1 / log2(r + 1.0::DOUBLE))) / list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda r: 1 / log2(r + 1.0::DOUBLE))) AS ndcg5 FROM metrics)
SELECT count(*) AS n, round(avg(CASE WHEN worst_rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_3, round(avg(CASE WHEN worst_rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_5,
       round(avg(CASE WHEN worst_rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage_10, CAST(median(worst_rank) AS DOUBLE) AS median_rank, round(avg(worst_rank), 6) AS mean_rank,
       round(avg(recall5), 6) AS recall_5, round(avg(coalesce(ndcg5, 0)), 6) AS ndcg_5, count(*) FILTER (WHERE worst_rank IS NULL) AS misses FROM scored""")
def rank_report(spark, sf_dir):
    return reports.rank_report(document_metrics(spark, sf_dir))


@query("difficulty_strata", f"{METRICS} SELECT question_id, CASE WHEN worst_rank IS NULL OR worst_rank > 5 THEN 'hard' WHEN worst_rank >= 4 THEN 'mid' ELSE 'easy' END AS difficulty FROM metrics")
def difficulty_strata(spark, sf_dir):
    return document_metrics(spark, sf_dir).select("question_id", sampling.difficulty(F.col("worst_rank")).alias("difficulty"))


def judged(spark, sf_dir):
    labels, docs = tables.table(spark, sf_dir, "labels"), tables.table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang", "source"), "doc_id").select(F.col("doc_id").alias("question_id"), F.col("lang").alias("question_type"), "source", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("toxic"))


JUDGED = "j AS (SELECT l.doc_id AS question_id, lang AS question_type, source, quality = 1 AS correct, toxic = 1 AS toxic FROM labels l JOIN documents d USING (doc_id))"


@query("accuracy_report", f"""WITH {JUDGED}, t AS (SELECT question_type AS level, count(*) AS n, count(*) FILTER (WHERE correct) AS r FROM j GROUP BY 1)
SELECT level, n, r AS "right", round(r / n, 6) AS accuracy FROM t UNION ALL
SELECT 'overall', CAST(sum(n) AS BIGINT), CAST(sum(r) AS BIGINT), round(sum(r) / sum(n), 6) FROM t UNION ALL
SELECT 'task averaged', CAST(sum(n) AS BIGINT), CAST(sum(r) AS BIGINT), round(avg(r / n), 6) FROM t""")
def accuracy_report(spark, sf_dir):
    return reports.accuracy_report(judged(spark, sf_dir))


@query("post_stratified", f"""WITH {JUDGED}, s AS (SELECT source AS stratum, count(*) AS n, count(*) FILTER (WHERE correct) AS r FROM j GROUP BY 1),
p AS (SELECT source AS stratum, count(*) AS population FROM documents GROUP BY 1)
SELECT round(sum(population * r / n) / sum(population), 6) AS estimate, CAST(sum(n) AS BIGINT) AS n, CAST(sum(population) AS BIGINT) AS population FROM s JOIN p USING (stratum)""")
def post_stratified(spark, sf_dir):
    population = tables.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("population"))
    return reports.post_stratified(judged(spark, sf_dir).withColumnRenamed("source", "stratum"), population)


@query("rollup_report", f"""WITH {JUDGED} SELECT CASE grouping(question_type, toxic) WHEN 3 THEN 'overall' WHEN 1 THEN 'question_type' ELSE 'toxic' END AS level,
CASE grouping(question_type, toxic) WHEN 1 THEN question_type WHEN 2 THEN CAST(toxic AS VARCHAR) END AS value, count(*) AS n, count(*) FILTER (WHERE correct) AS n_right, round(avg(CAST(correct AS INT)), 6) AS accuracy
FROM j GROUP BY GROUPING SETS ((), (question_type), (toxic))""")
def rollup_report(spark, sf_dir):
    values = [F.count("*").alias("n"), F.count_if("correct").alias("n_right"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy")]
    return reports.rollup_sets(judged(spark, sf_dir), "question_type", "toxic", values)


@query("paired_runs", f"""WITH {JUDGED} SELECT count(*) FILTER (WHERE toxic AND NOT correct) AS wins, count(*) FILTER (WHERE correct AND NOT toxic) AS losses, count(*) FILTER (WHERE correct = toxic) AS ties FROM j""")
def paired_runs(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return reports.paired(rows.select("question_id", "correct"), rows.select("question_id", F.col("toxic").alias("correct")))


@query("usage_by_role", """SELECT event_type AS role, count(*) AS calls, count(*) FILTER (WHERE user_id % 7 = 0) AS failures, CAST(sum(event_id % 100) AS BIGINT) AS tokens, round(avg(value), 6) AS latency, count(DISTINCT user_id % 3) AS models FROM events GROUP BY 1""")
def usage_by_role(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events")
    calls = events.select(F.col("event_type").alias("role"), (F.col("user_id") % 7 == 0).alias("failed"), (F.col("event_id") % 100).alias("tokens"), F.col("value").alias("latency"), (F.col("user_id") % 3).alias("model"))
    return reports.usage(calls)


@query("cost_by_role", """WITH t AS (SELECT event_type AS role, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY 1),
p AS (SELECT role, CASE WHEN role <> (SELECT max(role) FROM t) THEN length(role) * 0.5::DOUBLE END AS price FROM t),
c AS (SELECT role, tokens, price, tokens * price / 1000000 AS cost FROM t JOIN p USING (role))
SELECT role, tokens, round(cost, 6) AS cost FROM c UNION ALL SELECT 'total', CAST(sum(tokens) AS BIGINT), CASE WHEN bool_and(price IS NOT NULL) THEN round(sum(cost), 6) END FROM c""")
def cost_by_role(spark, sf_dir):
    tokens = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role")).agg(F.sum(F.col("event_id") % 100).alias("tokens"))
    last = tokens.agg(F.max("role").alias("last"))
    prices = tokens.crossJoin(F.broadcast(last)).where("role <> last").select("role", (F.length("role") * 0.5).alias("price"))
    return reports.cost(tokens, prices)


@query("call_check", """WITH a AS (SELECT event_type AS role, count(*) AS actual FROM events GROUP BY 1 ), e AS (SELECT role, actual - CASE WHEN role = (SELECT min(role) FROM a) THEN 1 ELSE 0 END AS expected FROM a WHERE role <> (SELECT max(role) FROM a) UNION ALL SELECT 'planner', 3)
SELECT coalesce(a.role, e.role) AS role, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, coalesce(expected, 0) = coalesce(actual, 0) AS agrees FROM a FULL JOIN e ON a.role = e.role""")
def call_check(spark, sf_dir):
    actual = tables.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("role")).agg(F.count("*").alias("actual"))
    ends = actual.agg(F.min("role").alias("lo"), F.max("role").alias("hi"))
    expected = actual.crossJoin(F.broadcast(ends)).where("role <> hi").select("role", (F.col("actual") - F.when(F.col("role") == F.col("lo"), 1).otherwise(0)).alias("expected"))
    return reports.call_check(expected.unionByName(spark.createDataFrame([("planner", 3)], "role string, expected long")), actual)


@query("length_percentiles", "SELECT source, CAST(quantile_disc(n_chars, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(n_chars, 0.9) AS BIGINT) AS p90, CAST(quantile_disc(n_chars, 1.0) AS BIGINT) AS p100 FROM documents GROUP BY source")
def length_percentiles(spark, sf_dir):
    return reports.percentiles(tables.table(spark, sf_dir, "documents"), ["source"], "n_chars", [0.5, 0.9, 1.0])


@query("upper_medians", "SELECT lang, n_chars AS upper_median FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE i = n // 2")
def upper_medians(spark, sf_dir):
    return reports.upper_median(tables.table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query("seeded_sample", """WITH q AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY sha256('screen' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM documents)
SELECT doc_id, lang, place FROM q WHERE place <= 20""")
def seeded_sample(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.quota_sample(docs, ["lang"], 20, "screen", "doc_id")


@query("round_robin_batches", """WITH t AS (SELECT item_id, length(text) % 4 AS kind, row_number() OVER (PARTITION BY length(text) % 4 ORDER BY item_id) AS turn FROM benchmark)
SELECT item_id, kind, turn, (row_number() OVER (ORDER BY turn, kind) - 1) // 10 AS batch FROM t""")
def round_robin_batches(spark, sf_dir):
    items = tables.table(spark, sf_dir, "benchmark").select("item_id", (F.length("text") % 4).cast("long").alias("kind"))
    return sampling.round_robin(items, "kind", [F.asc("item_id")], 10)


@query("first_per_branch", "SELECT min(doc_id) FILTER (WHERE lang = 'de') AS german, min(doc_id) FILTER (WHERE n_chars > 5000) AS long_text, min(doc_id) FILTER (WHERE source = 'none') AS nothing FROM documents")
def first_per_branch(spark, sf_dir):
    return sampling.first_per_branch(tables.table(spark, sf_dir, "documents"), {"german": F.col("lang") == "de", "long_text": F.col("n_chars") > 5000, "nothing": F.col("source") == "none"}, "doc_id")


@query("repair_merge", "SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def repair_merge(spark, sf_dir):
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    old = docs.select("doc_id", F.lit(-1).cast(dict(labels.dtypes)["quality"]).alias("quality"))
    return sampling.latest_wins([old, labels.select("doc_id", "quality")], "doc_id")


@query("unresolved", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unresolved(spark, sf_dir):
    return sampling.unresolved(tables.table(spark, sf_dir, "documents").select("doc_id"), tables.table(spark, sf_dir, "labels"), "doc_id")


@query("interleaved_tasks", "SELECT item_id AS case_index, arm, CAST(((i - item_id) % 3 + 3) % 3 AS BIGINT) AS turn FROM benchmark CROSS JOIN (VALUES ('a', 0), ('b', 1), ('c', 2)) v(arm, i)")
def interleaved_tasks(spark, sf_dir):
    cases = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_index"))
    return sampling.interleaved(cases, ["a", "b", "c"]).select("case_index", "arm", "turn")


def features(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.col("n_chars").cast("double").alias("f_chars"), F.size(F.split("text", "\n")).cast("double").alias("f_lines"))


SCALED = """f AS (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS f_chars, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS f_lines FROM documents),
s AS (SELECT doc_id, lang, (f_chars - min(f_chars) OVER w) / (max(f_chars) OVER w - min(f_chars) OVER w) AS f_chars, (f_lines - min(f_lines) OVER w) / (max(f_lines) OVER w - min(f_lines) OVER w) AS f_lines FROM f WINDOW w AS (PARTITION BY lang))"""


@query("scaled_features", f"WITH {SCALED} SELECT doc_id, lang, round(f_chars, 6) AS f_chars, round(f_lines, 6) AS f_lines FROM s")
def scaled_features(spark, sf_dir):
    rows = sampling.scaled(features(spark, sf_dir), ["lang"], ["f_chars", "f_lines"])
    return rows.withColumns({c: F.round(c, 6) for c in ("f_chars", "f_lines")})


@query("medoids", f"""WITH {SCALED}, d AS (SELECT doc_id, lang, round(sqrt((f_chars - avg(f_chars) OVER w) ** 2 + (f_lines - avg(f_lines) OVER w) ** 2), 9) AS distance FROM s WINDOW w AS (PARTITION BY lang))
SELECT lang, doc_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY lang ORDER BY distance, sha256('canary' || chr(0) || CAST(doc_id AS VARCHAR))) = 1""")
def medoids(spark, sf_dir):
    rows = sampling.scaled(features(spark, sf_dir), ["lang"], ["f_chars", "f_lines"])
    return sampling.medoids(rows, ["lang"], ["f_chars", "f_lines"], "doc_id", "canary").select("lang", "doc_id", F.round("distance", 6).alias("distance"))


@query("farthest_first")
def farthest_first(spark, sf_dir):
    items = tables.table(spark, sf_dir, "benchmark")
    rows = items.select("item_id", (F.length("text") % 3).cast("long").alias("kind"), F.length("text").cast("double").alias("a"), F.size(F.split("text", " ")).cast("double").alias("b"))
    return sampling.farthest_first(sampling.scaled(rows, ["kind"], ["a", "b"]), "kind", ["a", "b"], "item_id", 5)


@query("opaque_handles", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('memory' || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS n,
'memory_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS handle, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS short FROM documents""")
def opaque_handles(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("source", "doc_id", F.col("doc_id").cast("string").alias("id"))
    rows = rank.ranked(docs, ["source"], [dates.handle_order(F.lit("memory"), F.col("source"), F.col("id")).asc(), F.asc("doc_id")], None, "n")
    return rows.select("source", "doc_id", "n", F.format_string("memory_%03d", F.col("n")).alias("handle"), dates.short_handle(F.col("id")).alias("short"))


@query("publication_problems", """WITH p AS (SELECT doc_id AS question_id, coalesce(text, '') AS h FROM documents), c AS (SELECT item_id AS question_id FROM benchmark)
SELECT question_id, 'missing' AS problem FROM c WHERE question_id NOT IN (SELECT question_id FROM p) UNION SELECT question_id, 'unknown' FROM p WHERE question_id NOT IN (SELECT question_id FROM c)
UNION SELECT question_id, 'repeated' FROM p GROUP BY 1 HAVING count(*) > 1 UNION SELECT question_id, 'secret' FROM p WHERE regexp_matches(h, '(?i)(sk-[a-z0-9_-]{12,}|AIza[a-z0-9_-]{12,}|Bearer\\s+[a-z0-9._-]{12,})')""")
def publication_problems(spark, sf_dir):
    """Every document is a prediction, every benchmark item a case."""
    predictions = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("hypothesis"))
    return reports.publication_problems(predictions, tables.questions(spark, sf_dir).select("question_id"))


@query("publication_problems_all", """WITH p AS (SELECT doc_id AS question_id, coalesce(text, '') AS h FROM documents), c AS (SELECT doc_id AS question_id FROM labels)
SELECT question_id, 'missing' AS problem FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.question_id = c.question_id) UNION SELECT question_id, 'unknown' FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.question_id = p.question_id)
UNION SELECT question_id, 'repeated' FROM p GROUP BY 1 HAVING count(*) > 1 UNION SELECT question_id, 'secret' FROM p WHERE regexp_matches(h, '(?i)(sk-[a-z0-9_-]{12,}|AIza[a-z0-9_-]{12,}|Bearer\\s+[a-z0-9._-]{12,})')""")
def publication_problems_all(spark, sf_dir):
    """The whole check: every document is a prediction, every labelled id a case."""
    predictions = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("hypothesis"))
    return reports.publication_problems(predictions, tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id")))


@query("macro_recall", f"""{METRICS}, r AS (SELECT n_gold > 1 AS several, len(list_filter(coalesce(ranks, []), lambda r: r <= 12)) / n_gold AS rec, first_rank, complete FROM metrics)
SELECT several, count(*) AS n, round(avg(rec), 6) AS recall, count(*) FILTER (WHERE first_rank <= 12) AS hits, count(*) FILTER (WHERE complete) AS complete FROM r GROUP BY several""")
def macro_recall(spark, sf_dir):
    return reports.macro_recall(document_metrics(spark, sf_dir).withColumn("several", F.col("n_gold") > 1), ["several"])


@query("compact_packages", f"""WITH RECURSIVE {sql.TURNS}, items AS (SELECT session_id % 10 AS question_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS priority, session_id * 1000 + turn_index AS position, strlen(content) + 1 AS bytes FROM turns),
pool AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY priority, position) AS i FROM items WHERE bytes + 2 <= 3000),
walk AS (SELECT question_id, i, bytes AS used, true AS kept FROM pool WHERE i = 1 UNION ALL
  SELECT p.question_id, p.i, CASE WHEN w.used + p.bytes <= 2998 THEN w.used + p.bytes ELSE w.used END, w.used + p.bytes <= 2998 FROM walk w JOIN pool p ON p.question_id = w.question_id AND p.i = w.i + 1)
SELECT question_id, position, CAST(bytes AS BIGINT) AS bytes FROM walk JOIN pool USING (question_id, i) WHERE kept""")
def compact_packages(spark, sf_dir):
    t = tables.turns(spark, sf_dir)
    items = t.select((F.col("session_id") % 10).alias("question_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("priority"), (F.col("session_id") * 1000 + F.col("turn_index")).alias("position"), F.col("content").alias("item"))
    return spans.compact_package(items, 3000).select("question_id", "position", "bytes")
