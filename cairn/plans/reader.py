"""Queries over what a reader chooses and says: guards, repairs, packages, claim and notes search, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fixed
from ..operators import rank, reader, windows
from ..sources import tables
from . import retrieval, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = oracle
        return f

    return add


@query("any_term", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'password')")
def any_term(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return reader.any_term(docs, ["License", " ", "PASSWORD"]).select("doc_id")


ROUTED = retrieval.SQL["session_routing"]
#: A reader's output: routed sessions, some of them renamed to what does not exist, a turn each by the session's rank.
CHOSEN = f"""routed AS ({ROUTED}), {sql.TURNS}, sizes AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1),
chosen AS (SELECT question_id, CASE WHEN rank % 5 = 0 THEN session_id + 1000000 ELSE session_id END AS session_id, CASE WHEN question_id % 7 = 0 THEN 10000 ELSE unnest([rank - 1, rank, rank]) END AS turn_index FROM routed),
marked AS (SELECT c.*, n, n IS NOT NULL AND turn_index BETWEEN 0 AND n - 1 AS valid FROM chosen c LEFT JOIN (SELECT question_id, r.session_id, n FROM routed r JOIN sizes USING (session_id)) USING (question_id, session_id))"""


def chosen(spark, sf_dir):
    routed = retrieval.session_routing(spark, sf_dir)
    session = F.when(F.col("rank") % 5 == 0, F.col("session_id") + 1000000).otherwise(F.col("session_id")).alias("session_id")
    turn = F.explode(F.array(F.col("rank") - 1, "rank", "rank"))
    rows = routed.select("question_id", session, turn.alias("t"))
    return routed, rows.select("question_id", "session_id", F.when(F.col("question_id") % 7 == 0, 10000).otherwise(F.col("t")).alias("turn_index"))


def sizes(spark, sf_dir):
    return tables.turns(spark, sf_dir).groupBy("session_id").agg(F.count("*").alias("n"))


@query("reader_refs", f"WITH {CHOSEN} SELECT DISTINCT question_id, session_id, turn_index FROM marked WHERE valid")
def reader_refs(spark, sf_dir):
    routed, rows = chosen(spark, sf_dir)
    return reader.sanitised_refs(rows, routed, sizes(spark, sf_dir))[0]


@query("reader_warnings", f"""WITH {CHOSEN}, told AS (SELECT question_id, session_id, count(n) AS found, count(*) AS given, count(DISTINCT CASE WHEN valid THEN turn_index END) AS stand FROM marked GROUP BY ALL)
SELECT question_id, session_id, CASE WHEN found = 0 THEN 'unknown session' WHEN stand = 0 THEN 'no valid turn' ELSE 'invalid turns' END AS problem FROM told WHERE found = 0 OR stand = 0 OR stand < given""")
def reader_warnings(spark, sf_dir):
    routed, rows = chosen(spark, sf_dir)
    return reader.sanitised_refs(rows, routed, sizes(spark, sf_dir))[1]


FACTS = """facts AS (SELECT question_id, rank AS fact_id, CASE WHEN rank % 3 <> 0 THEN session_id + CASE WHEN rank % 2 = 0 THEN 1000000 ELSE 0 END END AS session_id, CASE WHEN rank % 3 = 0 THEN '/' || session_id END AS pointer FROM routed),
supports AS (SELECT f.*, r.session_id IS NOT NULL AS s, p.pointer IS NOT NULL AS p FROM facts f LEFT JOIN routed r ON r.question_id = f.question_id AND r.session_id = f.session_id LEFT JOIN (SELECT question_id, '/' || session_id AS pointer FROM routed WHERE session_id % 2 = 0) p ON p.question_id = f.question_id AND p.pointer = f.pointer),
kept AS (SELECT question_id, fact_id, count(DISTINCT session_id) AS sessions, count(DISTINCT pointer) AS pointers FROM supports WHERE s OR p GROUP BY ALL)"""


def facts(routed):
    key, n = F.col("session_id"), F.col("rank")
    rows = routed.select("question_id", n.alias("fact_id"), F.when(n % 3 != 0, key + F.when(n % 2 == 0, 1000000).otherwise(0)).alias("session_id"), F.when(n % 3 == 0, F.concat(F.lit("/"), key.cast("string"))).alias("pointer"))
    pointers = routed.where("session_id % 2 = 0").select("question_id", F.concat(F.lit("/"), key.cast("string")).alias("pointer"))
    return reader.sanitised_facts(rows, routed, pointers)


@query("reader_facts", f"WITH routed AS ({ROUTED}), {FACTS} SELECT * FROM kept")
def reader_facts(spark, sf_dir):
    return facts(retrieval.session_routing(spark, sf_dir))


@query("reader_verdicts", f"""WITH {CHOSEN}, {FACTS}, st AS (SELECT question_id FROM marked WHERE valid UNION SELECT question_id FROM kept WHERE question_id % 2 = 0)
SELECT item_id AS question_id, CASE WHEN item_id IN (FROM st) THEN 'sufficient' ELSE 'insufficient' END AS support_status, CASE WHEN item_id IN (FROM st) THEN 'direct' ELSE 'abstain' END AS answer_mode FROM benchmark""")
def reader_verdicts(spark, sf_dir):
    routed, rows = chosen(spark, sf_dir)
    plans = tables.questions(spark, sf_dir).select("question_id", F.lit("sufficient").alias("support_status"), F.lit("direct").alias("answer_mode"))
    return reader.reader_verdict(plans, reader.sanitised_refs(rows, routed, sizes(spark, sf_dir))[0], facts(routed).where("question_id % 2 = 0"))


@query("substituted_answers", f"""SELECT doc_id AS question_id, CASE WHEN doc_id % 2 = 0 AND regexp_replace(h, '\\s', '', 'g') = '' THEN '{fixed.UNAVAILABLE}' ELSE h END AS hypothesis
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' || chr(10) WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(text, '') END AS h FROM documents)""")
def substituted_answers(spark, sf_dir):
    n = F.col("doc_id")
    said = F.when(n % 3 == 0, " \n").when(n % 11 == 0, "").otherwise(F.col("text"))
    rows = tables.table(spark, sf_dir, "documents").select(n.alias("question_id"), said.alias("hypothesis"), F.when(n % 2 == 0, "insufficient").otherwise("sufficient").alias("support_status"))
    return reader.substituted(rows).select("question_id", "hypothesis")


AROUND = """CASE WHEN role = 'user' THEN [turn_index, turn_index + 1, turn_index - 1] ELSE [turn_index - 1, turn_index, turn_index + 1] END"""


def around_sql(refs: str, why: str, phase: int) -> str:
    return f"""SELECT question_id, {phase} AS phase, position, step, x.session_id, near AS turn_index, CASE WHEN near = home THEN '{why}' ELSE 'adjacent' END AS why FROM (
  SELECT r.question_id, r.position, r.session_id, r.turn_index AS home, unnest({AROUND}) AS near, generate_subscripts({AROUND}, 1) AS step FROM {refs} r JOIN turns t USING (session_id, turn_index)) x
  JOIN (SELECT session_id, turn_index AS near FROM turns) USING (session_id, near)"""


@query("repaired_selection", f"""WITH routed AS ({ROUTED}), {sql.TURNS}, shapes AS (SELECT item_id AS question_id, CASE item_id % 4 WHEN 0 THEN 'aggregate' WHEN 1 THEN 'order' ELSE 'lookup' END AS shape FROM benchmark),
items AS (SELECT question_id, rank AS position, session_id, rank AS turn_index FROM routed WHERE question_id % 3 > 0 AND rank <= 4), anchors AS (SELECT question_id, rank AS position, session_id, 0 AS turn_index FROM routed),
c AS ({around_sql('items', 'chosen', 0)}), asked AS (SELECT question_id, shape <> 'lookup' AS gathers FROM shapes WHERE shape <> 'lookup' OR question_id NOT IN (SELECT question_id FROM c)),
bag AS ({around_sql('anchors', 'own', 1)}),
u AS (SELECT * FROM c UNION ALL SELECT question_id, phase, position, step, session_id, turn_index, CASE WHEN why = 'adjacent' THEN why WHEN gathers THEN 'coverage' ELSE 'fallback' END FROM bag JOIN asked USING (question_id)),
once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY question_id, session_id, turn_index ORDER BY phase, position, step) = 1)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY phase, position, step, session_id, turn_index) AS place, session_id, turn_index, why FROM once QUALIFY place <= 40""")
def repaired_selection(spark, sf_dir):
    routed, asked = retrieval.session_routing(spark, sf_dir), tables.questions(spark, sf_dir)
    position = F.col("rank").alias("position")
    items = routed.where("question_id % 3 > 0 AND rank <= 4").select("question_id", position, "session_id", F.col("rank").alias("turn_index"))
    anchors = routed.select("question_id", position, "session_id", F.lit(0).cast("long").alias("turn_index"))
    kind = F.when(F.col("question_id") % 4 == 0, "aggregate").when(F.col("question_id") % 4 == 1, "order").otherwise("lookup")
    return reader.repaired(items, anchors, asked.select("question_id", kind.alias("shape")), tables.turns(spark, sf_dir))


@query("package_order", f"""WITH routed AS ({ROUTED}), {sql.TURNS}
SELECT question_id, session_id, turn_index, row_number() OVER (PARTITION BY question_id ORDER BY rank > 2, date, session_id, turn_index) AS place FROM routed JOIN turns USING (session_id)""")
def package_order(spark, sf_dir):
    routed = retrieval.session_routing(spark, sf_dir)
    items = routed.join(tables.turns(spark, sf_dir).select("session_id", "turn_index", "date"), "session_id").withColumn("tier", F.when(F.col("rank") <= 2, "selected").otherwise("sibling"))
    return reader.in_package_order(items).select("question_id", "session_id", "turn_index", "place")


@query("full_histories", f"""WITH {sql.TURNS}, s AS (SELECT session_id // 4 AS case_id, session_id, date, string_agg(role || ': ' || content, chr(10) ORDER BY turn_index) AS body FROM turns GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY date, session_id) AS i FROM s)
SELECT CAST(case_id AS BIGINT) AS case_id, string_agg('### Session ' || i || ':' || chr(10) || 'Session Date: ' || date || chr(10) || 'Session Content:' || chr(10) || body, chr(10) || chr(10) ORDER BY i) AS history FROM n GROUP BY case_id""")
def full_histories(spark, sf_dir):
    return reader.full_history(tables.turns(spark, sf_dir), F.floor(F.col("session_id") / 4))


def claim_rows(turns):
    return windows.claims(turns).join(turns.select("session_id", "date").distinct(), "session_id").withColumns({"kind": F.lit("raw"), "date_hint": F.lit("")})


@query("claim_search", f"""WITH {retrieval.CLAIMS}, c AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, i) AS claim_no, turn_index, role, sentence FROM once),
docs AS (SELECT session_id || '#' || claim_no AS doc_id, session_id, turn_index, '[role] ' || role || chr(10) || '[session_date] ' || date || chr(10) || '[event_date] ' || chr(10) || '[kind] raw' || chr(10) || sentence AS text FROM c JOIN (SELECT DISTINCT session_id, date FROM turns) USING (session_id)),
{sql.bm25('docs', 30, keep='session_id, turn_index,')},
scores AS (SELECT question_id, session_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(*) AS claims FROM hits GROUP BY ALL),
near AS (SELECT question_id, session_id, count(*) AS neighbours FROM (SELECT DISTINCT h.question_id, c.session_id, c.claim_no FROM hits h JOIN c ON c.session_id = h.session_id AND c.turn_index BETWEEN h.turn_index - 1 AND h.turn_index + 1) GROUP BY ALL)
SELECT question_id, session_id, round(score, 6) AS score, claims, neighbours, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM scores JOIN near USING (question_id, session_id) QUALIFY rank <= 24""")
def claim_search(spark, sf_dir):
    return reader.claim_search(claim_rows(tables.turns(spark, sf_dir)), tables.questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("notes_search", f"""WITH {retrieval.INDEX}, docs AS (SELECT session_id AS doc_id, opener || chr(10) || array_to_string(terms, '; ') AS text FROM idx), {sql.bm25('docs', 10)},
snips AS (SELECT session_id AS doc_id, opener || CASE WHEN len(terms) > 0 THEN ' | keyphrases: ' || array_to_string(terms[1:6], '; ') ELSE '' END AS s FROM idx)
SELECT question_id, doc_id, round(score, 6) AS score, rank, CASE WHEN length(s) <= 280 THEN s ELSE s[1:279] || '…' END AS snippet FROM hits JOIN snips USING (doc_id)""")
def notes_search(spark, sf_dir):
    index = windows.session_index(tables.turns(spark, sf_dir)).withColumnRenamed("session_id", "doc_id")
    docs = index.select("doc_id", F.concat("opener", F.lit("\n"), F.array_join("terms", "; ")).alias("text"))
    notes = index.select("doc_id", F.array("opener").alias("facts"), F.col("terms").alias("keyphrases"))
    return reader.notes_search(docs, notes, tables.questions(spark, sf_dir), 7).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank", "snippet")


NAME = "'chat_' || session_id // 4 || '_' || session_id % 4"


@query("routing_recovery", f"""WITH routed AS (SELECT *, {NAME} AS name, 'chat_' || session_id // 4 AS series FROM ({ROUTED})), g AS (SELECT DISTINCT question_id, 'chat_' || s // 4 || '_' || s % 4 AS name, 'chat_' || s // 4 AS series FROM (SELECT question_id, unnest([session_id, session_id + 1, session_id + 9]) AS s FROM routed)),
i AS (SELECT DISTINCT 'chat_' || conv_id // 4 || '_' || conv_id % 4 AS name FROM conversations WHERE role IN ('user', 'assistant')), b AS (SELECT question_id, name, series FROM routed WHERE rank % 3 = 0), t AS (SELECT question_id, name, series FROM routed WHERE rank <= 2),
seeds AS (SELECT question_id, series FROM b UNION SELECT question_id, series FROM t),
f AS (SELECT question_id, name, EXISTS (SELECT 1 FROM b WHERE b.question_id = g.question_id AND b.name = g.name) AS held, EXISTS (SELECT 1 FROM t WHERE t.question_id = g.question_id AND t.name = g.name) OR (name IN (SELECT name FROM i) AND EXISTS (SELECT 1 FROM seeds s WHERE s.question_id = g.question_id AND s.series = g.series)) AS back FROM g)
SELECT question_id, count(*) AS gold, count(*) FILTER (WHERE NOT held) AS missed, count(*) FILTER (WHERE NOT held AND back) AS recovered FROM f GROUP BY 1""")
def routing_recovery(spark, sf_dir):
    name = lambda s: F.concat(F.lit("chat_"), F.floor(s / 4).cast("string"), F.lit("_"), (s % 4).cast("string")).alias("name")
    s = F.col("session_id")
    routed = retrieval.session_routing(spark, sf_dir)
    gold = routed.select("question_id", F.explode(F.array(s, s + 1, s + 9)).alias("session_id")).select("question_id", name(s)).distinct()
    index = tables.turns(spark, sf_dir).select("session_id").distinct().select(name(s))
    return reader.routing_recovery(gold, routed.where("rank % 3 = 0").select("question_id", name(s)), routed.where("rank <= 2").select("question_id", name(s)), index)


@query("mode_report", f"""WITH r AS (SELECT event_type AS mode, event_id AS question_id, event_id % 9 = 0 AS restated, event_id % 3 AS rejected, event_id % 2 AS duplicates, user_id % 1000 AS input_tokens, event_id % 50 AS output_tokens, CASE WHEN event_id % 13 > 0 THEN event_id % 4 > 0 END AS label FROM events)
SELECT mode, count(label) AS judged, count(*) FILTER (WHERE label) AS correct, round(count(*) FILTER (WHERE label) / count(label), 6) AS accuracy, count(*) FILTER (WHERE label IS NULL) AS unjudged, count(*) FILTER (WHERE restated) AS restated,
CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(duplicates) AS BIGINT) AS duplicates, quantile_disc(input_tokens, 0.95) AS input_p95, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
round((sum(input_tokens) * {fixed.ANSWER_PRICES[0]}::DOUBLE + sum(output_tokens) * {fixed.ANSWER_PRICES[1]}::DOUBLE) / 1000000, 6) AS cost FROM r GROUP BY mode""")
def mode_report(spark, sf_dir):
    e, n = tables.table(spark, sf_dir, "events"), F.col("event_id")
    mode = F.col("event_type").alias("mode")
    results = e.select(mode, n.alias("question_id"), (n % 9 == 0).alias("restated"), (n % 3).alias("rejected"), (n % 2).alias("duplicates"), (F.col("user_id") % 1000).alias("input_tokens"), (n % 50).alias("output_tokens"))
    return reader.mode_report(results, e.where("event_id % 13 > 0").select(mode, n.alias("question_id"), (n % 4 > 0).alias("label")))


KINDS = [kind for kind, _ in fixed.ANSWER_MODES] + ["single-session-user"]


@query("oracle_plans", f"""WITH routed AS ({ROUTED}), q AS (SELECT item_id, item_id || CASE WHEN item_id % 6 = 0 THEN '_abs' ELSE '' END AS question_id, {sql.strings(KINDS)}[item_id % 6 + 1] AS question_type FROM benchmark),
c AS (SELECT q.question_id, question_type, session_id, CASE WHEN rank <= 2 THEN rank END AS turns FROM q LEFT JOIN (FROM routed WHERE rank <= 3) r ON r.question_id = q.item_id)
SELECT question_id, CASE WHEN ends_with(question_id, '_abs') THEN 'insufficient' ELSE 'sufficient' END AS support_status,
CASE WHEN ends_with(question_id, '_abs') THEN 'abstain' {' '.join(f"WHEN question_type = '{a}' THEN '{b}'" for a, b in fixed.ANSWER_MODES)} ELSE 'direct' END AS answer_mode,
CAST(CASE WHEN ends_with(question_id, '_abs') THEN 0 ELSE count(session_id) END AS BIGINT) AS sessions, CAST(CASE WHEN ends_with(question_id, '_abs') THEN 0 ELSE coalesce(sum(turns), 0) END AS BIGINT) AS turns,
CAST(CASE WHEN ends_with(question_id, '_abs') THEN 0 ELSE count(*) FILTER (WHERE session_id IS NOT NULL AND turns IS NULL) END AS BIGINT) AS lacking FROM c GROUP BY question_id, question_type""")
def oracle_plans(spark, sf_dir):
    n = F.col("question_id")
    name = F.concat(n.cast("string"), F.when(n % 6 == 0, "_abs").otherwise("")).alias("question_id")
    routed = retrieval.session_routing(spark, sf_dir).where("rank <= 3")
    kind = F.get(F.array(*map(F.lit, KINDS)), (n % 6).cast("int")).alias("question_type")
    cases = tables.questions(spark, sf_dir).select("question_id").join(routed.select("question_id", "session_id"), "question_id", "left").select(name, kind, "session_id")
    turns = routed.where("rank <= 2").select(name, "session_id", F.explode(F.sequence(F.lit(1), F.col("rank"))).alias("turn_index"))
    return reader.oracle_plan(cases, turns)


@query("comparable_times", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_ms(date_trunc('second', ts)) END AS at FROM events""")
def comparable_times(spark, sf_dir):
    said = F.when(F.col("event_id") % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return tables.table(spark, sf_dir, "events").select("event_id", dates.comparable_time(said).alias("at"))
