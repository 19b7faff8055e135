"""Queries over views and lanes: an item as a question, its halves as further lanes, the session index as notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import views, windows
from ..sources import tables
from . import retrieval, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = oracle
        return f

    return add


def inputs(spark, sf_dir):
    turns, q = tables.turns(spark, sf_dir), tables.questions(spark, sf_dir)
    index = windows.session_index(turns).persist()  # a row a session, used for notes, documents and excerpts
    fact = F.struct(F.col("opener").alias("text"), F.lit(0).cast("long").alias("turn_index"))
    event = "array<struct<text:string,date_hint:string,turn_index:bigint>>"
    notes = index.select("session_id", F.when(F.col("opener") != "", F.array(fact)).otherwise(F.array().cast("array<struct<text:string,turn_index:bigint>>")).alias("facts"), F.array().cast(event).alias("events"), F.col("terms").alias("keyphrases"))
    words = F.split("question", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("lane"), F.array_join(F.slice(words, F.lit(1), half), " ").alias("query"), F.array(F.lit("f1")).alias("facet_ids")),
        F.struct(F.lit(2).alias("lane"), F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("query"), F.array(F.lit("f2")).alias("facet_ids")),
    )
    lanes = views.lanes_of(q, q.select("question_id", F.explode(parts).alias("p")).select("question_id", "p.*"))
    return turns, notes, lanes


def view(role: str | None) -> str:
    return f"SELECT '{role or 'all'}' AS view, doc_id AS session_id, text FROM ({retrieval.role_docs(role)})"


DATED = f"(list_contains({sql.strings(fixed.TEMPORAL_WORDS)}, term) OR regexp_matches(term, '[0-9]'))"
HITS = f"""{retrieval.INDEX}, noted AS (SELECT i.*, d.date FROM idx i JOIN (SELECT DISTINCT session_id, date FROM turns) d USING (session_id)),
docs AS (SELECT 'notes' AS view, session_id, '[session_id] ' || session_id || chr(10) || '[session_date] ' || date || CASE WHEN opener <> '' THEN chr(10) || '[facts]' || chr(10) || '- ' || opener ELSE '' END
  || CASE WHEN len(terms) > 0 THEN chr(10) || '[keyphrases] ' || array_to_string(terms, '; ') ELSE '' END || CASE WHEN opener = '' AND len(terms) = 0 THEN chr(10) || '[notes] (empty)' ELSE '' END AS text FROM noted
  UNION ALL {view('user')} UNION ALL {view('assistant')} UNION ALL {view(None)}),
w AS (SELECT item_id AS question_id, text, string_split(text, ' ') AS ws FROM benchmark), h AS (SELECT *, CAST(ceil(len(ws) / 2) AS BIGINT) AS half FROM w),
lanes AS (SELECT question_id, 0 AS lane, text AS query, ['f1', 'f2'] AS facet_ids FROM h UNION ALL SELECT question_id, 1, array_to_string(ws[1:half], ' '), ['f1'] FROM h UNION ALL SELECT question_id, 2, array_to_string(ws[half+1:], ' '), ['f2'] FROM h),
tok AS (SELECT view, session_id, {sql.tokens('text')} AS toks FROM docs), stat AS (SELECT view, count(*) AS n, avg(len(toks)) AS avg_len FROM tok GROUP BY view),
ask AS (SELECT DISTINCT question_id, lane, unnest({sql.tokens('query')}) AS term FROM lanes),
post AS (SELECT view, session_id, len, term, count(*) AS tf FROM (SELECT view, session_id, len(toks) AS len, unnest(toks) AS term FROM tok) GROUP BY ALL), dfs AS (SELECT view, term, count(*) AS df FROM post GROUP BY ALL),
score AS (SELECT question_id, lane, view, session_id, count(*) AS matched,
  sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({fixed.BM25_K1} + 1) / (tf + {fixed.BM25_K1} * (1 - {fixed.BM25_B} + {fixed.BM25_B} * len / avg_len)) + CASE WHEN {DATED} THEN {fixed.TEMPORAL_BOOST} ELSE 0 END) AS score
  FROM ask JOIN post USING (term) JOIN dfs USING (view, term) JOIN stat USING (view) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id, lane, view ORDER BY round(score, 9) DESC, matched DESC, session_id) AS rank FROM score QUALIFY rank <= 10)"""


@query("lane_hits", f"WITH {HITS} SELECT question_id, lane, view, session_id, round(score, 6) AS score, matched, rank FROM hits")
def lane_hits(spark, sf_dir):
    turns, notes, lanes = inputs(spark, sf_dir)
    return views.lane_hits(views.view_documents(turns, notes), lanes).drop("terms").withColumn("score", F.round("score", 6))


@query("lane_pool", f"""WITH {HITS}, f AS (SELECT question_id, session_id, sum(1.0::DOUBLE / (60 + rank)) AS score, list_sort(list_distinct(flatten(list(facet_ids)))) AS facets FROM hits JOIN lanes USING (question_id, lane) GROUP BY ALL)
SELECT question_id, session_id, round(score, 6) AS score, array_to_string(facets, ' ') AS facets, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, len(facets) DESC, session_id) AS rank FROM f QUALIFY rank <= 24""")
def lane_pool(spark, sf_dir):
    turns, notes, lanes = inputs(spark, sf_dir)
    pool = views.pooled(views.lane_hits(views.view_documents(turns, notes), lanes), lanes)
    return pool.select("question_id", "session_id", F.round("score", 6).alias("score"), F.array_join("facets", " ").alias("facets"), "rank")


def cut(x: str, n: int) -> str:
    one = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({one}) <= {n} THEN {one} ELSE {one}[1:{n - 1}] || '…' END"


@query("lane_excerpts", f"""WITH {HITS}, said AS (SELECT unnest([role, 'all']) AS view, session_id, turn_index AS line_no, upper(role) || ' turn ' || turn_index || ': ' || {cut('content', 260)} AS line, {sql.tokens('content')} AS toks FROM turns
  UNION ALL SELECT 'notes', session_id, line_no, line, {sql.tokens('line')} FROM (SELECT session_id, 0 AS line_no, 'USER turn 0: ' || opener AS line FROM idx WHERE opener <> ''
    UNION ALL SELECT session_id, i - CASE WHEN opener = '' THEN 1 ELSE 0 END, 'keyphrase: ' || terms[i] FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM idx))),
m AS (SELECT question_id, lane, view, session_id, line, line_no, len(list_filter(toks, lambda t: list_contains({sql.tokens('query')}, t))) AS overlap FROM hits JOIN lanes USING (question_id, lane) JOIN said USING (view, session_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, lane, view, session_id ORDER BY overlap DESC, line_no) AS place FROM m QUALIFY place <= CASE WHEN view = 'notes' THEN 4 ELSE 3 END),
j AS (SELECT question_id, lane, view, session_id, string_agg(line, ' | ' ORDER BY place) AS t FROM r GROUP BY ALL)
SELECT question_id, session_id, lane, view, view || ': ' || CASE WHEN t IS NULL THEN CASE WHEN view = 'notes' THEN '(no structured notes)' ELSE '(no ' || view || ' evidence)' END ELSE {cut('t', 360)} END AS excerpt FROM hits LEFT JOIN j USING (question_id, lane, view, session_id)""")
def lane_excerpts(spark, sf_dir):
    turns, notes, lanes = inputs(spark, sf_dir)
    hits = views.lane_hits(views.view_documents(turns, notes), lanes).persist()
    return views.excerpts(hits, lanes, views.lines_of(turns, notes))
