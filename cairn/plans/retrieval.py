"""Queries over chat windows and documents: index units, ranking, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import rank, windows
from ..sources import tables
from . import sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


@query("turns_view", f"WITH {sql.TURNS} SELECT session_id, turn_index, role, content, date FROM turns")
def turns_view(spark, sf_dir):
    return tables.turns(spark, sf_dir)


@query("turn_windows", f"WITH {sql.windows(4, 2)} SELECT doc_id, session_id, date, start_turn, end_turn, md5(text) AS text_md5 FROM windows")
def turn_windows(spark, sf_dir):
    return windows.windows(tables.turns(spark, sf_dir)).withColumn("text_md5", F.md5("text")).drop("text")


@query("user_windows", f"WITH {sql.windows(2, 1)} SELECT doc_id, length(text) AS n FROM windows WHERE contains(text, chr(10) || '[user] ')")
def user_windows(spark, sf_dir):
    return windows.user_windows(tables.turns(spark, sf_dir), 2, 1).select("doc_id", F.length("text").cast("long").alias("n"))


@query("bm25_windows", f"WITH {sql.windows(4, 2)}, {sql.bm25('windows', 24, boost=0.15)} SELECT question_id, doc_id, round(score, 6) AS score, matched, rank FROM hits")
def bm25_windows(spark, sf_dir):
    docs = windows.windows(tables.turns(spark, sf_dir))
    return rank.bm25(docs, tables.questions(spark, sf_dir), 24, boost=0.15).withColumn("score", F.round("score", 6))


@query("bm25_documents", f"WITH docs AS (SELECT doc_id, text FROM documents), {sql.bm25('docs', 10)} SELECT question_id, doc_id, round(score, 6) AS score, matched, rank FROM hits")
def bm25_documents(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank.bm25(docs, tables.questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("bm25_classic", f"WITH docs AS (SELECT doc_id, text FROM documents), {sql.bm25('docs', 5, 1.2, 0.75)} SELECT question_id, doc_id, round(score, 6) AS score, rank FROM hits")
def bm25_classic(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank.bm25(docs, tables.questions(spark, sf_dir), 5, 1.2, 0.75).select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank")


SESSIONS = f"""WITH {sql.windows(2, 1)}, {sql.bm25('windows', 1000000, keep='session_id,')},
best AS (SELECT question_id, session_id, max(score) AS score FROM hits GROUP BY ALL)
SELECT question_id, session_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM best) WHERE rank <= 10"""


@query("session_ranks", SESSIONS)
def session_ranks(spark, sf_dir):
    """The flagship: windows of user turns, BM25 for each item, sessions by their best window."""
    docs = windows.windows(tables.turns(spark, sf_dir), 2, 1)
    hits = rank.bm25(docs, tables.questions(spark, sf_dir), None, keep=("session_id",))
    return rank.session_ranks(hits, "max", 10).select("question_id", "session_id", F.round("score", 6).alias("score"), "rank")


@query("session_ranks_top3", f"""WITH {sql.windows(2, 1)}, {sql.bm25('windows', 1000000, keep='session_id,')},
top3 AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question_id, session_id ORDER BY round(score, 9) DESC, doc_id) <= 3),
best AS (SELECT question_id, session_id, sum(score) AS score FROM top3 GROUP BY ALL)
SELECT question_id, session_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, session_id) AS rank FROM best) WHERE rank <= 10""")
def session_ranks_top3(spark, sf_dir):
    docs = windows.windows(tables.turns(spark, sf_dir), 2, 1)
    hits = rank.bm25(docs, tables.questions(spark, sf_dir), None, keep=("session_id",))
    return rank.session_ranks(hits, "top3", 10).select("question_id", "session_id", F.round("score", 6).alias("score"), "rank")


def role_docs(role: str | None) -> str:
    where = f"WHERE role = '{role}'" if role else ""
    lines = f"SELECT session_id, string_agg('[' || role || ' turn ' || n || '] ' || content, chr(10) ORDER BY turn_index) AS text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1 AS n FROM turns {where}) GROUP BY session_id"
    return f"SELECT session_id AS doc_id, '[source_view] {role or 'all'}' || chr(10) || coalesce(text, '') AS text FROM (SELECT DISTINCT session_id FROM turns) LEFT JOIN ({lines}) USING (session_id)"


FUSION = f"""WITH {sql.TURNS}, u AS ({role_docs('user')}), a AS ({role_docs('assistant')}), t AS ({role_docs(None)}),
{sql.bm25('u', 10, name='hu')}, {sql.bm25('a', 10, name='ha')}, {sql.bm25('t', 10, name='ht')},
views AS (SELECT question_id, doc_id, rank, 'user' AS channel FROM hu UNION ALL SELECT question_id, doc_id, rank, 'assistant' FROM ha UNION ALL SELECT question_id, doc_id, rank, 'all' FROM ht),
fused AS (SELECT question_id, doc_id AS session_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(DISTINCT channel) AS channels FROM views GROUP BY ALL)
SELECT question_id, session_id, round(score, 6) AS score, channels, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, channels DESC, session_id) AS rank FROM fused) WHERE rank <= 24"""


def fused(spark, sf_dir, top=24):
    turns, asked = tables.turns(spark, sf_dir), tables.questions(spark, sf_dir)
    parts = []
    for name, role in (("user", "user"), ("assistant", "assistant"), ("all", None)):
        docs = windows.role_view(turns, role).select(F.col("session_id").alias("doc_id"), "text")
        parts.append(rank.bm25(docs, asked, 10).select("question_id", F.col("doc_id").alias("session_id"), "rank", F.lit(name).alias("channel")))
    return rank.rrf(parts[0].unionByName(parts[1]).unionByName(parts[2]), top=top)


@query("fused_sessions", FUSION)
def fused_sessions(spark, sf_dir):
    return fused(spark, sf_dir).withColumn("score", F.round("score", 6))


INDEX = f"""{sql.TURNS}, u AS (SELECT * FROM turns WHERE role = 'user'),
openers AS (
  SELECT session_id, arg_min(trim(regexp_replace(content, '\\s+', ' ', 'g')), turn_index) AS o FROM u WHERE trim(content) <> '' GROUP BY session_id),
tf AS (SELECT session_id, term, count(*) AS tf FROM (SELECT session_id, unnest({sql.package_terms('content')}) AS term FROM u) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT session_id) AS n FROM turns),
best AS (
  SELECT session_id, term, row_number() OVER (PARTITION BY session_id ORDER BY round(tf * (ln((n + 1) / (df + 1)) + 1), 9) DESC, term) AS place
  FROM tf JOIN df USING (term) CROSS JOIN n QUALIFY place <= 8),
idx AS (
  SELECT s.session_id, coalesce(CASE WHEN length(o) <= 160 THEN o ELSE rtrim(o[1:159]) || '…' END, '') AS opener,
         coalesce(list(term ORDER BY place) FILTER (WHERE term IS NOT NULL), []) AS terms
  FROM (SELECT DISTINCT session_id FROM turns) s LEFT JOIN openers USING (session_id) LEFT JOIN best USING (session_id) GROUP BY s.session_id, o)"""


@query("session_index", f"WITH {INDEX} SELECT session_id, opener, array_to_string(terms, ' ') AS terms FROM idx")
def session_index(spark, sf_dir):
    return windows.session_index(tables.turns(spark, sf_dir)).withColumn("terms", F.array_join("terms", " "))


@query("session_routing", f"""WITH {INDEX}, ask AS (SELECT item_id AS question_id, unnest({sql.package_terms('text')}) AS term FROM benchmark),
weighed AS (SELECT session_id, unnest(terms) AS term, 3 AS w FROM idx UNION ALL SELECT session_id, unnest({sql.package_terms('opener')}), 2 FROM idx),
scored AS (SELECT question_id, session_id, CAST(sum(w) AS BIGINT) AS score FROM weighed JOIN ask USING (term) GROUP BY ALL)
SELECT question_id, session_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, session_id) AS rank FROM scored QUALIFY rank <= 8""")
def session_routing(spark, sf_dir):
    return rank.route(windows.session_index(tables.turns(spark, sf_dir)), tables.questions(spark, sf_dir))


@query("best_turns", f"""WITH {sql.TURNS}, ask AS (SELECT item_id AS question_id, unnest({sql.package_terms('text')}) AS term FROM benchmark),
held AS (SELECT session_id, turn_index AS line_no, unnest({sql.package_terms('content')}) AS term FROM turns),
shared AS (SELECT question_id, session_id, line_no, count(*) AS overlap FROM held JOIN ask USING (term) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id, session_id ORDER BY overlap DESC, line_no) AS rank FROM shared QUALIFY rank <= 3""")
def best_turns(spark, sf_dir):
    lines = tables.turns(spark, sf_dir).select("session_id", F.col("turn_index").alias("line_no"), F.col("content").alias("line"))
    return rank.best_lines(lines, tables.questions(spark, sf_dir))


@query("literal_grep", f"""WITH {sql.TURNS}, hits AS (
  SELECT session_id, turn_index AS line_no, CAST(CAST(contains(lower(content), 'license') AS INT) + CAST(contains(lower(content), 'the') AS INT) + CAST(contains(lower(content), 'password') AS INT) + CAST(contains(lower(content), 'zyxw') AS INT) + CAST(contains(lower(content), 'quux') AS INT) AS INTEGER) AS score FROM turns)
SELECT session_id, line_no, score, row_number() OVER (ORDER BY session_id, line_no) AS rank FROM hits WHERE score > 0 QUALIFY rank <= 20""")
def literal_grep(spark, sf_dir):
    lines = tables.turns(spark, sf_dir).select("session_id", F.col("turn_index").alias("line_no"), F.col("content").alias("line"))
    # the sixth that is not blank, though first by alphabet, no longer counts
    given = ["license", " the ", "Password", " ", "zyxw", "quux", "a"]
    patterns = spark.createDataFrame(list(enumerate(given)), "position int, pattern string")
    return rank.grep(lines, patterns).drop("line")


@query("parameter_sweep", "WITH docs AS (SELECT doc_id, text FROM documents), " + ", ".join(sql.bm25("docs", 3, k1, b, name=f"h{i}") for i, (k1, b) in enumerate([(0.9, 0.4), (1.2, 0.75), (1.5, 0.9)])) + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT question_id, doc_id, round(score, 6) AS score, rank, {k1}::DOUBLE AS k1, {b}::DOUBLE AS b FROM h{i}" for i, (k1, b) in enumerate([(0.9, 0.4), (1.2, 0.75), (1.5, 0.9)])) + ")")
def parameter_sweep(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rank.sweep(docs, tables.questions(spark, sf_dir), [(0.9, 0.4), (1.2, 0.75), (1.5, 0.9)], 3)
    return out.select("question_id", "doc_id", F.round("score", 6).alias("score"), "rank", "k1", "b")


PARTS = r"list_filter(list_transform(string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
CLAIMS = f"""{sql.TURNS}, s AS (
  SELECT session_id, turn_index, role, unnest({PARTS}) AS sentence, generate_subscripts({PARTS}, 1) AS i FROM turns),
once AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id, turn_index, role, lower(sentence) ORDER BY i) = 1)"""


@query("claims", f"WITH {CLAIMS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, i) AS claim_no, turn_index, role, sentence FROM once")
def claims(spark, sf_dir):
    return windows.claims(tables.turns(spark, sf_dir))


@query("personal_signals")
def personal_signals(spark, sf_dir):
    return windows.signals(tables.turns(spark, sf_dir))


@query("pair_windows", f"""WITH {sql.TURNS}, m AS (
  SELECT *, CASE WHEN role = 'assistant' AND lag(role) OVER (PARTITION BY session_id ORDER BY turn_index) = 'user' THEN 0 ELSE 1 END AS s FROM turns),
p AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY turn_index) AS pair FROM m)
SELECT session_id, CAST(pair AS BIGINT) AS pair, min(turn_index) AS start_turn, max(turn_index) AS end_turn, string_agg(content, chr(10) ORDER BY turn_index) AS text FROM p GROUP BY session_id, pair""")
def pair_windows(spark, sf_dir):
    return windows.pair_windows(tables.turns(spark, sf_dir))


@query("query_keys", f"SELECT item_id AS question_id, array_to_string(list_sort(list_distinct({sql.tokens('text')})), ' ') AS key FROM benchmark")
def query_keys(spark, sf_dir):
    return tables.questions(spark, sf_dir).select("question_id", text.query_key(text.tokens(F.col("question"))).alias("key"))
