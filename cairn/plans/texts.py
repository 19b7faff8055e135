"""Queries that show packages, spans and indexes as text, bound excerpts, and slice questions by how hard they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import formats, sampling, spans, windows
from ..sources import tables
from . import evaluation, retrieval, scalar

QUERIES, SQL = {}, {}


def query(name: str, oracle: str = ""):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def merged(spark, sf_dir):
    return spans.merge_intervals(evaluation.window_hits(spark, sf_dir), ["question_id", "session_id"]).drop("best_score", "n_hits")


HELD = f"""{evaluation.SPANS}, held AS (
  SELECT question_id, best_rank, s.session_id, start_turn, end_turn, date, turn_index, role, content FROM spans s JOIN turns t ON t.session_id = s.session_id AND turn_index BETWEEN start_turn AND end_turn)"""


@query("retrieved_texts", f"""WITH {HELD}, blocks AS (
SELECT question_id, best_rank, session_id, start_turn, '### session ' || session_id || ' | date ' || any_value(date) || ' | turns ' || start_turn || '-' || end_turn || chr(10) ||
  string_agg('[' || role || ' sessionId=' || session_id || ' turnIndex=' || turn_index || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY turn_index) AS block FROM held GROUP BY question_id, best_rank, session_id, start_turn, end_turn)
SELECT b.item_id AS question_id, coalesce(string_agg(block, chr(10) || chr(10) ORDER BY best_rank, session_id, start_turn), '{fixed.NO_SPANS}') AS retrieved FROM benchmark b LEFT JOIN blocks k ON k.question_id = b.item_id GROUP BY b.item_id""")
def retrieved_texts(spark, sf_dir):
    bundles = formats.span_bundles(merged(spark, sf_dir), tables.turns(spark, sf_dir))
    return tables.questions(spark, sf_dir).select("question_id").join(bundles, "question_id", "left").select("question_id", formats.spans_text(F.col("spans")).alias("retrieved"))


@query("select_catalogues", f"""WITH {HELD}
SELECT b.item_id AS question_id, coalesce(string_agg('- sessionId=' || session_id || ' turnIndex=' || turn_index || ' date=' || date || ' role=' || role || ' :: ' || replace(content, chr(10), ' ')[1:160], chr(10)
  ORDER BY best_rank, session_id, start_turn, turn_index), '(no turns in retrieval bundle)') AS catalogue FROM benchmark b LEFT JOIN held h ON h.question_id = b.item_id GROUP BY b.item_id""")
def select_catalogues(spark, sf_dir):
    bundles = formats.span_bundles(merged(spark, sf_dir), tables.turns(spark, sf_dir))
    return tables.questions(spark, sf_dir).select("question_id").join(bundles, "question_id", "left").select("question_id", formats.select_catalogue(F.col("spans")).alias("catalogue"))


@query("package_texts", f"""WITH {HELD}, shapes AS ({scalar.SQL["query_shapes"]}),
rows AS (SELECT *, CASE WHEN role = 'user' THEN 'selected' ELSE 'supporting' END AS tier FROM held),
numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id, tier ORDER BY best_rank, session_id, start_turn, turn_index) + 1 AS n FROM rows),
tiers AS (SELECT question_id, tier, string_agg('### item ' || n || chr(10) || 'session ' || session_id || ' | date ' || date || ' | turn ' || turn_index || ' | ' || role || chr(10) ||
  CASE WHEN tier = 'selected' THEN 'why: ranked ' || best_rank || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY n) AS body FROM numbered GROUP BY question_id, tier)
SELECT b.item_id AS question_id, 'queryShape: ' || shape || chr(10) || 'setBoundary: ' || b.text || chr(10) || 'candidateStatus: ' || CASE WHEN s.body IS NULL AND p.body IS NULL THEN 'none_found' ELSE 'found' END || chr(10) || 'missingRisk: n/a' ||
  chr(10) || chr(10) || CASE WHEN s.body IS NULL AND p.body IS NULL THEN '## NO MATCHING TURNS FOUND' || chr(10) || '(empty selected set; do not invent members)'
  ELSE '## SELECTED (matched the question)' || chr(10) || chr(10) || coalesce(s.body, '(no selected turns)') ||
       coalesce(chr(10) || chr(10) || '## SUPPORTING (same sessions; use when they bear on the question)' || chr(10) || chr(10) || p.body, '') END AS package
FROM benchmark b JOIN shapes USING (item_id) LEFT JOIN tiers s ON s.question_id = b.item_id AND s.tier = 'selected' LEFT JOIN tiers p ON p.question_id = b.item_id AND p.tier = 'supporting'""")
def package_texts(spark, sf_dir):
    """A question's spans as a package: user turns are selected, the others support them."""
    bundles = formats.span_bundles(merged(spark, sf_dir), tables.turns(spark, sf_dir))
    user = lambda t: t.role == "user"
    items = F.flatten(F.transform("spans", lambda s: F.transform(s.turns, lambda t: F.struct(
        s.session_id.alias("session_id"), s.date.alias("date"), t.turn_index.alias("turn_index"), t.role.alias("role"),
        F.when(user(t), F.concat(F.lit("ranked "), s.best_rank.cast("string"))).alias("why"), F.when(user(t), "selected").otherwise("supporting").alias("tier"), t.content.alias("text")))))
    rows = tables.questions(spark, sf_dir).join(bundles, "question_id", "left").withColumn("items", items)
    status = F.when(F.coalesce(F.size("items"), F.lit(0)) > 0, "found").otherwise("none_found")
    return rows.select("question_id", formats.package_text(F.col("items"), text.query_shape(F.col("question")), F.col("question"), status, F.lit("n/a")).alias("package"))


@query("session_index_texts", f"""WITH {retrieval.INDEX}, days AS (SELECT DISTINCT session_id, date FROM turns)
SELECT session_id // 10 AS case_id, string_agg('- sessionId=' || session_id || ' | date ' || date || chr(10) || '  opener: ' || opener || chr(10) || '  terms: ' || CASE WHEN len(terms) > 0 THEN array_to_string(terms, ', ') ELSE 'n/a' END, chr(10) ORDER BY session_id) AS listing
FROM idx JOIN days USING (session_id) GROUP BY 1""")
def session_index_texts(spark, sf_dir):
    """The index of a case, which is ten conversations, as text."""
    turns = tables.turns(spark, sf_dir)
    rows = windows.session_index(turns).join(turns.select("session_id", "date").distinct(), "session_id")
    entries = F.array_sort(F.collect_list(F.struct("session_id", "date", "opener", "terms")))
    return rows.groupBy(F.floor(F.col("session_id") / 10).alias("case_id")).agg(formats.index_text(entries).alias("listing"))


@query("bounded_excerpts", """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE text[1:388] || chr(10) || '…' || chr(10) || text[-209:] END AS excerpt FROM d""")
def bounded_excerpts(spark, sf_dir):
    """The SQL holds for texts whose graphemes are single characters of the first plane; so they are in the tables it was held against."""
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


@query("question_slices", f"""{evaluation.METRICS}, told AS (SELECT question_id, CASE WHEN complete THEN worst_rank ELSE 999 END AS worst FROM metrics),
known AS (SELECT *, worst > 5 AS hard FROM told),
placed AS (SELECT question_id, worst, hard, CASE WHEN hard THEN row_number() OVER (PARTITION BY hard ORDER BY worst DESC, question_id) ELSE row_number() OVER (PARTITION BY hard ORDER BY question_id) END AS n FROM known)
SELECT 'answerable' AS slice, item_id AS question_id, 0 AS part, NULL::INTEGER AS worst FROM benchmark UNION ALL
SELECT 'hard', question_id, 0, worst FROM placed WHERE hard UNION ALL SELECT 'hard12', question_id, 0, worst FROM placed WHERE hard AND n <= 12 UNION ALL
SELECT 'hard50', question_id, 0, worst FROM placed WHERE hard UNION ALL SELECT 'hard50', question_id, 1, worst FROM placed WHERE NOT hard AND n <= 17""")
def question_slices(spark, sf_dir):
    m = evaluation.document_metrics(spark, sf_dir).select("question_id", F.when(F.col("complete"), F.col("worst_rank")).alias("worst"))
    asked = tables.questions(spark, sf_dir).select("question_id", F.col("question_id").alias("position"), F.lit(False).alias("abstains"))
    return sampling.slices(asked, m).where("slice <> 'all'").select("slice", "question_id", "part", "worst")

