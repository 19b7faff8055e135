"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions import fixed


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def normalise(x: str) -> str:
    return f"translate(lower({x}), '_‘’“”–—', ' ''''\"\"--')"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND ends_with({t}, 'ies') THEN {t}[1:length({t})-3] || 'y' "
        f"WHEN length({t}) > 5 AND ends_with({t}, 'ing') THEN {t}[1:length({t})-3] "
        f"WHEN length({t}) > 4 AND ends_with({t}, 'ed') THEN {t}[1:length({t})-2] "
        f"WHEN length({t}) > 4 AND ends_with({t}, 's') THEN {t}[1:length({t})-1] ELSE {t} END"
    )


def tokens(x: str, norm=normalise) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({norm(x)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: {stem('t')}), "
        f"lambda t: length(t) > 1 AND NOT list_contains({strings(fixed.RETRIEVAL_STOPS)}, t))"
    )


def package_terms(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({strings(fixed.PACKAGE_STOPS)}, t)))"


DATE = "strftime(DATE '2023-01-01' + CAST(session_id % 365 AS INTEGER), '%Y/%m/%d')"

TURNS = f"""turns AS (
  SELECT *, {DATE} AS date FROM (
    SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, role,
           coalesce(text, '') AS content
    FROM conversations WHERE role IN ('user', 'assistant')))"""


def windows(width: int, stride: int) -> str:
    """CTEs turns and windows (user turns only)."""
    return f"""{TURNS},
sizes AS (SELECT session_id, date, count(*) AS n FROM turns GROUP BY ALL),
bounds AS (
  SELECT session_id, date, s AS start_turn, least(s + {width}, n) - 1 AS end_turn
  FROM (SELECT session_id, date, n, unnest(range(0, n, {stride})) AS s FROM sizes) WHERE s = 0 OR s - {stride} + {width} < n),
windows AS (
  SELECT concat(b.session_id, '#', b.start_turn, '-', b.end_turn) AS doc_id, b.session_id, b.date, b.start_turn, b.end_turn,
         concat_ws(chr(10), '[session_date] ' || b.date, string_agg('[user] ' || t.content, chr(10) ORDER BY t.turn_index) FILTER (WHERE t.role = 'user')) AS text
  FROM bounds b JOIN turns t ON t.session_id = b.session_id AND t.turn_index BETWEEN b.start_turn AND b.end_turn
  GROUP BY b.session_id, b.date, b.start_turn, b.end_turn)"""


def bm25(docs: str, k: int, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, boost: float = 0.0, name: str = "hits", keep: str = "") -> str:
    """CTEs that rank ``docs(doc_id, text)`` for each benchmark item; the last is ``name``."""
    p = name
    dated = f"(list_contains({strings(fixed.TEMPORAL_WORDS)}, term) OR regexp_matches(term, '[0-9]'))"
    return f"""{p}_tok AS (SELECT doc_id, {keep} {tokens('text')} AS toks FROM {docs}),
{p}_len AS (SELECT doc_id, {keep} len(toks) AS len FROM {p}_tok),
{p}_stat AS (SELECT count(*) AS n, avg(len) AS avg_len FROM {p}_len),
{p}_ask AS (SELECT DISTINCT item_id AS question_id, unnest({tokens('text')}) AS term FROM benchmark),
{p}_post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM {p}_tok) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_post GROUP BY term),
{p}_score AS (
  SELECT question_id, doc_id, {keep}
         sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / avg_len))) + {boost} * sum(CASE WHEN {dated} THEN 1 ELSE 0 END) AS score,
         count(*) AS matched
  FROM {p}_ask JOIN {p}_df USING (term) JOIN {p}_post USING (term) JOIN {p}_len USING (doc_id) CROSS JOIN {p}_stat GROUP BY ALL),
{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, matched DESC, doc_id) AS rank FROM {p}_score)
  WHERE rank <= {k})"""
