"""Queries that apply the scalar functions to whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, fixed, stemmer, text
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


def joined(c):
    return F.array_join(c, " ")


SURFACE = "trim(regexp_replace(translate(lower(content), '‘’“”–—', '''''\"\"--'), '\\s+', ' ', 'g'))"
PLAIN = "regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"
QTERMS = sql.tokens("content", lambda x: f"lower({x})")


@query("token_families", f"""WITH {sql.TURNS} SELECT session_id, turn_index,
array_to_string({sql.tokens('content')}, ' ') AS tokens,
array_to_string(list_distinct(list_filter({sql.tokens('content')}, lambda t: list_contains({sql.strings(fixed.TEMPORAL_WORDS)}, t) OR regexp_matches(t, '[0-9]'))), ' ') AS temporal,
len({sql.package_terms('content')}) AS n_package, len(regexp_extract_all(lower(content), '[a-z0-9]+')) AS n_plain,
len(list_distinct(list_filter({PLAIN.format(x=SURFACE)}, lambda t: regexp_matches(t, '[0-9]') OR list_contains({sql.strings(fixed.NUMBER_WORDS + fixed.TEMPORAL_WORDS)}, t)))) AS n_anchors,
len(list_distinct(list_filter({PLAIN.format(x=SURFACE)}, lambda t: length(t) >= 3 AND NOT regexp_matches(t, '[0-9]') AND NOT list_contains({sql.strings(fixed.NUMBER_WORDS + fixed.TEMPORAL_WORDS + fixed.COVERAGE_STOPS)}, t)))) AS n_coverage,
len(list_distinct({QTERMS})) AS n_question FROM turns""")
def token_families(spark, sf_dir):
    c = F.col("content")
    toks = text.tokens(c)
    size = lambda x: F.size(x).cast("long")
    return tables.turns(spark, sf_dir).select(
        "session_id", "turn_index", joined(toks).alias("tokens"), joined(F.array_sort(text.temporal_terms(toks))).alias("temporal"),
        size(text.package_terms(c)).alias("n_package"), size(text.plain_terms(c)).alias("n_plain"), size(text.coverage_anchors(c)).alias("n_anchors"),
        size(text.coverage_terms(c)).alias("n_coverage"), size(text.question_terms(c)).alias("n_question"),
    )


SQL["token_families"] = SQL["token_families"].replace("array_to_string(list_distinct(list_filter(", "array_to_string(list_sort(list_distinct(list_filter(", 1).replace("'[0-9]'))), ' ') AS temporal", "'[0-9]')))), ' ') AS temporal")


CLIP = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query("text_shapes", f"""WITH {sql.TURNS} SELECT session_id, turn_index,
CASE WHEN length({CLIP}) <= 60 THEN {CLIP} ELSE rtrim({CLIP}[1:59]) || '…' END AS clipped,
CASE WHEN length(content) > 80 THEN content[1:80] || '…' ELSE content END AS cut, length(content) > 80 AS was_cut,
CAST(length(content) + length(role) + 8 AS BIGINT) AS cost, CAST(ceil(length(content) / 4) AS BIGINT) AS by_chars, CAST(ceil(strlen(content) / 3) AS BIGINT) AS by_bytes,
trim(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS surface_key, {SURFACE} AS surface FROM turns""")
def text_shapes(spark, sf_dir):
    c = F.col("content")
    cut, was = text.truncate(c, 80)
    return tables.turns(spark, sf_dir).select(
        "session_id", "turn_index", text.clip(c, 60).alias("clipped"), cut.alias("cut"), was.alias("was_cut"), text.turn_cost(c, F.col("role")).cast("long").alias("cost"),
        text.tokens_by_chars(c).cast("long").alias("by_chars"), text.tokens_by_bytes(c).cast("long").alias("by_bytes"), text.surface_key(c).alias("surface_key"), text.surface(c).alias("surface"),
    )


@query("query_shapes", f"""SELECT item_id, CASE WHEN regexp_matches(lower(text), '{fixed.ORDER_WORDS}') THEN 'order' WHEN regexp_matches(lower(text), '{fixed.AGGREGATE_WORDS}') THEN 'aggregate'
WHEN regexp_matches(lower(text), '{fixed.UPDATE_WORDS}') THEN 'update-conflict' ELSE 'lookup' END AS shape FROM benchmark""")
def query_shapes(spark, sf_dir):
    return tables.table(spark, sf_dir, "benchmark").select("item_id", text.query_shape(F.col("text")).alias("shape"))


@query("slugs_and_series", """SELECT doc_id, trim(regexp_replace(lower(source || ' / ' || lang || '_' || doc_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(source || '_' || doc_id, '_[0-9]+$', '') AS series,
replace(replace(source || '/~' || lang, '~', '~0'), '/', '~1') AS pointer, regexp_matches(lang || '_x', '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') AS good_key FROM documents""")
def slugs_and_series(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    id_ = F.col("doc_id").cast("string")
    return d.select(
        "doc_id", text.slug(F.concat("source", F.lit(" / "), "lang", F.lit("_"), id_)).alias("slug"), text.series_prefix(F.concat("source", F.lit("_"), id_)).alias("series"),
        dates.pointer_escape(F.concat("source", F.lit("/~"), "lang")).alias("pointer"), dates.good_key(F.concat("lang", F.lit("_x"))).alias("good_key"),
    )


PHRASES = ["today", "yesterday", "tomorrow", "last monday", "next friday", "last sunday", "soon"]
DOW = "CASE regexp_extract(p, ' (\\w+)$', 1) WHEN 'sunday' THEN 0 WHEN 'monday' THEN 1 WHEN 'friday' THEN 5 END"


@query("relative_days", f"""WITH d AS (SELECT DISTINCT DATE '2023-01-01' + CAST(conv_id % 365 AS INTEGER) AS day FROM conversations),
p AS (SELECT day, unnest({sql.strings(PHRASES)}) AS p FROM d)
SELECT day, p AS phrase, CAST(CASE WHEN p = 'today' THEN day WHEN p = 'yesterday' THEN day - 1 WHEN p = 'tomorrow' THEN day + 1
WHEN starts_with(p, 'last ') THEN day - CAST((dayofweek(day) - {DOW} + 6) % 7 + 1 AS INTEGER) WHEN starts_with(p, 'next ') THEN day + CAST(({DOW} - dayofweek(day) + 6) % 7 + 1 AS INTEGER) END AS DATE) AS resolved FROM p""")
def relative_days(spark, sf_dir):
    days = tables.table(spark, sf_dir, "conversations").select(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("day")).distinct()
    rows = days.select("day", F.explode(text.words(PHRASES)).alias("phrase"))
    return rows.withColumn("resolved", dates.relative_day(F.col("phrase"), F.col("day")))


ASKED = ["what did i do last week", "plans for march and june 2022", "anything past month", "what happened today", "yesterday or so", "in the last year", "no cue here", "may i ask"]


@query("question_ranges", f"""WITH q AS (SELECT unnest({sql.strings(ASKED)}) AS question, DATE '2023-05-17' AS day),
r AS (SELECT question, CASE question WHEN 'what did i do last week' THEN [day - 15, day + 1] WHEN 'plans for march and june 2022' THEN [DATE '2022-02-28', DATE '2022-07-01'] WHEN 'anything past month' THEN [day - 46, day + 1]
WHEN 'what happened today' THEN [day - 1, day + 1] WHEN 'yesterday or so' THEN [day - 3, day + 1] WHEN 'in the last year' THEN [day - 401, day + 1] WHEN 'may i ask' THEN [DATE '2023-04-30', DATE '2023-06-01'] END AS x FROM q)
SELECT question, CAST(x[1] AS DATE) AS lo, CAST(x[2] AS DATE) AS hi FROM r""")
def question_ranges(spark, sf_dir):
    rows = spark.createDataFrame([(q,) for q in ASKED], "question string").withColumn("r", dates.question_range(F.col("question"), F.lit("2023-05-17").cast("date"), 1))
    return rows.select("question", "r.lo", "r.hi")


@query("operands")
def operands(spark, sf_dir):
    """Clock times, durations, frequencies and ranges of every turn that has some."""
    c = F.col("content")
    rows = tables.turns(spark, sf_dir).select("session_id", "turn_index", dates.clock_times(c).alias("times"), dates.durations(c).alias("durations"), dates.frequencies(c).alias("frequencies"), dates.number_ranges(c).alias("ranges"))
    return rows.where((F.size("times") > 0) | (F.size("durations") > 0) | (F.size("frequencies") > 0) | (F.size("ranges") > 0)).select("session_id", "turn_index", F.to_json(F.struct("times", "durations", "frequencies", "ranges")).alias("found"))


@query("set_and_array_functions", f"""WITH d AS (SELECT item_id, {sql.package_terms('text')} AS t FROM benchmark)
SELECT a.item_id, b.item_id AS other, len(list_intersect(a.t, b.t)) AS shared, [x for x in [a.item_id % 5 - 1, a.item_id % 5, a.item_id % 5 + 1] if x >= 0 AND x < 5] AS near FROM d a JOIN d b ON b.item_id = a.item_id + 1""")
def set_and_array_functions(spark, sf_dir):
    d = tables.table(spark, sf_dir, "benchmark").select("item_id", text.package_terms(F.col("text")).alias("t"))
    b = d.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("t").alias("u"))
    i = (F.col("item_id") % 5).cast("long")
    return d.join(b, "item_id").select("item_id", "other", text.overlap(F.col("t"), F.col("u")).cast("long").alias("shared"), dates.adjacent_turns(F.lit("assistant"), i, F.lit(5)).alias("near"))


@query("redaction", f"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' key sk-' || md5(CAST(doc_id AS VARCHAR)) || ' end' AS x FROM documents)
SELECT doc_id, regexp_matches(x, '{fixed.SECRET_VALUE}') AS secret, md5(regexp_replace(x, '{fixed.SECRET_VALUE}', '[REDACTED]', 'g')) AS clean FROM t""")
def redaction(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" key sk-"), F.md5(F.col("doc_id").cast("string")), F.lit(" end")).alias("x"))
    return d.select("doc_id", text.has_secret(F.col("x")).alias("secret"), F.md5(text.redact(F.col("x"))).alias("clean"))


@query("stems")
def stems(spark, sf_dir):
    """The suffix-stripping stemmer over the turns' words."""
    return tables.turns(spark, sf_dir).select("session_id", "turn_index", joined(stemmer.stems(text.plain_terms(F.col("content")))).alias("stems"))


@query("canonical_payloads")
def canonical_payloads(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.select("event_id", F.sha2(dates.udf_canonical_json(F.col("props")), 256).alias("hash"))
