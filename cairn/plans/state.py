"""Queries over state: property graph, cells, citations, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, rank, windows
from ..sources import tables
from ..streaming import flows, replay
from . import retrieval, sql

QUERIES, SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def claims(spark, sf_dir):
    """Each user's events as claims: the newest event type per user holds."""
    e = tables.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("subject"), (F.col("user_id") % 2).alias("predicate"), F.col("event_type").alias("value"), flows.micros("ts").alias("valid_from"), F.col("event_id").alias("seq"))


CLAIMS = "c AS (SELECT user_id AS subject, user_id % 2 AS predicate, event_type AS value, epoch_us(ts) AS valid_from, event_id AS seq FROM events)"


@query("contradictions", f"""WITH {CLAIMS}, k AS (SELECT * FROM c QUALIFY lag(value) OVER (PARTITION BY subject, predicate ORDER BY valid_from, seq) IS DISTINCT FROM value)
SELECT *, coalesce(lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, seq), -1) AS valid_to,
CASE WHEN lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, seq) IS NULL THEN 'active' ELSE 'contradicted' END AS status FROM k""")
def contradictions(spark, sf_dir):
    return ledger.close_contradictions(claims(spark, sf_dir)).withColumn("valid_to", F.coalesce("valid_to", F.lit(-1)))


@query("observations", f"""WITH {CLAIMS}, k AS (SELECT * FROM c QUALIFY lag(value) OVER (PARTITION BY subject ORDER BY valid_from, seq) IS DISTINCT FROM value)
SELECT subject AS pointer, arg_max(value, (valid_from, seq)) AS current, count(*) - 1 AS history FROM k GROUP BY subject""")
def observations(spark, sf_dir):
    c = claims(spark, sf_dir)
    return ledger.observations(c.select(F.col("subject").alias("pointer"), "value", F.col("valid_from").alias("effective_at"), "seq"))


@query("latest_properties", f"WITH {CLAIMS} SELECT subject AS entity, predicate AS name, arg_max(value, (valid_from, seq)) AS value FROM c GROUP BY ALL")
def latest_properties(spark, sf_dir):
    c = claims(spark, sf_dir)
    return ledger.latest_properties(c.select(F.col("subject").alias("entity"), F.col("predicate").alias("name"), "value", F.col("valid_from").alias("at"), "seq"))


@query("two_hop", """WITH RECURSIVE r AS (SELECT DISTINCT s_nationkey AS a, 100 + s_suppkey % 7 AS b FROM supplier), both_ways AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
w AS (SELECT DISTINCT a AS seed, a AS node, 0 AS hop FROM r UNION SELECT w.seed, b, hop + 1 FROM w JOIN both_ways ON w.node = both_ways.a WHERE hop < 2)
SELECT CAST(seed AS BIGINT) AS seed, CAST(node AS BIGINT) AS node, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY seed, node""")
def two_hop(spark, sf_dir):
    s = tables.table(spark, sf_dir, "supplier")
    relations = s.select(F.col("s_nationkey").cast("long").alias("a"), (100 + F.col("s_suppkey") % 7).cast("long").alias("b")).distinct()
    return ledger.two_hop(relations.select(F.col("a").alias("seed")).distinct(), relations)


@query("entity_resolution", """WITH k AS (SELECT n_nationkey AS id, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM nation),
m AS (SELECT c_custkey AS mention_id, trim(regexp_replace(lower(CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' ELSE n_name END), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT mention_id, count(DISTINCT id) AS n, min(id) AS one FROM m LEFT JOIN k USING (key) GROUP BY mention_id)
SELECT CAST(mention_id AS BIGINT) AS mention_id, CAST(CASE WHEN n = 1 THEN one END AS BIGINT) AS entity_id, CASE WHEN n = 1 THEN 'reused' WHEN n = 0 THEN 'new' ELSE 'ambiguous' END AS decision FROM f""")
def entity_resolution(spark, sf_dir):
    nation, customer = tables.table(spark, sf_dir, "nation"), tables.table(spark, sf_dir, "customer")
    entities = nation.select(F.col("n_nationkey").cast("long").alias("entity_id"), F.lit("place").alias("kind"), F.col("n_name").alias("alias"))
    mentions = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("mention_id"), F.lit("place").alias("kind"), F.when(F.col("c_custkey") % 5 == 0, "nowhere").otherwise(F.upper("n_name")).alias("name"))
    return ledger.resolve_entities(mentions, entities)


@query("state_cells")
def state_cells(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    mode = F.when(F.col("event_id") % 3 == 0, "append").when(F.col("event_id") % 3 == 1, "set").otherwise("observe")
    pointer = F.concat(F.lit("/"), "event_type", F.when(F.col("event_id") % 2 == 0, F.lit("/last")).otherwise(""))
    kind = F.when(F.col("event_id") % 11 == 0, "list").otherwise("state")
    return ledger.apply_updates(e.select(F.col("user_id").cast("long").alias("case_id"), F.col("event_id").cast("long").alias("seq"), pointer.alias("pointer"), kind.alias("kind"), mode.alias("mode"), F.col("value").cast("string").alias("value")))


@query("leaf_pointers")
def leaf_pointers(spark, sf_dir):
    return ledger.leaf_pointers(tables.table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), F.col("props").alias("json")))


@query("pointer_prefixes", """WITH s AS (SELECT doc_id, '/' || lang || '/' || source || '/' || doc_id % 3 AS pointer FROM documents), p AS (SELECT DISTINCT '/' || lang AS root FROM documents UNION SELECT DISTINCT '/' || lang || '/' || source FROM documents WHERE lang = 'de')
SELECT doc_id, pointer, root FROM s JOIN p ON pointer = root OR starts_with(pointer, root || '/')""")
def pointer_prefixes(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    sources = d.select("doc_id", F.concat_ws("/", F.lit(""), "lang", "source", (F.col("doc_id") % 3).cast("string")).alias("pointer"))
    roots = d.select(F.concat(F.lit("/"), "lang").alias("pointer")).unionByName(d.where("lang = 'de'").select(F.concat_ws("/", F.lit(""), "lang", "source").alias("pointer"))).distinct()
    return ledger.under_pointer(sources, roots)


@query("redundant_parents", """WITH u AS (SELECT doc_id, doc_id // 10 AS batch, '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '/' || source ELSE '' END AS pointer FROM documents)
SELECT doc_id, batch, pointer FROM u WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.batch = u.batch AND starts_with(v.pointer, u.pointer || '/'))""")
def redundant_parents(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents")
    pointer = F.concat(F.lit("/"), "lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/"), "source")).otherwise(""))
    return ledger.redundant_parents(d.select("doc_id", F.floor(F.col("doc_id") / 10).alias("batch"), pointer.alias("pointer"))).select("doc_id", "batch", "pointer")


CITED = """cited AS (SELECT item_id AS question_id, i AS position, (item_id * 7 + i) % (SELECT max(session_id) + 3 FROM turns) AS session_id, CASE WHEN i % 4 = 3 THEN NULL ELSE (item_id + i) % 9 END AS turn_index
  FROM benchmark CROSS JOIN (SELECT unnest(range(6)) AS i)),
chosen AS (SELECT DISTINCT c.question_id, t.session_id, t.turn_index FROM cited c JOIN turns t ON t.session_id = c.session_id WHERE t.turn_index % 2 = 0 AND (c.question_id + t.session_id) % 3 > 0)"""


@query("citation_kinds", f"""WITH {sql.TURNS}, {CITED}, sizes AS (SELECT session_id, count(*) AS n FROM turns GROUP BY 1), picked AS (SELECT question_id, session_id, list(turn_index) AS picked FROM chosen GROUP BY 1, 2),
r AS (SELECT c.*, n, picked, row_number() OVER (PARTITION BY c.question_id, c.session_id, c.turn_index ORDER BY position) > 1 AS twice FROM cited c LEFT JOIN sizes USING (session_id) LEFT JOIN picked p ON p.question_id = c.question_id AND p.session_id = c.session_id)
SELECT question_id, position, session_id, turn_index, CASE WHEN n IS NULL THEN 'unknown_session' WHEN picked IS NULL THEN 'not_selected' WHEN turn_index IS NOT NULL AND NOT turn_index BETWEEN 0 AND n - 1 THEN 'unknown_turn'
WHEN turn_index IS NOT NULL AND NOT list_contains(picked, turn_index) THEN 'turn_not_selected' WHEN twice THEN 'duplicate' ELSE 'valid' END AS kind FROM r""")
def citation_kinds(spark, sf_dir):
    turns = tables.turns(spark, sf_dir)
    most = turns.agg((F.max("session_id") + 3).alias("m"))
    items = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("question_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("position"))
    cited = items.crossJoin(F.broadcast(most)).select("question_id", "position", ((F.col("question_id") * 7 + F.col("position")) % F.col("m")).alias("session_id"), F.when(F.col("position") % 4 != 3, (F.col("question_id") + F.col("position")) % 9).alias("turn_index"))
    chosen = cited.select("question_id", "session_id").distinct().join(turns.select("session_id", "turn_index"), "session_id").where((F.col("turn_index") % 2 == 0) & ((F.col("question_id") + F.col("session_id")) % 3 > 0))
    return ledger.citation_kinds(cited, turns, chosen)


@query("date_filtered", f"""WITH top AS ({retrieval.SESSIONS}),
d AS (SELECT *, DATE '2023-01-01' + CAST(session_id % 365 AS INTEGER) BETWEEN DATE '2023-01-10' AND DATE '2023-02-20' AS inside FROM top),
k AS (SELECT * FROM d QUALIFY inside OR count(*) FILTER (WHERE inside) OVER (PARTITION BY question_id) < 3)
SELECT question_id, session_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM k""")
def date_filtered(spark, sf_dir):
    hits = retrieval.session_ranks(spark, sf_dir).select("question_id", "session_id", tables.date_of(F.col("session_id")).alias("date"), "rank")
    ranges = tables.questions(spark, sf_dir).select("question_id", F.lit("2023/01/10").alias("lo"), F.lit("2023/02/20").alias("hi"))
    return ledger.date_filter(hits, ranges).select("question_id", "session_id", "rank")


@query("count_batches", f"""WITH {sql.TURNS}, b AS (SELECT session_id, turn_index, (row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1) // 3 AS batch, count(*) OVER (PARTITION BY session_id) AS n FROM turns)
SELECT session_id, turn_index, batch FROM b WHERE (batch + 1) * 3 <= n""")
def count_batches(spark, sf_dir):
    return flows.batches_of(tables.turns(spark, sf_dir).select("session_id", "turn_index"), "session_id", ["turn_index"], 3)


@query("count_batches_flushed", f"WITH {sql.TURNS} SELECT session_id, turn_index, (row_number() OVER (PARTITION BY session_id ORDER BY turn_index) - 1) // 3 AS batch FROM turns")
def count_batches_flushed(spark, sf_dir):
    return flows.batches_of(tables.turns(spark, sf_dir).select("session_id", "turn_index"), "session_id", ["turn_index"], 3, flush=True)


@query("token_windows", """SELECT event_id, round(sum(value) OVER w, 4) AS load, count(*) OVER w AS active FROM (SELECT *, epoch_us(ts) AS us FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def token_windows(spark, sf_dir):
    return flows.window_load(tables.table(spark, sf_dir, "events"), "event_type", 3600, "value").select("event_id", F.round("load", 4).alias("load"), "active")


@query("hash_chain", """WITH e AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, event_id FROM events),
m AS (SELECT *, count(*) FILTER (WHERE event_id % 83 = 0) OVER (PARTITION BY stream ORDER BY sequence) AS lost FROM e)
SELECT stream, CAST(sequence AS INTEGER) AS sequence, event_id FROM m WHERE event_id % 83 <> 0 AND (event_id % 97 = 0 OR event_id % 89 = 0 OR lost > 0)""")
def hash_chain(spark, sf_dir):
    """A chain of hashes a user, then tampered with: payloads changed, links changed, and rows taken out."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.col("event_id").alias("order"), "event_id", F.col("event_type").alias("payload"))
    chain = replay.chained(e).withColumn("sequence", F.col("sequence").cast("int"))
    hit = lambda n: F.col("event_id") % n == 0
    tampered = chain.where(~hit(83)).withColumn("payload", F.when(hit(97), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))).withColumn("previous", F.when(hit(89), F.lit("elsewhere")).otherwise(F.col("previous")))
    return flows.verify_chain(tampered).select("stream", "sequence", "event_id")


@query("call_cache", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'miss' WHEN event_id % 7 = 0 THEN 'mismatch' ELSE 'hit' END AS cache FROM events")
def call_cache(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    cache = e.where("event_id % 5 <> 0").select("event_id", F.when(F.col("event_id") % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "event_type", F.lit("x").alias("reply"))
    return flows.call_cache(e, cache, "event_id", ["user_id", "event_type"]).select("event_id", "cache")


@query("windowed_counts", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(spark, sf_dir):
    rows = flows.windowed_counts(tables.table(spark, sf_dir, "events"), "1 hour", "10 minutes")
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("evidence_ledger", f"""WITH {sql.TURNS}, p AS (SELECT session_id, turn_index, content AS excerpt, '/' || role AS pointer FROM turns UNION ALL SELECT session_id, turn_index, content, '/all' FROM turns)
SELECT session_id, turn_index, excerpt, array_to_string(list_sort(list(DISTINCT pointer)), ' ') AS pointers, regexp_matches(lower(excerpt), '\\b(?:before|after|ago|when|how long|days?|weeks?|months?|years?)\\b') AS temporal FROM p GROUP BY session_id, turn_index, excerpt""")
def evidence_ledger(spark, sf_dir):
    t = tables.turns(spark, sf_dir).select("session_id", "turn_index", F.col("content").alias("excerpt"), F.concat(F.lit("/"), "role").alias("pointer"))
    return windows.evidence_ledger(t.unionByName(t.withColumn("pointer", F.lit("/all")))).withColumn("pointers", F.array_join("pointers", " "))


@query("fusion_of_channels", f"""WITH docs AS (SELECT doc_id, text FROM documents), {sql.bm25('docs', 10, name='h1')}, {sql.bm25('docs', 10, 1.2, 0.75, name='h2')},
c AS (SELECT question_id, doc_id, rank, 1 AS channel FROM h1 UNION ALL SELECT question_id, doc_id, rank, 2 FROM h2), f AS (SELECT question_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(DISTINCT channel) AS channels FROM c GROUP BY ALL)
SELECT question_id, doc_id, round(score, 6) AS score, channels, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, channels DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""")
def fusion_of_channels(spark, sf_dir):
    docs, asked = tables.table(spark, sf_dir, "documents").select("doc_id", "text"), tables.questions(spark, sf_dir)
    a = rank.bm25(docs, asked, 10).select("question_id", "doc_id", "rank", F.lit(1).alias("channel"))
    b = rank.bm25(docs, asked, 10, 1.2, 0.75).select("question_id", "doc_id", "rank", F.lit(2).alias("channel"))
    return rank.rrf(a.unionByName(b), top=10, item="doc_id").withColumn("score", F.round("score", 6))
