"""Queries over versioned trees, their logs, slots of sources, and the admission of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tree
from ..sources import tables
from ..streaming import admission, replay

QUERIES, SQL = {}, {}


def query(name: str, oracle: str = ""):
    def add(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return add


def updates(spark, sf_dir):
    """Every event as an update of its user's tree: sign-ups and purchases set a fact, other events are observations that
    hold from the day their property names, so many come late."""
    e = tables.table(spark, sf_dir, "events")
    fact, day = F.col("event_type").isin("signup", "purchase"), F.date_format("ts", "yyyy/MM/dd")
    effective = F.date_add(F.lit("2024-01-01"), F.get_json_object("props", "$.k").cast("int")).cast("string")
    who = F.array(F.struct(F.col("event_id").cast("string").alias("session_id"), F.lit(0).cast("long").alias("turn_index"), day.alias("date"), day.alias("batch_id")))
    return e.select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_id").alias("seq"), day.alias("batch_id"), F.lit("activity").alias("domain"), F.array("event_type").alias("path"),
        F.when(fact, "fact").otherwise("measurement").alias("kind"), F.when(fact, "set").otherwise("observe").alias("mode"), F.col("value").cast("string").alias("value"), effective.alias("effective_at"),
        day.alias("observed_at"), F.when(fact, "usd").alias("unit"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("problem"), who.alias("sources"),
    )


#: Assertions as they stand: a fact's equal ones in a row are one, with the first one's text and the last one's source.
STATES = """u AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_id AS seq, event_type AS t, value, event_type IN ('signup', 'purchase') AS fact, strftime(ts, '%Y/%m/%d') AS day,
  strftime(DATE '2024-01-01' + CAST(props->>'k' AS INTEGER), '%Y-%m-%d') AS eff FROM events),
m AS (SELECT *, coalesce(fact AND value = lag(value) OVER w AND eff = lag(eff) OVER w, false) AS same FROM u WINDOW w AS (PARTITION BY case_id, t ORDER BY seq)),
r AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, t ORDER BY seq) AS run FROM m),
states AS (SELECT case_id, t, run, any_value(fact) AS fact, any_value(eff) AS eff, any_value(value) AS value, max(seq) AS seq,
  arg_min('{"effective_at":"' || eff || '","observed_at":"' || day || '","unit":' || CASE WHEN fact THEN '"usd"' ELSE 'null' END || ',"value":' || CAST(value AS VARCHAR) || '}', seq) AS body FROM r GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY case_id, t ORDER BY CASE WHEN fact THEN '' ELSE eff END DESC, seq DESC) = 1 AS current, '/context/activity/' || t AS pointer FROM states)"""


@query("tree_cells", f"""WITH {STATES}
SELECT case_id, pointer, CASE WHEN any_value(fact) THEN 'fact' ELSE 'measurement' END AS kind, max(CASE WHEN current THEN body END) AS current, count(DISTINCT CASE WHEN NOT current THEN body END) AS history_count FROM placed GROUP BY case_id, pointer""")
def tree_cells(spark, sf_dir):
    return tree.cells(tree.decisions(updates(spark, sf_dir)))


@query("tree_history", f"""WITH {STATES} SELECT DISTINCT case_id, pointer, 'observation_' || substr(sha256(body), 1, 12) AS retired_key, body AS retired FROM placed WHERE NOT current""")
def tree_history(spark, sf_dir):
    return tree.history(tree.decisions(updates(spark, sf_dir)))


@query("tree_provenance", f"""WITH {STATES},
spots AS (SELECT case_id, pointer || CASE WHEN current THEN '/current' ELSE '/history/observation_' || substr(sha256(body), 1, 12) END AS place, max(seq) AS seq FROM placed GROUP BY ALL)
SELECT case_id, place || '/' || leaf AS pointer, CAST(seq AS VARCHAR) AS session_id FROM spots CROSS JOIN (SELECT unnest(['value', 'observed_at', 'effective_at', 'unit']) AS leaf)
UNION ALL SELECT case_id, '/context/activity/' || t, CAST(seq AS VARCHAR) FROM u""")
def tree_provenance(spark, sf_dir):
    return tree.provenance(tree.decisions(updates(spark, sf_dir))).select("case_id", "pointer", "session_id")


@query("tree_values", f"""WITH {STATES}, c AS (SELECT case_id, pointer, any_value(fact) AS fact, max(CASE WHEN current THEN value END) AS value, count(DISTINCT CASE WHEN NOT current THEN body END) AS history_count FROM placed GROUP BY case_id, pointer)
SELECT case_id, pointer || '/current/value' AS pointer, 'number' AS type, value AS number, history_count FROM c
UNION ALL SELECT case_id, pointer || '/current/unit', CASE WHEN fact THEN 'string' ELSE 'null' END, NULL, history_count FROM c""")
def tree_values(spark, sf_dir):
    """Pointers of each user and kind of event, also to what is not there, looked up in the trees."""
    u = updates(spark, sf_dir)
    asked = u.select("case_id", F.explode(F.array(*map(F.lit, ("value", "unit", "none")))).alias("leaf"), F.element_at("path", 1).alias("t")).distinct()
    pointers = asked.select("case_id", F.concat(F.lit("/context/activity/"), "t", F.lit("/current/"), "leaf").alias("pointer"))
    found = tree.evaluated(pointers, tree.cells(tree.decisions(u)))
    return found.select("case_id", "pointer", "type", F.when(F.col("type") == "number", F.col("value").cast("double")).alias("number"), "history_count")


@query("resumed_batches", """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS stream, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events),
b AS (SELECT *, place // 5 AS batch FROM n), d AS (SELECT stream, batch, max(ts) <= TIMESTAMP '2024-01-20' AND count(*) = 5 AS applied FROM b GROUP BY ALL),
w AS (SELECT stream, event_id, row_number() OVER (PARTITION BY stream ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY stream) AS total FROM b JOIN d USING (stream, batch) WHERE NOT applied)
SELECT stream, CAST(event_id AS VARCHAR) AS session_id, CASE WHEN (place // 5 + 1) * 5 <= total THEN 'retry' ELSE 'buffer' END AS what, CASE WHEN (place // 5 + 1) * 5 <= total THEN place // 5 END AS batch FROM w""")
def resumed_batches(spark, sf_dir):
    """A process that applied its users' batches of five events until January 20 and then stopped: what a restart retries and
    keeps, from a log whose hashes and digests it checks."""
    from pyspark.sql import Window

    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("session_id"), "ts")
    place = F.floor((F.row_number().over(Window.partitionBy("stream").orderBy("position")) - 1) / 5)
    dealt = e.withColumn("batch_id", F.concat(F.lit("b"), place.cast("string")))
    own = updates(spark, sf_dir).drop("batch_id").join(dealt.select(F.col("stream").alias("case_id"), F.col("position").alias("seq"), "batch_id"), ["case_id", "seq"])
    batches = dealt.groupBy("stream", "batch_id").agg(F.max("ts").alias("ts"), F.max("position").alias("order"), F.transform(F.array_sort(F.collect_list(F.struct("position", "session_id"))), lambda x: x.session_id).alias("session_ids"))
    applied = batches.where((F.size("session_ids") == 5) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp")))
    kept = tree.batch_digests(tree.decisions(own)).select(F.col("case_id").alias("stream"), "batch_id", "digest")
    events = applied.join(kept, ["stream", "batch_id"]).select("stream", "order", F.concat_ws(":", "batch_id", F.array_join("session_ids", ","), "digest").alias("payload"), F.lit("batch_applied").alias("event_type"), "batch_id", "session_ids", "digest")
    got = replay.resume(replay.chained(events), e, own, 5)
    rows = got.retry.select("stream", "session_id", F.lit("retry").alias("what"), F.col("batch").cast("long").alias("batch")).unionByName(got.buffer.select("stream", "session_id", F.lit("buffer").alias("what"), F.lit(None).cast("long").alias("batch")))
    # a digest that is not the recorded one, or a break, would show as a row of its own
    odd = got.differs.select("stream", F.col("batch_id").alias("session_id"), F.lit("differs").alias("what")).unionByName(got.broken.select("stream", F.col("sequence").cast("string").alias("session_id"), F.lit("broken").alias("what")))
    return rows.unionByName(odd.withColumn("batch", F.lit(None).cast("long")))


@query("call_admission")
def call_admission(spark, sf_dir):
    """When each event may start as a call of its type: 600 tokens in two hours, three at once, in minutes."""
    e = tables.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    calls = e.select(F.col("event_type").alias("model"), F.col("event_id").alias("call_id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("queued_at"), F.ceil("value").alias("tokens"), k.alias("lasts"))
    return admission.admitted(calls, 600, 3, 120)


@query("slot_sources")
def slot_sources(spark, sf_dir):
    """Each turn quoted as if it were the turn before, in batches of ten conversations: where the quotes are found."""
    t = tables.turns(spark, sf_dir)
    batch = F.floor(F.col("session_id") / 10)
    cited = t.select(batch.alias("batch_id"), F.col("session_id").alias("update"), F.col("turn_index").alias("place"), F.concat(F.lit("session_"), (F.col("session_id") % 10 + 1).cast("string")).alias("session_slot"), F.concat(F.lit("turn_"), F.col("turn_index").cast("string")).alias("turn_slot"), F.col("content").alias("quote"))
    sessions = t.select(batch.alias("batch_id"), (F.col("session_id") % 10).alias("slot"), "session_id", "date").distinct()
    return tree.slot_sources(cited, sessions, t).select("batch_id", "update", "place", "session_id", "turn_index", "how", "warning")
