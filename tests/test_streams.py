"""Admission against a plain simulation, batch and stream; replay of a log, broken and sound."""

import random

import pytest
from pyspark.sql import functions as F
from test_tree import UPDATES, random_updates, update

from cairn.operators import tree
from cairn.streaming import admission, replay

CALLS = "model string, call_id long, queued_at long, tokens long, lasts long"


def simulate(calls, budget, cap, window):
    """Tick by tick: finish, forget, then start from the head of the queue while it fits."""
    out, queue, active, reserved = {}, [], [], []
    todo = sorted(calls, key=lambda c: (c[2], c[1]))
    now = min((c[2] for c in todo), default=0)
    while todo or queue:
        while todo and todo[0][2] <= now:
            c = todo.pop(0)
            if c[3] > budget:
                out[c[1]] = None
            else:
                queue.append(c)
        active = [e for e in active if e > now]
        reserved = [(s, t) for s, t in reserved if s > now - window]
        while queue and len(active) < cap and sum(t for _, t in reserved) + queue[0][3] <= budget:
            c = queue.pop(0)
            before = sum(t for _, t in reserved)
            out[c[1]] = (now, before, before + c[3], len(active) + 1)
            reserved.append((now, c[3]))
            active += [now + c[4]] if c[4] > 0 else []
        now += 1
    return out


def random_calls(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice("ab"), i, rnd.randint(0, 3 * n), rnd.choice([0, 10, 40, 60, 101]), rnd.randint(0, 40)) for i in range(n)]


def starts(rows):
    return {r.call_id: None if r.problem else (r.started_at, r.reserved_before, r.reserved_after, r.active_after) for r in rows}


@pytest.mark.parametrize(("budget", "cap", "window"), [(100, 2, 60), (100, 100, 60), (100000, 1, 5), (100, 3, 1)])
def test_admission_is_the_simulation(spark, budget, cap, window):
    calls = random_calls(150, budget + cap)
    got = admission.admitted(spark.createDataFrame(calls, CALLS).repartition(4), budget, cap, window).collect()
    assert all(r.waited == r.started_at - r.queued_at >= 0 for r in got if not r.problem)
    assert starts(got) == {k: v for m in "ab" for k, v in simulate([c for c in calls if c[0] == m], budget, cap, window).items()}


def test_admission_literal(spark):
    calls = [("m", 1, 0, 60, 5), ("m", 2, 0, 60, 5), ("m", 3, 1, 20, 5), ("m", 4, 1, 500, 5), (None, 5, 1, 1, 1)]
    got = {r.call_id: (r.started_at, r.waited, r.problem) for r in admission.admitted(spark.createDataFrame(calls, CALLS), 100, 2, 60).collect()}
    assert got == {1: (0, 0, None), 2: (60, 60, None), 3: (60, 59, None), 4: (None, None, "reservation 500 exceeds token budget 100")}
    assert admission.admitted(spark.createDataFrame([], CALLS), 100, 2, 60).count() == 0
    with pytest.raises(ValueError):
        admission.admitted(spark.createDataFrame([], CALLS), 0, 2, 60)


def test_admission_stream_goes_on_after_a_restart(spark, tmp_path):
    calls = sorted(random_calls(90, 3), key=lambda c: (c[2], c[1]))
    whole = starts(admission.admitted(spark.createDataFrame(calls, CALLS), 100, 2, 60).collect())
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (calls[:30], calls[30:50], calls[50:]):  # the query ends and starts again from its checkpoint each time
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        stream = admission.admitted_stream(spark.readStream.schema(CALLS).parquet(source), 100, 2, 60)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert starts(spark.read.parquet(out).collect()) == whole


LOG = "stream string, order long, payload string, event_type string, batch_id string, session_ids array<string>, digest string"


def make_log(spark, applied, digests):
    rows = []
    for stream, batches in applied.items():
        for i, (batch, sessions) in enumerate(batches):
            rows.append((stream, i, f"{batch}:{sessions}", "batch_applied", batch, sessions, digests.get((stream, batch))))
    return replay.chained(spark.createDataFrame(rows, LOG))


def test_chain_and_breaks(spark):
    rows = [(s, i, f"p{i}", "x", None, [], None) for s in "abcd" for i in range(6)]
    log = replay.chained(spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG).repartition(3)).cache()
    assert replay.breaks(log).count() == 0 and replay.sound(log).count() == 24
    assert {r.stream: r.sequence for r in log.groupBy("stream").agg(F.max("sequence").alias("sequence")).collect()} == dict.fromkeys("abcd", 6)
    at = lambda s, n: (F.col("stream") == s) & (F.col("sequence") == n)
    bad = log.where(~at("a", 3)).withColumn("payload", F.when(at("b", 2), "other").otherwise(F.col("payload"))).withColumn("previous", F.when(at("c", 5), "elsewhere").otherwise(F.col("previous")))
    assert {tuple(r) for r in replay.breaks(bad).collect()} == {("a", 4, "sequence"), ("b", 2, "hash"), ("c", 5, "link")}
    assert {r.stream for r in replay.sound(bad).collect()} == {"d"}


def test_resume(spark):
    rows = [update(i, "m/count", i, "observe", batch=f"b{i // 2}", session=f"s{i}", case=c) for c in ("c", "d", "e") for i in range(8)]
    updates = spark.createDataFrame(rows, UPDATES)
    kept = tree.decisions(updates.where("case_id = 'c' and seq < 4 or case_id = 'd' and seq < 2 or case_id = 'e' and seq < 4"))
    digests = {(r.case_id, r.batch_id): r.digest for r in tree.batch_digests(kept).collect()}
    digests["e", "b1"] = "not what was decided"
    applied = {"c": [("b0", ["s0", "s1"]), ("b1", ["s2", "s3"])], "d": [("b0", ["s0", "s1"])], "e": [("b0", ["s0", "s1"]), ("b1", ["s2", "s3"])]}
    log = make_log(spark, applied, digests)
    sessions = spark.createDataFrame([(c, i, f"s{i}") for c in "cde" for i in range(7)], "stream string, position long, session_id string")
    got = replay.resume(log, sessions, updates, 2)
    assert got.broken.count() == 0
    assert {(r.stream, r.batch_id) for r in got.differs.collect()} == {("e", "b1")}
    assert {tuple(r) for r in got.cells.collect()} == {tuple(r) for r in tree.cells(kept).collect()}
    order = lambda df: [tuple(r) for r in df.orderBy("stream", "position").collect()]
    assert order(got.retry) == [("c", 0, 4, "s4"), ("c", 0, 5, "s5"), *[("d", (i - 2) // 2, i, f"s{i}") for i in range(2, 6)], ("e", 0, 4, "s4"), ("e", 0, 5, "s5")]
    assert order(got.buffer) == [("c", 6, "s6"), ("d", 6, "s6"), ("e", 6, "s6")]
    broken = replay.resume(log.withColumn("payload", F.when((F.col("stream") == "c") & (F.col("sequence") == 2), "x").otherwise(F.col("payload"))), sessions, updates, 2)
    assert [tuple(r) for r in broken.broken.collect()] == [("c", 2, "hash")] and {r.stream for r in broken.retry.collect()} == {"d", "e"} and broken.cells.where("case_id = 'c'").count() == 0


def test_resume_of_nothing(spark):
    log = replay.chained(spark.createDataFrame([], LOG))
    sessions = spark.createDataFrame([("c", i, f"s{i}") for i in range(3)], "stream string, position long, session_id string")
    got = replay.resume(log, sessions, spark.createDataFrame(random_updates(5, 1), UPDATES), 2)
    assert got.done.count() == got.broken.count() == 0 and got.retry.count() == 2 and got.buffer.count() == 1
