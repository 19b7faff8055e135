"""SS4, SS7: a hash-chained log, its soundness, and what a restart rebuilds, retries and keeps waiting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import tree


def chained(events: DataFrame) -> DataFrame:
    """SS7: events (stream, order, payload, ...) with sequence from 1, previous and hash, each hash over the one before.

    Events are sorted within partitions and hashed as they pass, so no stream is held, however long.
    """
    others = [f for f in events.schema if f.name != "order"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", sequence long, previous string, hash string"

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, n, last = None, 0, ""
        for b in batches:
            out = []
            for s, payload in zip(b["stream"], b["payload"], strict=True):
                if s != stream:
                    stream, n, last = s, 0, ""
                n, previous = n + 1, last
                last = hashlib.sha256(f"{n}|{previous}|{payload}".encode()).hexdigest()
                out.append((n, previous, last))
            yield pd.concat([b[[f.name for f in others]].reset_index(drop=True), pd.DataFrame(out, columns=["sequence", "previous", "hash"])], axis=1)

    return events.repartition("stream").sortWithinPartitions("stream", "order").mapInPandas(link, schema)


def breaks(log: DataFrame) -> DataFrame:
    """SS7: the first row of each stream that does not follow (stream, sequence, problem)."""
    by = Window.partitionBy("stream").orderBy("sequence")
    own = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous", "payload"), 256)
    rows = log.select("stream", "sequence", "previous", F.coalesce(F.lag("hash").over(by), F.lit("")).alias("link"), F.row_number().over(by).alias("due"), (F.col("hash") == own).alias("own"))
    problem = F.when(F.col("sequence") != F.col("due"), "sequence").when(F.col("previous") != F.col("link"), "link").when(~F.col("own"), "hash")
    return rows.withColumn("problem", problem).where("problem is not null").groupBy("stream").agg(F.min_by(F.struct("sequence", "problem"), "sequence").alias("r")).select("stream", "r.*")


def sound(log: DataFrame) -> DataFrame:
    """The log of the streams that have no break; a broken one resumes nothing."""
    return log.join(breaks(log).select("stream"), "stream", "left_anti")


@dataclass
class Resumed:
    """broken: first bad rows (a stream of which stands still); done: decisions of the batches that the log says were applied;
    cells: the tree that follows; differs: batches whose decisions are not those recorded; retry: sessions of full batches that were
    archived and not applied, to be run first, in order; buffer: archived sessions that fill no batch yet."""

    broken: DataFrame
    done: DataFrame
    cells: DataFrame
    differs: DataFrame
    retry: DataFrame
    buffer: DataFrame


def resume(log: DataFrame, sessions: DataFrame, updates: DataFrame, size: int) -> Resumed:
    """SS4: what a restart does with a log (stream, sequence, payload, previous, hash, event_type, batch_id, session_ids, digest).

    ``sessions(stream, position, session_id)`` is the archive; ``updates`` as for ``tree.decisions`` with the stream as
    case_id. Rows of type ``batch_applied`` name their sessions and the digest of what was decided; an update
    whose batch was not applied is not replayed. Batches are numbered in the order in which sessions came.
    """
    good = sound(log)
    applied = good.where("event_type = 'batch_applied'").select("stream", "batch_id", "session_ids", F.col("digest").alias("recorded"))
    done = tree.decisions(updates.join(applied.select(F.col("stream").alias("case_id"), "batch_id"), ["case_id", "batch_id"], "left_semi"))
    again = tree.batch_digests(done).select(F.col("case_id").alias("stream"), "batch_id", "digest")
    differs = applied.select("stream", "batch_id", "recorded").join(again, ["stream", "batch_id"], "left").where(~F.col("recorded").eqNullSafe(F.col("digest")))
    covered = applied.select("stream", F.explode("session_ids").alias("session_id"))
    waiting = sessions.join(breaks(log).select("stream"), "stream", "left_anti").join(covered, ["stream", "session_id"], "left_anti")
    by = Window.partitionBy("stream")
    place = F.row_number().over(by.orderBy("position", "session_id")) - 1
    rows = waiting.withColumn("batch", F.floor(place / size)).withColumn("n", F.count("*").over(by))
    full = (F.col("batch") + 1) * size <= F.col("n")
    columns = ["stream", "batch", "position", "session_id"]
    return Resumed(breaks(log), done, tree.cells(done), differs, rows.where(full).select(*columns), rows.where(~full).select("stream", "position", "session_id"))
