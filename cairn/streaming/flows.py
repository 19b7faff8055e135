"""Streams and their batch twins (SS1-SS12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

def micros(ts: str):
    """Microseconds since 1970; times without a zone are read in the session's, which should be UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def batches_of(rows: DataFrame, key: str, order: list[str], size: int, flush: bool = False) -> DataFrame:
    """SS2, SS3: ``size`` rows a batch of each key; a last batch that is not full stays out unless flushed."""
    by = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    place = rows.withColumn("batch", F.floor((F.row_number().over(by) - 1) / size).cast("long")).withColumn("n", n)
    return (place if flush else place.where((F.col("batch") + 1) * size <= F.col("n"))).drop("n")


def stream_batches(rows: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """SS2 as a stream: (key, batch, items) as soon as a batch is full; the rest waits in state."""

    def fill(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = state.get if state.exists else (0, [])
        held = list(held)
        for p in parts:
            held += p.sort_values(order)[value].tolist()
        out = []
        while len(held) >= size:
            out.append((at[0], done, held[:size]))
            done, held = done + 1, held[size:]
        state.update((done, held))
        yield pd.DataFrame(out, columns=[key, "batch", "items"])

    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandasWithState(fill, f"{key} {kinds[key]}, batch long, items array<{kinds[value]}>", f"done long, held array<{kinds[value]}>", "append", GroupStateTimeout.NoTimeout)


def window_load(events: DataFrame, key: str, seconds: int, amount: str, inclusive: bool = True) -> DataFrame:
    """SS6: the amount a key within the last ``seconds``, up to each row. The host's edge leaves the oldest instant out.

    Time is cut into spans as long as the window; a row is also sent to the span behind its own, so each span has all
    that its rows look back on, and a key's rows need not be in one task.
    """
    at = micros("ts")
    back = seconds * 1_000_000 - (0 if inclusive else 1)
    home = F.floor(at / (back + 1))
    spread = events.withColumn("_span", F.explode(F.array_distinct(F.array(home, home + 1))))
    by = Window.partitionBy(key, "_span").orderBy(at).rangeBetween(-back, 0)
    rows = spread.withColumn("load", F.sum(amount).over(by)).withColumn("active", F.count("*").over(by))
    return rows.where(F.col("_span").eqNullSafe(home)).drop("_span")


def verify_chain(events: DataFrame) -> DataFrame:
    """SS7: events (stream, sequence, payload, previous, hash): rows whose number, link or own hash is wrong."""
    by = Window.partitionBy("stream").orderBy("sequence")
    own = F.sha2(F.concat_ws("|", F.col("sequence").cast("string"), "previous", "payload"), 256)
    rows = events.withColumn("link", F.coalesce(F.lag("hash").over(by), F.lit(""))).withColumn("due", F.row_number().over(by))
    return rows.where((F.col("sequence") != F.col("due")) | (F.col("previous") != F.col("link")) | (F.col("hash") != own)).drop("link", "due")


def exactly_once(new: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """SS8: the first row of each id that is not done yet."""
    return new.dropDuplicates([id_]).join(done.select(id_), id_, "left_anti")


def ingest(stream: DataFrame, target: str, id_: list[str], checkpoint: str):
    """SS1, SS8: append each micro-batch's new ids to ``target`` once, whatever is delivered again."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates(id_)
        try:
            batch = batch.join(spark.read.parquet(target).select(*id_), id_, "left_anti")
        except Exception as e:  # the first batch finds no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        batch.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_cache(calls: DataFrame, cache: DataFrame, key: str, identity: list[str]) -> DataFrame:
    """SS9: a cached reply counts if every identity column agrees; one that differs is a mismatch."""
    c = cache.select(key, F.struct(*identity).alias("held"), "reply")
    joined = calls.join(c, key, "left")
    same = F.struct(*identity) == F.col("held")
    return joined.withColumn("cache", F.when(F.col("held").isNull(), "miss").when(same, "hit").otherwise("mismatch")).drop("held")


def tail(events: DataFrame, cursor: int) -> DataFrame:
    """SS12: what came after the cursor, in order."""
    return events.where(F.col("sequence") > cursor)


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Our extension: tumbling windows with a watermark, for streams and batches alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
