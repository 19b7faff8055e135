"""Shared plumbing of the training-data operators: reading, lineage cuts, skew-safe joins, text expressions.

Conventions used by every operator here:

* a document is named by ``doc_id`` *and* the hash of its text, so rows that repeat an id with another text
  never mix, and rows repeated in full all get the same answer;
* tables are read only with Spark's readers, and cut points go to the folder in ``spark.checkpoint.dir``;
* extra input columns never reach a plan, or ride in one struct (``carried``), so no name of theirs can clash.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, nothing else.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or else the context's; only a local session gets one of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-shared-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder; files go when the result is garbage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that nothing refers to any more; it does so when the JVM collects.

    The first round lets go of what Python's objects held in the JVM, the second finds it free.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def carried(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``docs`` as one struct ``own``, whose names clash with none, and ``more`` columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), *[c.alias(k) for k, c in more.items()])


def own_columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` out of ``own``; those named in ``new`` replaced."""
    return [(new[c] if c in new else F.col(f"own.`{c}`")).alias(c) for c in docs.columns]


def ship_package(spark: SparkSession) -> None:
    """Send this package to Python workers that are not told where it lies."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_cairn_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="cairn-package-"), "cairn_package.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "cairn").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(name))
    context._cairn_shipped = True


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound an Arrow batch by bytes as well as rows, as a row may hold megabytes of text."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


_held: dict = {}


def held(key=None, make=None):
    """What a Python worker keeps from task to task: one thing at a time, as the stages of a job take turns in the same
    workers. Without ``make`` it only lets go."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
        if make is None:
            return None
        _held[key] = make()
    return _held[key]


def skew_join(big: DataFrame, small: DataFrame, keys: list[str], rows: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``big`` with ``small`` (one row a key; column ``rows``: how often ``big`` has it).

    Fewer than ``parts`` keys can each hold over ``total / parts`` rows, so those are broadcast; any other key is
    light enough for a shuffle. ``big`` is read twice and should be materialised.
    """
    limit = max(total // parts, 1)
    hot = F.broadcast(small.where(F.col(rows) > limit).drop(rows))
    light = small.where(F.col(rows) <= limit).drop(rows)
    return big.join(hot, keys).unionByName(big.join(hot.select(*keys), keys, "left_anti").join(light, keys))


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(name: str = "text") -> Column:
    """64 bits that, with doc_id, tell rows of one id with different texts apart."""
    return F.xxhash64(F.lit("row"), F.col(name))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; the fast path is for text of one byte a character."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def spaced(c: Column) -> Column:
    """White space other than the space itself becomes a space."""
    for ch in WS[1:]:
        c = F.replace(c, F.lit(ch), F.lit(" "))
    return c


def words_of(c: Column) -> Column:
    """Array of the words of ``c``, in order."""
    return F.array_remove(F.split(spaced(c), " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's variable."""
    return F.transform(F.array(value), body)[0]


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
