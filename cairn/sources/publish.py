"""SNK4, SNK6, SNK7: tables that appear whole or not at all, and publications that are checked, hashed and then moved into place."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class Refused(ValueError):
    """A check that a publication does not pass; nothing that was published before has changed."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename within one file system; the target must not be there."""
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(target)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def replace(spark: SparkSession, fill, target: str) -> None:
    """SNK4: ``fill(path)`` writes beside ``target``, then takes its place; if it fails, what was there stays as it was.

    The old table is set aside by a rename and comes back if the new one cannot be moved, so a reader sees one of the two.
    """
    mark = uuid.uuid4().hex[:12]
    staged, aside = f"{target}.new-{mark}", f"{target}.old-{mark}"
    try:
        fill(staged)
        had = exists(spark, target)
        if had:
            move(spark, target, aside)
        try:
            move(spark, staged, target)
        except Exception:
            if had:
                move(spark, aside, target)
            raise
        if had:
            remove(spark, aside)
    finally:
        remove(spark, staged)


def write_atomic(df: DataFrame, target: str, form: str = "parquet") -> None:
    """SNK4, SNK6: replace the table at ``target`` by ``df``, which may itself read the old one."""
    replace(df.sparkSession, lambda path: df.write.format(form).save(path), target)


@dataclass
class Run:
    """What is to be published: tables by name, of which ``keyed`` must have one row a case; the run's state as its manifest says it."""

    run_id: str
    cases: DataFrame
    tables: dict[str, DataFrame]
    keyed: list[str]
    status: str = "completed"
    failure_count: int = 0
    dataset_mode: str = "full"
    dataset_hashes: dict[str, str] = field(default_factory=dict)


def problems(run: Run, hashes: dict[str, str]) -> list[str]:
    """Why a run cannot be published, in the order of the checks; every table is counted and searched whole, in Spark."""
    found = []
    if run.dataset_mode == "oracle":
        found.append("oracle runs are pipeline checks and cannot be published")
    if run.status != "completed":
        found.append("only completed runs can be published")
    if run.failure_count:
        found.append("run has unresolved failures")
    if run.dataset_hashes != hashes:
        found.append("run dataset hashes differ from the current pinned data")
    cases = run.cases.select("question_id").distinct()
    for name in run.keyed:
        if name not in run.tables:
            found.append(f"missing required publication artifact: {name}")
            continue
        ids = run.tables[name].groupBy("question_id").agg(F.count("*").alias("n"))
        both = cases.withColumn("case", F.lit(True)).join(ids, "question_id", "full_outer")
        bad = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("case").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated")).first().asDict()
        if any(bad.values()):
            found.append(f"{name} must have one row for each case: " + ", ".join(f"{v} {k}" for k, v in bad.items() if v))
    for name, df in run.tables.items():
        whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        if not df.where(whole.rlike(fixed.SECRET_VALUE)).isEmpty():
            found.append(f"possible secret detected in {name}")
    return found


def publish(run: Run, folder: str, name: str, hashes: dict[str, str], now: datetime | None = None) -> str:
    """SNK7: check ``run``, copy its tables as JSON lines beside ``folder/name``, hash every file, write the manifest, and move all
    into place by one rename. An existing publication is never replaced; a check that fails raises and leaves no trace."""
    spark = run.cases.sparkSession
    if not NAME.fullmatch(name):
        raise Refused("a name may contain only letters, numbers, dots, underscores, and dashes")
    target = f"{folder}/{name}"
    if exists(spark, target):
        raise FileExistsError(f"publication already exists: {target}")
    found = problems(run, hashes)
    if found:
        raise Refused("; ".join(found))
    staged = f"{folder}/.{name}-{uuid.uuid4().hex[:12]}"
    try:
        for table, df in run.tables.items():
            df.write.json(f"{staged}/{table}")
        manifest = {"schema_version": 1, "name": name, "run_id": run.run_id, "frozen_at": (now or datetime.now(UTC)).isoformat(timespec="seconds"), "dataset_hashes": hashes, "files": hashed(spark, staged)}
        text = json.dumps(manifest, sort_keys=True)
        if spark.createDataFrame([(text,)], "value string").where(F.col("value").rlike(fixed.SECRET_VALUE)).count():
            raise Refused("possible secret detected in the publication manifest")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{staged}/publication")
        move(spark, staged, target)
    finally:
        remove(spark, staged)
    return target


def hashed(spark: SparkSession, folder: str) -> dict[str, str]:
    """sha-256 of each data file below ``folder`` by its place there; a file a row, as many as the writers made."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    mark = folder.rstrip("/").rpartition("/")[2] + "/"
    rows = files.select(F.substring_index("path", mark, -1).alias("file"), F.sha2("content", 256).alias("sha256")).where(~F.col("file").startswith("publication/"))
    return {r.file: r.sha256 for r in rows.orderBy("file").collect()}


def verify(spark: SparkSession, target: str) -> DataFrame:
    """SNK9: (file, problem) of a publication whose files are not those of its manifest: missing, changed or added."""
    manifest = json.loads(spark.read.text(f"{target}/publication").first().value)
    now, then = hashed(spark, target), manifest["files"]
    wrong = [(f, "missing") for f in then if f not in now] + [(f, "changed") for f in then if f in now and now[f] != then[f]] + [(f, "added") for f in now if f not in then]
    return spark.createDataFrame(sorted(wrong), "file string, problem string")

