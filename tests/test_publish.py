"""Publications appear whole or not at all, and say what they hold."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import publish


def run_of(spark, **more):
    cases = spark.createDataFrame([(f"q{i}",) for i in range(20)], "question_id string")
    predictions = cases.withColumn("hypothesis", F.concat(F.lit("answer "), "question_id")).repartition(3)
    judged = cases.withColumn("label", F.lit(True))
    run = publish.Run("run-1", cases, {"predictions": predictions, "judgments": judged, "report": cases.agg(F.count("*").alias("n"))}, ["predictions", "judgments"], dataset_hashes={"data": "abc"})
    return dataclasses.replace(run, **more)


def entries(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc"))


def test_a_run_is_published_once(spark, tmp_path):
    path = publish.publish(run_of(spark), str(tmp_path), "first.1", {"data": "abc"})
    assert entries(tmp_path) == ["first.1"] and path.endswith("/first.1")
    manifest = json.loads(spark.read.text(f"{path}/publication").first().value)
    assert manifest["name"] == "first.1" and {f.split("/")[0] for f in manifest["files"]} == {"predictions", "judgments", "report"}
    assert all(len(h) == 64 for h in manifest["files"].values()) and spark.read.json(f"{path}/predictions").count() == 20
    assert publish.verify(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        publish.publish(run_of(spark), str(tmp_path), "first.1", {"data": "abc"})
    part = next((tmp_path / "first.1" / "predictions").glob("part-*"))
    part.write_text(part.read_text() + "{}\n")
    next((tmp_path / "first.1" / "predictions").glob(f".{part.name}.crc")).unlink()
    (tmp_path / "first.1" / "report" / "part-extra.json").write_text("{}")
    assert {r.problem for r in publish.verify(spark, path).collect()} == {"changed", "added"}


@pytest.mark.parametrize(
    ("more", "said"),
    [
        ({"status": "running"}, "only completed"), ({"failure_count": 2}, "unresolved"), ({"dataset_mode": "oracle"}, "oracle runs"), ({"dataset_hashes": {}}, "hashes differ"),
        ({"keyed": ["predictions", "labels"]}, "missing required publication artifact: labels"),
    ],
)
def test_runs_that_are_refused(spark, tmp_path, more, said):
    with pytest.raises(publish.Refused, match=said):
        publish.publish(run_of(spark, **more), str(tmp_path), "x", {"data": "abc"})
    assert entries(tmp_path) == []


def test_tables_that_are_refused(spark, tmp_path):
    run = run_of(spark)
    p = run.tables["predictions"]
    cases = {"1 missing": p.where("question_id <> 'q3'"), "1 repeated": p.union(p.where("question_id = 'q3'")), "1 unknown": p.union(spark.createDataFrame([("q99", "x")], p.schema)), "possible secret": p.withColumn("hypothesis", F.lit("key sk-" + "a1B2" * 10))}
    for said, bad in cases.items():
        with pytest.raises(publish.Refused, match=said):
            publish.publish(dataclasses.replace(run, tables={**run.tables, "predictions": bad}), str(tmp_path), "x", {"data": "abc"})
    with pytest.raises(publish.Refused, match="letters"):
        publish.publish(run, str(tmp_path), "../x", {"data": "abc"})
    assert entries(tmp_path) == []


def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "t")
    publish.write_atomic(spark.range(5), target)
    assert spark.read.parquet(target).count() == 5
    publish.write_atomic(spark.read.parquet(target).union(spark.range(2)), target)  # reads what it replaces
    assert spark.read.parquet(target).count() == 7 and entries(tmp_path) == ["t"]
    broken = spark.range(3).select(F.assert_true(F.col("id") < 2).alias("x"), "id")
    with pytest.raises(Exception, match="(?i)assert|true"):
        publish.write_atomic(broken, target)
    assert spark.read.parquet(target).count() == 7 and entries(tmp_path) == ["t"]
