"""Reading and checking inputs: chat sessions, cases, notes and the stand-in tables (SRC, SNK, D-invariants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN = "struct<role:string,content:string>"
CASE_SCHEMA = f"question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>, answer_session_ids array<string>"
NOTES_SCHEMA = "session_id string, facts array<struct<text:string,turn_index:int>>, keyphrases array<string>, events array<struct<text:string,date_hint:string,turn_index:int>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: a whole-file JSON list of cases; malformed files fail."""
    return spark.read.schema(CASE_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2, SRC9: JSON lines; blank lines are none."""
    return spark.read.schema(schema).json(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """SRC5, SRC6: session annotations, blank facts, phrases and events dropped."""
    raw = spark.read.schema(NOTES_SCHEMA).option("multiLine", True).json(path)
    return raw.select(
        "session_id",
        F.filter("facts", lambda x: F.trim(x.text) != "").alias("facts"),
        F.filter("keyphrases", lambda x: F.trim(x) != "").alias("keyphrases"),
        F.filter("events", lambda x: F.trim(x.text) != "").alias("events"),
    )


RANGE = "struct<has_temporal_constraint:boolean,start_date:string,end_date:string>"


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: (question_id, found) of date ranges: one file, a folder's ``_index.json``, or else a file a question.

    A file of many holds an object of ranges by question, or has it under ``ranges``. A file of one names its question, or is
    named after it; files whose names begin with ``_`` are none.
    """
    under = F.from_json("value", f"struct<ranges:map<string,{RANGE}>>").ranges
    many = lambda rows: rows.select(F.explode(F.coalesce(under, F.from_json("value", f"map<string,{RANGE}>"))).alias("question_id", "found"))
    if path.endswith(".json"):
        return many(spark.read.option("wholetext", True).text(path))
    index = spark._jvm.org.apache.hadoop.fs.Path(path, "_index.json")
    held = index.getFileSystem(spark._jsc.hadoopConfiguration())
    if held.exists(index):
        # Spark's readers pass over names that begin with "_"; this one file holds a line a question
        stream = held.open(index)
        try:
            value = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return many(spark.createDataFrame([(value,)], "value string"))
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    stem = F.regexp_replace(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -1)), r"\.json$", "")
    own = files.select(stem.alias("stem"), F.from_json("value", f"struct<question_id:string,{RANGE[7:-1]}>").alias("r"))
    return own.select(F.coalesce(F.nullif("r.question_id", F.lit("")), "stem").alias("question_id"), F.struct("r.has_temporal_constraint", "r.start_date", "r.end_date").alias("found"))


def official_predictions(predictions: DataFrame) -> DataFrame:
    """SNK6: the two columns that a benchmark's judge reads, as JSON lines with sorted keys."""
    return predictions.select(F.to_json(F.struct(F.col("hypothesis"), F.col("question_id")), {"ignoreNullFields": "false"}).alias("value"))


def exposed_ids(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """SRC10: ids of ``ids(id)`` that some file under ``path`` names between quotes."""
    found = spark.read.option("recursiveFileLookup", True).text(path).select(F.explode(F.regexp_extract_all("value", F.lit('"([^"]+)"'), F.lit(1))).alias("id"))
    return ids.join(found.distinct(), "id", "left_semi")


def write_once(df: DataFrame, path: str) -> None:
    """SNK3: refuse to overwrite."""
    df.write.mode("errorifexists").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    """SNK1."""
    df.write.mode("append").json(path)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """SNK5: a sequence number from 1 within each key."""
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SNK9: sha-256 and length of each file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def pages_of(df: DataFrame, order: list[str], per_page: int) -> DataFrame:
    """SNK8: page numbers of an export; one row a session reaches the ordering."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / per_page).cast("long"))


def sessions_of(cases: DataFrame) -> DataFrame:
    """D3: one row a session of each case, the first of repeated ids (PF3)."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    rows = cases.select("question_id", F.posexplode(zipped).alias("position", "s")).select("question_id", "position", "s.*")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("question_id", "session_id").orderBy("position"))).where("n = 1").drop("n")


def violations(cases: DataFrame, types: list[str]) -> DataFrame:
    """D-invariants: (question_id, problem) for every broken rule."""
    rules = {
        "blank id": F.trim("question_id") == "",
        "unknown type": ~F.col("question_type").isin(types),
        "array lengths": (F.size("haystack_session_ids") != F.size("haystack_dates")) | (F.size("haystack_session_ids") != F.size("haystack_sessions")),
        "blank question": F.trim("question") == "",
        "turn role": F.exists(F.flatten("haystack_sessions"), lambda t: ~t.role.isin("user", "assistant")),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    twice = cases.groupBy("question_id").count().where("count > 1").select("question_id", F.lit("repeated id").alias("problem"))
    return cases.select("question_id", F.explode(broken).alias("problem")).unionByName(twice)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in chat: user and assistant turns, numbered from 0, under a date made from the session's number."""
    said = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return said.select(F.col("conv_id").alias("session_id"), place.cast("long").alias("turn_index"), "role", F.coalesce("text", F.lit("")).alias("content"), date_of(F.col("conv_id")).alias("date"))


def date_of(session):
    return F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), (session % 365).cast("int")), "yyyy/MM/dd")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, doc_id): documents that hold the item's text verbatim. For metrics only.

    Items and documents meet on the item's longest inner word, which spaces bound in both. An item of one or two words
    has none; it meets the documents on its first word, or its last, as the end, or the beginning, of one of theirs.
    """
    q = questions(spark, sf_dir).where("question <> ''").withColumn("ws", F.split("question", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    inner = F.slice("ws", 2, F.size("ws") - 2)
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    asked = q.where(F.size("ws") > 2).select("question_id", longest.alias("w"))
    held = words.join(asked, "w").select("doc_id", "question_id")
    few = q.where(F.size("ws") <= 2).select("question_id", F.col("ws")[0].alias("part"), (F.size("ws") == 1).alias("alone"))
    n = few.select(F.length("part").alias("k"), "alone").distinct()
    ends = F.when(F.col("alone"), F.transform(F.sequence(F.lit(1), F.length("w") - F.col("k") + 1), lambda i: F.substring("w", i, F.col("k")))).otherwise(F.array(F.substring(F.col("w"), F.length("w") - F.col("k") + 1, F.col("k"))))
    pieces = words.join(F.broadcast(n), F.length("w") >= F.col("k")).select("doc_id", "alone", F.explode(ends).alias("part"))
    held = held.unionByName(pieces.join(few, ["part", "alone"]).select("doc_id", "question_id")).distinct()
    return held.join(docs, "doc_id").join(q.drop("ws"), "question_id").where(F.contains("text", F.col("question"))).select("question_id", "doc_id")
