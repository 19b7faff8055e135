"""Line dedup: explode normalised lines, hash, count documents a hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, carried, cut, own_columns, skew_join, strip_ws, text_hash, text_of


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, pos, k1, k2): each line whose key has ``min_chars`` code points, under a 128-bit hash."""
    lines = docs.where("doc_id is not null").select("doc_id", text_hash().alias("row"), F.posexplode(F.split(text_of(), "\n")).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", ascii_lower(strip_ws(F.col("line"))).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("line"), "key").alias("k2"))


def dropped_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row, gone): sorted positions of the lines that a smaller doc_id also holds."""
    lines = cut(line_table(docs, min_chars))
    keys = cut(lines.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last"))
    again = skew_join(lines, keys, ["k1", "k2"], "n", lines.count()).where("doc_id <> first")
    return again.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``docs(doc_id, text, ...)`` with columns ``kept_text``, ``n_lines`` and ``n_dropped`` added.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of ``min_chars`` or more code
    points that two documents hold stay only in the smallest doc_id (all their lines there stay). Null or empty
    text: one empty line. Rows without doc_id keep all lines and are no holders. Repeated rows each get the same
    result, and rows of one id with different texts hold lines as one document. Texts of any length are read whole;
    an empty table gives an empty one. Input columns of the three new names are replaced, all others pass through.
    """
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars)
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("kept_text", "n_lines", "n_dropped")])
    joined = carried(own, doc_id=F.col("doc_id"), row=text_hash()).join(gone, ["doc_id", "row"], "left")
    text = F.coalesce(F.col("own.text"), F.lit(""))
    split = joined.withColumn("lines", F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda p: F.get(F.col("lines"), p)), "\n")
    return split.select(
        *own_columns(own),
        F.when(F.col("gone").isNull(), text).otherwise(kept).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(h.first <> k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
