"""Quality rules in DataFrame functions only: per-document rules, then line frequency across a host's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, carried, cut, let, own_columns, skew_join, spaced, strip_ws, text_of, words_of

WINDOW = 5


def repeated_words(words: Column) -> Column:
    """Words that lie in a ``WINDOW``-word window found twice or more in the text, the first included.

    Windows are compared by 64-bit hashes. Only a text in which some hash repeats pays for the sort that gives the
    windows' places; then each place covers the words up to the next one, five at most.
    """
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def places(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        def twice(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        return let(by_hash, twice)

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)))


def base_rules(docs: DataFrame, **keep: Column) -> DataFrame:
    """``keep`` columns by name, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each text."""
    text = text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(strip_ws(x)) > 0)
    rows = docs.select(
        *[c.alias(k) for k, c in keep.items()],
        F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("w"),
    )
    rows = rows.select(*keep, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, host, line, words): the different lines of each document by hash; a null source is a host of its own.

    ``words`` are those of the line wherever it stands, so a row that is there twice has them twice.
    """
    text = text_of()
    parts = docs.select("doc_id", row_of().alias("row"), host_of().alias("host"), F.explode(F.split(text, "\n")).alias("line"))
    keyed = parts.select("doc_id", "row", "host", line_key(F.col("line")).alias("key")).where(F.length("key") > 0)
    return cut(keyed.groupBy("doc_id", "row", "host", F.xxhash64("key").alias("line")).agg(F.sum(F.size(words_of(F.col("key")))).alias("words")))


def row_of() -> Column:
    """64 bits that tell the texts of one id apart; null is as empty."""
    return F.xxhash64(F.lit("row"), text_of())


def host_of() -> Column:
    return F.coalesce(F.xxhash64("source"), F.lit(0))


def line_key(line: Column) -> Column:
    return ascii_lower(strip_ws(line))


def common_lines(docs: DataFrame, base: DataFrame, min_docs: int, share: float | None) -> DataFrame:
    """The rows of ``host_lines`` whose line too many documents of the host hold.

    A line counts once a document. With ``share``, exact copies of a text count as one document of their host, and the
    limit is the larger of ``min_docs`` and ``share`` of the host's different texts. Without, every document counts
    and ``min_docs`` is the limit, however large the host is.
    """
    lines = host_lines(docs)
    if share is None:
        common = cut(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs))
    else:
        texts = base.select("host", "row").distinct().groupBy("host").agg(F.count("*").alias("texts"))
        held = cut(lines.groupBy("host", "line", "row").agg(F.count("*").alias("n")).groupBy("host", "line").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") > min_docs))
        hosts = cut(held.groupBy("host").agg(F.count("*").alias("of_host")).join(texts, "host"))
        limits = skew_join(held, hosts, ["host"], "of_host", held.count())
        common = cut(limits.where(F.col("docs") > F.greatest(F.lit(float(min_docs)), F.col("texts") * F.lit(float(share)))).select("host", "line", "n"))
    return skew_join(lines, common, ["host", "line"], "n", lines.count())


def quality(docs: DataFrame, min_docs: int = 20, share: float | None = 0.1, min_words: int = 10, min_left: float = 0.2) -> DataFrame:
    """``docs(doc_id, text, source)`` -> base rules, ``n_common_words``, ``kept``, ``host`` and ``common`` for each row.

    Native functions only. ``kept`` is false if the base rules fail, or if fewer than ``min_words`` words, or less
    than ``min_left`` of all words, remain without the lines common on the document's host; ``common`` has the hashes
    of these lines (null: none). Null text has no words and fails; null ids and sources are ordinary values. A row that
    is there several times gets in each place what it would get alone, and counts as one document of its host; rows
    of one id that differ in text or source are judged each by its own. Texts of any length are read whole; an empty
    table gives an empty result; extra columns are ignored.
    """
    base = cut(base_rules(docs, doc_id=F.col("doc_id"), row=row_of(), host=host_of()))
    by = ["doc_id", "row", "host"]
    lines = common_lines(docs, base, min_docs, share).groupBy(*by).agg(F.sum("words").alias("gone"), F.collect_set("line").alias("common"))
    copies = base.groupBy(*by).agg(F.count("*").alias("copies")).where("copies > 1").select(*by, F.lit(0).cast("long").alias("gone"), F.lit(None).cast("array<long>").alias("common"), "copies")
    found = lines.withColumn("copies", F.lit(1).cast("long")).unionByName(copies).groupBy(*by).agg(F.max("gone").alias("gone"), F.max("copies").alias("copies"), F.max("common").alias("common"))
    found = found.where("gone > 0").select(*[F.col(c).alias(f"{c}2") for c in by], (F.col("gone") / F.col("copies")).cast("long").alias("gone"), "common")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("row") == F.col("row2")) & (F.col("host") == F.col("host2"))
    rows = base.join(found, same, "left").withColumn("n_common_words", F.coalesce("gone", F.lit(0)))
    left = F.col("n_words") - F.col("n_common_words")
    depleted = (left < min_words) | (left < F.col("n_words") * F.lit(min_left))
    return rows.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("doc_id2", "row2", "host2", "gone")


def quality_texts(docs: DataFrame, with_lines: bool = False, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the input's columns; ``params`` are those of ``quality``.

    ``text`` is without the lines common on the host, and ``n_chars``, if there is one, follows it; ``with_lines``
    leaves both as they came. The other lines stay as they are, blank ones too.
    """
    rules = quality(docs.select("doc_id", "text", "source"), **params).where("kept").select("doc_id", "row", "host", "common").dropDuplicates(["doc_id", "row", "host"])
    kept = rules.withColumnsRenamed({c: f"{c}2" for c in ("doc_id", "row", "host")})
    rows = carried(docs, doc_id=F.col("doc_id"), row=row_of(), host=host_of())
    joined = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("row") == F.col("row2")) & (F.col("host") == F.col("host2")))
    if with_lines:
        return joined.select(*own_columns(docs))
    text = F.col("own.text")
    stay = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("common"), F.xxhash64(line_key(x))))
    new = joined.withColumn("text", F.when(F.col("common").isNull(), text).otherwise(F.array_join(stay, "\n")))
    return new.select(*own_columns(docs, text=F.col("text"), n_chars=F.length("text").cast("long")))


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return quality(docs).drop("row", "host", "common")


OP6_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM wins QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS r FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY rid),
lines AS (SELECT rid, source, body, unnest(string_split(text, chr(10))) AS line FROM base),
dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS d FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
keyed AS (
  SELECT rid, source, body, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hosts AS (SELECT source, count(DISTINCT body) AS texts FROM base GROUP BY source),
common AS (
  SELECT k.source, k.key FROM keyed k JOIN hosts h ON k.source IS NOT DISTINCT FROM h.source WHERE k.key <> ''
  GROUP BY k.source, k.key HAVING count(DISTINCT k.body) > greatest(20.0, 0.1 * any_value(h.texts))),
gone AS (
  SELECT k.rid, CAST(sum(len(regexp_extract_all(k.key, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS g
  FROM keyed k JOIN common c ON k.source IS NOT DISTINCT FROM c.source AND k.key = c.key GROUP BY k.rid),
facts AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(g, 0) AS BIGINT) AS n_common_words
  FROM base b LEFT JOIN dups USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND NOT (n_words - n_common_words < 10 OR n_words - n_common_words < n_words * 0.2::DOUBLE) AS kept
FROM judged
"""
