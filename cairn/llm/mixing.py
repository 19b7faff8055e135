"""Mixing sources to target weights by hash thresholds: histograms of tokens, no sort of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, cut, own_columns

#: Bits of a document's place on the hash line, and bits that one histogram resolves.
HASH_BITS, STEP = 60, 12
#: Most sources whose table is broadcast; beyond it the table is spread over salts.
BROADCAST_SOURCES, SALTS = 100_000, 64


def size_of(name: str = "text") -> Column:
    """Words of the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def place_of() -> Column:
    """A document's fixed place on the hash line, 0 to 2^60 - 1; without doc_id that of its text, or else that of none."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def running(rows: DataFrame, order: list[str], *sums: str) -> DataFrame:
    """``rows`` with ``i``, how many come before in ``order``, and ``before_<x>`` and ``all_<x>`` of each of ``sums``.

    Rows are dealt out by ranges, so no task holds all; only sums a range are put in order at once.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ranges = dealt.groupBy("part").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"part_{x}") for x in sums])
    ahead, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"), *[F.coalesce(F.sum(f"part_{x}").over(ahead), F.lit(0.0)).alias(f"part_{x}") for x in sums], *[F.sum(f"part_{x}").over(whole).alias(f"all_{x}") for x in sums])
    inside = Window.partitionBy("part").orderBy(*order)
    out = dealt.join(F.broadcast(ranges), "part").withColumn("i", F.col("first") + F.row_number().over(inside) - 1)
    for x in sums:
        out = out.withColumn(f"before_{x}", F.col(f"part_{x}") + F.coalesce(F.sum(x).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return out.drop("part", "first", *[f"part_{x}" for x in sums])


def targets(sizes: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """``sizes(src, none, source_size)``, a row a source -> the same with ``target``.

    Sources in order of code points, null last, get ``weights`` in turn and share ``budget`` times all sizes; a
    target stops at ``cap`` times the source, and the excess goes to the others by weight. In order of cap to weight,
    the sources that stop are a prefix, so running sums find them at once.
    """
    given = running(sizes, ["none", "src"]).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("i") % len(weights) + 1).cast("int")))
    by_ratio = given.drop("i").withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w")).withColumn("size", F.col("source_size").cast("double"))
    w = running(by_ratio, ["ratio", "none", "src"], "most", "w", "size")
    level = (F.col("all_size") * F.lit(float(budget)) - F.col("before_most")) / (F.col("all_w") - F.col("before_w"))
    open_ = cut(w.select("src", "none", "source_size", "w", "most", "ratio", level.alias("level")))
    share = open_.where(F.col("level") * F.col("w") <= F.col("most")).agg(F.min(F.struct("ratio", "level"))["level"].alias("share"))
    out = open_.crossJoin(F.broadcast(share))  # one row
    return out.select("src", "none", "source_size", F.least(F.coalesce(F.col("share") * F.col("w"), F.col("most")), F.col("most")).alias("target"))


def join_sources(big: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """Join on (src, none): broadcast up to BROADCAST_SOURCES rows, else spread each source over SALTS."""
    if n <= BROADCAST_SOURCES:
        return big.join(F.broadcast(sources), ["src", "none"])
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.col("place"), F.lit(SALTS)).cast("int")).join(salted, ["src", "none", "salt"]).drop("salt")


def thresholds(sized: DataFrame, weights: list[float], budget: float, cap: float) -> tuple[DataFrame, int]:
    """``sized(src, none, place, size)`` -> a row a source: source_size, target, copies, below; and their number.

    A source's documents are taken ``copies`` times, and once more where ``place < below``. Sizes are summed by
    source and leading hash bits; the bucket in which the budget ends is the only one that the next histogram
    reads, until it holds one place. That place is taken if it brings the sum nearer.
    """
    sums = cut(sized.groupBy("src", "none").agg(F.sum("size").alias("source_size")))
    n = sums.count()
    goal = cut(targets(sums, weights, budget, cap))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("copies", full.cast("long")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    done, state, shift = None, goal.withColumn("prefix", F.lit(0).cast("long")), HASH_BITS
    near = sized
    while True:
        near = near if shift == HASH_BITS else cut(join_sources(near, state.select("src", "none", "prefix"), n).where(F.shiftright("place", shift) == F.col("prefix")).drop("prefix"))
        low = max(shift - STEP, 0)
        hist = near.groupBy("src", "none", F.shiftright("place", low).alias("bucket")).agg(F.sum("size").alias("s"), F.min("place").alias("p"), F.max("place").alias("q"))
        run = F.sum("s").over(Window.partitionBy("src", "none").orderBy("bucket"))
        joined = join_sources(hist.withColumn("upto", run).withColumn("place", F.col("p")), state, n).where(F.col("upto") > F.col("left"))
        # the first bucket that passes the budget, a row a source
        edge = joined.groupBy("src", "none").agg(F.min_by(F.struct("source_size", "target", "copies", (F.col("left") - F.col("upto") + F.col("s")).alias("left"), F.col("bucket").alias("prefix"), "s", "p", "q"), "bucket").alias("e")).select("src", "none", "e.*")
        edge = cut(edge)
        single = edge.where("p = q").withColumn("below", F.col("p") + F.when(2 * F.col("left") >= F.col("s"), 1).otherwise(0))
        done = single if done is None else done.unionByName(single)
        state = edge.where("p <> q").drop("s", "p", "q")
        shift = low
        if not state.limit(1).count():
            break
    # a source in which no bucket passes the budget has nothing left to add beyond its last place
    found = done.select("src", "none", "below")
    return cut(goal.drop("left").join(found, ["src", "none"], "left").withColumn("below", F.coalesce("below", F.when(F.col("target") > F.col("copies") * F.col("source_size"), F.lit(1 << HASH_BITS)).otherwise(F.lit(0))))), n


def planned(docs: DataFrame, weights: list[float], budget: float, cap: float) -> DataFrame:
    """``own`` (the row) and size, source_size, target, copies of each document."""
    keyed = carried(docs, src=F.coalesce(F.col("source"), F.lit("")), none=F.col("source").isNull(), place=place_of(), size=size_of())
    plan, n = thresholds(cut(keyed.drop("own")), list(weights), budget, cap)
    copies = (F.col("copies") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)).cast("int")
    return join_sources(keyed, plan, n).select("own", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with ``_mix``: struct(size, source_size, target, copies).

    ``copies`` (0, 1 or 2 with the defaults) is how often the mix takes a document; it depends on doc_id and the
    corpus alone, so reruns agree and repeated rows fare alike. Null or empty text has size 0, texts of any length are
    counted whole, null source is a source of its own, after all others. Rows without doc_id have the places of their
    texts. An empty table gives an empty one. An input column ``_mix`` is replaced, all others pass through.
    """
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "_mix"])
    return planned(own, weights, budget, cap).select(*own_columns(own), F.struct("size", "source_size", "target", "copies").alias("_mix"))


def mixed_documents(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: the input's columns, each document as often as it is taken; see ``mix`` for the odd cases."""
    taken = planned(docs, weights, budget, cap).select("own", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select(*own_columns(docs))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = mix(docs)
    return m.select("doc_id", F.col("_mix.size").alias("size"), F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("_mix.copies") * F.col("_mix.size")).alias("taken"))


OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) AS place
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS most FROM sources),
levels AS (
  SELECT *, most / w AS r,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
shared AS (SELECT min_by(level, r) AS level FROM levels WHERE level * w <= most),
goals AS (
  SELECT source, source_size, least(coalesce(s.level * l.w, most), most) AS target FROM levels l, shared s),
need AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goals),
run AS (
  SELECT d.doc_id, d.size, n.source_size, n.target, n.copies, n.target - n.copies * n.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS same
  FROM sized d JOIN need n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST((copies + CASE WHEN 2 * (rest - (upto - same)) >= same AND rest > 0 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM run
"""
