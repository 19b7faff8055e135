"""Hard negatives by integer inner products over bit planes, the most significant plane first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_package, stored, table

#: Bytes of anchors that one pass over the rows takes along; more anchors make more passes.
ANCHOR_BYTES = 8 << 20
#: Anchors that meet a batch of rows at once, and the share of live pairs under which pairs are followed one by one.
TOGETHER, SPARSE = 512, 0.06
NONE = -(1 << 62)


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """One row a vec_id that can take part: vec_id, label, q = floor(scale * component), the smallest (label, q) of repeats.

    Out are null ids, labels and vectors, empty vectors, null or non-finite components, and components so large that an
    inner product of such vectors would leave a long.
    """
    x = F.col("embedding").cast("array<double>")
    bound = F.sqrt(F.lit(float(1 << 62)) / F.size("x")) - 2
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < bound))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null and size(x) > 0").where(sound)
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale)).alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("v")).select("vec_id", "v.label", "v.q")


def by_length(batch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of an Arrow batch (vec_id, label, q) as arrays, apart for each length of vector."""
    q = batch.column("q")
    size = np.diff(q.offsets.to_numpy())
    flat = q.values.to_numpy()
    start = q.offsets.to_numpy()[:-1]
    ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        out.append((ids[at], labels[at], flat[start[at][:, None] + np.arange(d)]))
    return out


def planes_down(q: np.ndarray, x: np.ndarray, alive: np.ndarray, may) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and exact score of the pairs that stay, by the bits of ``x`` from the sign downwards.

    After the planes above bit k a score lies within [s + low * (2**k - 1), s + high * (2**k - 1)], where low and high
    sum the anchor's negative and positive components. ``may(anchors, lower, upper, alive)`` tells which pairs may still
    qualify; it is asked after every plane. While many pairs live, a plane is one matrix product; then it is summed
    for the living pairs alone. All numbers are whole and stay below 2**53, or else are kept as integers.
    """
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)) - 1, 0).bit_length()
    whole = float(np.abs(q).max(initial=0)) * 2.0 ** (top + 1) * q.shape[1] < 2.0**53
    kind = np.float64 if whole else np.int64
    q = q.astype(kind)
    low, high = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    everyone = np.arange(len(q))[:, None]
    score, k = -(q @ (x < 0).T.astype(kind)) * kind(1 << top), top
    while True:
        rest = kind((1 << k) - 1)
        alive &= may(everyone, score + low[:, None] * rest, score + high[:, None] * rest, alive)
        if not k or np.count_nonzero(alive) < SPARSE * alive.size:
            break
        k -= 1
        score += (q @ (x >> k & 1).T.astype(kind)) * kind(1 << k)
    a, r = np.nonzero(alive)
    s = score[a, r]
    while k and len(a):
        k -= 1
        bits, rest = (x >> k & 1).astype(kind), kind((1 << k) - 1)
        for i in range(0, len(a), 1 << 16):
            part = slice(i, i + (1 << 16))
            s[part] += np.einsum("ij,ij->i", q[a[part]], bits[r[part]]) * kind(1 << k)
        stay = may(a, s + low[a] * rest, s + high[a] * rest, None)
        a, r, s = a[stay], r[stay], s[stay]
    return a, r, s.astype(np.int64)


class Best:
    """The ``k`` best (score, then smaller id) of each key, exact for all rows met so far."""

    def __init__(self, keys: int, k: int):
        self.score, self.ids = np.full((keys, k), NONE), np.zeros((keys, k), np.int64)

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        k = self.score.shape[1]
        touched = np.unique(key)
        old_key, old = np.repeat(touched, k), self.score[touched].ravel()
        key = np.concatenate([old_key, key])
        ids, score = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([old, score])
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        stay = place < k
        self.score[key[stay], place[stay]], self.ids[key[stay], place[stay]] = score[stay], ids[stay]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, place = np.nonzero(self.score > NONE)
        return key, self.ids[key, place], self.score[key, place]


def same_label(anchors: dict, k: int):
    """mapInArrow: of each anchor the ``k`` best other rows of its label, of those in one partition."""

    def run(batches):
        block = anchors.value
        best = {d: Best(len(ids), k) for d, (ids, _, _) in block.items()}
        for ids, labels, x in (g for b in batches for g in by_length(b)):
            if x.shape[1] not in block:
                continue
            a_ids, a_labels, q = block[x.shape[1]]
            top = best[x.shape[1]]
            for label in np.intersect1d(labels, a_labels):
                rows = np.flatnonzero(labels == label)
                asked = np.flatnonzero(a_labels == label)
                for i in range(0, len(asked), TOGETHER):
                    at = asked[i : i + TOGETHER]
                    least = top.score[at, -1].astype(float)

                    def may(a, lower, upper, alive, least=least):
                        if alive is not None and alive.shape[1] >= k:  # what surely is among the k best lifts the bar
                            sure = np.where(alive, lower, NONE)
                            np.maximum(least, np.partition(sure, alive.shape[1] - k, axis=1)[:, -k], out=least)
                        return upper >= least[a]

                    a, r, s = planes_down(q[at], x[rows], a_ids[at][:, None] != ids[rows], may)
                    top.add(at[a], ids[rows[r]], s)
        for d, top in best.items():
            key, other, score = top.found()
            yield frame(anchor_id=block[d][0][key], other=other, score=score)

    return run


def other_labels(anchors: dict, bounds: dict, k: int):
    """mapInArrow: of each anchor and positive the ``k`` best rows of other labels within its bounds, in one partition.

    ``bounds`` has, for each length, arrays anchors x positives of the least and the largest score that count.
    """

    def run(batches):
        block, limits = anchors.value, bounds.value
        best = {d: Best(least.size, k) for d, (least, _) in limits.items()}
        for ids, labels, x in (g for b in batches for g in by_length(b)):
            if x.shape[1] not in block:
                continue
            _, a_labels, q = block[x.shape[1]]
            least, largest = limits[x.shape[1]]
            top, width = best[x.shape[1]], least.shape[1]
            for i in range(0, len(q), TOGETHER):
                at = np.arange(i, min(i + TOGETHER, len(q)))
                bar = np.maximum(least[at], top.score.reshape(*least.shape, k)[at, :, -1])
                roof = largest[at]

                def may(a, lower, upper, alive, bar=bar, roof=roof):
                    some = np.zeros(upper.shape, bool)
                    for p in range(bar.shape[1]):
                        some |= (upper >= bar[a, p]) & (lower <= roof[a, p])
                    return some

                a, r, s = planes_down(q[at], x, a_labels[at][:, None] != labels, may)
                for p in range(width):
                    fits = (s >= bar[a, p]) & (s <= roof[a, p])
                    top.add(at[a[fits]] * width + p, ids[r[fits]], s[fits])
        for d, top in best.items():
            key, other, score = top.found()
            width = limits[d][0].shape[1]
            yield frame(anchor_id=block[d][0][key // width], place=key % width, other=other, score=score)

    return run


def frame(**columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({k: pa.array(v.astype(np.int64)) for k, v in columns.items()})


def first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows a key, numbered from 1; a key has at most ``k`` rows a partition."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def anchor_blocks(anchors: DataFrame) -> tuple[DataFrame, int]:
    """``anchors`` with a column ``block``; each block's vectors take at most ANCHOR_BYTES."""
    anchors = stored(anchors)
    blocks = 1
    while True:
        numbered = anchors.withColumn("block", F.pmod(F.xxhash64(F.lit("anchor"), "vec_id"), F.lit(blocks)))
        largest = numbered.groupBy("block").agg(F.sum(F.size("q") * 8 + 16).alias("b")).agg(F.max("b")).first()[0] or 0
        if largest <= ANCHOR_BYTES:
            return numbered, blocks
        if blocks > 1 and anchors.count() < 2 * blocks:
            raise ValueError(f"an anchor of over {ANCHOR_BYTES} bytes")
        blocks = max(2 * blocks, -(-largest * blocks // ANCHOR_BYTES))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the whole-number inner product with the anchor, higher first, then
    the smaller vec_id. Rows where ``anchor`` holds are anchors; an anchor's positives are its first other rows of its
    label, and of each positive the first rows of other labels with ``low`` % to ``high`` % of its score are returned.

    Rows that ``quantised`` names take no part; rows that repeat a vec_id are one; vectors of other lengths have no score
    with an anchor. An anchor without a positive, and a positive without a negative in its range, gives no row; neither
    does an empty table. Other columns are ignored.

    Anchors go round in blocks of bounded bytes: each block is sent to every partition of the rows twice, for positives
    and then, their scores known, for negatives. What comes back is the best rows a partition, whose number does not grow
    with the rows; every score is exact, and a pair is left only when its interval shows that it cannot be returned.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = stored(quantised(vectors, scale))
    numbered, blocks = anchor_blocks(rows.where(anchor))
    out = []
    for n in range(blocks):
        part = numbered.where(F.col("block") == n).toPandas().sort_values("vec_id")
        if not len(part):
            continue
        block = {}
        for d, g in part.groupby(part["q"].map(len)):
            block[int(d)] = (g["vec_id"].to_numpy(np.int64), g["label"].to_numpy(np.int64), np.stack(g["q"].tolist()).astype(np.int64))
        shared = spark.sparkContext.broadcast(block)
        near = rows.mapInArrow(same_label(shared, positives), "anchor_id long, other long, score long")
        best = first(near, ["anchor_id"], positives).toPandas()  # at most `positives` rows an anchor of the block
        limits = {}
        for d, (ids, _, _) in block.items():
            mine = best[best["anchor_id"].isin(ids)]
            least, largest = np.full((len(ids), positives), -NONE), np.full((len(ids), positives), NONE)
            at = np.searchsorted(ids, mine["anchor_id"]), mine["rank"].to_numpy(int) - 1
            score = mine["score"].to_numpy(np.int64).astype(object)
            least[at], largest[at] = (-(-low * score // 100)).astype(np.int64), (high * score // 100).astype(np.int64)
            limits[d] = (least, largest)
        bounds = spark.sparkContext.broadcast(limits)
        far = rows.mapInArrow(other_labels(shared, bounds, negatives), "anchor_id long, place long, other long, score long")
        asked = spark.createDataFrame(pd.DataFrame({"anchor_id": best["anchor_id"].astype("int64"), "place": best["rank"].astype("int64") - 1, "positive_id": best["other"].astype("int64"), "positive_score": best["score"].astype("int64")}), "anchor_id long, place long, positive_id long, positive_score long")
        chosen = first(far, ["anchor_id", "place"], negatives).join(asked, ["anchor_id", "place"])
        out.append(stored(chosen.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
        shared.unpersist()
        bounds.unpersist()
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op13(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 3
"""
