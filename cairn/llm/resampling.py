"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, text_hash

BUCKETS_BITS, ALPHA, SEED = 14, 1.0, 42
#: Most labelled documents that the target model is fitted on: those of the smallest hashes of doc_id.
TARGET_DOCS = 20_000
STEP = 12
CHUNK = 1 << 16


def counts_of(text: bytes) -> np.ndarray:
    """Counts of the buckets of all words and pairs of words, A-Z folded."""
    words = text.lower().split()
    out = np.zeros(1 << BUCKETS_BITS, np.int64)
    shift = np.uint64(64 - BUCKETS_BITS)
    for i in range(0, len(words), CHUNK):
        part = words[max(0, i - 1) : i + CHUNK]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        grams = np.concatenate([h[1:] if i else h, pairs]) >> shift
        out += np.bincount(grams.astype(np.int64), minlength=1 << BUCKETS_BITS)
    return out


def _sums(batches):
    raw, target = np.zeros(1 << BUCKETS_BITS, np.int64), np.zeros(1 << BUCKETS_BITS, np.int64)
    for b in batches:
        for text, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True):
            c = counts_of(text or b"")
            raw += c
            if good:
                target += c
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of each bucket; raw is every document, target those whose doc_id is in ``good``.

    ``good`` has at most TARGET_DOCS ids, so it is broadcast. A sum a bucket reaches the driver.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(good.withColumn("good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    sums = rows.mapInArrow(_sums, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(1 << BUCKETS_BITS), np.zeros(1 << BUCKETS_BITS)
    raw[sums["bucket"]], target[sums["bucket"]] = sums["raw"], sums["target"]
    model = lambda c: np.log((c + ALPHA) / (c.sum() + ALPHA * len(c)))
    return model(target) - model(raw)


def _weights(model):
    def run(batches):
        ratio = model.value
        for b in batches:
            n, w = [], []
            for text in b.column("text").to_pylist():
                c = counts_of(text or b"")
                n.append(int(c.sum()))
                w.append(float(c @ ratio))
            w = np.array(w)
            u = (b.column("noise").to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
            key = w - np.log(-np.log(u))
            bits = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key, pa.float64()), pa.array(bits ^ (bits >> 63 & np.int64(2**63 - 1)))], ["doc_id", "row", "n_grams", "log_weight", "gumbel_key", "place"])

    return run


def kth_largest(rows: DataFrame, k: int) -> int | None:
    """The ``k``-th largest ``place`` by histograms of its leading bits: at most 2^STEP + 1 counts a round come back."""
    if k <= 0:
        return None
    shift, near = 64, rows.select("place")
    while True:
        shift = max(shift - STEP, 0)
        hist = sorted(((r.b, r.n, r.lo, r.hi) for r in near.groupBy(F.shiftright("place", shift).alias("b")).agg(F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi")).collect()), reverse=True)
        for b, n, lo, hi in hist:
            if k <= n:
                break
            k -= n
        else:
            return hist[-1][2] if hist else None
        if lo == hi or not shift:
            return lo
        near = near.where(F.shiftright("place", shift) == b)


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """``docs(doc_id, text)`` and ``labels(doc_id, quality, toxic)`` -> doc_id, n_grams, log_weight, gumbel_key, kept.

    The target is text labelled of quality 1 and not toxic. Each document's log importance weight is the sum of the
    log ratios of its n-grams; with Gumbel noise added, the largest ``share`` of the rows are a sample without
    replacement by weight, and ``kept``. By default ``share`` is the target's share among the labels. The noise is a
    hash of doc_id, so reruns agree, and rows that tie with the last one kept are kept too. Null or empty text has
    weight 0; null labels and ids are no target; without labels nothing can be told apart and all is noise.
    """
    bounded_batches(docs.sparkSession)
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    n_good, n_known = known.agg(F.count_if("good"), F.count("*")).first()
    share = share if share is not None else (n_good / n_known if n_known else 1.0)
    target = known.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).select("doc_id")
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, target))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("row"), F.xxhash64(F.lit("gumbel"), "doc_id").alias("noise"), F.col("text").cast("binary").alias("text"))
    weighed = cut(rows.mapInArrow(_weights(ratio), "doc_id long, row long, n_grams long, log_weight double, gumbel_key double, place long"))
    least = kth_largest(weighed, round(share * weighed.count()))
    return weighed.withColumn("kept", F.col("place") >= F.lit(least) if least is not None else F.lit(False)).drop("place")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return resample(docs, labels).drop("row")
