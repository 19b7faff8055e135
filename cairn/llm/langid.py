"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BITS, ORDERS, ALPHA = 14, 3, 0.5
#: Characters hashed at once; n-grams across the border are not lost.
CHUNK = 1 << 17
#: Texts of one matrix product, and most languages: the model is 128 kB a language and goes to every task.
ROWS, LANGUAGES = 64, 1000
_letter = regex.compile(r"\p{L}").search
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def buckets_of(text: str):
    """The buckets of the text's 1- to 3-grams of characters, case folded, a chunk at a time."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    for i in range(0, len(codes), CHUNK):
        part = codes[max(0, i - ORDERS + 1) : i + CHUNK].astype(np.uint64)
        old = min(i, ORDERS - 1)  # characters whose n-grams came with the chunk before
        gram = part * _MIX[0]
        for n in range(1, ORDERS + 1):
            if n > 1:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint64(29))) * _MIX[1] + part[n - 1 :] * _MIX[2]
            yield ((gram[max(0, old - n + 1) :] * _MIX[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def counts_of(text: str) -> np.ndarray:
    """How often each bucket occurs in the text."""
    out = np.zeros(1 << BITS, np.int64)
    for part in buckets_of(text):
        out += np.bincount(part, minlength=1 << BITS)
    return out


def sparse_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch as a sparse matrix by rows: where each text begins, and bucket and count of its entries."""
    cells, n, held, size = [], [], [], 0

    def close():
        nonlocal held, size
        if held:
            code, count = np.unique(np.concatenate(held), return_counts=True)
            cells.append(code), n.append(count)
        held, size = [], 0

    for k, text in enumerate(texts):
        if len(text) > CHUNK:  # its own counts, a chunk at a time
            close()
            c = counts_of(text)
            at = np.flatnonzero(c)
            cells.append(at | k << BITS), n.append(c[at])
            continue
        held += [part | k << BITS for part in buckets_of(text)]
        size += len(text)
        if size > CHUNK:
            close()
    close()
    code = np.concatenate([np.zeros(0, np.int64), *cells])
    return np.searchsorted(code >> BITS, np.arange(len(texts))), code & ((1 << BITS) - 1), np.concatenate([np.zeros(0, np.int64), *n])


def _fit(batches):
    """Sums of a partition: (lang, bucket, n), and the documents under bucket -1."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = counts_of(text)
            sums[lang] = sums[lang] + c if lang in sums else c
            docs[lang] = docs.get(lang, 0) + 1
    for lang, c in sums.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(c[at], docs[lang]))], ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log-probabilities (bucket x language) and log-priors, from every row of ``docs(lang, text)``.

    Only a sum a bucket and language reaches the driver: 2^14 numbers a language.
    """
    bounded_batches(docs.sparkSession)
    sums = docs.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_fit, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).limit((LANGUAGES + 1) << BITS).toPandas()
    langs = sorted(sums["lang"].unique())
    if len(langs) > LANGUAGES:
        raise ValueError(f"{len(langs)} values of lang; the model takes {LANGUAGES}")
    counts, docs_of = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs))
    at = sums["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    bucket, n = sums["bucket"].to_numpy(int), sums["n"].to_numpy(float)
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    docs_of[at[bucket < 0]] = n[bucket < 0]
    return langs, np.log((counts + ALPHA) / (counts.sum(axis=0) + ALPHA * len(counts))), np.log(docs_of / max(docs_of.sum(), 1))


def _predict(model):
    def run(batches):
        langs, logp, prior = model.value
        for b in batches:
            texts = b.column("text").to_pylist()
            told = [i for i, t in enumerate(texts) if t and langs and _letter(t)]
            found, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            starts, bucket, n = sparse_counts([texts[i] for i in told])
            for lo in range(0, len(told), ROWS):
                hi = min(lo + ROWS, len(told))
                first, end = starts[lo], starts[hi] if hi < len(told) else len(bucket)
                # the sparse matrix times the log-probabilities
                total = np.add.reduceat(n[first:end, None] * logp[bucket[first:end]], starts[lo:hi] - first) + prior
                best = total.argmax(axis=1)
                found[told[lo:hi]] = np.array(langs, object)[best]
                score[told[lo:hi]] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(found, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """``docs(doc_id, text, lang)`` -> doc_id, held_out, lang_pred, score for each row.

    Learns from all rows with text and lang whose crc32(doc_id as text) mod ``folds`` is not ``held``. Only the text
    enters a prediction; ``score`` is its posterior probability. ``und`` with score 0: null text, no letter, or
    nothing learned. Rows without doc_id are neither held out nor learned from. Ties go to the first language by name.
    Repeated rows are learned from each time and predicted alike; texts of any length are read whole, a chunk at a
    time; an empty table gives an empty one; other columns are ignored. Over LANGUAGES values of lang are an error.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    langs, logp, prior = fit(docs.where(fold != held))
    model = docs.sparkSession.sparkContext.broadcast((langs, logp, prior))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs)
