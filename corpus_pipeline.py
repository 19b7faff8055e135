"""From raw documents to token ids: quality rules, line dedup, SimHash near-dedup, source mixing, byte-level BPE.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; what one returns is written as Parquet and read as the next
one's documents. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, common, linededup, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and from the others the lines that over 20 documents of their host hold."""
    return quality.quality_texts(docs, share=None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id has; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8) stays, the one of the smallest doc_id.

    Candidates share an exact chain in rings of SimHash segments and pass the tests behind it, and each is compared
    exactly. Texts without a word are copies of each other, rows without doc_id stay, an empty table gives an empty one.
    """
    return simhash.one_of_each(docs, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the hashes of the ids and of what they decode to.

    Caches are small, as the workers stand beside executors that the stages before have grown.
    """
    return bpe.encode_documents(docs, with_ids=True, entries=60_000).drop("row")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is a table in the shared checkpoint folder."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express SimHash components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None
