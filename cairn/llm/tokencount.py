"""Token counts by rank-synchronous merging over ragged arrays."""

from __future__ import annotations

import gc
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_hash, text_of
from .pretokens import PieceCache, stretches

NEVER = np.int64(1) << 40


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself if it prints, else the next code point from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


class Merger:
    """The merges of a tokenizer file as sorted arrays: pair of ids -> rank and id of the merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.first = np.array([vocabulary[c] for c in byte_letters()], np.int64)
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that survive in each piece.

        All pieces lie in one array. Each round finds every sequence's lowest-ranked pair, merges all its places (of
        overlapping ones the first, third, ...), and takes sequences without a pair out with their length.
        """
        out = np.fromiter(map(len, pieces), np.int64, len(pieces))
        live = np.flatnonzero(out > 1)
        if not len(live):
            return out
        symbols = self.first[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)]
        length = out[live]
        own = np.repeat(np.arange(len(live)), length)
        rank = np.full(len(symbols), NEVER)
        inside = own[:-1] == own[1:]
        rank[:-1][inside] = self.rank(symbols[:-1][inside], symbols[1:][inside])
        while len(live):
            start = np.concatenate([[0], np.cumsum(length)[:-1]])
            best = np.minimum.reduceat(rank, start)
            done = best == NEVER
            if done.any():
                out[live[done]] = length[done]
                stay = ~done
                keep = stay[own]
                symbols, rank = symbols[keep], rank[keep]
                live, length, best = live[stay], length[stay], best[stay]
                own = np.repeat(np.arange(len(live)), length)
                if not len(live):
                    break
            hit = np.flatnonzero(rank == best[own])
            # in a run of overlapping places every second one merges
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            length = length - np.bincount(own[hit], minlength=len(live))
            place = np.cumsum(keep) - 1
            symbols, own, rank = symbols[keep], own[keep], rank[keep]
            # ranks change only at what was merged and just before it
            at = place[hit]
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[at] = NEVER
            at = at[at + 1 < len(symbols)]
            at = at[own[at] == own[at + 1]]
            rank[at] = self.rank(symbols[at], symbols[at + 1])
        return out


class Counter:
    def __init__(self, path: str):
        self.merger = Merger(path)
        self.cache = PieceCache(lambda pieces: self.merger.counts([p.encode() for p in pieces]).tolist(), sum)

    def sections(self, text: str) -> list[str]:
        """The text between special strings, which are one token each."""
        parts = [text]
        for s in self.merger.special:
            parts = [x for p in parts for x in p.split(s)] if s in text else parts
        return parts

    def count(self, texts: list[str | None]) -> list[int]:
        sections = [self.sections(t or "") for t in texts]
        found = iter(self.cache.values([stretches(s) for parts in sections for s in parts]))
        return [len(parts) - 1 + sum(sum(next(found)) for _ in parts) for parts in sections]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count(path: str):
    def run(batches):
        gc.disable()  # the caches hold millions of plain objects and no cycles
        try:
            c = counter(path)
            for b in batches:
                texts = b.column("text").to_pylist()
                n = [x for i in range(0, len(texts), 512) for x in c.count(texts[i : i + 512])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "row", "n_bytes", "n_tokens"])
        finally:
            gc.enable()

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, row, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a byte-level tokenizer file of the ``tokenizers`` library (default: the 50k one); counts are those of
    that library without added special tokens, and special strings inside a text count one. Null text is empty: 0.
    A row out for each row in; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("row"), F.octet_length(text_of()).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(_count(path), "doc_id long, row long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).drop("row")
