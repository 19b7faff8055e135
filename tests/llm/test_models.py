"""Token counts, vectors, language ID and resampling against libraries, brute force and held-out rows."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from cairn.llm import langid, resampling, tokencount, vectors

DATA = "/root/testdata/sf0.01"


def test_token_counts_are_the_library(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    texts = [None, "", " ", "  a", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "x" * 3000, "aaaa aaa aa", "ab" * 700, "\U0001f600\U0001f600 \U0001f600"]
    texts += ["".join(rnd.choices(" aabé1'\n\tsz\U0001f600。", k=rnd.randint(0, 30))) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tokencount.count_tokens(rows).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


def brute_links(rows, threshold):
    """Links a vec_id, and its smallest reachable vec_id."""
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    near = {i: {j for j in good if j != i and good[i][0] == good[j][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] / np.linalg.norm(good[i][1]) / np.linalg.norm(good[j][1]) >= threshold} for i in good}
    seen = {}
    for i in sorted(good):
        todo = [i] if i not in seen else []
        while todo:
            j = todo.pop()
            if j not in seen:
                seen[j] = i
                todo += near[j]
    return {i: len(n) for i, n in near.items()}, seen


def test_vectors_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.01], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [float("inf"), 1.0], 1), (12, [], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = vectors.near_duplicates(frame).collect()
    links, low = brute_links(rows, 0.98)
    assert len(got) == len({r[0] for r in rows})
    for r in got:
        if r.vec_id is not None:
            assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), low.get(r.vec_id, r.vec_id), low.get(r.vec_id, r.vec_id) == r.vec_id)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_recall_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 32))
    copies = base[rng.integers(0, 60, 300)] + rng.normal(size=(300, 32)) * rng.uniform(0.02, 0.2, (300, 1))
    dense = base[0] + rng.normal(size=(400, 32)) * 0.01
    rows = [(int(i), v.tolist(), int(i % 2)) for i, v in enumerate(np.concatenate([base, copies, dense]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, low = brute_links(rows, 0.98)
    for shard, task in ((1024, 4096), (64, 128)):  # one shard a label; many shards, and tiles for the dense ball
        monkeypatch.setattr(vectors, "SHARD", shard)
        monkeypatch.setattr(vectors, "TASK", task)
        got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
        assert {i: got[i].n_links for i in links} == links and {i: got[i].component_id for i in low} == low
        found, there = vectors.audit_recall(frame, spark.createDataFrame(list(got.values())), every=50)
        assert found == there > 0


def test_vectors_around_the_threshold_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    x = np.repeat(base, 20, axis=0) + rng.normal(size=(2400, 64)) * 0.14 / 8
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, low = brute_links(rows, 0.98)
    assert 10_000 < sum(links.values()) < 19 * 2400
    for shard, task in ((4096, 4096), (128, 256)):
        monkeypatch.setattr(vectors, "SHARD", shard)
        monkeypatch.setattr(vectors, "TASK", task)
        got = {r.vec_id: r for r in vectors.near_duplicates(frame).collect()}
        assert {i: r.n_links for i, r in got.items() if r.n_links} == {i: n for i, n in links.items() if n}
        assert all(got[i].component_id == low.get(i, i) for i in got)


def test_parts_share_both_ends_of_a_link():
    rng = np.random.default_rng(3)
    x = vectors.unit(list(rng.normal(size=(1500, 8))))
    c, margin = x[:40], 0.1
    inside = vectors.homes_of(x, c, margin)
    a, b = np.nonzero(x @ x.T >= 0.98)
    assert len(a) > 1500 and (inside[a] & inside[b]).any(axis=1).all() and inside.any(axis=1).all()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", None), (-3, "123 !?", "en"), (None, "the thing", "en"), (-4, "é" * 300_000, None)], docs.schema)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(odd)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    truth = {r.doc_id: (r.lang, len(r.text)) for r in docs.collect()}
    held = [(r.lang_pred == truth[i][0]) for i, r in got.items() if i is not None and i >= 0 and r.held_out and truth[i][1] > 40]
    assert len(held) > 200 and np.mean(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.identify(odd.where("false"))
    assert nothing.count() == 0 and langid.identify(odd.select("doc_id", "text", odd["lang"].substr(1, 0).alias("lang")).where("lang is null")).where("lang_pred <> 'und'").count() == 0


def test_language_chunks_lose_no_ngram(monkeypatch):
    text = "Straße çà et là " * 50
    whole = langid.counts_of(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert (langid.counts_of(text) == whole).all() and whole.sum() == 3 * len(text) - 3


def plain_buckets(text):
    """Buckets of 1- to 3-grams by whole numbers, a gram at a time."""
    full, out, mix = (1 << 64) - 1, Counter(), [int(x) for x in langid._MIX]
    codes = [ord(c) for c in text.lower()]
    for i, c in enumerate(codes):
        gram = c * mix[0] & full
        for n in range(3):
            if n:
                if i + n >= len(codes):
                    break
                gram = ((gram ^ gram >> 29) * mix[1] + codes[i + n] * mix[2]) & full
            out[(gram * mix[0] & full) >> 50] += 1
    return out


def test_language_is_plain_naive_bayes(spark, monkeypatch):
    rnd = random.Random(6)
    make = lambda letters: "".join(rnd.choices(letters, k=rnd.randint(1, 60)))
    rows = [(i, make("abc é" if i % 2 else "xbç "), ("fr" if i % 2 else "pt") if i % 5 else None) for i in range(80)] + [(3, "abc", "fr"), (3, "abc", "fr"), (900, "a" * 400, None)]
    learned = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    langs = sorted({lang for _, lang in learned})
    sums = {x: sum((plain_buckets(t) for t, lang in learned if lang == x), Counter()) for x in langs}
    want = Counter()
    for i, t, _ in rows:
        c = plain_buckets(t)
        total = [np.log(sum(x == y for _, y in learned) / len(learned)) + sum(n * np.log((sums[x][g] + 0.5) / (sums[x].total() + 0.5 * (1 << 14))) for g, n in c.items()) for x in langs]
        best = int(np.argmax(total))
        letters = any(ch.isalpha() for ch in t)
        want[i, langs[best] if letters else "und", round(1 / sum(np.exp(v - total[best]) for v in total), 6) if letters else 0.0] += 1
    monkeypatch.setattr(langid, "CHUNK", 100)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got) == want
    parts = langid.sparse_counts([t for _, t, _ in rows])
    ends = [*parts[0][1:], len(parts[1])]
    assert all(dict(zip(parts[1][a:b], parts[2][a:b], strict=True)) == plain_buckets(t) for (_, t, _), a, b in zip(rows, parts[0], ends, strict=True))


def test_resampling_weights_are_plain_counts(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["Alpha", "beta", "gamma", "delta\n", "é"], k=rnd.randint(0, 12)))) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")

    def grams(text):
        h = [xxhash.xxh64_intdigest(w, seed=42) for w in text.encode().lower().split()]
        pair = lambda a, b: ((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
        return Counter(x >> 50 for x in [*h, *map(pair, h, h[1:])])

    raw = sum((grams(t) for _, t in rows), Counter())
    target = sum((grams(t) for i, t in rows if i < 30 and i % 3 == 0 and i % 9), Counter())
    part = lambda c, g: np.log((c[g] + 1) / (c.total() + (1 << 14)))
    got = {r.doc_id: r for r in resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    for i, t in rows:
        c = grams(t)
        assert got[i].n_grams == c.total() and abs(got[i].log_weight - sum(n * (part(target, g) - part(raw, g)) for g, n in c.items())) < 1e-9
    kept = sorted(r.gumbel_key for r in got.values() if r.kept)
    assert len(kept) == round(len(rows) * 6 / 30) and kept == sorted(r.gumbel_key for r in got.values())[-len(kept) :]


def test_resampling(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in resampling.resample(docs, labels).collect()}
    assert len(got) == docs.count()
    known = {r.doc_id: r for r in labels.collect()}
    share = np.mean([r.quality == 1 and r.toxic == 0 for r in known.values()])
    order = sorted(got.values(), key=lambda r: -r.gumbel_key)
    kept = [r.doc_id for r in order if r.kept]
    assert kept == [r.doc_id for r in order[: len(kept)]] and len(kept) == round(share * len(got))
    good = [got[i].kept for i, r in known.items() if r.quality == 1 and r.toxic == 0]
    junk = [got[i].kept for i, r in known.items() if r.quality == 0]
    assert np.mean(good) > np.mean(junk) + 0.3
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "")], docs.schema)
    assert resampling.resample(odd, labels.limit(0)).count() == 4 and resampling.resample(odd.limit(0), labels).count() == 0
    text = b"one two three " * 40
    whole = resampling.counts_of(text)
    monkeypatch.setattr(resampling, "CHUNK", 5)
    assert (resampling.counts_of(text) == whole).all() and whole.sum() == 239


def test_kth_largest(spark):
    rnd = random.Random(1)
    values = [rnd.getrandbits(63) - (1 << 62) for _ in range(300)] + [5] * 7
    rows = spark.createDataFrame([(v,) for v in values], "place long")
    for k in (1, 2, 150, 307):
        assert resampling.kth_largest(rows, k) == sorted(values, reverse=True)[k - 1]
    assert resampling.kth_largest(rows, 0) is None
