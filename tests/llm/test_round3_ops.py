"""Whitening, token files and hard negatives against exact arithmetic, the library and brute force."""

import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import negatives, tokenfiles, whitening

DATA = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# whitening


def exact_moments(vectors):
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return x, n, s, np.array([[float(c) for c in r] for r in v])


def check_whitened(rows, vectors, k):
    """``rows`` by vec_id against exact moments of ``vectors`` (a list in order of vec_id)."""
    x, n, s, v = exact_moments(vectors)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(rows) == n * k
    z = np.zeros((n, k))
    for r in rows:
        assert r.n == n and r.deviation == sum((n * a - t) ** 2 for a, t in zip(x[r.vec_id], s, strict=True))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(v), rel=1e-9)
        z[r.vec_id, r.component - 1] = r.whitened
    centred = np.array([[n * a - t for a, t in zip(row, s, strict=True)] for row in x], float) / n
    axes = np.linalg.lstsq(centred, z, rcond=None)[0] * np.sqrt(values[:k])
    assert np.abs(np.linalg.norm(axes, axis=0) - 1).max() < 1e-9
    assert np.abs(v @ axes - axes * values[:k]).max() < 1e-9 * values[0]
    error = np.abs(z.T @ z / n - np.eye(k)).max()
    assert error < 1e-4 and rows[0].identity_error < 1e-4 and len({r.identity_error for r in rows}) == 1


def test_whitening_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6) * 50).round(4).tolist()
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string").repartition(5)
    check_whitened(whitening.whiten(frame).collect(), vectors, 6)
    check_whitened(whitening.whiten(frame, components=2).collect(), vectors, 2)


def test_whitening_limbs_of_large_numbers():
    rng = np.random.default_rng(5)
    for size in (1 << 10, 1 << 31, 1 << 60):
        x = rng.integers(-size, size, (300, 3))
        parts = whitening.limbs(x)
        assert (sum(p.astype(np.int64).astype(object) * (1 << whitening.BITS * i) for i, p in enumerate(parts)) == x.astype(object)).all()
        y, squares = whitening.deviations(x, 300, x.astype(object).sum(axis=0))
        exact = [sum((300 * int(a) - int(t)) ** 2 for a, t in zip(r, x.astype(object).sum(axis=0), strict=True)) for r in x]
        assert squares == [q if q < 1 << 63 else None for q in exact]


def test_whitening_of_large_components(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(50, 3)) * 2.0**44).tolist()
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in rows} == {None} and rows[0].identity_error < 1e-9


def test_whitening_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5, 0.0]), (3, None), (4, [1.0, None]), (5, [NAN, 1.0]), (6, [INF, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [1e300, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component int")
    check_whitened(whitening.whiten(frame).collect(), [r[1] for r in rows[:3]], 2)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(frame.where("embedding is null")).count() == 0
    twice = whitening.whiten(frame.union(frame).withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(twice) == 12 and {r.n for r in twice} == {6} and {r.vec_id for r in twice} == {None}
    alone = whitening.whiten(frame.where("vec_id = 0")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in alone] == [(None, 0.0, None, 0)] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    found = {(r.component, r.whitened is None) for r in whitening.whiten(line).collect()}
    assert found == {(1, False), (2, True)}


def test_op11_over_the_table(spark):
    source = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in source] == list(range(len(source)))
    check_whitened(whitening.op11(spark, DATA).collect(), [r.embedding for r in source], 32)


# token files


def some_ids():
    rng = np.random.default_rng(7)
    mixed = np.concatenate([rng.integers(0, 1 << b, 700) for b in range(1, 63)] + [np.zeros(5000, np.int64)])
    large = np.array([(1 << 60) - 1, 1 << 60, (1 << 64) - 1, 0, 1], np.uint64)
    return [np.zeros(0), np.zeros(1), np.zeros(4096), np.zeros(9000), np.arange(4097), rng.integers(0, 49408, 20000), mixed, rng.permutation(mixed), np.tile(large, 3000), np.ones(239), np.array([5] * 240 + [1 << 40])]


def test_simple8b_round_trip():
    rng = random.Random(8)
    for ids in some_ids():
        ids = ids.astype(np.uint64)
        words, blocks, escaped = tokenfiles.pack(ids)
        assert words.dtype == np.uint64 and len(blocks) == -(-len(ids) // tokenfiles.BLOCK)
        assert (tokenfiles.unpack(words, blocks, escaped, len(ids)) == ids).all()
        assert len(escaped) == (ids >= 1 << 60).sum()
        for _ in range(20 if len(ids) else 0):
            i, j = sorted((rng.randint(0, len(ids)), rng.randint(0, len(ids))))
            assert (tokenfiles.unpack_range(words, blocks, escaped, len(ids), i, j) == ids[i:j]).all()


def test_simple8b_words_are_as_few_as_greedy():
    ids = np.random.default_rng(9).integers(0, 3000, 4000)
    n, i = 0, 0
    while i < len(ids):
        i += max(c for c, w in tokenfiles.PACKS if w != 64 and all(int(x) < 1 << w for x in ids[i : i + c]))
        n += 1
    assert len(tokenfiles.pack(ids)[0]) == n


def odd_texts():
    rnd = random.Random(10)
    letters = "aB '\n\t  \r\x0bé1sz\U0001f600。Σσς́  \x85​<|>İǅ가가n't've"
    texts = [None, "", " ", "\n", "a <|endoftext|> b<|startoftext|>c", "<|endoftext|>" * 3, "ΑΣ Σ ΑΣΑ", "x" * 5000, "é ́e", "I'd it's 'S don't"]
    return texts + ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(400)]


def test_cut_texts_encode_as_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), tokenfiles.Encoder(path)
    assert encoder.cuts
    texts = [t or "" for t in odd_texts()]
    assert [e.tolist() for e in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    every = [chr(c) + chr(d) + "a" + chr(c) for c in range(33, 0x250) for d in (65, 39, 0xC9, 0x301, 0x130)]
    assert [e.tolist() for e in encoder.encode(every)] == [library.encode(t, add_special_tokens=False).ids for t in every]
    other = tokenfiles.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.cuts
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [e.tolist() for e in other.encode(texts[:50])] == [plain.encode(t, add_special_tokens=False).ids for t in texts[:50]]


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no name"), (None, "no other"), (3, "three again"), (7, "word " * 300_000)] + [(11, "same")] * 50
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int").repartition(6)
    tokenfiles.write_tokens(frame, str(tmp_path / "t"), path, end_id=1)
    whole = tokenfiles.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    digests = tokenfiles.read_tokens(spark, str(tmp_path / "t"), digest=True).orderBy("start").collect()
    assert len(whole) == len(rows)
    names = [r.doc_id for r in whole]
    assert names == sorted(n for n in names if n is not None) + [None] * 2
    expected = sorted(((i is None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows), key=lambda r: r[:2])
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in whole) == sorted(expected)
    before = 0
    for r, d in zip(whole, digests, strict=True):
        assert (r.start, r.n_tokens) == (before, len(r.ids)) == (d.start, d.n_tokens) and r.doc_id == d.doc_id
        assert d.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        before += r.n_tokens


def test_token_files_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tokenfiles.write_tokens(empty, str(tmp_path / "t"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "t"), digest=True).collect() == []


def test_op12_over_the_table(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = 0
    got = {r.doc_id: r for r in tokenfiles.op12(spark, DATA).collect()}
    source = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(source)
    for r in source:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        assert tuple(got[r.doc_id][1:]) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


# hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=3, scale=256):
    """``rows`` (vec_id, vector, label), unique and sound."""
    q = {i: np.floor(np.array(v, float) * scale).astype(object) for i, v, _ in rows}
    label = {i: lab for i, _, lab in rows}
    out = []
    for a in anchors:
        score = {i: int((q[a] * q[i]).sum()) for i in q if i != a and len(q[i]) == len(q[a])}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:positives]:
            fit = [i for i in order if label[i] != label[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit[:negatives])]
    return sorted(out)


def negatives_of(frame, condition="vec_id % 10 = 0", **more):
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, F.expr(condition), **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("spread", [0.05, 0.3, 3.0, 40000.0])
def test_hard_negatives_are_brute_force(spark, monkeypatch, spread):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] * spread + rng.normal(size=12) * spread * rng.choice([0.1, 1.0])).round(3).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, rows[i][1], int(rng.integers(0, 4))) for i in range(0, 90, 3)]  # exact copies, so ties
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rank string").repartition(5)
    expected = brute_negatives(rows, [r[0] for r in rows if r[0] % 10 == 0])
    assert len(expected) > 50
    assert negatives_of(frame) == expected
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 1200)  # several blocks of anchors
    monkeypatch.setattr(negatives, "TOGETHER", 3)
    assert negatives_of(frame) == expected


def test_hard_negatives_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.8, 0.0], 2), (3, [0.8, 0.0], 2), (4, [0.7, 0.0], None), (5, None, 1), (6, [NAN, 1.0], 2), (7, [None, 0.9], 2), (8, [INF, 0.9], 2), (9, [], 2), (11, [1e200, 1.0], 2), (12, [0.8, 0.0, 0.0], 2), (13, [-1.0, 0.0], 1), (14, [0.0, 0.0], 3)]
    frame = spark.createDataFrame(rows + [(None, [1.0, 0.0], 1), (3, [0.8, 0.0], 2)], "vec_id long, embedding array<double>, label int")
    sound = [r for r in rows if r[0] in (0, 1, 2, 3, 12, 13, 14)]
    assert negatives_of(frame) == brute_negatives(sound, [0])
    assert [r[:4] for r in negatives_of(frame)] == [(0, 1, 1, 2), (0, 1, 2, 3)]
    assert negatives_of(frame.limit(0)) == [] and negatives_of(frame, "vec_id = 77") == []
    assert negatives_of(frame, "vec_id = 12") == []


def test_planes_leave_no_pair_that_counts():
    rng = np.random.default_rng(12)
    for size in (3, 200, 1 << 26):
        q, x = rng.integers(-size, size, (20, 9)), rng.integers(-size, size, (300, 9))
        exact = q.astype(object) @ x.T.astype(object)
        bar = int(np.quantile(exact.astype(float), 0.98))
        a, r, s = negatives.planes_down(q, x, np.ones(exact.shape, bool), lambda a, lower, upper, alive, bar=bar: upper >= bar)
        assert sorted(zip(a.tolist(), r.tolist(), s.tolist(), strict=True)) == [(i, j, exact[i, j]) for i in range(20) for j in range(300) if exact[i, j] >= bar]


def test_op13_over_the_table_is_its_sql(spark):
    import duckdb

    source = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in source]
    got = sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in negatives.op13(spark, DATA).collect())
    assert got == brute_negatives(rows, [r.vec_id for r in source if r.vec_id % 50 == 0]) and got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    told = con.execute(negatives.OP13_SQL)
    assert [d[0] for d in told.description] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and sorted(told.fetchall()) == got
