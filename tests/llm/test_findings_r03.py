"""What the review of round 3 found missing."""

import base64
import math

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import bpe, common, simhash, tokenfiles, vectors


def test_sets_at_the_threshold_share_a_ring_chain():
    rng, masks = np.random.default_rng(5), {n: [simhash.mask((i + k) % simhash.PARTS for k in range(n)) for i in range(simhash.PARTS)] for n in (4, 8, 16, 32)}

    def candidates(x, y):
        for budget, keys, bits in simhash.rings(x, 0.8):
            for other, theirs, word in simhash.rings(y, 0.8):
                for i in np.flatnonzero((keys == theirs) & (keys != 0)) if budget == other else ():
                    yield all(((bits ^ word) & masks[n][i]).bit_count() * simhash.PARTS <= n * budget for n in masks)

    for n in (5, 6, 8, 9, 16, 17, 40, 51, 52, 64, 65, 128, 256, 300, 1000):
        for _ in range(40):
            both = math.ceil(1.6 * n / 1.8 - 1e-9)
            h = rng.integers(0, 1 << 64, 2 * n - both, np.uint64)
            x = np.sort(h[:n])
            assert any(candidates(x, np.sort(np.concatenate([h[:both], h[n:]])))) and any(candidates(x, np.sort(h[: math.ceil(0.8 * n - 1e-9)])))
    unlike = [np.sort(rng.integers(0, 1 << 64, 60, np.uint64)) for _ in range(100)]
    assert not any(any(candidates(x, y)) for i, x in enumerate(unlike) for y in unlike[:i])


def test_ids_are_looked_up_by_place_even_with_gaps(tmp_path):
    entries = [bytes([b]) for b in range(256)] + [b"ab", b"abc", "é".encode()]
    ids = [*range(256), 300, 301, 400]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for t, i in zip(entries, ids, strict=True)))
    codec = bpe.Codec(str(tmp_path / "ranks"))
    assert len(codec.texts) == len(codec.digits) == 401 and [codec.texts[i] for i in ids] == entries and codec.digits[400] == "400"
    found = next(iter(codec.encode_batch(["abc abé"])))
    assert found == [301, 32, 300, 400] and b"".join(bpe.decode_stream(found, codec.decoder)) == "abc abé".encode()


def test_states_hold_nothing_that_was_emitted():
    syllables = [b"the", b"an", b"er", b"en", b"ch", b"sch", b"in", b"on", b"qu", b"la", b"ment", "é".encode(), b"tion", b"ing", b"st", b"of"]
    rng, machine = np.random.default_rng(3), bpe.Transducer(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    words = [b"".join(syllables[i] for i in rng.integers(0, 16, n)) for n in rng.integers(2, 7, 3000)]
    made, step = [], machine.step
    machine.step = lambda state, byte: made.append(byte) or step(state, byte)
    found = [machine.encode(w) for w in words]
    assert [b"".join(map(machine.texts.__getitem__, ids)) for ids in found] == words
    assert len(made) < 0.27 * sum(map(len, words))


def test_bounds_of_states_and_caches_change_no_ids(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["the thing, the\nchanting;  enchanted " * 3, "Éléments d'une théorie", "", "x" * 500, "the thing again"] * 4
    wide = list(bpe.Codec(path).encode_batch(texts))
    monkeypatch.setattr(bpe, "STATES", 3)
    narrow = bpe.Codec(path, entries=2)
    assert list(narrow.encode_batch(texts)) == wide and len(narrow.known) < 20 and len(narrow.machine.states) < 1000


def test_a_worker_keeps_what_one_stage_left_until_another_asks():
    assert common.held("codec", lambda: [1]) == [1] and common.held("codec", lambda: [2]) == [1]
    assert common.held() is None and common.held("codec", lambda: [2]) == [2]
    common.held()


def test_sets_with_little_in_common_are_not_paired(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 100, np.uint64)
    sets = {i: np.concatenate([base[: 100 - k], rng.integers(0, 1 << 63, k, np.uint64)]) for i, k in enumerate([0, 5, 10, 19, 20, 21, 30, 60])}
    own = rng.integers(0, 1 << 63, 60, np.uint64)
    sets |= {8: np.concatenate([own, base[:40]]), 9: np.concatenate([own, rng.integers(0, 1 << 63, 40, np.uint64)])}  # 8 stays until 9 has gone
    rows = spark.createDataFrame([(i, len(h), h.tobytes()) for i, h in sets.items()], "node long, n long, hashes binary")
    found = dict(map(tuple, simhash.in_common(rows, 0.8).collect()))
    assert found == {0: 95, 1: 95, 2: 90, 3: 81, 4: 80}


def test_a_crowd_of_texts_that_share_a_passage_keeps_one_of_each(spark):
    rng = np.random.default_rng(12)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*passage, *(f"w{x}" for x in rng.integers(0, 10**6, 20))]) for _ in range(150)]
    texts += [texts[i] + f" end{i}" for i in range(0, 150, 3)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).select("doc_id").collect()}
    assert kept == set(range(150))


def test_shingles_in_common_are_counted_for_all_sets_that_share_a_key(spark, monkeypatch):
    rng, counted, in_common = np.random.default_rng(13), [], simhash.in_common

    def seen(sets, similarity):
        counted.append(sum(len(r.hashes) // 8 for r in sets.select("hashes").collect()))
        return in_common(sets, similarity)

    monkeypatch.setattr(simhash, "in_common", seen)
    passage = [f"p{i}" for i in range(30)]
    text = lambda start, n: " ".join([*start, *(f"w{x}" for x in rng.integers(0, 10**6, n))])
    crowd = [text(passage, 20) for _ in range(160)]
    spaced = [text([f"p{i}_{k // 2}" for i in range(30)], 20) for k in range(160)]  # each passage in two texts
    for texts in (crowd, spaced):
        docs = spark.createDataFrame([*enumerate(texts), (1000, texts[7] + " end")], "doc_id long, text string")
        kept = {r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).select("doc_id").collect()}
        assert kept == set(range(160))
    assert 0 < counted[0] < 5 * counted[1]


def test_words_of_plain_texts_are_cut_once_and_bounds_change_no_ids(monkeypatch):
    path, cut, pieces = public_tokenizers.path("word_bpe_49k.json"), [], tokenfiles._pieces
    monkeypatch.setattr(tokenfiles, "_pieces", lambda text: cut.append(text) or pieces(text))
    rng = np.random.default_rng(14)
    words = ["The", "thing,", "isn't", "(it)", "1984", "Éléments", "...", "a-b", "x" * 90, "Straße", "don't."]
    texts = [" ".join(np.array(words)[rng.integers(0, len(words), 40)]) for _ in range(300)]
    texts += ["", " \t\n ", "\x0ba\x0c b\r\n", "日本 the thing", "<|endoftext|> the", " the\xa0thing "] * 3
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = tokenfiles.Encoder(path)
    assert [i.tolist() for i in encoder.encode(texts)] == want == [i.tolist() for i in encoder.encode(texts)]
    assert sum(map(len, cut)) < 2000  # the plain texts have over 60,000 characters
    for size in (0, 1, 5, 14):
        narrow = tokenfiles.Encoder(path)
        narrow.plain.size = size
        assert [i.tolist() for s in range(0, len(texts), 20) for i in narrow.encode(texts[s : s + 20])] == want
        assert len(narrow.plain.words) <= size and len(narrow.plain.words) == len(narrow.plain.again) == len(narrow.plain.counts)


def test_tiles_pair_different_chunks_and_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 32)
    monkeypatch.setattr(vectors, "TASK", 64)
    rng = np.random.default_rng(15)
    x = rng.normal(size=(150, 32))
    x[75:] = x[:75] + rng.normal(size=(75, 32)) * 0.7  # pairs around the threshold, too near to other vectors to be split
    x = vectors.unit(list(x))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    classes = rows.selectExpr("vec_id rep", "label", "embedding vector", "1L copies")
    placed = vectors.shards(classes, 0.7).toPandas()
    tiled = placed[placed["tile"] != placed["shard"] + "-0-0"]
    assert len(tiled) and (tiled.groupby("tile")["chunk"].nunique() == 2).all()
    assert (tiled.groupby(["shard", "rep"])["within"].sum() == 1).all()
    near = x @ x.T >= 0.7
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(rows, 0.7).collect()}
    assert near.any() and got == dict(enumerate(near.sum(axis=1).tolist()))
