"""SimHash, BPE and the text operators against brute force."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import types as T

from cairn.llm import bpe, linededup, mixing, pretokens, quality, simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 6))) for _ in range(300)]
    rows = [(i, "\n".join(" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 15))) for _ in range(rnd.randint(1, 8))), f"s{i % 4}") for i in range(120)]
    for i in range(120, 150):  # near copies in groups
        words = rows[i % 7][1].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "s0"))
    rows += [(150, None, None), (151, "", "s1"), (152, None, "s2"), (153, rows[3][1], "s3"), (153, rows[3][1], "s3"), (None, "alone without id", "s0"), (154, "word " * 30_000, "s1")]
    return rows


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components(spark, corpus):
    prints = {i: brute_fingerprint(t) for i, t, _ in corpus if i is not None}
    want = brute_components(prints)
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert all(r.fp & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.one_of_each(frame(spark, corpus))
    assert kept.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))


def test_links_of_planted_fingerprints(spark, monkeypatch):
    rnd = random.Random(9)
    prints = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            prints.add(base ^ 1 << rnd.randrange(64) ^ (1 << rnd.randrange(64) if rnd.random() < 0.5 else 0) ^ (7 << rnd.randrange(60) if rnd.random() < 0.2 else 0))
    prints |= {0xABCDEF << 40 | x for x in rnd.sample(range(1 << 12), 500)}  # crowded keys
    prints = sorted(prints)
    want = brute_components({p: p for p in prints})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for limit in (64, 2):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        found = {r.node: r.label for r in simhash.components(simhash.links(rows)).collect()}
        groups, wanted = {}, {}
        for p in prints:
            groups.setdefault(found.get(signed(p), signed(p)), set()).add(p)
            wanted.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_bpe_is_the_library(spark, corpus):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rnd = random.Random(3)
    odd = ["", " ", "  a", "a  b ", "a \n b", "\n\n", "don't  I'LL can't", "x" * 5000, "!?" * 700, "\U0001f600 \U0001f600", "a\tb  \t c", "　ab　 c", "​ a", "<|endoftext|> z", *["".join(rnd.choices(" aabz1'\n\té漢\U0001f600.", k=rnd.randint(0, 40))) for _ in range(500)]]
    rows = corpus + [(1000 + i, t, "s") for i, t in enumerate(odd)]
    got = bpe.encode_documents(frame(spark, rows), with_ids=True).collect()
    assert len(got) == len(rows)
    text = {(i, t): t for i, t, _ in rows}
    by_id = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = enc.encode_ordinary(by_id[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by_id[r.doc_id].encode()).hexdigest()
    assert text


def test_utf8_machine_waits_and_refuses():
    data = "aé漢😀".encode()
    for step in range(1, 5):
        m = bpe.Utf8Machine()
        assert "".join(m.feed(data[i : i + step]) for i in range(0, len(data), step)) == data.decode()
        m.close()
    m = bpe.Utf8Machine()
    m.feed(data[:-1])
    with pytest.raises(ValueError):
        m.close()
    with pytest.raises(UnicodeDecodeError):
        bpe.Utf8Machine().feed(b"\xff")


def test_utf8_machine_decides_as_a_decoder_does():
    rnd = random.Random(5)
    parts = [bytes([b]) for b in range(256)] + [c.encode() for c in "aé߿ࠀ漢퟿�\U00010000\U0010ffff"]
    for _ in range(4000):
        data = b"".join(rnd.choices(parts, k=rnd.randint(0, 5)))
        path = bpe.utf8_path(data)
        cut = rnd.randint(0, len(data))
        assert path == bytes(bpe.utf8_path(data[cut:])[s] for s in bpe.utf8_path(data[:cut]))
        try:
            want = data.decode()
        except UnicodeDecodeError as e:
            # a cut last character waits, anything else is refused
            assert (path[0] != bpe.REJECTED) == (e.reason == "unexpected end of data")
        else:
            assert path[0] == 0
            assert bpe.Utf8Machine().feed(data) == want


def test_decode_stream_over_every_cut():
    data = "aé漢😀 b😀漢".encode()
    texts = {i: bytes([i]) for i in range(256)} | {300: "é漢".encode(), 301: "漢".encode()[1:] + b"\xf0", 302: "😀".encode()[1:]}
    machine = bpe.Utf8Machine(texts, {i: bpe.utf8_path(t) for i, t in texts.items()})
    for ids, want in (list(data), data), ([97, 300, 0xE6, 301, 302, 98], "aé漢漢😀b".encode()), ([], b""):
        for chunk in range(1, len(ids) + 2):
            found = list(bpe.decode_stream(ids, machine, chunk))
            assert b"".join(found) == want
            for part in found:
                part.decode()
    for bad in [302], [301], [97, 0xE6, 97], [0xC0]:
        with pytest.raises(ValueError):
            list(bpe.decode_stream(bad, machine))
    assert b"".join(bpe.decode_stream([97], machine)) == b"a"


def test_line_dedup(spark, corpus):
    strip = " \t\n\x0b\x0c\r"
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = corpus + [(200, "A long shared LINE\n\tother line of text here\x0b\n\n", "s"), (201, "x\n  a long shared line \r\nA LONG shared line", "s"), (202, "É long shared line\né long shared line", "s"), (203, "é long shared line", "s")]
    holders = {}
    for i, t, _ in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(line.strip(strip).translate(fold), set()).add(i)
    got = linededup.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {i: t or "" for i, t, _ in rows}
    for r in got:
        lines = by_id[r.doc_id].split("\n")
        key = lambda x: x.strip(strip).translate(fold)
        stay = [x for x in lines if r.doc_id is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == r.doc_id]
        assert (r.kept_text, r.n_lines, r.n_dropped) == ("\n".join(stay), len(lines), len(lines) - len(stay))


def test_quality_counts(spark, corpus):
    rows = corpus + [(300, "# a & b | c\n# a & b | c\n \n \n" * 3, "s"), (301, "one two three four five " * 3, "s"), (302, "a a a a a a", "s")]
    got = {(r.doc_id): r for r in quality.quality(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        windows = {}
        for k in range(len(words) - 4):
            windows.setdefault(tuple(words[k : k + 5]), []).append(k)
        again = {k + j for ks in windows.values() if len(ks) > 1 for k in ks for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words)) and not (r.kept and r.base_failed)


def test_quality_rejects_depleted(spark):
    shared = "the same long boilerplate line stands on every page of this host and says nothing new"
    rows = [(i, f"{shared}\nword{i} " + " ".join(f"w{i}x{k}" for k in range(40)), "h") for i in range(40)] + [(100 + i, f"{shared}\nshort tail {i}", "h") for i in range(3)] + [(200, f"{shared}\nshort tail", "other")]
    kept = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[100 + i] for i in range(3)) and kept[200]


@pytest.mark.parametrize("weights", [(5.0, 2.0, 1.0), (1.0,)])
def test_mixing_meets_targets(spark, corpus, weights):
    rows = corpus + [(1000 + i, "w " * (i % 9), "big") for i in range(900)]
    got = mixing.mix(frame(spark, rows), weights).collect()
    assert len(got) == len(rows)
    taken, goal, size, most = {}, {}, {}, {}
    for r in got:
        m = r._mix
        assert m.size == len((r.text or "").split()) and 0 <= m.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + m.copies * m.size
        size[r.source] = size.get(r.source, 0) + m.size
        goal[r.source], most[r.source] = m.target, max(most.get(r.source, 0), m.size)
    total = sum(size.values())
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    level = max(g / w[s] for s, g in goal.items())
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(most[s], 1) and goal[s] <= 2 * size[s] + 1e-9
        assert goal[s] == pytest.approx(min(2 * size[s], level * w[s]))
    again = mixing.mix(frame(spark, rows[::-1]), weights).collect()
    assert sorted((str(r.doc_id), r._mix.copies) for r in got) == sorted((str(r.doc_id), r._mix.copies) for r in again)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert linededup.dedup_lines(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert bpe.encode_documents(empty).count() == 0
