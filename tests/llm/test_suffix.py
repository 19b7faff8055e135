"""Suffix-array dedup: the order against sorting, the removal against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from cairn.llm import suffix


def test_suffix_order():
    rnd = random.Random(2)
    for _ in range(1500):
        text = [rnd.randint(1, rnd.choice([2, 3, 6])) for _ in range(rnd.randint(0, 40))] + [0]
        assert suffix.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchor_in_every_string(monkeypatch):
    rnd = random.Random(3)
    for text in (bytes(rnd.choices(b"abcdef", k=3000)), b"ab" * 400, b"a" * 700, b"x" * 150, b""):
        at, h, around, before, strings = suffix.anchors(text)
        own = {s for p, b, n in zip(at, before, strings, strict=True) for s in range(p - b, p - b + n + 1) if s <= p <= s + suffix.SPAN}
        assert own == set(range(len(text) - suffix.LENGTH + 1))
        monkeypatch.setattr(suffix, "CHUNK", 256)
        again = suffix.anchors(text)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(again, (at, h, around, before, strings), strict=True))


def test_anchors_together(monkeypatch):
    rnd = random.Random(4)
    texts = [b"", b"a" * 450, b"ab" * 300, b"x" * 199, b"y" * 200] + [bytes(rnd.choices(b"abc\xc3\xa9\n", k=rnd.randint(0, 900))) for _ in range(60)]
    texts += texts[-5:] + [texts[-1][:-1]]
    for together in (1, 500, 1 << 17):
        monkeypatch.setattr(suffix, "TOGETHER", together)
        got = sorted(zip(*[x.tolist() for x in suffix.anchors_of(texts)], strict=True))
        assert got == sorted((k, *r) for k, t in enumerate(texts) for r in zip(*[x.tolist() for x in suffix.anchors(t)], strict=True))


def test_repeated_strings_is_brute_force():
    rnd = random.Random(5)
    for _ in range(200):
        base = [rnd.choices(b"ab", k=suffix.SPAN) for _ in range(2)]
        sides = set()
        for _ in range(rnd.randint(2, 40)):
            x, y = (bytes(c if rnd.random() > rnd.choice([0, 0.005, 0.05]) else 99 for c in b) for b in base)
            n = rnd.choice([suffix.SPAN, rnd.randint(0, suffix.SPAN)])
            sides.add((x[suffix.SPAN - n :], y[: rnd.choice([suffix.SPAN, rnd.randint(suffix.SPAN - n, suffix.SPAN)])]))
        sides = sorted(sides)
        strings = [{d: (a + b"|" + b)[len(a) - d :][: suffix.SPAN + 1] for d in range(suffix.SPAN - len(b), len(a) + 1)} for a, b in sides]
        seen = Counter((d, s) for row in strings for d, s in row.items())
        hit = [[d for d, s in row.items() if seen[d, s] > 1] for row in strings]
        assert suffix.repeated_strings(sides) == [(-max(h), -min(h)) if h else None for h in hit]


def brute(texts):
    windows = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if windows[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not p for g, p in zip(gone, b"\0" + bytes(gone), strict=False)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [512, 3])
def test_removal_is_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    rnd = random.Random(7)
    make = lambda n: "".join(rnd.choices("abcdefgh éü\n", k=n))
    passages = [make(n) for n in (150, 199, 200, 210, 320, 900)]
    texts = [make(rnd.randint(0, 1500)) for _ in range(20)]
    for p in passages:
        for _ in range(5):
            cut = rnd.randrange(20)
            texts.append(make(rnd.randint(0, 300)) + p[cut:] + make(rnd.randint(0, 300)))
    whole = make(1200)
    texts += [whole, whole, whole[:600] + "X" + whole[601:], whole[:300] + whole[500:], "ab" * 200, "a" * 450, passages[5] + "-" + passages[5], None, ""]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(None, whole, "n"), (0, texts[0], "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    want = Counter((i, *r) for (i, _, _), r in zip(rows, brute([(t or "").encode() for _, t, _ in rows]), strict=True))
    got = suffix.dedup_bytes(frame).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeated_strings_of_an_anchor():
    rnd = random.Random(5)
    for _ in range(600):
        alphabet, m = rnd.choice([b"a", b"ab", b"abcdefgh"]), rnd.randint(1, 8)
        base = [bytes(rnd.choices(alphabet, k=240)) for _ in range(2)]
        sides = set()
        for _ in range(m):
            b = bytearray(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                b[rnd.randrange(240)] = 120
            first, end = rnd.randint(0, 120), rnd.randint(120, 240)
            if end - first >= 120:
                sides.add((bytes(b[first:120]), bytes(b[120:end])))
        sides = sorted(sides)
        strings = [{d: (left[len(left) - d :], right[: 120 - d]) for d in range(max(0, 120 - len(right)), len(left) + 1)} for left, right in sides]
        want = []
        for k, own in enumerate(strings):
            again = [-d for d, x in own.items() if any(o.get(d) == x for j, o in enumerate(strings) if j != k)]
            want.append((min(again), max(again)) if again else None)
        assert suffix.repeated_strings(sides) == want


def test_empty(spark):
    assert suffix.dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
