"""The whole pipeline against a plain Python version of its five stages."""

import hashlib
import math
import random
import re

import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from cairn.llm import pretokens

STRIP = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def good(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w) >= 10 and 100 * len(again) <= 20 * len(w)


def fewer_lines(rows):
    held = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(line.strip(STRIP).translate(FOLD), set()).add(i)
    drop = lambda k, i: len(k) >= 10 and len(held[k]) > 1 and min(held[k]) != i
    return [(i, "\n".join(x for x in (t or "").split("\n") if not drop(x.strip(STRIP).translate(FOLD), i)), s) for i, t, s in rows]


def print_of(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_each(rows):
    prints, group = {i: print_of(t) for i, t, _ in rows}, {}
    for i in sorted(prints):
        near = {group[j] for j in group if (prints[i] ^ prints[j]).bit_count() <= 2}
        group[i] = min([i, *near])
        for j in group:
            if group[j] in near:
                group[j] = group[i]
    return [r for r in rows if group[r[0]] == r[0]]


def mixed(rows):
    size = {i: len(words(t)) for i, t, _ in rows}
    of = {}
    for i, _, s in rows:
        of.setdefault(s, []).append(i)
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    total, left, open_, goal = 1.5 * sum(size.values()), 1.5 * sum(size.values()), set(of), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sum(size[i] for i in of[s])]
        if not over:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            goal[s] = 2 * sum(size[i] for i in of[s])
            left -= goal[s]
            open_.remove(s)
    assert math.isclose(sum(goal.values()), total)
    copies = {}
    for s, ids in of.items():
        whole = sum(size[i] for i in ids)
        base = int(goal[s] // whole) if whole else 0
        rest, used = goal[s] - base * whole, 0
        for i in sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:15]):
            copies[i] = base + (rest > 0 and 2 * (rest - used) >= size[i])
            used += size[i]
    return [r for r in rows for _ in range(copies[r[0]])]


def test_pipeline_is_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefgé", k=rnd.randint(2, 7))) for _ in range(400)]
    line = lambda: " ".join(rnd.choices(vocabulary, k=rnd.randint(3, 14)))
    shared = [line() for _ in range(6)]
    rows = [(i, "\n".join([*(line() for _ in range(rnd.randint(1, 6))), *rnd.sample(shared, rnd.randint(0, 2))]), f"s{i % 4}") for i in range(90)]
    rows += [(200 + i, rows[i][1], "s1") for i in range(5)] + [(300, None, None), (301, "too short", "s0"), (302, "again and again and " * 9, "s2"), (303, line() + "\n" + line() + "\n" + line(), None)]
    for i in range(400, 412):
        w = rows[i - 400][1].split(" ")
        rows.append((i, " ".join([*w, "tail"]), "s3"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    kept = mixed(one_each(fewer_lines([r for r in rows if good(r[1])])))
    want = sorted((i, enc.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t, _ in kept)
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len({i for i, *_ in want}) > 60
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
