"""Suffix-array dedup: removal of bytes under strings of 200 that start anywhere else."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, skew_join, stored, text_hash

#: Length of the repeated strings, and of the anchors, one of which every such string holds.
LENGTH, ANCHOR = 200, 80
SPAN = LENGTH - ANCHOR  # bytes on either side of an anchor that its strings can reach
#: Different surroundings of an anchor that one suffix array takes; those of anchors with more part by NARROW
#: neighbouring starts and what these share, and what is crowded even so is counted string by string.
GROUP, NARROW = 1024, 16
#: Bytes of a long text, and of short ones together, worked on at once.
CHUNK, TOGETHER = 1 << 20, 1 << 17
_BASE, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def suffix_order(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last symbol must be smaller than all others.

    Grouping construction. Suffixes begin in groups by first symbol. Groups are taken in descending order; each
    member points to the nearest suffix before it in a lower group, and the suffixes pointed to move right behind
    their old group, those with more pointers higher. After it a group holds the suffixes with one Lyndon prefix.
    Then, in the order found so far, each suffix passes its place to the one before it and along those pointers:
    each takes the next place of its group.
    """
    n = len(text)
    symbols = np.array(text, np.int64)
    order = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.diff(symbols[order], prepend=-1))
    sizes, ranks, groups, counts = np.diff(heads, append=n), np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
    ranks[order], groups[order], counts[heads] = np.arange(n), np.repeat(heads, sizes), sizes
    sa, at, group, size = order.tolist(), ranks.tolist(), groups.tolist(), counts.tolist()
    prev = list(range(-1, n - 1))
    end = n - 1
    while end >= 0:
        first = group[sa[end]]
        if first == end:
            i = sa[end]
            p = prev[i]
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                old = group[p]
                k = size[old]
                if k > 1:
                    last = old + k - 1
                    q, j = sa[last], at[p]
                    sa[j], at[q], sa[last], at[p] = q, j, p, last
                    size[old], size[last], group[p] = k - 1, 1, last
        else:
            pointers: dict[int, int] = {}
            for i in sa[first : end + 1]:
                p = prev[i]
                while p >= 0 and group[p] >= first:
                    p = prev[p]
                prev[i] = p
                if p >= 0:
                    pointers[p] = pointers.get(p, 0) + 1
            by_count: dict[int, list[int]] = defaultdict(list)
            for p, c in pointers.items():
                by_count[c].append(p)
            for c in sorted(by_count, reverse=True):
                leaving: dict[int, list[int]] = defaultdict(list)
                for p in by_count[c]:
                    leaving[group[p]].append(p)
                for old, ps in leaving.items():
                    k = size[old]
                    if len(ps) == k:
                        continue
                    for p in ps:
                        k -= 1
                        last = old + k
                        q, j = sa[last], at[p]
                        sa[j], at[q], sa[last], at[p] = q, j, p, last
                    size[old], size[last] = k, len(ps)
                    for p in ps:
                        group[p] = last
        end = first - 1
    free = list(range(n))
    placed = bytearray(n)
    out = [n - 1] * n
    placed[n - 1] = 1
    for r in range(n):
        s = out[r] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = prev[s]
    return out


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def agreement(strings: list[bytes]) -> tuple[list[int], set[int]]:
    """Of each string, the longest prefix that another one also has, and lengths of what any two have in common.

    In sorted order a neighbour has the longest, and what two have in common some neighbours between them have.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    out, lengths = [0] * len(strings), set()
    for a, b in zip(order, order[1:], strict=False):
        n = common_prefix(strings[a], strings[b])
        lengths.add(n)
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out, lengths


def repeated_strings(sides: list[tuple[bytes, bytes]]) -> list[tuple[int, int] | None]:
    """For different surroundings (bytes before and after) of one anchor: the first and the last start, counted from
    the anchor, of strings of LENGTH over the anchor that another one also has; None without any.

    How far a surrounding agrees with any other, before and behind the anchor, bounds where its strings can start; those
    that agree too little on both sides leave, and the others are cut to what they share. Cut ones that stand twice are
    one text, all of whose strings are repeated. A row of repeated strings begins as far before the anchor as two
    surroundings agree there, or ends as far behind it, so the text whose suffixes are sorted has blocks for symbols:
    the bytes between two such starts, and behind the anchor those between the ends of the strings that begin there.
    Each such string is the same number of symbols in a row, and stands twice if a neighbour in the order begins with
    them. Each surrounding ends in a symbol of its own.
    """
    out: list[tuple[int, int] | None] = [None] * len(sides)
    who, fewer = list(range(len(sides))), True
    while fewer:
        (back, begin), (ahead, reach) = agreement([sides[k][0][::-1] for k in who]), agreement([sides[k][1] for k in who])
        stay = [i for i in range(len(who)) if back[i] + ahead[i] >= SPAN]
        fewer, who = 2 * len(stay) < len(who), [who[i] for i in stay]
        back, ahead = [back[i] for i in stay], [ahead[i] for i in stay]
    same: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for k, most, far in zip(who, back, ahead, strict=True):
        left, right = sides[k]
        same[left[len(left) - most :], right[:far]].append(k)
    spans: list[tuple[int, int] | None] = [(-len(left), len(right) - SPAN) if len(ks) > 1 else None for (left, right), ks in same.items()]
    m, cuts = len(same), sorted(begin | {max(0, SPAN - e) for e in reach}, reverse=True)
    width, down = len(cuts) + 2, [-d for d in cuts]
    symbol = count(m + 1).__next__
    steps = [0, *(SPAN - d for d in cuts)]
    ahead_of = [(defaultdict(symbol), slice(d, e)) for d, e in zip(steps, steps[1:], strict=False)]
    behind = [(defaultdict(symbol), slice(d, e)) for d, e in zip(steps[1:], [*steps[2:], SPAN], strict=False)]
    text: list[int] = []
    owner: list[tuple[int, int] | None] = []
    for k, (left, right) in enumerate(same if None in spans else ()):
        left, most, least = left.rjust(SPAN), len(left), SPAN - len(right)
        lo, hi = bisect_left(down, -most), bisect_right(down, -least)  # never none: ``most`` is one
        text += [r[left[s]] for r, s in behind[lo:]]
        text.append(m)
        text += [r[right[s]] for r, s in ahead_of[:hi]]
        text.append(m - 1 - k)
        owner += [(k, d) for d in down[lo:hi]]
        owner += [None] * (len(text) - len(owner))
    last, before = None, None
    for i in suffix_order(text) if text else ():
        here = owner[i]
        if here is None:
            continue
        string = text[i : i + width]
        if string == last:
            for k, d in (before, here):
                f = spans[k]
                spans[k] = (min(d, f[0]), max(d, f[1])) if f else (d, d)
        last, before = string, here
    for ks, f in zip(same.values(), spans, strict=True):
        for k in ks:
            out[k] = f
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        n = CHUNK + 8 * LENGTH
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, w: int, fold, fill) -> np.ndarray:
    """``fold`` of each ``w`` neighbours of ``x``."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % w, fill, x.dtype)]).reshape(-1, w)
    ahead = fold.accumulate(blocks, axis=1).ravel()
    back = fold.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[: n - w + 1], ahead[w - 1 : n])


def _in_row(bytes_: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of bytes in a row, of which the strings at ``whole`` starts count (None: all); see ``anchors``."""
    up, down = _tables()
    c = bytes_.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c * up[: len(c)], out=sums[1:])
    h = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(c) - ANCHOR + 1]) | np.uint64(1)  # 0 marks strings that do not count
    least = _sliding(h, SPAN + 1, np.minimum, np.uint64((1 << 64) - 1))
    if whole is not None:
        least[~whole] = 0
    wide = np.concatenate([np.zeros(SPAN, np.uint64), least, np.zeros(SPAN, np.uint64)])
    most = _sliding(wide, SPAN + 1, np.maximum, np.uint64(0))
    at = np.flatnonzero(most == h)
    # strings of one least hash come in a row; an anchor's are those of its hash that reach over it
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    run = np.searchsorted(last, at - SPAN)
    while (other := least[first[run]] != h[at]).any():
        run = run + other
    start, end = np.maximum(first[run], at - SPAN), np.minimum(last[run], at)
    around = _mixed((sums[end + LENGTH] - sums[start]) * down[start] + (at - start).astype(np.uint64) * np.uint64(0x165667B19E3779F9) + (end - start).astype(np.uint64) * np.uint64(0x27D4EB2F165667C5))
    return at, h[at], around, at - start, end - start


NO_ANCHORS = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """The text's anchors: position, hash, hash of the surroundings, bytes of those before the anchor, strings less one.

    An anchor is a string of ANCHOR bytes whose hash is the least of SPAN + 1 neighbours: the least of those in some
    strings of LENGTH bytes, which are its strings and make up its surroundings. Every string has an anchor, the same
    wherever the string is. Where hashes tie, all are anchors.
    """
    n, found = len(text), [NO_ANCHORS]
    for s in range(0, n - ANCHOR + 1 if n >= LENGTH else 0, CHUNK):
        lo, hi = max(0, s - 3 * LENGTH), min(n, s + CHUNK + 3 * LENGTH)
        at, *more = _in_row(np.frombuffer(text, np.uint8)[lo:hi])
        own = (at + lo >= s) & (at + lo < s + CHUNK)
        found.append((at[own] + lo, *(x[own] for x in more)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of the text, then as ``anchors``, for many texts; short ones are worked on TOGETHER bytes at once."""
    found, held, size = [(np.zeros(0, np.int64), *NO_ANCHORS)], [], 0

    def together():
        lens = np.array([len(texts[k]) for k in held])
        ends = np.cumsum(lens)
        n = int(ends[-1])
        whole = np.repeat(ends, lens)[: n - LENGTH + 1] - np.arange(n - LENGTH + 1) >= LENGTH
        at, *more = _in_row(np.frombuffer(b"".join([texts[k] for k in held]), np.uint8), whole)
        k = np.searchsorted(ends, at, side="right")
        found.append((np.array(held)[k], at - (ends - lens)[k], *more))

    for k, text in enumerate(texts):
        if len(text) > TOGETHER:
            more = anchors(text)
            found.append((np.full(len(more[0]), k), *more))
        elif len(text) >= LENGTH:
            held.append(k)
            size += len(text)
            if size > TOGETHER:
                together()
                held, size = [], 0
    if held:
        together()
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: ``place`` of an anchor: 32 bits of the position, 7 of the bytes before, 7 of the strings. The text's whole hash,
#: ``row``, stands beside it.
def _unpacked(place: int) -> tuple[int, int, int]:
    """Position, first byte and end of the surroundings."""
    pos, before, strings = place >> 14 & 0xFFFFFFFF, place >> 7 & 127, place & 127
    return pos, pos - before, pos - before + strings + LENGTH


def _packed(batches):
    """Texts under zstd, as they go through two shuffles."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        z = [None if t is None else squeeze(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(z, pa.binary())], ["doc_id", "row", "z"])


def _texts(column) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [open_(z) if z is not None else b"" for z in column.to_pylist()]


def _anchor_rows(batches):
    for b in batches:
        who, p, h, around, before, strings = anchors_of([t or b"" for t in b.column("text").to_pylist()])
        if len(who):
            place = p << 14 | before << 7 | strings
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who)), b.column("row").take(pa.array(who)), pa.array(h.view(np.int64)), pa.array(around.view(np.int64)), pa.array(place)], ["doc_id", "row", "anchor", "around", "place"])


def _batch(rows, spec: str):
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in spec.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


SIDES, SPANS, STRINGS = "doc_id long, row long, anchor long, place long, before binary, after binary", "doc_id long, row long, lo int, hi int", "doc_id long, row long, lo int, w1 long, w2 long"


def _sides(batches):
    """The bytes on both sides of each anchor asked for."""
    for b in batches:
        rows = []
        for doc_id, row, text, asked in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), _texts(b.column("z")), b.column("asked").to_pylist(), strict=True):
            for a in asked:
                pos, lo, hi = _unpacked(a["place"])
                rows.append((doc_id, row, a["anchor"], a["place"], text[lo:pos], text[pos + ANCHOR : hi]))
        yield _batch(rows, SIDES)


def _rows(b):
    return zip(*[b.column(x).to_pylist() for x in ("doc_id", "row", "anchor", "place", "before", "after")], strict=True)


def _sort_groups(batches):
    """Rows of one anchor come one after another: a suffix array an anchor, a span a row with repeated strings."""

    def solve(rows):
        found = repeated_strings([(before, after) for *_, before, after in rows])
        return [(doc_id, row, (place >> 14) + f[0], (place >> 14) + f[1] + LENGTH) for (doc_id, row, _, place, *_), f in zip(rows, found, strict=True) if f]

    held, key = [], None
    for b in batches:
        out = []
        for r in _rows(b):
            if r[2] != key and held:
                out += solve(held)
                held = []
            key = r[2]
            held.append(r)
        yield _batch(out, SPANS)
    yield _batch(solve(held) if held else [], SPANS)


def _narrowed(batches):
    """Surroundings of a crowded anchor, cut for each NARROW neighbouring distances of a string's start to the anchor.

    Equal strings of one such range also share what all strings of the range hold, so the anchor's name becomes the
    hash of that: those who share less part, and those who share it with nobody drop out. ``same`` names what is left.
    """
    for b in batches:
        rows = []
        for doc_id, row, anchor, place, before, after in _rows(b):
            salt = anchor.to_bytes(8, "little", signed=True)
            least, most = SPAN - len(after), len(before)
            for low in range(least - least % NARROW, most + 1, NARROW):
                high = low + NARROW - 1
                core = before[most - low :] + after[: max(0, SPAN - high)]
                name = hashlib.blake2b(core, digest_size=8, salt=salt, person=bytes((low,))).digest()
                left, right = before[max(0, most - high) :], after[: SPAN - max(low, least)]
                same = hashlib.blake2b(left + right, digest_size=8, salt=salt, person=bytes((low, len(left)))).digest()
                rows.append((doc_id, row, int.from_bytes(name, "little", signed=True), place, left, right, int.from_bytes(same, "little", signed=True)))
        yield _batch(rows, f"{SIDES}, same long")


def _strings(batches):
    """Hash and place of each string of an anchor, for what is crowded even so."""
    for b in batches:
        rows = []
        for doc_id, row, anchor, place, before, after in _rows(b):
            pos, *_ = _unpacked(place)
            salt = anchor.to_bytes(8, "little", signed=True)
            for d in range(SPAN - len(after), len(before) + 1):
                w = hashlib.blake2b(before[len(before) - d :] + after[: SPAN - d], digest_size=16, salt=salt, person=bytes((d,))).digest()
                rows.append((doc_id, row, pos - d, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)))
        yield _batch(rows, STRINGS)


def merged_spans(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _remove(batches):
    for b in batches:
        n, gone, runs, digest, kept = [], [], [], [], []
        for text, spans in zip(_texts(b.column("z")), b.column("spans").to_pylist(), strict=True):
            at, left = 0, []
            merged = merged_spans(spans or [])
            for lo, hi in merged:
                left.append(text[at:lo])
                at = hi
            left.append(text[at:])
            rest = b"".join(left)
            n.append(len(text)), gone.append(len(text) - len(rest)), runs.append(len(merged)), digest.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """``docs(doc_id, row, text as binary)`` -> (doc_id, row, lo, hi): spans covered by repeated strings.

    Two equal strings have an anchor at the same place in them. So: count anchors; where the whole surroundings of an
    anchor stand twice, all of it is repeated; where they differ, suffix arrays over them, one an anchor, find the
    strings shared. An anchor with over GROUP different surroundings is parted by what its strings share; in a part,
    cut surroundings that stand twice are repeated whole, and one of each goes to the part's suffix array. If a part has
    over GROUP different ones even so, their strings are counted by hash, spread over the cluster. Anchors are found twice rather than kept: that is cheaper than the disk for all of them.
    """
    rows = docs.mapInArrow(_anchor_rows, "doc_id long, row long, anchor long, around long, place long")
    twice = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    near = stored(rows.join(twice, "anchor"))
    kinds = stored(near.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "place")).alias("first")))
    sure = skew_join(near, kinds.where("n > 1").select("anchor", "around", "n"), ["anchor", "around"], "n", near.count())
    pos = F.shiftright("place", 14).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long") - F.shiftright("place", 7).bitwiseAND(F.lit(127))
    sure = sure.select("doc_id", "row", pos.cast("int").alias("lo"), (pos + F.col("place").bitwiseAND(F.lit(127)) + LENGTH).cast("int").alias("hi"))
    differ = stored(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"))
    asked = kinds.join(differ.select("anchor"), "anchor").select("first.*", "anchor")
    lists = asked.groupBy("doc_id", "row").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    sides = stored(packed.join(lists, ["doc_id", "row"]).mapInArrow(_sides, SIDES))
    many = differ.where(F.col("m") > GROUP).select("anchor")
    narrow = stored(sides.join(many, "anchor", "left_semi").mapInArrow(_narrowed, f"{SIDES}, same long"))
    part = narrow.groupBy("anchor", "same").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "place", "before", "after")).alias("first"))
    alike = stored(part.select("anchor", "same", "n", "first.*"))
    at = F.shiftright("place", 14).bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")
    whole = skew_join(narrow, alike.where("n > 1").select("anchor", "same", "n"), ["anchor", "same"], "n", narrow.count())
    whole = whole.select("doc_id", "row", (at - F.octet_length("before")).cast("int").alias("lo"), (at + ANCHOR + F.octet_length("after")).cast("int").alias("hi"))
    again = stored(alike.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"))
    apart = alike.select(*sides.columns)
    few = sides.join(many, "anchor", "left_anti").unionByName(apart.join(again.where(F.col("m") <= GROUP), "anchor", "left_semi"))
    arrays = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_groups, SPANS)
    strings = stored(apart.join(again.where(F.col("m") > GROUP), "anchor", "left_semi").mapInArrow(_strings, STRINGS))
    shared = stored(strings.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"))
    counted = skew_join(strings, shared, ["w1", "w2"], "n", strings.count()).select("doc_id", "row", "lo", (F.col("lo") + LENGTH).alias("hi"))
    return sure.unionByName(whole).unionByName(arrays).unionByName(counted)


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for each row.

    A byte goes if a string of 200 bytes over it also starts anywhere else, in this or another document, overlaps
    included; strings are those of the input, and never cross documents. Null text is empty. Texts under 200 bytes
    stay whole. Rows repeated in full are documents like any other, and so lose what they share; ids may be null. Rows
    of one id and different texts are told apart by 64 bits of the text's hash.
    """
    bounded_batches(docs.sparkSession)
    none = F.lit(-(1 << 63))
    row = F.coalesce(text_hash(), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("doc_id"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    packed = rows.mapInArrow(_packed, "doc_id long, row long, z binary")
    lists = repeated_spans(rows, packed).groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    joined = packed.join(lists, ["doc_id", "row"], "left").select(F.nullif("doc_id", none).alias("doc_id"), "z", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).drop("kept")
