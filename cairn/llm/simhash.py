"""SimHash near-dedup with pigeonring filtering of candidates."""

from __future__ import annotations

import math
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, carried, cut, held, let, own_columns, release, skew_join, stored, text_hash
from .components import components

SHINGLE, SEED, CHUNK = 3, 42, 1 << 16
#: The ring: widths of the segments of a fingerprint, and the bits that may differ in all.
WIDTHS, TAU = (9, 9, 9, 9, 9, 9, 10), 2
#: Fingerprints that may share a candidate key and still be compared pair by pair.
PAIRWISE = 64
#: Members of a component that one round compares a key's others with, and pairs a row that need no more rounds.
HUBS, WORK = 8, 4
#: A key that leaves at most so many bits open is shared by few enough, 2^OPEN at most.
OPEN = 6
#: Most names of texts that are broadcast, beyond it the texts are shuffled.
BROADCAST = 500_000
#: Counts of the shingles that sets with a key in common share.
COUNTS = 3
#: The ring of a set of shingles: its parts, the shingles that it takes in at most, factors of the places in a chain.
PARTS, RING_TOP = 32, 64
CHAIN = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(PARTS)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the 3-word shingles, repeats included; A-Z folded; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(len(words) - SHINGLE + 1, 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = h[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for b in batches:
        fp = np.fromiter(map(fingerprint, b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) of each document; Python only hashes, bytes in and a long out."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("row"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, row long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(bits) -> int:
    return sum(1 << int(b) for b in bits)


def ring(bits: list[int], widths: tuple[int, ...]) -> list[tuple[int, list[tuple[int, int]]]]:
    """The candidate keys over ``bits``, a start each: (mask that must agree, [(mask, budget) of the longer chains]).

    With m segments and at most TAU differing bits, some start has every chain of l consecutive segments within
    l * TAU / m. Chains of budget 0 are exact, and give the key.
    """
    m, at = len(widths), [0, *np.cumsum(widths).tolist()]
    segments = [bits[at[i] : at[i + 1]] for i in range(m)]
    keys = []
    for start in range(m):
        order = [segments[(start + k) % m] for k in range(m)]
        chains = [(mask(sum(order[:n], [])), n * TAU // m) for n in range(1, m + 1)]
        keys.append((max(c for c, budget in chains if budget == 0), [(c, budget) for c, budget in chains if budget]))
    return keys


def first_keys() -> list[tuple[int, list[tuple[int, int]]]]:
    """The keys of whole fingerprints. Where the next chains may hold one bit, one half of them is exact too, so a key
    takes that half in: two keys a start, each of some 40 bits."""
    keys, out = ring([*range(64)], WIDTHS), []
    for exact, tests in keys:
        wide = max(c for c, budget in tests if budget == 1)
        single = [b for b in range(64) if (wide & ~exact) >> b & 1]
        out += [(exact | mask(half), tests) for half in (single[: len(single) // 2], single[len(single) // 2 :])]
    return out


def finer_keys(keys: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each key a ring of three segments over the bits that it leaves open: three keys, in a row."""
    out = []
    for exact, _ in keys:
        rest = [b for b in range(64) if not exact >> b & 1]
        n = len(rest)
        out += [(exact | k, tests) for k, tests in ring(rest, (n // 3, (n + 1) // 3, n - n // 3 - (n + 1) // 3))]
    return out


def chain_test(keys, a: Column, b: Column, t: Column) -> Column:
    """Do the chains of key ``t`` stay within their budgets, and the whole within TAU?"""
    differ, ok = a.bitwiseXOR(b), F.lit(True)
    for k in range(len(keys[0][1])):
        masks = F.array(*[F.lit(_signed(tests[k][0])).cast("long") for _, tests in keys])
        ok = ok & (F.bit_count(differ.bitwiseAND(F.get(masks, t))) <= keys[0][1][k][1])
    return ok & (F.bit_count(differ) <= TAU)


def links(prints: DataFrame) -> DataFrame:
    """``prints(fp)``, each once -> ``(u, v)``: fingerprints whose components are those of all links.

    Fingerprints that share a key are compared behind its chain test. A key that over PAIRWISE of them share is first
    made finer by a ring over the bits that it leaves open, again and again: they are a third fewer each time, and few
    bits hold few fingerprints, so no key stays crowded and nothing is capped or left out.
    """
    keys, found = first_keys(), None
    at = F.explode(F.array(*[F.lit(t) for t in range(len(keys))]))
    todo = prints.select("fp", at.alias("t"))
    while True:
        masks = F.array(*[F.lit(_signed(k)).cast("long") for k, _ in keys])
        keyed = todo.select("fp", "t", F.col("fp").bitwiseAND(F.get(masks, F.col("t"))).alias("key"))
        shared = cut(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
        rows = cut(keyed.join(shared, ["t", "key"]))
        narrow = all(64 - k.bit_count() <= OPEN for k, _ in keys)
        few = rows.where((F.col("n") <= PAIRWISE) | F.lit(narrow)).select("t", "key", "fp")
        a, b = few.alias("a"), few.alias("b")
        near = (F.col("a.fp") < F.col("b.fp")) & chain_test(keys, F.col("a.fp"), F.col("b.fp"), F.col("a.t"))
        pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
        found = pairs if found is None else found.unionByName(pairs)
        dense = rows.where(F.col("n") > PAIRWISE)
        if narrow or not dense.limit(1).count():
            return found.distinct()
        todo, keys = dense.select("fp", F.explode(F.sequence(3 * F.col("t"), 3 * F.col("t") + 2)).alias("t")), finer_keys(keys)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, row, fp, component_id), a row for each input row.

    Fingerprints that differ in at most two bits link; ``component_id`` is the smallest doc_id reachable. Exact
    copies and repeated rows share a fingerprint and so a class; empty and null texts have fingerprint 0 and link
    like any other; texts of any length are read whole. Rows of one id with different texts are in the class of their
    own text. Rows without doc_id get their class's component but never name one (null if the class has no id). Extra
    columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    found = components(links(classes.where("rep is not null").select("fp")))
    labelled = cut(classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    names = labelled.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("fps"))
    named = cut(skew_join(labelled, names, ["label"], "fps", labelled.count()).select("fp", "n", "component_id"))
    return skew_join(prints, named, ["fp"], "n", prints.count())


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted hashes of the different ``width``-word shingles; A-Z folded; a shorter text is one shingle, no words: none.

    A shingle's hash is made of its words' hashes in order.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    width = min(width, len(w))
    h = w[: len(w) - width + 1]
    for k in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[k : len(w) - width + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(31)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def differing(size: int, similarity: float) -> int:
    """Shingles in which two sets of at most ``size`` differ at most, both ways together, if their Jaccard index is ``similarity``."""
    return math.floor(2 * size * (1 - similarity) / (1 + similarity) + 1e-9)


def parted(hashes: np.ndarray, level: int, start_of: np.ndarray) -> tuple[np.ndarray, int]:
    """The ring of a set at ``level``: for each start a key of the chain of parts ``start_of`` (0: nothing in it), and a bit a part.

    The hashes' space, above RING_TOP shingles its first 2^-k alone, is a ring of PARTS parts. A part's segment is the
    SimHash of the shingles in it.
    """
    deep = max(level - RING_TOP.bit_length() + 1, 0)
    part = (hashes[: np.searchsorted(hashes, np.uint64(1 << (64 - deep)))] if deep else hashes) >> np.uint64(64 - deep - PARTS.bit_length() + 1)
    n, ring = np.bincount(part.astype(np.int64), minlength=PARTS), np.zeros(PARTS, np.uint64)
    if len(part):
        bits = np.unpackbits(hashes[: len(part)].view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        full = np.flatnonzero(n)
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0, dtype=np.int64)
        ring[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    ring = _mixed(ring + np.uint64(0x9E3779B97F4A7C15))
    width = start_of.shape[1]
    keys = _mixed((ring[start_of] * CHAIN[:width]).sum(axis=1, dtype=np.uint64) ^ np.uint64(level << 8) ^ np.arange(PARTS, dtype=np.uint64))
    return np.where(n[start_of].any(axis=1), keys, np.uint64(0)), int(np.packbits(ring >> np.uint64(63) > 0, bitorder="little").view(np.uint32)[0])


def chains(level: int, similarity: float) -> tuple[int, np.ndarray]:
    """Parts in which the rings of a level may differ, and the parts of each start's longest chain that must not.

    Of a share of the hashes the bound holds on average only: it gives the chains, and all other parts may differ.
    """
    budget = min(differing(min(1 << level, RING_TOP), similarity), PARTS - 1)
    start_of = (np.arange(PARTS)[:, None] + np.arange((PARTS - 1) // max(budget, 1))) % PARTS
    return PARTS if 1 << level > RING_TOP else budget, start_of


def rings(hashes: np.ndarray, similarity: float) -> list[tuple[int, np.ndarray, int]]:
    """(budget, keys, bits) of the set's ring at its level and, where it may be alike to a set above, at the next levels."""
    level, top, out = max(len(hashes) - 1, 0).bit_length(), math.floor(len(hashes) / similarity + 1e-9), []
    while len(hashes) and (not out or 1 << (level - 1) < top):
        budget, start_of = chains(level, similarity)
        out.append((budget, *parted(hashes, level, start_of)) if budget else (0, np.zeros(PARTS, np.uint64), 0))
        level += 1
    return out


def _described(width: int, similarity: float):
    def run(batches):
        held()  # what an encoder left in this worker
        for b in batches:
            node, fp, n, found, at = [], [], [], [], [0]
            for text in b.column("text").to_pylist():
                s = shingle_set(text, width)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED)), fp.append(set_fingerprint(s)), n.append(len(s))
                found += rings(s, similarity)
                at.append(len(found))
            own = lambda values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
            keys = np.concatenate([np.zeros(0, np.uint64), *(k for _, k, _ in found)]).view(np.int64)
            keys = pa.ListArray.from_arrays(pa.array(np.array(at) * PARTS, pa.int32()), pa.array(keys))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            columns = [b.column("doc_id"), b.column("row"), *longs, pa.array(n, pa.int64()), keys, own([r for *_, r in found], pa.int64()), own([h for h, *_ in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "node", "fp", "n", "keys", "rings", "budgets"])

    return run


def _shingled(width: int):
    def run(batches):
        held()  # what an encoder left in this worker
        for b in batches:
            sets = [shingle_set(text, width).tobytes() for text in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array(sets, pa.binary())], ["node", "n", "hashes"])

    return run


def _alike(similarity: float):
    def run(batches):
        held()  # what an encoder left in this worker
        for b in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in b.column(c).to_pylist()] for c in ("hu", "hv")]
            both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
            ok = [k >= similarity * (len(x) + len(y) - k) - 1e-9 for k, x, y in zip(both, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    return run


def _spread(batches):
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("hashes").to_pylist()]
        node = np.repeat(b.column("node").to_numpy(), [*map(len, sets)])
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["node", "hash"])


def in_common(sets: DataFrame, similarity: float) -> DataFrame:
    """``sets(node, n, hashes)`` -> (node, common): how many of a set's shingles any other of the sets has too.

    A set of which less than ``similarity`` is in common is similar to none of the others. It goes, and those that stay
    are counted among themselves, COUNTS times in all. What a set has in common with one other is never more. A shingle of
    a set is a row once, whatever other sets hold it.
    """
    stay = sets.select("node", "n")
    for round_ in range(COUNTS):
        left = sets.join(stay, "node", "left_semi") if round_ else sets
        held_by = left.select("node", "hashes").mapInArrow(_spread, "node long, hash long")
        alone = held_by.groupBy("hash").agg(F.count("*").alias("sets"), F.min("node").alias("node")).where("sets = 1")
        counted = stay.select("node", "n").join(alone.groupBy("node").agg(F.count("*").alias("alone")), "node", "left")
        stay = cut(counted.withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).where(F.col("common") >= similarity * F.col("n") - 1e-9).select("node", "n", "common"))
    return stay.select("node", "common")


def similar_nodes(docs: DataFrame, similarity: float, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> (doc_id, row, node) of each row, and ``(u, v)``: links whose components are those of
    all pairs of nodes with a Jaccard index of ``similarity`` or more.

    A node is a set of shingles. Their hashes' space is a ring of PARTS parts, and the SimHash of a part's shingles is
    the ring's segment. Two sets so similar differ in a bounded number of shingles, so in no more segments, and by the
    pigeonring principle from some start each chain of l segments differs in no more than l / PARTS of the bound.
    Chains whose bound is below one are exact, and give the key; the longer ones are tested behind it on a bit a
    segment. Sets of like size (powers of two) have rings alike, and a set stands in the next level too where it may be
    similar to a set there. Above RING_TOP shingles the ring covers a share of the hashes, the same for all sets of the
    level; the bound then holds on average, so longer chains are not tested, and two sets at 0.8 share some 13 of 32 keys.
    Candidates share a key, fit in size, and differ in at most ``bits`` bits of the whole SimHash (at 0.8 some 10 of 64
    differ on average, 3 more or less, so 28 is six deviations away); each is then compared exactly.

    Of the sets that share a key, those that have too few shingles in common with any other of them (``in_common``) to be
    similar go first, so that texts with a passage in common, however many, are not paired for it.

    To keep a large group of copies from being paired in full, members of a key that over PAIRWISE hold are compared
    with up to HUBS members of the key's largest component, round by round, until few are left out of it or a round no
    longer helps; then all members of different components are paired, if both have enough in common. No group is capped.
    """
    bounded_batches(docs.sparkSession, mb=2)
    release(docs.sparkSession)  # what was computed before left shuffles as large as its input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("row"), F.col("text").cast("binary").alias("text"))
    described = stored(texts.mapInArrow(_described(shingle, similarity), "doc_id long, row long, node long, fp long, n long, keys array<long>, rings array<long>, budgets array<int>"))
    prints = described.select("doc_id", "row", "node")
    once = ("fp", "n", "rings", "budgets", "keys")
    nodes = stored(described.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("who"), *[F.first(c).alias(c) for c in once]))
    keyed = nodes.select("node", F.posexplode("keys").alias("pos", "key")).where("key <> 0")
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    level = F.floor(F.col("pos") / PARTS).cast("int")
    facts = (F.pmod("pos", F.lit(PARTS)).alias("start"), F.get("rings", level).alias("ring"), F.get("budgets", level).alias("budget"))
    sharing = stored(keyed.join(shared.select("key"), "key").join(nodes.drop("keys", "who"), "node").select("key", "node", "fp", "n", *facts))
    asked = cut(sharing.select("node", "n").distinct().join(nodes.select("node", "who.*"), "node"))
    found = texts.join(F.broadcast(asked) if asked.count() <= BROADCAST else asked, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("node", "n", "text")
    sets = stored(found.mapInArrow(_shingled(shingle), "node long, n long, hashes binary"))
    common = in_common(sets, similarity)
    sets = sets.drop("n")
    rows = stored(sharing.join(common, "node"))
    release(docs.sparkSession)

    def close(a: str, b: str, bits: int = bits, lengths: tuple[int, ...] = (4, 8, 16, 32)) -> Column:
        x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
        ok = (F.col(f"{a}.node") != F.col(f"{b}.node")) & (F.least(x, y) >= F.greatest(x, y) * F.lit(similarity) - 1e-9)
        differ = F.col(f"{a}.ring").bitwiseXOR(F.col(f"{b}.ring"))
        for n in lengths:
            masks = F.array(*[F.lit(mask((i + k) % PARTS for k in range(n))).cast("long") for i in range(PARTS)])
            ok = ok & (F.bit_count(differ.bitwiseAND(F.get(masks, F.col(f"{a}.start")))) * PARTS <= n * F.col(f"{a}.budget"))
        enough = F.least(f"{a}.common", f"{b}.common") * (1 + similarity) >= (x + y) * similarity - 1e-6
        return ok & enough & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= bits)

    def ends() -> list[Column]:
        return [F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")]

    def linked(pairs: DataFrame) -> DataFrame:
        of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"h{end}"))
        return cut(pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "hu", "hv").mapInArrow(_alike(similarity), "u long, v long"))

    enough, tested, found, named, last = WORK * rows.count(), None, None, None, None
    for round_ in count():
        label = F.col("node") if named is None else F.coalesce("label", "node")
        labelled = stored((rows if named is None else rows.join(named, "node", "left")).withColumn("label", label))
        held = labelled.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"), F.count("*").alias("labels"))
        mixed = stored(labelled.join(held.where("labels > 1").select("key", "all", F.col("top.label").alias("top"), F.col("top.c").alias("of_top")), "key"))
        many = mixed.where(F.col("all") > PAIRWISE)
        work = many.where("label <> top").agg(F.sum("all")).first()[0] or 0
        if work <= enough or (round_ and work > 0.7 * last):
            break
        last = work
        part = F.pmod(F.xxhash64(F.lit(round_), "node"), F.lit(HUBS))
        # at first no component is there, and any member may be a hub
        hubs = (many.where("label = top") if round_ else many).groupBy("key", part).agg(F.min(F.struct("node", "fp", "n", "ring", "start", "budget", "common")).alias("hub")).select("key", "hub.*")
        near = (many.where("label <> top") if round_ else many).alias("a").join(hubs.alias("b"), (F.col("a.key") == F.col("b.key")) & close("a", "b", bits // 2)).select(*ends()).distinct()
        near = cut(near if tested is None else near.join(tested, ["u", "v"], "left_anti"))
        tested = near if tested is None else tested.unionByName(near)
        found = linked(near) if found is None else cut(found.unionByName(linked(near)))
        named = components(found)

    def crossed(members: DataFrame, near: Column) -> DataFrame:
        across = (F.col("a.key") == F.col("b.key")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.top")) | (F.col("a.node") < F.col("b.node")))
        return members.where("label <> top").alias("a").join(members.alias("b"), across & near).select(*ends())

    few = mixed.where(F.col("all") <= PAIRWISE).select("key", "node", "fp", "n", "start", "ring", "budget", "common", "label", "top")
    many = mixed.where(F.col("all") > PAIRWISE).select(*few.columns)
    shared_keys = many.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    many = stored(many.join(shared_keys, "node"))
    # of a crowded key's pairs only those whose first crowded key it is: without the chains of a start, as those of another may hold
    first = let(F.array_intersect("a.keys", "b.keys"), lambda both: both[0] == F.col("a.key"))
    pairs = crossed(few, close("a", "b")).unionByName(crossed(many, close("a", "b", lengths=()) & first)).distinct()
    rest = linked(cut(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")))
    found = rest if found is None else found.unionByName(rest)
    return prints, found


def one_of_each(docs: DataFrame, similarity: float | None = None, shingle: int = 5, bits: int = 28) -> DataFrame:
    """The documents that stand for their group of near copies, columns as they came; repeated rows of one are copies.

    Without ``similarity`` near copies are op3's: fingerprints that differ in at most two bits. With it they are texts
    whose sets of ``shingle``-word shingles have that Jaccard index or more; ``bits`` is the budget of the SimHash that
    spares comparisons, wide enough for 0.8. Of a group the smallest doc_id stays, and of its rows the one of the
    smallest text hash. Null and empty texts have no shingle and are copies of each other. Rows without doc_id link
    nothing and stay. An empty table gives an empty one.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    if similarity is None:
        prints = cut(fingerprints(named).select("doc_id", "row", F.col("fp").alias("node")))
        found = components(links(prints.select(F.col("node").alias("fp")).distinct()))
    else:
        prints, edges = similar_nodes(named, similarity, shingle, bits)
        found = components(edges)
    firsts = prints.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("who")).join(found, "node", "left")
    kept = firsts.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("who").alias("who")).select("who.doc_id", "who.row")
    rows = carried(docs, doc_id=F.col("doc_id").cast("long"), row=text_hash())
    stay = rows.join(kept, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return stay.unionByName(rows.where("doc_id is null")).select(*own_columns(docs))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
