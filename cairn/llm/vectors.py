"""Embedding near-dedup on robust-pruned flat graphs over overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, ship_package, skew_join
from .components import components

#: Vectors a shard aims at, and that one task takes at most; a shard that no split makes smaller is tiled.
SHARD, TASK = 1024, 4096
#: The most tasks that tiles are dealt to.
TASKS = 1000
#: Centroids of all shards that one round splits, vectors sampled for each, and parts of one shard.
CENTROIDS, SAMPLED, FANOUT = 4096, 16, 256
#: Shards that hold a vector after a split, on average of the sample, and the largest part; else fewer parts are tried.
GROWTH, LARGEST = 3.0, 0.7
#: The graph beyond the range of links: nearest candidates, edges kept, edges that lead back, random ones; the prune's factor.
NEAREST, DEGREE, BACK, FAR, ALPHA = 48, 20, 16, 4, 1.2
#: The search: nodes expanded on the way there by a vector that joins, and by one that has its own edges, and the most
#: medoids it starts from.
BEAM, OWN_BEAM, MEDOIDS = 16, 8, 64
QUERIES = 256
#: Rounding that a comparison of two similarities leaves room for.
EPS = 1e-9
#: The bound before the shards: the least directions of a sketch, and eighths of the dimensions; vectors of a chunk, rows of a
#: product, and room for rounding in single precision.
SKETCH, EIGHTHS, CHUNK, BLOCK, SLACK = 16, 3, 16384, 128, 1e-5


def unit(vectors) -> np.ndarray:
    x = np.asarray(np.stack(vectors), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(float).tiny)


def medoids(x: np.ndarray) -> np.ndarray:
    """Positions of the vectors nearest to about sqrt(n) cluster means, in order."""
    c = x[np.linspace(0, len(x) - 1, min(MEDOIDS, len(x), int(np.ceil(len(x) ** 0.5)))).astype(int)]
    for _ in range(3):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return np.unique((x @ c.T).argmax(axis=0))


def range_search(x: np.ndarray, q: np.ndarray, starts: np.ndarray, adj: list[np.ndarray], threshold: float, own=None) -> np.ndarray:
    """Similarities (queries x nodes, -2 where not met) that a greedy search from ``starts``, and from the query's ``own``
    node, meets.

    Each query expands its BEAM (with an own node OWN_BEAM) nearest known nodes one by one, then every known node within twice the range of a link
    until none is new. All queries move together; ``adj`` are arrays of edges, a row a node and -1 where empty.
    """
    m, n, who = len(q), len(x), np.arange(len(q))
    sims = np.full((m, n), -2.0)
    sims[:, starts] = q @ x[starts].T
    if own is not None:
        sims[who, own] = 1.0
    piece = max(1, (1 << 22) // x.shape[1])
    waiting = sims.copy()  # met and not expanded yet
    # chords: a node at distance r of the target is at most 2r from a query at r of it
    reach = 4 * threshold - 3 - EPS

    def meet(pair_q, pair_n):
        if 4 * len(pair_q) > m * n:  # most of them: one product is less than as many short ones
            sims[pair_q, pair_n] = waiting[pair_q, pair_n] = (q @ x.T)[pair_q, pair_n]
            return
        for i in range(0, len(pair_q), piece):
            a, b = pair_q[i : i + piece], pair_n[i : i + piece]
            sims[a, b] = waiting[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    def expand(qi, node):
        waiting[qi, node] = -2.0
        for edges in adj:
            near = edges[node]
            row, place = np.nonzero(near >= 0)  # few places of a hub's width are taken
            pair_q, pair_n = qi[row], near[row, place]
            fresh = sims[pair_q, pair_n] == -2
            code = np.unique(pair_q[fresh] * n + pair_n[fresh])
            meet(code // n, code % n)

    for _ in range(min(BEAM if own is None else OWN_BEAM, n)):
        best = waiting.argmax(axis=1)
        open_ = waiting[who, best] > -2
        if not open_.any():
            break
        expand(who[open_], best[open_])
    leads = None  # who leads where, for steps that expand many nodes at once
    while True:
        todo = waiting >= reach
        if todo.any():
            todo &= (sims == -2).any(axis=1)[:, None]
        count = int(todo.sum())
        if not count:
            return sims
        if count <= n:
            expand(*np.nonzero(todo))
            continue
        if leads is None:
            leads = np.concatenate([np.stack([row, edges[row, place]], axis=1) for edges in adj for row, place in [np.nonzero(edges >= 0)]])
            leads = leads[np.argsort(leads[:, 1], kind="stable")]
            ends, first = np.unique(leads[:, 1], return_index=True)
        waiting[todo] = -2.0
        bits = np.packbits(todo.T, axis=1)  # a row a node, a bit a query
        met = np.zeros_like(bits)
        met[ends] = np.bitwise_or.reduceat(bits[leads[:, 0]], first, axis=0)
        meet(*np.nonzero(np.unpackbits(met, axis=1, count=m).T.astype(bool) & (sims == -2)))


class Graph:
    """Flat graph over unit vectors that grows in batches, each searched in what stands before it joins.

    Within the range of links a node drops an edge only if one it keeps is nearer to that neighbour, and no number of
    edges is capped. So for each two nodes in range, known to the search, an edge or a path of ever nearer nodes leads
    from one to the other, none of them further than twice the range: expanding that far from a node meets all its links.
    Beyond the range, DEGREE robust-pruned edges, up to BACK that lead back and FAR fixed pseudo-random ones guide the way.
    """

    def __init__(self, x: np.ndarray, threshold: float):
        n = len(x)
        self.x, self.threshold, self.starts = x, threshold, medoids(x)
        self.near, self.n_near = np.full((n, 8), -1), np.zeros(n, int)
        self.far, self.n_back = np.full((n, DEGREE + BACK + FAR), -1), np.zeros(n, int)
        rng = np.random.default_rng(n)
        if n > 1:
            self.far[:, -FAR:] = rng.integers(0, n, (n, FAR))
        order = np.concatenate([self.starts, np.setdiff1d(rng.permutation(n), self.starts, assume_unique=True)])
        for s in range(0, n, QUERIES):
            self.join(order[s : s + QUERIES])

    def join(self, batch: np.ndarray) -> None:
        x = self.x
        sims = range_search(x, x[batch], self.starts, [self.near, self.far], self.threshold)
        sims[:, batch] = x[batch] @ x[batch].T
        sims[np.arange(len(batch)), batch] = -2
        linked = sims >= self.threshold
        for i, node in enumerate(batch):
            self.link(node, np.nonzero(linked[i])[0], sims[i, linked[i]])
        for node in np.setdiff1d(np.nonzero(linked.any(axis=0))[0], batch):
            self.link(node, batch[linked[:, node]], sims[linked[:, node], node])
        self.lead(batch, np.where(linked, -2.0, sims))

    def link(self, node: int, new: np.ndarray, sims: np.ndarray) -> None:
        """Edges from ``node`` to those of ``new`` that no edge kept is nearer to."""
        if not len(new):
            return
        order, have = np.argsort(-sims, kind="stable"), self.near[node, : self.n_near[node]]
        new, sims, kept = new[order], sims[order], []
        alive = ~np.isin(new, have)
        if len(have):
            alive &= ~(self.x[new] @ self.x[have].T > sims[:, None] + EPS).any(axis=1)
        while alive.any():
            i = int(alive.argmax())
            kept.append(new[i])
            alive[i] = False
            alive &= self.x[new] @ self.x[new[i]] <= sims + EPS
        end = len(have) + len(kept)
        if end > self.near.shape[1]:
            self.near = np.pad(self.near, ((0, 0), (0, max(end, 2 * self.near.shape[1]) - self.near.shape[1])), constant_values=-1)
        self.near[node, len(have) : end] = kept
        self.n_near[node] = end

    def lead(self, batch: np.ndarray, sims: np.ndarray) -> None:
        """Robust-pruned edges beyond the range, and edges back: the nearest candidate goes in, those ALPHA times nearer to it go."""
        c, rows = min(NEAREST, sims.shape[1]), np.arange(len(batch))
        cand = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        cand = np.take_along_axis(cand, np.argsort(-sims[rows[:, None], cand], axis=1, kind="stable"), axis=1)
        own = sims[rows[:, None], cand]
        alive, from_node, at = own > -2, np.sqrt(np.maximum(0, 2 - 2 * own)), self.x[cand]
        for slot in range(min(DEGREE, c)):
            some = np.nonzero(alive.any(axis=1))[0]
            if not len(some):
                break
            first = alive[some].argmax(axis=1)
            self.far[batch[some], slot] = cand[some, first]
            alive[some, first] = False
            between = np.einsum("ijk,ik->ij", at[some], at[some, first])
            alive[some] &= ALPHA * np.sqrt(np.maximum(0, 2 - 2 * between)) > from_node[some]
        to, back = self.far[batch, :DEGREE].ravel(), np.repeat(batch, DEGREE)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        nodes, first, n = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, n)
        self.far[to, DEGREE + (self.n_back[to] + place) % BACK] = back
        self.n_back[nodes] += n

    def edges(self) -> np.ndarray:
        return np.concatenate([self.near, self.far], axis=1)


def links_of(x: np.ndarray, adj: np.ndarray, threshold: float, queries: np.ndarray | None = None) -> np.ndarray:
    """Boolean n x n: links that searches for each of ``queries`` (default: all), from the medoids and from itself, find."""
    n, starts = len(x), medoids(x)
    queries = np.arange(n) if queries is None else queries
    found = np.zeros((n, n), bool)
    for s in range(0, len(queries), QUERIES):
        own = queries[s : s + QUERIES]
        found[own] = range_search(x, x[own], starts, [adj], threshold, own) >= threshold
    np.fill_diagonal(found, False)
    return found | found.T


def local_components(links: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def homes_of(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """Boolean vectors x centroids: the nearest centroid, and each whose border with that one is within ``margin``.

    Of two vectors at most 2 * margin apart, one lies within ``margin`` of the border between their nearest centroids,
    so it is in the other's part too, and the two meet.
    """
    sims = x @ c.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
    return sims[np.arange(len(x)), home][:, None] - sims <= margin * apart + EPS


def centroids_of(x: np.ndarray, parts: int, margin: float) -> np.ndarray | None:
    """Means of at most ``parts`` clusters of half the sample; fewer if the other half says that borders are too crowded."""
    while parts > 1:
        fit, held = x[::2], x[1::2]
        c = fit[np.linspace(0, len(fit) - 1, min(parts, len(fit))).astype(int)]
        for _ in range(8):
            near = (fit @ c.T).argmax(axis=1)
            c = np.stack([fit[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        if len(held):
            inside = homes_of(held, c, margin)
            if inside.sum(axis=1).mean() <= GROWTH and inside.mean(axis=0).max() <= LARGEST:
                return c
        parts //= 4 if parts >= 8 else 2
    return None


def start_of() -> Column:
    """What vectors must share to link: label and length."""
    return F.concat_ws("x", F.col("label").cast("string"), F.size("vector").cast("string"))


def tiles(rows: DataFrame, group: str) -> DataFrame:
    """``rows(rep, chunks, group, ...)`` in as many chunks of their group as ``chunks`` says (null: one), by hash, with ``chunk``
    and a row for each ``tile``: a pair of different chunks, or the one that there is. The pairs inside a chunk count in one of
    its tiles, where its rows are ``within``."""
    last = F.coalesce("chunks", F.lit(1)) - 1
    marked = rows.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64(F.lit("chunk"), "rep"), F.col("chunks")).cast("int"), F.lit(0)))
    other = F.explode(F.filter(F.sequence(F.lit(0), last), lambda c: (c != F.col("chunk")) | (last == 0)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    within = (last == 0) | (high == low + 1) & (low == F.least(F.col("chunk"), last - 1))
    tiled = marked.withColumn("other", other).withColumn("tile", F.concat_ws("-", group, low.cast("string"), high.cast("string"))).withColumn("within", within)
    return tiled.drop("chunks", "other")


def split_shards(members: DataFrame, sizes: list, seed: int, margin: float) -> DataFrame:
    """Members of the shards in ``sizes`` [(shard, n)] go to the centroids of their shard that ``homes_of`` names."""
    parts = {s: min(FANOUT, -(-n // SHARD)) for s, n in sizes}
    rate = members.sparkSession.createDataFrame([(s, min(1.0, SAMPLED * parts[s] / n)) for s, n in sizes], "shard string, rate double")
    spread = F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = members.join(F.broadcast(rate), "shard").where(spread <= F.col("rate")).select("shard", "rep", "vector").orderBy("shard", "rep").toPandas()
    centroids = {shard: centroids_of(unit(rows["vector"].tolist()), parts[shard], margin) for shard, rows in sample.groupby("shard")}
    shared = members.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for b in batches:
            out = []
            for shard, rows in b.groupby("shard"):
                c = shared.value.get(shard)
                if c is None:
                    out.append(rows)
                    continue
                x = unit(rows["vector"].tolist())
                row, part = np.nonzero(homes_of(x, c, margin))
                out.append(rows.iloc[row].assign(shard=[f"{shard}/{k}" for k in part], home=(x @ c.T).argmax(axis=1)[row] == part))
            if out:
                yield pd.concat(out)

    return members.mapInPandas(assign, members.schema)


def shards(classes: DataFrame, threshold: float) -> DataFrame:
    """``classes(rep, label, vector, copies)`` -> the same with ``shard``, several rows a vector, ``home``, ``tile`` and ``within``.

    Shards start as one a label and length, and are split around centroids of a bounded sample, the largest first and
    as many a round as CENTROIDS allows, for as many rounds as it takes until none holds more than TASK vectors or
    splitting no longer makes it smaller. Parts overlap by half the length of a link, so the two ends of a link always
    share a shard, one of them as the part of its nearest centroid: its ``home``. A shard that stays larger (a dense ball) is cut into chunks by hash, and each
    pair of different chunks is a tile of its own, so no task takes more than TASK vectors and no pair is lost. The pairs
    inside a chunk count in one of its tiles, where its rows are ``within``.
    """
    margin = float(np.sqrt(2 - 2 * threshold)) / 2
    members, round_ = cut(classes.withColumn("shard", start_of()).withColumn("of", F.lit(None).cast("long")).withColumn("home", F.lit(True))), 0
    while True:
        sizes = members.groupBy("shard").agg(F.count("*").alias("n"), F.max("of").alias("of"))
        smaller = F.col("of").isNull() & (F.col("n") > 2 * SHARD) | (F.col("n") > TASK) & (F.col("n") <= 0.9 * F.col("of"))
        todo, left = [], CENTROIDS
        for r in sizes.where(smaller).orderBy(F.desc("n"), "shard").limit(CENTROIDS // 2).collect():
            if left > 0:
                todo.append((r.shard, r.n))
                left -= min(FANOUT, -(-r.n // SHARD))
        if not todo:
            break
        picked = F.broadcast(members.sparkSession.createDataFrame(todo, "shard string, n long"))
        split = split_shards(members.join(picked, "shard").withColumn("of", F.col("n")).select(*members.columns), todo, round_, margin)
        members, round_ = cut(split.unionByName(members.join(picked, "shard", "left_anti"))), round_ + 1
    members = members.drop("of")
    sizes = members.groupBy("shard").agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > TASK).withColumn("chunks", F.ceil(F.col("n") / (TASK // 2)).cast("int")))
    # fewer than rows / TASK shards are large; those beyond a broadcast's size join by a shuffle
    return tiles(members.join(large.select("shard", "chunks"), "shard", "left"), "shard")


def sketches(x: np.ndarray) -> np.ndarray:
    """Unit vectors along some fixed orthonormal directions, and the length of what these leave, in single precision.

    The product of two sketches is at least that of their vectors: what is left adds the product of its lengths at most.
    """
    d = x.shape[1]
    axes = np.linalg.qr(np.random.default_rng(d).normal(size=(d, min(d, max(SKETCH, EIGHTHS * d // 8)))))[0]
    y = x @ axes
    return np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))]).astype(np.float32)


def in_bound(s: np.ndarray, chunk: np.ndarray, within: np.ndarray, threshold: float) -> np.ndarray:
    """Which sketches of a tile have another one in range: one of the other chunk, or of their own where ``within``."""
    found = np.zeros(len(s), bool)
    for part in np.unique(chunk):
        own = np.nonzero(chunk == part)[0]
        inside = bool(within[own[0]])
        other = np.nonzero((chunk > part) | (chunk == part) & inside)[0]
        for i in range(0, len(own) if len(other) else 0, BLOCK):
            rows = own[i : i + BLOCK]
            near = s[rows] @ s[other].T >= threshold - SLACK
            if inside:
                near[np.arange(len(rows)), np.searchsorted(other, rows)] = False
            found[rows] |= near.any(axis=1)
            found[other] |= near.any(axis=0)
    return found


def linkable(classes: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``classes(rep, label, vector, ...)`` that could link with another of their label and length.

    A sketch bounds similarities from above, so a vector whose sketch no other comes near enough to has no link and needs no
    place in a shard or graph. Sketches meet in tiles of two chunks: all pairs of a label, but short ones, and no pair is taken
    for a link here; that is left to the graphs.
    """

    def sketch(batches):
        for b in batches:
            for _, rows in b.groupby(b["vector"].map(len)):
                yield pd.DataFrame({"rep": rows["rep"].to_numpy(), "group": rows["group"].to_numpy(), "sketch": list(sketches(unit(rows["vector"].tolist())))})

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        return rows.loc[in_bound(np.stack(rows["sketch"].tolist()), rows["chunk"].to_numpy(), rows["within"].to_numpy(), threshold), ["rep"]]

    rows = classes.select("rep", start_of().alias("group"), "vector")
    sizes = cut(rows.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    drawn = rows.mapInPandas(sketch, "rep long, group string, sketch array<float>")
    found = tiles(drawn.join(sizes, "group"), "group").groupBy("tile").applyInPandas(near, "rep long")
    return cut(classes.join(found.distinct(), "rep", "left_semi"))


def _build(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        adj = Graph(unit(rows["vector"].tolist()), threshold).edges()
        reps = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": reps, "edges": [reps[np.unique(a[a >= 0])] for a in adj]})

    return run


def _search(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", ignore_index=True)
        reps, chunk, copies = rows["rep"].to_numpy(), rows["chunk"].to_numpy(), rows["copies"].to_numpy()
        width = max(map(len, rows["edges"]))
        ids = np.full((len(rows), max(width, 1)), -1)
        for i, e in enumerate(rows["edges"]):
            ids[i, : len(e)] = np.searchsorted(reps, e)  # edges to nodes of other shards do not lead on here
            at = np.minimum(ids[i, : len(e)], len(reps) - 1)
            ids[i, : len(e)] = np.where(reps[at] == e, at, -1)
        links = links_of(unit(rows["vector"].tolist()), ids, threshold, np.nonzero(rows["home"].to_numpy())[0])
        # a pair counts in the first shard that both are in and one has as home; in a tile of two chunks, across them or within
        homes = rows["homes"].tolist()
        names = {h: i for i, h in enumerate(sorted({h["shard"] for hs in homes for h in hs}))}
        member, home = np.zeros((len(rows), len(names)), np.float32), np.zeros((len(rows), len(names)), np.float32)
        for i, hs in enumerate(homes):
            member[i, [names[h["shard"]] for h in hs]] = 1
            home[i, [names[h["shard"]] for h in hs if h["home"]]] = 1
        here = names[rows["shard"].iloc[0]]
        earlier = home[:, :here] @ member[:, :here].T > 0
        counted = links & ~(earlier | earlier.T)
        counted &= (chunk[:, None] != chunk[None, :]) | rows["within"].to_numpy()[:, None]
        return pd.DataFrame({"rep": reps, "linked": counted @ copies, "low": reps[local_components(links)]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` -> vec_id, n_links, component_id, kept, a row a vec_id.

    Vectors link if their labels are equal and their cosine, in double, is at least ``threshold``. Null labels; null
    or zero vectors, and such with null or non-finite components; vectors of different lengths: no link. Exact copies
    share a class that is searched once. Rows that repeat a vec_id are one vector, the smallest (label, embedding), null labels last;
    rows without vec_id come back without links and component. Other columns are ignored.

    Only vectors that could link, by a bound on similarity, go on. Shards overlap so that the ends of a link share one. Each shard's graph grows by searches in itself, the adjacency
    lists of a vector's shards are united, and each shard is searched on the united lists, from its medoids and from each
    vector. A link is lost only if no search of the growing graph came near it; ``audit_recall`` measures that. Vectors
    of any length are read whole; an empty table gives an empty one. Counts of links and a spanning star a local component leave a task, never the pairs.
    """
    ship_package(vectors.sparkSession)
    named = vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").isNull(), "label", "embedding")).alias("v")).select("vec_id", "v.label", F.col("v.embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = cut(named.withColumn("usable", usable))
    good = rows.where("usable").select("vec_id", "label", "vector")
    classes = cut(good.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    placed = cut(shards(linkable(classes.select("rep", "label", "vector", "copies"), threshold), threshold))
    # few bytes a tile and much work, so Spark is not to put tiles together by size
    parts = max(1, min(placed.select("tile").distinct().count(), TASKS))
    homes = placed.select("rep", "shard", "home").distinct().groupBy("rep").agg(F.collect_list(F.struct("shard", "home")).alias("homes"))
    edges = placed.select("tile", "rep", "vector").repartition(parts, "tile").groupBy("tile").applyInPandas(_build(threshold), "rep long, edges array<long>")
    united = edges.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))
    ready = placed.join(united.join(homes, "rep"), "rep").select("tile", "shard", "home", "chunk", "within", "rep", "vector", "copies", "edges", "homes")
    found = cut(ready.repartition(parts, "tile").groupBy("tile").applyInPandas(_search(threshold), "rep long, linked long, low long"))
    label = components(found.select(F.col("rep").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    result = links.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "linked", F.coalesce("label", "rep").alias("component_id"))
    n_links, component = F.col("copies") - 1 + F.coalesce("linked", F.lit(0)), F.coalesce("component_id", "rep").alias("component_id")
    solved = cut(classes.join(result, "rep", "left").select("label", "vector", F.col("copies").alias("n"), n_links.alias("n_links"), component))
    linked = skew_join(good, solved, ["label", "vector"], "n", good.count()).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = vectors.where("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = 0.98, every: int = 50, block: int = 1024) -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id ``every`` divides, by brute force against all rows.

    Queries go in blocks of ``block`` to every partition of the vectors, and come back as a count each. Rows that repeat
    a vec_id are one, as in ``near_duplicates``; a vector of more links than there are counts as none found.
    """
    one = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct(F.col("label").isNull(), "label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = cut(one.where("label is not null and embedding is not null").where(sound))
    queries = rows.where(F.col("vec_id") % every == 0).orderBy(F.size("embedding"), "vec_id").toPandas()
    told = dict(result.where(F.col("vec_id") % every == 0).select("vec_id", "n_links").toPandas().itertuples(index=False))
    found = there = 0
    for part in (g.iloc[s : s + block] for _, g in queries.groupby(queries["embedding"].map(len)) for s in range(0, len(g), block)):
        q, ql, qi = unit(part["embedding"].tolist()), part["label"].to_numpy(), part["vec_id"].to_numpy()

        def count(batches, q=q, ql=ql, qi=qi):
            for b in batches:
                b = b[b["embedding"].map(len) == q.shape[1]]
                if len(b):
                    hit = (unit(b["embedding"].tolist()) @ q.T >= threshold) & (b["label"].to_numpy()[:, None] == ql) & (b["vec_id"].to_numpy()[:, None] != qi)
                    yield pd.DataFrame({"vec_id": qi, "n": hit.sum(axis=0)})

        counts = rows.mapInPandas(count, StructType().add("vec_id", "long").add("n", "long")).groupBy("vec_id").agg(F.sum("n").alias("n"))
        for i, n in counts.toPandas().itertuples(index=False):
            there += n
            found += told.get(i, 0) if told.get(i, 0) <= n else 0
    return int(found), int(there)


def op1(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
