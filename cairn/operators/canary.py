"""SM1-SM5: small samples that keep a population's shapes: features, medoids, farthest-first rounds, repair by swaps, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import beside, scaled

FEATURES = ["session_count", "context_chars", "turn_count", "evidence_count", "evidence_mean_position", "evidence_span", "question_chars", "answer_chars"]
STRATUM = ["kind", "abstention"]
#: Swaps that a repair can make of one class of cases: at most one a quartile.
SPARE = 4


def case_features(cases: DataFrame) -> DataFrame:
    """SM1: ``cases`` as ``tables.read_cases`` gives them -> question_id, kind, abstention, the eight features, quartile.

    A position is a session's index over the last index; of an id that occurs twice the later one counts. Evidence that is not
    among the sessions, or none at all, leaves the positions null, so such a case cannot be sampled.
    """
    ids = F.col("haystack_session_ids")
    last = F.greatest(F.size(ids) - 1, F.lit(1))
    at = F.transform("answer_session_ids", lambda s: F.when(F.array_contains(ids, s), (F.size(ids) - F.array_position(F.reverse(ids), s)) / last))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = cases.withColumn("_at", F.when((F.size(at) > 0) & ~F.exists(at, lambda x: x.isNull()), at))
    mean = total("_at") / F.size("_at")
    found = {
        "session_count": F.size("haystack_sessions"), "context_chars": total(F.transform(F.flatten("haystack_sessions"), lambda t: F.length(F.coalesce(t.content, F.lit(""))).cast("double"))),
        "turn_count": F.size(F.flatten("haystack_sessions")), "evidence_count": F.size("answer_session_ids"), "evidence_mean_position": mean, "evidence_span": F.array_max("_at") - F.array_min("_at"),
        "question_chars": F.length("question"), "answer_chars": F.length("answer"),
    }
    return rows.select("question_id", F.col("question_type").alias("kind"), F.col("question_id").endswith("_abs").alias("abstention"), *[c.cast("double").alias(n) for n, c in found.items()], quartile(mean).alias("quartile"))


def quartile(mean: Column) -> Column:
    return F.when(mean.isNotNull(), F.least(F.lit(3), F.floor(mean * 4).cast("int")))


def tiebreak(seed: str, id_: str = "question_id") -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256)


def distance(a: Column, b: Column) -> Column:
    return F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 9)


def nearest(rows: DataFrame, group: list[str]) -> DataFrame:
    """SM2: of each group the row nearest its mean, ties by ``tie``."""
    mean = {f"_m{i}": F.avg(F.col("v")[i]) for i in range(len(FEATURES))}
    near = beside(rows, group, mean).withColumn("d", distance(F.col("v"), F.array(*mean)))
    return near.groupBy(*group).agg(F.min_by(F.struct("question_id", "v", "quartile", "evidence_count"), F.struct("d", "tie")).alias("r")).select(*group, F.col("r.question_id").alias("id"), F.col("r.v").alias("v"))


def spread(cases: DataFrame, quotas: dict[tuple[str, bool], int], required: list | None = None, seed: str = "canary") -> list:
    """SM3: ids of a sample of ``quotas[kind, abstention]`` cases a stratum.

    Required ids go first, then, where the quota allows, the medoid of each evidence count that has none yet, or else the
    stratum's medoid; then always the case farthest from those taken. A round is one aggregate over all cases for all strata at
    once; what the driver keeps, and each round broadcasts, is the sample, as large as the quotas are.
    """
    vector = F.array(*[F.col(f"_{c}") for c in FEATURES])
    pool = cases.where(F.array_contains(F.array(*[F.lit(f"{a}\x1f{str(b).lower()}") for a, b in quotas]), F.concat_ws("\x1f", "kind", F.col("abstention").cast("string"))))
    pool = scaled(pool.withColumns({f"_{c}": F.col(c) for c in FEATURES}), STRATUM, [f"_{c}" for c in FEATURES]).select("question_id", *STRATUM, "quartile", "evidence_count", vector.alias("v"), tiebreak(seed).alias("tie"))
    pool = pool.persist()
    try:
        sizes = {(r.kind, r.abstention): r["count"] for r in pool.groupBy(*STRATUM).count().collect()}
        short = [k for k, q in quotas.items() if q > sizes.get(k, 0)]
        if short:
            raise ValueError(f"quota exceeds the population of {sorted(short)}")
        taken: dict[tuple, dict] = {k: {} for k in quotas}
        counts: dict[tuple, set] = {k: set() for k in quotas}
        if required:
            for r in pool.where(F.col("question_id").isin(required)).orderBy("question_id").collect():
                taken[r.kind, r.abstention][r.question_id] = r.v
                counts[r.kind, r.abstention].add(r.evidence_count)
            if sum(map(len, taken.values())) < len(set(required)):
                raise ValueError("required ids are outside their strata")
        groups: dict[tuple, list] = {k: [] for k in quotas}
        for r in nearest(pool, [*STRATUM, "evidence_count"]).orderBy("evidence_count").collect():
            groups[r.kind, r.abstention].append(r)
        for k, rows in groups.items():
            for r in rows if quotas[k] >= len(rows) else []:
                if r.evidence_count not in counts[k] and len(taken[k]) < quotas[k]:
                    taken[k][r.id] = r.v
        for r in nearest(pool, STRATUM).collect():
            if not taken[r.kind, r.abstention] and quotas[r.kind, r.abstention]:
                taken[r.kind, r.abstention][r.id] = r.v
        while any(len(taken[k]) < quotas[k] for k in quotas):
            open_ = [(*k, list(t), list(t.values())) for k, t in taken.items() if len(t) < quotas[k]]
            held = pool.sparkSession.createDataFrame(open_, f"kind string, abstention boolean, ids array<{dict(pool.dtypes)['question_id']}>, vs array<array<double>>")
            far = pool.join(F.broadcast(held), STRATUM).where(~F.array_contains("ids", F.col("question_id"))).withColumn("far", F.array_min(F.transform("vs", lambda v: distance(F.col("v"), v))))
            for r in far.groupBy(*STRATUM).agg(F.min_by(F.struct("question_id", "v"), F.struct(-F.col("far"), "tie")).alias("r")).collect():
                taken[r.kind, r.abstention][r.r.question_id] = r.r.v
        return sorted(i for t in taken.values() for i in t)
    finally:
        pool.unpersist()


def repaired(cases: DataFrame, sample: list, seed: str = "canary") -> list:
    """SM4: swap cases of the sample, as few as it takes, until each kind has all position quartiles that its population has.

    For the least quartile that is missing the first candidate by ``tiebreak``, and for it the first case of the sample of the same
    kind and abstention, whose swap keeps all evidence counts of the population and the other quartiles. A quartile
    that no swap covers is an error. The driver sees the sample and a few first candidates of each class (kind, abstention,
    quartile, evidence count), as only the class decides whether a swap will do.
    """
    rows = cases.select("question_id", *STRATUM, "quartile", "evidence_count", tiebreak(seed).alias("tie"))
    inside = {r.question_id: r for r in rows.where(F.col("question_id").isin(sample)).collect()}
    kinds = {r.kind for r in inside.values()}
    needed = {r.kind: r for r in rows.where(F.col("kind").isin(sorted(kinds))).groupBy("kind").agg(F.collect_set("quartile").alias("quartiles"), F.collect_set("evidence_count").alias("counts")).collect()}
    by = Window.partitionBy(*STRATUM, "quartile", "evidence_count").orderBy("tie")
    others = rows.where(~F.col("question_id").isin(sample)).withColumn("n", F.row_number().over(by)).where(F.col("n") <= SPARE).drop("n").collect()
    spare = {r.question_id: r for r in others}
    for kind in sorted(needed):
        quartiles, counts = set(needed[kind].quartiles), set(needed[kind].counts)
        while missing := quartiles - {r.quartile for r in inside.values() if r.kind == kind}:
            least, swap = min(missing), None
            mine = sorted((r for r in inside.values() if r.kind == kind), key=lambda r: r.tie)
            for new in sorted((r for r in spare.values() if r.kind == kind and r.quartile == least), key=lambda r: r.tie):
                for old in (r for r in mine if r.abstention == new.abstention):
                    proposed = [r for r in mine if r is not old] + [new]
                    if {r.evidence_count for r in proposed} == counts and quartiles - {least} <= {r.quartile for r in proposed}:
                        swap = (old, new)
                        break
                if swap:
                    break
            if not swap:
                raise ValueError(f"no swap covers position quartile {least} of {kind}")
            old, new = swap
            del inside[old.question_id], spare[new.question_id]
            inside[new.question_id], spare[old.question_id] = new, old
    return sorted(inside)


def canary(cases: DataFrame, quotas: dict[tuple[str, bool], int], required: list | None = None, seed: str = "canary") -> DataFrame:
    """SM3, SM4: the sampled rows of ``cases`` (``case_features``), spread out and repaired."""
    chosen = repaired(cases, spread(cases, quotas, required, seed), seed)
    kind = dict(cases.dtypes)["question_id"]
    picked = cases.sparkSession.createDataFrame([(i,) for i in chosen], f"question_id {kind}")
    return cases.join(F.broadcast(picked), "question_id", "left_semi")  # as many rows as the quotas


def manifest(cases: DataFrame, sample: DataFrame, name: str, seed: str, subset_of: str | None = None) -> DataFrame:
    """SM5: one row of JSON on a sample: ids, counts by kind, abstentions, strata with populations, coverage sets."""
    population = cases.groupBy(*STRATUM).agg(F.count("*").alias("population_count"))
    strata = sample.groupBy(*STRATUM).agg(F.count("*").alias("sample_count")).join(population, STRATUM)
    told = strata.agg(F.array_sort(F.collect_list(F.struct(F.col("kind").alias("question_type"), "abstention", "population_count", "sample_count"))).alias("strata"))
    pairs = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    by_kind = sample.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("abstention").alias("a"), F.array_sort(F.collect_set(F.col("evidence_count").cast("int"))).alias("e"), F.array_sort(F.collect_set("quartile")).alias("q"))
    kinds = by_kind.agg(
        F.sum("a").alias("abstention_count"), pairs("kind", "n").alias("question_type_counts"), F.map_filter(pairs("kind", "a"), lambda k, v: v > 0).alias("abstention_by_type"),
        F.struct(pairs("kind", "e").alias("evidence_counts_by_type"), pairs("kind", "q").alias("evidence_position_quartiles_by_type"), F.array(*map(F.lit, FEATURES)).alias("selection_features")).alias("coverage"),
    )
    ids = sample.agg(F.array_sort(F.collect_list("question_id")).alias("question_ids"))
    row = ids.crossJoin(told).crossJoin(kinds)  # one row each
    fields = [F.lit(1).alias("schema_version"), F.lit(name).alias("name"), F.lit(seed).alias("seed"), F.lit(subset_of).alias("subset_of"), "question_ids", "question_type_counts", "abstention_count", "abstention_by_type", "strata", "coverage"]
    return row.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("manifest"))
