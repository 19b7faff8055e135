"""Samples and run assembly (SM1-SM19): seeded by hash order, so every engine draws the same."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import ranked


def seeded(seed: str, id_: str) -> Column:
    """SM6, FH3: order of ids under a seed."""
    return F.sha2(F.concat(F.lit(seed), F.chr(F.lit(0)), F.col(id_).cast("string")), 256)


def quota_sample(pool: DataFrame, strata: list[str], quota: Column | int, seed: str, id_: str, first: list[Column] = ()) -> DataFrame:
    """SM6, SM7, SM11: the first of each stratum by ``first`` and then the seeded order."""
    quota = F.lit(quota) if isinstance(quota, int) else quota
    return ranked(pool, strata, [*first, seeded(seed, id_).asc(), F.asc(id_)], None, "place").where(F.col("place") <= quota)


def difficulty(worst_rank: Column) -> Column:
    """SM8."""
    return F.when(worst_rank.isNull() | (worst_rank > 5), "hard").when(worst_rank >= 4, "mid").otherwise("easy")


def round_robin(df: DataFrame, type_: str, order: list[Column], size: int = 25) -> DataFrame:
    """SM10: batches dealt across types: the first of every type, then the second, ..."""
    turn = ranked(df, [type_], order, None, "turn")
    place = F.row_number().over(Window.orderBy("turn", type_))  # one row an item of a hand-sized selection
    return turn.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def first_per_branch(df: DataFrame, branches: dict[str, Column], id_: str) -> DataFrame:
    """SM12: the smallest id of each branch."""
    return df.agg(*[F.min(F.when(c, F.col(id_))).alias(n) for n, c in branches.items()])


def select_ids(df: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    """SM13: rows of explicit ids, in the ids' order (``position``)."""
    return df.join(ids, id_)


def same_ids(a: DataFrame, b: DataFrame, id_: str) -> DataFrame:
    """SM14: ids of one side only; none if both agree."""
    left, right = a.select(id_), b.select(id_)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def latest_wins(parts: list[DataFrame], id_: str) -> DataFrame:
    """SM15: later tables replace earlier rows of an id."""
    both = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        both = both.unionByName(p.withColumn("part", F.lit(i)))
    return ranked(both, [id_], [F.desc("part")], 1, "n").drop("n", "part")


def unresolved(errors: DataFrame, done: DataFrame, id_: str) -> DataFrame:
    """SM17, SM18: what failed and was not completed since."""
    return errors.join(done.select(id_), id_, "left_anti")


def interleaved(cases: DataFrame, arms: list[str]) -> DataFrame:
    """SM19: every case with every arm, arms rotated by the case's number."""
    n = len(arms)
    arm = F.posexplode(F.array(*map(F.lit, arms))).alias("arm_index", "arm")
    return cases.select("*", arm).withColumn("turn", F.pmod(F.col("arm_index") - F.col("case_index"), F.lit(n)).cast("long"))


def beside(df: DataFrame, keys: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates of each group beside its rows, by partial sums and a join that can split a hot group."""
    own = [f"_key_{k}" for k in keys]
    groups = df.groupBy(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)]).agg(*[c.alias(n) for n, c in aggregates.items()])
    same = F.lit(True)
    for k, o in zip(keys, own, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(o))
    return df.join(groups, same).drop(*own)


def scaled(df: DataFrame, strata: list[str], features: list[str]) -> DataFrame:
    """FM6: min-max a stratum; a constant feature is 0."""
    lo, hi = {c: f"_lo_{c}" for c in features}, {c: f"_hi_{c}" for c in features}
    rows = beside(df, strata, {lo[c]: F.min(c) for c in features} | {hi[c]: F.max(c) for c in features})
    part = lambda c: (F.col(c) - F.col(lo[c])) / (F.col(hi[c]) - F.col(lo[c]))
    return rows.withColumns({c: F.when(F.col(hi[c]) > F.col(lo[c]), part(c)).otherwise(0.0) for c in features}).drop(*lo.values(), *hi.values())


def medoids(df: DataFrame, strata: list[str], features: list[str], id_: str, seed: str) -> DataFrame:
    """SM2: the row nearest its stratum's centroid, ties by seeded order."""
    mean = {c: f"_mean_{c}" for c in features}
    parts = sum(((F.col(c) - F.col(m)) ** 2 for c, m in mean.items()), F.lit(0.0))
    rows = beside(df, strata, {m: F.avg(c) for c, m in mean.items()}).withColumn("distance", F.round(F.sqrt(parts), 9)).drop(*mean.values())
    return ranked(rows, strata, [F.asc("distance"), seeded(seed, id_).asc()], 1, "n").drop("n")


def slices(asked: DataFrame, told: DataFrame, good_rank: int = 5, few: int = 12, beside_hard: int = 17, lost: int = 999) -> DataFrame:
    """SM9: ``asked(question_id, position, abstains)`` and ``told(question_id, worst)`` -> (slice, part, question_id, worst, position).

    ``told`` has the questions that were ranked and have an answer; ``worst`` is the rank of their last answer, null if one was
    not found, which counts as ``lost``. Slices: ``all``, ``answerable`` (those that do not abstain), ``hard`` (worst rank above
    ``good_rank``), ``hard12`` (the first ``few`` of them) and ``hard50`` (all hard ones, then, as part 1, the first ``beside_hard``
    others). A slice is in order by part, then in a hard part the worst rank from the highest, then position; no window numbers it.
    """
    known = asked.where(~F.col("abstains")).join(told, "question_id").withColumn("worst", F.coalesce(F.col("worst"), F.lit(lost)).cast("int"))
    hard, good = known.where(F.col("worst") > good_rank), known.where(F.col("worst") <= good_rank)
    named = lambda rows, name, part=0: rows.select(F.lit(name).alias("slice"), F.lit(part).alias("part"), "question_id", F.col("worst").cast("int").alias("worst"), "position")
    plain = asked.withColumn("worst", F.lit(None))
    parts = [
        named(plain, "all"), named(plain.where(~F.col("abstains")), "answerable"), named(hard, "hard"),
        named(hard.orderBy(F.desc("worst"), "position").limit(few), "hard12"), named(hard, "hard50"), named(good.orderBy("position").limit(beside_hard), "hard50", 1),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def farthest_first(df: DataFrame, stratum: str, features: list[str], id_: str, quota: int) -> DataFrame:
    """SM3, SM4: from the medoid on, always the row farthest from those taken; pools of a stratum are small."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(id_, ignore_index=True)
        x = rows[features].to_numpy(float)
        taken = [int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
        near = ((x - x[taken[0]]) ** 2).sum(axis=1)
        while len(taken) < min(quota, len(rows)):
            near[taken] = -1
            taken.append(int(np.argmax(near)))
            near = np.minimum(near, ((x - x[taken[-1]]) ** 2).sum(axis=1))
        return pd.DataFrame({stratum: rows[stratum].iloc[taken], id_: rows[id_].iloc[taken], "place": range(1, len(taken) + 1)})

    kinds = dict(df.dtypes)
    return df.groupBy(stratum).applyInPandas(pick, f"{stratum} {kinds[stratum]}, {id_} {kinds[id_]}, place long")


def teacher_packs(questions: DataFrame, gold: DataFrame, notes: DataFrame) -> DataFrame:
    """SM16: a row a question: its gold sessions in order, each with its notes."""
    rows = gold.join(notes, "session_id", "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("session_id", "note"))).alias("sessions"))
    return questions.join(rows, "question_id", "left")


def occurrences(rows: DataFrame, case: str, id_: str, position: str) -> DataFrame:
    """SS5: repeats of an id within a case are occurrences of their own, numbered in order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(case, id_).orderBy(position)).cast("long"))
