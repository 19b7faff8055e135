"""Interval merge, budgets and packages (SP1-SP17): window algebra where it suffices, ordered folds where it does not."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .rank import best, ranked


def merge_intervals(hits: DataFrame, keys: list[str]) -> DataFrame:
    """SP1, SP2: hits (keys, start_turn, end_turn, rank, score) -> spans; overlapping and touching ones merge."""
    by = Window.partitionBy(*keys).orderBy("start_turn", "end_turn")
    reach = F.max("end_turn").over(by.rowsBetween(Window.unboundedPreceding, -1))
    flagged = hits.withColumn("new", F.when(F.col("start_turn") <= reach + 1, 0).otherwise(1))
    island = flagged.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "island").agg(F.min("start_turn").alias("start_turn"), F.max("end_turn").alias("end_turn"), F.min("rank").alias("best_rank"), F.max("score").alias("best_score"), F.count("*").alias("n_hits")).drop("island")


def span_cost(spans: DataFrame, turns: DataFrame, max_turn_chars: int = 4000) -> DataFrame:
    """SP2: the characters a span's turns cost, long turns cut; an equi-join on the session bounds the range."""
    cost = text.turn_cost(F.when(F.length("content") > max_turn_chars, F.concat(F.substring("content", 1, max_turn_chars), F.lit("…"))).otherwise(F.col("content")), F.col("role"))
    t = turns.select("session_id", "turn_index", cost.alias("c"))
    inside = F.col("turn_index").between(F.col("start_turn"), F.col("end_turn"))
    return spans.join(t, "session_id").where(inside).groupBy(*spans.columns).agg(F.sum("c").alias("chars"))


def greedy_budget(spans: DataFrame, budget: int, key: str = "question_id", order: tuple[str, ...] = ("best_rank", "session_id", "start_turn"), cost: str = "chars") -> DataFrame:
    """SP3, SP14: in order, the first always, then whatever still fits; what does not is skipped, not an end.

    One array fold a key, in the JVM; the pool of a question is bounded by the top-k before it.
    """
    others = [c for c in spans.columns if c != key]
    entry = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"c_{c}") for c in others])
    pools = spans.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("pool"))
    kind = dict(pools.dtypes)["pool"]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        price = x[f"c_{cost}"].cast("long")
        fits = (F.size(a.kept) == 0) | (a.used + price <= budget)
        return F.struct(F.when(fits, a.used + price).otherwise(a.used).alias("used"), F.when(fits, F.concat(a.kept, F.array(x))).otherwise(a.kept).alias("kept"))

    kept = pools.select(key, F.explode(F.aggregate("pool", start, step, lambda a: a.kept)).alias("x"))
    return kept.select(key, *[F.col(f"x.c_{c}").alias(c) for c in others])


def series_siblings(selected: DataFrame, sessions: DataFrame, most: int) -> DataFrame:
    """SP4: unselected sessions (session_id, name) whose name shares a series prefix with a selected one's, first by order."""
    prefix = text.series_prefix(F.col("name"))
    wanted = selected.join(sessions, "session_id").select("question_id", prefix.alias("series")).distinct()
    pool = sessions.select("session_id", "name", prefix.alias("series")).where(F.col("name") != prefix)
    new = pool.join(wanted, "series").join(selected.select("question_id", "session_id"), ["question_id", "session_id"], "left_anti")
    return ranked(new, ["question_id"], [F.asc("session_id")], most)


def expand_requested(requested: DataFrame, sessions: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """SP5: the first ``most`` requested sessions that exist, and the unknown ones as warnings."""
    known = ranked(requested.join(sessions.select("session_id"), "session_id", "left_semi"), ["question_id"], [F.asc("position")], most)
    return known, requested.join(sessions.select("session_id"), "session_id", "left_anti")


def floor_refs(spans: DataFrame, turns: DataFrame, n: int) -> DataFrame:
    """SP6: turns of ranked spans, user turns first, then by span rank and score; ``n`` a question."""
    t = turns.select("session_id", "turn_index", "role")
    refs = spans.join(t, "session_id").where(F.col("turn_index").between(F.col("start_turn"), F.col("end_turn")))
    once = ranked(refs, ["question_id", "session_id", "turn_index"], [F.asc("best_rank")], 1, "copy").drop("copy")
    return ranked(once, ["question_id"], [(F.col("role") != "user").asc(), F.asc("best_rank"), best("best_score"), F.asc("session_id"), F.asc("turn_index")], n)


def adjacent(refs: DataFrame, turns: DataFrame, reach: int = 1) -> DataFrame:
    """SP17: refs and the turns up to ``reach`` away in the same session, once each."""
    near = refs.select("question_id", "session_id", F.explode(F.sequence(F.col("turn_index") - reach, F.col("turn_index") + reach)).alias("turn_index")).distinct()
    return near.join(turns.select("session_id", "turn_index"), ["session_id", "turn_index"], "left_semi")


PACKAGE = "question_id long, place long, phase int, session_id long, turn_index long, chars long"


def context_package(refs: DataFrame, max_turns: int, max_chars: int) -> DataFrame:
    """SP7-SP9: refs (question_id, phase, position, session_id, turn_index, chars) -> the package, in order.

    Phases run one after another; each ends at the first ref that would pass a cap, later phases still run. A ref taken
    before is free, and the first one is exempt from the character cap. One small group a question.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used, seen, ended, out = 0, set(), set(), []
        for r in rows.sort_values(["phase", "position", "session_id", "turn_index"]).itertuples():
            at = (r.session_id, r.turn_index)
            if at in seen or r.phase in ended:
                continue
            if len(out) >= max_turns or (out and used + r.chars > max_chars):
                ended.add(r.phase)
                continue
            seen.add(at)
            used += r.chars
            out.append((r.question_id, len(out) + 1, r.phase, *at, r.chars))
        return pd.DataFrame(out, columns=["question_id", "place", "phase", "session_id", "turn_index", "chars"])

    return refs.groupBy("question_id").applyInPandas(fold, PACKAGE)


def balanced_package(refs: DataFrame, max_turns: int = 40, max_chars: int = 40_000, prefix: int = 4000) -> DataFrame:
    """SP10: coverage (a turn a session, in bag order), then adjacency, then breadth round robin.

    ``refs`` has round (0, 1, 2), session_order, k. An overflow ends the coverage round, a session's adjacency, and
    nothing but itself in the breadth round; at most ``prefix`` characters of a turn count.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        used, seen, shut, out = 0, set(), set(), []
        rows = rows.assign(a=rows["k"].where(rows["round"] == 2, rows["session_order"]), b=rows["session_order"].where(rows["round"] == 2, rows["k"]))
        for r in rows.sort_values(["round", "a", "b", "turn_index"]).itertuples():
            at, price = (r.session_id, r.turn_index), min(r.chars, prefix)
            gate = ("all",) if r.round == 0 else (r.round, r.session_id)
            if at in seen or gate in shut:
                continue
            if len(out) >= max_turns or (out and used + price > max_chars):
                if r.round < 2:
                    shut.add(gate)
                continue
            seen.add(at)
            used += price
            out.append((r.question_id, len(out) + 1, r.round, *at, price))
        return pd.DataFrame(out, columns=["question_id", "place", "phase", "session_id", "turn_index", "chars"])

    return refs.groupBy("question_id").applyInPandas(fold, PACKAGE)


def hydrate(bag: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SP11: the bag's sessions once, by date and id, and those that do not exist."""
    once = bag.groupBy("question_id", "session_id").agg(F.min("position").alias("position"))
    found = once.join(sessions.select("session_id", "date").distinct(), "session_id")
    return ranked(found, ["question_id"], [F.asc("date"), F.asc("session_id")]), once.join(sessions.select("session_id"), "session_id", "left_anti")


def set_cover(candidates: DataFrame, most: int = 12) -> DataFrame:
    """SP12: candidates (question_id, session_id, facets array, weight, score), greedily by new facets, weight, score.

    Inherently one after another, over the two dozen candidates of a question.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left, covered, out = rows.sort_values("session_id").to_dict("records"), set(), []
        while left and len(out) < most:
            value = lambda r: (len(set(r["facets"]) - covered) * 100 + r["weight"] * 10 + r["score"], -r["session_id"])
            r = max(left, key=value)
            left = [x for x in left if x is not r]
            out.append((r["question_id"], len(out) + 1, r["session_id"], len(set(r["facets"]) - covered)))
            covered |= set(r["facets"])
        return pd.DataFrame(out, columns=["question_id", "place", "session_id", "fresh"])

    return candidates.groupBy("question_id").applyInPandas(pick, "question_id long, place long, session_id long, fresh long")


def admit(requested: DataFrame, pool: DataFrame, most: int = 12) -> DataFrame:
    """SP13: requested sessions that the pool holds, in order; a question without any gets its pool's first."""
    wanted = requested.groupBy("question_id", "session_id").agg(F.min("position").alias("position"))
    valid = ranked(wanted.join(pool.select("question_id", "session_id"), ["question_id", "session_id"], "left_semi"), ["question_id"], [F.asc("position")], most, "place")
    rest = pool.join(valid.select("question_id").distinct(), "question_id", "left_anti")
    fallback = ranked(rest, ["question_id"], [F.asc("rank")], most, "place")
    return valid.select("question_id", "session_id", "place", F.lit(False).alias("fallback")).unionByName(fallback.select("question_id", "session_id", "place", F.lit(True).alias("fallback")))


def compiled_context(payloads: DataFrame, budget: int) -> DataFrame:
    """SP16: the full payload if it fits the budget, else the reduced one."""
    fits = F.length("full") <= budget
    return payloads.withColumn("payload", F.when(fits, F.col("full")).otherwise(F.col("reduced"))).withColumn("reduced_used", ~fits)


def compact_package(items: DataFrame, budget: int, envelope: int = 2) -> DataFrame:
    """SP14, SP15: items (question_id, priority, position, item) whole, in order, while the JSON list of them fits the bytes.

    An item costs its bytes and a comma; what does not fit is skipped. ``envelope`` is the empty list's size.
    """
    priced = items.withColumn("bytes", F.octet_length("item").cast("long") + 1)
    return greedy_budget(priced.where(F.col("bytes") + envelope <= budget), budget - envelope, order=("priority", "position"), cost="bytes")
