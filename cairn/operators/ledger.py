"""State over time: property graph, cells, guards on citations (GR, ST, PF9-PF17)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .rank import ranked


def close_contradictions(claims: DataFrame) -> DataFrame:
    """GR2: claims (subject, predicate, value, valid_from, seq): the next different value ends a claim."""
    by = Window.partitionBy("subject", "predicate").orderBy("valid_from", "seq")
    changed = claims.withColumn("before", F.lag("value").over(by)).where(~F.col("before").eqNullSafe(F.col("value"))).drop("before")
    rows = changed.withColumn("valid_to", F.lead("valid_from").over(by))
    return rows.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("contradicted"))


def supersede(claims: DataFrame, ended: DataFrame) -> DataFrame:
    """GR3: ``ended(claim_id, at)`` ends claims by id."""
    joined = claims.join(ended, "claim_id", "left")
    return joined.withColumn("status", F.when(F.col("at").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("valid_to", F.coalesce("at", "valid_to")).drop("at")


def latest_properties(updates: DataFrame) -> DataFrame:
    """GR4: the last value of each property."""
    return updates.groupBy("entity", "name").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def resolve_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """GR1: mentions (mention_id, kind, name) to entities (entity_id, kind, alias) of one normalised name: one, none, or several."""
    keyed = mentions.select("mention_id", "kind", text.surface_key(F.col("name")).alias("key"))
    known = entities.select("entity_id", "kind", text.surface_key(F.col("alias")).alias("key")).distinct()
    found = keyed.join(known, ["kind", "key"], "left").groupBy("mention_id").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("one"))
    return found.select("mention_id", F.when(F.col("n") == 1, F.col("one")).alias("entity_id"), F.when(F.col("n") == 1, "reused").when(F.col("n") == 0, "new").otherwise("ambiguous").alias("decision"))


def two_hop(seeds: DataFrame, relations: DataFrame, hops: int = 2) -> DataFrame:
    """GR6: seeds (seed) over undirected relations (a, b): (seed, node, hop) with the fewest hops."""
    both = relations.select("a", "b").unionByName(relations.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    reached = frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("hop"))
    for hop in range(1, hops + 1):
        frontier = frontier.join(both, frontier["node"] == both["a"]).select("seed", F.col("b").alias("node"), F.lit(hop).cast("long").alias("hop")).distinct()
        reached = reached.unionByName(frontier)
    return reached.groupBy("seed", "node").agg(F.min("hop").alias("hop"))


def projection(claims: DataFrame) -> DataFrame:
    """GR7: kind -> entity -> predicates with their current values."""
    rows = claims.where("status = 'active'").groupBy("kind", "subject").agg(F.array_sort(F.collect_list(F.struct("predicate", "value"))).alias("facts"))
    return rows.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("subject", "facts"))).alias("entities"))


def observations(updates: DataFrame) -> DataFrame:
    """ST2: updates (pointer, value, effective_at, seq): the current value is that of the latest effective time.

    A value that comes late is history at once; of one time the later update wins. Equal values in a row are one.
    """
    by = Window.partitionBy("pointer").orderBy("effective_at", "seq")
    rows = updates.withColumn("before", F.lag("value").over(by)).where(~F.col("before").eqNullSafe(F.col("value")))
    return rows.groupBy("pointer").agg(F.max_by("value", F.struct("effective_at", "seq")).alias("current"), (F.count("*") - 1).alias("history"))


CELLS = "case_id long, seq long, pointer string, accepted boolean, reason string, cell string"


def apply_updates(updates: DataFrame) -> DataFrame:
    """ST1, ST3, ST4: updates (case_id, seq, pointer, kind, mode, value) applied in order, a decision each.

    ``set`` replaces and keeps the old value as history, ``append`` adds what is not there yet, ``observe`` is a set
    that goes to the nearest existing parent cell. An update that does not fit is rejected and the rest goes on. Cases
    are sorted, not grouped: a task holds the cells of one case at a time. ``tree.decisions`` is the whole fold, with
    history by content, late observations and provenance.
    """

    def fold(batches):
        case, cells = None, {}
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.case_id != case:
                    case, cells = r.case_id, {}
                at, reason = r.pointer, ""
                if r.mode == "observe" and at not in cells:
                    parents = [at[:i] for i in range(len(at) - 1, 0, -1) if at[i] == "/"]
                    at = next((p for p in parents if p in cells), at)
                cell = cells.get(at)
                if cell and cell["type"] != r.kind:
                    reason = "type conflict"
                elif r.mode == "append" and cell and not isinstance(cell["current"], list):
                    reason = "not a list"
                elif r.mode == "append":
                    cell = cells.setdefault(at, {"type": r.kind, "current": [], "history": []})
                    if r.value not in cell["current"]:
                        cell["current"].append(r.value)
                elif cell is None:
                    cell = cells[at] = {"type": r.kind, "current": r.value, "history": []}
                elif cell["current"] != r.value:
                    cell["history"].append(cell["current"])
                    cell["current"] = r.value
                out.append((r.case_id, r.seq, at, not reason, reason, json.dumps(cells.get(at), sort_keys=True)))
            yield pd.DataFrame(out, columns=["case_id", "seq", "pointer", "accepted", "reason", "cell"])

    rows = updates.select("case_id", "seq", "pointer", "kind", "mode", "value")
    return rows.repartition("case_id").sortWithinPartitions("case_id", "seq").mapInPandas(fold, CELLS)


def leaf_pointers(documents: DataFrame) -> DataFrame:
    """FJ3, FJ4: ``documents(id, json)`` -> (id, pointer, value) of each leaf; arrays and references are leaves.

    A root that is no object has no pointer, and an empty object no leaf.
    """

    def leaves(batches):
        for b in batches:
            out = []
            for id_, doc in zip(b["id"], b["json"], strict=True):
                root = json.loads(doc) if doc else None
                todo = [("", root)] if isinstance(root, dict) and "$ref" not in root else []
                while todo:
                    at, value = todo.pop()
                    if isinstance(value, dict) and "$ref" not in value:
                        todo += [(at + "/" + k.replace("~", "~0").replace("/", "~1"), v) for k, v in value.items()]
                    else:
                        out.append((id_, at, json.dumps(value, sort_keys=True)))
            yield pd.DataFrame(out, columns=["id", "pointer", "value"])

    return documents.select("id", "json").mapInPandas(leaves, "id long, pointer string, value string")


def under_pointer(sources: DataFrame, pointers: DataFrame) -> DataFrame:
    """ST14: sources whose pointer is one of ``pointers`` or lies below it, by their ancestors: an equi-join."""
    parts = F.split("pointer", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return sources.withColumn("root", F.explode(ancestors)).join(pointers.select(F.col("pointer").alias("root")), "root")


def redundant_parents(updates: DataFrame) -> DataFrame:
    """ST15: updates whose path is a strict prefix of another one's in the batch go."""
    parts = F.split("pointer", "/")
    above = updates.select("batch", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("pointer")).distinct()
    return updates.join(above, ["batch", "pointer"], "left_anti")


def citation_kinds(citations: DataFrame, turns: DataFrame, selected: DataFrame) -> DataFrame:
    """PF9-PF12: each citation (question_id, position, session_id, turn_index) as the first of unknown_session,
    not_selected, unknown_turn, turn_not_selected, duplicate, valid; a null turn cites the session."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    chosen = selected.groupBy("question_id", "session_id").agg(F.collect_set("turn_index").alias("picked"))
    twice = F.row_number().over(Window.partitionBy("question_id", "session_id", "turn_index").orderBy("position")) > 1
    rows = citations.withColumn("twice", twice).join(sizes, "session_id", "left").join(chosen, ["question_id", "session_id"], "left")
    turn = F.col("turn_index")
    kind = (
        F.when(F.col("n").isNull(), "unknown_session").when(F.col("picked").isNull(), "not_selected").when(turn.isNotNull() & ~turn.between(0, F.col("n") - 1), "unknown_turn")
        .when(turn.isNotNull() & ~F.array_contains("picked", turn), "turn_not_selected").when(F.col("twice"), "duplicate").otherwise("valid")
    )
    return rows.select("question_id", "position", "session_id", "turn_index", kind.alias("kind"))


def date_filter(hits: DataFrame, ranges: DataFrame, least: int = 3) -> DataFrame:
    """PF6: hits (question_id, session_id, date, rank) within the question's range, if ``least`` survive; ranked again."""
    joined = hits.join(ranges, "question_id", "left").withColumn("inside", F.coalesce(F.col("date").between(F.col("lo"), F.col("hi")), F.lit(True)))
    n = F.count_if("inside").over(Window.partitionBy("question_id"))
    kept = joined.withColumn("n", n).where(F.col("inside") | (F.col("n") < least)).drop("n", "inside", "lo", "hi", "rank")
    return ranked(kept.join(hits.select("question_id", "session_id", F.col("rank").alias("old")), ["question_id", "session_id"]), ["question_id"], [F.asc("old")]).drop("old")


def relocate(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """ST11: evidence (id, session_id, turn_index, excerpt) where it says, or in the one other turn of its session that holds it."""
    joined = evidence.join(turns.select("session_id", F.col("turn_index").alias("t"), "content"), "session_id").where(F.contains(text.evidence_text(F.col("content")), text.evidence_text(F.col("excerpt"))))
    found = joined.groupBy("id").agg(F.bool_or(F.col("t") == F.col("turn_index")).alias("here"), F.count("*").alias("n"), F.min("t").alias("other"))
    out = evidence.join(found, "id", "left")
    return out.select("id", F.when(F.col("here"), F.col("turn_index")).when(F.col("n") == 1, F.col("other")).alias("turn_index"), F.when(F.col("here"), "exact").when(F.col("n") == 1, "moved").otherwise("lost").alias("how"))


def signal_coverage(signals: DataFrame, updates: DataFrame) -> DataFrame:
    """ST10: a signal (id, session_id, turn_index, sentence) is covered if an update cites its turn with all its anchors."""
    cited = updates.select("session_id", "turn_index", text.coverage_anchors(F.col("value")).alias("has"))
    joined = signals.join(cited, ["session_id", "turn_index"], "left").withColumn("covered", F.size(F.array_except(text.coverage_anchors(F.col("sentence")), F.coalesce("has", F.array().cast("array<string>")))) == 0)
    rows = joined.groupBy("id").agg(F.coalesce(F.bool_or(F.col("has").isNotNull() & F.col("covered")), F.lit(False)).alias("c"))
    return rows.select("id", F.when(F.col("c"), "graph_covered").otherwise("session_index_fallback").alias("coverage"))


def point_in_time(updates: DataFrame, batch: int) -> DataFrame:
    """ST18: observations as they stood after a batch."""
    return observations(updates.where(F.col("batch") <= batch))


def replay_differs(updates: DataFrame, recorded: DataFrame) -> DataFrame:
    """ST9, ST17: apply the log again; decisions whose cell's hash is not the recorded one."""
    again = apply_updates(updates).select("case_id", "seq", F.sha2("cell", 256).alias("again"))
    return again.join(recorded.select("case_id", "seq", "hash"), ["case_id", "seq"], "full_outer").where(~F.col("again").eqNullSafe(F.col("hash")))


def patched(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """ST5: one batch of add, replace, remove and move patches (op, pointer, to, value) over cells (pointer, value).

    A remove or move takes everything below its pointer along; patches of a batch touch different pointers.
    """
    moves = patches.where(F.col("op").isin("move", "remove")).select(F.col("pointer").alias("root"), "op", "to")
    gone = under_pointer(cells, moves.select(F.col("root").alias("pointer"))).select("pointer", "root").distinct()
    kept = cells.join(gone.select("pointer"), "pointer", "left_anti")
    moved = cells.join(gone, "pointer").join(moves.where("op = 'move'"), "root").select(F.concat("to", F.expr("substring(pointer, length(root) + 1)")).alias("pointer"), "value")
    put = patches.where(F.col("op").isin("add", "replace")).select("pointer", "value")
    return kept.join(put.select("pointer"), "pointer", "left_anti").unionByName(moved).unionByName(put)


def migration_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """ST6: leaves (pointer, value) and sources of the old graph that the new one lacks."""
    return before.select("value", "source").distinct().join(after.select("value", "source").distinct(), ["value", "source"], "left_anti")


def first_resolutions(resolutions: DataFrame, signals: DataFrame) -> DataFrame:
    """ST16: the first resolution of each known signal; unknown ones are ignored."""
    return ranked(resolutions.join(signals.select("signal_id"), "signal_id", "left_semi"), ["signal_id"], [F.asc("position")], 1, "n").drop("n")


def session_audit(cited: DataFrame, ignored: DataFrame, batch: DataFrame) -> DataFrame:
    """ST8: sessions of a batch cited and ignored at once, or neither; names outside the batch."""
    c, i, b = (df.select("session_id").distinct().withColumn(n, F.lit(True)) for df, n in ((cited, "c"), (ignored, "i"), (batch, "b")))
    rows = b.join(c, "session_id", "full_outer").join(i, "session_id", "full_outer")
    kind = F.when(F.col("b").isNull(), "outside").when(F.col("c") & F.col("i"), "cited and ignored").when(F.col("c").isNull() & F.col("i").isNull(), "missing")
    return rows.select("session_id", kind.alias("warning")).where("warning is not null")


def valid_sources(updates: DataFrame, turns: DataFrame, batch: DataFrame) -> DataFrame:
    """ST7, GR5: updates (id, session_id, turn_index) with whether they cite a turn that exists in the batch, and why not."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"))
    rows = updates.join(sizes, "session_id", "left").join(batch.select("session_id").distinct().withColumn("here", F.lit(True)), "session_id", "left")
    reason = F.when(F.col("here").isNull(), "not in batch").when(F.col("n").isNull() | ~F.col("turn_index").between(0, F.col("n") - 1), "no such turn").otherwise("")
    return rows.select("id", (reason == "").alias("accepted"), reason.alias("reason"))


def windows_covered(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``score`` for ``want`` and ``have`` (arrays of tokens): the share of ``want``, repeats counted, that the
    best window of as many tokens of ``have`` holds."""
    others = [c for c in pairs.columns if c not in ("want", "have")]

    def score(batches):
        from collections import Counter

        for b in batches:
            out = []
            for want, have in zip(b["want"], b["have"], strict=True):
                n, need = len(want), Counter(want)
                held = Counter(have[:n])
                hit = best = sum((need & held).values())
                for gone, new in zip(have, have[n:], strict=False):  # the window moves by one token
                    hit -= held[gone] <= need[gone]
                    held[gone] -= 1
                    held[new] += 1
                    hit += held[new] <= need[new]
                    best = max(best, hit)
                out.append(best / n if n else 0.0)
            yield b[others].assign(score=out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*others).schema)
    return pairs.mapInPandas(score, schema + ", score double")


def relocate_fuzzy(evidence: DataFrame, turns: DataFrame, least: float = 0.84, margin: float = 0.08) -> DataFrame:
    """ST11: evidence (id, session_id, excerpt) -> the turn of its session whose best window of as many tokens shares the
    most, repeats counted, if that is ``least`` or more and ``margin`` better than any other turn's."""
    wanted = evidence.select("id", "session_id", text.plain_terms(F.col("excerpt")).alias("want"))
    held = turns.select("session_id", "turn_index", text.plain_terms(F.col("content")).alias("have"))
    rows = windows_covered(wanted.join(held, "session_id").select("id", "turn_index", "want", "have"))
    by = Window.partitionBy("id").orderBy(F.desc("score"), "turn_index")
    two = rows.withColumn("n", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).where("n = 1")
    return two.where((F.col("score") >= least) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin)).select("id", "turn_index", "score")


def operand_updates(turns: DataFrame) -> DataFrame:
    """ST12: updates that a user turn's durations, frequencies and ranges state by themselves."""
    from ..functions import dates

    c = F.col("content")
    kinds = {"duration": dates.durations(c), "frequency": dates.frequencies(c)}
    user = turns.where("role = 'user'")
    parts = [user.select("session_id", "turn_index", F.lit(name).alias("kind"), F.explode(found).alias("o")).select("session_id", "turn_index", "kind", "o.surface", "o.value", "o.unit") for name, found in kinds.items()]
    ranges = user.select("session_id", "turn_index", F.lit("range").alias("kind"), F.explode(dates.number_ranges(c)).alias("o"))
    parts.append(ranges.select("session_id", "turn_index", "kind", F.concat_ws("-", F.col("o.lo").cast("string"), F.col("o.hi").cast("string")).alias("surface"), F.col("o.lo").alias("value"), "o.unit"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _untagged(node: dict):
    """One tagged node, its children done before it; an entry of an object becomes a pair."""
    kind = node.get("kind")
    if kind is None and set(node) == {"key", "value"} and node["key"]:
        return (node["key"], node["value"])
    if kind in ("string", "number", "boolean") and set(node) == {"kind", "value"}:
        return node["value"]
    if kind == "null":
        return None
    if kind == "array":
        return node["items"]
    if kind == "object":
        out = dict(node["entries"])
        if len(out) < len(node["entries"]):
            raise ValueError("duplicate key")
        return out
    raise ValueError(f"unknown kind {kind!r}")


def decode_tagged(documents: DataFrame) -> DataFrame:
    """FJ5, ST13: ``documents(id, json)`` in the tagged encoding -> (id, json, problem): plain JSON with sorted keys, or
    null and what is wrong (a repeated key, an unknown kind, no JSON)."""

    def decode(batches):
        for b in batches:
            out = []
            for id_, doc in zip(b["id"], b["json"], strict=True):
                try:
                    out.append((id_, json.dumps(json.loads(doc, object_hook=_untagged), sort_keys=True), None))
                except (ValueError, KeyError, TypeError) as e:
                    out.append((id_, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "json", "problem"])

    return documents.select("id", "json").mapInPandas(decode, "id long, json string, problem string")
