"""The versioned tree of a case: updates in order, history by content, late observations, provenance that moves (ST1-ST7, FJ2, FJ4)."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, fixed
from .rank import ranked

DECISIONS = "case_id string, seq long, batch_id string, accepted boolean, reason string, pointer string, op string, kind string, current string, retired_key string, retired string, late boolean, sources string"
SOURCES = "array<struct<session_id:string,turn_index:long,date:string,batch_id:string>>"
DEPTH = 24
ROOT = "/context"
_key = re.compile(fixed.SNAKE_CASE).fullmatch
_nothing_new = re.compile(fixed.NOTHING_NEW, re.I).search


class Refused(ValueError):
    """Why an update does not go in; the others of its batch do."""


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256((value if isinstance(value, str) else canonical(value)).encode()).hexdigest()


def pointer_of(parts) -> str:
    return ROOT + "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def parts_of(pointer: str) -> tuple[str, ...]:
    return tuple(p.replace("~1", "/").replace("~0", "~") for p in pointer[len(ROOT) + 1 :].split("/"))


def is_reference(value) -> bool:
    return isinstance(value, dict) and list(value) == ["$ref"] and isinstance(value["$ref"], str)


def inspect(value, depth: int, refs: set[str]) -> None:
    """Refuse what may not be in a tree at this depth, and gather references."""
    if depth > DEPTH:
        raise Refused(f"context tree exceeds maximum depth {DEPTH}")
    if isinstance(value, list):
        for v in value:
            inspect(v, depth + 1, refs)
    elif is_reference(value):
        if not value["$ref"].startswith(ROOT + "/"):
            raise Refused("$ref must contain an absolute context pointer")
        refs.add(value["$ref"])
    elif isinstance(value, dict):
        for k, v in value.items():
            if not _key(k) or k in fixed.DANGEROUS_KEYS:
                raise Refused(f"unsafe or non-snake-case context key: {k}")
            inspect(v, depth + 1, refs)


class Tree:
    """What the fold holds of one case: its cells by path, the branches above them, and the pointers referred to."""

    def __init__(self):
        self.cells: dict[tuple, dict] = {}
        self.branches: set[tuple] = {()}
        self.refs: set[str] = set()

    def path(self, parts: tuple, u) -> tuple:
        """Where an update goes: an observation below a cell goes to that cell."""
        if u.mode == "observe":
            for i in range(1, len(parts) + 1):
                cell = self.cells.get(parts[:i])
                if cell:
                    if cell["kind"] != u.kind:
                        raise Refused(f"observation path crosses a different kind: {pointer_of(parts[:i])}")
                    parts = parts[:i]
                    break
                if parts[:i] not in self.branches:
                    break
        for p in parts:
            if not _key(p) or p in fixed.DANGEROUS_KEYS:
                raise Refused(f"unsafe or non-snake-case context key: {p}")
            if p in fixed.FORBIDDEN_KEYS:
                raise Refused(f"forbidden transcript or runtime key: {p}")
        crossed = next((parts[i - 1] for i in range(1, len(parts)) if parts[:i] in self.cells), None)
        if crossed:
            raise Refused(f"path crosses a value instead of a branch: {crossed}")
        if parts in self.branches:
            raise Refused(f"target is not a cell: {pointer_of(parts)}")
        return parts

    def leaf(self, pointer: str, changed: tuple, cell: dict) -> bool:
        """Whether ``pointer`` is a leaf once ``cell`` stands at ``changed``."""
        parts = parts_of(pointer)
        for i in range(1, len(parts) + 1):
            value = cell if parts[:i] == changed else self.cells.get(parts[:i])
            if value is not None:
                for p in parts[i:]:
                    if not isinstance(value, dict) or is_reference(value) or p not in value:
                        return False
                    value = value[p]
                return not isinstance(value, dict) or is_reference(value)
        return False

    def apply(self, u) -> dict:
        """The update's effect, or Refused with the tree as it was. ``time`` is comparable, null where there is none."""
        if u.problem:
            raise Refused(u.problem)
        if _nothing_new(u.reason or ""):
            raise Refused("update declares that it holds nothing new")
        parts = self.path((u.domain, *u.path), u)
        value = json.loads(u.value)
        refs: set[str] = set()
        inspect(value, len(parts) + 2, refs)
        if not u.observed_at:
            raise Refused("update has no resolvable observation date")
        new = {"value": value, "observed_at": u.observed_at, "effective_at": u.effective_at, "unit": u.unit}
        time = None if pd.isna(u.time) else u.time
        before = self.cells.get(parts)
        out = {"pointer": pointer_of(parts), "op": "replace", "kind": u.kind, "late": False, "retired_key": None, "retired": None}
        if before is None:
            cell = {"kind": u.kind, "current": new, "history": {}, "time": time}
            out["op"] = "add"
        else:
            cell = {**before, "history": dict(before["history"])}
            current, retired = before["current"], None
            if u.mode == "observe" and time is not None and before["time"] is not None and time < before["time"]:
                retired = new
                out |= {"late": True, "kind": before["kind"]}
            else:
                if u.mode == "append":
                    lists = [v if isinstance(v, list) else [v] for v in (current["value"], value)]
                    seen: set[str] = set()
                    new["value"] = [v for v in lists[0] + lists[1] if not (digest(v) in seen or seen.add(digest(v)))]
                same = digest(current["value"]) == digest(new["value"]) and (current["effective_at"], current["unit"]) == (u.effective_at, u.unit)
                if same and u.mode != "observe":
                    out |= {"op": None, "kind": before["kind"]}
                else:
                    retired = current
                    cell |= {"kind": u.kind, "current": new, "time": time}
            if retired is not None:
                key = f"observation_{digest(retired)[:12]}"
                inspect(retired["value"], len(parts) + 3, set())
                cell["history"][key] = retired
                out |= {"retired_key": key, "retired": canonical(retired)}
        lost = next((r for r in sorted(self.refs | refs) if not self.leaf(r, parts, cell)), None)
        if lost:
            raise Refused(f"unresolved context reference: {lost}")
        self.refs |= refs
        self.cells[parts] = cell
        self.branches.update(parts[:i] for i in range(1, len(parts)))
        return out | {"current": canonical(cell["current"])}


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    case, tree = None, Tree()
    for b in batches:
        rows = []
        for u in b.itertuples():
            if u.case_id != case:
                case, tree = u.case_id, Tree()
            try:
                rows.append({"accepted": True, "reason": None, **tree.apply(u)})
            except (Refused, json.JSONDecodeError) as e:
                rows.append({"accepted": False, "reason": str(e) if isinstance(e, Refused) else "value is no JSON", "pointer": None, "op": None, "kind": None, "current": None, "retired_key": None, "retired": None, "late": False})
        done = pd.DataFrame(rows, columns=["accepted", "reason", "pointer", "op", "kind", "current", "retired_key", "retired", "late"], dtype=object)
        yield pd.concat([b[["case_id", "seq", "batch_id"]].reset_index(drop=True), done, b["sources"].reset_index(drop=True)], axis=1)


def decisions(updates: DataFrame) -> DataFrame:
    """ST1, ST2, ST3, ST4: ``updates`` in order of ``seq``, a decision each; a refused one leaves its case as it was.

    ``updates``: case_id, seq, batch_id, domain, path (array), kind, mode (set, append, observe), value (JSON), effective_at,
    observed_at, unit, reason, problem (of its sources, or null), sources (array of structs).

    ``set`` replaces, ``append`` adds distinct values, ``observe`` always counts and goes to the nearest cell on its
    path; what was current becomes history under a hash of its content. An observation whose effective time lies before
    the current one's is history at once. A value that does not change gives an accepted row without ``op``.

    Cases are sorted, not grouped, so a task holds the cells of one case at a time, however long its log is.
    """
    columns = ["batch_id", "domain", "path", "kind", "mode", "value", "effective_at", "observed_at", "unit", "reason", "problem"]
    time = dates.comparable_time(F.replace(F.col("effective_at"), F.lit("/"), F.lit("-"))).alias("time")
    rows = updates.select(F.col("case_id").cast("string").alias("case_id"), F.col("seq").cast("long").alias("seq"), *columns, time, F.to_json(F.col("sources").cast(SOURCES)).alias("sources"))
    return rows.repartition("case_id").sortWithinPartitions("case_id", "seq").mapInPandas(_fold, DECISIONS)


def source_problems(updates: DataFrame, sessions: DataFrame) -> DataFrame:
    """ST7: ``updates`` with ``problem``: the first source that its batch's ``sessions`` do not bear out, or null.

    ``sessions``: batch_id, session_id, date, turns (how many). A source names its own batch, a session of it, that
    session's date, and a turn that it has.
    """
    each = updates.select("case_id", "seq", "batch_id", F.posexplode(F.col("sources").cast(SOURCES)).alias("place", "s"))
    known = sessions.select("batch_id", F.col("session_id").alias("known"), F.col("date").alias("day"), "turns")
    rows = each.join(known, (each["batch_id"] == known["batch_id"]) & (F.col("s.session_id") == F.col("known")), "left").drop(known["batch_id"])
    said = (
        F.when(F.col("known").isNull(), F.concat(F.lit("source session is outside current batch: "), F.col("s.session_id")))
        .when(~F.col("s.batch_id").eqNullSafe(F.col("batch_id")), F.concat(F.lit("source batch mismatch: "), F.col("s.batch_id")))
        .when(~F.col("s.date").eqNullSafe(F.col("day")), F.concat(F.lit("source date mismatch: "), F.col("s.session_id")))
        .when(~F.col("s.turn_index").between(0, F.col("turns") - 1), F.concat(F.lit("source turn is outside session: "), F.col("s.session_id")))
    )
    first = rows.withColumn("problem", said).where("problem is not null").groupBy("case_id", "seq").agg(F.min_by("problem", "place").alias("problem"))
    return updates.drop("problem").join(first, ["case_id", "seq"], "left")


def cells(done: DataFrame) -> DataFrame:
    """FJ4: the catalogue of cells after ``decisions``: case_id, pointer, kind, current (JSON), history_count."""
    of = done.where("accepted").groupBy("case_id", "pointer")
    return of.agg(F.max_by("kind", "seq").alias("kind"), F.max_by("current", "seq").alias("current"), F.count_distinct("retired_key").alias("history_count"))


def history(done: DataFrame) -> DataFrame:
    """The past assertions of each cell by the hash of their content: case_id, pointer, retired_key, retired (JSON)."""
    return done.where("retired_key is not null").select("case_id", "pointer", "retired_key", "retired").distinct()


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaf_paths(s: pd.Series) -> pd.Series:
    """FJ3: pointers of the leaves of a JSON object, from its root."""

    def walk(value, at: str) -> list[str]:
        if not isinstance(value, dict) or is_reference(value):
            return [at]
        return [p for k, v in value.items() for p in walk(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}")]

    return s.map(lambda x: walk(json.loads(x), "") if x else [])


def provenance(done: DataFrame) -> DataFrame:
    """ST5: who says what after ``decisions``: case_id, pointer, session_id, turn_index, date, batch_id.

    A cell has all its updates' sources; the leaves of its current assertion those of the update that wrote or confirmed
    it last; the leaves of an assertion in the history those it had when it was current, or brought along if it came late.
    """
    rows = done.where("accepted").withColumn("who", F.from_json("sources", SOURCES))
    wrote = Window.partitionBy("case_id", "pointer").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    past = rows.withColumn("earlier", F.last(F.when(~F.col("late"), F.col("who")), ignorenulls=True).over(wrote)).where("retired_key is not null")
    past = past.groupBy("case_id", "pointer", "retired_key").agg(F.max_by(F.struct("retired", F.when(F.col("late"), F.col("who")).otherwise(F.col("earlier")).alias("who")), "seq").alias("r"))
    past = past.select("case_id", F.concat_ws("/", "pointer", F.lit("history"), "retired_key").alias("at"), F.col("r.retired").alias("body"), "r.who")
    now = rows.where("not late").groupBy("case_id", "pointer").agg(F.max_by(F.struct("current", "who"), "seq").alias("r"))
    now = now.select("case_id", F.concat_ws("/", "pointer", F.lit("current")).alias("at"), F.col("r.current").alias("body"), "r.who")
    leaves = past.unionByName(now).select("case_id", F.explode(F.transform(leaf_paths("body"), lambda p: F.concat(F.col("at"), p))).alias("pointer"), "who")
    whole = rows.select("case_id", "pointer", "who")
    return leaves.unionByName(whole).select("case_id", "pointer", F.explode("who").alias("s")).select("case_id", "pointer", "s.*").dropDuplicates(["case_id", "pointer", "session_id", "turn_index", "batch_id"])


def batch_digests(done: DataFrame) -> DataFrame:
    """ST9, ST17: a hash of all that a batch decided, in order; equal hashes of all batches prove an equal tree."""
    own = F.sha2(F.concat_ws("\x1f", F.coalesce("pointer", F.lit("")), F.coalesce("op", F.lit("")), F.coalesce("kind", F.lit("")), F.coalesce("current", F.lit("")), F.coalesce("retired_key", F.lit("")), F.col("accepted").cast("string")), 256)
    return done.groupBy("case_id", "batch_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", own.alias("h")))), lambda x: x.h), "\n"), 256).alias("digest"))


def at_pointer(document: Column, pointer: Column) -> Column:
    """FJ2: the JSON at ``/context/...`` of a JSON object of the tree, as a struct of value and type; null where nothing is.

    Segments are unescaped; only objects are entered, so a number in a pointer is a key, never a place in an array.
    """
    parts = F.transform(F.split(pointer, "/"), dates.pointer_unescape)
    # get_json_object would read brackets and quotes in a key as syntax, so each step takes the object apart as a map
    step = lambda held, key: F.from_json(held, "map<string,variant>")[key]
    start = F.to_json(F.from_json(document, "variant"))
    walk = F.aggregate(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), start, lambda held, key: F.when(F.ltrim(held).startswith("{"), F.to_json(step(held, key))))
    value = F.when((F.element_at(parts, 1) == "") & (F.try_element_at(parts, F.lit(2)) == "context"), walk)
    first = F.substring(value, 1, 1)
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(value.isin("true", "false"), "boolean").when(value == "null", "null").otherwise("number")
    return F.when(value.isNotNull(), F.struct(value.alias("value"), kind.alias("type")))


def evaluated(pointers: DataFrame, catalogue: DataFrame) -> DataFrame:
    """FJ2, FJ4: ``pointers(case_id, pointer)`` to cells or below them -> the cell's kind, history_count, and value and type there.

    A pointer finds its cell by its ancestors, an equi-join; one that no cell holds, or that leads to nothing in it, is not there.
    """
    parts = F.split("pointer", "/")
    above = F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("cell"), F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(0))), "/").alias("rest")))
    rows = pointers.select("case_id", "pointer", F.explode(above).alias("a")).select("case_id", "pointer", "a.cell", "a.rest").distinct()
    joined = rows.join(catalogue.withColumnRenamed("pointer", "cell"), ["case_id", "cell"])
    body = F.concat(F.lit('{"kind":'), F.to_json(F.struct(F.col("kind").alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("kind").alias("k")))) - 6), F.lit(',"current":'), "current", F.lit("}"))
    found = joined.withColumn("v", at_pointer(body, F.when(F.col("rest") == "", F.lit(ROOT)).otherwise(F.concat(F.lit(ROOT + "/"), "rest"))))
    return found.where("v is not null").select("case_id", "pointer", "kind", "history_count", "v.value", "v.type")


def patched_sources(who: DataFrame, patches: DataFrame) -> DataFrame:
    """ST5: provenance rows (pointer, source) after a batch of patches (op, pointer, to, value JSON, source).

    What is removed loses its rows, what moves takes them along and its root gains the patch's source; leaves of an added
    value have the patch's source alone, those of a replaced value keep the sources that the same leaf had.
    """
    from .ledger import under_pointer

    roots = patches.select(F.col("pointer").alias("root"), "op", "to", F.col("source").alias("by"))
    inside = under_pointer(who, roots.select(F.col("root").alias("pointer"))).distinct()
    kept = who.join(inside.select("pointer").distinct(), "pointer", "left_anti")
    moves = inside.join(roots.where("op = 'move'"), "root")
    place = F.concat("to", F.substring("pointer", F.length("root") + 1, F.length("pointer")))
    moved = moves.select(place.alias("pointer"), "source").unionByName(moves.where(F.col("pointer") == F.col("root")).select(F.col("to").alias("pointer"), F.col("by").alias("source")))
    leaves = patches.where(F.col("op").isin("add", "replace")).select("op", F.col("source").alias("by"), F.explode(F.transform(leaf_paths("value"), lambda p: F.concat("pointer", p))).alias("pointer"))
    before = leaves.where("op = 'replace'").select("pointer").join(who, "pointer")
    return kept.unionByName(moved).unionByName(leaves.select("pointer", F.col("by").alias("source"))).unionByName(before).distinct()


def redundant(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST15: ``updates(case_id, batch_id, seq, domain, path)`` without those whose path is a strict prefix of another's in
    the batch, domain segments inside a path taken out first; and a warning for each that says so (seq, warning)."""
    plain = F.when(F.size("path") > 2, F.filter("path", lambda p: p != F.col("domain"))).otherwise(F.col("path"))
    rows = updates.withColumn("given", F.col("path")).withColumn("path", plain).withColumn("_path", F.array_join("path", "\x1f"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.array_join(F.slice("path", 1, n), "\x1f"))
    parents = rows.where("size(path) > 1").select("case_id", "batch_id", F.explode(above).alias("_path"), F.col("seq").alias("by")).join(rows.select("case_id", "batch_id", "_path"), ["case_id", "batch_id", "_path"], "left_semi")
    kept = rows.join(parents.select("case_id", "batch_id", "_path").distinct(), ["case_id", "batch_id", "_path"], "left_anti")
    gone = parents.select("case_id", F.col("by").alias("seq"), F.concat(F.lit("discarded redundant parent-value update at "), F.replace("_path", F.lit("\x1f"), F.lit("/"))).alias("warning")).distinct()
    cut = rows.where(F.size("path") < F.size("given")).select("case_id", "seq", F.concat(F.lit("removed redundant domain segment '"), "domain", F.lit("' from semantic path")).alias("warning"))
    return kept.drop("_path", "given"), cut.unionByName(gone.join(kept.select("case_id", "seq"), ["case_id", "seq"], "left_semi"))


def slot_sources(cited: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """ST13: sources named by slots -> the turns they mean. ``cited``: batch_id, update, place, session_slot (session_1, ...),
    turn_slot (turn_1, ...), quote; ``sessions``: batch_id, slot (from 0), session_id, date; ``turns``: session_id,
    turn_index, content.

    The declared turn counts if it holds the quote; else the batch's one turn that does; else the one whose best window of
    as many tokens covers the quote by 0.84, and 0.08 better than any other; else the declared turn, without a quote. A slot
    that names no turn gives an invalid source. A row a source, with how it was found and a warning.
    """
    from ..functions import text
    from .ledger import windows_covered

    number = lambda c: F.regexp_extract(c, r"_(\d+)$", 1).try_cast("long") - 1
    at = sessions.select("batch_id", "slot", "session_id", "date").join(turns.select("session_id", "turn_index", text.evidence_text(F.col("content")).alias("said"), "content"), "session_id")
    rows = cited.withColumn("slot", number(F.col("session_slot"))).withColumn("turn_index", number(F.col("turn_slot"))).withColumn("needle", text.evidence_text(F.col("quote")))
    key = ["batch_id", "update", "place"]
    declared = rows.join(at.select("batch_id", "slot", "turn_index", F.col("session_id").alias("own"), "date", F.contains("said", F.lit("")).alias("there"), F.col("said").alias("own_said")), ["batch_id", "slot", "turn_index"], "left")
    declared = declared.withColumn("holds", F.coalesce(F.contains("own_said", F.col("needle")), F.lit(False))).drop("own_said")
    # only quotes that the declared turn does not hold look at the other turns of their batch
    lost = declared.where("there and not holds").select(*key, "needle", "quote")
    met = lost.join(at.select("batch_id", F.col("slot").alias("s"), F.col("turn_index").alias("t"), "said", "content", F.col("session_id").alias("sid"), F.col("date").alias("d")), "batch_id")
    exact = met.where(F.contains("said", F.col("needle"))).groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("s", "t", "sid", "d")).alias("one")).where("n = 1")
    scored = windows_covered(met.select(*key, "s", "t", "sid", "d", text.plain_terms(F.col("quote")).alias("want"), text.plain_terms(F.col("content")).alias("have")))
    by = Window.partitionBy(*key).orderBy(F.desc("score"), "s", "t")
    best = scored.withColumn("n", F.row_number().over(by)).withColumn("next", F.lead("score").over(by)).where("n = 1")
    best = best.where((F.col("score") >= 0.84) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= 0.08))).select(*key, F.struct("s", "t", "sid", "d").alias("near"), "score")
    out = declared.join(exact.select(*key, "one"), key, "left").join(best, key, "left")
    how = F.when(F.col("there").isNull(), "invalid").when(F.col("holds"), "declared").when(F.col("one").isNotNull(), "corrected").when(F.col("near").isNotNull(), "resolved").otherwise("retained")
    other = F.coalesce("one", "near")
    there = lambda slot, turn: F.concat(F.lit("session_"), (slot + 1).cast("string"), F.lit("/turn_"), (turn + 1).cast("string"))
    warning = (
        F.when(how == "corrected", F.concat(F.lit("evidence location corrected from "), there(F.col("slot"), F.col("turn_index")), F.lit(" to "), there(F.col("one.s"), F.col("one.t"))))
        .when(how == "resolved", F.concat(F.lit("evidence quote resolved to "), there(F.col("near.s"), F.col("near.t")), F.lit(" at "), F.format_number("score", 2), F.lit(" token coverage")))
        .when(how == "retained", F.lit("evidence quote did not match transcript; declared session/turn provenance retained for audit"))
    )
    moved = how.isin("corrected", "resolved")
    named = F.when(moved, other["sid"]).otherwise(F.col("own"))
    return out.select(
        *key, F.coalesce(named.cast("string"), F.concat(F.lit("__invalid_evidence_"), "session_slot")).alias("session_id"), F.when(moved, other["t"]).when(how == "invalid", 0).otherwise(F.col("turn_index")).alias("turn_index"),
        F.when(moved, other["d"]).when(how == "invalid", "__invalid_evidence__").otherwise(F.col("date")).alias("date"), F.when(how.isin("declared", "corrected"), F.col("quote")).alias("excerpt"), how.alias("how"), warning.alias("warning"),
    )


def valid_slots(sources: DataFrame) -> DataFrame:
    """ST13: of an update's sources the valid ones; of an update without any, the first, so that it is refused for it."""
    by = Window.partitionBy("batch_id", "update")
    rows = sources.withColumn("valid", F.count_if(F.col("how") != "invalid").over(by))
    first = ranked(rows.where("valid = 0"), ["batch_id", "update"], [F.asc("place")], 1, "n").drop("n")
    return rows.where("valid > 0 and how <> 'invalid'").unionByName(first).drop("valid")
