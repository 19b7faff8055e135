"""The versioned tree: literal cases, a plain nested tree in Python, pointers, patches, slots."""

import copy
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import tree

UPDATES = "case_id string, seq long, batch_id string, domain string, path array<string>, kind string, mode string, value string, effective_at string, observed_at string, unit string, reason string, problem string, sources array<struct<session_id:string,turn_index:long,date:string,batch_id:string>>"


def update(seq, path, value, mode="set", kind="fact", effective=None, unit=None, reason="said so", problem=None, batch="b1", session="s1", observed="2025/01/01", case="c"):
    domain, *rest = path.split("/")
    return (case, seq, batch, domain, rest, kind, mode, json.dumps(value), effective, observed, unit, reason, problem, [(session, 0, observed, batch)])


def decided(spark, rows):
    return {r.seq: r for r in tree.decisions(spark.createDataFrame(rows, UPDATES)).collect()}


def test_bad_updates_are_refused_one_by_one(spark):
    rows = [
        update(1, "people/user/education/degree", "Business"),
        update(2, "other/session/turns", "raw transcript"),
        update(3, "measurements/user/followers", 250, "observe", "measurement", "2025/01/01", "followers"),
        update(4, "people/user/education/degree/year", 3),
        update(5, "people/user/education", "flat"),
        update(6, "people/Not_Snake", 1),
        update(7, "people/constructor", 1),
        update(8, "people/x", 1, reason="No new durable information here"),
        update(9, "people/x", {"bad key": 1}),
        update(10, "people/x", {"$ref": "/context/people/missing"}),
        update(11, "people/x", {"$ref": "/context/people/user/education/degree/current/value"}),
        update(12, "people/y", {"$ref": "elsewhere"}),
        update(13, "people/z", 1, problem="source session is outside current batch: s9"),
        update(14, "measurements/user/followers/at_start", 1, "observe", "fact"),
        update(15, "people/w", 1, observed=None),
    ]
    got = decided(spark, rows)
    assert {s for s, r in got.items() if r.accepted} == {1, 3, 11}
    reasons = {s: r.reason for s, r in got.items() if not r.accepted}
    assert reasons[2] == "forbidden transcript or runtime key: session" and reasons[4] == "path crosses a value instead of a branch: degree"
    assert reasons[5] == "target is not a cell: /context/people/user/education" and reasons[6].endswith("Not_Snake") and reasons[7].endswith("constructor")
    assert reasons[8].startswith("update declares") and reasons[9].endswith("bad key") and reasons[10].startswith("unresolved context reference")
    assert reasons[12].startswith("$ref must") and reasons[13] == rows[12][12] and reasons[14].startswith("observation path crosses a different kind")
    assert "observation date" in reasons[15]


def test_depth_has_a_limit(spark):
    deep = lambda n: 1 if not n else {"a": deep(n - 1)}
    got = decided(spark, [update(1, "d/p", deep(20)), update(2, "d/q", deep(21)), update(3, "d/p", 1)])
    assert [got[i].accepted for i in (1, 2, 3)] == [True, False, False]  # the third would put the first one level deeper


def test_observations_keep_history_by_content(spark):
    rows = [
        update(1, "m/user/count", 350, "observe", "measurement", "2025-02-01", "x", session="s1"),
        update(2, "m/user/count", 250, "observe", "measurement", "2025-01-01", "x", session="s2", batch="b2"),
        update(3, "m/user/count/at_start", 100, "observe", "measurement", "2024/12/01", "x", session="s3", batch="b2"),
        update(4, "m/user/count", 400, "observe", "measurement", "2025-03-01", "x", session="s4", batch="b3"),
        update(5, "m/user/tags", "a", "append", session="s5", batch="b3"),
        update(6, "m/user/tags", ["b", "a", "c"], "append", session="s6", batch="b3"),
        update(7, "m/user/tags", "c", "append", session="s7", batch="b3"),
    ]
    done = tree.decisions(spark.createDataFrame(rows, UPDATES))
    by = {r.seq: r for r in done.collect()}
    assert [by[i].op for i in range(1, 8)] == ["add", "replace", "replace", "replace", "add", "replace", None]
    assert [by[i].late for i in range(1, 5)] == [False, True, True, False] and by[3].pointer == "/context/m/user/count"
    cells = {r.pointer: r for r in tree.cells(done).collect()}
    count, tags = cells["/context/m/user/count"], cells["/context/m/user/tags"]
    assert json.loads(count.current)["value"] == 400 and count.history_count == 3 and json.loads(tags.current)["value"] == ["a", "b", "c"]
    first = {"value": 350, "observed_at": "2025/01/01", "effective_at": "2025-02-01", "unit": "x"}
    key = "observation_" + hashlib.sha256(json.dumps(first, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
    assert {(json.loads(r.retired)["value"]) for r in tree.history(done).where("pointer like '%count'").collect()} == {350, 250, 100}
    who = {}
    for r in tree.provenance(done).collect():
        who.setdefault(r.pointer, set()).add(r.session_id)
    assert who["/context/m/user/count"] == {"s1", "s2", "s3", "s4"} and who["/context/m/user/count/current/value"] == {"s4"}
    assert who[f"/context/m/user/count/history/{key}/value"] == {"s1"}
    assert who["/context/m/user/tags/current/value"] == {"s7"} and who["/context/m/user/tags"] == {"s5", "s6", "s7"}
    late = by[2].retired_key
    assert who[f"/context/m/user/count/history/{late}/effective_at"] == {"s2"}


class Plain:
    """The tree as nested objects, copied before every update: the same rules written another way."""

    def __init__(self):
        self.root, self.who = {}, {}

    @staticmethod
    def cell(v):
        return isinstance(v, dict) and isinstance(v.get("current"), dict) and isinstance(v.get("history"), dict)

    @staticmethod
    def leaves(v, at):
        return [p for k, x in v.items() for p in Plain.leaves(x, f"{at}/{k}")] if isinstance(v, dict) and list(v) != ["$ref"] else [at]

    def write(self, at, body, who):
        self.who = {p: s for p, s in self.who.items() if not p.startswith(at + "/")}
        for p in self.leaves(body, at):
            self.who[p] = [who]

    def put(self, u):
        _, _, batch, domain, path, kind, mode, value, effective, observed, unit, *_, sources = u
        saved = copy.deepcopy((self.root, self.who))
        try:
            parts, node = [domain, *path], self.root
            if mode == "observe":
                for i, p in enumerate(parts):
                    node = node.get(p)
                    if self.cell(node):
                        if node["kind"] != kind:
                            raise ValueError
                        parts = parts[: i + 1]
                        break
                    if node is None:
                        break
            node = self.root
            for p in parts[:-1]:
                node = node.setdefault(p, {})
                if self.cell(node):
                    raise ValueError
            old = node.get(parts[-1])
            if old is not None and not self.cell(old):
                raise ValueError
            value, source, at = json.loads(value), (sources[0][0], batch), "/context/" + "/".join(parts)
            new = {"value": value, "observed_at": observed, "effective_at": effective, "unit": unit}
            self.who.setdefault(at, [])
            self.who[at] += [source] * (source not in self.who[at])
            if old is None:
                node[parts[-1]] = {"kind": kind, "current": new, "history": {}}
                self.write(at + "/current", new, source)
                return True
            now = old["current"]
            key = lambda a: "observation_" + hashlib.sha256(json.dumps(a, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
            if mode == "observe" and effective and now["effective_at"] and effective < now["effective_at"]:
                old["history"][key(new)] = new
                self.write(f"{at}/history/{key(new)}", new, source)
                return True
            if mode == "append":
                given = (now["value"] if isinstance(now["value"], list) else [now["value"]]) + (value if isinstance(value, list) else [value])
                new["value"] = [v for i, v in enumerate(given) if v not in given[:i]]
            if mode != "observe" and (new["value"], effective, unit) == (now["value"], now["effective_at"], now["unit"]):
                self.write(at + "/current", now, source)
                return True
            old["history"][key(now)] = now
            self.who |= {p.replace(at + "/current", f"{at}/history/{key(now)}", 1): s for p, s in list(self.who.items()) if p.startswith(at + "/current/")}
            old |= {"kind": kind, "current": new}
            self.write(at + "/current", new, source)
            return True
        except ValueError:
            self.root, self.who = saved
            return False

    def cells(self, node=None, at="/context"):
        for k, v in (self.root if node is None else node).items():
            if self.cell(v):
                yield f"{at}/{k}", v
            else:
                yield from self.cells(v, f"{at}/{k}")


def random_updates(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        path = "/".join([rnd.choice("pq"), *(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))])
        value = rnd.choice([1, 2, "x", [1, "y"], {"u": 1, "v": {"w": 2}}])
        rows.append(update(i, path, value, rnd.choice(["set", "append", "observe"]), rnd.choice(["fact", "fact", "state"]), rnd.choice([None, "2025-01-01", "2025-02-01", "2025-03-01"]), rnd.choice([None, "m"]), batch=f"b{i // 10}", session=f"s{i}", case=str(rnd.randint(0, 3))))
    return rows


def test_fold_is_the_plain_tree(spark):
    rows = random_updates(600, 4)
    done = tree.decisions(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), UPDATES).repartition(5)).cache()
    plain, accepted = {}, {}
    for u in rows:
        accepted[u[1]] = plain.setdefault(u[0], Plain()).put(u)
    assert 100 < sum(accepted.values()) < 600 and {r.seq: r.accepted for r in done.collect()} == accepted
    want = {(c, p): (v["kind"], v["current"], len(v["history"])) for c, t in plain.items() for p, v in t.cells()}
    assert {(r.case_id, r.pointer): (r.kind, json.loads(r.current), r.history_count) for r in tree.cells(done).collect()} == want
    held = {(c, p, k): a for c, t in plain.items() for p, v in t.cells() for k, a in v["history"].items()}
    assert {(r.case_id, r.pointer, r.retired_key): json.loads(r.retired) for r in tree.history(done).collect()} == held
    who = {(c, p, *s) for c, t in plain.items() for p, ss in t.who.items() for s in ss}
    assert {(r.case_id, r.pointer, r.session_id, r.batch_id) for r in tree.provenance(done).collect()} == who


def test_empty_log(spark):
    done = tree.decisions(spark.createDataFrame([], UPDATES))
    assert done.count() == tree.cells(done).count() == tree.provenance(done).count() == tree.history(done).count() == 0


def test_digests_show_what_replay_changes(spark):
    rows = random_updates(80, 5)
    first = {tuple(r) for r in tree.batch_digests(tree.decisions(spark.createDataFrame(rows, UPDATES))).collect()}
    again = {tuple(r) for r in tree.batch_digests(tree.decisions(spark.createDataFrame(rows[::-1], UPDATES).repartition(3))).collect()}
    n = next(r.seq for r in tree.decisions(spark.createDataFrame(rows, UPDATES)).where("accepted and seq > 30").orderBy("seq").collect())
    changed = [r if r[1] != n else (*r[:7], '"other"', *r[8:]) for r in rows]
    other = {tuple(r) for r in tree.batch_digests(tree.decisions(spark.createDataFrame(changed, UPDATES))).collect()}
    assert first == again and rows[n][0:3:2] in {t[:2] for t in first - other}


def test_source_problems(spark):
    sessions = spark.createDataFrame([("b1", "s1", "2025/01/01", 2), ("b1", "s2", "2025/01/02", 1)], "batch_id string, session_id string, date string, turns long")
    given = [[("s1", 1, "2025/01/01", "b1")], [("s1", 0, "2025/01/01", "b1"), ("s9", 0, "2025/01/01", "b1")], [("s1", 0, "2025/01/01", "b2")], [("s2", 0, "2025/01/01", "b1")], [("s2", 1, "2025/01/02", "b1"), ("s8", 0, "", "b1")]]
    rows = [(*update(i, "a/b", 1)[:13], s) for i, s in enumerate(given)]
    got = {r.seq: r.problem for r in tree.source_problems(spark.createDataFrame(rows, UPDATES), sessions).collect()}
    assert got == {0: None, 1: "source session is outside current batch: s9", 2: "source batch mismatch: b2", 3: "source date mismatch: s2", 4: "source turn is outside session: s2"}


@pytest.mark.parametrize(
    ("pointer", "want"),
    [
        ("/context/a", ('{"b":[1,2],"c/d":{"e~f":"x"}}', "object")), ("/context/a/b", ("[1,2]", "array")), ("/context/a/b/0", None), ("/context/a/c~1d/e~0f", ('"x"', "string")),
        ("/context/n", ("null", "null")), ("/context/t", ("true", "boolean")), ("/context/k.[0]'", ("1.5", "number")), ("/context/none", None), ("/other/a", None), ("/context/t/x", None), ("context/a", None), ("", None),
    ],
)
def test_at_pointer(spark, pointer, want):
    doc = {"a": {"b": [1, 2], "c/d": {"e~f": "x"}}, "n": None, "t": True, "k.[0]'": 1.5}
    row = spark.createDataFrame([(json.dumps(doc), pointer)], "doc string, p string").select(tree.at_pointer(F.col("doc"), F.col("p")).alias("v")).first()
    assert (row.v and tuple(row.v)) == want


def test_pointers_into_cells(spark):
    done = tree.decisions(spark.createDataFrame([update(1, "m/a~b/c", {"x": [1]}, "observe"), update(2, "m/count", 3, "observe"), update(3, "m/count", 4, "observe")], UPDATES))
    asked = [("c", p) for p in ("/context/m/count", "/context/m/count/current/value", "/context/m/count/current", "/context/m/count/current/none", "/context/m", "/context/none/x")] + [("d", "/context/m/count")]
    got = {(r.case_id, r.pointer): (r.kind, r.history_count, r.value, r.type) for r in tree.evaluated(spark.createDataFrame(asked, "case_id string, pointer string"), tree.cells(done)).collect()}
    assert set(got) == {("c", "/context/m/count"), ("c", "/context/m/count/current/value"), ("c", "/context/m/count/current")}
    assert got["c", "/context/m/count/current/value"] == ("fact", 1, "4", "number") and got["c", "/context/m/count"][3] == "object"


def test_patches_move_provenance(spark):
    who = spark.createDataFrame([("/context/a/x", "s1"), ("/context/a/y", "s2"), ("/context/ab", "s3"), ("/context/r/k", "s4"), ("/context/r/gone", "s5"), ("/context/d/q", "s6")], "pointer string, source string")
    patches = [("move", "/context/a", "/context/b", None, "m"), ("replace", "/context/r", None, '{"k": 1, "n": [1]}', "r"), ("remove", "/context/d", None, None, "d"), ("add", "/context/new", None, '{"u": {"v": 1}}', "n")]
    got = {tuple(r) for r in tree.patched_sources(who, spark.createDataFrame(patches, "op string, pointer string, to string, value string, source string")).collect()}
    assert got == {("/context/b/x", "s1"), ("/context/b/y", "s2"), ("/context/ab", "s3"), ("/context/r/k", "s4"), ("/context/r/k", "r"), ("/context/r/n", "r"), ("/context/new/u/v", "n")}


def test_redundant_parents_and_domains(spark):
    rows = [("c", "b", 1, "people", ["user"]), ("c", "b", 2, "people", ["user", "people", "age"]), ("c", "b", 3, "people", ["people", "x"]), ("c", "b2", 4, "people", ["user"])]
    kept, told = tree.redundant(spark.createDataFrame(rows, "case_id string, batch_id string, seq long, domain string, path array<string>"))
    assert {r.seq: r.path for r in kept.collect()} == {2: ["user", "age"], 3: ["people", "x"], 4: ["user"]}
    assert {(r.seq, re.sub(r"'.*'", "", r.warning)) for r in told.collect()} == {(2, "removed redundant domain segment  from semantic path"), (2, "discarded redundant parent-value update at user")}


def test_slots_find_their_turns(spark):
    turns = [("s1", 0, "I bought a red bike in May last year"), ("s1", 1, "Nice, what a colour"), ("s2", 0, "My sister moved to the green house near the old lake"), ("s2", 1, "Nice, what a colour")]
    sessions = spark.createDataFrame([("b", 0, "s1", "2025/01/01"), ("b", 1, "s2", "2025/01/02")], "batch_id string, slot long, session_id string, date string")
    cited = [
        ("b", 1, 0, "session_1", "turn_1", "red bike"), ("b", 1, 1, "session_1", "turn_2", "the green house"), ("b", 2, 0, "session_1", "turn_1", "sister moved to a green house near the old lake"),
        ("b", 3, 0, "session_1", "turn_1", "what a colour"), ("b", 4, 0, "session_7", "turn_1", "red bike"), ("b", 4, 1, "session_1", "turn_9", "red bike"), ("b", 5, 0, "session_9", "turn_1", "x"), ("b", 5, 1, "session_2", "turn_2", "Nice"),
    ]
    got = tree.slot_sources(spark.createDataFrame(cited, "batch_id string, update long, place long, session_slot string, turn_slot string, quote string"), sessions, spark.createDataFrame(turns, "session_id string, turn_index long, content string")).cache()
    by = {(r.update, r.place): r for r in got.collect()}
    assert {k: (r.session_id, r.turn_index, r.how) for k, r in by.items()} == {
        (1, 0): ("s1", 0, "declared"), (1, 1): ("s2", 0, "corrected"), (2, 0): ("s2", 0, "resolved"), (3, 0): ("s1", 0, "retained"),
        (4, 0): ("__invalid_evidence_session_7", 0, "invalid"), (4, 1): ("__invalid_evidence_session_1", 0, "invalid"), (5, 0): ("__invalid_evidence_session_9", 0, "invalid"), (5, 1): ("s2", 1, "declared"),
    }
    assert by[1, 1].warning == "evidence location corrected from session_1/turn_2 to session_2/turn_1" and by[2, 0].warning.endswith("session_2/turn_1 at 0.90 token coverage")
    assert by[2, 0].excerpt is None and by[1, 0].excerpt == "red bike" and by[1, 0].warning is None
    assert sorted((r.update, r.place) for r in tree.valid_slots(got).collect()) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]
