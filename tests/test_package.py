"""Evidence packages against a plain fold that serialises the whole envelope after each item."""

import json
import random

import pytest

from cairn.operators import package

SCHEMAS = {
    "plans": "question_id long, support_status string, answer_mode string", "selected": "question_id long, place long, session_id string, purpose string, turn_index long",
    "cited": "question_id long, place long, session_id string, turn_index long", "facts": "question_id long, place long, statement string, session_ids array<string>, pointers array<string>",
    "conflicts": "question_id long, place long, body string", "values": "question_id long, place long, pointer string, value string, sources string",
}


def plain(case, turns, budget):
    dump = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())
    payload = {"schemaVersion": 1, "readerDecision": {"supportStatus": case["plan"][0], "answerMode": case["plan"][1]}, "evidenceFacts": [], "conflicts": [], "graphEvidence": [], "sessions": []}
    if dump(payload) > budget:
        return None
    omitted, chosen = [], {}
    for session, purpose, turn in case["selected"] + [(s, "context", t) for s, t in case["cited"]]:
        if session not in turns or (session not in chosen and len(chosen) >= 8):
            continue
        own = chosen.setdefault(session, {"purposes": [], "asked": []})
        own["purposes"] += [purpose] * (purpose not in own["purposes"])
        own["asked"].append(turn)

    def attempt(name, change):
        new = json.loads(json.dumps(payload))
        change(new)
        if dump(new) <= budget:
            payload.update(new)
        else:
            omitted.append(name)

    def add_turn(session, i, why):
        def change(p):
            block = next((b for b in p["sessions"] if b["sessionId"] == session), None)
            if block is None:
                block = {"sessionId": session, "date": turns[session][0], "purposes": chosen[session]["purposes"], "turns": []}
                p["sessions"].append(block)
            role, content = turns[session][1][i]
            block["turns"].append({"turnIndex": i, "role": role, "content": content, "selection": why})

        attempt(f"session:{session}:turn:{i}", change)

    for why in ("reader_selected", "adjacent_context"):
        for session, own in chosen.items():
            there = range(len(turns[session][1]))
            asked = {t for t in own["asked"] if t in there}
            near = {t + d for t in own["asked"] for d in (-1, 0, 1) if t + d in there}
            for i in sorted(asked if why == "reader_selected" else near - asked):
                add_turn(session, i, why)
    held = [p for p, _, _ in case["values"][:12]]
    for i, (statement, sessions, pointers) in enumerate(case["facts"][:12]):
        s, p = [x for x in dict.fromkeys(sessions) if x in chosen], [x for x in dict.fromkeys(pointers) if x in held]
        if not s and not p:
            omitted.append(f"fact:{i}:unselected_source")
        else:
            attempt(f"fact:{i}", lambda x, f={"statement": statement, "sessionIds": s, "graphPointers": p}: x["evidenceFacts"].append(f))
    for i, body in enumerate(case["conflicts"]):
        attempt(f"conflict:{i}", lambda x, b=body: x["conflicts"].append(b))
    for i, (pointer, value, sources) in enumerate(case["values"][:12]):
        if value is None:
            omitted.append(f"graph:{i}:unknown_pointer")
        else:
            attempt(f"graph:{i}", lambda x, g={"pointer": pointer, "value": value, "sources": sources}: x["graphEvidence"].append(g))
    return payload, omitted


def random_case(rnd):
    session, word = lambda: f"s{rnd.randint(0, 13)}", lambda: rnd.choice(["short", 'quo"ted \\ ', "naïve \n line\t\x01", "日本語 " * 9, "x" * 150])
    return {
        "plan": ("sufficient", "direct"), "selected": [(session(), rnd.choice(["direct_answer", "context"]), rnd.randint(-1, 5)) for _ in range(rnd.randint(0, 14))],
        "cited": [(session(), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 4))], "facts": [(word(), [session() for _ in range(rnd.randint(0, 3))], rnd.sample(["/context/a", "/context/b"], rnd.randint(0, 2))) for _ in range(rnd.randint(0, 15))],
        "conflicts": [{"description": word()} for _ in range(rnd.randint(0, 2))], "values": [("/context/" + rnd.choice("abcd"), rnd.choice([None, 1, {"v": "é"}]), [{"sessionId": "s1"}]) for _ in range(rnd.randint(0, 14))],
    }


def chosen_of(spark, cases):
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    rows = {
        "plans": [(q, *c["plan"]) for q, c in cases.items()], "selected": [(q, i, *x) for q, c in cases.items() for i, x in enumerate(c["selected"])], "cited": [(q, i, *x) for q, c in cases.items() for i, x in enumerate(c["cited"])],
        "facts": [(q, i, *x) for q, c in cases.items() for i, x in enumerate(c["facts"])], "conflicts": [(q, i, dump(x)) for q, c in cases.items() for i, x in enumerate(c["conflicts"])],
        "values": [(q, i, p, None if v is None else dump(v), dump(s)) for q, c in cases.items() for i, (p, v, s) in enumerate(c["values"])],
    }
    return package.Chosen(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()})


@pytest.mark.parametrize("budget", [1, 170, 400, 1200, 36_000])
def test_packages_are_the_plain_fold(spark, budget):
    rnd = random.Random(budget)
    turns = {f"s{i}": (f"2025/01/{i + 1:02d}", [(rnd.choice(["user", "assistant"]), rnd.choice(["hi", 'a "b" \\', "é" * 40, "y" * 90])) for _ in range(rnd.randint(1, 5))]) for i in range(12)}
    cases = {q: random_case(rnd) for q in range(25)}
    said = spark.createDataFrame([(s, d, i, r, t) for s, (d, ts) in turns.items() for i, (r, t) in enumerate(ts)], "session_id string, date string, turn_index long, role string, content string")
    got = {r.question_id: r for r in package.evidence_packages(chosen_of(spark, cases), said, budget).collect()}
    assert set(got) == set(cases)
    for q, case in cases.items():
        want, r = plain(case, turns, budget), got[q]
        if want is None:
            assert r.payload is None and r.problem
            continue
        assert json.loads(r.payload) == want[0] and sorted(r.omitted) == sorted(want[1])
        assert r.bytes == len(r.payload.encode()) <= budget and r.token_estimate == -(-r.bytes // 4) and r.problem is None


def test_no_packages(spark):
    turns = spark.createDataFrame([], "session_id string, date string, turn_index long, role string, content string")
    assert package.evidence_packages(chosen_of(spark, {}), turns).count() == 0
    one = package.evidence_packages(chosen_of(spark, {1: {"plan": ("insufficient", "abstain"), "selected": [("s1", "context", 0)], "cited": [], "facts": [], "conflicts": [], "values": []}}), turns).first()
    assert json.loads(one.payload)["sessions"] == [] and one.bytes == len(one.payload)
    with pytest.raises(ValueError):
        package.evidence_packages(chosen_of(spark, {}), turns, 0)


def test_packages_of_the_tables(spark):
    from cairn.plans import cases

    data = "/root/testdata/sf0.001"
    c, turns = cases.chosen(spark, data)
    said = {}
    for r in turns.orderBy("session_id", "turn_index").collect():
        said.setdefault(str(r.session_id), (r.date, []))[1].append((r.role, r.content))
    plans = {r.question_id: {"plan": (r.support_status, r.answer_mode), "selected": [], "cited": [], "facts": [], "conflicts": [], "values": []} for r in c.plans.collect()}
    for r in c.selected.orderBy("place").collect():
        plans[r.question_id]["selected"].append((str(r.session_id), r.purpose, r.turn_index))
    for r in c.facts.orderBy("place").collect():
        plans[r.question_id]["facts"].append((r.statement, r.session_ids, r.pointers))
    got = {r.question_id: r for r in cases.evidence_packages(spark, data).collect()}
    assert set(got) == set(plans)
    for q, case in plans.items():
        payload, omitted = plain(case, said, 4000)
        assert json.loads(got[q].payload) == payload and sorted(got[q].omitted.split()) == sorted(omitted) and got[q].bytes == len(got[q].payload.encode())
