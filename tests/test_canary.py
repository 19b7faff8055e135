"""Canaries against plain Python over the whole population; repair, nesting, features, manifests."""

import hashlib
import json
import math
import random

import pytest

from cairn.operators import canary
from cairn.sources import tables

ROWS = "question_id string, kind string, abstention boolean, " + ", ".join(f"{c} double" for c in canary.FEATURES) + ", quartile int"


def population(n, seed, kinds="ab"):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        absent = rnd.random() < 0.2
        evidence, at = rnd.choice([1.0, 1.0, 2.0]), rnd.choice([0.05, 0.1, 0.3, 0.4, 0.6, 0.9])
        features = [float(rnd.randint(1, 9)), float(rnd.randint(1, 999)), float(rnd.randint(1, 50)), evidence, at, rnd.random(), float(rnd.randint(1, 99)), float(rnd.randint(1, 99))]
        rows.append((f"q{i}" + "_abs" * absent, rnd.choice(kinds), absent, *features, min(3, int(at * 4))))
    return rows


def tie(i, seed):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()


def plain_spread(rows, quotas, required, seed):
    out = []
    for key, quota in quotas.items():
        pool = {r[0]: r[3:11] for r in rows if r[1:3] == key}
        lo, hi = [min(c) for c in zip(*pool.values(), strict=True)], [max(c) for c in zip(*pool.values(), strict=True)]
        v = {i: [(x - a) / (b - a) if b > a else 0.0 for x, a, b in zip(f, lo, hi, strict=True)] for i, f in pool.items()}
        far = lambda a, b: round(math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))), 9)

        def medoid(ids):
            mean = [sum(c) / len(ids) for c in zip(*(v[i] for i in ids), strict=True)]  # noqa: B023
            return min(ids, key=lambda i: (far(v[i], mean), tie(i, seed)))  # noqa: B023

        taken = sorted(i for i in required if i in pool)
        groups = {}
        for i, f in pool.items():
            groups.setdefault(f[3], []).append(i)
        if quota >= len(groups):
            for count in sorted(groups):
                if not set(groups[count]) & set(taken) and len(taken) < quota:
                    taken.append(medoid(groups[count]))
        if not taken and quota:
            taken.append(medoid(list(pool)))
        while len(taken) < quota:
            taken.append(min((i for i in pool if i not in taken), key=lambda i: (-min(far(v[i], v[t]) for t in taken), tie(i, seed))))
        out += taken
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_spread_is_farthest_first(spark, seed):
    rows = population(120, seed)
    quotas = {("a", False): 6, ("b", False): 5, ("a", True): 1, ("b", True): 2}
    cases = spark.createDataFrame(rows, ROWS).repartition(4)
    assert canary.spread(cases, quotas, seed="s") == plain_spread(rows, quotas, [], "s")
    required = [r[0] for r in rows if r[1:3] == ("a", False)][:3]
    got = canary.spread(cases, quotas, required, "s")
    assert got == plain_spread(rows, quotas, required, "s") and set(required) <= set(got)


def test_spread_checks_its_quotas(spark):
    cases = spark.createDataFrame(population(20, 3), ROWS)
    with pytest.raises(ValueError, match="quota exceeds"):
        canary.spread(cases, {("a", False): 500})
    with pytest.raises(ValueError, match="outside"):
        canary.spread(cases, {("a", False): 2}, ["nobody"])
    with pytest.raises(ValueError, match="quota exceeds"):
        canary.spread(cases.limit(0), {("a", False): 1})


def test_repair_swaps_until_quartiles_are_covered(spark):
    at = lambda i, q, e=1.0, kind="a", absent=False: (i, kind, absent, 1.0, 1.0, 1.0, e, q / 4, 0.0, 1.0, 1.0, q)
    rows = [at("p0", 0), at("p1", 0), at("p2", 1, 2.0), at("p3", 2), at("p4", 3), at("p5", 3), at("x1_abs", 3, absent=True)]
    cases = spark.createDataFrame(rows, ROWS)
    got = canary.repaired(cases, ["p0", "p1", "p2", "p3"])
    new = min(("p4", "p5"), key=lambda i: tie(i, "canary"))
    old = min(("p0", "p1"), key=lambda i: tie(i, "canary"))
    assert got == sorted({"p0", "p1", "p2", "p3", new} - {old})
    assert canary.repaired(cases, ["p0", "p2", "p3", "p4"]) == ["p0", "p2", "p3", "p4"]
    with pytest.raises(ValueError, match="quartile 3"):
        canary.repaired(cases, ["p0", "p2", "p3"])  # any swap would lose another quartile


def test_nested_canaries_and_manifest(spark):
    cases = spark.createDataFrame(population(200, 9), ROWS).cache()
    large = canary.canary(cases, {("a", False): 12, ("b", False): 12, ("a", True): 2}, seed="n").cache()
    small = canary.canary(large, {("a", False): 6, ("b", False): 6}, seed="n").cache()
    assert (large.count(), small.count()) == (26, 12) and small.join(large, "question_id", "left_anti").count() == 0
    for kind in "ab":
        assert {r.quartile for r in small.where(f"kind = '{kind}'").collect()} == {0, 1, 2, 3}
    told = json.loads(canary.manifest(cases, large, "large", "n").first().manifest)
    assert told["question_ids"] == sorted(r.question_id for r in large.collect()) and told["abstention_count"] == 2 and told["abstention_by_type"] == {"a": 2} and told["subset_of"] is None
    assert [s["sample_count"] for s in told["strata"]] == [12, 2, 12] and sum(s["population_count"] for s in told["strata"]) <= 200
    assert told["coverage"]["evidence_position_quartiles_by_type"] == {"a": [0, 1, 2, 3], "b": [0, 1, 2, 3]} and told["question_type_counts"] == {"a": 14, "b": 12}
    assert [r.question_id for r in canary.canary(cases.repartition(7), {("a", False): 12, ("b", False): 12, ("a", True): 2}, seed="n").orderBy("question_id").collect()] == told["question_ids"]


def test_features_of_cases(spark):
    turn = {"role": "user", "content": "abcd"}
    row = ("q1_abs", "kind", "why?", "because", "2025/01/01", ["s1", "s2", "s3", "s2"], ["d"] * 4, [[turn], [turn, turn], [], [turn]], ["s1", "s2"])
    lost = ("q2", "kind", "why?", "b", "2025/01/01", ["s1"], ["d"], [[turn]], ["s9"])
    got = {r.question_id: r for r in canary.case_features(spark.createDataFrame([row, lost], tables.CASE_SCHEMA)).collect()}
    one = got["q1_abs"]
    assert [one[c] for c in canary.FEATURES] == [4.0, 16.0, 4.0, 2.0, 0.5, 1.0, 4.0, 7.0] and (one.kind, one.abstention, one.quartile) == ("kind", True, 2)
    assert got["q2"].quartile is None and got["q2"].evidence_mean_position is None and got["q2"].abstention is False
