"""Metrics and reports (AG1-AG30): every one an aggregate over a judged or ranked table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def hit_metrics(ranks: DataFrame, gold: DataFrame, item: str = "doc_id") -> DataFrame:
    """AG1: a row a question with gold: found, gold, hit, complete, first and worst rank (worst null unless all are found)."""
    joined = gold.join(ranks.select("question_id", item, "rank"), ["question_id", item], "left")
    rows = joined.groupBy("question_id").agg(F.count("*").alias("n_gold"), F.count("rank").alias("n_found"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"), F.array_sort(F.array_compact(F.collect_list("rank"))).alias("ranks"))
    whole = F.col("n_found") == F.col("n_gold")
    return rows.select("question_id", "n_gold", "n_found", (F.col("n_found") > 0).alias("hit"), whole.alias("complete"), "first_rank", F.when(whole, F.col("last_rank")).alias("worst_rank"), "ranks")


def rank_report(metrics: DataFrame) -> DataFrame:
    """AG4: coverage at 3, 5, 10 on the worst rank, median and mean rank, recall at 5, ndcg at 5, misses."""
    rows = metrics.withColumn("recall5", F.size(F.filter("ranks", lambda r: r <= 5)) / F.col("n_gold")).withColumn("ndcg5", dates.ndcg(F.col("ranks"), F.col("n_gold"), 5))
    cover = lambda k: F.avg(F.when(F.col("worst_rank") <= k, 1.0).otherwise(0.0))
    return rows.agg(
        F.count("*").alias("n"), *[F.round(cover(k), 6).alias(f"coverage_{k}") for k in (3, 5, 10)],
        F.median("worst_rank").cast("double").alias("median_rank"), F.round(F.avg("worst_rank"), 6).alias("mean_rank"),
        F.round(F.avg("recall5"), 6).alias("recall_5"), F.round(F.avg("ndcg5"), 6).alias("ndcg_5"), F.count_if(F.col("worst_rank").isNull()).alias("misses"),
    )


def rollup_sets(df: DataFrame, a: str, b: str, values: list[Column]) -> DataFrame:
    """AG2, AG5, AG6: one pass for overall, by ``a`` and by ``b``; ``level`` names the set."""
    sets = df.groupingSets([[], [a], [b]], a, b).agg(F.grouping_id().alias("g"), *values)
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, a).otherwise(b)
    return sets.withColumn("level", level).withColumn("value", F.when(F.col("g") == 1, F.col(a).cast("string")).when(F.col("g") == 2, F.col(b).cast("string"))).drop("g", a, b)


def compactness(df: DataFrame, baseline: str, used: str) -> Column:
    """AG3: how many times smaller; null without tokens."""
    return F.when(F.col(used) > 0, F.col(baseline) / F.col(used))


def accuracy_report(judged: DataFrame) -> DataFrame:
    """AG11: accuracy a type, over all, and the mean of the types'."""
    by_type = judged.groupBy("question_type").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    types = by_type.select(F.col("question_type").alias("level"), "n", "right", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))
    total = by_type.agg(F.sum("n").alias("n"), F.sum("right").alias("right"), F.avg(F.col("right") / F.col("n")).alias("mean"))
    overall = total.select(F.lit("overall").alias("level"), "n", "right", F.round(F.col("right") / F.col("n"), 6).alias("accuracy"))
    averaged = total.select(F.lit("task averaged").alias("level"), "n", "right", F.round("mean", 6).alias("accuracy"))
    return types.unionByName(overall).unionByName(averaged)


def post_stratified(judged: DataFrame, population: DataFrame) -> DataFrame:
    """AG12: accuracy weighed by each stratum's population; strata of the sample unknown to the population fail."""
    strata = judged.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    joined = strata.join(population, "stratum", "left").withColumn("population", F.coalesce("population", F.raise_error(F.lit("unknown stratum")).cast("long")))
    return joined.agg(F.round(F.sum(F.col("population") * F.col("right") / F.col("n")) / F.sum("population"), 6).alias("estimate"), F.sum("n").alias("n"), F.sum("population").alias("population"))


def usage(calls: DataFrame) -> DataFrame:
    """AG13, AG15, AG28: calls, failures, tokens, mean latency a role; more than one model a role shows."""
    return calls.groupBy("role").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum("tokens").alias("tokens"), F.round(F.avg("latency"), 6).alias("latency"), F.countDistinct("model").alias("models"))


def call_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """AG14: roles of either side with both counts and whether they agree."""
    joined = expected.join(actual, "role", "full_outer")
    return joined.select("role", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("agrees", F.col("expected") == F.col("actual"))


def cost(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """AG16: cost a role and in all; the total is null if any price is missing."""
    rows = tokens.join(prices, "role", "left").withColumn("cost", F.col("tokens") * F.col("price") / 1_000_000)
    total = rows.agg(F.lit("total").alias("role"), F.sum("tokens").alias("tokens"), F.when(F.bool_and(F.col("price").isNotNull()), F.sum("cost")).alias("cost"))
    return rows.select("role", "tokens", "cost").unionByName(total).withColumn("cost", F.round("cost", 6))


def funnel(stages: DataFrame, gold: DataFrame, order: list[str]) -> DataFrame:
    """AG17, AG25: gold that each stage keeps a question; recall of no gold is 1."""
    kept = stages.groupBy("question_id", "stage").agg(F.collect_set("item").alias("items"))
    want = gold.groupBy("question_id").agg(F.collect_set("item").alias("gold"))
    grid = want.select("question_id", "gold", F.explode(F.array(*map(F.lit, order))).alias("stage"))
    joined = grid.join(kept, ["question_id", "stage"], "left").withColumn("matched", F.size(F.array_intersect("gold", F.coalesce("items", F.array().cast(dict(kept.dtypes)["items"])))))
    return joined.select("question_id", "stage", "matched", F.when(F.size("gold") == 0, 1.0).otherwise(F.col("matched") / F.size("gold")).alias("recall"), (F.col("matched") == F.size("gold")).alias("complete"))


def gate(summary: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """AG18: one row with a check for each threshold and the verdict."""
    checks = {name: F.col(name) >= least for name, least in thresholds.items()}
    verdict = F.lit(True)
    for c in checks.values():
        verdict = verdict & c
    return summary.select("*", *[c.alias(f"{n}_ok") for n, c in checks.items()], verdict.alias("passed"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AG20: the element at n // 2 of the sorted values, which for even n is not the median between."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("same"))  # only different values reach the window
    by = Window.partitionBy(*keys)
    rows = counts.withColumn("upto", F.sum("same").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.floor(F.sum("same").over(by) / 2))
    return rows.where((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("same"))).select(*keys, F.col(value).alias("upper_median"))


def coverage_class(n: Column, total: Column) -> Column:
    """AG21."""
    return F.when(n == 0, "none").when(n < total, "partial").otherwise("full")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """AG8, AG22: wins, losses and ties of ``b(question_id, correct)`` against ``a``."""
    joined = a.select("question_id", F.col("correct").alias("x")).join(b.select("question_id", F.col("correct").alias("y")), "question_id")
    return joined.agg(F.count_if(F.col("y") & ~F.col("x")).alias("wins"), F.count_if(F.col("x") & ~F.col("y")).alias("losses"), F.count_if(F.col("x") == F.col("y")).alias("ties"))


def flips(metrics: DataFrame, side: str, sides: list[str]) -> DataFrame:
    """AG9: a column a side, rows that differ only."""
    wide = metrics.groupBy("question_id").pivot(side, sides).agg(F.bool_and("complete"))
    return wide.where(~F.col(f"`{sides[0]}`").eqNullSafe(F.col(f"`{sides[1]}`")))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """FM4, AG7, AG24: nearest-rank percentiles."""
    kind = dict(df.dtypes)[value]
    return df.groupBy(*keys).agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").cast(kind).alias(f"p{round(p * 100)}") for p in ps])


def issues(found: dict[str, DataFrame]) -> DataFrame:
    """AG26: the sorted names of the checks that found a row, a question."""
    parts = [df.select("question_id", F.lit(name).alias("issue")) for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("question_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))


def forbidden_paths(leaves: DataFrame, names: list[str]) -> DataFrame:
    """AG27: leaves (id, pointer) with a forbidden key on their path."""
    return leaves.where(F.arrays_overlap(F.split("pointer", "/"), F.array(*map(F.lit, names))))


def macro_recall(metrics: DataFrame, keys: list[str], k: int = 12) -> DataFrame:
    """AG19: mean recall, hits within ``k`` and complete questions, for each subset."""
    recall = F.size(F.filter("ranks", lambda r: r <= k)) / F.col("n_gold")
    return metrics.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(recall), 6).alias("recall"), F.count_if(F.col("first_rank") <= k).alias("hits"), F.count_if("complete").alias("complete"))


def publication_problems(predictions: DataFrame, cases: DataFrame, text_column: str = "hypothesis") -> DataFrame:
    """SNK7: (question_id, problem): missing, unknown or repeated predictions, and such with a secret."""
    from ..functions import text

    p, c = predictions.select("question_id", text_column), cases.select("question_id")
    parts = {
        "missing": c.join(p, "question_id", "left_anti"),
        "unknown": p.join(c, "question_id", "left_anti"),
        "repeated": p.groupBy("question_id").count().where("count > 1"),
        "secret": p.where(text.has_secret(F.col(text_column))),
    }
    tagged = [df.select("question_id", F.lit(name).alias("problem")) for name, df in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3]).distinct()
