"""Stages that a model may fill (X1-X13): typed contracts, and the deterministic default where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: What each stage returns, as a schema.
CONTRACTS = {
    "annotate": "session_id string, facts array<struct<text:string,turn_index:int>>, keyphrases array<string>, events array<struct<text:string,date_hint:string,turn_index:int>>",
    "plan": "question_id long, facets array<struct<facet_id:string,kind:string,required:int>>, lanes array<struct<query:string,facet_ids:array<string>>>",
    "admit": "question_id long, session_id long, position int",
    "assess": "question_id long, session_id long, label string, facets array<string>",
    "hop": "question_id long, hop int, tool string, argument string",
    "select": "question_id long, shape string, items array<struct<session_id:long,turn_index:long>>, expand array<long>",
    "extract": "session_id long, claims array<struct<text:string,turn_index:int>>",
    "digest": "question_id long, facts array<string>, conflicts array<array<string>>, members array<string>, omitted string",
    "answer": "question_id long, hypothesis string, evidence array<struct<session_id:long,turn_index:long>>, support string",
    "update": "case_id long, seq long, pointer string, kind string, mode string, value string",
    "consolidate": "case_id long, seq long, operation string, payload string",
    "judge": "question_id long, correct boolean",
    "date_range": "question_id long, inferred boolean, lo date, hi date",
}


@dataclass(frozen=True)
class Stage:
    """A named stage: ``run`` takes a table and returns one of the contract's schema, checked by name and type."""

    name: str
    run: Callable[[DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        out = self.run(df)
        want = T._parse_datatype_string(CONTRACTS[self.name])
        if out.schema.simpleString() != want.simpleString():
            raise TypeError(f"stage {self.name}: {out.schema.simpleString()} is not {want.simpleString()}")
        return out


def plan_default(queries: DataFrame) -> DataFrame:
    """X2 without a model: one facet and the question as its only lane."""
    facet = F.struct(F.lit("f1").alias("facet_id"), F.lit("topic").alias("kind"), F.lit(1).alias("required"))
    lane = F.struct(F.col("question").alias("query"), F.array(F.lit("f1")).alias("facet_ids"))
    return queries.select("question_id", F.array(facet).alias("facets"), F.array(lane).alias("lanes"))


def extract_default(turns: DataFrame, chars: int = 400) -> DataFrame:
    """X7 without a model: each user turn, clipped, is a claim."""
    claims = F.array_sort(F.collect_list(F.struct(F.col("turn_index").cast("int").alias("turn_index"), text.clip(F.col("content"), chars).alias("text"))))
    rows = turns.where("role = 'user'").groupBy("session_id").agg(claims.alias("c"))
    return rows.select("session_id", F.transform("c", lambda x: F.struct(x.text.alias("text"), x.turn_index.alias("turn_index"))).alias("claims"))


def judge_default(answers: DataFrame) -> DataFrame:
    """X12 without a model: right if the reply names yes."""
    return answers.select("question_id", F.contains(F.lower("reply"), F.lit("yes")).alias("correct"))


DEFAULTS = {"plan": Stage("plan", plan_default), "extract": Stage("extract", extract_default), "judge": Stage("judge", judge_default)}
