"""SP7, SP15: what a final answer is given: turns, facts, conflicts and graph values in one JSON envelope that never exceeds its bytes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

SESSIONS, FACTS, POINTERS = 8, 12, 12


@dataclass
class Chosen:
    """A reader's choice as tables. ``plans(question_id, support_status, answer_mode)``; ``selected(question_id, place, session_id,
    purpose, turn_index)``, a row a requested turn; ``cited(question_id, place, session_id, turn_index)``, the sources of selected
    pointers in order; ``facts(question_id, place, statement, session_ids, pointers)``; ``conflicts(question_id, place, body)`` and
    ``values(question_id, place, pointer, value, sources)`` with JSON bodies, value null where a pointer leads nowhere. Places count from 0."""

    plans: DataFrame
    selected: DataFrame
    cited: DataFrame
    facts: DataFrame
    conflicts: DataFrame
    values: DataFrame


def quoted(c: Column) -> Column:
    """A string as JSON."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def requests(c: Chosen, turns: DataFrame) -> DataFrame:
    """Every request for a turn of a session that exists, of the first SESSIONS of each question in order of first mention:
    question_id, seq, session_id, purpose, turn_index, n (turns of the session), date, home (the session's place)."""
    sizes = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.min("date").alias("date"))
    asked = c.selected.select("question_id", F.struct(F.lit(0).alias("p"), F.col("place").cast("long").alias("i")).alias("seq"), "session_id", "purpose", "turn_index")
    cited = c.cited.select("question_id", F.struct(F.lit(1).alias("p"), F.col("place").cast("long").alias("i")).alias("seq"), "session_id", F.lit("context").alias("purpose"), "turn_index")
    rows = asked.unionByName(cited).join(sizes, "session_id")
    first = rows.groupBy("question_id", "session_id").agg(F.min("seq").alias("first"))
    home = first.withColumn("home", F.row_number().over(Window.partitionBy("question_id").orderBy("first", "session_id"))).where(F.col("home") <= SESSIONS).drop("first")
    return rows.join(home, ["question_id", "session_id"])


def headers(asked: DataFrame) -> DataFrame:
    """(question_id, session_id, home, header): the JSON of a session up to its turns; purposes each once, as first named."""
    once = asked.groupBy("question_id", "session_id", "home", "date", "purpose").agg(F.min("seq").alias("seq"))
    rows = once.groupBy("question_id", "session_id", "home", "date").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "purpose"))), lambda x: x.purpose).alias("purposes"))
    text = F.concat(F.lit('{"sessionId":'), quoted(F.col("session_id").cast("string")), F.lit(',"date":'), quoted(F.col("date")), F.lit(',"purposes":'), F.to_json("purposes"), F.lit(',"turns":['))
    return rows.select("question_id", "session_id", "home", text.alias("header"))


def turn_items(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """The requested turns of each session, and their neighbours: (question_id, phase, a, b, id, session_id, body)."""
    steps = F.explode(F.array(*[F.struct((F.col("turn_index") + d).alias("t"), F.lit(d == 0).alias("own")) for d in (-1, 0, 1)]))
    near = asked.select("question_id", "session_id", "home", steps.alias("s")).groupBy("question_id", "session_id", "home", F.col("s.t").cast("long").alias("turn_index")).agg(F.bool_or("s.own").alias("own"))
    rows = near.join(turns.select("session_id", "turn_index", "role", "content"), ["session_id", "turn_index"])
    why = F.when(F.col("own"), "reader_selected").otherwise("adjacent_context")
    body = F.concat(F.lit('{"turnIndex":'), F.col("turn_index").cast("string"), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"content":'), quoted(F.col("content")), F.lit(',"selection":"'), why, F.lit('"}'))
    name = F.concat(F.lit("session:"), F.col("session_id").cast("string"), F.lit(":turn:"), F.col("turn_index").cast("string"))
    return rows.select("question_id", F.when(F.col("own"), 0).otherwise(1).alias("phase"), F.col("home").cast("long").alias("a"), F.col("turn_index").alias("b"), name.alias("id"), F.col("session_id").cast("string").alias("session_id"), body.alias("body"))


def items(c: Chosen, asked: DataFrame, turns: DataFrame) -> DataFrame:
    """All that a package may hold, in the order in which it is tried; ``body`` is null for what cannot be tried at all."""
    kept = asked.groupBy("question_id").agg(F.collect_set(F.col("session_id").cast("string")).alias("own"))  # at most SESSIONS
    known = c.values.where(F.col("place") < POINTERS).groupBy("question_id").agg(F.collect_set("pointer").alias("held"))
    none = F.array().cast("array<string>")
    facts = c.facts.where(F.col("place") < FACTS).join(kept, "question_id", "left").join(known, "question_id", "left")
    both = lambda given, held: F.filter(F.array_distinct(F.coalesce(given, none)), lambda x: F.array_contains(F.coalesce(held, none), x))
    facts = facts.select("question_id", "place", "statement", both(F.col("session_ids").cast("array<string>"), F.col("own")).alias("s"), both(F.col("pointers"), F.col("held")).alias("p"))
    void = (F.size("s") == 0) & (F.size("p") == 0)
    fact = F.concat(F.lit('{"statement":'), quoted(F.col("statement")), F.lit(',"sessionIds":'), F.to_json("s"), F.lit(',"graphPointers":'), F.to_json("p"), F.lit("}"))
    row = lambda df, phase, name, body: df.select("question_id", F.lit(phase).alias("phase"), F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), name.alias("id"), F.lit(None).cast("string").alias("session_id"), body.alias("body"))
    at = F.col("place").cast("string")
    value = F.concat(F.lit('{"pointer":'), quoted(F.col("pointer")), F.lit(',"value":'), "value", F.lit(',"sources":'), "sources", F.lit("}"))
    graph = F.concat(F.lit("graph:"), at, F.when(F.col("value").isNull(), ":unknown_pointer").otherwise(""))
    out = turn_items(asked, turns).unionByName(row(facts, 2, F.concat(F.lit("fact:"), at, F.when(void, ":unselected_source").otherwise("")), F.when(~void, fact)))
    out = out.unionByName(row(c.conflicts, 3, F.concat(F.lit("conflict:"), at), F.col("body")))
    return out.unionByName(row(c.values.where(F.col("place") < POINTERS), 4, graph, value))


def envelope(support: Column, mode: Column, facts: Column, conflicts: Column, graph: Column, sessions: Column) -> Column:
    return F.concat(
        F.lit('{"schemaVersion":1,"readerDecision":{"supportStatus":'), quoted(support), F.lit(',"answerMode":'), quoted(mode), F.lit('},"evidenceFacts":['), facts,
        F.lit('],"conflicts":['), conflicts, F.lit('],"graphEvidence":['), graph, F.lit('],"sessions":['), sessions, F.lit("]}"),
    )


def evidence_packages(c: Chosen, turns: DataFrame, budget: int = fixed.PACKAGE_BYTES) -> DataFrame:
    """A package for each plan: question_id, payload (JSON), bytes, token_estimate, omitted (ids), problem.

    Requested turns come first, then their neighbours, facts, conflicts and graph values; each is put in whole if the whole
    envelope with it stays within ``budget`` UTF-8 bytes, else left out by name, and the next is tried. The first turn of a
    session pays for the session's head. A plan whose empty envelope is too large has a problem and no payload.

    The fold runs in the JVM over sizes, one row a question (at most SESSIONS sessions, FACTS facts and POINTERS values, and the
    plan's conflicts); bodies are put together only of what was kept.
    """
    if budget < 1:
        raise ValueError("the byte budget must be positive")
    asked = requests(c, turns).persist()
    heads = headers(asked)
    tried = items(c, asked, turns)
    head = heads.select("question_id", F.col("session_id").cast("string").alias("session_id"), "home", "header")
    rows = tried.join(head, ["question_id", "session_id"], "left").persist()  # sizes are read first, then the bodies of what is kept
    size = F.struct("phase", "a", "b", "id", "session_id", F.coalesce(F.octet_length("header") + 2, F.lit(0)).alias("head"), F.octet_length("body").alias("bytes"))
    lists = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(size)).alias("todo"))
    blank = F.lit("")
    priced = c.plans.join(lists, "question_id", "left").withColumn("base", F.octet_length(envelope(F.col("support_status"), F.col("answer_mode"), blank, blank, blank, blank)).cast("long"))
    none = F.array().cast("array<string>")
    start = F.struct(F.col("base").alias("total"), none.alias("sessions"), F.array().cast("array<int>").alias("lists"), none.alias("kept"), none.alias("omitted"))

    def add(held: Column, x: Column) -> Column:
        turn = x.phase < 2
        new = turn & ~F.array_contains(held.sessions, x.session_id)
        comma = F.when(new, F.size(held.sessions) > 0).otherwise(turn | F.array_contains(held.lists, x.phase)).cast("int")
        total = held.total + x.bytes + comma + F.when(new, x["head"]).otherwise(0)
        fits = F.coalesce(total <= budget, F.lit(False))
        more = lambda yes, array, value: F.when(yes, F.concat(array, F.array(value))).otherwise(array)
        return F.struct(
            F.when(fits, total).otherwise(held.total).alias("total"), more(fits & new, held.sessions, x.session_id).alias("sessions"), more(fits & ~turn, held.lists, x.phase).alias("lists"),
            more(fits, held.kept, x.id).alias("kept"), more(~fits, held.omitted, x.id).alias("omitted"),
        )

    empty = F.array().cast("array<struct<phase:int,a:bigint,b:bigint,id:string,session_id:string,head:int,bytes:int>>")
    folded = priced.withColumn("f", F.aggregate(F.coalesce("todo", empty), start, add)).select("question_id", "support_status", "answer_mode", "base", "f.*").persist()
    kept = folded.select("question_id", F.posexplode("kept").alias("place", "id")).join(rows, ["question_id", "id"])
    listed = lambda order, value, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), between)
    blocks = kept.where("phase < 2").groupBy("question_id", "session_id", "header").agg(F.min("place").alias("place"), listed("place", "body", ",").alias("said"))
    blocks = blocks.withColumn("block", F.concat("header", "said", F.lit("]}"))).groupBy("question_id").agg(listed("place", "block", ",").alias("sessions_json"))
    parts = kept.where("phase > 1").groupBy("question_id").pivot("phase", [2, 3, 4]).agg(listed("place", "body", ","))
    done = folded.drop("sessions", "lists").join(blocks, "question_id", "left").join(parts, "question_id", "left")
    of = lambda name: F.coalesce(F.col(name), blank)
    large = F.col("base") > budget
    payload = F.when(~large, envelope(F.col("support_status"), F.col("answer_mode"), of("2"), of("3"), of("4"), of("sessions_json")))
    return done.select(
        "question_id", payload.alias("payload"), F.when(~large, F.col("total")).alias("bytes"), F.when(~large, F.ceil(F.col("total") / fixed.CHARS_PER_TOKEN)).alias("token_estimate"), "omitted",
        F.when(large, "byte budget cannot fit the package envelope").alias("problem"),
    )
