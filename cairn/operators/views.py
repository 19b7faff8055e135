"""RK8, RK9: several views of every session searched by several lanes in one pass of postings, fused with facets and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, fixed, text
from .rank import best, ranked

#: Postings of a term beyond which the term is dealt over SALTS tasks.
HOT, SALTS = 100_000, 32
POOL, HITS = 24, 10


def lane_hits(docs: DataFrame, lanes: DataFrame, k: int | None = HITS, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, boost: float = fixed.TEMPORAL_BOOST, within: tuple[str, ...] = ()) -> DataFrame:
    """``docs(view, session_id, text)`` against ``lanes(question_id, lane, query)``: the ``k`` best of each lane in each view.

    A view is an index of its own, with its own number, mean length and document frequencies. Documents are cut into terms
    once for all views, lanes and questions; a posting is weighed before it meets the lanes that ask for its term, and
    terms with many postings are dealt over several tasks. Columns ``within`` of both sides part the documents further: a lane
    searches only those of its own case, which are indexes of their own.
    Rows: ``within``, question_id, lane, view, session_id, score, matched, terms, rank.
    """
    of = list(within)
    toks = docs.select(*of, "view", "session_id", text.tokens(F.col("text")).alias("toks"))
    stats = toks.groupBy(*of, "view").agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avg_len"))
    asked = lanes.select(*of, "question_id", "lane", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term"))
    terms = asked.select(*of, "term").distinct()
    held = toks.select(*of, "view", "session_id", F.size("toks").alias("len"), F.explode("toks").alias("term")).join(terms, [*of, "term"], "left_semi")
    postings = held.groupBy(*of, "view", "session_id", "len", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy(*of, "view", "term").agg(F.count("*").alias("df"))
    hot = df.groupBy(*of, "term").agg(F.sum("df").alias("all")).withColumn("salts", F.when(F.col("all") > HOT, SALTS).otherwise(1)).drop("all")
    weighed = postings.join(df, [*of, "view", "term"]).join(hot, [*of, "term"])
    weighed = weighed.join(stats, [*of, "view"]) if of else weighed.join(F.broadcast(stats), "view")  # a row a view
    dated = F.array_contains(text.words(fixed.TEMPORAL_WORDS), F.col("term")) | F.col("term").rlike("[0-9]")
    share = dates.bm25_idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))) + F.when(dated, boost).otherwise(0.0)
    weighed = weighed.select(*of, "term", F.pmod(F.xxhash64("view", "session_id"), F.col("salts")).alias("salt"), "view", "session_id", share.alias("share"))
    dealt = asked.join(hot, [*of, "term"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")
    scored = dealt.join(weighed, [*of, "term", "salt"]).groupBy(*of, "question_id", "lane", "view", "session_id").agg(F.sum("share").alias("score"), F.count("*").alias("matched"), F.array_sort(F.collect_list("term")).alias("terms"))
    return scored if k is None else ranked(scored, [*of, "question_id", "lane", "view"], [best("score"), F.desc("matched"), F.asc("session_id")], k)


def pooled(hits: DataFrame, lanes: DataFrame, top: int = POOL) -> DataFrame:
    """Sessions by the sum of 1 / (60 + rank) over all views and lanes; of equal ones those with more facets first, then by id.

    ``lanes(question_id, lane, query, facet_ids)``. Rows: question_id, session_id, score, facets, terms, ranks, rank.
    """
    rows = hits.join(lanes.select("question_id", "lane", "facet_ids"), ["question_id", "lane"])
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    place = F.struct("lane", "view", "rank")
    fused = rows.groupBy("question_id", "session_id").agg(F.sum(1 / (fixed.RRF_K + F.col("rank"))).alias("score"), every("facet_ids").alias("facets"), every("terms").alias("terms"), F.array_sort(F.collect_list(place)).alias("ranks"))
    return ranked(fused, ["question_id"], [best("score"), F.size("facets").desc(), F.asc("session_id")], top)


def cut(c: Column, n: int) -> Column:
    """Single spaces, ``n`` characters at most, the last one an ellipsis if any are left out."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))


def lines_of(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """What excerpts are made of: (view, session_id, line_no, line, toks); toks of a turn are those of its content alone.

    ``notes(session_id, facts, events, keyphrases)``: facts first, then events, then phrases.
    """
    head = F.concat(F.upper("role"), F.lit(" turn "), F.col("turn_index").cast("string"), F.lit(": "))
    said = turns.select(F.explode(F.array("role", F.lit("all"))).alias("view"), "session_id", F.col("turn_index").cast("long").alias("line_no"), F.concat(head, cut(F.col("content"), 260)).alias("line"), text.tokens(F.col("content")).alias("toks"))
    at = lambda x: F.concat(F.lit("USER turn "), x.turn_index.cast("string"))
    some = lambda c: F.coalesce(c, F.array())
    facts = F.transform("facts", lambda x: F.concat(at(x), F.lit(": "), x.text))
    events = F.transform("events", lambda x: F.concat(at(x), F.lit(" event"), F.when(x.date_hint != "", F.concat(F.lit(" ("), x.date_hint, F.lit(")"))).otherwise(""), F.lit(": "), x.text))
    phrases = F.transform("keyphrases", lambda x: F.concat(F.lit("keyphrase: "), x))
    noted = notes.select("session_id", F.posexplode(F.concat(some(facts), some(events), some(phrases))).alias("line_no", "line"))
    return said.unionByName(noted.select(F.lit("notes").alias("view"), "session_id", F.col("line_no").cast("long").alias("line_no"), "line", text.tokens(F.col("line")).alias("toks")))


def excerpts(hits: DataFrame, lanes: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each hit its session's lines that share most tokens with the lane's query, three turns or four notes, as one text.

    Lines are cut into tokens once, and meet only the hits on their session and view; ties go by place. A hit whose view has no
    line in the session says so. Rows: question_id, session_id, lane, view, excerpt.
    """
    asked = lanes.select("question_id", "lane", F.array_distinct(text.tokens(F.col("query"))).alias("ask"))
    rows = hits.select("question_id", "lane", "view", "session_id").join(asked, ["question_id", "lane"]).join(lines, ["view", "session_id"], "left")
    overlap = F.size(F.filter(F.coalesce("toks", F.array().cast("array<string>")), lambda t: F.array_contains("ask", t)))
    of = ["question_id", "session_id", "lane", "view"]
    order = Window.partitionBy(*of).orderBy(overlap.desc(), "line_no")
    few = rows.select(*of, "line", F.row_number().over(order).alias("place")).where(F.col("place") <= F.when(F.col("view") == "notes", 4).otherwise(3))
    joined = few.groupBy(*of).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x.line), " | ").alias("said"))
    none = F.when(F.col("view") == "notes", "(no structured notes)").otherwise(F.concat(F.lit("(no "), "view", F.lit(" evidence)")))
    return joined.select(*of, F.concat("view", F.lit(": "), F.when(F.col("said") == "", none).otherwise(cut(F.col("said"), 360))).alias("excerpt"))


def catalogue(pool: DataFrame, said: DataFrame, days: DataFrame, heading: str = "candidate", views: tuple[str, ...] = ("notes", "user", "assistant", "all"), most: int = 6) -> DataFrame:
    """FN26: a question's pool as text, a block a candidate in order, with its first ``most`` different excerpts."""
    place = F.array_position(F.array(*map(F.lit, views)), F.col("view"))
    first = said.groupBy("question_id", "session_id", "excerpt").agg(F.min(F.struct(place.alias("v"), "lane")).alias("at"))
    told = first.groupBy("question_id", "session_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "excerpt"))), lambda x: F.concat(F.lit("- "), x.excerpt)), 1, most).alias("lines"))
    rows = pool.join(told, ["question_id", "session_id"], "left").join(days.select("session_id", "date").distinct(), "session_id", "left")
    block = F.concat(
        F.lit(heading + " "), F.col("rank").cast("string"), F.lit(": "), F.col("session_id").cast("string"), F.lit(" date="), F.when(F.coalesce("date", F.lit("")) == "", "(unknown)").otherwise(F.col("date")),
        F.lit(" fused="), F.format_number("score", 4), F.lit(" suggested_facets=["), F.array_join("facets", ","), F.lit("]\n"), F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n"),
    )
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x.block), "\n\n").alias("catalogue"))


def lanes_of(questions: DataFrame, queries: DataFrame) -> DataFrame:
    """Lane 0 is the question with all facets of its plan; the others are ``queries(question_id, lane, query, facet_ids)``."""
    all_ = queries.groupBy("question_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("facet_ids")))).alias("facet_ids"))
    own = questions.join(all_, "question_id", "left").select("question_id", F.lit(0).cast("long").alias("lane"), F.col("question").alias("query"), F.coalesce("facet_ids", F.array().cast("array<string>")).alias("facet_ids"))
    return own.unionByName(queries.select("question_id", F.col("lane").cast("long").alias("lane"), "query", "facet_ids"))


def view_documents(turns: DataFrame, notes: DataFrame) -> DataFrame:
    """DB4, DB5: (view, session_id, text) of the four views of each session."""
    from . import windows

    days = turns.select("session_id", "date").distinct()
    parts = [windows.notes_documents(notes, days).select(F.lit("notes").alias("view"), "session_id", "text")]
    parts += [windows.role_view(turns, role).select(F.lit(role or "all").alias("view"), "session_id", "text") for role in ("user", "assistant", None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])

