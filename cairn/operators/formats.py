"""FN26: packages, digests, retrieved spans, catalogues, indexes, facets and ledgers as text, a Column of arrays each.

Arrays come in the order in which they are shown, but a ledger's, which is put in order here. A null array is an empty one;
a null string inside an entry is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def or_else(c: Column, other: str) -> Column:
    """``other`` for null and empty strings."""
    return F.when(F.coalesce(c.cast("string"), F.lit("")) == "", F.lit(other)).otherwise(c.cast("string"))


def listed(entries: Column, block, between: str, none: str) -> Column:
    """The entries' blocks with ``between`` them, or ``none``; ``block(entry, index)``, index from 0."""
    return F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, F.array_join(F.transform(entries, block), between)).otherwise(F.lit(none))


def package_text(items: Column, shape: Column, boundary: Column, status: Column, risk: Column) -> Column:
    """A package: its header, then selected items, then supporting ones if there are any.

    ``items``: array of struct(session_id, date, turn_index, role, why, tier, text). The first item of each tier is number 2,
    as the texts that this must equal number them so. Without items, or with status ``none_found``, it says that none was found.
    """
    header = joined("queryShape: ", shape, "\nsetBoundary: ", boundary, "\ncandidateStatus: ", status, "\nmissingRisk: ", risk)

    def block(x: Column, i: Column) -> Column:
        why = F.when(F.coalesce(x.why, F.lit("")) != "", F.concat(F.lit("why: "), x.why, F.lit("\n"))).otherwise("")
        return joined("### item ", i + 2, "\nsession ", x.session_id, " | date ", x.date, " | turn ", x.turn_index, " | ", x.role, "\n", why, x.text)

    tier = lambda name: F.filter(items, lambda x: x.tier == name)
    supporting = listed(tier("supporting"), block, "\n\n", "")
    found = F.concat(
        header, F.lit("\n\n" + fixed.SELECTED_HEADING + "\n\n"), listed(tier("selected"), block, "\n\n", "(no selected turns)"),
        F.when(supporting != "", F.concat(F.lit("\n\n" + fixed.SUPPORTING_HEADING + "\n\n"), supporting)).otherwise(""),
    )
    nothing = (F.coalesce(status, F.lit("")) == "none_found") | (F.coalesce(F.size(items), F.lit(0)) <= 0)
    return F.when(nothing, F.concat(header, F.lit("\n\n" + fixed.NO_TURNS))).otherwise(found)


def digest_text(facts: Column, conflicts: Column, members: Column, omitted: Column) -> Column:
    """A digest: facts (id, date, session_id, turn_index, statement), conflicts (entity, fact_ids, note), members
    (member, date, fact_id) and, unless it is blank, what was left out."""
    turn = lambda x: F.when(x.session_id.isNull(), F.lit("session unknown")).otherwise(joined("session ", x.session_id, " | turn ", or_else(x.turn_index, "?")))
    fact = lambda x, i: joined("### ", x.id, "\ndate ", or_else(x.date, "unknown"), " | ", turn(x), "\n", x.statement)
    conflict = lambda x, i: joined("### conflict ", i + 1, "\nentity: ", x.entity, "\nfactIds: ", F.array_join(x.fact_ids, ", "), "\nnote: ", x.note)
    of = lambda x: F.when(F.coalesce(x.fact_id, F.lit("")) != "", F.concat(F.lit(" | factId "), x.fact_id)).otherwise("")
    member = lambda x, i: joined(i + 1, ". ", x.member, " (date ", or_else(x.date, "unknown"), of(x), ")")
    left = F.regexp_replace(F.coalesce(omitted, F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = [
        F.lit(fixed.FACTS_HEADING), listed(facts, fact, "\n\n", "(no facts extracted)"),
        F.lit(fixed.CONFLICTS_HEADING), listed(conflicts, conflict, "\n\n", "(none flagged)"),
        F.lit(fixed.MEMBERS_HEADING), listed(members, member, "\n", "(none flagged)"),
        F.when(left != "", F.concat(F.lit(fixed.OMITTED_HEADING + "\n"), left)),
    ]
    return F.concat_ws("\n\n", *parts)


def spans_text(spans: Column) -> Column:
    """Retrieved spans, each with all its turns: array of struct(session_id, date, start_turn, end_turn, turns), turns being
    an array of struct(turn_index, role, content)."""

    def block(x: Column, i: Column) -> Column:
        turn = lambda t: joined("[", t.role, " sessionId=", x.session_id, " turnIndex=", t.turn_index, "]\n", t.content)
        return joined("### session ", x.session_id, " | date ", x.date, " | turns ", x.start_turn, "-", x.end_turn, "\n", F.array_join(F.transform(x.turns, turn), "\n\n"))

    return listed(spans, block, "\n\n", fixed.NO_SPANS)


def select_catalogue(spans: Column, chars: int = 160) -> Column:
    """A line for each turn of the spans, with the first characters of what was said."""

    def lines(x: Column) -> Column:
        said = lambda t: F.substring(F.replace(t.content, F.lit("\n"), F.lit(" ")), 1, chars)
        return F.transform(x.turns, lambda t: joined("- sessionId=", x.session_id, " turnIndex=", t.turn_index, " date=", x.date, " role=", t.role, " :: ", said(t)))

    return listed(F.flatten(F.transform(spans, lines)), lambda x, i: x, "\n", "(no turns in retrieval bundle)")


def index_text(entries: Column) -> Column:
    """A session index: array of struct(session_id, date, opener, terms)."""
    terms = lambda x: F.when(F.coalesce(F.size(x.terms), F.lit(0)) > 0, F.array_join(x.terms, ", ")).otherwise("n/a")
    return listed(entries, lambda x, i: joined("- sessionId=", x.session_id, " | date ", x.date, "\n  opener: ", x.opener, "\n  terms: ", terms(x)), "\n", "(no sessions)")


def facets_text(facets: Column) -> Column:
    """A plan's facets: array of struct(id, kind, required, description, terms); no facets, no text."""
    return listed(facets, lambda x, i: joined(x.id, " [", x.kind, "] required=", x.required, ": ", x.description, " | terms=", F.array_join(x.terms, ", ")), "\n", "")


def ledger_text(entries: Column, most: int = 4) -> Column:
    """A ledger: array of struct(session_id, date, score, facet_ids, excerpts), the best first, of equal ones by id."""
    order = lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.session_id < b.session_id, -1).when(a.session_id > b.session_id, 1).otherwise(0)
    told = lambda x: F.array_join(F.transform(F.slice(x.excerpts, 1, most), lambda e: F.concat(F.lit("- "), e)), "\n")
    block = lambda x, i: joined(x.session_id, " date=", or_else(x.date, "(unknown)"), " best_score=", F.format_string("%.3f", x.score), " searched_facets=[", F.array_join(x.facet_ids, ","), "]\n", told(x))
    return listed(F.array_sort(entries, order), block, "\n\n", "(empty)")


def span_bundles(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """``spans(question_id, session_id, start_turn, end_turn, best_rank)`` -> (question_id, spans): the array ``spans_text`` takes.

    Spans stand by best rank, then session and start. A span's turns are found by an equi-join on its session, and a question's
    spans are as many as its retrieval kept.
    """
    t = turns.select("session_id", "date", "turn_index", "role", "content")
    held = spans.join(t, "session_id").where(F.col("turn_index").between(F.col("start_turn"), F.col("end_turn")))
    said = held.groupBy("question_id", "best_rank", "session_id", "start_turn", "end_turn").agg(F.first("date").alias("date"), F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))).alias("turns"))
    return said.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("best_rank", "session_id", "start_turn", "end_turn", "date", "turns"))).alias("spans"))
