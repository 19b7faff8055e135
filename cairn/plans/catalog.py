"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import cases, evaluation, graph, grounded, lanes, reader, relational, retrieval, scalar, state, texts, versions

MODULES = [retrieval, evaluation, scalar, state, relational, graph, reader, versions, grounded, lanes, cases, texts]


def flagship(spark, sf_dir):
    return retrieval.session_ranks(spark, sf_dir)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: s for m in MODULES for name, s in m.SQL.items()}
