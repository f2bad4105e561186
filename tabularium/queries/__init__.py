"""Registered queries, each with the SQL that gives the same rows."""

from tabularium.queries import calculation, contracts, covering, digests, evaluation, guarding, records, reranking, routing, search, selection, structures, tables

MODULES = (contracts, search, selection, evaluation, calculation, guarding, tables, records, routing, covering, digests, structures, reranking)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
