"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from markscope.plans import extended, extended_oracle, oracle, queries

QUERIES = {**queries.QUERIES, **extended.QUERIES}
ORACLE = {**oracle.ORACLE, **extended_oracle.ORACLE}
