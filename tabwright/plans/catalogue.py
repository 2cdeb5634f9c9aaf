"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from tabwright.plans import queries_clean, queries_explore, queries_load, queries_shape

QUERIES = {}
SQL = {}
for _family in (queries_load, queries_clean, queries_shape, queries_explore):
    QUERIES.update(_family.QUERIES)
    SQL.update(_family.SQL)

flagship = queries_explore.flagship
