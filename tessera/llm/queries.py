"""The queries of the problems in this folder, and the SQL that checks those SQL can express."""

from __future__ import annotations

from . import q_abuse, q_budget, q_encode, q_groups, q_langid, q_lines, q_pack, q_scans, q_split

QUERIES: dict = {}
SQL: dict = {}
for _module in (q_langid, q_split, q_groups, q_lines, q_budget, q_scans, q_encode, q_pack, q_abuse):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
