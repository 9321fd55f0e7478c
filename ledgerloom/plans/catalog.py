"""Every registered query of the library proper, with its SQL counterpart where there is one."""

from __future__ import annotations

from . import grammar_queries, layout_queries, money_queries, record_queries, relational_queries, resolve_queries, text_queries, vector_queries  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
