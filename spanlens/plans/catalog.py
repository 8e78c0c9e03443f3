"""The library's registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import corpus_queries, detect_queries, engine_queries, evaluation_queries, judge_eval_queries, judge_queries, layout_queries, mention_queries, metric_queries, propose_queries, question_queries, table_queries

_PARTS = (detect_queries, metric_queries, evaluation_queries, judge_queries, propose_queries, question_queries, corpus_queries, engine_queries, table_queries, layout_queries, mention_queries, judge_eval_queries)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL: dict[str, str] = {name: q for part in _PARTS for name, q in part.SQL.items()}
