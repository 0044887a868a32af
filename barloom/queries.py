"""All panel queries and their SQL for DuckDB."""

from __future__ import annotations

from barloom.plans import diagnostic_queries, evaluation_queries, feature_queries, formula_queries, indicator_queries, model_queries, panel_queries, research_queries, series_queries, signal_queries, store_queries, stored_queries, strategy_queries, stream_queries, summary_queries, tick_queries

MODULES = (indicator_queries, panel_queries, research_queries, formula_queries, store_queries, stream_queries, strategy_queries, feature_queries, diagnostic_queries, series_queries, model_queries, evaluation_queries, tick_queries, stored_queries, summary_queries, signal_queries)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
