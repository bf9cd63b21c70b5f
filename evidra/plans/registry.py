"""Registered queries: name, DataFrame form and DuckDB form."""

from __future__ import annotations

from evidra.plans import evidence_queries, file_queries, naming_queries, pieces_queries, resampling_queries, rescue_queries, sample_queries, study_queries, summary_queries

FLAGSHIP = "evidence"
QUERIES, ORACLES = {}, {}
for plans in (evidence_queries, sample_queries, study_queries, file_queries, naming_queries, rescue_queries, resampling_queries, pieces_queries, summary_queries):
    QUERIES |= plans.QUERIES
    ORACLES |= plans.ORACLES
