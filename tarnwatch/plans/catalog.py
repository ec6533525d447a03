"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from tarnwatch.plans import detector_queries, function_queries, mechanism_queries, package_queries, report_queries, rollup_queries, stream_queries, window_queries

QUERIES, ORACLE = {}, {}
for _m in (rollup_queries, window_queries, report_queries, detector_queries, package_queries, function_queries, stream_queries, mechanism_queries):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
