"""All queries of the engine, collected from the plan modules."""

from __future__ import annotations


def _modules() -> list:
    from . import evaluation_plans, graph_plans, report_plans, rule_plans, source_plans, token_plans

    return [rule_plans, token_plans, evaluation_plans, report_plans, graph_plans, source_plans]


def queries() -> dict:
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _modules():
        out |= m.ORACLES
    return out
