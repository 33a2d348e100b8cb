"""All registered queries: name -> (callable(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations


def all_queries() -> dict:
    from . import q_checks, q_clean, q_cluster, q_graph, q_more, q_pareto, q_profile
    out = {}
    for mod in (q_pareto, q_clean, q_profile, q_cluster, q_graph, q_more, q_checks):
        out.update(mod.QUERIES)
    return out
