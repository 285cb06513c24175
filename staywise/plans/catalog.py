"""All registered queries.  Importing the query modules fills the registry."""

from __future__ import annotations

from staywise.plans import q_features, q_history, q_io, q_metrics, q_model, q_more, q_round2, q_store, q_stream, q_train  # noqa: F401
from staywise.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
