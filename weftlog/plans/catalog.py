"""All registered queries; importing the modules fills the registry."""

from weftlog.plans import ingest_queries, model_queries, session_queries, workflow_queries  # noqa: F401
from weftlog.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
