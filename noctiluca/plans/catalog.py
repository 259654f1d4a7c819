"""All registered queries and their SQL counterparts."""

from noctiluca.plans import models, records, retrieval, sources, vectors
from noctiluca.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "models", "records", "retrieval", "sources", "vectors"]
