"""Registered queries over the driver's tables."""

from attestor.plans import decisions, governance, lifecycle, response, retrieval, structuring

REGISTRY = {**retrieval.QUERIES, **structuring.QUERIES, **governance.QUERIES, **decisions.QUERIES, **response.QUERIES, **lifecycle.QUERIES}
