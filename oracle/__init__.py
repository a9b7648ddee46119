"""SQL twins of the registered queries, for DuckDB."""

from oracle import decisions, governance, lifecycle, response, retrieval, structuring

ORACLES = {**retrieval.ORACLES, **structuring.ORACLES, **governance.ORACLES, **decisions.ORACLES, **response.ORACLES, **lifecycle.ORACLES}
