"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "rrf_hybrid", "bm25_topk", "keyword_logtf_topk", "weighted_fusion", "knn_cosine_topk", "exact_identifier_search", "ranked_budget_fill", "required_context",
    "relation_expand_outgoing", "relation_revalidate", "headings", "blocks", "entity_mentions", "reference_binding", "publish_blockers", "required_closure", "document_summary",
    "idempotent_ingest", "evidence_snapshot", "facet_split", "conflicts", "macro_summary", "percentiles", "job_state",
]


def main() -> None:
    from attestor.plans import REGISTRY
    from attestor.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n] or HEADLINE
    REGISTRY["rrf_hybrid"](spark, "/root/testdata/sf0.001").count()  # start workers and load classes
    seconds = {}
    for name in only:
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
