"""Benchmark of the headline queries: one JSON line, seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# The first run of a query also compiles its code; the faster of two runs counts. Searches read the stored chunk table and
# keyword index, which the first one of a session writes; chunk_fixed, embed_chunks and keyword_index time that work.
RUNS = 2
HEADLINE = (
    "normalize_articles", "insert_if_absent", "recent_articles",
    "shingles", "minhash_signature", "near_dup_filter", "near_dup_pairs_verified",
    "chunk_recursive", "chunk_fixed", "embed_chunks",
    "vector_topk", "keyword_index", "keyword_topk", "hybrid_search", "rerank_topn",
    "fuzzy_terms", "route_queries", "web_context", "parallel_context", "answer_rows",
    "log_level_counts", "query_log", "trending_topics", "daily_log_index",
)


def main() -> None:
    from articleflow.session import local_session
    from catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    # One untimed small run starts the JVM's and the Python workers' machinery.
    spark.range(1000).repartition(int(cpus) if cpus.isdigit() else 8).mapInArrow(lambda it: it, "id long").count()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
