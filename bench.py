"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from lodestar import workload
from lodestar.session import local_session, ship

HEADLINE = [
    "flagship_context",
    "b02_html_to_text", "c01_chunk_semantic", "c02_chunk_fixed", "c03_chunk_tokens", "c05_pack_tokens", "c08_chunk_dual",
    "d01_embed", "d02_embed_cached", "a11_index_documents",
    "e01_knn_cosine", "e01_knn_documents", "e06_knn_in_blocks", "e08_knn_approx", "e09_hybrid_search",
    "f02_bm25_corpus", "f02_bm25_candidates", "f04_mmr", "f05_evaluate",
    "g03_fuse_weighted", "g04_fuse_ensemble", "g05_fuse_cascade", "g06_dedup_prefix",
    "h01_parse_triplets_strict", "h07_expand_seeds", "h09_graph_retrieve", "h11_connected_components", "h11_label_propagation", "h13_community_summaries",
    "i01_rank_tables", "i07_cache_store", "i09_fold_attempts", "l02_assemble_stream",
    "a09_upsert_orders", "j01_order_summary", "j02_product_sales", "j03_purchase_history", "j10_revenue_by_customer", "j13_broad_customers",
    "j14_revenue_share_by_region", "j15_monthly_growth", "k01_unique_line_keys", "k03_orphan_lines",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "lodestar-bench")
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    registry = workload.load()
    registry["j07_orders_by_region"].run(spark, folder).collect()  # Starts the JVM's compilers and the pools.
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(repeats):
            began = time.perf_counter()
            registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
