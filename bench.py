"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores. Each query runs twice; the second, warm run counts.
Results are written to the no-op sink, so every row is computed and none is gathered."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscan.plans import load  # noqa: E402
from folioscan.session import build_session  # noqa: E402

HEADLINE = (
    "j1_tfidf_scores", "j2_bm25_phrase", "j3_vector_scores", "j5_hybrid_rrf", "d17_doc_frequency", "d18_term_frequency",
    "i4_window_chunks", "i7_chunk_documents", "i8_chunk_parent_child", "h2_tokenize", "h7_html_text", "a9_read_html",
    "b4_search_library", "b5_scope_filter", "c2_resolve_links", "c3_broken_links", "c12_asset_new", "d3_revenue_by_month",
    "d4_revenue_totals", "d9_channel_summaries", "d11_stats_bundle", "d12_page_stats", "d13_tag_index", "d24_style_metrics",
    "e5_stack_expiry", "e9_session_digest", "e17_qa_pairs", "j18_upsert_page_index", "k2_monotone_changes",
    "k3_debounced_batches", "k8_order_lifecycle", "k13_rate_limit", "j7_search_scoped", "c18_related_qa", "j2_index_phrase",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = sys.argv[1:]
    spark = build_session(f"local[{cpus}]", int(cpus), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog, seconds = load(), {}
    for key in only or HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog[key].run(spark, folder).write.format("noop").mode("overwrite").save()
            seconds[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {seconds[key]}", file=sys.stderr, flush=True)
    name = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(name[2:]) if name.startswith("sf") else name}))
    spark.stop()


if __name__ == "__main__":
    main()
