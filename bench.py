"""Time the headline queries once each after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from clausegrid.catalog import QUERIES  # noqa: E402
from clausegrid.session import build_session  # noqa: E402

HEADLINE = [
    "shared_clauses_with_trade", "pair_year_counts", "pair_year_weighted", "binary_presence", "pivot_panel",
    "panel_left_join", "panel_lag", "bilateral_totals", "join_dim_twice", "dedup_first", "clean_chain",
    "clean_stopwords", "dict_token_map", "clean_stem", "split_paragraphs", "split_sentences", "span_extract",
    "action_decompose", "bag_of_words", "topic_keywords", "sequence_encode", "map_country_codes",
    "edit_distance_pairs", "nearest_label", "knn_vote", "embed_text", "dbscan", "within_one_effect", "fe_ols_one_way",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("pair_year_counts", "elementwise_similarity_stats"):  # the second starts the Python workers
        QUERIES[warm](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
