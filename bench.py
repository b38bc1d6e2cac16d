"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of cores. Each
query runs once to warm up and three times for its median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from corpusflow.queries import load
from corpusflow.session import local_session

HEADLINE = (
    "a1_dataset_stats", "f1_text_match", "f2_sentences", "p15_split_sections", "p20_tag_labels", "p26_parse_label_lines",
    "j4_reconcile", "j5_match_text", "j7_match_images", "j16_cache_stats", "a2_status_summary", "a8_corpus_bleu",
    "a9_rouge_ngrams", "a11_multilabel_summary", "a12_disaggregate", "a14_percentiles", "a16_paired_bootstrap_mean",
    "a20_phrase_profile", "a21_phrase_overlap", "w1_number_within", "w2_early_stop_fold", "w5_per_item_latency",
    "o1_top_k", "c9_sample_weighted", "c12_stage_balanced", "c13_dq_rules", "k2_fingerprint", "u4_dedupe_last",
    "a17_paired_bootstrap_corpus", "a9_rouge_l_documents", "a22_overlap_synthesis", "x1_stream_new_texts", "x2_stream_early_stop", "g5_score_distinct",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "spark": spark.version, "cores": cores,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "driver_memory": spark.conf.get("spark.driver.memory", None),
    }))


if __name__ == "__main__":
    main()
