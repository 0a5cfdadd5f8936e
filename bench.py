"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated name
parts, default the headline set, ``all`` for every query). Each query is run once to warm up and then timed;
the result goes to the ``noop`` sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dataset_build_m8,dataset_build_aspects_m8_j2,exact_dedup_w1,normalized_dedup_w2_p14,clean_text_p2,"
    "sentence_sentiment_a1_j1,stratified_split_w3,sample_per_language_w5,oversample_a9_j7,"
    "quality_findings_a16,balance_report_a11_a12_a14,classification_report_a18,fairness_payload_a25_a23,"
    "linear_scorer_m2,batch_scorer_m1,aspect_extraction_m3_t4,token_attribution_m6,language_detect_p9,"
    "error_ratio_r5,latency_quantiles_r9,high_error_rate_r12_w9,preceding_user_j6,latency_summary_a34"
)


def main() -> None:
    from labelflow.catalog import QUERIES
    from labelflow.session import get_spark

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    # each test table is one row group, which a scan gives to one task
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.labelflow.inputPartitions": cpus}
    spark = get_spark(f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, fn in QUERIES.items():
        if wanted != ["all"] and not any(w and w in name for w in wanted):
            continue
        for _ in range(2):
            start = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
