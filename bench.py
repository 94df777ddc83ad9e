"""Headline queries on one folder; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from civicmill import plans  # noqa: E402
from civicmill.session import build_session  # noqa: E402

HEADLINE = (
    "B12_topic", "B15_lifecycle", "B19_event_route", "B20_refid_class", "B27_normalize_text", "C01_bill_records", "C07_nearest_book", "C11_companions", "C12_nearest",
    "C13_identity", "C16_peer_agreement", "C20_resolution_ladder", "D03_completeness", "D15_defection", "D17_party_inference", "D25_token_stats", "D30_meetings", "D39_accuracy_gates",
    "D42_group_digest", "D50_code_profile", "E01_position", "E04_state_machine", "E08_persuadability", "E12_activity_windows", "F03_feed", "F05_rarest_tokens", "G03_history_diff",
    "G06_change_feed", "I04_pair_verdict", "I07_feature_scores", "I12_naive_bayes", "I14_label_vote", "J02_outages", "J06_incremental",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = plans.load_all()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the engine outside the clock
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
