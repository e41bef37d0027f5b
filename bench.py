"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose the data and the cores. One small query warms the session up; then each
query runs ``RUNS`` times, written to the no-op sink so that nothing is collected, and
its median counts. Times include planning, code generation and the jobs that learn
statistics. ``large_plans`` are single runs with the settings that large tables
bring about: several blocks per capture, several buckets per class, and order
statistics found digit by digit. They are no part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "w21_packet_features", "w22_flow_summary", "w20_two_stream_statistics", "s08_balanced_dataset",
    "s11_stratified_split", "f16_engineer", "m02_anova_f", "t03_text_table", "t04_instruction_record",
    "v05_metrics_table",
]
RUNS = 3


def large_plans(spark, sf_dir: str) -> dict:
    from flowloom import schemas as S
    from flowloom.operators import packets as W
    from flowloom.operators import sampling as SP
    from flowloom.operators import statistics as ST
    from flowloom.plans.fixtures import packets
    from flowloom.plans.sampling_queries import clean_flows

    def exact_quantiles():
        df = clean_flows(spark, sf_dir)
        columns = S.FEATURES[:8]
        counts = ST.value_counts(df, columns)
        ST.order_statistics(df, {c: [counts[c] // 2] for c in columns}, counts, exact_values=1)

    def save(df):
        df.write.format("noop").mode("overwrite").save()

    return {
        "w21_blocks_of_100": lambda: save(W.packet_features(packets(spark, sf_dir), block_rows=100)),
        "s11_buckets_of_10000": lambda: save(SP.stratified_split(clean_flows(spark, sf_dir), "flow_id", rows_per_bucket=10_000)),
        "g04_medians_by_digits": exact_quantiles,
    }


def seconds_of(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    from flowloom.plans.catalog import QUERIES
    from flowloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, **{"spark.sql.shuffle.partitions": cpus})
    seconds = {}
    QUERIES["w22_flow_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        seconds[name] = median(
            seconds_of(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()) for _ in range(RUNS))
        print(name, seconds[name], file=sys.stderr, flush=True)
    large = {name: seconds_of(run) for name, run in large_plans(spark, sf_dir).items()}
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "large_plans": large, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
