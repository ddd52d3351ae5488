"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs whole, twice; the faster run counts. The given tables are one file with one row group
each, which a single task reads; before the clock starts they are stored again as one file per core,
as a larger table would lie, with the same rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from paragauge.catalog import fixtures  # noqa: E402
from paragauge.catalog.queries import QUERIES  # noqa: E402
from paragauge.session import local_session  # noqa: E402

TABLES = ["conversations", "documents"]

HEADLINE = [
    "split_exact", "split_hash", "training_shuffle", "training_text", "extract_answer",
    "tokenize_13a", "ngrams", "exact_match", "bleu_corpus", "rouge_mean", "rouge_lsum",
    "meteor_corpus", "bootstrap_ci", "metrics_report", "pivot_predictions",
    "conversation_render", "batch_generate",
]


def spread(spark, sf_dir: str, files: int) -> str:
    """The same tables as so many files each."""
    folder = tempfile.mkdtemp(prefix="paragauge-bench-")
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    name, sf_dir = Path(sf_dir).name, spread(spark, sf_dir, cores)
    pairs = fixtures.pairs(spark, sf_dir).count()
    predictions = fixtures.predictions(spark, sf_dir).count()
    QUERIES["metrics_report"](spark, sf_dir).collect()  # starts the Python workers

    seconds = {}
    for query in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[query] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": name.removeprefix("sf"),
                "files_per_table": cores,
                "pairs": pairs,
                "predictions": predictions,
                "report_rows_per_sec": round(predictions / seconds["metrics_report"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
