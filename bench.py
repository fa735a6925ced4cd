"""Prints one JSON line with the seconds of the headline queries: one warm-up, then the median of two runs; of sequence_cells the only run."""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from lattica.operators.sampling import SamplerConfig
from lattica.plans.preprocess import preprocess
from lattica.registry import QUERIES
from lattica.sources.testdb import annotation
from lattica.streaming.batches import Sampler

SMALL = "/root/testdata/sf0.001"

NAMES = ["stats_numerical", "stats_ts_global", "vocab_categorical", "encode_timestamp15", "fk_edges", "csr_adjacency", "degree_stats", "task_num_lineitems_30d", "task_count_distinct", "split_assign", "neighbors_2hop_temporal", "sequence_cells"]
#: Read from the encoded database of the smallest tables, which preprocessing writes: batches a job makes.
BATCHES = 16


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in NAMES:
        times = []
        for i in range(3 if name != "sequence_cells" else 1):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i or name == "sequence_cells":
                times.append(time.time() - began)
        seconds[name] = round(statistics.median(times), 3)
    with tempfile.TemporaryDirectory() as at:
        began = time.time()
        database = preprocess(spark, SMALL, annotation(), f"{at}/db")
        seconds["preprocess_sf0.001"] = round(time.time() - began, 3)
        sampler = Sampler(database, SamplerConfig(batches_per_job=BATCHES))
        sampler.batches("train", 0, 1)
        began = time.time()
        sampler.batches("train", 1, BATCHES)
        seconds["train_batches_16_sf0.001"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
