"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from weftline.plans import registry

HEADLINE = ("potts_energy", "local_fields", "icm_sweep", "site_patterns", "pruning_4taxa", "pruning_weighted", "sankoff_score", "jc_distance_matrix", "hmm_forward_2state", "transition_mle", "autocorrelation", "gmm_e_step", "negbin_loglik", "kmeans_cost", "syndrome")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline queries, sum of the better of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
