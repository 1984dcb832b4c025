"""Times the headline queries, warm, and prints one JSON line. BENCH_SF_DIR: the tables; BENCH_CPUS: local threads; BENCH_RUNS: timed runs of each after a first one, of which the median counts; the training-data operators are timed once after it."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

from veritab.operators import completeness, distribution, schemas, uniqueness
from veritab.plans import catalogue
from veritab.plans.checks import run
from veritab.plans.profile import profile

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def baseline() -> dict:
    """The suites that the baseline file names, over customer."""
    people = lambda s, d: s.read.parquet(f"{d}/customer.parquet")
    null, unique = [completeness.null(["c_custkey", "c_name"])], [uniqueness.unique("c_custkey")]
    spread = [distribution.between("c_acctbal", -1000, 10_000)]
    shape = [schemas.table_schema({"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"})]
    suites = {"local_null": null, "local_range": spread, "local_schema": shape, "local_unique": unique, "local_mixed_core_suite": [*null, *spread, *unique, *shape]}
    return {name: (lambda s, d, c=checks: run(people(s, d), c)) for name, checks in suites.items()}


def ten_million() -> dict:
    """The published targets are stated for ten million rows: lineitem, repeated that often."""

    def rows(spark: SparkSession, folder: str):
        table = spark.read.parquet(f"{folder}/lineitem.parquet")
        return spark.range(-(-10_000_000 // table.count())).select().join(table, how="cross")

    suite = [completeness.null(["l_orderkey", "l_quantity"]), distribution.between("l_discount", 0, 1), distribution.positive("l_quantity")]
    return {
        "check_10m": lambda s, d: run(rows(s, d), suite),
        "profile_10m": lambda s, d: profile(rows(s, d), ["l_quantity", "l_extendedprice", "l_returnflag"], approximate=True),
    }


HEADLINE = (
    "flagship_suite", "duplicate", "referential_integrity", "foreign_key", "primary_key", "profile", "entropy", "information_gain", "distribution_shape", "psi", "ks_test", "wasserstein_drift", "outlier",
    "zscore_multivariate", "mahalanobis", "pii_in_text", "mask_redact", "tumbling_window", "session_window", "increasing", "timeseries_gap", "window_aggregate", "multi_table_aggregate", "cube", "geo_distance",
    "get_quantiles", "iqr_anomaly", "autocorrelation", "k_nearest_points", "count_min_sketch", "incremental_profile", "source_csv", "stream_checks",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalogue.queries()
    chosen = baseline() | ten_million() | {name: known[name] for name in HEADLINE}
    if Path(__file__).with_name("veritab").joinpath("llm").is_dir():
        from veritab.llm.queries import queries

        chosen |= {name: f for name, f in queries().items()}
    took = {}
    for name, query in chosen.items():
        times = []
        for _ in range(1 + (RUNS if not name.startswith("op") else 1)):
            began = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(SF_DIR).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
