"""Reproduce the skew measurements quoted in README.md and PLANS.md.

Usage: python tools/skew_probe.py [sf_dir]   (default sf0.1)

Updates are derived from ``lineitem``: ``seq = l_orderkey * 8 + l_linenumber``,
and every third order's lines go to one metric id ("hot"), so a single key holds
a third of all rows. Each variant runs into the ``noop`` sink after a warm-up; best of two runs.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallyfold.operators import dedup, running  # noqa: E402
from tallyfold.session import local_session  # noqa: E402


def timed(name: str, df: DataFrame) -> None:
    best = float("inf")
    for _ in range(2):
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t0)
    print(f"{name:28s} {best:6.2f} s", flush=True)


def main(argv: list[str]) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot = F.col("l_orderkey") % 3 == 0
    counters = li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("l_partkey") % 5000).cast("string"))).alias("id"),
        F.lit("counter").alias("type"),
        F.col("l_partkey").alias("delta"),
        F.lit(None).cast("double").alias("value"),
    )
    # Warm the JVM and the Python workers before timing anything.
    counters.groupBy("id").count().write.format("noop").mode("overwrite").save()
    w = Window.partitionBy("id", "type").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    plain = counters.select(
        "seq", "id", "type",
        F.when(F.count(F.when(F.col("delta").isNull(), 1)).over(w) == 0, F.sum("delta").over(w)).alias("delta"),
        "value",
    )
    timed("W1 plain window", plain)
    timed("W1 prefix scan", running.running_result(counters))
    timed("W1 prefix scan, sparse seq", running.running_result(counters.withColumn("seq", F.col("seq") * 1_000_003)))

    gauges = counters.select("seq", "id", F.lit("gauge").alias("type"), F.col("seq").cast("double").alias("value"))
    last = Window.partitionBy("id").orderBy(F.col("seq").desc())
    timed("W2 row_number", gauges.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn"))
    timed("W2 largest struct", dedup.keep_last(gauges, ["id"], "seq"))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
