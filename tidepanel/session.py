"""A local session for tests and benchmarks.  On a cluster, use the session that is there."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tidepanel.functions.tables import shared_folder


def local_session(name: str, cores: int | str | None = None, memory: str = "12g") -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or 8
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # the work is in wide windows over little data: one partition per core, not merged by size
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # wide plans hold more generated classes than the default of 100 keeps
        .config("spark.sql.codegen.cache.maxEntries", "3000")
        .config("spark.ui.showConsoleProgress", "false")
        # projections of many features: methods the JIT compiles instead of one huge interpreted one
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # no call-site capture per column expression: wide plans build several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_folder(spark)
    return spark
