"""Run records, the figures made from them, and measuring a run."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The keys of a run record.
KEYS = ("algo", "nodes", "workers_per_node", "input", "size", "bps", "alphabet", "time_input", "time_hist", "time_eff", "time_construct", "time_merge", "memory", "traffic", "traffic_asym")

_TYPES = ("string", "int", "int", "string", "long", "int", "long", *["double"] * 5, *["long"] * 3)
SCHEMA = ", ".join(f"{k} {t}" for k, t in zip(KEYS, _TYPES, strict=True))
log = logging.getLogger("undulo")


def result_line(records: DataFrame) -> DataFrame:
    """(line): ``RESULT key=value ...`` for each record."""
    return records.select(F.concat_ws(" ", F.lit("RESULT"), *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in KEYS]).alias("line"))


def iec(x: Column) -> Column:
    """Bytes in units of 1024, three decimals."""
    out = F.format_string("%.3f TiB", x / 2.0**40)
    for power, unit in ((4, "GiB"), (3, "MiB"), (2, "KiB"), (1, "B")):
        out = F.when(x < 1024**power, F.format_string(f"%.3f {unit}", x / 2.0 ** (10 * (power - 1)))).otherwise(out)
    return out


def summary(records: DataFrame) -> DataFrame:
    """(text): a record in prose: input, size, time, nodes and workers, traffic and its asymmetry, memory in all and for each worker."""
    total = sum((F.col(k) for k in KEYS if k.startswith("time_")), F.lit(0.0))
    parts = [
        F.col("algo"), F.lit(" on "), F.col("input"), F.lit(": "), iec(F.col("size")), F.lit(" in "), F.format_string("%.3f", total), F.lit(" s on "),
        F.col("nodes").cast("string"), F.lit(" nodes of "), F.col("workers_per_node").cast("string"), F.lit(" workers, traffic "), iec(F.col("traffic")),
        F.lit(" (asymmetry "), iec(F.col("traffic_asym")), F.lit("), memory "), iec(F.col("memory")), F.lit(" ("), iec(F.expr("memory div (nodes * workers_per_node)")), F.lit(" a worker)"),
    ]
    return records.select(F.concat(*parts).alias("text"))


def throughput(records: DataFrame) -> DataFrame:
    """(algo, nodes, size, throughput): bits of the index in Gibit by the median of the time to build it."""
    time_ = F.percentile(F.col("time_construct") + F.col("time_merge") + F.col("time_hist"), 0.5)
    bits = F.col("size") * F.ceil(F.log2("alphabet"))
    return records.groupBy("algo", "nodes", "size", "alphabet").agg(time_.alias("t")).select("algo", "nodes", "size", (bits / F.col("t") / 2.0**30).alias("throughput"))


def memory_per_node(records: DataFrame) -> DataFrame:
    return records.groupBy("algo", "nodes").agg((F.avg("memory") / F.col("nodes") / 2.0**30).alias("mem_per_node"))


def traffic(records: DataFrame) -> DataFrame:
    return records.groupBy("algo", "nodes").agg((F.avg("traffic") / 2.0**30).alias("traffic"))


def executor_totals(spark: SparkSession) -> dict[str, int]:
    """Bytes shuffled, the difference between the executor that wrote most and that which wrote least, and peak memory, as Spark's status store has them for all executors."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    every = [found.apply(k) for k in range(found.size())]
    peaks = [e.peakMemoryMetrics().get() for e in every if e.peakMemoryMetrics().isDefined()]
    memory = sum(p.getMetricValue("JVMHeapMemory") + p.getMetricValue("JVMOffHeapMemory") for p in peaks)
    written = [e.totalShuffleWrite() for e in every]
    return {"traffic": sum(written), "traffic_asym": max(written) - min(written), "memory": memory}


def measured(spark: SparkSession, algo: str, text: str, size: int, width: int, alphabet: int, steps: dict[str, Callable[[], object]], done: Callable[[str, float], None] | None = None) -> DataFrame:
    """One record of a run. steps: what to do, by the name of its time (input, hist, eff, construct, merge); ``done`` is told each step and its seconds, as the log is."""
    before, times = executor_totals(spark), {}
    for name, step in steps.items():
        began = time.monotonic()
        step()
        times[name] = time.monotonic() - began
        log.info("%s: %s took %.3f s", algo, name, times[name])
        if done:
            done(name, times[name])
    after = executor_totals(spark)
    nodes = max(1, spark.sparkContext._jsc.sc().statusStore().executorList(True).size() - 1)
    workers = max(1, spark.sparkContext.defaultParallelism // nodes)
    row = (algo, nodes, workers, text, size, width, alphabet, *[float(times.get(k.removeprefix("time_"), 0.0)) for k in KEYS if k.startswith("time_")], after["memory"], after["traffic"] - before["traffic"], after["traffic_asym"])
    return spark.createDataFrame([row], SCHEMA)
