"""Builds an index of a file from the command line: ``python -m undulo.launch [-k tree|matrix|nodes] [-w width] [-p prefix] [-r buffer] [-e] [-o output] file``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undulo.operators import build as B
from undulo.operators import report
from undulo.plans import alphabet as A
from undulo.sources import store
from undulo.sources import text as T


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="undulo.launch")
    out.add_argument("file", help="the input, or a pattern of several files")
    out.add_argument("-k", "--kind", default=B.TREE, choices=(B.TREE, B.MATRIX, B.NODES))
    out.add_argument("-w", "--width", type=int, default=1, choices=T.WIDTHS, help="bytes of a symbol")
    out.add_argument("-p", "--prefix", type=int, help="bytes of each file to take")
    out.add_argument("-r", "--rbuf", type=int, default=T.RANGE, help="bytes that a task reads about")
    out.add_argument("-e", "--effective", action="store_true", help="the input's symbols are codes from 0 on already")
    out.add_argument("-o", "--output", help="where to write the index as binary files")
    return out


def run(spark: SparkSession, argv: list[str]) -> DataFrame:
    """Builds, writes where asked to, and returns the record of the run."""
    args, found = parser().parse_args(argv), {}

    def scan() -> None:
        found["chunks"] = T.from_binary(spark, args.file, args.width, args.prefix, args.rbuf)

    def hist() -> None:
        found["hist"] = A.packed_histogram(found["chunks"])
        if args.effective:  # every code up to the largest is in the alphabet
            largest = found["hist"].agg(F.max("raw")).first()[0]
            every = spark.range(0 if largest is None else largest + 1).select(F.col("id").alias("raw"))
            found["hist"] = every.join(found["hist"], "raw", "left").select("raw", F.coalesce("occ", F.lit(0).cast("long")).alias("occ"))
        found["alphabet"] = A.effective_alphabet(found["hist"])

    def construct() -> None:
        found["words"] = B.build(found["chunks"], found["alphabet"], args.kind)
        if args.output:
            store.export_words(found["words"], args.output)
        else:
            found["words"].write.format("noop").mode("overwrite").save()

    def parts() -> None:
        alphabet = found["alphabet"]
        if args.output and alphabet.counts is not None:
            store.export_histogram(list(zip(alphabet.symbols, alphabet.counts.tolist(), strict=True)), args.width, args.output)
        if args.output and args.kind == B.MATRIX:
            store.export_zeros({r.level: r.z for r in B.z_from_histogram(alphabet).collect()}, args.output)

    times = report.measured(spark, args.kind, args.file, 0, args.width, 0, {"input": scan, "hist": hist, "construct": construct, "merge": parts})
    alphabet = found["alphabet"]
    return times.withColumn("size", F.lit(alphabet.n).cast("long")).withColumn("alphabet", F.lit(alphabet.sigma).cast("long"))


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("undulo").getOrCreate()
    print(report.result_line(run(session, sys.argv[1:])).first().line)
