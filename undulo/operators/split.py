"""The balanced split of a node's zeros and ones over workers, for one node and down a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undulo.functions.bits import level_bit, node_of
from undulo.functions.running import running_sum
from undulo.plans.alphabet import Alphabet
from undulo.sources.scratch import small_side, stored


def _with_targets(rows: DataFrame, workers: Column) -> DataFrame:
    """Adds how many workers take the zeros (num0) and the ones (num1), and how many items one of them takes."""
    wanted = F.ceil(F.col("num0") * workers / (F.col("num0") + F.col("num1")))
    rows = rows.withColumn("targets0", F.when(F.col("num1") > 0, F.least(wanted, workers - 1)).otherwise(wanted).cast("long"))
    rows = rows.withColumn("targets1", (workers - F.col("targets0")).cast("long"))
    for b in "01":
        rows = rows.withColumn(f"per{b}", F.when(F.col(f"targets{b}") > 0, F.ceil(F.col(f"num{b}") / F.col(f"targets{b}"))).otherwise(0).cast("long"))
    return rows


def split_plan(bits: DataFrame, workers: int) -> DataFrame:
    """One row: how many zeros and ones, how many workers take each, and how many items one of them takes."""
    row = bits.agg(F.sum(1 - F.col("bit")).cast("long").alias("num0"), F.sum("bit").cast("long").alias("num1"))
    return _with_targets(row, F.lit(workers))


def split_targets(bits: DataFrame, workers: int) -> DataFrame:
    """(pos, bit, target): items in order fill the zeros' workers, then the ones'."""
    ranked = running_sum(bits.withColumn("one", F.lit(1)), ["bit"], "pos", "one", "rank")
    p = split_plan(bits, workers).first()
    per = [max(1, p.per0 or 0), max(1, p.per1 or 0)]
    target = F.when(F.col("bit") == 0, F.expr(f"rank div {per[0]}")).otherwise(F.expr(f"{p.targets0} + rank div {per[1]}"))
    return ranked.select("pos", "bit", target.cast("long").alias("target"))


def split_counts(alphabet: Alphabet) -> DataFrame:
    """(level, node_id, num0, num1) of all nodes with symbols below."""
    h = alphabet.height
    rows = alphabet.table.select("code", "occ", F.explode(F.sequence(F.lit(0), F.lit(max(h - 1, 0)))).alias("level")).filter(F.col("level") < h)
    node = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level")) + node_of(F.col("code"), F.col("level"), h)
    bit = level_bit(F.col("code"), F.col("level"), h)
    return rows.groupBy("level", node.alias("node_id")).agg(F.sum(F.when(bit == 0, F.col("occ")).otherwise(0)).alias("num0"), F.sum(F.when(bit == 1, F.col("occ")).otherwise(0)).alias("num1"))


def split_tree(alphabet: Alphabet, workers: int) -> DataFrame:
    """(level, node_id, first, workers, num0, num1, targets0, targets1, per0, per1) of the nodes that several workers share: the root has all of them, a child those
    that its parent's split gives it, and one worker's subtree is split no further. A level's nodes that are split are no more than workers."""
    counts = stored(split_counts(alphabet), "split-counts")
    found = held = None
    for level in range(alphabet.height):
        if level == 0:
            held = counts.filter("level = 0").select("node_id", F.lit(0).cast("long").alias("first"), F.lit(workers).cast("long").alias("workers"))
        own = counts.filter(F.col("level") == level).join(small_side(held, workers), "node_id").filter("workers > 1")
        own = stored(_with_targets(own, F.col("workers")), "split-level")
        found = own if found is None else found.unionByName(own)
        child = lambda b, first, n: F.struct((F.col("node_id") * 2 + b).alias("node_id"), first.alias("first"), F.col(n).alias("workers"))
        held = own.select(F.explode(F.array(child(0, F.col("first"), "targets0"), child(1, F.col("first") + F.col("targets0"), "targets1"))).alias("x")).select("x.*")
    names = ["level", "node_id", "first", "workers", "num0", "num1", "targets0", "targets1", "per0", "per1"]
    return found.select(names) if found is not None else _with_targets(counts.withColumn("workers", F.lit(0).cast("long")).withColumn("first", F.lit(0).cast("long")), F.col("workers")).select(names)
