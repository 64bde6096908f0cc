"""Bits and words: the first bit of a word is its highest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitrev(x: Column, bits: Column) -> Column:
    """The lowest ``bits`` bits of ``x`` in reverse; 0 for no bits."""
    turned = F.conv(F.reverse(F.lpad(F.bin(x), bits, F.lit("0"))), 2, 10).cast("long")
    return F.when(bits > 0, turned).otherwise(F.lit(0).cast("long"))


def level_bit(code: Column, level: Column, height: int) -> Column:
    return F.call_function("shiftright", code, (F.lit(height - 1) - level).cast("int")).bitwiseAND(F.lit(1)).cast("int")


def node_of(code: Column, level: Column, height: int) -> Column:
    """The prefix of a code that names its node on a level."""
    return F.call_function("shiftright", code, (F.lit(height) - level).cast("int")).cast("long")


def pack(df: DataFrame, keys: list[str], position: str, bit: str) -> DataFrame:
    """Words of 64 bits from (keys, position, bit); bits that are absent are 0."""
    place = (F.lit(63) - F.col(position) % 64).cast("int")
    word = F.bit_or(F.call_function("shiftleft", F.col(bit).cast("long"), place))
    return df.groupBy(*keys, F.expr(f"{position} div 64").alias("word_idx")).agg(word.alias("word"))


def expand(words: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, bit) for all 64 places of each word."""
    rows = words.select(*keys, "word_idx", "word", F.explode(F.expr("sequence(0, 63)")).alias("k"))
    return rows.select(*keys, (F.col("word_idx") * 64 + F.col("k")).alias("p"), F.getbit("word", F.lit(63) - F.col("k")).cast("int").alias("bit"))
