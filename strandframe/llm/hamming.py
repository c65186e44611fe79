"""Pairs of 64-bit codes within a Hamming distance, by one-wildcard segment variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(n: int, bits: int = 64) -> list[tuple[int, int]]:
    """(lowest bit, width) of n segments."""
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(code: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))


def variants(code: Column, n: int) -> Column:
    """array<long>: per segment and wildcard bit one key, the kept bits with the wildcard's place above them."""
    keys = []
    for low, width in cut(n):
        for bit in range(width):
            # kept bits use at most 32 places, so the place name starts at 40
            keys.append(_part(code, low, width).bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((low + bit) << 40)))
    return F.array(*keys)


def first_place(difference: Column, n: int) -> Column:
    """The wildcard place at which a pair of that difference is reported: of the first segment with one
    bit or none, the bit that differs or else the lowest.  Null if no segment has so few."""
    place = None
    for low, width in cut(n):
        part = _part(difference, low, width)
        here = F.when(part == 0, F.lit(low)).otherwise(F.lit(low) + F.bit_count(part - 1))
        place = F.when(F.bit_count(part) <= 1, here) if place is None else place.when(F.bit_count(part) <= 1, here)
    return place


def close_pairs(codes: DataFrame, distance: int, n: int) -> DataFrame:
    """(a, b), a < b: different codes(fp) at most `distance` bits apart of which some segment differs in one
    bit at most.  The join meets a pair at each key it shares; its condition verifies the whole codes and
    lets the pair through at one key only, so links are made once and no distinct follows.

    The keys are as many rows a code as it has bits, which a plan's sizes don't tell: by its codes' size alone the
    index would be broadcast, and the driver would hold it.  So both sides are sorted and merged."""
    index = codes.select("fp", F.explode(variants(F.col("fp"), n)).alias("key"))
    x, y = index.alias("x"), index.alias("y")
    difference = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    close = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(difference) <= distance)
        & (F.shiftrightunsigned("x.key", 40) == first_place(difference, n))
    )
    return x.hint("merge").join(y, close).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
