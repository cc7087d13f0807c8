"""The full-period sequence of variable names and its seen and hidden parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import base26

# Multiplier, increment and start of x' = (53 x + 1) mod 26^L.
MULTIPLIER, INCREMENT, START = 53, 1, 123456789


def skip(n: int, m: int) -> tuple[int, int]:
    """(a, c): n steps are x -> (a x + c) mod m; by doubling."""
    a, c, pa, pc = 1, 0, MULTIPLIER, INCREMENT
    while n:
        if n & 1:
            a, c = pa * a % m, (pa * c + pc) % m
        pa, pc, n = pa * pa % m, (pa * pc + pc) % m, n >> 1
    return a, c


def sequence(spark: SparkSession, length: int, count: int | None = None) -> DataFrame:
    """ordinal, state, name for the first count (or all 26^length) names. Each row is computed from its ordinal
    alone by doubling, in column arithmetic, so any number of tasks gives the same rows."""
    m = 26**length
    n = count or m
    a, c, jumps = MULTIPLIER % m, INCREMENT, []
    for k in range(max(1, (max(n, 2) - 1).bit_length())):
        jumps.append((1 << k, a, c))
        a, c = a * a % m, (a * c + c) % m
    table = F.array(*(F.struct(*(F.lit(x).cast("long").alias(name) for x, name in zip(j, ("bit", "a", "c")))) for j in jumps))
    modulus = F.lit(m).cast("long")
    step = lambda x, j: F.when(F.col("ordinal").bitwiseAND(j["bit"]) > 0, F.pmod(x * j["a"] + j["c"], modulus)).otherwise(x)
    state = F.aggregate(table, F.lit(START % m).cast("long"), step)
    return spark.range(n).select(F.col("id").alias("ordinal")).withColumn("state", state).withColumn("name", base26(F.col("state"), length))


def seen(ordinal: Column, length: int, rarity: float) -> Column:
    """Single letters are all seen."""
    return F.lit(True) if length == 1 else ordinal < max(1, int(26**length * rarity))


def ranked(number: Column, longest: int = 10, again: bool = False) -> Column:
    """The name with this 0-based rank when names are ordered by length, then by letters; beyond the longest ones null, or (again) those anew."""
    out, before = None, 0
    for length in range(1, longest + 1):
        name = base26(number - F.lit(before), length)
        before += 26**length
        out = (F if out is None else out).when(number < F.lit(before), name)
    return out.otherwise(name) if again else out
