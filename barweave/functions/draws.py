"""Random draws that are pure functions of their ids: same value on any partitioning or retry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *ids: Column | str) -> Column:
    """Uniform in [0, 1): the first 60 bits of an md5 over seed and ids."""
    cols = [F.lit(str(seed))] + [(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids]
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10)
    return digits.cast("long") / F.lit(float(16 ** 15))


def normal(seed: int | str, *ids: Column | str) -> Column:
    """Standard normal by Box-Muller on two draws."""
    a, b = uniform(f"{seed}a", *ids), uniform(f"{seed}b", *ids)
    return F.sqrt(-2 * F.ln(F.greatest(a, F.lit(1e-300)))) * F.cos(2 * math.pi * b)


def distinct_positions(seed: int | str, count: Column, size: Column, *ids: Column | str) -> Column:
    """``count`` different positions in [0, size), or all of them if there are fewer.

    Draw j falls among the ``size - j`` positions not yet taken: counted from below, it moves up by
    one past every earlier position at or under it.  Works on the one row that describes a run, so
    the rows of the run need no ranking.
    """
    few = F.least(count.cast("long"), size.cast("long"))

    def place(taken: Column, j: Column) -> Column:
        free = F.floor(uniform(f"{seed}d", *ids, j) * (size - j + 1)).cast("long")
        return F.concat(taken, F.array(F.aggregate(F.array_sort(taken), free, lambda at, t: F.when(t <= at, at + 1).otherwise(at))))

    steps = F.when(few >= 1, F.sequence(F.lit(1).cast("long"), few)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.array().cast("array<bigint>"), place)
