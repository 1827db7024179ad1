"""Text hygiene for transcripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters to remove and the mark of a shortened text.
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"
MARK = "\n...[truncated]"


def clean_text(c: Column | str, limit: int | None = None) -> Column:
    """Remove control characters; only if a ``limit`` is given, longer texts are cut and marked."""
    t = F.regexp_replace(F.col(c) if isinstance(c, str) else c, CONTROL, "")
    return t if limit is None else F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit(MARK))).otherwise(t)


def over_limit(c: Column | str, limit: int = 12_000) -> Column:
    """Is the cleaned text longer than a reader of ``limit`` characters takes?"""
    return F.length(clean_text(c)) > limit


def words(c: Column | str) -> Column:
    return F.filter(F.split(F.col(c) if isinstance(c, str) else c, "\\s+"), lambda w: w != "")


def is_repetition_loop(w: Column) -> Column:
    """Does a word array start with one phrase of 1-6 words repeated >= 4 times over >= 60 % of it?

    For phrase length n the run of repeats ends at the first word that differs from the word
    n places before it.
    """
    size = F.size(w)

    def loop(n: int) -> Column:
        tail = F.slice(w, n + 1, F.greatest(size - n, F.lit(0)))
        same = F.zip_with(tail, F.slice(w, 1, F.greatest(size - n, F.lit(0))), lambda a, b: a == b)
        first = F.array_position(same, False)
        run = F.when(first == 0, F.size(tail)).otherwise(first - 1) + n
        reps = F.floor(run / n)
        return (size >= 4 * n) & (reps >= 4) & (reps * n / size >= 0.6)
    return F.when(size < 8, False).otherwise(reduce(lambda a, b: a | b, [loop(n) for n in range(1, 7)]))
