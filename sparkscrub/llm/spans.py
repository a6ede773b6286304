"""Positions of regular-expression matches with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums over arrays are made in blocks of this many elements, so that appending stays cheap.
BLOCK = 256
MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running_starts(lens: Column) -> Column:
    """For an array of lengths, the sum of those before each element."""

    def starts(a: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(a, zero, step, lambda s: s["out"])

    def whole(lens: Column) -> Column:
        n = F.ceil(F.size(lens) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, starts(sums), lambda a, at: F.transform(starts(a), lambda x: x + at)))

    return let(let(lens, whole), joined)


def match_spans(text: Column, pattern: str, guard: str | None = None, around: int = 80) -> Column:
    """Array of (start, end, value, left, right) of the leftmost non-overlapping matches of ``pattern``.

    Positions are code points, end exclusive; ``left`` and ``right`` are up to ``around`` code points
    before and after the match, none of them in another match. ``pattern`` holds no capturing group and
    never matches the empty string or U+0001. ``guard`` is a cheaper pattern that any text with a match has.
    """
    clean = F.translate(text, MARK, "\x03")
    parts = F.split(F.regexp_replace(clean, f"({pattern})", f"{MARK}$1{MARK}"), MARK)
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")

    def found(parts: Column, at: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)),
            lambda i: F.struct(
                at[i].alias("start"), (at[i] + F.length(parts[i])).alias("end"),
                parts[i].alias("value"), F.right(parts[i - 1], F.lit(around)).alias("left"), F.left(parts[i + 1], F.lit(around)).alias("right"),
            ),
        )

    some = lambda p: F.when(F.size(p) > 1, let(running_starts(F.transform(p, F.length)), lambda at: found(p, at))).otherwise(none)
    return F.when(F.coalesce(text.rlike(guard or pattern), F.lit(False)), let(parts, some)).otherwise(none)
