"""The k-th smallest of a distributed whole-number column, without sorting it.

Digits from the top: one pass counts the rows by their leading digit, in the range that
still holds the wanted rank.  Four passes settle a 60-bit value exactly, whatever the
number of rows; a pass brings at most 2^15 counts for each wanted rank to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 60
DIGIT = 15


def kth_smallest(df: DataFrame, col: str, ranks: list[int], bits: int = BITS, digit: int = DIGIT) -> list[int]:
    """The values of ``col`` (whole numbers of ``bits`` bits, no null) at the 1-based ``ranks`` in ascending order."""
    # per wanted rank: the leading digits found so far, and the rank within the rows that share them
    state = [(0, r) for r in ranks]
    shift = bits
    while shift > 0:
        step = min(digit, shift)
        shift -= step
        heads = sorted({head for head, _ in state})
        lead = F.shiftright(F.col(col), shift + step)
        rows = df.select(lead.alias("head"), F.shiftright(F.col(col), shift).alias("next")).where(F.col("head").isin(heads))
        counts: dict[int, list] = {h: [] for h in heads}
        for r in rows.groupBy("head", "next").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[r["head"]].append((r["next"], r["n"]))
        moved = []
        for head, rank in state:
            for value, n in sorted(counts[head]):
                if rank <= n:
                    moved.append((value, rank))
                    break
                rank -= n
            else:
                raise ValueError("a rank is beyond the number of rows")
        state = moved
    return [value for value, _ in state]
