"""The k-th largest number of a table, without sorting it or sending it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of the long column ``key``, found by counting leading bits (at most 2**16 counts a pass)."""
    if k < 1:
        return None
    low = None
    for shift in (48, 36, 24, 12, 0):
        scope = keys if low is None else keys.filter(F.shiftright("key", shift + 12) == F.lit(low))
        counts = scope.groupBy(F.shiftright("key", shift).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("part")).collect()
        for low, n in counts:
            if k <= n:
                break
            k -= n
        else:
            return None
    return low
