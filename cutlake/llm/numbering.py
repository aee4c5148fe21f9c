"""Global row numbers in a sort order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with a gapless number from 0 in the order of ``order``, and the row count.

    Rows are dealt by ranges of the order columns, sorted inside each range and
    written once, so that range bounds drawn by sampling cannot differ between
    reads. A range's first number is the sum of the counts before it: one small
    row per range. Rows equal in all order columns are numbered in any order.
    """
    every = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_all")
    keys = [F.col(f"_all.`{c}`") for c in order]
    dealt = df.select(every).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    stored = store.keep(dealt, "numbered").select("_all", F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_row"))
    counts = sorted((r[0], r[1]) for r in stored.groupBy("_range").count().collect())
    first, firsts = 0, []
    for part, n in counts:
        firsts.append((part, first))
        first += n
    starts = df.sparkSession.createDataFrame(firsts, "_range long, _first long")
    return stored.join(F.broadcast(starts), "_range").select("_all.*", (F.col("_first") + F.col("_row")).alias(name)), first
