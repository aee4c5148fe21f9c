"""Facts of a group brought back to its rows when one group may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1024
WAYS = 1 << 20


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: str, how: str = "left", share: int = SHARE) -> DataFrame:
    """``rows`` with the other columns of ``groups`` (one row per ``key``; ``size`` counts its rows).

    A group that holds more than one in ``share`` of the grouped rows is heavy;
    there are fewer than ``share`` of them, whatever the input, so they are
    broadcast. All other groups meet their rows in a shuffled merge join in which no
    key has more than that part of the rows. Heavy rows pass through that join
    under keys of their own, made from the column ``spread``.

    ``groups`` is read several times: give a stored table. Rows with a null key
    get nulls (``how="left"``) or are dropped (``"inner"``).
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    facts = [c for c in groups.columns if c != key]
    heavy = groups.where(F.col(size) * share > total)
    # zero, but not a literal: a literal would be folded and the rows dealt by the key alone
    zero = F.pmod(F.xxhash64(key), F.lit(1)).cast("int")
    light = groups.where(F.col(size) * share <= total).select(F.col(key).alias("_lk"), zero.alias("_ls"), *(F.col(c).alias(f"_l_{c}") for c in facts))
    heavy = heavy.select(F.col(key).alias("_hk"), *(F.col(c).alias(f"_h_{c}") for c in facts))
    seen = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    away = F.col("_hk").isNotNull() | F.col(key).isNull()
    seen = seen.withColumn("_s", F.when(away, 1 + F.pmod(F.xxhash64(spread), F.lit(WAYS))).otherwise(0).cast("int"))
    both = seen.join(light.hint("merge"), (F.col(key) == F.col("_lk")) & (F.col("_s") == F.col("_ls")), "left")
    if how == "inner":
        both = both.where(F.col("_hk").isNotNull() | F.col("_lk").isNotNull())
    return both.select(*rows.columns, *(F.when(F.col("_hk").isNotNull(), F.col(f"_h_{c}")).otherwise(F.col(f"_l_{c}")).alias(c) for c in facts))
