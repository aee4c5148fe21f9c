"""Exact interpolated quantiles without holding a key's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S


def magnitude_chunk(value: Column) -> Column:
    """A non-decreasing integer label of a double: 64 steps per power of two."""
    sized = F.floor(F.log2(F.lit(1.0) + F.abs(value) * F.lit(1024.0)) * 64)
    return F.when(value < 0, -sized - 1).otherwise(sized)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], count: str = "n"
) -> DataFrame:
    """One row per key: the row count and each linear-interpolated quantile.

    Equal values are counted map-side first; running counts then come from a
    chunked scan over the value axis, so a hot key is spread over many tasks.
    Null and NaN values are left out.
    """
    level = F.col("_v")
    tally = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .where(level.isNotNull() & ~F.isnan(level))
        .groupBy(*keys, "_v")
        .agg(F.count("*").alias("_n"))
    )
    ranked = S.scan(
        tally, keys, ["_v"], chunk=magnitude_chunk(level), _upto=S.running_sum("_n"), _all=S.total("_n")
    )
    picks = [F.max("_all").alias(count)]
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col("_all") - 1)
        picks.append(F.min(F.when(F.col("_upto") > F.floor(spot), level)).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_upto") > F.ceil(spot), level)).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(*picks)
    blend = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col(count) - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        blend.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*keys, F.col(count), *blend)


def median_and_mad(df: DataFrame, keys: list[str], value: str, also: dict[str, float] | None = None) -> DataFrame:
    """Per key: ``median``, ``mad`` (median absolute deviation), ``n`` and any further quantiles."""
    middle = exact_quantiles(df.select(*keys, value), keys, value, {"median": 0.5, **(also or {})})
    off = df.select(*keys, value).join(middle.select(*keys, "median"), keys)
    spread = exact_quantiles(off.select(*keys, F.abs(F.col(value) - F.col("median")).alias("_off")), keys, "_off", {"mad": 0.5}, count="_m")
    return middle.join(spread.drop("_m"), keys)
