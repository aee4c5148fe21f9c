"""Interval joins as bucketed equi-joins, and the sweep over covered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S


def _buckets(low: Column, high: Column, width: float) -> Column:
    """Bucket numbers touched by half-open [low, high); a point touches one."""
    first = F.floor(low / F.lit(float(width)))
    last = F.greatest(first, F.ceil(high / F.lit(float(width))) - 1)
    return F.sequence(first, last)


def range_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
    salt: int = 1,
) -> DataFrame:
    """Pairs of one key whose half-open spans overlap (a point counts as its own instant).

    Both sides are cut into buckets of ``width`` and equi-joined on
    ``(key, bucket)``; a pair is kept only in the bucket where the later of the
    two starts falls, so nothing has to be deduplicated. Hot (key, bucket)
    pairs are split by AQE's skew join; ``salt`` > 1 additionally spreads the
    left side and repeats the right side that many times.
    """
    lo, hi = (F.col(c) for c in left_span)
    ro, rh = (F.col(c) for c in right_span)
    on = [*keys, "_bucket"]
    a = left.withColumn("_bucket", F.explode(_buckets(lo, hi, width)))
    b = right.withColumn("_bucket", F.explode(_buckets(ro, rh, width)))
    if salt > 1:
        a = a.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salt)))
        b = b.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        on = [*on, "_salt"]
    starts = F.floor(F.greatest(lo, ro) / F.lit(float(width)))
    touch = (
        F.when(lo >= hi, (ro <= lo) & (lo < rh))
        .when(ro >= rh, (lo <= ro) & (ro < hi))
        .otherwise((lo < rh) & (ro < hi))
    )
    return a.join(b, on).where(touch & (F.col("_bucket") == starts)).drop("_bucket", "_salt")


def coverage_runs(spans: DataFrame, keys: list[str], start: str, end: str, width: float | None = None) -> DataFrame:
    """Runs of constant cover per key: ``lo, hi, depth`` between neighbouring span edges."""
    edges = (
        spans.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col(start).alias("at"), F.lit(1).alias("step")),
                    F.struct(F.col(end).alias("at"), F.lit(-1).alias("step")),
                )
            ).alias("e"),
        )
        .groupBy(*keys, F.col("e.at").alias("lo"))
        .agg(F.sum("e.step").alias("step"))
    )
    swept = S.scan(edges, keys, ["lo"], width, hi=S.following("lo"), depth=S.running_sum("step"))
    return swept.where(F.col("hi").isNotNull()).select(*keys, "lo", "hi", "depth")


def gap_runs(
    spans: DataFrame, clocks: DataFrame, keys: list[str], start: str, end: str, length: str, width: float | None = None
) -> DataFrame:
    """Half-open runs of each clock ``[0, length)`` that no span covers."""
    clock = clocks.select(*keys, F.lit(0).cast("long").alias("_s"), F.col(length).cast("long").alias("_e"))
    marked = spans.select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"))
    inside = marked.join(clock.select(*keys, F.col("_e").alias("_n")), keys).select(
        *keys,
        F.greatest("_s", F.lit(0).cast("long")).alias("_s"),
        F.least("_e", "_n").alias("_e"),
    )
    # A gap lies between the furthest end so far and the next start; the clock's own end closes the last one.
    # Spans that start together need no order: only the first of them can see a gap.
    closing = clock.where("_e > 0").select(*keys, F.col("_e").alias("_s"), "_e")
    reached = S.scan(inside.where("_s < _e").unionByName(closing), keys, ["_s"], width, _reach=S.max_before("_e"))
    lo = F.coalesce("_reach", F.lit(0).cast("long"))
    return reached.select(*keys, lo.alias("lo"), F.col("_s").alias("hi")).where("lo < hi")
