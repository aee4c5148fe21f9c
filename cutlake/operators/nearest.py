"""As-of and nearest joins by one union and a chunked scan; never a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S


def _merged(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, carry: list[str]) -> DataFrame:
    facts = F.struct(F.col(right_at).alias("at"), *[F.col(c) for c in carry])
    a = left.select(
        *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    )
    b = right.where(F.col(right_at).isNotNull()).select(
        *keys, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), facts.alias("_fact")
    )
    return a.unionByName(b, allowMissingColumns=True)


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    right_at: str,
    carry: list[str],
    width: float | None = None,
    prefix: str = "",
) -> DataFrame:
    """Each left row with the newest right row at or before it (nulls if none).

    Right rows must be unique per (key, time). Left rows keep all columns.
    """
    both = _merged(left, right, keys, at, right_at, carry)
    seen = S.scan(both, keys, ["_at", "_side"], width, _hit=S.last_known("_fact"))
    out = seen.where("_side = 1").select("_row.*", *[F.col(f"_hit.{c}").alias(prefix + c) for c in carry])
    return out


def nearest(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, width: float | None = None
) -> DataFrame:
    """Each left row with ``nearest`` (right position) and ``distance``; the earlier one wins a tie.

    Keys without any right row get nulls, so a missing reference never reads as a hit.
    """
    points = right.select(*keys, F.col(right_at)).distinct()
    both = _merged(left, points, keys, at, right_at, [])
    where = F.col("_fact.at")
    seen = S.scan(both, keys, ["_at", "_side"], width, _lo=S.last_known(where), _hi=S.next_known(where))
    before, after = F.col("_at") - F.col("_lo"), F.col("_hi") - F.col("_at")
    pick = F.when(F.col("_lo").isNull() | (after < before), F.col("_hi")).otherwise(F.col("_lo"))
    best: Column = F.abs(F.col("_at") - pick)
    return seen.where("_side = 1").select("_row.*", pick.alias("nearest"), best.alias("distance"))


def neighbours(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, carry: list[str], width: float | None = None
) -> DataFrame:
    """Each left row with ``before`` and ``after``: structs of the right row at or before it and of the next one.

    They hold ``at`` and the carried columns. Right rows must be unique per
    (key, time); ``at`` must not be null.
    """
    both = _merged(left, right, keys, at, right_at, carry)
    seen = S.scan(both, keys, ["_at", "_side"], width, before=S.last_known("_fact"), after=S.next_known("_fact"))
    return seen.where("_side = 1").select("_row.*", "before", "after")
