"""Validated appends and snapshot patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ["picked_up", "running", "progress", "queued", "blocked", "finished", "called"]
CALL_LIMIT = 320
KIND = r"^[a-z][a-z0-9_]*$"


def status_fault(state: Column, text: Column, why: Column) -> Column:
    """Why a status line may not be written, or null."""
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    option = lambda n: line.rlike(rf"(?:^|[\s(])(?:RULING\s*)?{n}\s*[=)\.:]\s*\S")
    return (
        F.when(~F.coalesce(state.isin(STATES), F.lit(False)), "unknown_state")
        .when(state.isin("queued", "blocked") & (F.coalesce(why, F.lit("")) == ""), "why_required")
        .when((state == "called") & (F.length(line) > CALL_LIMIT), "call_too_long")
        .when((state == "called") & ~(option(1) & option(2)), "call_without_options")
    )


def check_status(lines: DataFrame) -> DataFrame:
    return lines.withColumn("fault", status_fault(F.col("state"), F.col("text"), F.col("why")))


def append_status(lines: DataFrame, path: str, quarantine: str) -> None:
    """Append accepted status lines to one table and refused ones, with the reason, to another."""
    checked = check_status(lines)
    checked.where("fault IS NULL").drop("fault").write.mode("append").parquet(path)
    checked.where("fault IS NOT NULL").write.mode("append").parquet(quarantine)


def check_events(events: DataFrame, payload: list[str]) -> DataFrame:
    """Events with their payload as JSON and whether their kind is a plain token."""
    encoded = F.to_json(F.struct(*payload))
    return events.select("id", "kind", encoded.alias("payload"), F.coalesce(F.col("kind").rlike(KIND), F.lit(False)).alias("accepted"))


def append_events(events: DataFrame, payload: list[str], path: str) -> None:
    """Append events; a kind that is not a plain token fails the job."""
    checked = check_events(events, payload)
    kind = F.when(F.col("accepted"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("event kind must be a token: "), F.col("kind"))))
    checked.select("id", kind.alias("kind"), "payload").write.mode("append").parquet(path)


def patch_rows(base: DataFrame, patches: DataFrame, key: str = "sequence", fields: str = "fields") -> DataFrame:
    """Rows after a patch: ``set`` overwrites keys, ``add`` refuses an existing one; each patch must match one row.

    ``fields`` is a ``map<string,string>``; ``patches`` has ``set`` and ``add``
    maps. Rows of a refused patch stay as they were, with the ``fault``.
    """
    none = F.create_map().cast("map<string,string>")
    count = base.groupBy(key).agg(F.count("*").alias("_n"))
    joined = base.join(patches.select(key, F.coalesce("set", none).alias("_set"), F.coalesce("add", none).alias("_add"), F.lit(True).alias("_hit")), key, "left").join(count, key)
    clash = F.size(F.array_intersect(F.map_keys("_add"), F.map_keys(F.map_concat(F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys("_set"), k)), "_set")))) > 0
    fault = F.when(F.col("_hit") & (F.col("_n") != 1), "row_not_unique").when(F.col("_hit") & clash, "key_exists")
    kept = F.map_filter(fields, lambda k, v: ~F.array_contains(F.map_keys("_set"), k))
    merged = F.map_concat(kept, "_set", F.map_filter("_add", lambda k, v: ~F.array_contains(F.map_keys(kept), k) & ~F.array_contains(F.map_keys("_set"), k)))
    return joined.select(*[c for c in base.columns if c != fields], F.when(F.col("_hit") & fault.isNull(), merged).otherwise(F.col(fields)).alias(fields), fault.alias("fault"))


def unmatched_patches(base: DataFrame, patches: DataFrame, key: str = "sequence") -> DataFrame:
    return patches.join(base.select(key), key, "left_anti").select(key)


def write_snapshot(rows: DataFrame, path: str, snapshot: str) -> None:
    """A patched table is a new snapshot partition; earlier ones stay."""
    rows.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot").parquet(path)
