"""Phase durations learned from event gaps, and the estimates made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S
from cutlake.operators.quantiles import exact_quantiles
from cutlake.operators.spacing import keep_spaced

# Hours assumed for a phase with too little history.
PRIORS = {
    "feasibility": 0.75,
    "cast": 1.5,
    "build": 3.5,
    "audit": 1.5,
    "fix": 4.0,
    "deliver": 0.75,
    "intake": 0.15,
    "study": 1.0,
}
# Phases still ahead of each phase, before fix rounds and delivery.
AHEAD = {
    "intake": ["study", "build", "audit"],
    "study": ["build", "audit"],
    "feasibility": ["cast", "build", "audit"],
    "cast": ["build", "audit"],
    "build": ["audit"],
    "audit": [],
    "fix": ["audit"],
}
# How a phase is named to a reader.
LABELS = {
    "feasibility": "feasibility",
    "cast": "casting",
    "build": "build",
    "audit": "audit",
    "fix": "fix round",
    "deliver": "delivery",
    "intake": "intake",
    "study": "reference study",
}
MIN_SAMPLES, MAX_GAP_HOURS, DEDUPE_MINUTES = 3, 48.0, 90
DEFAULT_FIX_ROUNDS, INTAKE_FIX_ROUNDS, MIN_REMAINING_HOURS = 3.0, 1.0, 0.25
QUARTILES = {"p25_h": 0.25, "median_h": 0.5, "p75_h": 0.75}


def merge_streams(*streams: DataFrame) -> DataFrame:
    """One event table from several sources; columns a source lacks are null."""
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def dedupe_within(
    events: DataFrame,
    keys: tuple[str, ...] = ("row", "phase", "fix_round"),
    at: str = "ts",
    tie: tuple[str, ...] = ("event_id",),
    minutes: int = DEDUPE_MINUTES,
) -> DataFrame:
    """Drop an event when a kept one of the same key lies at most ``minutes`` before it."""
    return keep_spaced(events, list(keys), at, list(tie), minutes * 60_000_000)


def gaps(events: DataFrame, keys: tuple[str, ...] = ("row",), at: str = "ts", tie: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Hours from the previous event of the key, with that event's phase (first events drop out)."""
    stepped = S.scan(
        events, list(keys), [at, *tie], _then=S.prev(F.unix_micros(F.col(at).cast("timestamp"))), previous_phase=S.prev("phase")
    )
    hours = (F.unix_micros(F.col(at).cast("timestamp")) - F.col("_then")) / F.lit(3_600_000_000.0)
    return stepped.where(F.col("_then").isNotNull()).withColumn("hours", hours).drop("_then")


def phase_samples(gap_rows: DataFrame, max_hours: float = MAX_GAP_HOURS) -> DataFrame:
    """Gaps that measure work: not into feasibility, not out of delivery, 0 < gap <= limit."""
    return gap_rows.where(
        (F.col("phase") != "feasibility")
        & (F.col("previous_phase") != "deliver")
        & (F.col("hours") > 0)
        & (F.col("hours") <= max_hours)
    )


def phase_stats(samples: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Quartiles per known phase; a phase below ``min_samples`` reads its prior x0.6 / x1.6."""
    priors = samples.sparkSession.createDataFrame(list(PRIORS.items()), "phase string, prior double")
    found = exact_quantiles(samples, ["phase"], "hours", QUARTILES)
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    learned = n >= min_samples
    scale = {"p25_h": 0.6, "median_h": 1.0, "p75_h": 1.6}
    cols = [F.when(learned, F.round(F.col(q), 3)).otherwise(F.col("prior") * s).alias(q) for q, s in scale.items()]
    return priors.join(found, "phase", "left").select(
        "phase", n.alias("n"), *cols, F.when(learned, "history").otherwise("prior").alias("source")
    )


def run_facts(events: DataFrame, key: str = "row") -> DataFrame:
    """Per row: distinct fix rounds, and hours from the first opener to the last delivery."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    opener = F.col("phase").isin("feasibility", "cast", "build")
    facts = events.groupBy(key).agg(
        F.countDistinct(F.when((F.col("phase") == "fix") & (F.col("fix_round") != 0), F.col("fix_round"))).alias("fix_rounds"),
        F.max(F.when(F.col("phase") == "deliver", us)).alias("_done"),
        F.min(F.when(opener, us)).alias("_open"),
        F.count("*").alias("events"),
    )
    hours = (F.col("_done") - F.col("_open")) / F.lit(3_600_000_000.0)
    fine = (F.col("events") >= 2) & (F.col("_open") < F.col("_done")) & (hours <= MAX_GAP_HOURS * 4)
    rounds = F.when(F.col("events") >= 2, F.col("fix_rounds"))
    return facts.select(key, "events", F.coalesce(rounds, F.lit(0)).cast("long").alias("fix_rounds"), F.when(fine, hours).alias("run_hours"))


def fit_durations(events: DataFrame, key: str = "row") -> DataFrame:
    """The fitted model as rows ``(part, phase, n, p25_h, median_h, p75_h, source)``.

    ``part`` is ``phase``, ``fix_rounds`` (median rounds, prior below two rows)
    or ``total_hours`` (whole runs).
    """
    stats = phase_stats(phase_samples(gaps(events, (key,)))).withColumn("part", F.lit("phase"))
    facts = run_facts(events, key)
    rounds = exact_quantiles(facts.where("fix_rounds > 0").withColumn("_v", F.col("fix_rounds").cast("double")), [], "_v", {"m": 0.5})
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    enough = n >= 2
    rounds = rounds.select(
        F.lit("fix_rounds").alias("part"),
        F.lit("fix").alias("phase"),
        n.alias("n"),
        F.lit(None).cast("double").alias("p25_h"),
        F.when(enough, F.round("m", 2)).otherwise(F.lit(DEFAULT_FIX_ROUNDS)).alias("median_h"),
        F.lit(None).cast("double").alias("p75_h"),
        F.when(enough, "history").otherwise("prior").alias("source"),
    )
    totals = exact_quantiles(facts, [], "run_hours", QUARTILES).select(
        F.lit("total_hours").alias("part"),
        F.lit("run").alias("phase"),
        n.alias("n"),
        *[F.round(q, 2).alias(q) for q in QUARTILES],
        F.lit("history").alias("source"),
    )
    return stats.unionByName(rounds).unionByName(totals)


def estimate(events: DataFrame, model: DataFrame, now: Column, key: str = "row", tie: tuple[str, ...] = ("event_id",), activity: DataFrame | None = None) -> DataFrame:
    """Hours left per row: median hours of the phases still ahead, minus time already spent.

    ``events`` are deduplicated and merged from all sources, ``model`` is the output
    of :func:`fit_durations`. Time is counted from the newest event of the row or, if
    later, from its lane's last activity (``activity``: key, active_at). Rows already
    delivered have no estimate.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    newest = F.max_by(F.struct("phase", us.alias("us")), F.struct("ts", *tie))
    per_row = events.groupBy(key).agg(
        newest.alias("_new"),
        F.countDistinct(F.when((F.col("phase") == "fix") & (F.col("fix_round") != 0), F.col("fix_round"))).alias("rounds_done"),
        F.max(F.col("phase").isin("intake", "study")).alias("_fresh"),
    )
    if activity is not None:
        busy = activity.groupBy(key).agg(F.max(F.unix_micros(F.col("active_at").cast("timestamp"))).alias("_busy"))
        per_row = per_row.join(busy, key, "left").withColumn("_new", F.struct(F.col("_new.phase").alias("phase"), F.greatest("_new.us", "_busy").alias("us"))).drop("_busy")
    fitted_rounds = model.where("part = 'fix_rounds'").select(F.max("median_h")).scalar()
    target = F.when(F.col("_fresh"), F.lit(INTAKE_FIX_ROUNDS)).otherwise(F.coalesce(fitted_rounds, F.lit(DEFAULT_FIX_ROUNDS)))
    left = F.greatest(F.lit(0), F.bround(target).cast("int") - F.col("rounds_done").cast("int"))
    ahead = F.create_map(*[x for p, tail in AHEAD.items() for x in (F.lit(p), F.array(*map(F.lit, tail)).cast("array<string>"))])
    placed = (
        per_row.select(key, F.col("_new.phase").alias("phase"), F.col("_new.us").alias("_us"), "rounds_done", left.alias("_left"))
        .withColumn("_tail", F.try_element_at(ahead, F.col("phase")))
        .where(F.col("_tail").isNotNull())
        .withColumn("remaining", F.concat("_tail", F.flatten(F.array_repeat(F.array(F.lit("fix"), F.lit("audit")), F.col("_left"))), F.array(F.lit("deliver"))))
    )
    stats = model.where("part = 'phase'").select(F.col("phase").alias("_p"), "p25_h", "median_h", "p75_h")
    totals = (
        placed.select(key, "phase", "_us", "rounds_done", F.size("remaining").cast("long").alias("steps"), F.explode("remaining").alias("_p"))
        .join(stats, "_p")
        .groupBy(key, "phase", "_us", "rounds_done", "steps")
        .agg(*[F.sum(q).alias(q) for q in QUARTILES])
    )
    spent = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.col("_us")) / F.lit(3_600_000_000.0))
    floor = F.lit(MIN_REMAINING_HOURS)
    out = totals.withColumn("_l", F.greatest(floor, F.col("median_h") - spent)).withColumn("_w", F.greatest(floor, F.col("p25_h") - spent))
    out = out.withColumn("_h", F.greatest("_l", F.col("p75_h") - spent))
    labels, kind = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), events.schema["ts"].dataType
    return out.select(
        key,
        "phase",
        F.col("rounds_done").cast("long").alias("rounds_done"),
        "steps",
        F.round("_l", 2).alias("remaining_hours"),
        F.round(F.greatest(floor, (F.col("_h") - F.col("_w")) / 2.0), 1).alias("spread_hours"),
        F.when((F.col("phase") == "fix") & (F.col("rounds_done") > 0), F.concat_ws(" ", labels["fix"], "rounds_done")).otherwise(labels[F.col("phase")]).alias("phase_label"),
        F.timestamp_micros("_us").cast(kind).alias("anchor"),
        F.timestamp_micros(F.unix_micros(now.cast("timestamp")) + F.round(F.round("_l", 2) * 3600).cast("long") * 1_000_000).cast(kind).alias("eta"),
    )
