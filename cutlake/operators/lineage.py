"""Receipt chains, stage status, ownership and input fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.operators.verdicts import SEVERITY, severity_rank

# The stage order of a project.
STAGES = [
    "REFERENCE_LOCKED", "BLUEPRINT_LOCKED", "FOOTAGE_INDEXED", "FEASIBILITY_REPORTED", "SELECTION_LOCKED", "ASSETS_LOCKED", "RENDERED",
    "TECHNICAL_QC", "STRUCTURE_QC", "VISUAL_QC", "LOCAL_REVIEW_READY", "HUMAN_APPROVED", "DELIVERY_APPROVED", "DELIVERED",
]
# Report layers and the stage each one reads.
LAYERS = [
    ("reference_lock", "REFERENCE_LOCKED"), ("blueprint", "BLUEPRINT_LOCKED"), ("footage_index", "FOOTAGE_INDEXED"), ("feasibility", "FEASIBILITY_REPORTED"),
    ("selection", "SELECTION_LOCKED"), ("colour_grade_proof", "SELECTION_LOCKED"), ("captions_typography", "ASSETS_LOCKED"), ("audio_beat_parity", "STRUCTURE_QC"),
    ("render", "RENDERED"), ("technical_qc", "TECHNICAL_QC"), ("structure_qc", "STRUCTURE_QC"), ("visual_qc", "VISUAL_QC"), ("human_approval", "HUMAN_APPROVED"),
    ("delivery_approval", "DELIVERY_APPROVED"),
]


def stage_index(stage: Column) -> Column:
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)) - 1


def receipt_id(fields: list[Column]) -> Column:
    """Identity of a receipt: digest of its content fields in order."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def verify_chain(receipts: DataFrame, artifacts: DataFrame, expected_id: Column, key: str = "project") -> DataFrame:
    """Each stage's own check and whether it and every stage before it hold.

    Columns: stage_idx, status, receipt_id, predecessor_id, receipt_sha256,
    actual_sha256. ``artifacts``: project, stage_idx, sha256, actual_sha256. A
    project has a fixed, small number of stages, so the walk along them is one
    window pass per project.
    """
    moved = artifacts.groupBy(key, "stage_idx").agg(F.count_if(~F.col("sha256").eqNullSafe(F.col("actual_sha256"))).alias("_moved"))
    w = Window.partitionBy(key).orderBy("stage_idx")
    j = receipts.join(moved, [key, "stage_idx"], "left").select("*", F.lag("receipt_id").over(w).alias("_prev"), F.lag("stage_idx").over(w).alias("_pi"))
    linked = F.when(F.col("stage_idx") == 0, F.col("predecessor_id").isNull()).otherwise(
        (F.col("_pi") == F.col("stage_idx") - 1) & F.col("predecessor_id").eqNullSafe(F.col("_prev"))
    )
    reason = (
        F.when(F.col("status") != "PASS", "not_pass")
        .when(~F.coalesce(F.col("receipt_sha256") == F.col("actual_sha256"), F.lit(False)), "receipt_changed")
        .when(~F.coalesce(F.col("receipt_id") == expected_id, F.lit(False)), "identity_invalid")
        .when(~F.coalesce(linked, F.lit(False)), "linkage_invalid")
        .when(F.coalesce("_moved", F.lit(0)) > 0, "artifact_changed")
    )
    judged = j.withColumn("fault", reason)
    held = F.min(F.when(F.col("fault").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return judged.select(key, "stage_idx", "status", "fault", held.alias("valid"))


def next_stage(verified: DataFrame, key: str = "project", stages: int = len(STAGES)) -> DataFrame:
    """First stage that is not PASS or not valid; the one after the last receipt; null when all are done."""
    agg = verified.groupBy(key).agg(F.min(F.when(~F.col("valid"), F.col("stage_idx"))).alias("_bad"), F.max("stage_idx").alias("_last"))
    nxt = F.coalesce("_bad", F.when(F.col("_last") + 1 < stages, F.col("_last") + 1))
    return agg.select(key, nxt.cast("long").alias("next_stage"))


def stale_cascade(stages: DataFrame, key: str = "project") -> DataFrame:
    """Status after changes: every later stage that is not pending becomes STALE."""
    w = Window.partitionBy(key).orderBy("stage_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.col("changed").cast("int")).over(w) == 1, F.lit(False))
    return stages.withColumn("new_status", F.when(before & (F.col("status") != "PENDING"), "STALE").otherwise(F.col("status")))


def stage_status(status: Column, valid: Column) -> Column:
    return (
        F.when((status == "PASS") & valid, "PROVEN")
        .when(status == "PASS", "FAILED")
        .when(status == "BLOCKED", "WITHHELD")
        .when(status.isin("FAIL", "STALE"), "FAILED")
        .otherwise("PENDING_MACHINE")
    )


def layer_status(projects: DataFrame, stages: DataFrame, evidence: DataFrame, calls: DataFrame, key: str = "project") -> DataFrame:
    """Status of the fourteen layers per project: the weaker of stage and evidence, then the human gates.

    ``stages``: project, stage, status, valid. ``evidence``: project, layer,
    status. ``calls``: project, layer, stage, state (null state is open). A call
    gates its layer, or its stage and every later one; an unknown stage gates all.
    """
    table = F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(s).alias("stage")) for n, s in LAYERS])
    rows = projects.select(key, F.explode(table).alias("l")).select(key, "l.*").withColumn("_pos", stage_index(F.col("stage")))
    found = stages.select(key, "stage", stage_status(F.col("status"), F.col("valid")).alias("_status"))
    proof = evidence.select(key, "layer", F.col("status").alias("_evidence"))
    ready = stages.where("valid AND status = 'PASS'").groupBy(key).agg(
        F.bool_or(F.col("stage") == "LOCAL_REVIEW_READY").alias("_review"), F.bool_or(F.col("stage") == "HUMAN_APPROVED").alias("_approved")
    )
    opened = calls.where(F.coalesce(F.upper(F.trim("state")) == "AWAITING_OPERATOR", F.lit(True)))
    # Open calls shrink to one row per project: the earliest gated stage and the named layers (fourteen at most).
    gates = opened.groupBy(key).agg(
        F.min(F.when(F.col("layer").isNull(), F.coalesce(stage_index(F.col("call_stage")), F.lit(0)))).alias("_gate"), F.collect_set("layer").alias("_layers")
    )
    j = rows.join(found, [key, "stage"], "left").join(proof, [key, "layer"], "left").join(ready, key, "left").join(gates, key, "left")
    own = F.coalesce("_status", F.lit("PENDING_MACHINE"))
    rank = F.least(severity_rank(own), severity_rank(F.col("_evidence")))
    weak = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), rank.cast("int"))
    no = F.lit(False)
    waits = ((F.col("layer") == "human_approval") & F.coalesce("_review", no)) | ((F.col("layer") == "delivery_approval") & F.coalesce("_approved", no))
    called = (F.col("_pos") >= F.col("_gate")) | F.array_contains("_layers", F.col("layer")) | F.array_contains("_layers", F.col("stage"))
    final = F.when((weak == "PENDING_MACHINE") & (waits | F.coalesce(called, no)), "PENDING_HUMAN").otherwise(weak)
    return j.select(key, "layer", "stage", final.alias("status"))


FOREIGN = r"QUARANTINED|LEGACY|BESPOKE"


def ownership(registry: DataFrame, projects: DataFrame, foreign: str = FOREIGN) -> DataFrame:
    """Project each registry row belongs to, by root or by shortcode, and whether a daemon may drive it.

    Later registry rows of one project win, by ``ordinal``.
    """
    code = F.lower(F.regexp_replace("project", r"^reel-|-v\d+$", ""))
    known = projects.select("project", F.lower("project").alias("_name"), code.alias("_code"))
    keys = known.select("project", F.explode(F.array_distinct(F.array("_name", "_code"))).alias("_short")).groupBy("_short").agg(F.min("project").alias("_by_code"))
    linked = registry.withColumn("_short", F.lower(F.trim("shortcode"))).join(keys, "_short", "left")
    project = F.coalesce(F.nullif(F.trim("project_root"), F.lit("")), F.col("_by_code"))
    reason = F.when(F.upper("runtime").rlike(foreign), F.concat(F.lit("runtime is "), F.col("runtime"))).when(
        F.upper("review_state").rlike(foreign), F.concat(F.lit("review_state is "), F.col("review_state"))
    ).when(F.lower(F.trim("driver")) == "agent", "driver is agent")
    rows = linked.withColumn("_project", project).where("_project IS NOT NULL")
    return rows.groupBy(F.col("_project").alias("project")).agg(F.max_by(F.struct(reason.isNull().alias("daemon_owned"), reason.alias("reason"), F.col("shortcode")), "ordinal").alias("o")).select("project", "o.*")


def input_fingerprint(files: DataFrame, key: str = "project", path: str = "path", state: str = "state") -> DataFrame:
    """Digest over a project's (path, state) pairs that does not depend on row order.

    Each pair's digest is cut into four numbers of 60 bits; their sums and the
    count are digested again. Sums combine on the map side, so no list of a
    project's files is made, however many it has.
    """
    line = F.concat_ws("\u001f", F.col(path), F.coalesce(F.col(state), F.lit("")))
    lanes = [F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = files.select(key, F.sha2(line, 256).alias("_d")).groupBy(key).agg(F.count("*").alias("_n"), *(F.sum(x).alias(f"_s{i}") for i, x in enumerate(lanes)))
    return sums.select(key, F.sha2(F.concat_ws(":", "_n", *(f"_s{i}" for i in range(4))), 256).alias("fingerprint"))
