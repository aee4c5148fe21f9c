"""Hand-made cases: ledger folds, verdicts, durations, families, queues, retrieval."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cutlake.functions import rules as R
from cutlake.functions import text as X
from cutlake.functions import timecode as T
from cutlake.operators import durations as D
from cutlake.operators import joins as J
from cutlake.operators import ledger as L
from cutlake.operators import retrieval as A
from cutlake.operators import reuse as U
from cutlake.operators import verdicts as V
from cutlake.streaming import jobs as Q

T0 = datetime(2026, 3, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_null_never_erases(spark):
    rows = [(1, "a", "HERO", None, None, None), (2, "a", None, "ME", None, None), (3, "a", "NEVER", None, 0.0, 5.0), (4, "a", "BROLL", None, 0.0, 5.0), (5, "a", "NEVER", None, 1.0, None)]
    df = spark.createDataFrame(rows, "seq int, stem string, grade string, ident string, t0 double, t1 double").withColumns({"ts": F.lit(T0), "clip_id": F.lit("c")})
    r = L.fold_grades(df).first()
    assert (r.grade, r.ident, r.segments) == ("HERO", "ME", {"0.00-5.00": "BROLL"})
    # The casting reader takes half a window as a whole-clip line.
    assert L.fold_grades(df, strict=True).first().grade == "NEVER"


@pytest.mark.parametrize("d,n,first", [(7.0, 1, 7.0), (7.5, 2, 3.75), (12.5, 2, 6.25), (17.5, 4, 4.38), (0.0, 0, None), (None, 0, None)])
def test_segment_grid(spark, d, n, first):
    grid = one(spark, T.segments(F.lit(d).cast("double")))
    assert len(grid) == n
    if n:
        assert grid[0].t1 == first and grid[-1].t1 == d


@pytest.mark.parametrize("x", [14.175, 2.675, 1.005, 0.125, 0.375, -1.115, 9.995, 4.375])
def test_round_exact_is_python_round(spark, x):
    assert one(spark, T.round_exact(F.lit(x), 2)) == round(x, 2)


def test_cut_three_frames_off_fails(spark):
    cuts = spark.createDataFrame([("a", 12), ("b", 15), ("c", 3)], "asset string, frame long")
    onsets = spark.createDataFrame([("a", 10), ("b", 12)], "asset string, frame long")
    expected = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 0)], "asset string, expected_cuts int")
    got = {r.asset: r.verdict for r in J.beat_verdict(J.beat_alignment(cuts, onsets, ["asset"]), expected, ["asset"]).collect()}
    assert got == {"a": "PASS", "b": "FAIL", "c": "FAIL", "d": "FAIL", "e": "PASS"}


def test_rollup_of_nothing_is_unmeasurable(spark):
    rows = [("a", "PASS"), ("a", "FAIL"), ("b", "PASS"), ("b", "UNMEASURABLE"), ("c", "UNMEASURABLE"), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v string")
    assert {r.k: r.x for r in df.groupBy("k").agg(V.rollup_verdict(F.col("v")).alias("x")).collect()} == {"a": "FAIL", "b": "PASS", "c": "UNMEASURABLE", "d": "UNMEASURABLE"}
    assert df.where("false").agg(V.weakest(F.col("v")).alias("x")).first().x == "PENDING_MACHINE"


def test_modal_read_ties(spark):
    rows = [("a", "", 1, None), ("a", "x", 2, None), ("b", "y", 2, None), ("b", "x", 3, None), ("c", "z", 1, "blank")]
    got = {r.k: (r.modal, r.sample_size) for r in V.modal_read(spark.createDataFrame(rows, "k string, read string, ordinal int, skipped string"), ["k"]).collect()}
    assert got == {"a": ("x", 2), "b": ("y", 2), "c": (None, 0)}


@pytest.mark.parametrize("before,after,want", [("FAIL", "PASS", "FIXED"), ("FAIL", "FAIL", "STILL-BROKEN"), ("PASS", "FAIL", "REGRESSED"), ("PASS", "PASS", "HELD"), (None, "PASS", "NOW-MEASURABLE"), ("PASS", None, "UNMEASURABLE")])
def test_delta(spark, before, after, want):
    assert one(spark, V.delta(F.lit(before).cast("string"), F.lit(after).cast("string"))) == want


def test_learned_durations(spark):
    """Eleven rows of ten events: build two hours, audit one, fix three; feasibility keeps its prior."""
    steps = [("feasibility", None, 0), ("build", None, 2), ("audit", None, 1), ("fix", 1, 3), ("audit", None, 1), ("fix", 2, 3), ("audit", None, 1), ("fix", 3, 3), ("audit", None, 1), ("deliver", None, 0.5)]
    rows = []
    for row in range(11):
        at = T0 + timedelta(days=row)
        for phase, fix, hours in steps:
            at += timedelta(hours=hours)
            rows.append((row, at, len(rows), phase, fix))
    events = spark.createDataFrame(rows, "row int, ts timestamp, event_id long, phase string, fix_round int")
    kept = D.dedupe_within(events, minutes=30)
    model = {(r.part, r.phase): (r.median_h, r.source) for r in D.fit_durations(kept).collect()}
    assert model[("phase", "build")] == (2.0, "history") and model[("phase", "audit")] == (1.0, "history") and model[("phase", "fix")] == (3.0, "history")
    assert model[("phase", "deliver")] == (0.5, "history") and model[("phase", "feasibility")] == (0.75, "prior")
    assert model[("fix_rounds", "fix")] == (3.0, "history") and model[("total_hours", "run")][0] == 15.5


def test_window_change_is_not_a_changed_slot(spark):
    slot = lambda v, s, src, at: ("f", v, s, "r", 24, src, at, at + 24)
    rows = [slot(None, "p1", "A", 0), slot(None, "p2", "B", 0), slot("v1", "p1", "C", 0), slot("v1", "p2", "B", 99), slot("v2", "p1", "C", 0), slot("v2", "p2", "D", 0)]
    df = spark.createDataFrame(rows, "family string, variant string, slot_id string, role string, frames int, source_sha256 string, source_start_frame long, source_end_frame long")
    got = {r.variant: (r.changed, r.faults) for r in U.family_audit(df, F.lit("p1"), 2, 2, 0.5).collect()}
    assert got == {"v1": (1, "too_few_changes"), "v2": (2, "opening_reused")}


def test_superseded_but_delivered_counts(spark):
    rows = [(2, "p1", "M1", "v2", "f2", "base", "", 1), (2, "p1", "M2", "v2", "f3", "supersede", "", 2), (2, "p1", "M3", "v2", "f4", "supersede", "", 3), (1, "p9", "M3", "v1", "f1", "historic", "v001:", 1)]
    df = spark.createDataFrame(rows, "row int, slot string, master_id string, version string, file string, kind string, prefix string, ordinal int")
    slots = U.delivered_slots(df)
    assert {(r.row, r.slot, r.master_id) for r in slots.collect()} == {(2, "p1", "M3"), (1, "v001:p9", "M3")}
    assert [(r.master_id, r.first_row) for r in U.first_ship(slots).collect()] == [("M3", 1)]


@pytest.mark.parametrize("width", [1, 10**15])
def test_defer_keeps_the_attempt(spark, width):
    runs = {
        1: ["enqueue", "claim", "start", "defer", "claim", "fail", "claim", "enqueue", "fail"], 2: ["claim", "enqueue", "enqueue", "claim", "start", "finish"], 3: ["enqueue", "defer", "fail", "defer"], 4: ["start"],
    }
    rows = [(p, i, a, T0 + timedelta(minutes=i)) for p, acts in runs.items() for i, a in enumerate(acts)]
    df = spark.createDataFrame(rows, "project long, seq long, action string, ts timestamp").repartition(3)
    got = {r.project: (r.status, r.attempt) for r in Q.job_state(df, width=width).collect()}
    assert got == {1: ("FAILED", 2), 2: ("DONE", 0), 3: ("QUEUED", 1), 4: ("NONE", 0)}


def test_parse_options_runs(spark):
    got = one(spark, X.parse_options(F.lit("Keep the v2 = cut? RULING 1 = keep it. 2 = drop it, 5 = x or")))
    assert got.prefix == "Keep the v2 = cut? " and [(o.n, o.label) for o in got.options] == [("1", "keep it"), ("2", "drop it, 5 = x")]
    assert one(spark, X.parse_options(F.lit("1 = only"))).options == []
    assert one(spark, X.question_sentence(F.lit("It runs. Does it fit? "), F.lit(True))) == "Does it fit?"


def test_normalize_text(spark):
    df = spark.createDataFrame([("That's Ｆｉｎｅ ﬁ",), ("GARDEN!",), (None,)], "t string")
    assert [r.x for r in df.select(X.normalize_text(F.col("t")).alias("x")).collect()] == ["thatsfinefi", "garden", ""]


def test_alias_table_last_definition_wins(spark):
    got = set(one(spark, X.tokens(F.lit("The walking athlete on a road, x"))))
    assert got == {"walking", "motion", "athlete", "human", "road", "vehicle"}


def test_clip_ids(spark):
    assert one(spark, R.normalise_clip_id(F.lit("a/b\\0123__CLIP_0061.MP4"))) == "CLIP_0061"
    assert one(spark, R.normalise_clip_id(F.lit("x__take.1"))) == "take.1"
    assert one(spark, R.master_id(F.lit("day 3/ab__CAM_0002.MP4"))) == "CAM_0002"
    assert one(spark, R.master_id(F.lit("a note about CLIP_0001 here"))) is None


def _roles(spark):
    rows = [("walk", "walking arrival", "subject walking", 2.0), ("none", "zzz", "", None)]
    df = spark.createDataFrame(rows, "id string, role string, reference_observation string, target_duration double")
    return df.withColumns({"composition": F.lit(""), "substitute_requirements": F.array().cast("array<string>"), "target_luma": F.lit(100.0), "target_sat": F.lit(None).cast("double")})


def test_shortlist_action_and_wordless_roles(spark):
    """A visible action ranks over a static overlap, and a role no clip shares a word with is still ranked whole."""
    rows = [("a.mov", ["walking street"], 4.0, 0.2, 90.0), ("b.mov", ["walking arrival subject seated static"], 4.0, 0.0, 10.0), ("c.mov", ["garden"], 1.0, 0.5, 100.0), ("d.mov", ["hall"], 9.0, 0.0, None)]
    cat = spark.createDataFrame(rows, "path string, semantic_groups array<string>, duration_s double, motion_speed double, luma_p50 double")
    none = F.array().cast("array<string>")
    cat = cat.withColumns({"clip_id": F.col("path"), "labels": none, "families": none, "local_peaks": F.lit(0), "motion_label": F.lit(""), "poses": F.lit(0), "faces": F.lit(0), "sat_p50": F.lit(None).cast("double"), "laplacian_var": F.lit(None).cast("double")})
    got = A.shortlist(_roles(spark), cat, cat, top_n=4).collect()
    rank = {(r.role_id, r["rank"]): (r.path, r.score) for r in got}
    assert rank[("walk", 1)][0] == "a.mov" and len(rank) == 8
    assert [rank[("none", i)][0] for i in (1, 2, 3, 4)] == ["c.mov", "a.mov", "b.mov", "d.mov"]
    assert rank[("none", 1)][1] == 1.5


def test_spread_assignment_has_no_silent_repeat(spark):
    rows = [("f", s, f"c{i}") for s in ("s1", "s2", "s3") for i in range(5)] + [("f", "s4", "c0")]
    out = A.spread_assignment(spark.createDataFrame(rows, "family string, slot string, clip_id string"), 3, "seed").collect()
    assert len(out) == 12
    for v in (1, 2, 3):
        kept = [r.clip_id for r in out if r.variant == v and r.choice != "conflict"]
        assert len(kept) == len(set(kept))


def test_red_check_fails_on_mutation(spark):
    rows = [("a", i, str(i)) for i in range(4)]
    good = spark.createDataFrame(rows, "k string, i int, v string")
    assert J.ledger_equal(good, good, ["k"], "i", "v").first().verdict == "PASS"
    bad = good.withColumn("v", F.when(F.col("i") == 2, "x").otherwise(F.col("v")))
    r = J.ledger_equal(good, bad, ["k"], "i", "v").first()
    assert (r.verdict, r.first_divergence, r.divergent) == ("FAIL", 2, 1)
