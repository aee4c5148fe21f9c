"""Three-valued verdicts: modal reads, agreement, roll-ups, overlays and deltas.

UNMEASURABLE is never a pass and null is never zero. Every operator here is a
map-side-combinable aggregation or an equi-join on the target key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.text import normalize_ascii
from cutlake.operators.quantiles import exact_quantiles

SEVERITY = ["FAILED", "PENDING_MACHINE", "WITHHELD", "PENDING_HUMAN", "PROVEN"]
AGREEMENT, STABILITY = 0.25, 1.0 / 3.0
TRACK_AGREEMENT, TRACK_STATES = 0.50, 4


def rollup_verdict(verdict: Column) -> Column:
    """Aggregate: FAIL if any, else PASS if any, else UNMEASURABLE."""
    failed = F.coalesce(F.bool_or(verdict == "FAIL"), F.lit(False))
    passed = F.coalesce(F.bool_or(verdict == "PASS"), F.lit(False))
    return F.when(failed, "FAIL").when(passed, "PASS").otherwise("UNMEASURABLE")


def severity_rank(status: Column) -> Column:
    return F.when(status.isin(*SEVERITY), F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status))


def weakest(status: Column) -> Column:
    """Aggregate: the weakest known status; PENDING_MACHINE when there is none."""
    return F.coalesce(F.min_by(status, severity_rank(status)), F.lit("PENDING_MACHINE"))


def combine_authorities(technical: Column, structure: Column, visual: Column, human: Column) -> Column:
    """Struct ``(overall, local_review_ready, publishable)`` from four authorities."""
    machine = [technical, structure, visual]
    anyone = lambda values: reduce(lambda a, b: a | b, [m.isin(*values) for m in machine])
    ready = reduce(lambda a, b: a & b, [m == "PASS" for m in machine])
    overall = (
        F.when((human == "REJECTED") | anyone(["FAIL"]), "REJECT")
        .when(anyone(["BLOCKED", "PENDING"]), "BLOCKED")
        .when(human == "APPROVED", "APPROVED")
        .otherwise("LOCAL_REVIEW_READY")
    )
    return F.struct(
        overall.alias("overall"), ready.alias("local_review_ready"), (ready & (human == "APPROVED")).alias("publishable")
    )


def modal_read(cells: DataFrame, keys: list[str], read: str = "read", ordinal: str = "ordinal", skipped: str = "skipped") -> DataFrame:
    """Most frequent read per key; a tie prefers a non-empty read, then the one seen first.

    Adds ``sample_size``, ``modal_count`` and ``stability``. Keys whose cells
    were all skipped keep a row with a null read.
    """
    measured = F.col(skipped).isNull()
    per_read = cells.groupBy(*keys, F.when(measured, F.col(read)).alias("_read")).agg(
        F.count_if(measured).alias("_n"), F.min(F.when(measured, F.col(ordinal))).alias("_first")
    )
    order = F.struct(F.col("_n"), (F.col("_read") != "").alias("_filled"), (-F.col("_first")).alias("_early"))
    top = per_read.groupBy(*keys).agg(
        F.max_by(F.struct("_read", "_n"), F.when(F.col("_n") > 0, order)).alias("_top"), F.sum("_n").alias("sample_size")
    )
    count = F.coalesce(F.col("_top._n"), F.lit(0).cast("long"))
    share = F.when(F.col("sample_size") > 0, count / F.col("sample_size")).otherwise(0.0)
    return top.select(
        *keys, F.col("_top._read").alias("modal"), count.alias("modal_count"), "sample_size", F.round(share, 4).alias("stability"), share.alias("_share")
    )


def ensemble_resolve(cells: DataFrame, keys: list[str], projection: str, order: str, floor: float = STABILITY) -> DataFrame:
    """First projection whose modal read is non-empty and stable; else the first one, unresolved."""
    modes = modal_read(cells, [*keys, projection, order])
    good = (F.col("sample_size") > 0) & (F.coalesce("modal", F.lit("")) != "") & (F.col("_share") >= floor)
    pick = F.struct(F.col(projection), "modal", "stability", "sample_size")
    chosen = modes.groupBy(*keys).agg(
        F.min_by(pick, F.when(good, F.col(order))).alias("_good"), F.min_by(pick, F.col(order)).alias("_first")
    )
    best = F.coalesce("_good", "_first")
    return chosen.select(*keys, F.col("_good").isNotNull().alias("resolved"), best.alias("b")).select(*keys, "resolved", "b.*")


def agreement(cells: DataFrame, declared: DataFrame, keys: list[str], threshold: float = AGREEMENT) -> DataFrame:
    """Share of measured cells equal to the declared text, per declared key."""
    hits = (
        cells.join(declared.select(*keys, "declared"), keys)
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("skipped").isNull()).alias("sample_size"),
            F.count_if(F.col("skipped").isNull() & (F.col("read") == F.col("declared"))).alias("cells_agreeing"),
        )
    )
    n = F.coalesce("sample_size", F.lit(0).cast("long"))
    share = F.when(n > 0, F.col("cells_agreeing") / n)
    verdict = F.when(share.isNull(), "UNMEASURABLE").when(share >= threshold, "PASS").otherwise("FAIL")
    return declared.select(*keys).join(hits, keys, "left").select(
        *keys, n.alias("sample_size"), F.round(share, 4).alias("agreement"), verdict.alias("verdict")
    )


def word_triage(states: DataFrame) -> DataFrame:
    """Verdict per state with the reference read as control.

    Needs normalised ``reference``, ``delivered`` and ``declared`` (null when
    a read did not resolve) and ``neighbours`` (count of other captions in the crop).
    """
    rn, vn, dn = F.col("reference"), F.col("delivered"), F.col("declared")
    control = F.coalesce(rn == dn, F.lit(False))
    near = (F.col("neighbours") > 0) & (F.coalesce(vn, F.lit("")) != "") & (dn != "") & vn.contains(dn)
    verdict = (
        F.when(control & (vn == dn), "MATCH")
        .when(control & F.coalesce(near, F.lit(False)), "MATCH_PLUS_NEIGHBOUR_TEXT")
        .when(control, "MISMATCH")
        .when(rn.isNull() & vn.isNull(), "UNRESOLVED_TEXT")
        .otherwise("UNVERIFIABLE_BY_READER")
    )
    judged = states.withColumn("verdict", verdict)
    return judged.withColumn("blocking", F.col("verdict").isin("MATCH", "MISMATCH"))


def triage_rollup(triaged: DataFrame, keys: list[str]) -> DataFrame:
    return triaged.groupBy(*keys).agg(
        F.count("*").alias("states_total"),
        F.count_if("blocking").alias("sample_size"),
        F.count_if(F.col("verdict") == "MISMATCH").alias("mismatches"),
        rollup_verdict(F.when(F.col("verdict") == "MISMATCH", "FAIL").when(F.col("verdict") == "MATCH", "PASS")).alias("verdict"),
    )


def _resolved(read: Column, stability: Column, floor: float) -> Column:
    return (normalize_ascii(read) != "") & (F.coalesce(stability, F.lit(0.0)) >= floor)


def _track(ok: Column, wrong: Column) -> Column:
    n = ok + wrong
    return F.when(n < TRACK_STATES, "UNMEASURABLE").when(ok / n < TRACK_AGREEMENT, "FAIL").otherwise("PASS")


def track_agreement(states: DataFrame, keys: list[str], floor: float = STABILITY) -> DataFrame:
    """Roll-up of reference/delivered/declared reads: classes, agreement and both verdicts."""
    norm = normalize_ascii
    r_ok = _resolved(F.col("reference_read"), F.col("reference_stability"), floor)
    d_ok = _resolved(F.col("delivered_read"), F.col("delivered_stability"), floor)
    same = norm(F.col("reference_read")) == norm(F.col("delivered_read"))
    contract = norm(F.col("declared_text")) == norm(F.col("reference_read"))
    counted = states.groupBy(*keys).agg(
        F.count("*").alias("states_total"),
        F.count_if(r_ok & d_ok & same).alias("words_ok"),
        F.count_if(r_ok & d_ok & ~same).alias("wrong_words"),
        F.count_if(r_ok & ~d_ok).alias("unreadable_delivered"),
        F.count_if(~r_ok).alias("unverifiable"),
        F.count_if(r_ok & contract).alias("contract_words_ok"),
        F.count_if(r_ok & ~contract).alias("contract_words_wrong"),
    )
    ok, wrong = F.col("words_ok"), F.col("wrong_words")
    return counted.select(
        "*",
        F.round(F.try_divide(ok, ok + wrong), 4).alias("agreement"),
        _track(ok, wrong).alias("verdict"),
        _track(F.col("contract_words_ok"), F.col("contract_words_wrong")).alias("contract_verdict"),
    )


def override_agreement(states: DataFrame, declared: DataFrame, keys: list[str], floor: float = STABILITY) -> DataFrame:
    """Every resolved delivered read must equal the declared override; none resolved is UNMEASURABLE."""
    read_ok = _resolved(F.col("delivered_read"), F.col("delivered_stability"), floor)
    match = read_ok & (normalize_ascii(F.col("delivered_read")) == normalize_ascii(F.col("override")))
    out = states.join(declared.select(*keys, "override"), keys).groupBy(*keys).agg(
        F.count_if(read_ok).alias("sample_size"), F.count_if(match).alias("agreeing"), F.count("*").alias("states_total")
    )
    n = F.col("sample_size")
    return out.withColumn("verdict", F.when(n == 0, "UNMEASURABLE").when(F.col("agreeing") == n, "PASS").otherwise("FAIL"))


def worst_frame(measures: DataFrame, keys: list[str], frame: str, separation: str, contrast: str, reference: str,
                min_separation: float = 25.0, min_ratio: float = 0.80) -> DataFrame:
    """Worst frame by separation (earliest on a tie), median, ratio to the reference contrast, verdict."""
    worst = F.min_by(F.struct(frame, separation, contrast), F.struct(separation, frame))
    base = measures.groupBy(*keys).agg(worst.alias("w"), F.max(reference).alias("_ref"), F.count("*").alias("sample_size"))
    middle = exact_quantiles(measures, keys, separation, {"median_separation": 0.5}, count="_n").drop("_n")
    ratio = F.when(F.col("_ref") > 0, F.round(F.col(f"w.{contrast}") / F.col("_ref"), 4))
    verdict = (
        F.when(F.col(f"w.{separation}") < min_separation, "FAIL").when(ratio < min_ratio, "FAIL").when(ratio.isNull(), "UNMEASURABLE").otherwise("PASS")
    )
    return base.join(middle, keys, "left").select(
        *keys,
        "sample_size",
        F.col(f"w.{frame}").alias("worst_frame"),
        F.col(f"w.{separation}").alias("worst_separation"),
        F.round("median_separation", 2).alias("median_separation"),
        ratio.alias("ratio"),
        verdict.alias("verdict"),
    )


def contrast_by_layer(measures: DataFrame, keys: list[str], frame: str, ratio: str, threshold: float = 1.8) -> DataFrame:
    """Minimum contrast per layer, its three worst frames, PASS at the threshold.

    The frames come from a per-key top-k, so no layer is collected whole.
    """
    from cutlake.operators.scan import top_k_per

    low = measures.groupBy(*keys).agg(F.min(ratio).alias("minimum"), F.count("*").alias("frames"))
    worst = top_k_per(measures, keys, [F.col(ratio), F.col(frame)], 3).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", frame))), lambda x: x[frame].cast("string")), ",").alias("worst_frames")
    )
    return low.join(worst, keys).withColumn("status", F.when(F.col("minimum") >= threshold, "PASS").otherwise("FAIL"))


def presence(samples: DataFrame, keys: list[str], reference: str, same: str, opposite: str,
             floor: float = 0.003, ceiling: float = 0.55, min_ratio: float = 0.25) -> DataFrame:
    """Is the ink there, at either polarity, relative to the reference's own ink fraction."""
    agg = samples.groupBy(*keys).agg(
        F.max(reference).alias("r"), F.max(same).alias("d"), F.max(opposite).alias("o"), F.count(reference).alias("sample_size")
    )
    enough = lambda x: F.col(x) >= min_ratio * F.col("r")
    verdict = (
        F.when(F.col("r").isNull() | (F.col("r") < floor) | (F.col("r") > ceiling), "UNMEASURABLE")
        .when(enough("d") | enough("o"), "PASS")
        .otherwise("FAIL")
    )
    return agg.select(
        *keys, "sample_size", F.round("r", 6).alias("reference_fraction"), F.round("d", 6).alias("delivered_fraction"),
        verdict.alias("verdict"), F.when(verdict == "PASS", enough("o") & ~enough("d")).otherwise(F.lit(False)).alias("polarity_divergent"),
    )


def separation_margin(scores: DataFrame, keys: list[str], score: str, rejected: str) -> DataFrame:
    """Highest rejected score, lowest accepted score and the gap between them."""
    agg = scores.groupBy(*keys).agg(
        F.max(F.when(F.col(rejected), F.col(score))).alias("rejected_max"), F.min(F.when(~F.col(rejected), F.col(score))).alias("accepted_min")
    )
    return agg.withColumn("margin", F.round(F.col("accepted_min") - F.col("rejected_max"), 4))


def holdout_split(words: DataFrame, keys: list[str], word: str, fraction: float = 0.5) -> DataFrame:
    """Held-out flag per distinct word: the first ``round(n*fraction)`` by digest, at least 1, at most n-1.

    The digest order is cut into 65,536 ranges, so ranking spreads over tasks.
    """
    from cutlake.operators import scan as S

    distinct = words.select(*keys, word).distinct().withColumn("_digest", F.sha2(F.col(word), 256))
    bucket = F.conv(F.substring("_digest", 1, 4), 16, 10).cast("long")
    ranked = S.scan(distinct, keys, ["_digest"], chunk=bucket, _rank=S.position(), _n=S.total(F.lit(1).cast("long")))
    held = F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.rint(F.col("_n") * fraction).cast("long")))
    return ranked.select(*keys, word, (F.col("_rank") <= held).alias("holdout"))


def holdout_proof(scores: DataFrame, keys: list[str], metric: str, word: str, score: str, rival: str, higher: str, bound: str,
                  margin: float = 0.05, min_metrics: int = 2) -> DataFrame:
    """PROVEN when at least two metrics each beat the runner-up by the margin on every held-out word, within bounds.

    ``scores`` has one row per (key, metric, word) with a ``split`` of train or holdout.
    Words on both sides, or metrics without a rival score, keep the key a hypothesis.
    """
    gain = F.when(F.col(higher), F.col(score) - F.col(rival)).otherwise(F.col(rival) - F.col(score)) / F.greatest(F.abs(F.col(rival)), F.lit(1e-9))
    inside = F.when(F.col(bound).isNull(), True).when(F.col(higher), F.col(score) >= F.col(bound)).otherwise(F.col(score) <= F.col(bound))
    good = F.coalesce((gain >= margin) & inside, F.lit(False))
    held = scores.where(F.col("split") == "holdout")
    per_metric = held.groupBy(*keys, metric).agg(F.bool_and(good).alias("ok"))
    judged = per_metric.groupBy(*keys).agg(F.count("*").alias("metrics"), F.count_if("ok").alias("metrics_agreeing"))
    both = (
        scores.groupBy(*keys, word)
        .agg(F.bool_or(F.col("split") == "train").alias("t"), F.bool_or(F.col("split") == "holdout").alias("h"))
        .groupBy(*keys)
        .agg(F.bool_or(F.col("t") & F.col("h")).alias("overlap"), F.bool_or("t").alias("trained"))
    )
    proven = (F.col("metrics") >= min_metrics) & (F.col("metrics") == F.col("metrics_agreeing")) & ~F.col("overlap") & F.col("trained")
    return both.join(judged, keys, "left").select(
        *keys,
        F.coalesce("metrics", F.lit(0).cast("long")).alias("metrics"),
        F.coalesce("metrics_agreeing", F.lit(0).cast("long")).alias("metrics_agreeing"),
        "overlap",
        F.when(F.coalesce(proven, F.lit(False)), "HOLDOUT_PROVEN").otherwise("HYPOTHESIS").alias("identity_status"),
    )


def expected_vs_observed(fixtures: DataFrame, checks: list[str], expected: str = "expected") -> DataFrame:
    """Observed verdict of a fixture from its boolean checks, and whether it meets the expectation."""
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(False)) for c in checks])
    observed = (
        F.when(F.col(expected) == "REJECTED", F.when(ok, "REJECTED").otherwise("FALSE_PASS"))
        .when(F.col(expected) == "UNRESOLVED", F.when(ok, "UNRESOLVED").otherwise("UNVERIFIED"))
        .otherwise(F.when(ok, "ACCEPTED").otherwise("UNVERIFIED"))
    )
    return fixtures.withColumn("observed", observed).withColumn("status", F.when(ok & (observed == F.col(expected)), "PASS").otherwise("FAIL"))


def keyed_diff(ours: DataFrame, theirs: DataFrame, keys: list[str], vector: str, limit: float = 6.0) -> DataFrame:
    """Euclidean distance of two vectors per key; a key without a counterpart is unjudged, not a pass."""
    other = theirs.select(*keys, F.col(vector).alias("_theirs"))
    joined = ours.select(*keys, vector).join(other, keys, "left")
    squares = F.zip_with(F.col(vector), F.col("_theirs"), lambda a, b: F.pow(a.cast("double") - b, 2))
    distance = F.when(F.col("_theirs").isNotNull(), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))
    verdict = F.when(distance.isNull(), "UNMATCHED").when(distance <= limit, "PASS").otherwise("FAIL")
    return joined.select(*keys, F.round(distance, 4).alias("distance"), verdict.alias("verdict"))


def overlay_shards(base: DataFrame, tail: DataFrame, repass: DataFrame, gate: str) -> DataFrame:
    """Base gate results with tail targets replaced or added and one gate re-measured.

    Columns: target, gate, verdict. Tail targets replace a base target whole and
    are exempt from the re-pass; a re-passed verdict keeps the old one as history.
    """
    tails = tail.select("target").distinct()
    kept = base.join(tails, "target", "left_anti").withColumn("source", F.lit("base"))
    merged = kept.unionByName(tail.withColumn("source", F.lit("tail")))
    fresh = repass.where(F.col("gate") == gate).select("target", "gate", F.col("verdict").alias("_new")).withColumn("_hit", F.lit(True))
    # A re-measured gate also lands on base targets that did not have the gate yet.
    adds = (
        fresh.join(kept.select("target").distinct(), "target", "left_semi")
        .join(kept.where(F.col("gate") == gate).select("target"), "target", "left_anti")
        .select("target", "gate", F.col("_new").alias("verdict"), F.lit(None).cast("string").alias("previous"), F.lit("repass").alias("source"))
    )
    joined = merged.join(fresh, ["target", "gate"], "left")
    swap = F.col("_hit") & (F.col("source") == "base")
    updated = joined.select(
        "target",
        "gate",
        F.when(swap, F.col("_new")).otherwise(F.col("verdict")).alias("verdict"),
        F.when(swap, F.col("verdict")).alias("previous"),
        F.when(swap, "repass").otherwise(F.col("source")).alias("source"),
    )
    return updated.unionByName(adds)


def first_wins_merge(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame that names a key; keys are unique inside a frame."""
    tagged = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    best = merged.groupBy(key).agg(F.min_by(F.struct(*[c for c in merged.columns if c not in (key, "_rank")]), "_rank").alias("r"))
    return best.select(key, "r.*")


def delta(before: Column, after: Column) -> Column:
    """How a gate moved between two runs."""
    blind = lambda v: v.isNull() | (v == "UNMEASURABLE")
    return (
        F.when(blind(after), "UNMEASURABLE")
        .when(blind(before), "NOW-MEASURABLE")
        .when(before == "FAIL", F.when(after == "PASS", "FIXED").otherwise("STILL-BROKEN"))
        .when(after == "PASS", "HELD")
        .otherwise("REGRESSED")
    )


def delta_join(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Current results with their movement against a baseline."""
    prior = baseline.select(*keys, F.col("verdict").alias("_before"))
    return current.join(prior, keys, "left").select(*keys, "verdict", delta(F.col("_before"), F.col("verdict")).alias("delta"))


def severity_order(targets: DataFrame, gates: list[str]) -> DataFrame:
    """Worst targets first: skipped last, then by 100 per failed gate plus mismatches and missing states."""
    fails = reduce(lambda a, b: a + b, [F.when(F.col(g) == "FAIL", 1).otherwise(0) for g in gates])
    weight = fails * 100 + F.coalesce("mismatches", F.lit(0)) + F.coalesce("missing", F.lit(0))
    skipped = F.coalesce(F.col("status") == "SKIPPED", F.lit(False))
    scored = targets.withColumn("severity", F.when(skipped, F.lit(None)).otherwise(weight).cast("long"))
    return scored.orderBy(skipped, F.col("severity").desc_nulls_last(), "target")


def contrast_gate(pixels: DataFrame, keys: list[str], ratio: str) -> DataFrame:
    """PASS: c10 >= 3, c50 >= 4.5, under 10 % below 3. SEVERE: c50 < 3 or half the pixels below 3. Else FAIL."""
    q = exact_quantiles(pixels, keys, ratio, {"c10": 0.10, "c50": 0.50})
    low = pixels.groupBy(*keys).agg(F.avg(F.when(F.col(ratio) < 3.0, 1.0).otherwise(0.0)).alias("below3"))
    ok = (F.col("c10") >= 3.0) & (F.col("c50") >= 4.5) & (F.col("below3") < 0.10)
    return q.join(low, keys).select(
        *keys, "n", F.round("c10", 6).alias("c10"), F.round("c50", 6).alias("c50"), F.round("below3", 6).alias("below3"),
        F.when(ok, "PASS").when((F.col("c50") < 3.0) | (F.col("below3") >= 0.50), "SEVERE").otherwise("FAIL").alias("verdict"),
    )


def colour_gate(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Luma quantile, saturation and highlight errors of ``ours_*`` against ``ref_*`` columns."""
    err = lambda name: F.abs(F.col(f"ours_{name}") - F.col(f"ref_{name}"))
    checks = {
        "q10": err("q10") <= 0.05, "q50": err("q50") <= 0.05, "q90": err("q90") <= 0.05,
        "saturation": err("saturation") <= 0.06, "highlight": err("highlight") * 100 <= 5.0,
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]))
    return stats.select(*keys, F.array_join(failed, ",").alias("failed"), F.when(F.size(failed) == 0, "PASS").otherwise("FAIL").alias("verdict"))
