"""Change points, onsets, tempo, scenes and level ramps on per-frame and per-hop series.

Series positions are integers, one row per (key, position). Windows of a fixed
reach run inside chunks that carry a margin of neighbouring rows (``halo``), so
a long asset spreads over tasks; unbounded state goes through the chunked scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions import timecode as T
from cutlake.operators import scan as S
from cutlake.operators.nearest import as_of
from cutlake.operators.quantiles import median_and_mad


def halo(df: DataFrame, keys: list[str], pos: str, reach: int, width: int, columns: dict) -> DataFrame:
    """Add window columns that look at most ``reach`` positions away.

    Each row also visits every other chunk that has a position within reach;
    ``columns`` maps names to functions of the window spec; visitors drop out.
    """
    at = lambda shift: F.floor((F.col(pos) + shift) / F.lit(float(width)))
    spread = df.withColumn("_home", at(0)).withColumn("_chunk", F.explode(F.sequence(at(-reach), at(reach))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    seen = spread.select("*", *[make(w).alias(name) for name, make in columns.items()])
    return seen.where("_chunk = _home").drop("_chunk", "_home")


def merge_peaks(hits: DataFrame, keys: list[str], pos: str, height: str, gap: int, width: float | None = None) -> DataFrame:
    """Fold hits left to right: closer than ``gap`` to the last kept one, the strictly higher survives.

    A hit at least ``gap`` after the hit before it always starts anew, so the
    fold runs on each cluster of close hits by itself.
    """
    rows = hits.select(*keys, F.col(pos).cast("long").alias(pos), F.col(height).cast("double").alias(height))
    cluster = S.islands(rows, keys, [pos], [pos], lambda b, r: r[pos] - b[pos] >= gap, width, "_c")
    n = len(keys)

    def fold():
        last: list[tuple] = []

        def row(values: tuple) -> list[tuple]:
            x, done = values[: n + 2], []
            if last and x[n] - last[0][n] < gap:
                if x[n + 1] > last[0][n + 1]:
                    last[0] = x
            else:
                done = last.copy()
                last[:] = [x]
            return done

        return row, lambda: last

    kinds = dict(rows.dtypes)
    return S.walk(cluster.withColumn("_c", F.to_json("_c")), [*keys, "_c"], [pos], fold, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns))


def bhattacharyya(a: Column, b: Column) -> Column:
    """Histogram distance sqrt(1 - sum(sqrt(ab)) / sqrt(sum(a) sum(b)))."""
    plus = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    shared = plus(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)))
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - shared / F.sqrt(plus(a) * plus(b))))


def cut_scores(frames: DataFrame, keys: list[str], frame: str, hist: str, lab_delta: str) -> DataFrame:
    """0.55 x pixel change + 0.45 x histogram distance to the frame before; first frames have no score."""
    before = S.scan(frames, keys, [frame], _h=S.prev(hist))
    score = 0.55 * F.col(lab_delta) + 0.45 * bhattacharyya(F.col("_h"), F.col(hist))
    return before.where("_h IS NOT NULL").select(*keys, frame, score.alias("score"))


def detect_cuts(scores: DataFrame, keys: list[str], frame: str, score: str) -> DataFrame:
    """Frames whose score clears the adaptive threshold, close ones merged to the highest; with the threshold used."""
    mad = median_and_mad(scores, keys, score, {"q95": 0.95})
    limit = F.greatest(
        F.lit(0.115), F.col("median") + 8.0 * F.greatest(F.col("mad"), F.lit(0.002)), F.least(F.lit(0.35), F.col("q95") * 0.68)
    )
    limits = mad.select(*keys, limit.alias("threshold"))
    hits = scores.join(limits, keys).where(F.col(score) >= F.col("threshold"))
    kept = merge_peaks(hits, keys, frame, score, 3)
    return kept.join(hits.select(*keys, frame, "threshold").dropDuplicates([*keys, frame]), [*keys, frame])


def blocks_from_cuts(clocks: DataFrame, cuts: DataFrame, keys: list[str], frame: str, length: str) -> DataFrame:
    """Half-open blocks p001... covering each clock; a boundary outside the clock is an error."""
    placed = cuts.select(*keys, F.col(frame).cast("long").alias("_b")).distinct().join(clocks.select(*keys, F.col(length).alias("_n")), keys)
    bad = (F.col("_b") < 0) | (F.col("_b") >= F.col("_n") - 1)
    checked = placed.withColumn("_b", F.when(bad, F.raise_error(F.concat(F.lit("boundary outside the clock: "), F.col("_b").cast("string")))).otherwise(F.col("_b")))
    ends = checked.select(*keys, "_b").unionByName(clocks.select(*keys, (F.col(length) - 1).cast("long").alias("_b")))
    walked = S.scan(ends, keys, ["_b"], _p=S.prev("_b"), _i=S.position())
    number = F.col("_i").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    start = F.coalesce(F.col("_p") + 1, F.lit(0).cast("long"))
    return walked.select(*keys, F.concat(F.lit("p"), padded).alias("block_id"), start.alias("start_frame"), (F.col("_b") + 1).alias("end_frame"))


def flux_envelope(hops: DataFrame, keys: list[str], pos: str, flux: str, reach: int = 15, width: int = 4096) -> DataFrame:
    """Flux above its centred moving mean, edges padded with the end values, scaled to a maximum of one."""
    ends = hops.groupBy(*keys).agg(
        F.min_by(flux, pos).alias("_first"), F.max_by(flux, pos).alias("_last"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi")
    )
    summed = halo(hops, keys, pos, reach, width, {"_sum": lambda w: F.sum(flux).over(w.rangeBetween(-reach, reach))}).join(ends, keys)
    before = F.greatest(F.lit(0), reach - (F.col(pos) - F.col("_lo")))
    after = F.greatest(F.lit(0), reach - (F.col("_hi") - F.col(pos)))
    mean = (F.col("_sum") + before * F.col("_first") + after * F.col("_last")) / (2 * reach + 1)
    raised = summed.select(*hops.columns, F.greatest(F.lit(0.0), F.col(flux) - mean).alias("_e"))
    top = raised.groupBy(*keys).agg(F.max("_e").alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col("_e") / F.col("_top")).otherwise(F.col("_e"))
    return raised.join(top, keys).select(*hops.columns, scaled.alias("env"))


def _neighbours(df: DataFrame, keys: list[str], pos: str, value: str, width: int) -> DataFrame:
    return halo(df, keys, pos, 1, width, {"_l": lambda w: F.lag(value).over(w), "_r": lambda w: F.lead(value).over(w)})


def pick_onsets(env: DataFrame, keys: list[str], pos: str, value: str, threshold: float = 0.12, gap: int = 4, width: int = 4096) -> DataFrame:
    """Local maxima above a level, the higher kept within the gap; series ends never count."""
    near = _neighbours(env, keys, pos, value, width)
    v = F.col(value)
    return merge_peaks(near.where((v >= F.col("_l")) & (v > F.col("_r")) & (v > threshold)), keys, pos, value, gap)


def energy_onsets(hops: DataFrame, keys: list[str], pos: str, energy: str, gap: int = 5, width: int = 4096) -> DataFrame:
    """Rises of energy that stand out from the series' own median rise."""
    before = halo(hops, keys, pos, 1, width, {"_p": lambda w: F.lag(energy).over(w)})
    novelty = before.select(*keys, pos, F.greatest(F.lit(0.0), F.coalesce(F.col(energy) - F.col("_p"), F.lit(0.0))).alias("strength"))
    stats = median_and_mad(novelty, keys, "strength")
    limits = stats.select(*keys, (F.col("median") + 5.0 * F.greatest(F.col("mad"), F.lit(1e-5))).alias("_t"))
    near = _neighbours(novelty, keys, pos, "strength", width).join(limits, keys)
    v = F.col("strength")
    return merge_peaks(near.where((v >= F.col("_t")) & (v >= F.col("_l")) & (v >= F.col("_r"))), keys, pos, "strength", gap)


def tempo(env: DataFrame, keys: list[str], pos: str, value: str, rate: float, low: float = 55.0, high: float = 200.0, top: int = 8, width: int = 4096) -> DataFrame:
    """Strongest autocorrelation peaks between two tempi.

    Products with each earlier hop come from lag columns inside chunks that
    carry the needed margin; the sums combine map-side.
    """
    import math

    first, last = max(1, math.ceil(60.0 * rate / high)), math.floor(60.0 * rate / low)
    lags = range(max(1, first - 1), last + 2)
    mean = env.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count("*").alias("_n"))
    centred = env.join(mean, keys).select(*keys, pos, "_n", (F.col(value) - F.col("_m")).alias("_e"))
    seen = halo(centred, keys, pos, last + 1, width, {f"_{k}": (lambda w, k=k: F.lag("_e", k).over(w)) for k in lags})
    sums = seen.groupBy(*keys, "_n").agg(*[F.sum(F.col("_e") * F.col(f"_{k}")).alias(f"_{k}") for k in lags])
    long = sums.unpivot([*keys, "_n"], [f"_{k}" for k in lags], "_lag", "strength").withColumn("lag", F.substring("_lag", 2, 9).cast("int"))
    w = Window.partitionBy(*keys).orderBy("lag")  # one row per lag: bounded by the tempo range
    before = F.when(F.col("lag") == 1, F.lit(0.0)).otherwise(F.lag("strength").over(w))
    peaks = long.select("*", before.alias("_b"), F.lead("strength").over(w).alias("_a")).where(
        F.col("lag").between(first, last) & (F.col("lag") < F.col("_n") - 1) & (F.col("strength") >= F.col("_b")) & (F.col("strength") >= F.col("_a"))
    )
    ranked = S.top_k_per(peaks, keys, [F.col("strength").desc(), F.col("lag")], top)
    return ranked.select(*keys, "rank", "lag", F.lit(60.0 * rate) / F.col("lag"), "strength").toDF(*keys, "rank", "lag", "bpm", "strength")


def grid_phase(onsets: DataFrame, grids: DataFrame, keys: list[str], seconds: str, phases: int = 200) -> DataFrame:
    """Phase of a beat grid that most onsets land on (within a tenth of a beat); the first best wins.

    ``grids``: keys, bpm, window_end. Counts combine map-side per (key, phase).
    """
    period = F.lit(60.0) / F.col("bpm")
    tried = onsets.join(grids, keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(phases - 1)))).withColumn("_ph", F.col("_i") * (period / phases))
    beats = F.greatest(F.ceil((F.col("window_end") - F.col("_ph")) / period), F.lit(0))
    k = F.least(F.greatest(F.rint((F.col(seconds) - F.col("_ph")) / period), F.lit(0.0)), beats - 1.0)
    off = F.abs(F.col(seconds) - F.col("_ph") - k * period)
    counted = tried.where(beats >= 2).groupBy(*keys, "_i", "_ph", beats.alias("beats")).agg(F.count_if(off < period * 0.10).alias("hits"))
    best = counted.groupBy(*keys).agg(F.max_by(F.struct("_ph", "hits", "beats"), F.struct("hits", -F.col("_i"))).alias("b"))
    return best.select(*keys, F.col("b._ph").alias("phase"), F.col("b.hits").alias("on_grid"), F.round(F.col("b.hits") / F.col("b.beats") * 100, 1).alias("hit_percent"))


def song_window(hops: DataFrame, keys: list[str], pos: str, rms: str, hop_seconds: float, need: float, hinge: float, width: int = 4096) -> DataFrame:
    """Start of the stretch whose biggest energy lift falls on the hinge."""
    k = int(1.0 / hop_seconds)
    right = (k - 1) // 2
    smooth = halo(hops, keys, pos, k, width, {"_s": lambda w: F.sum(rms).over(w.rangeBetween(right - (k - 1), right)) / k})
    lifted = halo(smooth, keys, pos, 2 * k, width, {"_b": lambda w: F.lag("_s", 2 * k).over(w)})
    length = hops.groupBy(*keys).agg(((F.max(pos) + 1) * hop_seconds).alias("_dur"))
    at = F.col(pos) * hop_seconds
    legal = lifted.join(length, keys).where((at > hinge + 2) & (at < F.col("_dur") - (need - hinge) - 1))
    lift = F.coalesce(F.col("_s") - F.col("_b"), F.lit(0.0))
    drop = legal.groupBy(*keys).agg(F.max_by(F.col(pos), F.struct(F.round(lift, 9), -F.col(pos))).alias("_d"))
    found = length.join(drop, keys, "left")
    when = F.col("_d") * hop_seconds
    return found.select(*keys, F.round(F.coalesce(F.greatest(F.lit(0.0), when - hinge), F.lit(0.0)), 6).alias("start"), F.round(when, 2).alias("drop"))


def scenes(clips: DataFrame, keys: list[str], ts: str, tie: str, family: str, duration: str, gap_minutes: int = 12) -> DataFrame:
    """Consecutive clips of one family and one side of the day, less than the gap apart.

    The gap is measured in true seconds, so one of a day and five minutes is a gap.
    """
    night = T.is_night(F.col(ts))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = clips.withColumns({"night": night, "_us": us})
    broken = lambda b, r: (b[family] != r[family]) | (b["night"] != r["night"]) | (r["_us"] - b["_us"] >= gap_minutes * 60_000_000)
    run = S.islands(rows, keys, [ts, tie], [family, "night", "_us"], broken, label="_run")
    grouped = run.groupBy(*keys, "_run").agg(
        F.min(family).alias("family"), F.bool_and("night").alias("night"), F.min(ts).alias("start"), F.count("*").alias("clips"),
        F.sum(F.when(F.col(duration) < 3.0, 1).otherwise(2)).alias("capacity"),
    )
    numbered = S.scan(grouped.withColumn("_tie", F.col(f"_run.{tie}")), keys, ["start", "_tie"], scene=S.position())
    return numbered.withColumn("story_day", T.story_day(F.col("start"))).drop("_run", "_tie")


def display_clock(scene_rows: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """Minutes of a display clock from 07:00 to 17:30 in tens, strictly rising in scene order."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = scene_rows.groupBy(*keys).agg(F.min(us).alias("_a"), F.max(us).alias("_b"))
    span = F.greatest(F.col("_b") - F.col("_a"), F.lit(1_000_000))
    minute = F.floor((420 + (us - F.col("_a")) / span * 630) / 10) * 10
    rows = S.scan(scene_rows.join(ends, keys).withColumn("_m", minute.cast("long")), keys, [ts, tie], _i=S.position())
    top = S.scan(rows.withColumn("_x", F.col("_m") - 10 * F.col("_i")), keys, [ts, tie], _t=S.running_max("_x"))
    return top.select(*scene_rows.columns, (F.col("_t") + 10 * F.col("_i")).alias("display_minute"))


def monotonic_audit(edl: DataFrame, keys: list[str], order: str, ts: str, night: str) -> DataFrame:
    """Cut-list neighbours that run backwards in time, and clips on the wrong side of the day."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = edl.withColumns({"_us": us, "_day": T.story_day(F.col(ts))})
    seen = S.scan(rows, keys, [order], _p=S.prev("_us"), _pn=S.prev(night), _pd=S.prev("_day"))
    back = (F.col("_pn") == F.col(night)) & (F.col("_us") < F.col("_p") - 120_000_000) & (F.col("_pd") == F.col("_day"))
    named = F.array_compact(F.array(F.when(back, F.lit("time_goes_backwards")), F.when(T.is_night(F.col(ts)) != F.col(night), F.lit("wrong_side"))))
    return seen.select(*keys, order, F.explode(named).alias("violation"))


def peak_run(profile: DataFrame, keys: list[str], pos: str, value: str, share: float) -> DataFrame:
    """Contiguous run around the maximum that stays at or above a share of it: [lo, hi)."""
    top = profile.groupBy(*keys).agg(F.max(value).alias("_peak"), F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("_at"), F.max(pos).alias("_last"))
    low = profile.join(top, keys).where((F.col("_peak") > 0) & (F.col(value) < share * F.col("_peak")))
    edges = low.groupBy(*keys).agg(
        F.max(F.when(F.col(pos) < F.col("_at"), F.col(pos))).alias("_l"), F.min(F.when(F.col(pos) > F.col("_at"), F.col(pos))).alias("_r")
    )
    first = profile.groupBy(*keys).agg(F.min(pos).alias("_first"))
    out = top.join(edges, keys, "left").join(first, keys)
    return out.select(
        *keys,
        F.when(F.col("_peak") <= 0, 0).otherwise(F.coalesce(F.col("_l") + 1, F.col("_first"))).cast("long").alias("lo"),
        F.when(F.col("_peak") <= 0, 0).otherwise(F.coalesce(F.col("_r"), F.col("_last") + 1)).cast("long").alias("hi"),
    )


def level_ramp(series: DataFrame, keys: list[str], pos: str, ours: str, reference: str, tolerance: float, limit: float, width: int = 4096) -> DataFrame:
    """Per-frame correction reference - ours, smoothed by a median of up to five and clamped.

    Keys shorter than three frames, or already within tolerance everywhere, give no rows.
    """
    raw = series.select(*keys, pos, (F.col(reference) - F.col(ours)).alias("_r"))
    listed = halo(raw, keys, pos, 2, width, {"_w": lambda w: F.collect_list("_r").over(w.rangeBetween(-2, 2))})
    middle = F.element_at(F.array_sort("_w"), (F.floor(F.size("_w") / 2) + 1).cast("int"))
    ramp = listed.select(*keys, pos, F.greatest(F.lit(-limit), F.least(F.lit(limit), middle)).alias("delta"))
    moved = ramp.groupBy(*keys).agg(F.max(F.abs("delta")).alias("_top"), F.count("*").alias("_n")).where((F.col("_top") >= tolerance) & (F.col("_n") >= 3))
    return ramp.join(moved.select(*keys), keys)


# Entry curves: one row per frame of one caption's life. A window over a curve
# is bounded by the time that caption is on screen.

ONSET_ALPHA, ONSET_FIT, MIN_CONTAIN, SCALE = 0.22, 0.55, 0.60, (0.80, 1.30)
SHARP_SIGMA, SHARP_ALPHA = 1.2, 0.60


def present() -> Column:
    return (
        (F.coalesce("contain", F.lit(0.0)) >= MIN_CONTAIN)
        & F.col("scale").between(*SCALE)
        & F.col("opacity").between(ONSET_ALPHA, 2.0)
        & (F.col("fit") >= ONSET_FIT)
    )


def entry_onset(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Frame the ink lands on per curve, and whether it was there from the first frame.

    The change point with the largest rise of mean fit wins (the first on a tie);
    below a rise of 0.10 the first stable frame stands in.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    whole = Window.partitionBy(*keys)
    rows = curve.select(
        *keys, "n", present().alias("_p"), F.row_number().over(w).alias("_i"), F.count("*").over(whole).alias("_c"),
        F.sum("fit").over(w.rowsBetween(S.FIRST, -1)).alias("_b"), F.sum("fit").over(whole).alias("_t"), F.lead(present()).over(w).alias("_q"),
    )
    k = F.col("_i") - 1
    after = (F.col("_t") - F.col("_b")) / (F.col("_c") - k)
    gain = F.round(after - F.col("_b") / k, 9)
    fits = (k >= 1) & (F.round(after, 9) >= ONSET_FIT) & F.col("_p") & (gain > 0)
    stable = F.col("_p") & F.coalesce("_q", F.lit(True))
    found = rows.groupBy(*keys).agg(
        F.min("n").alias("_first"),
        F.bool_and(F.when(F.col("_i") <= 2, F.col("_p"))).alias("_at_once"),
        F.max_by(F.struct("n", gain.alias("g")), F.when(fits, F.struct(gain.alias("g"), -F.col("n")))).alias("_best"),
        F.min(F.when(stable, F.col("n"))).alias("_stable"),
    )
    landed = F.when(F.col("_at_once"), F.col("_first")).when(F.col("_best.g") >= 0.10, F.col("_best.n")).otherwise(F.col("_stable"))
    return found.select(*keys, landed.alias("landed"), F.col("_at_once").alias("at_once"))


def walk_back(curve: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Start of the monotone ramp that ends where the ink landed."""
    w = Window.partitionBy(*keys).orderBy("n")
    rows = curve.select(
        *keys, "n", "fit", "opacity", (F.col("sigma_x") + F.col("sigma_y")).alias("_s"), F.lag("fit").over(w).alias("_pf"), F.lag("opacity").over(w).alias("_po"),
        F.lag(F.col("sigma_x") + F.col("sigma_y")).over(w).alias("_ps"),
    )
    anchor = landed.join(curve.select(*keys, F.col("n").alias("landed"), F.col("fit").alias("_lf")), [*keys, "landed"])
    placed = rows.join(anchor.select(*keys, "landed", "_lf"), keys).where(F.col("n") <= F.col("landed"))
    floor = F.greatest(F.lit(0.25), 0.55 * F.col("_lf"))
    stops = (
        F.col("_pf").isNull() | (F.col("_pf") < floor) | (F.col("_po") > F.col("opacity") + 0.03)
        | (F.col("_ps") < F.col("_s") - 0.6) | (F.col("_po") < 0.05)
    )
    return placed.groupBy(*keys).agg(F.max(F.when(stops, F.col("n"))).alias("first_frame"))


def entry_facts(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the curves with ``landed``, ``at_once``, ``first_frame``, ``floor_x``, ``floor_y`` and ``sharp_frame`` of their curve.

    The rules of :func:`entry_onset`, :func:`walk_back`, :func:`settled_floor` and
    :func:`sharp_frame` as windows that share one partitioning and order, so that the rows are
    shuffled once; joined to each other they are read and shuffled for each. Curves
    with a null key land, but are not walked back and have no sharp frame, as in a join.
    """
    w, whole = Window.partitionBy(*keys).orderBy("n"), Window.partitionBy(*keys)
    blurred = F.col("sigma_x") + F.col("sigma_y")
    rows = curve.withColumns(
        {
            "_p": present(), "_i": F.row_number().over(w), "_c": F.count("*").over(whole), "_b": F.sum("fit").over(w.rowsBetween(S.FIRST, -1)), "_t": F.sum("fit").over(whole),
            "_q": F.lead(present()).over(w), "_pf": F.lag("fit").over(w), "_po": F.lag("opacity").over(w), "_ps": F.lag(blurred).over(w),
        }
    )
    k = F.col("_i") - 1
    after = (F.col("_t") - F.col("_b")) / (F.col("_c") - k)
    gain = F.round(after - F.col("_b") / k, 9)
    fits = (k >= 1) & (F.round(after, 9) >= ONSET_FIT) & F.col("_p") & (gain > 0)
    tail = F.col("_c") - F.col("_i") < F.greatest(F.lit(3), F.floor(F.col("_c") / 3))
    rows = rows.withColumns(
        {
            "_first": F.min("n").over(whole),
            "at_once": F.bool_and(F.when(F.col("_i") <= 2, F.col("_p"))).over(whole),
            "_best": F.max(F.when(fits, F.struct(gain.alias("g"), (-F.col("n")).alias("m")))).over(whole),
            "_stable": F.min(F.when(F.col("_p") & F.coalesce("_q", F.lit(True)), F.col("n"))).over(whole),
            **{f"floor_{a}": F.median(F.when(tail, F.col(f"sigma_{a}"))).over(whole) for a in ("x", "y")},
        }
    )
    rows = rows.withColumn("landed", F.when(F.col("at_once"), F.col("_first")).when(F.col("_best.g") >= 0.10, -F.col("_best.m")).otherwise(F.col("_stable")))
    rows = rows.withColumn("_lf", F.max(F.when(F.col("n") == F.col("landed"), F.col("fit"))).over(whole))
    stops = (
        F.col("_pf").isNull() | (F.col("_pf") < F.greatest(F.lit(0.25), 0.55 * F.col("_lf"))) | (F.col("_po") > F.col("opacity") + 0.03)
        | (F.col("_ps") < blurred - 0.6) | (F.col("_po") < 0.05)
    )
    given = F.lit(True)
    for key in keys:
        given &= F.col(key).isNotNull()
    walked = F.max(F.when(given & ~F.col("at_once") & (F.col("n") <= F.col("landed")) & stops, F.col("n"))).over(whole)
    rows = rows.withColumn("_walked", walked).withColumn("first_frame", F.when(F.col("at_once"), F.col("landed")).otherwise(F.col("_walked")))
    near = lambda axis: F.col(f"sigma_{axis}") <= F.greatest(F.lit(SHARP_SIGMA), F.col(f"floor_{axis}") + 0.6)
    ok = (F.col("n") >= F.col("first_frame")) & near("x") & near("y") & (F.col("opacity") >= SHARP_ALPHA)
    sharp = F.when(given & F.col("first_frame").isNotNull(), F.coalesce(F.min(F.when(ok, F.col("n"))).over(whole), F.max("n").over(whole)))
    return rows.withColumn("sharp_frame", sharp).select(*curve.columns, "landed", "at_once", "first_frame", "floor_x", "floor_y", "sharp_frame")


def first_frames(curve: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`entry_onset`, walked back unless the ink was there at once."""
    return entry_facts(curve, keys).groupBy(*keys).agg(F.max("first_frame").alias("first_frame"))


def sharp_frames(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Per curve its settled blur and :func:`sharp_frame`, null where no ink lands."""
    return entry_facts(curve, keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("floor_x", "floor_y", "sharp_frame")])


def settled_floor(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Median sigma over the last third of a curve (three rows at least)."""
    w = Window.partitionBy(*keys)
    tail = curve.select(*keys, "sigma_x", "sigma_y", F.row_number().over(w.orderBy(F.col("n").desc())).alias("_d"), F.count("*").over(w).alias("_c"))
    kept = tail.where(F.col("_d") <= F.greatest(F.lit(3), F.floor(F.col("_c") / 3)))
    return kept.groupBy(*keys).agg(F.median("sigma_x").alias("floor_x"), F.median("sigma_y").alias("floor_y"))


def sharp_frame(curve: DataFrame, firsts: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """First frame from the onset on that is as sharp as the settled look and opaque; else the last frame."""
    j = curve.join(firsts.where("first_frame IS NOT NULL"), keys).join(floors, keys)
    near = lambda axis: F.col(f"sigma_{axis}") <= F.greatest(F.lit(SHARP_SIGMA), F.col(f"floor_{axis}") + 0.6)
    ok = (F.col("n") >= F.col("first_frame")) & near("x") & near("y") & (F.col("opacity") >= SHARP_ALPHA)
    return j.groupBy(*keys).agg(F.coalesce(F.min(F.when(ok, F.col("n"))), F.max("n")).alias("sharp_frame"))


def clean_ramp(curve: DataFrame, firsts: DataFrame, sharps: DataFrame, floors: DataFrame, keys: list[str]) -> DataFrame:
    """Opacity that only rises and blur that only falls between onset and sharp frame; pinned outside."""
    return _ramp(curve.join(firsts, keys).join(sharps, keys).join(floors, keys), keys)


def clean_ramps(curve: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`clean_ramp` with the onset, sharp frame and settled blur of each curve."""
    return _ramp(entry_facts(curve, keys).where("sharp_frame IS NOT NULL"), keys)


def _ramp(j: DataFrame, keys: list[str]) -> DataFrame:
    inside = (F.col("n") >= F.col("first_frame")) & (F.col("n") < F.col("sharp_frame"))
    w = Window.partitionBy(*keys).orderBy("n")
    up, onward = w.rowsBetween(S.FIRST, 0), w.rowsBetween(0, S.LAST)
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("opacity")))
    blur = lambda axis: T.round_exact(F.greatest(F.lit(0.0), F.col(f"sigma_{axis}") - F.col(f"floor_{axis}")), 2)
    done = F.col("n") >= F.col("sharp_frame")
    return j.select(
        *keys, "n",
        F.when(done, 1.0).when(inside, T.round_exact(F.max(F.when(inside, level)).over(up), 3)).otherwise(0.0).alias("opacity"),
        *[F.when(inside, F.max(F.when(inside, blur(a))).over(onward)).otherwise(0.0).alias(f"sigma_{a}") for a in ("x", "y")],
    )


def median3(curve: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Three-row median; the two ends keep their values."""
    w = Window.partitionBy(*keys).orderBy(pos)
    l, r = F.lag(value).over(w), F.lead(value).over(w)
    mid = F.element_at(F.array_sort(F.array(l, F.col(value), r)), 2)
    return curve.withColumn("smooth", F.when(l.isNull() | r.isNull(), F.col(value)).otherwise(mid))


def blur_axis(x: Column, y: Column) -> Column:
    strong = lambda a, b: (a >= 1.5) & (a >= 1.6 * F.greatest(b, F.lit(0.3)))
    return F.when(strong(x, y), "h").when(strong(y, x), "v").otherwise("iso")


def device_summary(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Per curve: onset, sharp frame, blur axis, largest excess blur, median fit and confidence."""
    rows = entry_facts(curve, keys)
    win = F.col("sharp_frame").isNotNull() & (F.col("n") >= F.col("first_frame")) & (F.col("n") <= F.col("sharp_frame"))
    excess = lambda a: F.max(F.when(win, F.greatest(F.lit(0.0), F.col(f"sigma_{a}") - F.col(f"floor_{a}"))))
    out = rows.groupBy(*keys).agg(
        F.max("first_frame").alias("first_frame"), F.max("sharp_frame").alias("sharp_frame"), excess("x").alias("_x"), excess("y").alias("_y"), F.median(F.when(win, F.col("fit"))).alias("_fit")
    )
    fit = F.coalesce("_fit", F.lit(0.0))
    return out.select(
        *keys, "first_frame", "sharp_frame", F.when(F.col("first_frame").isNotNull(), blur_axis(F.col("_x"), F.col("_y"))).alias("axis"),
        T.round_exact(F.col("_x"), 2).alias("max_sigma_x"), T.round_exact(F.col("_y"), 2).alias("max_sigma_y"), T.round_exact(F.col("_fit"), 3).alias("median_fit"),
        F.when(fit >= 0.6, "high").when(fit >= 0.4, "medium").otherwise("low").alias("confidence"),
    )


def swap_verdict(states: DataFrame, curve: DataFrame, key: str = "asset", state: str = "state") -> DataFrame:
    """Hard swap or ramp for each state that follows another: the incoming curve on its cut frame decides.

    ``states``: asset, state, start_frame. ``curve``: asset, state, n, opacity, blur.
    """
    order = S.scan(states, [key], ["start_frame", state], _p=S.prev(state)).where("_p IS NOT NULL")
    at = curve.select(key, state, F.col("n").alias("start_frame"), "opacity", "blur")
    hard = (F.col("opacity") >= 0.75) & (F.col("blur") <= SHARP_SIGMA)
    return order.join(at, [key, state, "start_frame"], "left").select(
        key, F.col("_p").alias("from_state"), F.col(state).alias("to_state"), F.col("start_frame").alias("cut_frame"), F.when(hard, "hard swap").otherwise("ramped").alias("verdict")
    )


def row_at(curve: DataFrame, asked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Curve value for each asked frame: null before the first row and inside a hole, the last row's after the end."""
    ends = curve.groupBy(*keys).agg(F.max("n").alias("_hi"))
    found = as_of(asked.join(ends, keys, "left"), curve.select(*keys, "n", value), keys, "frame", "n", ["n", value])
    return found.select(*keys, "frame", F.when((F.col("n") == F.col("frame")) | (F.col("frame") > F.col("_hi")), F.col(value)).alias(value))
