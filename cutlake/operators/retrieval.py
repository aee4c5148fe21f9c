"""Ranked retrieval of clips for shot roles, and window choice for slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutlake.functions import rules as R
from cutlake.functions.text import tokens
from cutlake.functions.timecode import required_source_frames
from cutlake.operators import scan as S
from cutlake.operators.ranges import range_join
from cutlake.session import cut_lineage

WEIGHTS = {"role": 5.0, "requirement": 3.0, "observation": 1.5}
#: Columns of the catalogue that a shortlist repeats where they exist.
TOLD = ["source_sha256", "orientation", "coverage_board", "families", "labels"]
FLAGS = ["moves", "walks", "sports", "stable", "human", "pair"]


def role_terms(roles: DataFrame) -> DataFrame:
    """Token sets and flags of each role. Columns read: id, role, reference_observation, composition, substitute_requirements."""
    text = lambda *cols: F.concat_ws(" ", *cols)
    requirements = F.array_join("substitute_requirements", " ")
    sets = roles.select(
        F.col("id").alias("role_id"),
        "target_duration", "target_luma", "target_sat",
        tokens(F.coalesce("role", F.lit(""))).alias("t_role"),
        tokens(text("reference_observation", "composition")).alias("t_observation"),
        tokens(F.coalesce(requirements, F.lit(""))).alias("t_requirement"),
    )
    has = lambda *words: F.arrays_overlap(F.col("_all"), F.array(*[F.lit(w) for w in words]))
    return sets.withColumn("_all", F.array_union(F.array_union("t_role", "t_observation"), "t_requirement")).withColumns(
        {"moves": has("motion", "sport", "walking"), "walks": has("walking"), "sports": has("sport"), "stable": has("stable", "hold", "locked"), "human": has("human"), "pair": has("pair")}
    ).drop("_all")


def catalog_terms(catalog: DataFrame, features: DataFrame) -> DataFrame:
    """Token set and numeric facts of each clip; labels and families are arrays of strings on the silver table."""
    words = F.concat_ws(" ", "path", F.array_join(F.coalesce("semantic_groups", F.array()), " "), F.array_join(F.coalesce("labels", F.array()), " "), F.array_join(F.coalesce("families", F.array()), " "))
    told = [c for c in TOLD if c in catalog.columns]
    facts = catalog.select(
        "path", "clip_id", *(F.col(c).alias(f"_told_{c}") for c in told), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), F.coalesce("motion_speed", F.lit(0.0)).alias("motion_speed"),
        F.coalesce("local_peaks", F.lit(0)).alias("local_peaks"), (F.coalesce("motion_label", F.lit("")) == "locked_or_nearly_locked").alias("is_locked"),
        F.coalesce("poses", F.lit(0)).alias("poses"), F.coalesce("faces", F.lit(0)).alias("faces"), tokens(words).alias("terms"),
    )
    facts = facts.withColumns({f"has_{w}": F.array_contains("terms", w) for w in ("static", "human", "pair")})
    return facts.join(features.select("path", "luma_p50", "sat_p50", "laplacian_var"), "path", "left")


def _motion() -> Column:
    return F.least(F.lit(3.0), F.col("motion_speed") * 20.0) + F.least(F.lit(2.0), F.col("local_peaks") * 0.5)


def _sharpness() -> Column:
    """Null where the measure is missing or not finite."""
    return F.when(F.abs("laplacian_var") < float("inf"), F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.col("laplacian_var"))) / 8.0))


def _numeric() -> list[tuple[str, Column, bool]]:
    """Score terms that do not come from shared words: evidence name, value, whether the evidence carries the value."""
    c = F.col
    covered = c("duration_s") + 1e-6 >= c("target_duration")
    near = lambda a, b, top, scale: F.greatest(F.lit(0.0), top - F.abs(c(a) - c(b)) / scale)
    return [
        ("native_motion", F.when(c("moves"), _motion()), True),
        ("action_contradiction:static_vs_walking", F.when(c("walks") & c("has_static"), -12.0), False),
        ("action_contradiction:static_vs_sport", F.when(c("sports") & c("has_static"), -8.0), False),
        ("stable_camera", F.when(c("stable") & c("is_locked"), 2.0), False),
        ("human_evidence", F.when(c("human") & ((c("poses") > 0) | (c("faces") > 0) | c("has_human")), 1.5), False),
        ("paired_action_evidence", F.when(c("pair") & (c("poses") >= 2), 3.0).when(c("pair") & c("has_pair"), 1.0), False),
        ("duration_covered", F.when(covered, 1.0), False),
        ("duration_shortfall", F.when(~covered, -20.0), False),
        ("luma_tiebreak", F.when(c("target_luma").isNotNull() & c("luma_p50").isNotNull(), near("target_luma", "luma_p50", 1.5, 64.0)), True),
        ("saturation_tiebreak", F.when(c("target_sat").isNotNull() & c("sat_p50").isNotNull(), near("target_sat", "sat_p50", 1.0, 128.0)), True),
        ("sharpness_tiebreak", _sharpness(), True),
    ]


def _scored(pairs: DataFrame, terms: DataFrame, clips: DataFrame) -> DataFrame:
    """Full score and evidence of ``pairs(role_id, _c)``: each meets its clip and its role once."""
    joined = pairs.join(clips, "_c").join(terms, "role_id").withColumns({f"_in_{s}": F.array_intersect(f"t_{s}", "terms") for s in WEIGHTS})
    shared = {s: F.col(f"_in_{s}") for s in WEIGHTS}
    parts = _numeric()
    total = F.lit(0.0)
    for part, weight in WEIGHTS.items():
        total = total + weight * F.size(shared[part])
    for _, value, _ in parts:
        total = total + F.coalesce(value, F.lit(0.0))
    lines = [F.when(F.size(x) > 0, F.concat(F.lit(f"{s}_terms:"), F.array_join(F.slice(F.array_sort(x), 1, 12), ","))) for s, x in shared.items()]
    lines += [F.when(v.isNotNull(), F.format_string(f"{n}:%.3f", v) if valued else F.lit(n)) for n, v, valued in parts]
    told = [F.col(c).alias(c.removeprefix("_told_")) for c in clips.columns if c.startswith("_told_")]
    return joined.select("role_id", "path", "clip_id", F.round(total, 6).alias("score"), F.array_compact(F.array(*lines)).alias("evidence"), "duration_s", *told)


def _wanted(terms: DataFrame) -> DataFrame:
    """``role_id, term, part, weight`` of every word of every role."""
    sides = [terms.select("role_id", F.explode(f"t_{s}").alias("term"), F.lit(s).alias("part"), F.lit(w).alias("weight")) for s, w in WEIGHTS.items()]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


def _frequent(counts: DataFrame) -> DataFrame:
    """``term, _df`` of words that hold more than one posting in 1024: fewer than 1024, whatever the input. ``counts(term, df)`` is stored."""
    total = counts.agg(F.sum("df")).first()[0] or 0
    return counts.where(F.col("df") * 1024 > total).select("term", F.col("df").alias("_df"))


def _salted(postings: DataFrame, often: DataFrame) -> DataFrame:
    """Postings of frequent words are dealt to ``SALTS`` parts by clip."""
    return postings.join(F.broadcast(often), "term", "left").withColumn("_salt", F.when(F.col("_df").isNotNull(), F.pmod(F.xxhash64("_c"), F.lit(SALTS))).otherwise(0).cast("int"))


def _asked(wanted: DataFrame, often: DataFrame) -> DataFrame:
    """What is wanted of a frequent word is asked of each of its parts."""
    salts = F.when(F.col("_df").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return wanted.join(F.broadcast(often), "term", "left").withColumn("_salt", F.explode(salts)).drop("_df")


def score_overlaps(terms: DataFrame, clips: DataFrame) -> DataFrame:
    """Pairs that share a word, with weighted overlap, through an inverted-index join on the word."""
    # stored: words are counted, then joined, and finding them in the texts is the heavy part
    own = cut_lineage(clips.select(F.col("path").alias("_c"), "path", "terms"))
    wanted = _wanted(terms)
    counts = cut_lineage(own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    often = _frequent(counts)
    held = _salted(own.select("_c", "path", F.explode("terms").alias("term")), often)
    met = held.join(_asked(wanted, often), ["term", "_salt"]).groupBy("role_id", "path")
    # A pair gathers at most the role's own words.
    said = lambda s: F.array_sort(F.collect_set(F.when(F.col("part") == s, F.col("term"))))
    grouped = met.agg(F.sum("weight").alias("word_score"), *[said(s).alias(s) for s in WEIGHTS])
    lines = [F.when(F.size(s) > 0, F.concat(F.lit(f"{s}_terms:"), F.array_join(F.slice(s, 1, 12), ","))) for s in WEIGHTS]
    return grouped.select("role_id", "path", "word_score", F.array_compact(F.array(*lines)).alias("words"))


BUCKET, SALTS, SEED_WORDS, SEEDS, SLACK = 0.5, 64, 8, 4, 1e-3


def _postings(clips: DataFrame) -> DataFrame:
    """``term, _c`` with the clip's numeric facts; ``_bucket`` of the most it can gain for any role. The empty word is in every clip."""
    fact = lambda value, name: value.cast("float").alias(name)
    held = clips.select(
        "_c", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"), "has_static", fact(F.coalesce(_sharpness(), F.lit(0.0)), "_sharp"), fact(F.greatest(_motion(), F.lit(0.0)), "_move"),
        F.when(F.col("is_locked"), 2.0).otherwise(0.0).alias("_hold"), F.when((F.col("poses") > 0) | (F.col("faces") > 0) | F.col("has_human"), 1.5).otherwise(0.0).alias("_people"),
        F.when(F.col("poses") >= 2, 3.0).when(F.col("has_pair"), 1.0).otherwise(0.0).alias("_two"), F.col("duration_s").alias("_long"), fact(F.col("luma_p50"), "_luma"), fact(F.col("sat_p50"), "_sat"),
    )
    return held.withColumn("_bucket", F.floor(sum((F.col(c) for c in ("_sharp", "_move", "_hold", "_people", "_two")), F.lit(0.0)) / BUCKET))


def _bound() -> Column:
    """What the numeric terms of a posting give a role, up to rounding (the facts are single precision)."""
    c = F.col
    gain = c("_sharp") + F.when(c("moves"), c("_move")).otherwise(0.0) + F.when(c("stable"), c("_hold")).otherwise(0.0) + F.when(c("human"), c("_people")).otherwise(0.0) + F.when(c("pair"), c("_two")).otherwise(0.0)
    lost = F.when(c("walks") & c("has_static"), -12.0).otherwise(0.0) + F.when(c("sports") & c("has_static"), -8.0).otherwise(0.0)
    length = F.when(c("target_duration").isNull(), 0.0).when(c("_long") + 1e-6 < c("target_duration"), -20.0).otherwise(1.0)
    near = lambda target, have, top, scale: F.coalesce(F.greatest(F.lit(0.0), top - F.abs(c(target) - c(have)) / scale), F.lit(0.0))
    return gain + lost + length + near("target_luma", "_luma", 1.5, 64.0) + near("target_sat", "_sat", 1.0, 128.0)


def _most() -> Column:
    """The most that a role's own targets can add to what a posting's bucket counts."""
    has = lambda name, most: F.when(F.col(name).isNotNull(), most).otherwise(0.0)
    return has("target_duration", 1.0) + has("target_luma", 1.5) + has("target_sat", 1.0)


def shortlist(roles: DataFrame, catalog: DataFrame, features: DataFrame, top_n: int = 20) -> DataFrame:
    """The ``top_n`` best clips per role by score, then path: rank, score and evidence.

    Top-k by score bounds over an inverted index. Each role first scores a few
    clips of its rarest words; its ``top_n``-th of these is a bar that the final list
    reaches. The role's words stand in order from the most frequent, after an empty
    word that every clip has. A clip whose rarest word of the role is the i-th
    scores at most the weights up to there plus its numeric bound, so a posting is
    read only where that reaches the bar: postings are keyed by word and bucket of
    the numeric bound, and a role asks for the buckets that can matter. What is read is
    added up per clip and bounded once more; for the clips that remain the other
    words are looked up by word and clip, and those near the last place are scored in
    full. Frequent words are split over tasks.
    """
    if top_n < 1:
        raise ValueError("top_n must be at least 1")
    terms = cut_lineage(role_terms(roles))
    # dealt by path first: tokens are the heavy part, and a catalogue may come in few splits
    clips = cut_lineage(catalog_terms(catalog.repartition("path"), features).withColumn("_c", F.monotonically_increasing_id()))
    order = [F.col("score").desc(), F.col("path")]
    weights = _wanted(terms).groupBy("role_id", "term").agg(F.sum("weight").alias("weight"))
    weights = weights.unionByName(terms.select("role_id", F.lit("").alias("term"), F.lit(0.0).alias("weight")).distinct())
    postings = cut_lineage(_postings(clips).join(weights.select("term").distinct(), "term", "left_semi"))
    counts = cut_lineage(postings.groupBy("term").agg(F.count("*").alias("df"), F.max("_bucket").alias("_top")))
    often = _frequent(counts)
    postings = _salted(postings, often)
    top_bucket = counts.agg(F.max("_top")).first()[0] or 0

    own = W.partitionBy("role_id")  # a role's own words: few rows a key
    common = own.orderBy(F.col("term") != "", F.col("df").desc(), "term").rowsBetween(W.unboundedPreceding, 0)
    wanted = weights.join(counts.select("term", "df"), "term").withColumns({
        "_reach": F.sum("weight").over(common), "_rare": F.row_number().over(own.orderBy("df", "term")),
    })
    wanted = cut_lineage(wanted)

    few = wanted.where((F.col("_rare") <= SEED_WORDS) | (F.col("term") == ""))
    thin = lambda df: F.pmod(F.xxhash64("_c"), df) < SEEDS * top_n  # noqa: E731  about so many clips of a word
    some = postings.where(F.col("_df").isNull() | thin(F.col("_df"))).join(_asked(few, often), ["term", "_salt"]).where(thin(F.col("df")))
    some = some.groupBy("role_id", "_c").agg(F.sum("weight").alias("_sum"))
    # stored: few pairs, whose known size spares the clips a shuffle
    some = cut_lineage(S.top_k_per(some, ["role_id"], [F.col("_sum").desc(), F.col("_c")], SEEDS * top_n).select("role_id", "_c"))
    scored = _scored(some, terms, clips).select("role_id", "path", "score")
    bars = S.top_k_per(scored, ["role_id"], order, top_n).groupBy("role_id").agg(F.count("*").alias("_k"), F.min("score").alias("_worst"))
    lowest = -1e9
    reaches = wanted.groupBy("role_id").agg(F.collect_set("_reach").alias("_reaches"))
    bar = F.when(F.col("_k") >= top_n, F.col("_worst") - SLACK).otherwise(lowest)
    facts = ["target_duration", "target_luma", "target_sat", *FLAGS]
    kinds = terms.select("role_id", *facts).dropDuplicates(["role_id"])
    bars = cut_lineage(kinds.join(bars, "role_id", "left").join(reaches, "role_id").select("role_id", *facts, "_reaches", bar.alias("_bar")))

    need = F.greatest(F.floor((F.col("_bar") - F.col("_reach") - _most()) / BUCKET), F.lit(0))
    asked = wanted.join(bars.drop("_reaches"), "role_id").where(need <= top_bucket)
    asked = asked.select("role_id", "term", "weight", "_reach", "_bar", *facts, F.explode(F.sequence(need, F.lit(top_bucket).cast("long"))).alias("_bucket"))
    read = postings.join(_asked(asked, often), ["term", "_salt", "_bucket"]).withColumn("_cap", _bound()).where(F.col("_reach") + F.col("_cap") >= F.col("_bar"))
    sums = read.groupBy("role_id", "_c").agg(F.sum("weight").alias("_sum"), F.first("_cap").alias("_cap"))
    # words that were not read for a clip are those whose reach and the clip's bound stay under the bar
    sums = sums.join(bars.select("role_id", "_bar", "_reaches"), "role_id")
    unread = F.coalesce(F.array_max(F.filter("_reaches", lambda r: r + F.col("_cap") < F.col("_bar"))), F.lit(0.0))
    open_ = (F.col("_sum") + unread + F.col("_cap")) >= F.col("_bar")
    sums = cut_lineage(sums.where(open_).select("role_id", "_c", "_bar", "_cap", (F.col("_sum") + F.col("_cap")).alias("_near")))
    more = sums.join(wanted.where("term <> ''").select("role_id", "term", "weight", "_reach"), "role_id").where(F.col("_reach") + F.col("_cap") < F.col("_bar"))
    # by clip, then word: rows sort by a number, not by words that many rows share
    more = more.select("role_id", "_c", "term", "weight").join(postings.select("_c", "term"), ["_c", "term"])
    near = sums.select("role_id", "_c", "_near").unionByName(more.select("role_id", "_c", F.col("weight").alias("_near"))).groupBy("role_id", "_c").agg(F.sum("_near").alias("_near"))
    near = cut_lineage(near)
    last = S.top_k_per(near, ["role_id"], [F.col("_near").desc(), F.col("_c")], top_n).groupBy("role_id").agg(F.min("_near").alias("_least"))
    left = near.join(last, "role_id").where(F.col("_near") >= F.col("_least") - 2 * SLACK).select("role_id", "_c")
    return S.top_k_per(_scored(left, terms, clips), ["role_id"], order, top_n)


def bed_penalty(windows: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate windows ranked by lost contrast plus added clutter against the reference's beds; lowest first."""
    ref = reference.select("state", "text", F.col("ink").alias("_ink"), F.col("bed").alias("_bed"), F.col("sd").alias("_sd"))
    joined = windows.join(ref, ["state", "text"])
    wanted = F.abs(F.col("_ink") - F.col("_bed"))
    lost = F.greatest(F.lit(0.0), wanted - F.abs(F.col("_ink") - F.col("bed"))) / F.greatest(wanted, F.lit(1.0))
    clutter = F.greatest(F.lit(0.0), F.col("sd") - F.col("_sd")) / 50.0
    return joined.groupBy(*keys).agg(F.round(F.sum(lost + clutter), 3).alias("penalty")).orderBy("penalty", *keys)


def allowed_clips(stems: DataFrame, whole: DataFrame, parts: DataFrame, bans: DataFrame, settled: DataFrame, identity: bool) -> DataFrame:
    """Clips that may be scanned: no NEVER, no ban; for an identity slot only settled ones, HERO first."""
    never = whole.where("grade = 'NEVER'").select("stem")
    open_to = stems.join(never, "stem", "left_anti").join(bans.select("stem").distinct(), "stem", "left_anti")
    if not identity:
        return open_to.withColumn("hero", F.lit(False)).orderBy("stem")
    bad = whole.where("grade = 'BROLL' OR ident = 'NOTME'").select("stem")
    heroes = whole.where("grade = 'HERO'").select("stem").union(parts.where("grade = 'HERO'").select("stem")).distinct().withColumn("hero", F.lit(True))
    kept = open_to.join(settled.select("stem").distinct(), "stem", "left_semi").join(bad, "stem", "left_anti").join(heroes, "stem", "left")
    return kept.withColumn("hero", F.coalesce("hero", F.lit(False))).orderBy(F.col("hero").desc(), "stem")


def shot_score(luma: Column, sharp: Column, people: Column, faces: Column, face_area: Column, area: Column, top: Column, identity: Column, night: Column, no_person_ok: Column) -> Column:
    """Higher is better; -1e9 rejects dark, soft and empty shots."""
    base = F.least(sharp, F.lit(300.0)) / 300.0
    face = 2.0 + F.when(face_area.between(0.004, 0.12), 0.5).otherwise(0.0) - F.when(face_area > 0.2, 1.5).otherwise(0.0)
    body = 1.0 - F.when((area > 0.35) & (top > 0.97), 1.5).otherwise(0.0)
    crowd = F.when(people > 2, 0.6).otherwise(0.0)
    return (
        F.when((luma < F.when(night, 34.0).otherwise(45.0)) | (sharp < 15), -1e9)
        .when(~identity, base)
        .when(people == 0, F.when(no_person_ok & (sharp >= 60), base * 0.2).otherwise(-1e9))
        .otherwise(base + F.when(faces > 0, face).otherwise(body) - crowd)
    )


QUANTILES = [0.10, 0.38, 0.66, 0.88]


def pool_windows(clips: DataFrame, frames: Column, steps: int = 12, out_num: int = 24, out_den: int = 1) -> DataFrame:
    """Distinct start frames spread over each clip's usable range."""
    need = required_source_frames(frames, F.col("fps.num"), F.col("fps.den"), out_num, out_den)
    usable = F.greatest(F.lit(0).cast("long"), F.col("frame_count") - need)
    spots = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.rint(usable * i / (steps - 1)).cast("long"))
    starts = F.when(usable == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(spots))
    return clips.select("clip_id", F.explode(starts).alias("start_frame"), need.alias("_n")).select("clip_id", "start_frame", (F.col("start_frame") + F.col("_n")).alias("end_frame"))


def window_start(usable: Column, repeat: Column) -> Column:
    """In-point at a fixed quantile of the usable range, chosen by how often the clip was used."""
    q = F.element_at(F.array(*[F.lit(x) for x in QUANTILES]), (F.pmod(repeat, F.lit(len(QUANTILES))) + 1).cast("int"))
    return F.greatest(F.lit(0).cast("long"), F.least(F.rint(usable * q).cast("long"), usable.cast("long")))


def spread_assignment(pools: DataFrame, variants: int, seed: str, keys: tuple[str, str] = ("family", "slot")) -> DataFrame:
    """One clip per (family, slot, variant), spread over the slot's pool in seeded order.

    The pool is ranked by a digest, and variant v takes rank v plus the slot's
    offset. A clip a variant would show twice stays at its first slot; the
    other slots move on once by the number of variants. What still collides
    is reported as a conflict rather than solved.
    """
    family, slot = keys
    digest = F.sha2(F.concat_ws("|", F.lit(seed), F.col(family), F.col(slot), F.col("clip_id")), 256)
    bucket = F.conv(F.substring("_d", 1, 4), 16, 10).cast("long")
    ranked = S.scan(
        pools.select(family, slot, "clip_id").distinct().withColumn("_d", digest), [family, slot], ["_d"], chunk=bucket, _r=S.position(), _n=S.total(F.lit(1).cast("long"))
    )
    size = ranked.groupBy(family, slot).agg(F.max("_n").alias("_n"))
    offset = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col(family), F.col(slot)), 256), 1, 12), 16, 10).cast("long"), F.col("_n"))
    asked = size.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants)))).withColumn("_w", F.pmod(F.col("variant") + offset, F.col("_n")))
    seat = ranked.select(family, slot, (F.col("_r") - 1).alias("_w"), "clip_id")
    first = asked.join(seat, [family, slot, "_w"])
    owner = first.groupBy(family, "variant", "clip_id").agg(F.min(slot).alias("_owner"))
    placed = first.join(owner, [family, "variant", "clip_id"])
    kept = placed.where(F.col(slot) == F.col("_owner")).select(family, slot, "variant", "clip_id", F.lit("first").alias("choice"))
    moved = placed.where(F.col(slot) != F.col("_owner")).select(family, slot, "variant", "_n", F.pmod(F.col("_w") + variants, F.col("_n")).alias("_w"))
    second = moved.join(seat, [family, slot, "_w"]).select(family, slot, "variant", "clip_id")
    taken = kept.select(family, "variant", "clip_id").withColumn("_taken", F.lit(True))
    rivals = second.groupBy(family, "variant", "clip_id").agg(F.min(slot).alias("_owner"))
    settled = second.join(rivals, [family, "variant", "clip_id"]).join(taken, [family, "variant", "clip_id"], "left")
    clash = F.col("_taken") | (F.col(slot) != F.col("_owner"))
    return kept.unionByName(settled.select(family, slot, "variant", "clip_id", F.when(F.coalesce(clash, F.lit(False)) | (F.col(slot) != F.col("_owner")), "conflict").otherwise("second").alias("choice")))


def rank_windows(options: DataFrame, siblings: DataFrame, current: Column, keys: list[str], width: float = 256.0, top: int | None = None) -> DataFrame:
    """Servable windows no sibling shows, best clearance margin first, then a new clip, id and start."""
    clear = R.caption_clearance(F.col("p05"), F.col("p95"), F.col("plate_alpha"))
    judged = options.withColumn("_c", clear).where("_c.servable")
    other = siblings.select(*keys, "clip_id", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    hit = range_join(judged.select(*keys, "clip_id", "start_frame", "end_frame"), other, [*keys, "clip_id"], ("start_frame", "end_frame"), ("_s", "_e"), width)
    free = judged.join(hit.select(*keys, "clip_id", "start_frame").distinct(), [*keys, "clip_id", "start_frame"], "left_anti")
    same = (F.col("clip_id") == current).cast("int")
    order = [F.col("_c.margin").desc(), same, F.col("clip_id"), F.col("start_frame")]
    ranked = S.top_k_per(free, keys, order, top if top is not None else 2_147_483_647)
    return ranked.select(*keys, "clip_id", "start_frame", "end_frame", F.col("_c.margin").alias("margin"), "rank")
