"""Clip filters, bans, order classification and row validation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions import rules as R

PLACEHOLDER = r"^(REPLACE_|PENDING_|UNOBSERVED)"


def find_clips(
    clips: DataFrame,
    role: str | None = None,
    world: str | None = None,
    action: str | None = None,
    min_energy: str = "low",
    subject: str | None = None,
    lighting: str | None = None,
    crop_safe: bool = False,
    min_duration: float = 0.0,
    limit: int | None = None,
    id_col: str = "clip_id",
) -> DataFrame:
    """Tagged clips that meet every given filter, most confident and energetic first."""
    t = lambda f: F.col(f"tags.{f}")
    keep = F.col("tags").isNotNull()
    if role:
        keep &= F.array_contains(t("roles"), role)
    if world:
        keep &= t("world_cluster") == world
    if action:
        keep &= F.exists(t("action_verbs"), lambda v: v.contains(action))
    if R.ENERGY[min_energy]:
        keep &= R.energy_rank(t("energy")) >= R.ENERGY[min_energy]
    if subject:
        keep &= t("subject") == subject
    if lighting:
        keep &= t("lighting") == lighting
    if crop_safe:
        keep &= t("crop_safety_916") == "safe"
    if min_duration > 0:
        keep &= F.coalesce(F.col("duration"), F.lit(0.0)) >= min_duration
    order = [R.energy_rank(t("confidence")).desc(), R.energy_rank(t("energy")).desc(), F.col(id_col)]
    found = clips.where(keep)
    return found.orderBy(*order).limit(limit) if limit is not None else found.orderBy(*order)


def eligible_pool(
    clips: DataFrame, rules: DataFrame, out_num: int = 24, out_den: int = 1, require_clearance: bool = False, ways: int = 64
) -> DataFrame:
    """(slot, clip) pairs that pass a slot's allow and deny sets and have enough frames.

    Clips meet rules by an equi-join on role; a rule without roles is reached
    through the ``*`` role every clip also carries, in ``ways`` parts of the clips,
    so that no key has all of them. A pair is taken only under
    the first role both share, so it appears once. Rules: slot, frames, roles,
    deny_roles, lighting, subject, world, deny_world, energy, exclude (arrays).
    """
    from cutlake.functions.timecode import required_source_frames

    none = F.array().cast("array<string>")
    rule = rules.withColumn("_role", F.explode(F.when(F.size("roles") > 0, F.col("roles")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(ways - 1)), lambda i: F.concat(F.lit("*"), i.cast("string"))))))
    clip = clips.withColumn("_role", F.explode(F.array_distinct(F.concat(F.coalesce("tags.roles", none), F.array(F.concat(F.lit("*"), F.pmod(F.xxhash64("clip_id"), F.lit(ways)).cast("string")))))))
    pairs = clip.join(rule, "_role")
    shared = F.try_element_at(F.array_intersect(F.col("roles"), F.coalesce("tags.roles", none)), F.lit(1))
    allows = lambda rule_set, value: (F.size(rule_set) == 0) | F.coalesce(F.array_contains(F.col(rule_set), value), F.lit(False))
    world = F.coalesce(F.col("tags.world_cluster"), F.lit(""))
    need = required_source_frames(F.col("frames"), F.col("fps.num"), F.col("fps.den"), out_num, out_den)
    keep = (
        ((F.size("roles") == 0) | (F.col("_role") == shared))
        & ~F.arrays_overlap(F.coalesce("tags.roles", none), F.col("deny_roles"))
        & allows("lighting", F.coalesce(F.col("tags.lighting"), F.lit("")))
        & allows("subject", F.coalesce(F.col("tags.subject"), F.lit("")))
        & allows("world", world)
        & ~F.array_contains(F.col("deny_world"), world)
        & allows("energy", F.coalesce(F.col("tags.energy"), F.lit("")))
        & ~F.array_contains(F.col("exclude"), F.col("clip_id"))
        & (F.col("frame_count") >= need)
    )
    if require_clearance:
        keep &= R.caption_clearance(F.col("p05"), F.col("p95"), F.col("plate_alpha"))["servable"]
    return pairs.where(keep).select("slot", "clip_id", need.alias("needed_frames"), (F.col("frame_count") - need).alias("spare_frames"))


def ban_keys(entries: DataFrame, ids: list[str], files: list[str], lists: list[str]) -> DataFrame:
    """Every (kind, key) a ban entry can be matched by: kind is hash, file or id."""
    absorbed = F.array_compact(F.concat(F.array(*[F.col(c).cast("string") for c in ids]), *[F.col(c) for c in lists]))
    named = F.flatten(F.transform(F.array_compact(F.array(*[F.col(c) for c in files])), R.name_forms))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    def read(value: Column) -> Column:
        token = F.trim(value)
        is_hash = F.lower(token).rlike("^[0-9a-f]{64}$")
        is_file = token.contains("/") | F.regexp_extract(token, "([^/]*)$", 1).contains(".")
        return (
            F.when(token == "", F.array().cast("array<struct<kind:string,key:string>>"))
            .when(is_hash, F.array(pair("hash", token)))
            .when(is_file, F.transform(R.name_forms(token), lambda f: pair("file", f)))
            .otherwise(F.array(pair("id", token), pair("file", token)))
        )

    keys = F.concat(F.flatten(F.transform(absorbed, read)), F.transform(named, lambda f: pair("file", f)))
    return entries.select(F.explode(keys).alias("k")).select("k.kind", "k.key").distinct()


def classify_orders(
    orders: DataFrame,
    events: DataFrame,
    now: Column,
    lane: str = "runner",
    attempts: int = 3,
    lookback_days: int = 14,
) -> DataFrame:
    """Verdict per order receipt from its newest answers.

    ``orders``: receipt, kind, sent. ``events``: receipt, seq, head, lane, ts,
    state (null when the line carries no status), not_before, line. The events
    are reduced map-side to one row per receipt before the join.
    """
    mine = (F.col("lane") == lane) | F.col("lane").startswith(lane + "-")
    line = F.struct("head", "lane", "state", "not_before", "line")
    facts = events.groupBy("receipt").agg(
        F.max_by(line, "seq").alias("last"),
        F.max(mine).alias("mine"),
        F.max_by(line, F.when(F.col("lane").startswith(lane) & F.col("state").isNotNull(), F.col("seq"))).alias("own"),
        F.count_if((F.col("state") == "queued") & (F.col("lane") == lane)).alias("tries"),
    )
    joined = orders.join(facts, "receipt", "left")
    waiting = F.coalesce((F.col("own.state") == "queued") & (F.col("own.lane") == lane), F.lit(False))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))
    due = F.coalesce(F.col("own.not_before").cast("timestamp") <= now.cast("timestamp"), F.lit(False))
    taken = F.col("last.line").rlike(r"(?i)—\s*picked up\b") & ~F.col("last.line").rlike(r"(?i)—\s*finished\b")
    verdict = (
        F.when(F.col("kind") == "smoketest", "skip")
        .when(F.col("mine") & waiting & (F.col("tries") < attempts) & due, "retry")
        .when(F.col("mine"), "closed")
        .when(F.col("last").isNull() & (age > lookback_days * 86_400_000_000), "stale")
        .when(F.col("last").isNull(), "actionable")
        .when(F.col("last.state").isin("finished", "called"), "closed")
        .when(F.col("last.state").isNotNull(), "claimed")
        .when(F.col("last.head") == "CALL", "closed")
        .when(taken, "claimed")
        .otherwise("closed")
    )
    return joined.select(*orders.columns, verdict.alias("verdict"), F.coalesce("tries", F.lit(0)).cast("long").alias("tries"))


def violations(df: DataFrame, keep: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per failed check; ``checks`` are true where a row is at fault."""
    named = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return df.select(*keep, F.explode(named).alias("violation"))


def named_blocks(slots: DataFrame, projects: DataFrame, blocks: DataFrame, rule: Column, key: str = "project") -> DataFrame:
    """Rows of ``projects`` (key) and ``blocks`` (block_id) for which ``rule`` holds, of pairs that slots name: never more rows than slots have pairs, where all that fit would be a product."""
    named = slots.select(key, "block_id").distinct()
    return named.join(blocks, "block_id").join(projects, key).where(rule)


def validate_selection(slots: DataFrame, blocks: DataFrame, key: str = "project") -> DataFrame:
    """Faults of cast slots against their blocks. Slots carry an ``ordinal``; a repeated block is reported once, at its last.

    Blocks that come from a rule and not from a table are better found for the named ones only (:func:`named_blocks`).
    """
    spec = blocks.select(key, "block_id", F.col("frames").alias("_frames"), F.col("role").alias("_role"))
    joined = slots.join(spec, [key, "block_id"], "left")
    repeats = slots.groupBy(key, "block_id").agg(F.count("*").alias("_n"), F.max("ordinal").alias("ordinal")).where("_n > 1")
    note = F.trim(F.coalesce("candidate_observation", F.lit("")))
    role = F.lower(F.trim(F.coalesce("_role", F.lit(""))))
    known = F.col("_frames").isNotNull()
    found = violations(
        joined,
        [key, "block_id", "ordinal"],
        {
            "unknown_block": ~known,
            "wrong_frames": known & (F.col("frames") != F.col("_frames")),
            "missing_observation": (note == "") | F.upper(note).rlike(PLACEHOLDER),
            "copied_observation": (role != "") & (F.lower(note) == role),
            "missing_source": F.col("source_path").isNull() | F.upper("source_path").rlike(PLACEHOLDER),
            "negative_start": F.col("source_start_frame") < 0,
            "speed_changed": F.coalesce("reverse", F.lit(False)) | (F.coalesce("speed", F.lit(1.0)) != 1.0),
        },
    )
    return found.unionByName(repeats.select(key, "block_id", "ordinal", F.lit("duplicate_block").alias("violation")))


def validate_feasibility(rows: DataFrame, inventory: DataFrame, key: str = "project") -> DataFrame:
    """Faults of feasibility rows: coverage, evidence, decision, and clips outside the inventory."""
    note = F.trim(F.coalesce("evidence", F.lit("")))
    cover = F.coalesce("coverage", F.lit(""))
    decision = F.coalesce("decision", F.lit(""))
    found = violations(
        rows,
        [key, "block_id"],
        {
            "invalid_coverage": ~cover.isin("exact_scene_available", "role_equivalent_substitute", "missing"),
            "missing_evidence": (note == "") | F.upper(note).rlike("^(PENDING_|REPLACE_)"),
            "no_clips": (cover != "missing") & (F.size(F.coalesce("clip_ids", F.array().cast("array<string>"))) == 0),
            "substitute_not_approved": (cover == "role_equivalent_substitute") & (decision != "APPROVED_ROLE_EQUIVALENT_SUBSTITUTE"),
            "exact_not_selected": (cover == "exact_scene_available") & (decision != "EXACT_SCENE_SELECTED"),
            "missing_undecided": (cover == "missing")
            & ~decision.isin("ACQUIRE_NEW_FOOTAGE", "CHANGE_REFERENCE_WITH_EXPLICIT_USER_APPROVAL"),
        },
    )
    cited = rows.where(cover != "missing").select(key, "block_id", F.explode("clip_ids").alias("clip_id"))
    unknown = cited.join(inventory.select("clip_id"), "clip_id", "left_anti").select(key, "block_id").distinct()
    return found.unionByName(unknown.withColumn("violation", F.lit("unknown_clip")))


def redaction_hits(docs: DataFrame, terms: list[str], id_col: str, text_col: str, deal: str | None = None) -> DataFrame:
    """(document, term, hits) for every term found: non-overlapping, in lower case; terms of up to three letters need spaces around them.

    All terms are searched in one pass over each text by an Aho-Corasick automaton,
    which travels inside the plan, so nothing is joined. ``deal`` names a column by which rows
    are dealt first, for inputs of fewer splits than cores.
    """
    listed = sorted({t.lower() for t in terms} - {""})
    # a short term is sought with its spaces in the padded text; a long one may not reach into the padding
    wanted = [(f" {t} " if len(t) <= 3 else t, t, len(t) <= 3) for t in listed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for needle, term, short in wanted:
            machine.add_word(needle, (*machine.get(needle, ()), (term, len(needle), short)))
        if wanted:
            machine.make_automaton()
        for batch in batches:
            rows: list[tuple] = []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if not wanted or not text:
                    continue
                hits: dict[str, int] = {}
                free: dict[str, int] = {}
                last = len(text)
                for end, found in machine.iter(f" {text} "):
                    for term, size, short in found:
                        begin = end - size + 1
                        if (short or (begin >= 1 and end <= last)) and begin >= free.get(term, 0):
                            hits[term] = hits.get(term, 0) + 1
                            free[term] = end + 1
                rows += [(at, term, n) for term, n in hits.items()]
            at, term, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(term, pa.string()), pa.array(n, pa.int64())], names=["id", "term", "hits"])

    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    rows = rows if deal is None else docs.select(id_col, text_col, *([] if deal in (id_col, text_col) else [deal])).repartition(deal).select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, term string, hits long").withColumnRenamed("id", id_col)


def validate_states(states: DataFrame, styles: DataFrame, clocks: DataFrame, key: str = "asset") -> DataFrame:
    """Faults of caption states: ids, spans, clock, boxes and styles.

    Boxes are ``array<int>`` in x0, y0, x1, y1 order. Styles: key, style_id, inherits.
    """
    known = styles.select(key, "style_id", F.lit(True).alias("_known"))
    joined = states.join(known, [key, "style_id"], "left").join(clocks.select(key, "frame_count"), key, "left")
    core = [F.element_at("core_box", i) for i in (1, 2, 3, 4)]
    treat = [F.element_at("treatment_box", i) for i in (1, 2, 3, 4)]
    found = violations(
        joined,
        [key, "id"],
        {
            "empty_span": F.col("end_frame") <= F.col("start_frame"),
            "wrong_frames": F.col("frames") != F.col("end_frame") - F.col("start_frame"),
            "past_clock": F.col("end_frame") > F.col("frame_count"),
            "empty_box": (core[2] <= core[0]) | (core[3] <= core[1]),
            "box_outside_treatment": (treat[0] > core[0]) | (treat[1] > core[1]) | (treat[2] < core[2]) | (treat[3] < core[3]),
            "undeclared_style": F.col("_known").isNull(),
        },
    )
    wants = styles.where(F.col("inherits").isNotNull()).select(key, F.col("style_id").alias("id"), F.col("inherits").alias("style_id"))
    orphan = wants.join(styles.select(key, "style_id"), [key, "style_id"], "left_anti").select(key, "id")
    twice = states.groupBy(key, "id").agg(F.count("*").alias("_n")).where("_n > 1").select(key, "id")
    return found.unionByName(orphan.withColumn("violation", F.lit("inherits_undeclared"))).unionByName(
        twice.withColumn("violation", F.lit("duplicate_id"))
    )
