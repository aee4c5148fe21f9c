"""Folds over append-only logs, review queues and the board built from them.

Latest-wins folds are ``max_by`` aggregations, combined map-side before the
shuffle, so a log in which one key holds most rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions import rules as R
from cutlake.functions import timecode as T
from cutlake.operators import scan as S
from cutlake.session import cut_lineage

OPEN_STATES = ["picked_up", "running", "progress", "queued", "blocked"]
WAITING = ["queued", "blocked"]
GRADES, IDENTS = ["HERO", "BROLL", "NEVER"], ["ME", "NOTME"]


def latest(value: Column, order: Column) -> Column:
    """Aggregate: the newest non-null value; a null line never erases an older one."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def fold_grades(events: DataFrame, strict: bool = False, order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Per clip ``grade``, ``ident`` and ``segments`` (map of ``t0-t1`` to grade), latest non-null each.

    The grading reader (default) takes a line with both bounds as a segment
    grade, with none as whole-clip values, and ignores half a window. The
    casting reader (``strict``) needs known values and ``t0 < t1`` for a
    segment; any other line speaks for the whole clip.
    """
    whole, part = fold_parts(events, strict, order)
    labelled = part.groupBy("stem", T.segment_key(F.col("t0"), F.col("t1")).alias("_label")).agg(F.max_by("grade", "at").alias("grade"))
    entries = labelled.groupBy("stem").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_label", "grade")))).alias("segments"))
    return whole.join(entries, "stem", "left")


def fold_parts(events: DataFrame, strict: bool = False, order: tuple[str, ...] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """The fold as two tables: whole-clip values per stem, and one row per (stem, t0, t1) with the place ``at`` of its line.

    The grading reader files a segment under its two-decimal label, so bounds that
    share a label are one segment and carry the newest line's bounds.
    """
    at = F.struct(*order)
    grade, ident = F.col("grade"), F.col("ident")
    both = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    none = F.col("t0").isNull() & F.col("t1").isNull()
    if strict:
        grade, ident = F.when(grade.isin(GRADES), grade), F.when(ident.isin(IDENTS), ident)
        windowed = F.coalesce(F.col("t1") > F.col("t0"), F.lit(False))
        whole_line = ~windowed
    else:
        windowed, whole_line = both, none
    named = events.where(F.coalesce("stem", F.lit("")) != "")
    if not strict:
        named = named.where(both | none)
    whole = named.groupBy("stem").agg(
        latest(F.when(whole_line, grade), at).alias("grade"),
        latest(ident if strict else F.when(whole_line, ident), at).alias("ident"),
        latest(F.col("clip_id"), at).alias("clip_id"),
        F.max_by("ts", at).alias("ts"),
    )
    graded = named.where(windowed & grade.isNotNull()).select("stem", "t0", "t1", grade.alias("grade"), at.alias("at"))
    if strict:
        return whole, graded.groupBy("stem", "t0", "t1").agg(F.max_by("grade", "at").alias("grade"), F.max("at").alias("at"))
    newest = graded.groupBy("stem", T.segment_key(F.col("t0"), F.col("t1")).alias("_label")).agg(F.max_by(F.struct("t0", "t1", "grade"), "at").alias("s"), F.max("at").alias("at"))
    return whole, newest.select("stem", "s.*", "at")


def effective_settled(settled: DataFrame, events: DataFrame) -> DataFrame:
    """(settled + HERO/ME) without whole-clip NEVER and NOTME."""
    whole, part = fold_parts(events, strict=True)
    heroes = part.where("grade = 'HERO'").select("stem").union(whole.where("grade = 'HERO' OR ident = 'ME'").select("stem"))
    banned = whole.where("grade = 'NEVER' OR ident = 'NOTME'").select("stem")
    return settled.select("stem").union(heroes).distinct().join(banned, "stem", "left_anti")


def pieces(items: DataFrame) -> DataFrame:
    """One row per gradable piece with the grade that stands for it (own segment, else whole clip)."""
    grid = T.segments(F.col("duration"))
    keys = F.transform(grid, lambda s: T.segment_key(s["t0"], s["t1"]))
    listed = F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit(None).cast("string")))
    rows = items.select("*", F.posexplode(listed).alias("piece", "key"))
    own = F.when(F.col("segments").isNotNull() & F.col("key").isNotNull(), F.try_element_at("segments", "key"))
    return rows.withColumn("piece", F.col("piece").cast("long")).withColumn("standing", F.coalesce(own, "grade"))


def piece_coverage(items: DataFrame, key: str = "clip_id") -> DataFrame:
    """Per clip: pieces, graded pieces and the first piece without a grade."""
    missing = F.col("standing").isNull()
    return pieces(items).groupBy(key).agg(
        F.count("*").alias("pieces"), F.count_if(~missing).alias("graded"), F.min(F.when(missing, F.col("piece"))).alias("first_uncovered")
    )


def grade_summary(items: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row of totals over the library."""
    cut = pieces(items)
    known = F.col("standing").isin(GRADES)
    # Grade and ident are the clip's own, the same on each of its pieces.
    per_clip = cut.groupBy(key).agg(
        F.max("grade").alias("_g"), F.max("ident").alias("_i"), F.count("*").alias("n"), F.count_if(known).alias("k"), *[F.count_if(F.col("standing") == g).alias(g) for g in GRADES]
    )
    return per_clip.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("_g") == g).alias(f"whole_{g.lower()}") for g in GRADES],
        *[F.count_if(F.col("_i") == i).alias(f"ident_{i.lower()}") for i in IDENTS],
        F.sum("n").alias("segments_total"),
        F.sum("k").alias("segments_graded"),
        F.count_if(F.col("n") == F.col("k")).alias("clips_covered"),
        *[F.sum(g).alias(f"segments_{g.lower()}") for g in GRADES],
        F.min(F.when(F.col("k") < F.col("n"), F.col(key))).alias("first_uncovered_clip"),
    )


def grader_items(library: DataFrame, scores: DataFrame, usage: DataFrame, grades: DataFrame, identity: DataFrame) -> DataFrame:
    """Library clips with person verdict, usage, folded grades and identity (ban > not operator > settled > unruled)."""
    rank = identity.groupBy("stem").agg(
        F.min(F.when(F.col("kind") == "blacklisted", 0).when(F.col("kind") == "not_operator", 1).otherwise(2)).alias("_rank")
    )
    joined = (
        library.join(scores.select("clip_id", F.col("verdict").alias("_verdict")), "clip_id", "left")
        .join(usage.select("stem", F.col("uses").alias("_uses")), "stem", "left")
        .join(grades.select("stem", "grade", "ident", "segments"), "stem", "left")
        .join(rank, "stem", "left")
    )
    verdict = F.when(F.col("proxy").isNull(), "NO_PROXY").otherwise(F.coalesce("_verdict", F.lit("UNSCANNED")))
    who = F.when(F.col("_rank") == 0, "blacklisted").when(F.col("_rank") == 1, "not_operator").when(F.col("_rank") == 2, "settled").otherwise("unruled")
    return joined.withColumns({"verdict": verdict, "identity": who, "uses": F.coalesce("_uses", F.lit(0)).cast("long")}).drop("_verdict", "_rank", "_uses")


def queue_group(item_new: Column, verdict: Column, untagged: Column, identity: Column) -> Column:
    return (
        F.when(item_new, 0)
        .when(verdict == "NO_PROXY", 6)
        .when(untagged, 1)
        .when(verdict == "PERSON", F.when(identity == "unruled", 2).otherwise(3))
        .when(verdict == "EMPTY", 5)
        .otherwise(4)
    )


def grading_queue(items: DataFrame) -> DataFrame:
    """Items in grading order: new, untagged, people, the rest, empty, no proxy; then stem."""
    group = queue_group(F.col("is_new"), F.col("verdict"), F.col("untagged"), F.col("identity")).cast("long")
    return items.withColumn("queue_group", group).orderBy("queue_group", "stem")


def effective_state(blocks: DataFrame, key: str = "receipt") -> DataFrame:
    """State of each receipt whose trailing blocks are open.

    ``started``: start of the trailing run of open states; ``working_since``:
    start of its last stretch without a wait; ``state``: newest block of the run
    that is not mere progress. Receipts that end closed are left out. The run is
    found by an aggregate of the last closed and last waiting block, not by a
    window over the receipt's whole history.
    """
    opened = F.col("state").isin(OPEN_STATES)
    ends = blocks.groupBy(key).agg(
        F.coalesce(F.max(F.when(~opened, F.col("seq"))), F.lit(-1)).alias("_closed"),
        F.coalesce(F.max(F.when(~opened | F.col("state").isin(WAITING), F.col("seq"))), F.lit(-1)).alias("_waited"),
    )
    tail = blocks.join(ends, key).where(F.col("seq") > F.col("_closed"))
    fact = F.struct("state", "why", "not_before")
    run = tail.groupBy(key).agg(
        F.max_by("lane", "seq").alias("lane"),
        F.max("row").alias("row"),
        F.min_by("ts", "seq").alias("started"),
        F.min_by("ts", F.when(F.col("seq") > F.col("_waited"), F.col("seq"))).alias("_work"),
        F.coalesce(F.max_by(fact, F.when(F.col("state") != "progress", F.col("seq"))), F.max_by(fact, "seq")).alias("e"),
    )
    queued = F.col("e.state").isin(WAITING)
    return run.select(
        key, "row", "lane", "started", F.coalesce("_work", "started").alias("working_since"), F.col("e.state").alias("state"),
        queued.alias("queued"), F.when(queued, F.col("e.why")).alias("why"), F.col("e.not_before").alias("not_before"),
    )


def picked_up(blocks: DataFrame, now: Column, trust_seconds: int = 10_800) -> DataFrame:
    """Newest open pickup per row whose current stretch of work is still trusted."""
    state = effective_state(blocks)
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("working_since").cast("timestamp"))
    fresh = state.where(age < trust_seconds * 1_000_000)
    facts = F.struct("receipt", "lane", "started", "working_since", "state")
    return fresh.groupBy("row").agg(F.max_by(facts, F.struct("started", "receipt")).alias("p")).select("row", "p.*")


def latest_answer(answers: DataFrame, key: str = "call_id", sequence: str = "sequence", name: str = "name") -> DataFrame:
    """Latest answer per call by sequence; the later name wins a tie."""
    rest = [c for c in answers.columns if c != key]
    return answers.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(sequence, name)).alias("a")).select(key, "a.*")


def verdict_history(receipts: DataFrame, key: str, order: list[str], verdict: str, width: float | None = None) -> DataFrame:
    """Every verdict in order with its number and the one before; nothing is removed."""
    return S.scan(receipts, [key], order, width, sequence=S.position(), previous_verdict=S.prev(verdict))


def order_queue(orders: DataFrame) -> DataFrame:
    return orders.orderBy("priority", "sent", "name")


def recent(df: DataFrame, ts: str, tie: str, limit: int) -> DataFrame:
    """The newest rows: a top-k, so each task keeps only ``limit`` rows."""
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(limit)


def brief(lessons: DataFrame, inbox: DataFrame, row: int | None, tags: list[str]) -> DataFrame:
    """Lessons newest first with tag matches ahead and own rows starred, then open inbox items."""
    match = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])) if tags else F.lit(False)
    own = (F.col("row") == row) if row is not None else F.lit(False)
    first = lessons.select(
        F.lit("lesson").alias("part"), "id", F.when(match, 0).otherwise(1).cast("long").alias("tier"), F.coalesce(own, F.lit(False)).alias("starred")
    )
    wanted = inbox.where(F.col("triage").isNull() & (own if row is not None else F.lit(True)))
    second = wanted.select(F.lit("inbox").alias("part"), "id", F.lit(2).cast("long").alias("tier"), F.lit(False).alias("starred"))
    return first.unionByName(second).orderBy("tier", F.when(F.col("part") == "lesson", -F.col("id")).otherwise(F.col("id")))


def census(clips: DataFrame, by: list[str], rollup: bool = False) -> DataFrame:
    """Clip counts, share percent and the most distinct blocks a locked build could draw; largest first.

    ``rollup`` adds subtotal rows (null keys).
    """
    labels = [F.coalesce(F.nullif(F.trim(F.col(b)), F.lit("")), F.lit("UNTAGGED")).alias(b) for b in by]
    named = clips.select(*labels)
    grouped = named.rollup(*by) if rollup else named.groupBy(*by)
    counted = grouped.agg(F.count("*").alias("clips"))
    total = clips.select(F.count("*")).scalar()
    return counted.select(*by, "clips", F.round(F.col("clips") / total * 100, 2).alias("share_percent"), F.col("clips").alias("block_ceiling")).orderBy(F.col("clips").desc(), *by)


def pending_drops(drops: DataFrame, registry: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Recent drops whose code no registry row carries."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))
    return drops.where(age <= hours * 3_600_000_000).join(registry.select("shortcode").distinct(), "shortcode", "left_anti")


def terminally_failed(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates that already failed for good on the same input; a missing hash equals a missing hash."""
    done = failures.select(F.col("project").alias("_p"), F.col("stage").alias("_s"), F.col("input_hash").alias("_h")).distinct()
    on = (F.col("project") == F.col("_p")) & (F.col("stage") == F.col("_s")) & F.col("input_hash").eqNullSafe(F.col("_h"))
    return candidates.join(done, on, "left_semi")


def answered_after(calls: DataFrame, rulings: DataFrame, finished: DataFrame, notes: DataFrame) -> DataFrame:
    """Calls still open: not ruled by name, no later finished work, no later note of another name on the row.

    Finished work and notes are reduced to at most two rows per row number
    before the join: a later note counts when its name differs from the call.
    """
    done = finished.groupBy("row").agg(F.max("ts").alias("_done"))
    by_name = notes.groupBy("row", "name").agg(F.max("ts").alias("ts"))
    two = S.top_k_per(by_name, ["row"], [F.col("ts").desc(), F.col("name")], 2)
    spoken = two.groupBy("row").agg(
        F.min_by("name", "rank").alias("_by"), F.max("ts").alias("_said"), F.max(F.when(F.col("rank") == 2, F.col("ts"))).alias("_other")
    )
    open_calls = calls.join(rulings.select("call_id").distinct(), "call_id", "left_anti").join(done, "row", "left").join(spoken, "row", "left")
    said = F.when(F.col("_by") == F.col("call_id"), F.col("_other")).otherwise(F.col("_said"))
    later = lambda ts: F.coalesce(ts > F.col("raised"), F.lit(False))
    closed = later(F.col("_done")) | later(said)
    return open_calls.where(~closed).select(*calls.columns)


def merge_calls(registry: DataFrame, intake: DataFrame, answers: DataFrame) -> DataFrame:
    """Calls of both sources by id (the registry wins), with an answer receipt overriding the state."""
    both = registry.withColumn("source", F.lit("registry")).unionByName(intake.withColumn("source", F.lit("intake")))
    rank = F.when(F.col("source") == "registry", 0).otherwise(1)
    merged = both.groupBy("call_id").agg(F.min_by(F.struct("project", "state", "source"), rank).alias("c")).select("call_id", "c.*")
    given = latest_answer(answers).select("call_id", F.col("name").alias("answer_receipt"))
    return merged.join(given, "call_id", "left").withColumn("state", F.when(F.col("answer_receipt").isNotNull(), "ANSWERED").otherwise(F.col("state")))


def resolve_file(wants: DataFrame, index: DataFrame) -> DataFrame:
    """Path for each different (row, name, bytes): own row's deliver copy, own copy, then ownerless copies; never another row's.

    Inside a tier the copy of the wanted size wins, then copies of another size, last those of unknown size;
    among equals the newest. Owned copies travel once, to their row and name, where one a size is kept and meets
    the wants; only wants that have none look up ownerless copies: the newest of their size, else of their name.
    """
    newest = F.struct("mtime", "path")
    tier = F.when(F.col("path").contains("/deliver/") & ~F.col("path").contains("/variants/"), 0).otherwise(1)
    copies = index.select(F.col("name").alias("_name"), "owner", F.col("bytes").alias("_bytes"), "mtime", "path")
    owned = copies.where("owner IS NOT NULL").repartition("owner", "_name")
    held = owned.groupBy("owner", "_name", "_bytes").agg(F.max(F.struct((-tier).alias("t"), "mtime", "path")).alias("_best"))
    # Wants without row or name find nothing. They are set aside first, and a size is never null as a key, so that no join adds a test for null and all parts of the result read the same shuffles.
    size = lambda name: F.struct(F.col(name).alias("size"))
    placed = F.col("row").isNotNull() & F.col("name").isNotNull()
    met = wants.where(placed).join(held, (F.col("row") == F.col("owner")) & (F.col("name") == F.col("_name")), "left")
    rank = F.struct(F.col("_best.t"), (F.col("_bytes") == F.col("bytes")).alias("s"), F.col("_best.mtime"), F.col("_best.path"))
    own = met.groupBy("row", "name", "bytes").agg(F.max(F.when(F.col("_best").isNotNull(), rank)).alias("_own"))
    bare = own.where("_own IS NULL").drop("_own")
    loose = copies.where("owner IS NULL")
    sized = loose.where("_bytes IS NOT NULL").groupBy("_name", size("_bytes").alias("_size")).agg(F.max(newest).alias("_sized"))
    fits = (F.col("name") == F.col("_name")) & (size("bytes") == F.col("_size"))
    named = loose.groupBy(F.col("_name").alias("_any_name")).agg(F.max(F.when(F.col("_bytes").isNotNull(), newest)).alias("_known"), F.max(newest).alias("_any"))
    rest = bare.join(sized, fits, "left").where("_sized IS NULL").join(named, F.col("name") == F.col("_any_name"), "left")
    other = F.coalesce(F.when(F.col("bytes").isNotNull(), F.col("_known")), "_any")
    want = ["row", "name", "bytes"]
    found = own.where("_own IS NOT NULL").select(*want, F.col("_own.path").alias("path"))
    found = found.unionByName(bare.join(sized, fits).select(*want, F.col("_sized.path").alias("path")))
    found = found.unionByName(rest.select(*want, other["path"].alias("path")))
    return found.unionByName(wants.where(~placed).select(*want).distinct().withColumn("path", F.lit(None).cast(index.schema["path"].dataType)))


def unlisted_cards(cards: DataFrame, declared: DataFrame) -> DataFrame:
    return cards.join(declared.select("call_id").distinct(), "call_id", "left_anti")


def newest_batch(files: DataFrame) -> DataFrame:
    """Files of the newest stamp that holds a variant video, one per name, with the count expected from cast files."""
    cast = F.regexp_extract("name", r"^cast_var(\d+)\.json$", 1)
    # Patterns are searched once for each different name of a row and stamp, only where the ending allows, and the result is written once for its three readers.
    best = F.min(F.struct((~F.col("path").contains("deliver")).alias("far"), "path")).alias("_best")
    names = files.where(F.lower("name").endswith(".mp4") | F.col("name").endswith(".json")).groupBy("row", "stamp", "name").agg(best)
    seen = names.withColumns({"_cast": F.when(F.col("name").endswith(".json"), cast), "_variant": F.when(F.lower("name").endswith(".mp4"), R.variant_of(F.col("name")))})
    marked = cut_lineage(seen).where("_variant IS NOT NULL OR _cast <> ''").withColumn("_video", F.col("_variant").isNotNull())
    newest = marked.where("_video").groupBy("row").agg(F.max("stamp").alias("stamp"))
    batch = marked.join(newest, ["row", "stamp"])
    planned = batch.where("_cast <> ''").groupBy("row").agg(F.countDistinct(F.col("_cast").cast("int")).alias("expected"))
    chosen = batch.where("_video")
    found = chosen.groupBy("row").agg(F.count("*").alias("found"))
    return (
        chosen.join(planned, "row", "left").join(found, "row")
        .select("row", "stamp", "name", F.col("_variant").alias("variant"), F.col("_best.path").alias("path"), "expected", "found")
    )


def current_version(files: DataFrame, states: DataFrame) -> DataFrame:
    """Per row the file of the version its state names, else of the highest tagged version, else the last name."""
    asked = F.regexp_extract("state", r"(?<![A-Za-z0-9])[Vv](\d{1,3})(?![0-9])", 1).try_cast("int")
    version = R.version_of(F.col("name"))
    joined = files.withColumn("_v", version).join(states.select("row", asked.alias("_want")), "row", "left")
    picks = joined.groupBy("row").agg(
        F.min(F.when(F.col("_v") == F.col("_want"), F.col("name"))).alias("_named"),
        F.min_by("name", F.when(F.col("_v").isNotNull(), F.struct(-F.col("_v"), "name"))).alias("_high"),
        F.max("name").alias("_last"),
    )
    return picks.select("row", F.coalesce("_named", "_high", "_last").alias("name"))


def board_counts(cards: DataFrame) -> DataFrame:
    """Cards per bucket in board order, with the card that lands soonest."""
    order = F.when(F.col("bucket") == "needs_you", 0).when(F.col("bucket") == "machine", 1).when(F.col("bucket") == "parked", 2).otherwise(3)
    counted = cards.groupBy("bucket").agg(
        F.count("*").alias("cards"), F.min_by("row", F.when(F.col("eta").isNotNull(), F.struct("eta", "row"))).alias("soonest_row"), F.min("eta").alias("soonest_eta")
    )
    return counted.withColumn("position", order.cast("long")).orderBy("position")


def lane_quota(headline: DataFrame, registry: DataFrame, intake: DataFrame, lane: str) -> DataFrame:
    """Distinct holders of a limited lane over its three declarations, and where each was first found."""
    parts = [(headline, "headline", 0), (registry, "registry", 1), (intake, "intake", 2)]
    union = None
    for df, name, rank in parts:
        one = df.where(F.upper(F.trim("lane")) == lane).select(F.lower(F.trim("shortcode")).alias("holder"), F.lit(name).alias("found_in"), F.lit(rank).alias("_rank"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy("holder").agg(F.min_by("found_in", "_rank").alias("found_in"), F.count("*").alias("declarations"))


def row_timeline(casts: DataFrame, renders: DataFrame, receipts: DataFrame) -> DataFrame:
    """Casts, renders and receipts of all rows in one time order; tests left out, refused renders labelled."""
    a = casts.select("row", "ts", F.lit("cast").alias("kind"), "name")
    b = renders.select("row", "ts", F.when(F.col("refused"), "render refused").otherwise("render").alias("kind"), "name")
    c = receipts.where("kind <> 'smoketest'").select("row", "ts", F.lit("receipt").alias("kind"), "name")
    return a.unionByName(b).unionByName(c).orderBy("row", "ts", "kind", "name")


def slot_contract_diff(master: DataFrame, variant: DataFrame, keys: list[str]) -> DataFrame:
    """Slots only one side has."""
    a, b = master.select(*keys).distinct(), variant.select(*keys).distinct()
    missing = a.join(b, keys, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))
