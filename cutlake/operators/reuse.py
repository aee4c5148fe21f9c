"""Reuse maps, duplicate content, variant families and trial metrics."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.functions.color import circular_mean
from cutlake.operators.scan import top_k_per
from cutlake.session import cut_lineage



def duplicate_groups(files: DataFrame, digest: str = "sha256", path: str = "path", salts: int = 16) -> DataFrame:
    """Members of every content group with more than one path: digest, path, copies.

    Members stay rows, since one group may hold a large share of all files. The
    count comes map-side; the join back is salted so that such a group is
    spread over ``salts`` tasks.
    """
    counted = files.groupBy(digest).agg(F.countDistinct(path).alias("copies")).where("copies > 1")
    wide = counted.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    marked = files.select(digest, path).distinct().withColumn("_salt", F.pmod(F.xxhash64(path), F.lit(salts)))
    return marked.join(wide, [digest, "_salt"]).select(digest, path, "copies")


def unique_content(files: DataFrame, digest: str = "sha256") -> DataFrame:
    counted = files.groupBy(digest).agg(F.count("*").alias("n"))
    return counted.agg(F.sum("n").alias("files"), F.count("*").alias("unique_content"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def delivered_slots(deliveries: DataFrame) -> DataFrame:
    """Every delivered (row, slot, master) use.

    Base slots are replaced by the latest supersession of the slot; also,
    variant and historic cuts sit beside them under their prefix.
    """
    base = deliveries.where("kind = 'base'")
    sup = deliveries.where("kind = 'supersede'").groupBy("row", "slot").agg(F.max_by(F.struct("version", "master_id", "file"), "ordinal").alias("s")).select("row", "slot", "s.*")
    kept = base.join(sup.select("row", "slot"), ["row", "slot"], "left_anti").select("row", "slot", "version", "master_id", "file")
    past = F.col("kind") == "historic"
    side = deliveries.where("kind IN ('also', 'variant', 'historic')").select("row", F.concat("prefix", "slot").alias("slot"), "version", "master_id", "file", past.alias("historic"))
    current = kept.unionByName(sup.select(*kept.columns)).withColumn("historic", F.lit(False))
    return current.unionByName(side).where("master_id IS NOT NULL")


def reuse_map(slots: DataFrame) -> DataFrame:
    """Uses with, per master, how many slots and rows it ships in; counts combine map-side."""
    facts = slots.groupBy("master_id").agg(F.count("*").alias("uses"), F.countDistinct("row").alias("rows"))
    return slots.join(facts, "master_id")


def first_ship(slots: DataFrame) -> DataFrame:
    """First delivered row and slot of each master over every delivered cut, historic ones included."""
    pick = F.struct("row", "slot")
    return slots.groupBy("master_id").agg(F.min(pick).alias("f"), F.count("*").alias("uses")).select("master_id", F.col("f.row").alias("first_row"), F.col("f.slot").alias("first_slot"), "uses")


def usage_histogram(casts: DataFrame, master: str = "master_id") -> DataFrame:
    """Uses per master, least used first."""
    return casts.groupBy(master).agg(F.count("*").alias("uses"), (F.count("*") > 1).alias("reused")).orderBy("uses", master)


def plan_health(records: DataFrame, plans: DataFrame) -> DataFrame:
    """Per row: resolved or not, records without a source, override-delta warning, missing variants.

    ``records``: row, kind, variant, master_id. ``plans``: row, expected_variants.
    """
    base = F.col("kind") == "base"
    agg = records.groupBy("row").agg(
        F.count_if(base).alias("base_records"), F.count_if(base & F.col("master_id").isNull()).alias("sourceless"),
        F.countDistinct(F.when(F.col("kind") == "variant", F.col("variant"))).alias("variants"),
    )
    j = plans.join(agg, "row", "left")
    n = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    return j.select(
        "row", n("base_records").alias("base_records"), n("sourceless").alias("sourceless"), n("variants").alias("variants"),
        F.when(n("base_records") == 0, "UNRESOLVED").otherwise("RESOLVED").alias("status"), (n("sourceless") * 2 > n("base_records")).alias("delta_warning"),
        (n("variants") < F.col("expected_variants")).alias("too_few_variants"),
    )


def require_variants(health: DataFrame) -> DataFrame:
    """The same table, failing the job on the first row with fewer variants than declared."""
    message = F.concat(F.lit("too few live variants on row "), F.col("row").cast("string"))
    return health.withColumn("variants", F.when(F.col("too_few_variants"), F.raise_error(message).cast("long")).otherwise(F.col("variants")))


EVIDENCE = r'"(?:drive_file_id|drive_id|[^"]*delivery[^"]*)"\s*:|"today_files"\s*:\s*(?:\[\s*[^\]\s]|\{\s*[^}\s])'


def coverage_gap(registry: DataFrame, declared: DataFrame, document: str = "document") -> DataFrame:
    """Rows whose JSON document carries delivery evidence at any depth but that are not declared."""
    shown = registry.where(F.lower(F.col(document)).rlike(EVIDENCE))
    return shown.join(declared.select("row").distinct(), "row", "left_anti")


def reuse_violations(slots: DataFrame, blocks: DataFrame, key: str = "project") -> DataFrame:
    """Sources used more than once without one shared, non-empty repeat group."""
    joined = slots.join(blocks.select(key, "block_id", "repeat_group"), [key, "block_id"], "left")
    group = F.coalesce("repeat_group", F.lit(""))
    agg = joined.groupBy(key, "source").agg(F.count("*").alias("uses"), F.min(group).alias("_a"), F.max(group).alias("_b"))
    return agg.where((F.col("uses") > 1) & ((F.col("_a") != F.col("_b")) | (F.col("_a") == ""))).select(key, "source", "uses")


def family_audit(slots: DataFrame, opening: Column, min_variants: int = 2, min_changed: int = 1, min_ratio: float = 0.5) -> DataFrame:
    """Faults of each variant against its master (variant null) and its siblings.

    A window of the same source is not a changed slot. Packages are compared by
    a digest of the variant's ordered slots.
    """
    master = slots.where("variant IS NULL").select("family", "slot_id", F.col("role").alias("_role"), F.col("frames").alias("_frames"), F.col("source_sha256").alias("_src"))
    size = master.groupBy("family").agg(F.count("*").alias("_size"))
    ours = slots.where("variant IS NOT NULL")
    who = ours.select("family", "variant").distinct()
    wanted = who.join(master, "family")
    joined = wanted.join(ours, ["family", "variant", "slot_id"], "full_outer").withColumn("_open", F.col("slot_id") == opening)
    here, there = F.col("source_sha256").isNotNull(), F.col("_src").isNotNull()
    changed = here & there & (F.col("source_sha256") != F.col("_src"))
    entry = F.when(here, F.struct("slot_id", "source_sha256", "source_start_frame", "source_end_frame"))
    per = joined.groupBy("family", "variant").agg(
        F.count_if(there & ~here).alias("missing"), F.count_if(here & ~there).alias("extra"),
        F.count_if(here & there & ((F.col("role") != F.col("_role")) | (F.col("frames") != F.col("_frames")))).alias("contract"),
        F.count_if(changed).alias("changed"), F.max(F.when(F.col("_open"), F.col("source_sha256"))).alias("_opening"), F.max(F.when(F.col("_open"), F.col("_src"))).alias("_master_opening"),
        F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256).alias("_package"),
    )
    same = per.groupBy("family", "_package").agg(F.min("variant").alias("_first"))
    opens = per.groupBy("family", "_opening").agg(F.min("variant").alias("_first_open"))
    count = per.groupBy("family").agg(F.count("*").alias("_variants"))
    j = per.join(same, ["family", "_package"]).join(opens, ["family", "_opening"], "left").join(size, "family").join(count, "family")
    ratio = F.col("changed") / F.col("_size")
    faults = {
        "too_few_variants": F.col("_variants") < min_variants, "missing_slots": F.col("missing") > 0, "extra_slots": F.col("extra") > 0, "contract_changed": F.col("contract") > 0,
        "duplicate_package": F.col("variant") != F.col("_first"), "opening_not_new": F.col("_opening") == F.col("_master_opening"),
        "opening_reused": F.col("variant") != F.col("_first_open"), "too_few_changes": F.col("changed") < min_changed, "ratio_too_low": ratio + 1e-12 < min_ratio,
    }
    named = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(n)) for n, bad in faults.items()]))
    return j.select("family", "variant", "changed", F.round(ratio, 4).alias("ratio"), F.array_join(named, ",").alias("faults"), F.when(F.size(named) == 0, "PASS").otherwise("FAIL").alias("status"))


def distance_matrix(slots: DataFrame) -> DataFrame:
    """Variant pairs of a family that share at least one (slot, source), with the slots that differ.

    An equi-join on (family, slot, source) finds what two variants share; a
    pair that shares nothing differs in every slot and is not listed.
    """
    size = slots.groupBy("family").agg(F.countDistinct("slot_id").alias("slots"))
    side = lambda name: slots.select("family", "slot_id", "source_sha256", F.col("variant").alias(name))
    shared = side("a").join(side("b"), ["family", "slot_id", "source_sha256"]).where("a < b").groupBy("family", "a", "b").agg(F.count("*").alias("_same"))
    return shared.join(size, "family").select("family", "a", "b", (F.col("slots") - F.col("_same")).alias("changed"), F.round((F.col("slots") - F.col("_same")) / F.col("slots"), 4).alias("ratio"))


def closest_variants(slots: DataFrame) -> DataFrame:
    """The pair of each family of two or more variants that differs least (first by name on a tie).

    A listed pair shares a slot and so differs less than any unlisted one; a family
    whose variants share nothing gives its first two.
    """
    listed = distance_matrix(slots).groupBy("family").agg(F.min(F.struct("changed", "a", "b")).alias("m"))
    two = top_k_per(slots.select("family", "variant").distinct(), ["family"], [F.col("variant")], 2).groupBy("family")
    size = slots.groupBy("family").agg(F.countDistinct("slot_id").alias("changed"))
    first = two.agg(F.min("variant").alias("a"), F.max("variant").alias("b")).where("a < b").join(size, "family")
    both = first.select("family", F.struct("changed", "a", "b").alias("f")).join(listed, "family", "left")
    return both.select("family", F.coalesce("m", "f").alias("m")).select("family", "m.*")


def frame_distance_pairs(vectors: DataFrame, key: str, vector: str, limit: float, size: int, projections: int = 3, block: int = 16384) -> DataFrame:
    """All pairs of distinct vectors whose mean absolute difference is at most ``limit``, with the distance.

    Identical vectors are folded into one first (``copies``). For any signs, the
    signed sums of two vectors differ by no more than their total difference,
    so a pair within the limit lies in neighbouring cells of a grid over a few
    signed sums. The result is exact for any limit; how few candidates meet
    depends on the limit being small against the spread of the vectors, which
    is what a search for near copies asks. Vectors of neighbouring cells meet
    in blocks of about ``block``, one group for each pair of blocks: where all
    cells are neighbours the work is that of all pairs, a vector travels once
    for each block it meets, and a group stays as large as two blocks.
    """
    kind = vectors.schema[vector].dataType.elementType
    values = vectors.withColumn("_v", F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>"))
    unique = values.groupBy("_v").agg(F.min(key).alias(key), F.count("*").alias("copies"))

    def signed_sum(width: int) -> Column:
        # Signs flip in runs of that many entries.
        flip = lambda x, i: F.when(F.pmod(F.floor(i / F.lit(float(width))), F.lit(2)) == 0, x).otherwise(-x)
        return F.aggregate(F.transform(F.col("_v").cast("array<double>"), flip), F.lit(0.0), lambda a, x: a + x)

    sums = {f"_g{p}": F.floor(signed_sum(2**p) / F.lit(float(size) * limit)) for p in range(projections)}
    grid = list(sums)
    # a vector with a value that is missing or not finite is near to none
    finite = unique.where(F.abs(signed_sum(1)) < float("inf"))
    home = cut_lineage(finite.select(F.col(key).alias("id"), "_v", "copies", *[e.alias(n) for n, e in sums.items()]))
    counted = home.groupBy(*grid).agg(F.ceil(F.count("*") / block).alias("_parts"))
    # cells and block numbers meet their neighbours; vectors follow only to the pairs of blocks that are compared
    names = counted.select(*grid, "_parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    names = cut_lineage(names.withColumn("_block", F.monotonically_increasing_id()))
    near = names.select(*grid, F.col("_block").alias("_b"))
    for g in grid:
        near = near.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    both = cut_lineage(names.withColumnRenamed("_block", "_a").join(near, grid).where("_a <= _b").select("_a", "_b"))
    sides = both.select("_a", "_b", F.col("_a").alias("_block")).unionByName(both.where("_a <> _b").select("_a", "_b", F.col("_b").alias("_block")))
    placed = home.join(counted, grid).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).join(names.drop("_parts"), [*grid, "_part"]).select("_block", "id", "copies", "_v")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        a, b, at = (table[c].to_numpy() for c in ("_a", "_b", "_block"))
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        v = table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        left, right = np.flatnonzero(at == a), np.flatnonzero(at == b)
        for i, j, distance in _close(v, left, right, limit, a[0] == b[0]):
            i, j = np.where(ids[i] > ids[j], j, i), np.where(ids[i] > ids[j], i, j)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[i], ids[j], copies[i], copies[j], distance)], names=["a", "b", "a_copies", "b_copies", "distance"])

    # as many tasks as there are pairs to compare, so that a few do not gather in one
    tasks = min(4 * max(both.count(), 1), 4096)
    kind = dict(vectors.dtypes)[key]
    members = placed.join(sides, "_block").repartition(tasks, "_a", "_b")
    return members.groupBy("_a", "_b").applyInArrow(measure, f"a {kind}, b {kind}, a_copies long, b_copies long, distance double")


def _close(v: np.ndarray, left: np.ndarray, right: np.ndarray, limit: float, same: bool, tile: int = 512, steps: int = 8) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and mean absolute difference of the pairs ``left`` x ``right`` within ``limit``, each once if they are the ``same``.

    A value's range is cut into steps; each step counts how far the value fills it. Two
    values fill a step of width w to u and u', and |u - u'| >= (u - u')^2 / w, so squared
    distances of these fillings, one matrix product, never exceed the absolute difference.
    What the bound leaves is measured exactly.
    """
    size = v.shape[1]
    known = v[np.isfinite(v)].astype("float64")
    middle, reach = (float(known.mean()), 2 * float(known.std())) if known.size else (0.0, 0.0)
    step = 2 * reach / steps or 1.0
    floors = middle - reach + step * np.arange(steps)

    def filled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = (np.clip(v[rows][:, :, None] - floors, 0, step) / np.sqrt(step)).astype("float32").reshape(len(rows), -1)
        return u, -(u * u).sum(axis=1, keepdims=True) / 2

    # two more columns add the halves of the squares, so that a product is minus half of the squared distance
    one = np.ones((tile, 1), "float32")
    tiles = [(rows := right[q : q + tile], *filled(rows)) for q in range(0, len(right), tile)]
    tiles = [(rows, np.hstack([w, one[: len(rows)], half]), half) for rows, w, half in tiles]
    for p in range(0, len(left), tile):
        rows = left[p : p + tile]
        u, half = filled(rows)
        u = np.hstack([u, half, one[: len(rows)]])
        for others, w, other_half in tiles[p // tile if same else 0 :]:
            slack = limit * size / 2 - 1e-4 * float(half.min() + other_half.min())
            near = np.flatnonzero(~(u @ w.T < -slack))  # what is not a number is not far
            for c in range(0, len(near), 4096):
                i, j = rows[near[c : c + 4096] // len(others)], others[near[c : c + 4096] % len(others)]
                if same:
                    once = i < j
                    i, j = i[once], j[once]
                distance = np.abs(v[i].astype("float64") - v[j].astype("float64")).mean(axis=1)
                hit = distance <= limit
                if hit.any():
                    yield i[hit], j[hit], distance[hit]


def shot_stats(frames: DataFrame, keys: list[str], metrics: list[str], hue: str, hist: str) -> DataFrame:
    """Median of each metric over a shot's frames (NaN left out), mean hue, mean hue histogram and its top bin.

    A shot is a short run of frames, so its medians are taken in one aggregation;
    equal values are held once with their count.
    """
    middle = lambda m: F.median(F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))).alias(m)
    hues = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.round(circular_mean(F.col(hue)), 6).alias("hue_mean"), *map(middle, metrics))
    bins = frames.select(*keys, F.posexplode(hist).alias("bin", "share")).groupBy(*keys, "bin").agg(F.round(F.avg("share"), 9).alias("share"))
    top = bins.groupBy(*keys).agg(F.max_by(F.struct("bin", "share"), F.struct("share", -F.col("bin"))).alias("t"))
    dominant = F.when(F.col("t.share") > 0, F.col("t.bin")).otherwise(-1)
    return hues.join(top, keys, "left").select(*keys, "frames", *metrics, "hue_mean", dominant.alias("dominant_bin"))


def feasibility_ratio(rows: DataFrame, key: str = "project", locked: bool = True, minimum: float = 0.80) -> DataFrame:
    """Share of blocks with an exact scene; blocked by any missing block or a low share in locked mode."""
    agg = rows.groupBy(key).agg(F.count("*").alias("blocks"), F.count_if(F.col("coverage") == "exact_scene_available").alias("exact"), F.count_if(F.col("coverage") == "missing").alias("missing"))
    ratio = F.col("exact") / F.col("blocks")
    switch = (ratio < minimum) if locked else F.lit(False)
    return agg.select(
        key, "blocks", "exact", "missing", F.round(ratio, 8).alias("ratio"), switch.alias("mode_switch"), F.when((F.col("missing") > 0) | switch, "BLOCKED").otherwise("PASS").alias("status")
    )


# Capture windows of a trial.
WINDOWS = ["24h", "72h"]


def trial_metrics(snapshots: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per (trial, window) with each known metric, null where absent, and the absent ones by name.

    A (trial, window, metric) given more than once marks the snapshot as duplicated.
    """
    first = snapshots.groupBy("trial", "window").pivot("metric", metrics).agg(F.first("value"))
    twice = snapshots.groupBy("trial", "window", "metric").agg(F.count("*").alias("_n")).groupBy("trial", "window").agg((F.max("_n") > 1).alias("duplicated"))
    absent = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    return first.join(twice, ["trial", "window"]).withColumn("withheld", F.array_join(absent, ","))


def comparable_trials(snapshots: DataFrame, min_n: int = 3) -> DataFrame:
    """Mean and deviation of a metric per window where at least ``min_n`` trials measured it."""
    agg = snapshots.where("value IS NOT NULL").groupBy("window", "metric").agg(F.countDistinct("trial").alias("trials"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    return agg.where(F.col("trials") >= min_n)


