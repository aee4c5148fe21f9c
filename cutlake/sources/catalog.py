"""Catalogue, feature, ledger and library readers, and the incremental file index.

Each reader is a text scan plus a parser that takes a DataFrame of lines, so
the same parsing serves batch, streams and tables that already hold the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.schemas import GRADE_LINE, LIBRARY


def get(doc: Column | str, path: str, kind: str = "string") -> Column:
    """A typed value at a path of a variant, null when absent or of another type."""
    return F.try_variant_get(F.col(doc) if isinstance(doc, str) else doc, path, kind)


def label_texts(doc: Column | str, path: str, *fields: str) -> Column:
    """Texts of an array whose elements are strings or objects carrying ``fields``."""
    read = lambda v: F.array_compact(F.array(get(v, "$"), *[get(v, f"$.{f}") for f in fields]))
    plain = lambda texts: F.filter(texts, lambda x: ~x.startswith("{"))
    items = F.coalesce(get(doc, path, "array<variant>"), F.array().cast("array<variant>"))
    return plain(F.flatten(F.transform(items, read)))


def parse_catalog(lines: DataFrame, value: str = "value", origin: str | None = None) -> DataFrame:
    """One row per JSON object line; blank lines drop, any other line fails the job by name."""
    doc = F.col("doc")
    source = F.col(origin) if origin else F.lit("catalog")
    bad = doc.isNull() | ~F.schema_of_variant(doc).startswith("OBJECT")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a JSON object in "), source, F.lit(": "), F.col(value)))).otherwise(F.lit(True))
    rows = lines.where(F.trim(value) != "").withColumn("doc", F.try_parse_json(F.col(value))).withColumn("_ok", checked).where("_ok")
    motion = "$.camera_motion"
    return rows.select(
        get("doc", "$.path").alias("path"),
        get("doc", "$.clip_id").alias("clip_id"),
        F.coalesce(get("doc", "$.source_sha256"), get("doc", "$.sha256")).alias("source_sha256"),
        get("doc", "$.duration_s", "double").alias("duration_s"),
        get("doc", f"{motion}.label").alias("motion_label"),
        get("doc", f"{motion}.translation_speed_p90", "double").alias("motion_speed"),
        get("doc", "$.editorial_role_counts.subject_or_local_motion_peak", "int").alias("local_peaks"),
        get("doc", "$.pose_count_in_representative_frame", "int").alias("poses"),
        get("doc", "$.face_count_in_representative_frame", "int").alias("faces"),
        F.coalesce(get("doc", "$.semantic_groups", "array<string>"), F.array().cast("array<string>")).alias("semantic_groups"),
        label_texts("doc", "$.top_visual_labels", "label").alias("labels"),
        label_texts("doc", "$.duplicate_or_setup_families", "family_id", "description").alias("families"),
    )


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("origin"))
    return parse_catalog(lines, origin="origin")


def parse_features(docs: DataFrame, value: str = "value") -> DataFrame:
    """Feature rows of ``[...]`` or ``{"features": [...]}`` documents; the last row of a path wins."""
    parsed = docs.select(F.try_parse_json(F.col(value)).alias("_doc"))
    doc = F.col("_doc")
    rows = F.coalesce(get(doc, "$.features", "array<variant>"), get(doc, "$", "array<variant>"))
    at = parsed.select(F.posexplode(rows).alias("pos", "r"))
    flat = at.select(get("r", "$.path").alias("path"), "pos", *[get("r", f"$.{n}", "double").alias(n) for n in ("luma_p50", "sat_p50", "laplacian_var")])
    facts = F.struct("luma_p50", "sat_p50", "laplacian_var")
    return flat.where(F.coalesce("path", F.lit("")) != "").groupBy("path").agg(F.max_by(facts, "pos").alias("f")).select("path", "f.*")


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(spark.read.text(path, wholetext=True))


def parse_ledger(lines: DataFrame, value: str = "value") -> DataFrame:
    """Grade lines that parse and name a stem; a torn line never takes others with it."""
    row = F.from_json(F.col(value), GRADE_LINE, {"mode": "PERMISSIVE"})
    return lines.select(*[c for c in lines.columns if c != value], row.alias("r")).select(*[c for c in lines.columns if c != value], "r.*").where(F.coalesce("stem", F.lit("")) != "")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_ledger(spark.read.text(path))


def explode_library(docs: DataFrame, value: str = "value") -> DataFrame:
    """Clips of library documents as rows; a clip without a world is UNTAGGED."""
    clips = F.from_json(F.col(value), LIBRARY)["clips"]
    rows = docs.select(F.explode(clips).alias("clip_id", "clip")).select("clip_id", "clip.*")
    return rows.withColumn("world", F.coalesce(F.nullif(F.trim("tags.world_cluster"), F.lit("")), F.lit("UNTAGGED")))


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return explode_library(spark.read.text(path, wholetext=True))


def incremental_index(listing: DataFrame, prior: DataFrame) -> DataFrame:
    """Each listed file with its earlier record when (path, sha256) is unchanged; ``reused`` is false for the rest."""
    keep = [c for c in prior.columns if c not in listing.columns]
    seen = prior.select("path", "sha256", *keep, F.lit(True).alias("_seen"))
    return listing.join(seen, ["path", "sha256"], "left").withColumn("reused", F.coalesce("_seen", F.lit(False))).drop("_seen")


def work_list(listing: DataFrame, prior: DataFrame) -> DataFrame:
    """Listed files that have to be probed."""
    return listing.join(prior.select("path", "sha256"), ["path", "sha256"], "left_anti")


def index_manifest(listing: DataFrame, records: DataFrame) -> DataFrame:
    """Expected, probed, passed, failed and missing counts; PASS only when every listed file passed."""
    marked = listing.select("path").join(records.select("path", "status"), "path", "left")
    agg = marked.agg(
        F.count("*").alias("expected"), F.count("status").alias("probed"), F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status").isNull()).alias("missing")
    )
    done = (F.col("failed") == 0) & (F.col("passed") == F.col("expected"))
    return agg.withColumn("status", F.when(done, "PASS").otherwise("FAIL"))
