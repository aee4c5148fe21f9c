"""Exact duplicates by full content, in stages that no group of copies can overload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store
from cutlake.llm.carry import carried, one_of_each, restored
from cutlake.llm.groups import attach

SALTS = 64


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", salts: int = SALTS, normalise=None) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (a null id only where no
    row of the group has one; of rows that repeat id and text one is kept as a
    pair, so both carry ``kept``). A null text counts as empty, empty texts are
    equal to each other. ``normalise`` maps the text column; by default nothing
    is changed. Other columns of ``docs`` are ignored, whatever their names.

    Digests only choose what to compare. Texts whose digest occurs twice are
    grouped by digest and full text: first inside each task (the map side of the
    aggregation), then per salt, so that a large group is merged by many tasks,
    then over the salt winners.
    """
    body: Column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if normalise is not None:
        body = normalise(body)
    rows = docs.select(F.col(id).alias("_id"), body.alias("_text")).withColumn("_digest", F.sha2(F.encode("_text", "UTF-8"), 256))
    twins = store.keep(rows.groupBy("_digest").agg(F.count("*").alias("_n")).where("_n > 1"), "twins")
    both = attach(rows, twins, "_digest", "_n", "_id", how="inner")
    salted = both.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    top, size = F.max("_id").alias("keep_id"), F.count("*").alias("group_size")
    local = salted.groupBy("_salt", "_digest", "_text").agg(top, size)
    winners = local.groupBy("_digest", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = store.keep(winners, "winners")
    shared = store.keep(winners.groupBy("_digest").agg(F.count("*").alias("_texts")).where("_texts > 1"), "shared_digests")
    slim = rows.select("_id", "_digest")
    if shared.isEmpty():
        found = attach(slim, winners.drop("_text"), "_digest", "group_size", "_id")
    else:  # two texts under one digest: the full text decides the group as well
        own = F.concat_ws(":", "_digest", "_text")
        found = attach(rows.withColumn("_key", own), winners.withColumn("_key", own).drop("_digest", "_text"), "_key", "group_size", "_id").drop("_key", "_text")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    out = found.withColumn("keep_id", keep).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.select(F.col("_id").alias(id), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_exact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has no copy under a larger id, with all their columns.

    Rows that repeat both id and text are copies too: one of them stays.
    """
    gone = exact_groups(docs, id, text).where(~F.col("kept")).select(F.col(id).alias("_gid"), F.col("text_sha256").alias("_sha"))
    digest = F.sha2(F.encode(F.coalesce("_text", F.lit("")), "UTF-8"), 256)
    left = carried(docs, id, text).join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (digest == F.col("_sha")), "left_anti")
    return restored(one_of_each(left, ["_id", "_text"], store.keep))
