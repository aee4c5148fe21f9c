"""Lines that many sites share, by distinct-site sketches, removed from documents. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store
from cutlake.llm.groups import attach

MIN_SITES, LG_K, ERRORS = 5, 12, 4.0


def _lines(docs: DataFrame, id: str, text: str, site: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # hashed and split below the explode: beside it Spark would hash the whole text again for each line
    texts = docs.select(F.col(id).alias("_id"), F.col(site).cast("string").alias("_site"), F.hash(body).alias("_text_hash"), F.split(body, "\n").alias("_lines"))
    return texts.select("_id", "_site", "_text_hash", F.posexplode("_lines").alias("_pos", "_line"))


def line_key(line: Column) -> Column:
    """96 bits of the trimmed line; null for a blank line, which is never boilerplate."""
    own = F.trim(line)
    return F.when(own != "", F.struct(F.xxhash64(own).alias("a"), F.hash(own).alias("b")))


def site_spread(rows: DataFrame, min_sites: int, lg_k: int = LG_K, errors: float = ERRORS) -> DataFrame:
    """``_key, _sites, _n`` of the keys of ``rows(_key, _site)`` that at least ``min_sites`` distinct sites have.

    One HyperLogLog sketch per key: built on the map side, merged by the
    aggregation, so a line that is everywhere costs a sketch a task. An estimate
    farther than ``errors`` standard errors (and a half) from the threshold
    decides; the others get an exact distinct count. A null site is no site.
    """
    spread = rows.groupBy("_key").agg(F.hll_sketch_agg("_site", lg_k).alias("_sketch"), F.count("*").alias("_n"))
    spread = spread.where(F.col("_n") >= min_sites).select("_key", "_n", F.hll_sketch_estimate("_sketch").alias("_sites"))
    spread = store.keep(spread, "line_spread")
    band = errors * 1.04 / math.sqrt(1 << lg_k) * min_sites + 0.5
    off = F.col("_sites") - min_sites
    near = spread.where(F.abs(off) <= band)
    pairs = attach(rows, near.select("_key", "_n", F.lit(True).alias("_near")), "_key", "_n", "_site", how="inner")
    exact = pairs.groupBy("_key", "_site").agg(F.count("*").alias("_rows")).groupBy("_key").agg(F.count("_site").alias("_sites"), F.sum("_rows").alias("_n"))
    far = spread.where(off > band).select("_key", "_sites", "_n")
    return far.unionByName(exact.where(F.col("_sites") >= min_sites).select("_key", "_sites", "_n"))


def drop_shared_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: ``id, n_lines, n_removed, removed_bytes, kept_text``.

    A line (trimmed of spaces, cut at ``\\n``) that at least ``min_sites`` distinct
    sites have is boilerplate and leaves every document; the other lines stay as they
    are, blank ones included, joined by ``\\n``. A null text is one empty line. A null
    site adds to no count, but its lines are removed alike. Rows that repeat an id and
    a text are treated alike. Other columns are ignored.
    """
    lines = _lines(docs, id, text, site).withColumn("_key", line_key(F.col("_line")))
    shared = store.keep(site_spread(lines.where("_key is not null").select("_key", "_site"), min_sites), "shared_lines")
    places = lines.where("_key is not null").select("_id", "_text_hash", "_pos", "_key")
    hits = attach(places, shared, "_key", "_n", "_pos", how="inner")
    gone = hits.groupBy("_id", "_text_hash").agg(F.collect_set("_pos").alias("_gone"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id).alias("_own"), body.alias("_body"), F.hash(body).alias("_h"))
    met = rows.join(gone.hint("merge"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text_hash")), "left")
    parts, none = F.split("_body", "\n"), F.col("_gone").isNull()
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))  # hashed: linear in the lines
    # the lines are bound by a lambda of their own: inside the other one Spark would split the text anew for each line
    joined = F.element_at(F.transform(F.array(parts), lambda held: F.array_join(F.transform(left, lambda i: F.get(held, i)), "\n")), 1)
    kept = F.when(none, F.col("_body")).otherwise(joined)
    out = met.select(F.col("_own").alias(id), F.size(parts).cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"), "_body", kept.alias("kept_text"))
    return out.select(id, "n_lines", "n_removed", (F.octet_length("_body") - F.octet_length("kept_text")).cast("long").alias("removed_bytes"), "kept_text")
