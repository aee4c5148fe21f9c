"""Whole rows carried past an operator's own columns, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``_all`` (a struct of all columns), ``_id``, ``_text``."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), F.col(id).alias("_id"), F.col(text).cast("string").alias("_text"))


def restored(rows: DataFrame) -> DataFrame:
    return rows.select("_all.*")


def one_of_each(rows: DataFrame, keys: list[str], keep) -> DataFrame:
    """Carried rows with one row for each value of ``keys``; only rows whose id repeats are compared.

    ``keep`` stores a table: the repeated ids are found first, mostly none.
    """
    repeated = keep(rows.groupBy("_id").count().where("count > 1").select(F.col("_id").alias("_rid")), "repeated_ids")
    if repeated.isEmpty():
        return rows
    again = F.col("_id").eqNullSafe(F.col("_rid"))
    return rows.join(repeated, again, "left_anti").unionByName(rows.join(repeated, again, "left_semi").dropDuplicates(keys))
