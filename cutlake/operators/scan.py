"""Ordered per-key scans that never put one whole key in one task.

A plain ``Window.partitionBy(key)`` sends a key's rows to a single task. Here
each key's ordering axis is cut into fixed-width chunks, the window runs inside
``(key, chunk)``, and a summary of one row per chunk carries the running state
from chunk to chunk. The result does not depend on the chunk width; the width
only sets how many rows one task sees. The rows are shuffled once, on
``(key, chunk)``; the summary is aggregated map-side before its own shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
DAY_US = 86_400_000_000


class Step(NamedTuple):
    kind: str
    value: Column | None = None
    default: object = None


def prev(value: str | Column) -> Step:
    """The value on the previous row (null on a key's first row)."""
    return Step("prev", _col(value))


def following(value: str | Column) -> Step:
    """The value on the next row (null on a key's last row)."""
    return Step("next", _col(value))


def last_known(value: str | Column) -> Step:
    """The newest non-null value up to and including this row."""
    return Step("last", _col(value))


def next_known(value: str | Column) -> Step:
    """The first non-null value from this row onward."""
    return Step("first", _col(value))


def running_sum(value: str | Column) -> Step:
    return Step("sum", _col(value))


def running_max(value: str | Column) -> Step:
    return Step("max", _col(value))


def max_before(value: str | Column) -> Step:
    """Maximum over the rows strictly before this one (null on a key's first row)."""
    return Step("bmax", _col(value))


def running_min(value: str | Column) -> Step:
    return Step("min", _col(value))


def remaining_max(value: str | Column) -> Step:
    """Maximum from this row to the end of the key."""
    return Step("rmax", _col(value))


def remaining_min(value: str | Column) -> Step:
    return Step("rmin", _col(value))


def total(value: str | Column) -> Step:
    """Sum over the whole key, repeated on every row."""
    return Step("total", _col(value))


def position() -> Step:
    """1-based row number inside the key."""
    return Step("sum", F.lit(1).cast("long"))


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def chunk_of(df: DataFrame, order: str, width: float | None) -> Column:
    """Chunk number of the leading order column (a number, date or timestamp)."""
    kind = df.schema[order].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        micros = F.unix_micros(F.col(order).cast("timestamp"))
        return F.floor(micros / F.lit(float(width or 8 * DAY_US)))
    return F.floor(F.col(order) / F.lit(float(width or 4096)))



def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    width: float | None = None,
    *,
    chunk: Column | None = None,
    **steps: Step,
) -> DataFrame:
    """Add one column per step, computed in ``order`` (ascending) within ``keys``.

    ``order`` must identify a row within its key so that the result is
    determined; its first column must not be null. ``chunk`` overrides the
    chunk number and must be non-decreasing along ``order``.
    """
    rows = df.withColumn("_key", F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0)))
    rows = rows.withColumn("_chunk", chunk if chunk is not None else chunk_of(df, order[0], width))
    sort = F.struct(*[F.col(o) for o in order]) if len(order) > 1 else F.col(order[0])
    part = Window.partitionBy("_key", "_chunk").orderBy(*order)
    upto = part.rowsBetween(FIRST, 0)
    # What lies ahead is what was passed in the other direction: a frame that shrinks row by row is counted anew for each row.
    onward = Window.partitionBy("_key", "_chunk").orderBy(*[F.col(o).desc() for o in order]).rowsBetween(FIRST, 0)
    across = Window.partitionBy("_key").orderBy("_chunk")
    earlier, later = across.rowsBetween(FIRST, -1), across.rowsBetween(1, LAST)
    whole = Window.partitionBy("_key")

    local, summary, carry = {}, {}, {}
    final: dict[str, Column] = {}
    for name, (kind, value, _) in steps.items():
        here, sums, over = f"_in_{name}", f"_s_{name}", f"_c_{name}"
        inside, carried = F.col(here), F.col(over)
        boxed = F.struct(value.alias("v")) if value is not None else None
        if kind == "prev":
            local[here] = F.lag(boxed).over(part)
            summary[sums] = F.max_by(boxed, sort)
            carry[over] = F.last(F.col(sums), ignorenulls=True).over(earlier)
            final[name] = F.coalesce(inside, carried)["v"]
        elif kind == "next":
            local[here] = F.lead(boxed).over(part)
            summary[sums] = F.min_by(boxed, sort)
            carry[over] = F.first(F.col(sums), ignorenulls=True).over(later)
            final[name] = F.coalesce(inside, carried)["v"]
        elif kind == "last":
            local[here] = F.last(value, ignorenulls=True).over(upto)
            summary[sums] = F.max_by(value, F.when(value.isNotNull(), sort))
            carry[over] = F.last(F.col(sums), ignorenulls=True).over(earlier)
            final[name] = F.coalesce(inside, carried)
        elif kind == "first":
            local[here] = F.last(value, ignorenulls=True).over(onward)
            summary[sums] = F.min_by(value, F.when(value.isNotNull(), sort))
            carry[over] = F.first(F.col(sums), ignorenulls=True).over(later)
            final[name] = F.coalesce(inside, carried)
        elif kind == "sum":
            local[here] = F.sum(value).over(upto)
            summary[sums] = F.sum(value)
            carry[over] = F.sum(F.col(sums)).over(earlier)
            final[name] = F.when(inside.isNull() & carried.isNull(), F.lit(None)).otherwise(
                F.coalesce(inside, F.lit(0)) + F.coalesce(carried, F.lit(0))
            )
        elif kind == "bmax":
            local[here] = F.max(value).over(part.rowsBetween(FIRST, -1))
            summary[sums] = F.max(value)
            carry[over] = F.max(F.col(sums)).over(earlier)
            final[name] = F.greatest(inside, carried)
        elif kind == "total":
            summary[sums] = F.sum(value)
            carry[over] = F.sum(F.col(sums)).over(whole)
            final[name] = carried
        else:
            forward = kind in ("max", "min")
            fold = F.max if kind.endswith("max") else F.min
            pick = F.greatest if kind.endswith("max") else F.least
            local[here] = fold(value).over(upto if forward else onward)
            summary[sums] = fold(value)
            carry[over] = fold(F.col(sums)).over(earlier if forward else later)
            final[name] = pick(inside, carried)

    chunks = rows.groupBy("_key", "_chunk").agg(*[c.alias(n) for n, c in summary.items()])
    carried_rows = chunks.select("_key", "_chunk", *[c.alias(n) for n, c in carry.items()])
    placed = rows.select("*", *[c.alias(n) for n, c in local.items()])
    joined = placed.join(carried_rows, ["_key", "_chunk"])
    kept = [c for c in df.columns if c not in steps]
    return joined.select(*kept, *[c.alias(n) for n, c in final.items()])


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    facts: list[str],
    opens: Callable[[Column, Column], Column],
    width: float | None = None,
    label: str = "island",
) -> DataFrame:
    """Label runs of rows by the order columns of the row that opens them.

    ``opens(before, row)`` says whether a row starts a run, from the ``facts``
    of the row before and its own. Runs may cross chunks: inside a chunk the
    rule is a window; between chunks it is judged on first and last rows only.
    """
    rows = df.withColumns(
        {"_key": F.struct(*keys) if keys else F.struct(F.lit(0)), "_chunk": chunk_of(df, order[0], width), "_at": F.struct(*order), "_fact": F.struct(*facts)}
    )
    part = Window.partitionBy("_key", "_chunk").orderBy(*order)
    stepped = rows.withColumn("_b", F.lag("_fact").over(part))
    opened = stepped.withColumn("_o", F.when(F.col("_b").isNotNull() & opens(F.col("_b"), F.col("_fact")), F.col("_at")))
    placed = opened.withColumn("_in", F.last("_o", ignorenulls=True).over(part.rowsBetween(FIRST, 0)))
    chunks = opened.groupBy("_key", "_chunk").agg(
        F.min_by(F.struct("_at", "_fact"), "_at").alias("_first"), F.max_by("_fact", "_at").alias("_last"), F.max("_o").alias("_top")
    )
    across = Window.partitionBy("_key").orderBy("_chunk")
    before = F.lag("_last").over(across)
    joined = chunks.withColumn("_entry", F.when(before.isNull() | opens(before, F.col("_first._fact")), F.col("_first._at")))
    carried = joined.select(
        "_key", "_chunk",
        F.coalesce("_entry", F.last(F.coalesce("_top", "_entry"), ignorenulls=True).over(across.rowsBetween(FIRST, -1))).alias("_from"),
    )
    return placed.join(carried, ["_key", "_chunk"]).select(*df.columns, F.coalesce("_in", "_from").alias(label))


def walk(df: DataFrame, group: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """One ordered pass over each group with a state of fixed size.

    ``fold()`` gives a fresh pair ``(row, end)`` for a group: ``row(values)`` takes the
    tuple of a row's columns, ``end()`` closes the group, and both return the rows to
    emit. Rows stream past, so memory does not follow the size of a group.
    """
    import pandas as pd

    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    own = [df.columns.index(g) for g in group]

    def run(batches):
        now, row, end = None, None, list
        for pdf in batches:
            out = []
            for values in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                at = tuple(values[i] for i in own)
                if at != now:
                    out += end()
                    now, (row, end) = at, fold()
                out += row(values)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(end(), columns=names)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; Catalyst limits each map task to ``k`` before the shuffle."""
    spot = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, spot.cast("long")).where(F.col(rank) <= k)
