"""Keys of a stream dealt to buckets, so that one Python call and a few state accesses serve many keys.

A call, a timer and each access of state cost a fixed time, whatever they carry: with one
group per key a stream of many short keys spends all of it there. A bucket's state is
one Arrow block; each micro-batch rewrites the blocks of the buckets it touches.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
BUCKET = "_bucket"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def dealt(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the bucket of their key; rows without a key share one of their own."""
    return rows.withColumn(BUCKET, bucket_of(F.col(key), buckets))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")))


def pack(schema: str, rows: Iterable[tuple]) -> bytes:
    """Rows of the types named in ``schema`` (``name type, ...``) as one Arrow block."""
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    batch = pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(block: bytes | None) -> list[tuple]:
    if block is None:
        return []
    return list(zip(*[c.to_pylist() for c in pa.ipc.open_stream(bytes(block)).read_all().columns]))


def whole(values: pd.Series) -> list:
    """A column as Python values; a null is None and leaves whole numbers whole."""
    if values.dtype.kind == "f":
        return [None if v != v else int(v) for v in values.tolist()]
    return [None if v is pd.NA else v for v in values.tolist()]


def micros(values: pd.Series) -> list[int]:
    return values.astype("datetime64[us]").astype("int64").tolist()
