"""Run a streaming DataFrame over what is there now and read its output back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cutlake.session import shared_folder


def drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Process all available input and return the rows written, with the batch that wrote them.

    Each micro-batch overwrites its own ``batch=<id>`` partition, so a batch
    repeated after a failure leaves no second copy.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(f"{_ddl(stream)}, batch BIGINT").option("basePath", out).parquet(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
