"""The batch operators over a growing folder: each micro-batch of a file source goes through one of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import guards
from ..operators.ledger import Ledger
from ..plans.translate import keeper


def incrementally(spark: SparkSession, source: str, schema: str, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Applies operator to the new Parquet files under source and appends to target, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so every file counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def translated_cells(spark: SparkSession, source: str, schema: str, backend: guards.Backend, target: str, checkpoint: str, memo: str, once: bool = True, **options) -> StreamingQuery:
    """Table cells that arrive in a folder, translated batch by batch, with a memo over all batches.

    The memo is a ledger in a shared folder: each distinct call of a batch is looked up there and asked for only if no
    earlier batch, run or lost task had it answered, so it outlives restarts, and a cell that fills a third of a batch
    is one row of the lookup. The batch's number of distinct calls is all that is sent over the network for it.
    """
    ledger, keep = Ledger(memo), keeper(spark)

    def operator(cells: DataFrame) -> DataFrame:
        told = lambda d: guards.guarded_translation(d, "cell_key", "text", backend, keep, ledger=ledger, **options).select("cell_key", "translated")
        return guards.translated_cells(cells, told, guards.cell_retry(backend, ledger=ledger, **options), keep)

    return incrementally(spark, source, schema, operator, target, checkpoint, once)
