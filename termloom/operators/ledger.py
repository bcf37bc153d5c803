"""A ledger of model calls: an answer is on file before it is used, so what was answered once is not asked again."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One model call: everything that its answer depends on.
Call = Callable[[list[str], list[str], list[int], float, int], list[str]]


def call_id(prompt: Column, text: Column, budget: Column, temperature: float, seed: int, model: str) -> Column:
    """The hash of all that an answer depends on; of lengths too, so that no two calls run into one text."""
    parts = [F.coalesce(prompt, F.lit("")), F.coalesce(text, F.lit("")), budget.cast("string"), F.lit(str(temperature)), F.lit(str(seed)), F.lit(model)]
    return F.sha2(F.concat_ws("\0", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)


@dataclass(frozen=True)
class Ledger:
    """Answers in a folder that the driver and all executors share, in buckets by the first hex digits of the call's hash.

    Equal calls are made once. A task writes a file after so many answers, complete or not at all (renamed into place),
    and a task that is run again first reads what the run has written in its bucket. So only calls whose file was not
    written yet are made twice: at most `every` a lost task. A second copy that runs beside the first (speculation) sees
    what was written when it comes to the bucket, and can repeat the bucket's later calls. A run that is started again
    anti-joins all that earlier runs have answered. No answer (null) is not written down. Of two answers to one call,
    which two runs at a time or two copies of a task can give, the smaller counts, for all its rows alike.
    """

    folder: str
    every: int = 16
    digits: int = 2

    def answers(self, spark: SparkSession) -> DataFrame:
        """(call, answer), one row a call."""
        where, path = fs.FileSystem.from_uri(self.folder)
        where.create_dir(path, recursive=True)
        every = spark.read.schema("call string, answer string, bucket string").option("basePath", self.folder).parquet(self.folder)
        return every.groupBy("call").agg(F.min("answer").alias("answer"))

    def answered(self, rows: DataFrame, model: Call, out: str, temperature: float, seed: int, name: str = "") -> DataFrame:
        """rows (prompt, masked, budget and others) with the answer to each in a new column; null without one."""
        spark = rows.sparkSession
        keyed = rows.withColumn("_call", call_id(F.col("prompt"), F.col("masked"), F.col("budget"), temperature, seed, name))
        asked = keyed.select("_call", "prompt", "masked", "budget").dropDuplicates(["_call"])
        asked = asked.join(self.answers(spark), F.col("_call") == F.col("call"), "left_anti").withColumn("_bucket", F.substring("_call", 1, self.digits))
        asked = asked.repartition(16**self.digits, "_bucket").sortWithinPartitions("_bucket", "_call")
        asked.mapInPandas(self._task(model, uuid.uuid4().hex, temperature, seed), "n long").agg(F.sum("n")).collect()
        told = self.answers(spark).select(F.col("call").alias("_call"), F.col("answer").alias(out))
        return keyed.join(told, "_call", "left").drop("_call")

    def _task(self, model: Call, run: str, temperature: float, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            where, root = fs.FileSystem.from_uri(self.folder)
            here, known = None, set()
            for pdf in batches:
                for bucket, part in pdf.groupby("_bucket", sort=False):
                    path = f"{root}/bucket={bucket}"
                    if bucket != here:
                        here, known = bucket, _written(where, path, run)
                    todo = part[~part["_call"].isin(known)]
                    for at in range(0, len(todo), self.every):
                        few = todo.iloc[at : at + self.every]
                        got = model(list(few["prompt"]), list(few["masked"]), [int(n) for n in few["budget"]], temperature, seed)
                        _write(where, path, run, [(c, a) for c, a in zip(few["_call"], got, strict=True) if a is not None])
                yield pd.DataFrame({"n": [len(pdf)]})

        return task


def _written(where: fs.FileSystem, path: str, run: str) -> set[str]:
    """The calls that this run has written in a bucket."""
    files = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    mine = [f.path for f in files if f.base_name.startswith(run) and f.base_name.endswith(".parquet")]
    return {c for f in mine for c in pq.read_table(f, columns=["call"], filesystem=where, partitioning=None)["call"].to_pylist()}


def _write(where: fs.FileSystem, path: str, run: str, rows: list[tuple[str, str]]) -> None:
    if not rows:
        return
    calls, answers = zip(*rows, strict=True)
    where.create_dir(path, recursive=True)
    name = f"{run}-{uuid.uuid4().hex}.parquet"
    # Spark passes over names that begin with an underscore
    pq.write_table(pa.table({"call": pa.array(calls, pa.string()), "answer": pa.array(answers, pa.string())}), f"{path}/_{name}", filesystem=where)
    where.move(f"{path}/_{name}", f"{path}/{name}")
