"""Where results go: tables, markdown documents, glossary files, logs, snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").parquet(path)


def markdown_documents(blocks: DataFrame, text: str = "markdown") -> DataFrame:
    """(doc_id, content): documents as markdown in order; headings up to level 4, tables as [TABLE n] lines."""
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(4))), F.lit(" "), F.col(text)))
        .when(F.col("kind") == "table_ref", F.concat(F.lit("[TABLE "), F.col("table_index").cast("string"), F.lit("]")))
        .when(F.col("kind") == "list_item", F.concat(F.lit("- *"), F.coalesce("title", F.lit("")), F.lit("*"), F.coalesce("separator", F.lit(" ")), F.col(text)))
        .when(F.col("kind").isin("body", "separator"), F.coalesce(F.col(text), F.col("text")))
    )
    parts = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct("pos", line.alias("line")))))
    return blocks.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n").alias("content"))


def padded_cells(cells: DataFrame, text: str = "translated") -> DataFrame:
    """(doc_id, table_idx, row_idx, cells): rows padded with blanks to their table's width."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("col_idx", F.col(text).alias("t")))), lambda c: c["t"])
    rows = cells.groupBy("doc_id", "table_idx", "row_idx").agg(row.alias("cells"))
    wide = rows.groupBy("doc_id", "table_idx").agg(F.max(F.size("cells")).alias("_n"))
    return rows.join(wide, ["doc_id", "table_idx"]).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("_n") - F.size("cells")))).drop("_n")


def notes_table(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """Footnotes: marker, original, translation."""
    return blocks.where("kind = 'footnote'").join(translated, ["doc_id", "pos"]).select("doc_id", "pos", "marker", F.col("text").alias("original"), "translated")


def comments_table(blocks: DataFrame, translated: DataFrame) -> DataFrame:
    """Comments: author, date, original and translation; the anchor as it is."""
    return blocks.where("kind = 'comment'").join(translated, ["doc_id", "pos"]).select("doc_id", "pos", "comment.author", "comment.date", "comment.anchor", F.col("text").alias("original"), "translated")


def append_log(spark: SparkSession, path: str, record: dict) -> None:
    """One line of the run log: timestamp, input, output, glossary, phases, model."""
    import json

    spark.createDataFrame([(json.dumps(record, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("append").text(path)


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    """A small text file (a glossary) as the one part of a folder, in order."""
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def snapshot(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Writes a stage's table under folder, if one is given, and goes on from what was written."""
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def append_report(report: DataFrame, path: str) -> int:
    """Appends the findings of a check to a log folder; returns how many there are."""
    from pyspark.sql import Observation

    seen = Observation()  # counted while they are written: counting first would run the check twice
    counted = report.observe(seen, F.count(F.lit(1)).alias("n"))
    counted.withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("append").json(path)
    return seen.get["n"]


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files of a folder that executors share; returns how many. A file appears whole or not
    at all, and a task that runs again writes the same file again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                store.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    return files.select("name", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def listed(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder's files whose names fit the pattern."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hpath)
    return [str(f.getPath()) for f in found or []]


def delete_file(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder if it is there."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)
