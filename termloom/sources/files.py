"""Where documents come from: folders of files, tables of texts and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text, plain_run, squash
from ..schema import BLOCKS

SUFFIXES = (".docx", ".pdf")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """binaryFile rows of the .docx and .pdf files right in a folder, whatever the case of the suffix. No order: one by path
    would move the contents; order_by_path() gives it for names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", False).option("pathGlobFilter", "*.{[dD][oO][cC][xX],[pP][dD][fF]}").load(path)
    return files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(F.col("suffix").isin(*SUFFIXES))


def by_path(files: DataFrame) -> DataFrame:
    """The files' names and sizes in order of path, without their contents, which stay unread."""
    return files.select("path", "suffix", "length").orderBy("path")


def extracted(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, cells, failures) by suffix. failures (path, error) lists the files that give no blocks; none of them ends a run.

    keep writes a table down and reads it back: every file is then read and parsed once.
    """
    from ..plans.pdf_documents import document_blocks
    from .docx import parsed, parsed_blocks, parsed_cells, parsed_failures, parsed_numbers, with_numbers

    words = keep(parsed(files.where("suffix = '.docx'")))
    blocks, cells, bad = document_blocks(files.where("suffix = '.pdf'"), keep)
    own = with_numbers(parsed_blocks(words), parsed_numbers(words))
    return own.unionByName(blocks), parsed_cells(words).unionByName(cells), parsed_failures(words).unionByName(bad)


def _as_blocks(rows: DataFrame, kind: Column, level: Column, text: Column, title: Column) -> DataFrame:
    empty = {"marker": "string", "text": "string", "comment": "struct<id:string,author:string,date:string,anchor:string>", "image": "binary", "width_inches": "double", "table_index": "int"}
    out = rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("int").alias("pos"), kind.alias("kind"), level.cast("int").alias("level"), plain_run(text).alias("runs"), title.alias("title"), F.when(kind == "list_item", F.lit(" ")).alias("separator"), *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    return out.select(*[c.split()[0] for c in BLOCKS.split(", ") if c.split()[0] in out.columns])


def line_blocks(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A text's non-blank lines as body blocks, in order."""
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).where(has_text(F.col("line")))
    return _as_blocks(lines, F.lit("body"), F.lit(None), F.col("line"), F.lit(None).cast("string"))


#: The elements of a page that become blocks.
PAGE_BLOCK = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|article|ul|ol|nav|footer|body|html|div)\b|$)"


def page_parts(pages: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, part): a page's headings, paragraphs and list items with text, without markup, in order."""
    parts = F.arrays_zip(F.regexp_extract_all("html", F.lit(PAGE_BLOCK), 1).alias("tag"), F.regexp_extract_all("html", F.lit(PAGE_BLOCK), 2).alias("part"))
    x = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(parts).alias("pos", "p")).select("doc_id", "pos", F.lower("p.tag").alias("tag"), squash(F.regexp_replace("p.part", "(?s)<[^>]*>", "")).alias("part"))
    return x.where("part <> ''")


def page_blocks(pages: DataFrame) -> DataFrame:
    kind = F.when(F.col("tag").startswith("h"), "heading").when(F.col("tag") == "li", "list_item").otherwise("body")
    level = F.when(F.col("tag").startswith("h"), F.substring("tag", 2, 1))
    return _as_blocks(page_parts(pages), kind, level, F.col("part"), F.when(kind == "list_item", F.lit("")))
