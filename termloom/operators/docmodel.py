"""Document model operators: text views of blocks, flattening, routing, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import runs_markdown, runs_text, strip

NUMBER_PREFIX = r"^(\d+(?:\.\d+)*[\.\)]\s*)"
LIST_MARKER = r"^\s*(\d+[\).])\s*"
NOTE_MARKER = r"‹FN(\d+)›"


def block_text(blocks: DataFrame) -> DataFrame:
    """Adds plain (text of the runs, or the text column) and markdown."""
    has = F.col("runs").isNotNull()
    return blocks.withColumn("plain", F.when(has, runs_text(F.col("runs"))).otherwise(F.col("text"))).withColumn("markdown", F.when(has, runs_markdown(F.col("runs"))).otherwise(F.col("text")))


def flat_texts(blocks: DataFrame, notes: bool = True, headings: bool = True) -> DataFrame:
    """(doc_id, pos, part): texts of a document in order; list items as title, space, body; tables, images, separators never."""
    kinds = ["body", "list_item", *(["heading"] if headings else []), *(["footnote", "comment"] if notes else [])]
    part = F.when(F.col("kind") == "list_item", F.concat_ws(" ", "title", "plain")).otherwise(F.col("plain"))
    return block_text(blocks.where(F.col("kind").isin(kinds))).select("doc_id", "pos", part.alias("part"))


def consolidate_rows(rows: DataFrame, key: str, pos: str, formats: list[str], text: str) -> DataFrame:
    """Run consolidation in exploded form: islands of equal formats by pos become one row, texts joined in order."""
    w = Window.partitionBy(key).orderBy(pos)
    new = F.lit(False)
    for c in formats:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    island = F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(new.cast("int"))).over(w)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), "")
    return rows.withColumn("run", island).groupBy(key, "run", *formats).agg(joined.alias("text"), F.count(F.lit(1)).alias("n"))


def split_number(text: Column) -> tuple[Column, Column]:
    """(number prefix, rest) of a heading; the prefix stays out of translation and is put back before it."""
    prefix = F.regexp_extract(text, NUMBER_PREFIX, 1)
    return prefix, F.substring(text, F.length(prefix) + 1, F.length(text))


def repaired_marker(source: Column, translated: Column) -> Column:
    """A translated list title gets the source's number marker back where it lost it."""
    marker = F.regexp_extract(source, LIST_MARKER, 1)
    lost = (marker != "") & ~translated.rlike(LIST_MARKER)
    return F.when(lost, F.concat(marker, F.lit(" "), F.regexp_replace(translated, r"(?U)^\s+", ""))).otherwise(translated)


def routed(blocks: DataFrame) -> DataFrame:
    """Adds route: heading, list_item, marked (body with note markers), body, footnote, comment, table or none."""
    b = block_text(blocks)
    route = F.when((F.col("kind") == "body") & F.col("markdown").rlike(NOTE_MARKER), "marked").when(F.col("kind").isin("heading", "list_item", "body", "footnote", "comment"), F.col("kind")).when(F.col("kind") == "table_ref", "table").otherwise("none")
    return b.withColumn("route", route)


def doc_stats(blocks: DataFrame) -> DataFrame:
    """Counts by kind and chars_in: characters of body text, of list titles and bodies, and of headings."""
    b = block_text(blocks)
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}")
    length = F.when(F.col("kind").isin("body", "heading"), F.length("plain")).when(F.col("kind") == "list_item", F.length(F.coalesce("title", F.lit(""))) + F.length("plain")).otherwise(0)
    return b.groupBy("doc_id").agg(*[n(k) for k in ("heading", "body", "list_item", "footnote", "comment", "image", "table_ref")], F.sum(length).alias("chars_in"))


def nonblank(blocks: DataFrame) -> DataFrame:
    return blocks.where(strip(F.col("plain")) != "")
