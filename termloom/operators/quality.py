"""Structural quality checks between a source and an output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .docmodel import block_text

TABLE_LINE = r"^\s*\[TABLE\s+\d+\]\s*$"
NUMBERED = r"^\s*\d+(?:\.\d+)*[\.\)]\s"
LOW, HIGH = 0.3, 3.0


def is_table_line() -> Column:
    """Whether plain is a rendered table; most texts lack its first letters and need not be put together for that."""
    raw = F.coalesce(F.array_join(F.transform("runs", lambda r: r["text"]), ""), F.col("text"))
    return F.contains(raw, F.lit("[TABLE")) & F.col("plain").rlike(TABLE_LINE)


def counted(blocks: DataFrame) -> DataFrame:
    """(doc_id, what, n) for headings, body (without rendered table lines), lists, tables and footnotes; zeros included."""
    b = block_text(blocks)
    table_line = (F.col("kind") == "body") & is_table_line()
    what = F.when(F.col("kind") == "heading", "headings").when(table_line | (F.col("kind") == "table_ref"), "tables").when(F.col("kind") == "body", "body").when(F.col("kind") == "list_item", "lists").when(F.col("kind") == "footnote", "footnotes")
    kinds = F.explode(F.array(*map(F.lit, ("headings", "body", "lists", "tables", "footnotes"))))
    every = b.select("doc_id").distinct().select("doc_id", kinds.alias("what"))
    n = b.select("doc_id", what.alias("what")).where("what is not null").groupBy("doc_id", "what").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["doc_id", "what"], "left").fillna(0, ["n"])


def count_diff(source: DataFrame, output: DataFrame) -> DataFrame:
    """Kinds (headings, body and tables only) whose counts differ."""
    s, o = counted(source).withColumnRenamed("n", "n_source"), counted(output).withColumnRenamed("n", "n_output")
    both = s.join(o, ["doc_id", "what"], "full").fillna(0, ["n_source", "n_output"])
    return both.where(F.col("what").isin("headings", "body", "tables") & (F.col("n_source") != F.col("n_output")))


def zipped(source: DataFrame, output: DataFrame, text: str = "plain") -> DataFrame:
    """Pairs of the i-th rows (from 1) of either side within a document; the longer side's rest goes."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    side = lambda d, name: d.select("doc_id", F.row_number().over(w).alias("ordinal"), F.col(text).alias(name))
    return side(source, "source").join(side(output, "output"), ["doc_id", "ordinal"])


def lost_numbers(source: DataFrame, output: DataFrame) -> DataFrame:
    """Headings whose number prefix is gone."""
    h = lambda b: block_text(b).where("kind = 'heading'")
    return zipped(h(source), h(output)).where(F.col("source").rlike(NUMBERED) & ~F.col("output").rlike(NUMBERED))


def ratio_outliers(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose output is under 0.3 or over 3 times as long as a source of at least `least` characters. pairs: n_source, n_output."""
    r = pairs.where(F.col("n_source") >= least)
    return r.withColumn("ratio", F.col("n_output") / F.col("n_source")).where((F.col("ratio") < LOW) | (F.col("ratio") > HIGH))


def body_ratios(source: DataFrame, output: DataFrame) -> DataFrame:
    body = lambda b: block_text(b).where((F.col("kind") == "body") & ~is_table_line()).select("doc_id", "pos", F.length("plain").alias("n"))
    # lengths meet, the texts stay where they are
    return ratio_outliers(zipped(body(source), body(output), "n").withColumnsRenamed({"source": "n_source", "output": "n_output"}), 20)


def cell_ratios(source: DataFrame, output: DataFrame) -> DataFrame:
    keys = ["doc_id", "table_idx", "row_idx", "col_idx"]
    pairs = source.select(*keys, F.length(strip(F.col("text"))).alias("n_source")).join(output.select(*keys, F.length(strip(F.col("text"))).alias("n_output")), keys)
    return ratio_outliers(pairs, 10)


def report(source: DataFrame, output: DataFrame, source_cells: DataFrame | None = None, output_cells: DataFrame | None = None) -> DataFrame:
    """(doc_id, check, place, message) of all checks."""
    rows = [
        count_diff(source, output).select("doc_id", F.lit("count").alias("check"), F.col("what").alias("place"), F.format_string("%s count mismatch: source=%d, output=%d", "what", "n_source", "n_output").alias("message")),
        lost_numbers(source, output).select("doc_id", F.lit("number"), F.col("ordinal").cast("string"), F.format_string("heading #%d lost its number prefix: %s", "ordinal", F.substring("source", 1, 60))),
        body_ratios(source, output).select("doc_id", F.lit("body"), F.col("ordinal").cast("string"), F.format_string("paragraph #%d length ratio %.2f", "ordinal", "ratio")),
    ]
    if source_cells is not None and output_cells is not None:
        rows.append(cell_ratios(source_cells, output_cells).select("doc_id", F.lit("cell"), F.concat_ws("/", "table_idx", "row_idx", "col_idx"), F.format_string("cell length ratio %.2f", "ratio")))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
