"""Layout inference on PDF span tables: fonts, lines, paragraphs, classes, folding and stitching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import RUN, consolidated, runs_text, strip, stripped_length

#: Thresholds and patterns of the layout rules.
NOTE_SHARE, ZONE_SHARE, SPLIT_GAP, SIZE_STEP, DEFAULT_HEIGHT = 0.85, 0.6, 0.7, 0.5, 10.0
ROMAN_HEAD = r"^[IVXLCDM]+\.\s*\S"
ROMAN_ONLY = r"^[IVXLCDM]+\.$"
NUMBERED_ITEM = r"^\d+\)\s+\S"
LONE_MARKER = r"^(?:[*†‡§¶]+|\d+)$"
RULE_LINE = r"^[_\-–—=]{3,}$"
PAGE_NUMBER = r"^-?\s*\d+\s*-?$"
NOTE_START = r"^(\d+|[*†‡§¶])\s+"


def styled(spans: DataFrame) -> DataFrame:
    """Adds bold and italic, from the flags (bits 4 and 1) or the font's name, and the size rounded to tenths."""
    font = F.lower(F.coalesce("font", F.lit("")))
    bold = (F.col("flags").bitwiseAND(16) != 0) | font.rlike("bold|heavy|black")
    italic = (F.col("flags").bitwiseAND(2) != 0) | font.rlike("italic|oblique")
    return spans.withColumn("bold", bold).withColumn("italic", italic).withColumn("rsize", F.round("size", 1))


def font_stats(spans: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_bold, heading_sizes, n_larger, note_size): the size with most characters is the body's.

    Of sizes with equally many the one seen first counts. heading_sizes are up to four larger sizes, largest first.
    """
    s = styled(spans).withColumn("n", F.length(strip(F.col("text")))).where("n > 0")
    by = s.groupBy("doc_id", "rsize").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("n_bold"), F.min(F.struct("page", "block", "line", "span")).alias("seen"))
    w = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), F.col("seen"))
    top = by.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("doc_id", F.col("rsize").alias("body_size"), (F.col("n_bold") > F.col("n") / 2).alias("body_bold"))
    larger = by.select("doc_id", "rsize").join(top, "doc_id").where(F.col("rsize") > F.col("body_size")).groupBy("doc_id").agg(F.sort_array(F.collect_set("rsize"), asc=False).alias("larger"))
    none = F.array().cast("array<double>")
    out = top.join(larger, "doc_id", "left").withColumn("larger", F.coalesce("larger", none))
    return out.select("doc_id", "body_size", "body_bold", F.slice("larger", 1, 4).alias("heading_sizes"), F.size("larger").alias("n_larger"), (F.col("body_size") * NOTE_SHARE).alias("note_size"))


def lines_of(spans: DataFrame) -> DataFrame:
    """(doc_id, page, block, line, runs, marker, y0, y1) of lines with text.

    The first span of a block's first line is a marker, not text, if it is short and under 0.8 of the next span's size.
    """
    s = styled(spans).where("text <> ''")
    w = Window.partitionBy("doc_id", "page", "block", "line").orderBy("span")
    first_line = F.col("line") == F.min("line").over(Window.partitionBy("doc_id", "page", "block"))
    peel = first_line & (F.row_number().over(w) == 1) & (F.length(strip(F.col("text"))) <= 4) & (F.col("size") < F.lead("size").over(w) * 0.8)
    s = s.withColumn("peel", F.coalesce(peel, F.lit(False)))
    run = F.struct("span", F.struct("text", "bold", "italic", F.col("rsize").alias("size")).alias("run"))
    out = s.groupBy("doc_id", "page", "block", "line").agg(F.array_sort(F.collect_list(F.when(~F.col("peel"), run))).alias("r"), F.max(F.when(F.col("peel"), strip(F.col("text")))).alias("marker"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    out = out.withColumn("runs", F.transform("r", lambda x: x["run"])).drop("r")
    return out.where(F.exists("runs", lambda r: stripped_length(r) > 0))


def upper_median(value: str, *keys: str) -> Column:
    """The middle of the sorted values of the rows with equal keys, the upper one of two; null without a value."""
    return F.expr(f"percentile_disc(0.5) within group (order by {value} desc) over (partition by {', '.join(keys)})")


def islands(lines: DataFrame) -> DataFrame:
    """lines with para, the number of their paragraph within the block.

    A line begins a paragraph after a gap over 0.7 of the block's median height, on a change of size over 0.5 or of
    boldness, between two bold lines, before a bold Roman header and before an item like 3).
    """
    block = Window.partitionBy("doc_id", "page", "block")
    w = block.orderBy("line")
    filled = F.filter("runs", lambda r: stripped_length(r) > 0)
    x = lines.withColumn("_size", F.coalesce(F.array_max(F.transform(filled, lambda r: r["size"])), F.lit(0.0))).withColumn("_bold", F.exists(filled, lambda r: r["bold"])).withColumn("_text", runs_text(F.col("runs")))
    height = F.coalesce(upper_median("if(y1 > y0, y1 - y0, null)", "doc_id", "page", "block"), F.lit(DEFAULT_HEIGHT))
    was = lambda c: F.lag(c).over(w)
    split = (F.col("y0") - was("y1") > height * SPLIT_GAP) | (F.abs(F.col("_size") - was("_size")) > SIZE_STEP) | (F.col("_bold") != was("_bold")) | (F.col("_bold") & was("_bold")) | (F.col("_bold") & F.col("_text").rlike(ROMAN_HEAD)) | F.col("_text").rlike(NUMBERED_ITEM)
    x = x.withColumn("_split", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(split, F.lit(False)).cast("int")))
    return x.withColumn("para", F.sum("_split").over(w)).drop("_size", "_bold", "_text", "_split")


def paragraphs(lines: DataFrame) -> DataFrame:
    """One row a paragraph: runs of its lines joined by a space in the format before it, y0, y1 and the first line's marker."""
    x = islands(lines)
    row = F.struct("line", "runs", "marker", "y0", "y1")
    g = x.groupBy("doc_id", "page", "block", "para").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    space = lambda rs: F.array(F.struct(F.lit(" ").alias("text"), F.element_at(rs, -1)["bold"].alias("bold"), F.element_at(rs, -1)["italic"].alias("italic"), F.element_at(rs, -1)["size"].alias("size")))
    joined = F.aggregate("rows", F.array().cast(f"array<{RUN}>"), lambda acc, r: F.when(F.size(acc) > 0, F.concat(acc, space(acc), r["runs"])).otherwise(r["runs"]))
    first = F.element_at("rows", 1)
    g = g.withColumn("runs", consolidated(joined)).withColumn("marker", first["marker"]).withColumn("y0", first["y0"]).withColumn("y1", F.element_at("rows", -1)["y1"])
    return g.select("doc_id", "page", "block", "para", "runs", "marker", "y0", "y1").where(runs_text(F.col("runs")) != "")


def dominant_size(runs: Column) -> Column:
    """The size with most stripped characters; of equals the one seen first."""
    sizes = F.array_distinct(F.transform(runs, lambda r: r["size"]))
    weight = lambda s: F.aggregate(F.filter(runs, lambda r: r["size"] == s), F.lit(0), lambda a, r: a + stripped_length(r))
    ranked = F.transform(sizes, lambda s, i: F.struct(weight(s).alias("n"), (-i).alias("i"), s.alias("size")))
    return F.array_max(ranked)["size"]


def is_mostly_bold(runs: Column) -> Column:
    n = lambda keep: F.aggregate(F.filter(runs, keep), F.lit(0), lambda a, r: a + stripped_length(r))
    return n(lambda r: r["bold"]) * 2 > n(lambda r: F.lit(True))


def split_item(runs: list, text_of=lambda r: r["text"]) -> tuple[str, str, dict, str] | None:
    """(title, body, format of the body's first run, separator) of an italic title followed by a plain body, else None.

    Short non-italic runs (up to four characters each) may stand before the title. A colon moves to the title; a dash
    between them becomes the separator. Titles under 8 and bodies under 10 characters do not count.
    """
    import re

    k = 0
    while k < len(runs) and not runs[k]["italic"] and len(text_of(runs[k]).strip()) <= 4:
        k += 1
    j = k
    while j < len(runs) and runs[j]["italic"]:
        j += 1
    if j == k or j == len(runs):
        return None
    title = " ".join("".join(map(text_of, runs[:j])).split())
    body = "".join(map(text_of, runs[j:])).strip()
    lead = next((r for r in runs[j:] if text_of(r).strip()), None)
    if len(title) < 8 or len(body) < 10 or lead is None:
        return None
    dash = re.match(r"[.\s]*([-–—])[.\s]*", body)
    if body[0] == ":" and title[-1] != ":":
        return title.rstrip(" .") + ":", body[1:].lstrip(), lead, " "
    if dash:
        return title.rstrip(". ") + "." * ("." in dash[0]), body[dash.end() :].lstrip(), lead, f" {dash[1]} "
    return title, body, lead, " "


_RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType()), T.StructField("size", T.DoubleType())])


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.ArrayType(_RUN)), T.StructField("separator", T.StringType())]))
def list_items(runs: pd.Series) -> pd.DataFrame:
    out = []
    for rs in runs:
        got = split_item(list(rs)) if rs is not None else None
        out.append((None, None, None) if got is None else (got[0], [{"text": got[1], "bold": got[2]["bold"], "italic": got[2]["italic"], "size": got[2]["size"]}], got[3]))
    return pd.DataFrame(out, columns=["title", "body", "separator"])


def classified(paras: DataFrame, fonts: DataFrame, zones: DataFrame) -> DataFrame:
    """Blocks from paragraphs: separator, then (in the note zone) page number or footnote, heading, list item, body.

    zones (doc_id, page, zone_y) says where a page's notes may start.
    """
    p = paras.join(fonts, "doc_id").join(zones, ["doc_id", "page"])
    p = p.withColumn("plain", runs_text(F.col("runs"))).withColumn("dsize", dominant_size(F.col("runs"))).withColumn("strong", is_mostly_bold(F.col("runs")) & ~F.col("body_bold"))
    level = F.array_position("heading_sizes", F.col("dsize")).cast("int")
    short = F.length("plain") < 120
    bold_level = F.when(F.col("strong") & short & F.col("plain").rlike(ROMAN_HEAD), F.least(F.col("n_larger") + 1, F.lit(3))).when(F.col("strong") & short, F.least(F.col("n_larger") + 1, F.lit(4))).otherwise(0)
    p = p.withColumn("level", F.when(level > 0, level).otherwise(bold_level)).withColumn("item", list_items(F.col("runs")))
    small = (F.col("dsize") < F.col("note_size")) & (F.col("y0") > F.col("zone_y"))
    kind = F.when(F.col("plain").rlike(RULE_LINE), "separator").when(small & F.col("plain").rlike(PAGE_NUMBER), "body").when(small, "footnote").when(F.col("level") > 0, "heading").when(F.col("item.title").isNotNull(), "list_item").otherwise("body")
    p = p.withColumn("kind", kind)
    own = F.regexp_extract("plain", NOTE_START, 1)
    peeled = F.coalesce(F.col("marker"), F.lit("")) != ""
    note = F.col("kind") == "footnote"
    return p.select(
        "doc_id", "page", "block", "para", "y0", "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"),
        F.when(F.col("kind") == "list_item", F.col("item.body")).when(F.col("kind").isin("heading", "body"), F.col("runs")).alias("runs"),
        F.when(F.col("kind") == "list_item", F.col("item.title")).alias("title"), F.when(F.col("kind") == "list_item", F.col("item.separator")).alias("separator"),
        F.when(note, F.when(peeled, F.col("marker")).when(own != "", own).otherwise("*")).alias("marker"),
        F.when(note, F.when(peeled, F.col("plain")).otherwise(F.regexp_replace("plain", NOTE_START, ""))).when(F.col("kind") == "separator", F.col("plain")).alias("text"),
    )


def note_zones(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, zone_y): the first thin rule in the lower three quarters of a page, else 60 % of its height."""
    d = drawings.join(pages, ["doc_id", "page"]).where((F.abs(F.col("y1") - F.col("y0")) < 3) & (F.col("x1") - F.col("x0") > 30) & (F.col("x1") - F.col("x0") < 300) & (F.col("y0") > F.col("height") * 0.25))
    first = d.groupBy("doc_id", "page").agg(F.min_by("y0", "draw_idx").alias("rule_y"))
    return pages.join(first, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("rule_y", F.col("height") * ZONE_SHARE).alias("zone_y"))


def meets(a: str, b: str, grow: float = 0.0) -> Column:
    """Whether the boxes of two aliases overlap, b grown on all sides."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "x0") < c(b, "x1") + grow) & (c(b, "x0") - grow < c(a, "x1")) & (c(a, "y0") < c(b, "y1") + grow) & (c(b, "y0") - grow < c(a, "y1"))


def clear_of(boxes: DataFrame, others: DataFrame, grow: float = 0.0) -> DataFrame:
    """boxes that meet none of the others on their page: an anti join with the page as its equi key."""
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & meets("a", "b", grow)
    return boxes.alias("a").join(others.alias("b"), on, "left_anti")


def image_regions(images: DataFrame, drawings: DataFrame, tables: DataFrame, least: float = 50.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, width_inches): pictures clear of tables, once a rounded box, and the union of ten or
    more drawings on a page if it meets no picture; sides of at least 50 points, width at most six inches."""
    boxes = ["doc_id", "page", "x0", "y0", "x1", "y1"]
    wide = (F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least)
    pics = clear_of(images.where(wide), tables, 5.0).select(*boxes)
    key = [F.round(c).alias(f"_{c}") for c in boxes[2:]]
    pics = pics.select(*boxes, *key).dropDuplicates(["doc_id", "page", "_x0", "_y0", "_x1", "_y1"]).select(*boxes)
    w, h = F.col("x1") - F.col("x0"), F.abs(F.col("y1") - F.col("y0"))
    drawn = clear_of(drawings.where(~((h < 3) & (w > 30)) & ~((w < 3) & (h < 3))), tables, 5.0)
    union = drawn.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).where("n >= 10").where(wide)
    union = clear_of(union, pics).select(*boxes)
    return pics.unionByName(union).withColumn("width_inches", F.least((F.col("x1") - F.col("x0")) / 72.0, F.lit(6.0)))


def assembled(elements: DataFrame) -> DataFrame:
    """Blocks numbered by page, then by y0, then in order of emission."""
    w = Window.partitionBy("doc_id").orderBy("page", "y0", "block", "para")
    return elements.withColumn("pos", F.row_number().over(w) - 1)


def folded_markers(blocks: DataFrame) -> DataFrame:
    """A heading that is only a Roman number joins the next heading, a stub footnote the next footnote: pairs from the left.

    Of a row of neighbours that could fold, those at odd places do: each fold takes the block after it away.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("plain", F.when(F.col("kind") == "footnote", F.col("text")).otherwise(runs_text(F.col("runs"))))
    follows = F.lead("kind").over(w) == F.col("kind")
    could = F.coalesce(follows & (((F.col("kind") == "heading") & F.col("plain").rlike(ROMAN_ONLY)) | ((F.col("kind") == "footnote") & strip(F.col("plain")).rlike(LONE_MARKER))), F.lit(False))
    b = b.withColumn("could", could)
    b = b.withColumn("start", F.sum(F.when(F.col("could") & ~F.coalesce(F.lag("could").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    b = b.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "start", "could").orderBy("pos")))
    b = b.withColumn("folds", F.col("could") & (F.col("nth") % 2 == 1)).withColumn("before", F.lag(F.struct("folds", "plain", "marker")).over(w))
    joined = F.coalesce(F.col("before.folds"), F.lit(False))
    first = F.expr("array_position(transform(runs, r -> length(regexp_replace(r.text, '(?U)^\\\\s+|\\\\s+$', '')) > 0), true)")
    runs = F.transform("runs", lambda r, i: F.when(i + 1 == first, F.struct(F.concat(F.col("before.plain"), F.lit(" "), r["text"]).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["size"].alias("size"))).otherwise(r))
    kept_marker = F.when((F.coalesce(F.col("before.marker"), F.lit("")) != "") & (F.col("before.marker") != "*"), F.col("before.marker")).when(strip(F.col("before.plain")) != "", strip(F.col("before.plain"))).otherwise(F.coalesce("marker", F.lit("*")))
    out = b.withColumn("runs", F.when(joined & (F.col("kind") == "heading"), runs).otherwise(F.col("runs"))).withColumn("marker", F.when(joined & (F.col("kind") == "footnote"), kept_marker).otherwise(F.col("marker")))
    return out.where(~F.col("folds")).drop("plain", "could", "start", "nth", "folds", "before")


def goes_on(before: Column, text: Column) -> Column:
    """Whether text continues before: that does not end in closing punctuation, and text starts lower-case or with ( , ;"""
    tail = F.regexp_replace(before, r"(?U)\s+$", "")
    return F.coalesce((tail != "") & ~tail.rlike("[.!?:;»)”\"]$") & text.rlike(r"^(?:\p{Ll}|[(,;])"), F.lit(False))


def stitched(blocks: DataFrame) -> DataFrame:
    """Body paragraphs that continue the body or list item before them are joined to it by a space.

    The test looks at the last piece's tail and the next one's head only, so islands over lag() do.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("plain", runs_text(F.coalesce("runs", F.array().cast(f"array<{RUN}>"))))
    more = (F.col("kind") == "body") & F.lag("kind").over(w).isin("body", "list_item") & goes_on(F.lag("plain").over(w), F.col("plain"))
    b = b.withColumn("island", F.sum((~F.coalesce(more, F.lit(False))).cast("int")).over(w))
    rest = [c for c in blocks.columns if c not in ("doc_id", "runs")]
    space = lambda rs: F.array(F.struct(F.lit(" ").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.coalesce(F.try_element_at(rs, F.lit(-1))["size"], F.lit(0.0)).alias("size")))
    rows = F.array_sort(F.collect_list(F.struct("pos", "runs")))
    joined = F.aggregate(rows, F.lit(None).cast(f"array<{RUN}>"), lambda acc, r: F.when(acc.isNull(), r["runs"]).otherwise(F.concat(acc, space(acc), r["runs"])))
    g = b.groupBy("doc_id", "island").agg(*[F.min_by(c, "pos").alias(c) for c in rest], joined.alias("runs"), F.count(F.lit(1)).alias("_n"))
    return g.withColumn("runs", F.when(F.col("_n") > 1, consolidated(F.col("runs"))).otherwise(F.col("runs"))).drop("island", "_n").select(*blocks.columns)


def deduped_cells(cells: DataFrame) -> DataFrame:
    """Cells without those equal to their left neighbour, columns numbered anew."""
    w = Window.partitionBy("doc_id", "table_idx", "row_idx").orderBy("col_idx")
    kept = cells.withColumn("_left", F.lag("text").over(w)).where("_left is null or text <> _left").drop("_left")
    return kept.withColumn("col_idx", (F.row_number().over(w) - 1).cast("int"))


def collapsed_table(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """(doc_id, table_idx, row_idx, cells): merged-cell grids squeezed: a row is its non-blank cells in order (a lone blank
    if none), padded to the widest row; columns that are blank in every row go. Grids of one column stay."""
    t = Window.partitionBy("doc_id", "table_idx")
    r = rows.withColumn("_wide", F.max(F.size(cells)).over(t)).withColumn("_full", F.filter(F.col(cells), lambda c: strip(c) != ""))
    head = F.get(F.col(cells), 0)
    trimmed = F.transform("_full", lambda c, i: F.when((i == 0) & (strip(head) != ""), head).otherwise(strip(c)))
    r = r.withColumn("_row", F.when(F.size("_full") > 0, trimmed).otherwise(F.array(F.lit(""))))
    r = r.withColumn("_n", F.max(F.size("_row")).over(t)).withColumn("_row", F.concat("_row", F.array_repeat(F.lit(""), F.col("_n") - F.size("_row"))))
    used = F.max(F.size("_full")).over(t)
    out = F.when(F.col("_wide") <= 1, F.col(cells)).otherwise(F.slice("_row", F.lit(1), F.greatest(F.col("_used"), F.lit(0))))
    return r.withColumn("_used", used).withColumn(cells, out).select("doc_id", "table_idx", "row_idx", cells)
