"""PDF files end to end: from a folder's bytes to blocks and table cells, by the layout operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout, tables
from ..schema import BLOCKS
from ..sources import pdf


def document_blocks(files: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, cells, failures) of the files (path, content).

    keep writes down what several steps read (pages, what they paint, and cells), so that a file is read once; without it they are
    computed for each step. Text that meets a table or picture is left to it.
    """
    pages = keep(pdf.pages(files))
    marks = keep(pdf.marks(pages))
    spans, drawings = pdf.spans(marks), pdf.drawings(marks)
    found = keep(tables.ruled_cells(pdf.rules(marks)))
    boxes = tables.table_boxes(found)
    pictures = picture_blocks(pdf.images(marks), drawings, boxes)
    taken = boxes.drop("table_idx").unionByName(pictures.drop("width_inches", "image"))
    block_boxes = spans.groupBy("doc_id", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    free = layout.clear_of(block_boxes, taken).select("doc_id", "page", "block")
    own = spans.join(free, ["doc_id", "page", "block"], "left_semi")
    zones = layout.note_zones(drawings, pdf.page_sizes(pages))
    paras = layout.classified(layout.paragraphs(layout.lines_of(own)), layout.font_stats(spans), zones)
    paras = paras.select("*", F.lit(None).cast("binary").alias("image"), F.lit(None).cast("double").alias("width_inches"), F.lit(None).cast("int").alias("table_index"))
    none = {c: F.lit(None).cast(t) for c, t in paras.dtypes}
    beside = lambda df, **own: df.select(*[own.get(c, F.col(c) if c in df.columns else none[c]).cast(t).alias(c) for c, t in paras.dtypes])
    last = F.lit(1 << 30)
    held = beside(boxes, kind=F.lit("table_ref"), block=last, para=F.col("table_idx"), table_index=F.col("table_idx"))
    shown = beside(pictures, kind=F.lit("image"), block=last + 1, para=F.lit(0))
    blocks = layout.assembled(paras.unionByName(held).unionByName(shown)).drop("page", "block", "para", "y0")
    blocks = layout.stitched(layout.folded_markers(blocks))
    # markers folded and paragraphs stitched, what is left is numbered anew
    blocks = layout.assembled(blocks.withColumns({"page": F.lit(0), "y0": F.col("pos"), "block": F.lit(0), "para": F.lit(0)}).drop("pos"))
    kinds = dict(p.split(" ", 1) for p in _columns(BLOCKS))
    blocks = blocks.select(*[(F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    rows = layout.collapsed_table(tables.cell_texts(found, marks.where("kind = 'text'")))
    cells = rows.select("doc_id", "table_idx", "row_idx", F.posexplode("cells").alias("col_idx", "text"))
    return blocks, cells, pdf.failures(pages)


def picture_blocks(images: DataFrame, drawings: DataFrame, tables_: DataFrame) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, width_inches, image) of a page's picture regions; regions of drawings have no bytes."""
    near = {f"_{c}": F.round(c) for c in ("x0", "y0", "x1", "y1")}
    on = ["doc_id", "page", *near]
    own = images.withColumns(near).select(*on, "image").dropDuplicates(on)
    return layout.image_regions(images, drawings, tables_).withColumns(near).join(own, on, "left").drop(*near)


def _columns(schema: str) -> list[str]:
    """The columns of a schema text, those of structs left whole."""
    out, depth, own = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return out
