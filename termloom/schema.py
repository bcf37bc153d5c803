"""Tables of the document model. Position is explicit everywhere: Spark keeps no list order."""

from __future__ import annotations

from .functions.text import RUN

BLOCKS = f"doc_id string, pos int, kind string, level int, runs array<{RUN}>, title string, separator string, marker string, text string, comment struct<id:string,author:string,date:string,anchor:string>, image binary, width_inches double, table_index int"
TABLE_CELLS = "doc_id string, table_idx int, row_idx int, col_idx int, text string"
SPANS = "doc_id string, page int, block int, line int, span int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double"
ENTRIES = "entry_idx int, source_terms array<string>, target string, target_alts array<string>, kind string, note string, origin string, source string, alt_versions array<struct<label:string,target:string>>"
#: Kinds of blocks and of glossary entries.
BLOCK_KINDS = ("heading", "body", "list_item", "footnote", "comment", "image", "table_ref", "separator")
ENTRY_KINDS = ("require", "verbatim", "prefer")
