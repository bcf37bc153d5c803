"""Word files from blocks and cells, as zipped XML, one document a group, with the standard library only."""

from __future__ import annotations

import hashlib
import io
import re
import shutil
import struct
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.guards import emphasis_pieces

#: The namespace, part names and relation types of the file format.
NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"
STAMP = (1980, 1, 1, 0, 0, 0)
MOST_LEVEL = 4
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(s: str) -> str:
    """Runs' text: tabs and line breaks as their elements, characters that XML cannot hold left out."""
    parts = re.split("([\t\n])", NOT_XML.sub("", s))
    mark = {"\t": "<w:tab/>", "\n": "<w:br/>"}
    return "".join(mark.get(p) or f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in parts if p)


def _run(text: str, bold: bool = False, italic: bool = False, raised: bool = False, size: float = 0.0) -> str:
    look = "<w:b/>" * bold + "<w:i/>" * italic + '<w:vertAlign w:val="superscript"/>' * raised + (f'<w:sz w:val="{round(size * 2)}"/>' if size else "")
    return f"<w:r><w:rPr>{look}</w:rPr>{_text(text)}</w:r>" if text else ""


def _marked(text: str, notes: dict[str, int], bold: bool = False, italic: bool = False, size: float = 0.0) -> str:
    """A run whose note markers become references where the note is there, and raised numbers where it is not."""
    out = []
    for k, piece in enumerate(re.split("‹FN([0-9]+)›", text)):
        if k % 2 and piece in notes:
            out.append(f'<w:r><w:footnoteReference w:id="{notes[piece]}"/></w:r>')
        else:
            out.append(_run(piece, bold, italic, k % 2 == 1, size))
    return "".join(out)


def _runs(block: dict, notes: dict[str, int]) -> str:
    """A block's own runs, or its translated text with its emphasis."""
    told = block.get("translated")
    if told is None:
        return "".join(_marked(r["text"], notes, r["bold"], r["italic"], r["size"] or 0.0) for r in block["runs"] or [])
    return "".join(_marked(f"‹FN{t}›", notes) if up else _run(t, b, i) for t, b, i, up in emphasis_pieces(told))


def _paragraph(inside: str, style: str = "", place: dict | None = None) -> str:
    props = (f"<w:pStyle w:val={quoteattr(style)}/>" if style else "") + (f'<w:numPr><w:ilvl w:val="{place["level"]}"/><w:numId w:val="{place["num_id"]}"/></w:numPr>' if place else "")
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inside}</w:p>"


def picture_size(image: bytes) -> tuple[int, int]:
    """(width, height) in pixels of a PNG or JPEG file, (1, 1) if it is neither."""
    if image.startswith(b"\x89PNG"):
        return struct.unpack(">II", image[16:24])
    at = 2
    while image.startswith(b"\xff\xd8") and at + 9 < len(image) and image[at] == 0xFF:
        if image[at + 1] in (0xC0, 0xC1, 0xC2):
            high, wide = struct.unpack(">HH", image[at + 5 : at + 9])
            return wide, high
        at += 2 + struct.unpack(">H", image[at + 2 : at + 4])[0]
    return 1, 1


def _picture(image: bytes, inches: float, k: int, part: int) -> str:
    """The k-th inline drawing, of a picture part, of that width, the height in proportion."""
    wide, high = picture_size(image)
    cx = round(inches * 914400)
    cy = round(cx * high / wide)
    fill = f'<pic:blipFill><a:blip r:embed="p{part}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"/></pic:spPr>'
    graphic = f'<a:graphic xmlns:a="{DRAWING}/main"><a:graphicData uri="{DRAWING}/picture"><pic:pic xmlns:pic="{DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="{k}" name="p{k}"/><pic:cNvPicPr/></pic:nvPicPr>{fill}</pic:pic></a:graphicData></a:graphic>'
    return f'<w:r><w:drawing><wp:inline xmlns:wp="{DRAWING}/wordprocessingDrawing"><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{k}" name="p{k}"/>{graphic}</wp:inline></w:drawing></w:r>'


def _numbering(levels: list[dict]) -> str:
    """The numbering part of levels (num_id, abstract_id, level, fmt, template, start, restart)."""
    shapes: dict[str, dict[int, dict]] = {}
    nums: dict[str, tuple[str, dict[int, int]]] = {}
    for v in levels:
        shapes.setdefault(v["abstract_id"], {})[v["level"]] = v
        own = nums.setdefault(v["num_id"], (v["abstract_id"], {}))
        if v["restart"] is not None:
            own[1][v["level"]] = v["restart"]
    level = lambda v: f'<w:lvl w:ilvl="{v["level"]}"><w:start w:val="{v["start"]}"/><w:numFmt w:val="{v["fmt"]}"/><w:lvlText w:val={quoteattr(v["template"])}/></w:lvl>'
    a = "".join(f'<w:abstractNum w:abstractNumId="{k}">{"".join(level(v) for _, v in sorted(own.items()))}</w:abstractNum>' for k, own in sorted(shapes.items()))
    again = lambda own: "".join(f'<w:lvlOverride w:ilvl="{k}"><w:startOverride w:val="{n}"/></w:lvlOverride>' for k, n in sorted(own.items()))
    return a + "".join(f'<w:num w:numId="{k}"><w:abstractNumId w:val="{abstract}"/>{again(own)}</w:num>' for k, (abstract, own) in sorted(nums.items()))


def _table(rows: list[list[str]]) -> Iterator[str]:
    """A table, piece by piece, whose rows are padded with blanks to the widest."""
    wide = max(map(len, rows), default=0)
    cell = lambda t: f"<w:tc><w:tcPr/>{''.join(_paragraph(_run(p)) for p in t.split(chr(10)))}</w:tc>"
    yield f"<w:tbl><w:tblPr/><w:tblGrid>{'<w:gridCol/>' * wide}</w:tblGrid>"
    for r in rows:
        yield f"<w:tr>{''.join(map(cell, [*r, *[''] * (wide - len(r))]))}</w:tr>"
    yield "</w:tbl>"


def word_file(blocks: Iterable[dict], tables: dict[int, list[list[str]]] | None = None, levels: list[dict] | None = None, note_blocks: list[dict] | None = None) -> bytes:
    """A .docx of blocks in order: headings up to level 4, list items with their title, notes and comments in their parts.

    A table's block becomes the table if tables has it, else a line [TABLE n]. Pictures become media parts of their width.
    levels: numbering definitions, for blocks with a place (num_id, level). Equal blocks give equal bytes.
    note_blocks: the notes among the blocks, which are then read once only, as a stream.
    """
    if note_blocks is None:
        blocks = list(blocks)
        note_blocks = [b for b in blocks if b["kind"] == "footnote"]
    notes = {b["marker"] or "": k for k, b in enumerate(note_blocks, 1)}
    comments: list[str] = []
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, MOST_LEVEL + 1)) + '<w:style w:type="paragraph" w:styleId="ListParagraph"><w:name w:val="List Paragraph"/></w:style>'
    foot = "".join(f'<w:footnote w:id="{k}">{_paragraph(_run(b.get("translated") or b["text"] or ""))}</w:footnote>' for k, b in enumerate(note_blocks, 1))
    names = ["document", "styles", "footnotes", "comments", *["numbering"] * bool(levels)]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    begin = lambda n: f'{head}<w:{n} xmlns:w="{NS}" xmlns:r="{OFFICE}">'
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{KIND}.{"document.main" if n == "document" else n}+xml"/>' for n in names)
    out = io.BytesIO()
    links, pictures = bytearray(), 0
    parts: dict[bytes, int] = {}  # equal pictures are one part
    # an archive takes one part at a time: the body waits on disk while pictures go in as they come
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, tempfile.SpooledTemporaryFile(1 << 20) as body:
        add = lambda name, data, kind=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name, STAMP), data, kind)
        part = lambda n, inside: add(f"word/{n}.xml", f"{begin(n)}{inside}</w:{n}>".encode())
        add("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Default Extension="jpeg" ContentType="image/jpeg"/>{types}</Types>'.encode())
        add("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="d" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'.encode())
        part("styles", styles)
        part("footnotes", foot)
        if levels:
            part("numbering", _numbering(levels))
        put = lambda x: body.write(x.encode())
        put(f"{begin('document')}<w:body>")
        for b in blocks:
            if b["kind"] == "heading":
                put(_paragraph(_runs(b, notes), f"Heading{max(1, min(MOST_LEVEL, b['level'] or 1))}", b.get("place")))
            elif b["kind"] == "list_item":
                title = b.get("title_translated") or b["title"] or ""
                put(_paragraph(_run(title + (b["separator"] or " ")) + _runs(b, notes), "ListParagraph"))
            elif b["kind"] == "table_ref":
                rows = (tables or {}).get(b["table_index"])
                for piece in _table(rows) if rows else [_paragraph(_run(f"[TABLE {b['table_index']}]"))]:
                    put(piece)
            elif b["kind"] in ("body", "separator"):
                put(_paragraph(_runs(b, notes) if b["runs"] is not None or b.get("translated") is not None else _run(b["text"] or ""), place=b.get("place")))
            elif b["kind"] == "image" and b.get("image"):
                image, pictures = bytes(b["image"]), pictures + 1
                key = hashlib.blake2b(image, digest_size=16).digest()
                if key not in parts:
                    k = parts[key] = len(parts) + 1
                    end = "png" if image.startswith(b"\x89PNG") else "jpeg"
                    add(f"word/media/image{k}.{end}", image, zipfile.ZIP_STORED)
                    links += f'<Relationship Id="p{k}" Type="{OFFICE}/image" Target="media/image{k}.{end}"/>'.encode()
                put(_paragraph(_picture(image, b.get("width_inches") or 6.0, pictures, parts[key])))
            elif b["kind"] == "comment":
                c, k = b["comment"] or {}, len(comments)
                own = f"<w:commentRangeStart w:id=\"{k}\"/>{_run(c.get('anchor') or '')}<w:commentRangeEnd w:id=\"{k}\"/>"
                put(_paragraph(own + f'<w:r><w:commentReference w:id="{k}"/></w:r>'))
                comments.append(f"<w:comment w:id=\"{k}\" w:author={quoteattr(c.get('author') or '')} w:date={quoteattr(c.get('date') or '')}>{_paragraph(_run(b.get('translated') or b['text'] or ''))}</w:comment>")
        put("<w:sectPr/></w:body></w:document>")
        part("comments", "".join(comments))
        fixed = "".join(f'<Relationship Id="{n}" Type="{OFFICE}/{n}" Target="{n}.xml"/>' for n in names[1:])
        add("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships">{fixed}'.encode() + links + b"</Relationships>")
        info = zipfile.ZipInfo("word/document.xml", STAMP)
        info.compress_type = zipfile.ZIP_DEFLATED
        body.seek(0)
        with z.open(info, "w") as part_file:
            shutil.copyfileobj(body, part_file, 1 << 16)
    return out.getvalue()


def word_documents(blocks: DataFrame, cells: DataFrame | None = None, cell_text: str = "translated", levels: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): a .docx a document, from blocks (with translated and title_translated, if known) and their cells.

    A document is one file, so its blocks and cells meet in one task: as sorted rows, numbering levels and cells first, then
    notes, then all blocks, of which the task holds a table's texts and the file so far.
    """
    fields = ["kind", "level", "runs", "title", "separator", "marker", "text", "comment", "image", "width_inches", "table_index"]
    more = [c for c in ("translated", "title_translated", "place") if c in blocks.columns]
    block = F.struct(*fields, *more)
    kind = dict(blocks.select(block.alias("block")).dtypes)["block"]
    cell_kind = "struct<table_idx:int,row_idx:int,col_idx:int,t:string>"
    level_kind = "struct<num_id:string,abstract_id:string,level:int,fmt:string,template:string,start:int,restart:int>"
    none = lambda t, name: F.lit(None).cast(t).alias(name)
    own = lambda df, part, pos: df.select("doc_id", F.lit(part).alias("part"), F.col(pos).cast("long").alias("pos"), block.alias("block"), none(cell_kind, "cell"), none(level_kind, "def"))
    rows = own(blocks, 3, "pos").unionByName(own(blocks.where("kind = 'footnote'"), 2, "pos"))
    if cells is not None:
        cell = F.struct(F.col("table_idx").cast("int").alias("table_idx"), F.col("row_idx").cast("int").alias("row_idx"), F.col("col_idx").cast("int").alias("col_idx"), F.col(cell_text).alias("t"))
        rows = rows.unionByName(cells.select("doc_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), none(kind, "block"), cell.alias("cell"), none(level_kind, "def")))
    if levels is not None:
        level = F.struct(*(F.col(n).cast(t).alias(n) for n, t in (c.split(":") for c in level_kind[7:-1].split(","))))
        rows = rows.unionByName(levels.select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"), none(kind, "block"), none(cell_kind, "cell"), level.alias("def")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                for lo in range(0, b.num_rows, 100):
                    yield from zip(*(c.slice(lo, 100).to_pylist() for c in b.columns), strict=True)

        for doc, own_rows in groupby(stream(), key=lambda r: r[0]):
            shapes, notes, tables = [], [], {}
            at = next(own_rows, None)
            while at is not None and at[1] < 3:
                if at[1] == 0:
                    shapes.append(at[4])
                elif at[1] == 1:
                    c = at[3]
                    tables.setdefault(c["table_idx"], {}).setdefault(c["row_idx"], []).append(c["t"] or "")
                else:
                    notes.append(at[2])
                at = next(own_rows, None)
            if at is not None:
                content = word_file((r[2] for r in chain([at], own_rows)), {n: list(x.values()) for n, x in tables.items()}, shapes, notes)
                yield pa.RecordBatch.from_arrays([pa.array([doc], out_kind), pa.array([content], pa.binary())], ["doc_id", "content"])

    doc_kind = dict(blocks.dtypes)["doc_id"]
    out_kind = to_arrow_type(blocks.schema["doc_id"].dataType)
    # dealt by a hash of the id: a union of tables that are dealt by the id itself would pass for dealt, and is not where small ones are put together
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "part", "pos", "cell", "def", "block")
    return placed.select("doc_id", "part", "block", "cell", "def").mapInArrow(run, f"doc_id {doc_kind}, content binary")
