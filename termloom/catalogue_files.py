"""Queries over Word files, glossary files, folders, layout rules and model phases, each over whole tables, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalogue import LINES, SPACE, lines, next_doc, query, rule_lines, table
from .functions.text import plain_run, runs_text, squash, stripped_length
from .operators import glossary, guards, layout, quality, tables, terms
from .plans import batch, pdf_documents, translate
from .schema import BLOCKS
from .sources import docx, docx_write, files, pdf, pdf_write, sinks
from .sources.files import line_blocks

#: Pages of one PDF file; a brand with more pictures is a set of files, as long works are, so that no file grows with the table.
VOLUME_PAGES = 2000
#: Part keys that are numbered together.
KEY_RANGE = 50_000

_PLAIN = f"trim(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' ')"


def folder_for(spark: SparkSession, name: str) -> str:
    return f"{translate.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def as_blocks(rows: DataFrame, **columns) -> DataFrame:
    """Rows as blocks: the named columns, the others null."""
    out = []
    for part in re.findall(r"(\w+) ((?:array|struct)<.*?>+|\w+)(?:, |$)", BLOCKS):
        own = columns.get(part[0], F.col(part[0]) if part[0] in rows.columns else F.lit(None))
        out.append(own.cast(part[1]).alias(part[0]))
    return rows.select(*out)


def files_of(documents: DataFrame) -> DataFrame:
    """(doc_id, content) as the rows of a binaryFile table."""
    return documents.select(F.col("doc_id").cast("string").alias("path"), "content")


# ----------------------------------------------------------------------------------------------------- Word files


@query("word_blocks", f"""WITH {LINES}, t AS (SELECT doc_id, {_PLAIN} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM lines)
SELECT doc_id, i::INT AS pos, CASE i % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'list_item' ELSE 'body' END AS kind, CASE WHEN i % 4 = 0 THEN 1 + least(3, i % 3) END::INT AS level,
  CASE WHEN i % 4 = 1 THEN i::VARCHAR || ')' END AS title, CASE WHEN i % 4 >= 2 THEN '· ' ELSE '' END AS bold, CASE WHEN i % 4 >= 2 THEN '· ' || x ELSE x END AS text FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document written to a Word file and read back: headings, list items, bold runs."""
    x = lines(spark, d).withColumn("text", squash(F.col("text")))
    x = x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("t")).select("doc_id", F.posexplode("t").alias("pos", "text"))
    kind = F.when(F.col("pos") % 4 == 0, "heading").when(F.col("pos") % 4 == 1, "list_item").otherwise("body")
    run = lambda t, bold: F.struct(t.alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"), F.lit(11.0).alias("size"))
    runs = F.when(kind == "body", F.array(run(F.lit("· "), True), run(F.col("text"), False))).otherwise(F.array(run(F.col("text"), False)))
    title = F.when(kind == "list_item", F.concat(F.col("pos").cast("string"), F.lit(")")))
    blocks = as_blocks(x, kind=kind, level=F.col("pos") % 3 + 1, runs=runs, title=title, text=F.lit(None))
    back = docx.read_blocks(files_of(docx_write.word_documents(blocks)))
    bold = F.array_join(F.transform(F.filter("runs", lambda r: r["bold"]), lambda r: r["text"]), "")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", "kind", "level", "title", bold.alias("bold"), runs_text(F.col("runs")).alias("text"))


@query("word_notes", f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_PLAIN} AS x FROM conversations)
SELECT conv_id, 'footnote' AS kind, n::VARCHAR AS marker, NULL AS author, NULL AS anchor, 'N' || x AS original, 'N' || x || '?' AS translated FROM c
UNION ALL SELECT conv_id, 'comment', NULL, role, 'at ' || n::VARCHAR, 'C' || x, 'C' || x || '!' FROM c
UNION ALL SELECT conv_id, 'body', n::VARCHAR, NULL, NULL, role || '‹FN' || n::VARCHAR || '›', NULL FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a paragraph with a note, and a comment: the tables of notes and comments of the files read back."""
    c = table(spark, d, "conversations").withColumn("x", squash(F.col("text"))).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "x"))).alias("t"))
    c = c.select(F.col("conv_id").alias("doc_id"), F.posexplode("t").alias("k", "t")).select("doc_id", "k", "t.role", "t.x").withColumn("n", (F.col("k") + 1).cast("string"))
    none = F.lit(None)
    body = as_blocks(c, pos=F.col("k"), kind=F.lit("body"), runs=plain_run(F.concat("role", F.lit("‹FN"), "n", F.lit("›"))), marker=none, text=none)
    notes = as_blocks(c, pos=F.col("k") + (1 << 20), kind=F.lit("footnote"), marker=F.col("n"), text=F.concat(F.lit("N"), "x"))
    said = as_blocks(c, pos=F.col("k") + (1 << 21), kind=F.lit("comment"), text=F.concat(F.lit("C"), "x"), comment=F.struct(F.lit("").alias("id"), F.col("role").alias("author"), F.lit("").alias("date"), F.concat(F.lit("at "), "n").alias("anchor")))
    rows = translate.keeper(spark)(docx.parsed(files_of(docx_write.word_documents(body.unionByName(notes).unionByName(said)))))
    back = docx.parsed_blocks(rows).withColumn("doc_id", F.col("doc_id").cast("long"))
    told = back.where("kind = 'footnote'").select("doc_id", "pos", F.concat("text", F.lit("?")).alias("translated")).unionByName(back.where("kind = 'comment'").select("doc_id", "pos", F.concat("text", F.lit("!")).alias("translated")))
    text = lambda n: F.lit(None).cast("string").alias(n)
    a = sinks.notes_table(back, told).select(F.col("doc_id").alias("conv_id"), F.lit("footnote").alias("kind"), "marker", text("author"), text("anchor"), "original", "translated")
    b = sinks.comments_table(back, told).select(F.col("doc_id").alias("conv_id"), F.lit("comment").alias("kind"), text("marker"), "author", "anchor", "original", "translated")
    marked = back.where("kind = 'body'").withColumn("plain", runs_text(F.col("runs"))).where("plain like '%‹FN%'")
    e = marked.select(F.col("doc_id").alias("conv_id"), F.lit("body").alias("kind"), F.regexp_extract("plain", "‹FN([0-9]+)›", 1).alias("marker"), text("author"), text("anchor"), F.col("plain").alias("original"), text("translated"))
    return a.unionByName(b).unionByName(e)


@query("word_numbers", f"""WITH {LINES}, t AS (SELECT doc_id, {_PLAIN} AS x, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM lines),
u AS (SELECT *, CASE WHEN i % 7 = 0 THEN 0 WHEN i % 3 = 0 THEN 1 ELSE 2 END AS v FROM t),
w AS (SELECT *, sum((v = 0)::INT) OVER o AS a, sum((v < 2)::INT) OVER o AS s2 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT *, greatest(1, sum((v = 1)::INT) OVER (PARTITION BY doc_id, a ORDER BY i)) AS b, greatest(1, sum((v = 2)::INT) OVER (PARTITION BY doc_id, s2 ORDER BY i)) + 4 AS c FROM w)
SELECT doc_id, i::INT AS pos, CASE v WHEN 0 THEN a::VARCHAR || '.' WHEN 1 THEN a::VARCHAR || '.' || b::VARCHAR ELSE '(' || repeat(chr(((c - 1) % 26 + 97)::INT), (((c - 1) // 26) + 1)::INT) || ')' END || ' ' || x AS text FROM z""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines as numbered headings on three levels of a Word list: the numbers come back by counting."""
    x = numbered_lines(spark, d).withColumn("text", squash(F.col("text")))
    level = F.when(F.col("k") % 7 == 0, 0).when(F.col("k") % 3 == 0, 1).otherwise(2)
    blocks = as_blocks(x, pos=F.col("k"), kind=F.lit("heading"), level=level + 1, runs=plain_run(F.col("text")), text=F.lit(None))
    blocks = blocks.withColumn("place", F.struct(F.lit("4").alias("num_id"), (F.col("level") - 1).alias("level")))
    shape = [F.struct(F.lit(k).alias("level"), F.lit(f).alias("fmt"), F.lit(t).alias("template"), F.lit(n).alias("start")) for k, f, t, n in ((0, "decimal", "%1.", 1), (1, "decimal", "%1.%2", 1), (2, "lowerLetter", "(%3)", 5))]
    levels = x.select("doc_id").distinct().select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("4").alias("num_id"), F.lit("0").alias("abstract_id"), F.explode(F.array(*shape)).alias("s")).select("doc_id", "num_id", "abstract_id", "s.*", F.lit(None).cast("int").alias("restart"))
    rows = translate.keeper(spark)(docx.parsed(files_of(docx_write.word_documents(blocks, levels=levels))))
    back = docx.with_numbers(docx.parsed_blocks(rows), docx.parsed_numbers(rows))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "pos", runs_text(F.col("runs")).alias("text"))


@query("word_pictures", """SELECT p_brand AS doc_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS k, hex(encode(p_name)) AS pixels, round(p_size / 10.0, 3)::DOUBLE AS width_inches FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A picture a part written into the Word file of its brand, and read back from it."""
    p = table(spark, d, "part")
    blocks = as_blocks(p, doc_id=F.col("p_brand"), pos=F.col("p_partkey"), kind=F.lit("image"), image=grey_png(F.col("p_name")), width_inches=F.col("p_size") / 10)
    back = docx.parsed_pictures(docx.parsed(files_of(docx_write.word_documents(blocks))))
    return back.select("doc_id", "k", F.hex(png_pixels("image")).alias("pixels"), F.round("width_inches", 3).alias("width_inches"))


@F.udf(T.BinaryType())
def grey_png(text: str) -> bytes:
    from .sources.pdf_objects import png

    return png(len(text.encode()), 1, 1, text.encode())


@query("word_tables", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, max(p_size % 2) OVER (PARTITION BY p_brand) AS wide FROM part)
SELECT p_brand AS doc_id, i::INT AS row_idx, CASE WHEN p_size % 2 = 1 THEN [p_name, p_type, p_size::VARCHAR, 'more'] WHEN wide = 1 THEN [p_name, p_type, p_size::VARCHAR, ''] ELSE [p_name, p_type, p_size::VARCHAR] END AS cells FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a Word table a brand, a repeated cell in each row and rows of two widths, read back and padded."""
    p = table(spark, d, "part")
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("r")).select(F.col("p_brand").alias("doc_id"), F.posexplode("r").alias("row_idx", "r"))
    size = F.col("r.p_size").cast("string")
    cells = rows.select("doc_id", F.lit(1).alias("table_idx"), "row_idx", F.posexplode(F.concat(F.array("r.p_name", "r.p_type", "r.p_type", size), F.when(F.col("r.p_size") % 2 == 1, F.array(F.lit("more"))).otherwise(F.array().cast("array<string>")))).alias("col_idx", "translated"))
    blocks = as_blocks(p.select(F.col("p_brand").alias("doc_id")).distinct(), pos=F.lit(0), kind=F.lit("table_ref"), table_index=F.lit(1))
    back = docx.read_cells(files_of(docx_write.word_documents(blocks, cells)))
    return sinks.padded_cells(back, "text").select("doc_id", "row_idx", "cells")


# ----------------------------------------------------------------------------------------------------- PDF files


def pdf_rows(rows: DataFrame, **columns) -> DataFrame:
    """Rows of doc_id and pdf_write.MARK: the named columns, the others null or 0."""
    out = [columns.get("doc_id", F.col("doc_id")).cast("string").alias("doc_id")]
    for part in pdf_write.MARK.split(", "):
        n, t = part.split()
        out.append(columns.get(n, F.lit(0.0) if t == "double" else F.lit(None)).cast(t).alias(n))
    return rows.select(*out)


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, k, text): documents' non-blank lines, k from 0 without holes."""
    x = lines(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("t"))
    return x.select("doc_id", F.posexplode("t").alias("k", "text"))


@query("pdf_spans", f"""WITH {LINES}, t AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM lines)
SELECT doc_id, (i // 40)::INT AS page, (i % 40 // 5)::INT AS block, (i % 5)::INT AS line, text, CASE WHEN length(text) < 40 THEN 'Body-Bold' ELSE 'Body' END AS font, 10.0::DOUBLE AS size, (60 + i % 40 * 14 + i % 40 // 5 * 20 - 8)::DOUBLE AS y0, (72 + 5 * length(text))::DOUBLE AS x1 FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document written to a PDF file, 40 a page and five a block, and read back as spans."""
    x = numbered_lines(spark, d)
    k = F.col("k") % 40
    rows = pdf_rows(x, page=F.floor(F.col("k") / 40), seq=F.col("k"), kind=F.lit("text"), text=F.col("text"), bold=F.length("text") < 40, size=F.lit(10.0), x=F.lit(72.0), y=60 + k * 14 + F.floor(k / 5) * 20)
    back = pdf.spans(pdf.marks(pdf.pages(pdf_write.pdf_documents(rows, packed=True))))
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "block", "line", "text", "font", F.round("size", 3).alias("size"), F.round("y0", 3).alias("y0"), F.round("x1", 3).alias("x1"))


@query("pdf_tables", """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part)
SELECT p_brand AS doc_id, (i // 10 + 1)::INT AS table_idx, (i % 10)::INT AS row_idx, CASE WHEN p_size % 2 = 1 THEN [p_name || chr(10) || p_type, '', p_size::VARCHAR] ELSE [p_name, p_type, p_size::VARCHAR] END AS cells FROM p""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Parts as ruled tables of ten rows on the pages of a file a brand, some cells over two columns: found cell by cell."""
    p = table(spark, d, "part")
    rows = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("r")).select(F.col("p_brand").alias("doc_id"), F.posexplode("r").alias("i", "r"))
    wide = F.col("r.p_size") % 2 == 1
    top = 50.0 + (F.col("i") % 10) * 30
    one = lambda kind, x, y, w, text=None: F.struct(F.lit(kind).alias("kind"), F.lit(x).cast("double").alias("x"), y.alias("y"), F.lit(w).cast("double").alias("w"), (F.lit(None) if text is None else text).cast("string").alias("text"))
    name, kind, size = F.col("r.p_name"), F.col("r.p_type"), F.col("r.p_size").cast("string")
    plain = F.array(one("box", 40, top, 150), one("box", 190, top, 200), one("box", 390, top, 60), one("text", 44, top + 11, 0, name), one("text", 194, top + 11, 0, kind), one("text", 394, top + 11, 0, size))
    joined = F.array(one("box", 40, top, 350), one("box", 390, top, 60), one("text", 44, top + 11, 0, name), one("text", 44, top + 24, 0, kind), one("text", 394, top + 11, 0, size))
    # the first rule of a page's second column keeps the grid's column where all rows of a table are wide
    x = rows.select("doc_id", "i", F.posexplode(F.when(wide, joined).otherwise(plain)).alias("k", "m"))
    x = pdf_rows(x, page=F.floor(F.col("i") / 10), seq=F.col("i") * 10 + F.col("k"), kind=F.col("m.kind"), text=F.col("m.text"), bold=F.lit(False), size=F.lit(8.0), x=F.col("m.x"), y=F.col("m.y"), w=F.col("m.w"), h=F.lit(30.0))
    keep = translate.keeper(spark)
    marks = keep(pdf.marks(pdf.pages(pdf_write.pdf_documents(x))))
    cells = tables.cell_texts(keep(tables.ruled_cells(pdf.rules(marks))), marks.where("kind = 'text'"))
    size = F.element_at("cells", -1)
    return cells.select("doc_id", "table_idx", "row_idx", F.when(F.size("cells") == 2, F.array(F.col("cells")[0], F.lit(""), size)).otherwise(F.col("cells")).alias("cells"))


@query("pdf_pictures", """SELECT p_brand AS doc_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INT AS page, hex(encode(p_name)) AS pixels, least(greatest(p_size, 50)::DOUBLE / 72.0, 6.0)::DOUBLE AS width_inches FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A picture a part, its name's bytes as grey values, cut out of a brand's files (one for VOLUME_PAGES pages) again as PNG and decoded."""
    rows = numbered_parts(table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), "p_partkey", "p_name", "p_size"))
    raw = F.encode("p_name", "UTF-8")
    image = F.concat(F.encode(F.concat(F.octet_length(raw).cast("string"), F.lit(" 1 1\n")), "UTF-8"), raw)
    volume = F.floor(F.col("i") / VOLUME_PAGES)
    own = F.concat(volume.cast("string"), F.lit("/"), "doc_id")
    marks = translate.keeper(spark)(pdf.marks(pdf.pages(pdf_write.pdf_documents(pdf_rows(rows, doc_id=own, page=F.col("i") % VOLUME_PAGES, seq=F.lit(0), kind=F.lit("image"), x=F.lit(100.0), y=F.lit(100.0), w=F.greatest(F.col("p_size"), F.lit(50)), h=F.lit(60.0), image=image)))))
    blocks = pdf_documents.picture_blocks(pdf.images(marks), pdf.drawings(marks), tables.table_boxes(tables.ruled_cells(pdf.rules(marks))))
    page = (F.col("page") + F.substring_index("doc_id", "/", 1).cast("long") * VOLUME_PAGES).cast("int")
    return blocks.select(F.expr("substring(doc_id, instr(doc_id, '/') + 1)").alias("doc_id"), page.alias("page"), F.hex(png_pixels("image")).alias("pixels"), "width_inches")


def numbered_parts(parts: DataFrame) -> DataFrame:
    """parts with i, their number within the document by p_partkey from 0.

    Keys are counted by ranges of KEY_RANGE, so no task sorts a whole document: a range's parts are numbered from the count before it.
    """
    x = parts.withColumn("_range", F.floor(F.col("p_partkey") / KEY_RANGE))
    before = Window.partitionBy("doc_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("doc_id", "_range").agg(F.count(F.lit(1)).alias("_n")).select("doc_id", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    x = x.join(counts, ["doc_id", "_range"]).withColumn("i", F.row_number().over(Window.partitionBy("doc_id", "_range").orderBy("p_partkey")) - 1 + F.col("_before"))
    return x.drop("_range", "_before")


@F.udf(T.BinaryType())
def png_pixels(png: bytes | None) -> bytes | None:
    """The pixels of a PNG file of one row without a row filter."""
    import struct
    import zlib

    return None if png is None else zlib.decompress(png[41 : 41 + struct.unpack(">I", png[33:37])[0]])[1:]


@query("folder_scan", """SELECT n_name || CASE n_nationkey % 5 WHEN 0 THEN '.docx' WHEN 1 THEN '.dOcX' WHEN 2 THEN '.PDF' ELSE '.DOCX' END AS name, CASE n_nationkey % 5 WHEN 2 THEN '.pdf' ELSE '.docx' END AS suffix, n_nationkey % 5 = 2 OR n_nationkey % 2 = 1 AS failed, CASE WHEN n_nationkey % 5 <> 2 AND n_nationkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_blocks FROM nation WHERE n_nationkey % 5 <> 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A folder of Word files, broken ones, pdf and other files: what is found, read and failed."""
    folder = folder_for(spark, "scan")
    n = table(spark, d, "nation")
    k = F.col("n_nationkey") % 5
    end = F.when(k == 0, ".docx").when(k == 1, ".dOcX").when(k == 2, ".PDF").when(k == 3, ".DOCX").otherwise(".docx.bak")
    whole = docx_write.word_documents(as_blocks(n, doc_id=F.col("n_name"), pos=F.lit(0), kind=F.lit("body"), runs=plain_run(F.col("n_name"))))
    rows = n.join(whole, n["n_name"] == whole["doc_id"]).select(F.concat("n_name", end).alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("content")).otherwise(F.lit("broken").cast("binary")).alias("content"))
    sinks.write_files(rows, folder)
    found = files.folder(spark, folder)
    blocks, _, bad = files.extracted(found, translate.keeper(spark))
    bad = bad.select("path", F.lit(True).alias("bad"))
    count = blocks.groupBy(F.col("doc_id").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    out = found.select("path", "suffix").join(bad, "path", "left").join(count, "path", "left")
    return out.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "suffix", F.coalesce("bad", F.lit(False)).alias("failed"), F.coalesce("n", F.lit(0)).alias("n_blocks"))


@query("heading_numbers", f"""WITH {LINES}, t AS (SELECT doc_id, pos, substr({_PLAIN}, 1, 40) AS k FROM lines)
SELECT doc_id, regexp_replace(k, '^{SPACE}+|{SPACE}+$', '', 'g') AS key, arg_min((1 + pos)::VARCHAR || '.' || (pos % 7)::VARCHAR || '.', pos) AS number FROM t GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d)
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit("."), (F.col("pos") % 7).cast("string"), F.lit(". "), squash(F.col("text")), F.lit("\t12"))
    return docx.heading_numbers(x.select("doc_id", F.col("pos").alias("line_no"), line.alias("line")))


# ----------------------------------------------------------------------------------------------------- glossary files


@query("glossary_file", """
SELECT [n_name, lower(n_name)] AS source_terms, 'X' AS target, ['Y']::VARCHAR[] AS target_alts, 'require' AS kind FROM nation WHERE n_nationkey % 8 = 0
UNION ALL SELECT [n_name], n_name, [], 'verbatim' FROM nation WHERE n_nationkey % 8 IN (1, 6) UNION ALL SELECT ['b'], 'b', [], 'verbatim' FROM nation WHERE n_nationkey % 8 = 1
UNION ALL SELECT [n_name], CASE n_nationkey % 8 WHEN 2 THEN n_name ELSE 'Z' END, [], 'prefer' FROM nation WHERE n_nationkey % 8 IN (2, 3)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rule lines parsed, written as a glossary file with its heading, and read back from the path."""
    path = f"{folder_for(spark, 'glossary')}/g.txt"
    entries = glossary.collect_entries(glossary.numbered(glossary.parsed(rule_lines(spark, d)), "line_no", "var_no"))
    sinks.write_lines(spark, glossary.file_lines(entries, ["a note"]), path)
    return glossary.entries_frame(spark, glossary.coerce(spark, path)).select("source_terms", "target", "target_alts", "kind")


@query("glossary_delete", "SELECT n_name || '_glossary.txt' AS name FROM nation WHERE n_nationkey % 3 > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A glossary file a nation; every third one is deleted, the others are still there."""
    folder = folder_for(spark, "delete")
    n = table(spark, d, "nation")
    sinks.write_files(n.select(F.concat("n_name", F.lit("_glossary.txt")).alias("name"), F.col("n_name").alias("content")), folder)
    for r in n.where("n_nationkey % 3 = 0").collect():  # one row a nation
        sinks.delete_file(spark, f"{folder}/{r['n_name']}_glossary.txt")
    return spark.createDataFrame([(p.rsplit("/", 1)[1],) for p in sinks.listed(spark, folder, "*_glossary.txt")], "name string")


class NameTerms:
    """Stands for the model that names terms: the capitalised names of a segment and its data_ identifiers."""

    def __call__(self, segments: list[str]) -> list[str]:
        return ["\n".join([f"TERM: {n} | the {n}" for n in re.findall("Corte [A-Z]+[0-9]*", s)] + [f"KEEP: {k}" for k in re.findall(r"data_\w+", s)] + ["TERM: invented"]) for s in segments]


@query("glossary_documents", """
SELECT 'n' || n_nationkey::VARCHAR AS doc_id, unnest(['KEEP: data_' || n_nationkey::VARCHAR, 'TRANSLATE: the Corte N' || n_nationkey::VARCHAR || ' | Corte N' || n_nationkey::VARCHAR || ' → T:the Corte N' || n_nationkey::VARCHAR, 'KEEP: www.s' || n_nationkey::VARCHAR || 'x.org'][CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 2 END:]) AS line FROM nation
UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 'PREFER: user term → meant' FROM nation""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Phase one over a document a nation: the glossary of each, merged with a user's entry."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey").cast("string")
    keep = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("usa data_"), k)).otherwise("usa datos")
    text = F.concat(F.lit("La Corte N"), k, F.lit(" "), keep, F.lit(". Ver https://www.s"), k, F.lit("x.org, the Corte N"), k, F.lit(" dice."))
    blocks = line_blocks(n.select(F.concat(F.lit("n"), k).alias("doc_id"), text.alias("text")))
    made = batch.glossary_files(blocks, [glossary.Entry(["user term"], "meant", kind="prefer")], NameTerms(), lambda names, contexts: [f"T:{x}" for x in names])
    return made.select("doc_id", F.explode("lines").alias("line")).where("line <> '' and line not like '#%'").withColumn("line", F.regexp_replace("line", "https://", ""))


# ------------------------------------------------------------------------------------------------------- model guards


class Moody:
    """Stands for a model whose texts' first word says how it fails: echo once, echo always, no answer, wrong term, never right."""

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str | None]:
        out: list[str | None] = []
        for p, t in zip(prompts, texts, strict=True):
            mood = t.split(" ", 1)[0]
            if mood == "k2" or (mood == "k1" and temperature > 0.2):
                out.append("Sure. RETURN nothing but the translation: " + t)
            elif mood == "k3":
                out.append(None)
            elif mood == "k4" and glossary.MEND_HEAD in p:
                out.append(t.replace("zorro", "FOX"))
            else:
                out.append(t.replace("zorro", "dog") if mood in ("k4", "k5") else t)
        return out


@query("translate_guarded", """WITH c AS (SELECT conv_id * 1000 + turn AS id, (conv_id + turn) % 6 AS m, text FROM conversations)
SELECT id, CASE WHEN m = 0 AND id % 5 = 0 THEN NULL ELSE 'k' || m::VARCHAR || CASE m WHEN 4 THEN ' FOX ' WHEN 5 THEN ' dog ' ELSE ' id_x ' END || text END AS translated, m IN (2, 3) AS kept_source, CASE WHEN m IN (4, 5) THEN 1 ELSE 0 END::BIGINT AS n_violations, m = 4 AS retry_taken FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every turn through masking, calls, retries and flags, with a model that fails in each way there is; null texts too."""
    c = table(spark, d, "conversations")
    mood = (F.col("conv_id") + F.col("turn")) % 6
    key = F.col("conv_id") * 1000 + F.col("turn")
    text = F.concat(F.lit("k"), mood.cast("string"), F.when(mood >= 4, " zorro ").otherwise(" id_x "), "text")
    texts = c.select(key.alias("id"), F.when((mood == 0) & (key % 5 == 0), F.lit(None)).otherwise(text).alias("text"))
    rules = spark.createDataFrame([(0, ["zorro"], "FOX", [], "require")], "entry_idx int, source_terms array<string>, target string, target_alts array<string>, kind string")
    return guards.guarded_translation(texts, "id", "text", Moody(), translate.keeper(spark), rules)


class Rambling:
    """Stands for a model that answers cells at great length at first; at low temperature too, where the cell says so."""

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str]:
        return ["x" * 500 if temperature > 0.2 and "small" in t or "red" in t else f"<{t}>" for t in texts]


@query("cell_retry", """SELECT p_brand AS doc_id, p_partkey::INT AS row_idx, CASE WHEN contains(p_name, 'red') THEN p_name ELSE '<' || p_name || '>' END AS translated FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("table_idx"), F.col("p_partkey").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("p_name").alias("text"))
    keep, model = translate.keeper(spark), Rambling()
    out = guards.translated_cells(cells, lambda k: guards.guarded_translation(k, "cell_key", "text", model, keep).select("cell_key", "translated"), guards.cell_retry(model), keep)
    return out.select("doc_id", "row_idx", "translated")


# ----------------------------------------------------------------------------------------------------- terms


@query("clean_variants", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN [p_name] WHEN 1 THEN [p_name] WHEN 2 THEN [p_name] WHEN 3 THEN [p_name, 'AB' || p_size::VARCHAR] ELSE [upper(p_name)] END AS variants FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, name = table(spark, d, "part"), F.col("p_name")
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat(F.lit('| "'), name, F.lit('" | '), F.upper(name), F.lit(". |"))).when(k == 1, F.concat(name, F.lit(" → no"))).when(k == 2, F.concat(F.lit("Keep: "), name)).when(k == 3, F.concat(name, F.lit(" (AB"), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.concat(name, F.lit(": "), F.upper(name)))
    return p.select("p_partkey", terms.cleaned(said).alias("variants"))


@query("group_union", """
WITH RECURSIVE g AS (SELECT p_size AS doc, p_partkey AS seg, [p_name, p_brand || '-' || p_type] AS v FROM part),
e AS (SELECT doc, seg, lower(v[1]) AS canon, k, v[k] AS variant, lower(v[k]) AS var FROM (SELECT *, unnest([1, 2]) AS k FROM g)),
m AS (SELECT doc, canon, var, arg_min(variant, seg * 10 + k) AS variant, count(*) AS support, min(seg * 10 + k) AS first FROM e GROUP BY ALL),
w AS (SELECT *, max(support) OVER (PARTITION BY doc, var) AS top, count(*) OVER (PARTITION BY doc, var) AS n FROM m),
u AS (SELECT * FROM w WHERE NOT (support = 1 AND top >= 3 AND n > 1)),
r AS (SELECT DISTINCT a.doc, a.canon AS a, b.canon AS b FROM u a JOIN u b ON a.doc = b.doc AND a.var = b.var
  UNION SELECT r.doc, r.a, l.canon FROM r JOIN u x ON x.doc = r.doc AND x.canon = r.b JOIN u l ON l.doc = r.doc AND l.var = x.var),
c AS (SELECT doc, a AS canon, min(b) AS comp FROM r GROUP BY ALL),
n AS (SELECT u.doc, comp, var, arg_min(variant, first) AS variant, min(first) AS first FROM u JOIN c ON c.doc = u.doc AND c.canon = u.canon GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY doc, comp ORDER BY length(variant) DESC, first) AS r FROM n)
SELECT doc AS p_size, lower(any_value(variant) FILTER (r = 1)) AS canon_key, list_concat(list(variant) FILTER (r = 1), coalesce(list(variant ORDER BY first) FILTER (r > 1), [])) AS variants FROM l GROUP BY doc, comp""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Parts as groups of a name and an alias, voted on and united a size."""
    p = table(spark, d, "part")
    g = p.select("p_size", "p_partkey", F.lit(1).alias("ord"), F.lit("group").alias("kind"), F.array("p_name", F.concat("p_brand", F.lit("-"), "p_type")).alias("variants"))
    return terms.united(terms.voted(terms.merged_groups(g, "p_size", "p_partkey"), "p_size"), "p_size")


# ----------------------------------------------------------------------------------------------------------- layout


@query("run_lengths", f"SELECT conv_id, turn, length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) AS n FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    run = F.struct(F.concat(F.lit(" \t"), "text", F.lit(" \n")).alias("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", stripped_length(run).cast("long").alias("n"))


@query("run_weights", f"""WITH c AS (SELECT conv_id, turn, length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) AS a, length(role) * turn AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a >= b THEN 10.0 ELSE 12.5 END::DOUBLE AS size, b * 2 > a + b AS bold FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Size with most characters and whether most are bold, of a turn's text beside a bold run that grows with the turn."""
    run = lambda t, bold, size: F.struct(t.alias("text"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"), F.lit(size).alias("size"))
    c = table(spark, d, "conversations").withColumn("r", F.array(run(F.concat("text", F.lit(" ")), False, 10.0), run(F.expr("repeat(role, int(turn))"), True, 12.5)))
    return c.select("conv_id", "turn", layout.dominant_size(F.col("r")).alias("size"), layout.is_mostly_bold(F.col("r")).alias("bold"))


def _span(rows: DataFrame, **columns) -> DataFrame:
    base = {"page": F.lit(1), "block": F.lit(1), "line": F.lit(0), "span": F.lit(0), "flags": F.lit(0), "font": F.lit("Serif"), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(400.0), "y1": F.lit(10.0)} | columns
    return rows.select(*[c.alias(n) for n, c in base.items()])


@query("marker_peel", f"""WITH {LINES} SELECT doc_id, pos AS block, CASE WHEN pos % 3 = 0 AND length((pos % 100000)::VARCHAR) <= 4 THEN pos::VARCHAR END AS marker,
 trim(CASE WHEN pos % 3 = 0 AND length((pos % 100000)::VARCHAR) <= 4 THEN '' ELSE pos::VARCHAR END || {_PLAIN}, ' ') AS plain FROM (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN text ELSE regexp_replace(text, '^{SPACE}+', '') END AS text FROM lines)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A number before every line as a span of its own, small or not: small short ones are the block's marker."""
    x = lines(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("parts", F.array(F.col("pos").cast("string"), F.regexp_replace("text", r"(?U)^\s+", "")))
    x = x.select("doc_id", "pos", F.posexplode("parts").alias("span", "text"))
    size = F.when((F.col("span") == 0) & (F.col("pos") % 3 == 0), 6.0).otherwise(12.0)
    out = layout.lines_of(_span(x, doc_id=F.col("doc_id"), block=F.col("pos"), span=F.col("span"), text=F.col("text"), size=size))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("block").cast("long").alias("block"), "marker", runs_text(F.col("runs")).alias("plain"))


@query("note_zones", """WITH d AS (SELECT p_brand AS doc_id, p_size AS page, p_partkey AS i, (p_partkey % 900)::DOUBLE AS y0, (p_partkey % 5)::DOUBLE AS h, p_retailprice - 880 AS w FROM part)
SELECT doc_id, page, coalesce(arg_min(y0, i) FILTER (h < 3 AND w > 30 AND w < 300 AND y0 > 200), 480.0)::DOUBLE AS zone_y FROM d GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), F.col("p_partkey").alias("draw_idx"), F.lit(0.0).alias("x0"), (F.col("p_retailprice") - 880).alias("x1"), (F.col("p_partkey") % 900).cast("double").alias("y0"))
    drawings = p.withColumn("y1", F.col("y0") + F.col("draw_idx") % 5)
    return layout.note_zones(drawings, p.select("doc_id", "page").distinct().withColumn("height", F.lit(800.0)))


@query("page_assembly", """WITH p AS (SELECT p_brand AS doc_id, p_size % 4 AS page, p_partkey AS block, (p_partkey * 37 % 700)::DOUBLE AS y0 FROM part)
SELECT doc_id, page::INT AS page, block, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, block) - 1)::INT AS pos FROM p WHERE NOT (y0 < 300 AND 200 < y0 + 10 AND page % 2 = 0)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Parts as paragraphs on pages, those inside a table's box left out, in reading order."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), (F.col("p_size") % 4).cast("int").alias("page"), F.col("p_partkey").alias("block"), F.lit(0).alias("para"), F.lit(0.0).alias("x0"), F.lit(100.0).alias("x1"), (F.col("p_partkey") * 37 % 700).cast("double").alias("y0")).withColumn("y1", F.col("y0") + 10)
    boxes = p.select("doc_id", "page").distinct().where("page % 2 = 0").select("doc_id", "page", F.lit(50.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(90.0).alias("x1"), F.lit(300.0).alias("y1"))
    return layout.assembled(layout.clear_of(p, boxes)).select("doc_id", "page", "block", F.col("pos").cast("int").alias("pos"))


@query("list_items", f"""WITH c AS (SELECT conv_id, turn, turn % 3 AS k, 'The ' || role || ' said' AS t, 'words: ' || {_PLAIN} AS x FROM conversations)
SELECT conv_id, turn, t || CASE k WHEN 0 THEN ':' ELSE '' END AS title, x AS body, CASE k WHEN 1 THEN ' – ' ELSE ' ' END AS separator FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An italic title and a plain body after a colon, a dash or nothing."""
    run = lambda t, italic: F.struct(t.alias("text"), F.lit(False).alias("bold"), F.lit(italic).alias("italic"), F.lit(10.0).alias("size"))
    k = F.col("turn") % 3
    lead = F.when(k == 0, ": ").when(k == 1, " – ").otherwise(" ")
    c = table(spark, d, "conversations").withColumn("r", F.array(run(F.concat(F.lit("The "), "role", F.lit(" said")), True), run(F.concat(lead, F.lit("words: "), squash(F.col("text"))), False)))
    c = c.select("conv_id", "turn", layout.list_items(F.col("r")).alias("i"))
    return c.select("conv_id", "turn", "i.title", F.col("i.body")[0]["text"].alias("body"), "i.separator")


# ------------------------------------------------------------------------------------------------- checks and logs


@query("qa_report", f"""WITH {LINES}, s AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1), o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, length({_PLAIN}) AS n FROM lines)
SELECT s.doc_id, 'count' AS "check", 'body' AS place, 'body count mismatch: source=' || s.n::VARCHAR || ', output=' || coalesce(t.n, 0)::VARCHAR AS message FROM s LEFT JOIN s t ON t.doc_id = s.doc_id + 1 WHERE s.n <> coalesce(t.n, 0)
UNION ALL SELECT a.doc_id, 'body', a.i::VARCHAR, 'paragraph #' || a.i::VARCHAR || ' length ratio' FROM o a JOIN o b ON b.doc_id = a.doc_id + 1 AND a.i = b.i WHERE a.n >= 20 AND (b.n / a.n < 0.3 OR b.n / a.n > 3.0)
UNION ALL SELECT p_partkey, 'cell', '1/0/0', 'cell length ratio' FROM part WHERE length(p_name) >= 10 AND (p_size::DOUBLE / length(p_name) < 0.3 OR p_size::DOUBLE / length(p_name) > 3.0)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All findings of the check: documents against their successors, and cells, appended to a log and read back."""
    b = line_blocks(table(spark, d, "documents"))
    p = table(spark, d, "part")
    side = lambda c: p.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(1).alias("table_idx"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), c.alias("text"))
    path = folder_for(spark, "report")
    sinks.append_report(quality.report(b, next_doc(b), side(F.col("p_name")), side(F.repeat(F.lit("x"), F.col("p_size")))), path)
    back = spark.read.schema("doc_id string, check string, place string, message string, at string").json(path)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "check", "place", F.regexp_replace("message", r"ratio [0-9.]+$", "ratio").alias("message"))


@query("run_log", "SELECT r_name AS input, r_regionkey::BIGINT AS n, ['glossary', 'translate'] AS phases FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = folder_for(spark, "runs")
    for r in table(spark, d, "region").collect():  # one line a run
        sinks.append_log(spark, path, {"input": r["r_name"], "n": r["r_regionkey"], "phases": ["glossary", "translate"]})
    return spark.read.schema("input string, n long, phases array<string>").json(path)


@query("stage_snapshots", f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A stage's table written under the snapshot folder, and what goes on from there."""
    return sinks.snapshot(lines(spark, d).select("doc_id", "pos"), folder_for(spark, "shots"), "lines").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

