"""PDF files: what a writer puts in comes back; hand-written files with other forms of the same things; damage."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from termloom.sources import pdf, pdf_objects, pdf_write


def rows_of(spark, texts):
    return spark.createDataFrame([("d", *(float(v) if k in range(5, 10) else v for k, v in enumerate(r))) for r in texts], "doc_id string, " + pdf_write.MARK)


def text(page, seq, said, x, y, size=10.0, bold=False):
    return (page, seq, "text", said, bold, size, x, y, 0.0, 0.0, None)


def files(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "path string, content binary")


def plain_pdf(content, resources=b"<< /Font << /F1 4 0 R >> >>", more=b"", filter_=b"", page=b""):
    """A file whose objects have no table of places."""
    return b"".join([
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] /Resources ", resources, b" >> endobj\n",
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R ", page, b">> endobj\n4 0 obj << /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Times-Bold /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi /uni4E2D] >> /FirstChar 32 /Widths [250] >> endobj\n",
        b"5 0 obj << /Length %d %s >> stream\n" % (len(content), filter_), content, b"\nendstream endobj\n", more, b"trailer << /Root 1 0 R >>",
    ])


@pytest.mark.parametrize("packed", [False, True])
def test_written_files_come_back(spark, packed):
    texts = [text(0, 0, "Título", 72, 80, 16.0, True), text(0, 1, "uno y dos", 72, 100), text(0, 2, "𝄞 中文 ﬁn", 72, 112), text(2, 0, "far", 300, 700)]
    got = pdf.marks(pdf.pages(pdf_write.pdf_documents(rows_of(spark, texts), packed))).collect()
    assert [(r["page"], r["text"], r["font"], round(r["size"], 3), round(r["x0"], 3), round(r["base"], 3)) for r in sorted(got, key=lambda r: (r["page"], r["idx"]))] == [
        (0, "Título", "Body-Bold", 16.0, 72.0, 80.0), (0, "uno y dos", "Body", 10.0, 72.0, 100.0), (0, "𝄞 中文 ﬁn", "Body", 10.0, 72.0, 112.0), (2, "far", "Body", 10.0, 300.0, 700.0),
    ]


def test_spans_lines_and_blocks(spark):
    texts = [text(0, 0, "a ", 72, 100), text(0, 1, "b", 82, 100, 10.0, True), text(0, 2, "c", 95, 100), text(0, 3, "next", 72, 112), text(0, 4, "far below", 72, 200), text(0, 5, "beside", 300, 200)]
    got = pdf.spans(pdf.marks(pdf.pages(pdf_write.pdf_documents(rows_of(spark, texts))))).orderBy("block", "line", "span").collect()
    assert [(r["block"], r["line"], r["span"], r["text"]) for r in got] == [(0, 0, 0, "a "), (0, 0, 1, "b"), (0, 0, 2, " c"), (0, 1, 0, "next"), (1, 0, 0, "far below"), (2, 0, 0, "beside")]
    assert all(r["y1"] > r["y0"] and r["x1"] > r["x0"] for r in got)


def test_operators_and_fonts(spark):
    content = rb"""q .5 0 0 .5 10 20 cm BT /F1 20 Tf 12 TL 10 50 Td (A\(b\)\\\101\012) Tj 0 -30 TD [(x) -2000 (y)] TJ T* <010203> Tj (z) ' 1 2 (w) " ET Q
% a comment
BT /F1 8 Tf 1 0 0 1 5 5 Tm /Missing 3 Tf (gone) Tj ET 10 10 50 20 re S 0 0 m 9 0 l 9 9 l s 1 1 m 2 2 l n ( unfinished"""
    got = pdf.marks(pdf.pages(files(spark, a=plain_pdf(content)))).orderBy("idx").collect()
    said = [r for r in got if r["kind"] == "text"]
    assert [r["text"] for r in said] == ["A(b)\\A", "x", "y", "éfi中", "z", "w"]
    assert said[0]["font"] == "Times-Bold" and said[0]["size"] == pytest.approx(10) and said[0]["x0"] == pytest.approx(15) and said[0]["base"] == pytest.approx(100 - 45)
    assert said[2]["x0"] - said[1]["x1"] == pytest.approx(20)
    assert said[3]["base"] - said[1]["base"] == pytest.approx(15)  # TD has set the leading to 30
    assert [r["kind"] for r in got if r["kind"] != "text"] == ["rule"] * 4 + ["drawing"] + ["rule"] * 3 + ["drawing"]


def test_forms_filters_and_updates(spark):
    form = b"6 0 obj << /Type /XObject /Subtype /Form /Matrix [2 0 0 2 0 0] /Length 40 >> stream\nBT /F1 5 Tf 1 0 0 1 10 10 Tm (in) Tj ET    \nendstream endobj\n"
    res = b"<< /Font << /F1 4 0 R >> /XObject << /X 6 0 R >> >>"
    hexed = plain_pdf(b"/X Do".hex().encode() + b">", res, form, b"/Filter /ASCIIHexDecode")
    flate = zlib.compress(b"BT /F1 5 Tf (old) Tj ET")
    updated = plain_pdf(flate, filter_=b"/Filter [/FlateDecode]") + b"\n5 0 obj << /Length 99 >> stream\nBT /F1 5 Tf (new) Tj ET\nendstream endobj"
    got = {r["doc_id"]: (r["text"], round(r["size"], 2), round(r["x0"], 2)) for r in pdf.marks(pdf.pages(files(spark, hexed=hexed, updated=updated))).collect()}
    assert got == {"hexed": ("in", 10.0, 20.0), "updated": ("new", 5.0, 0.0)}


def test_failures(spark):
    good = plain_pdf(b"BT /F1 5 Tf (x) Tj ET")
    cases = {
        "good": good, "empty": b"", "text": b"no pdf", "locked": good + b"trailer << /Encrypt << >> >>", "cut": good[: good.index(b"endstream") - 20],
        "nested": b"%PDF-1.4 1 0 obj " + b"[" * 100, "odd_filter": plain_pdf(b"x", filter_=b"/Filter /Crypt"), "loop": good.replace(b"/Kids [3 0 R]", b"/Kids [2 0 R]"),
    }
    p = pdf.pages(files(spark, **cases))
    bad = {r["path"]: r["error"] for r in pdf.failures(p).collect()}
    assert set(bad) == set(cases) - {"good"} and "encrypted" in bad["locked"]
    assert [r["text"] for r in pdf.marks(p).collect()] == ["x"]


def unpng(b):
    """(width, height, colour type, pixels) of a PNG file, checksums verified."""
    at, body, head = 8, b"", None
    while at < len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        data = b[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", b, at + 8 + n)[0] == zlib.crc32(kind + data)
        head = data if kind == b"IHDR" else head
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    w, h, _, kind = struct.unpack_from(">IIBB", head)
    n, lines = 1 if kind == 0 else 3, zlib.decompress(body)
    return w, h, kind, b"".join(lines[k * (w * n + 1) + 1 : (k + 1) * (w * n + 1)] for k in range(h))


def test_pictures(spark):
    pixels = bytes(range(2 * 3 * 3))
    rows = rows_of(spark, [(0, 0, "image", None, False, 0.0, 100.0, 50.0, 80.0, 60.0, b"2 3 3\n" + pixels)])
    got = pdf.images(pdf.marks(pdf.pages(pdf_write.pdf_documents(rows)))).first()
    assert unpng(got["image"]) == (2, 3, 2, pixels) and [round(got[k], 2) for k in ("x0", "y0", "x1", "y1")] == [100, 50, 180, 110]
    file = pdf_objects.File(plain_pdf(b""))
    make = lambda raw, **d: pdf_objects.picture(file, pdf_objects.Stream(d, raw))
    n = pdf_objects.Name
    assert unpng(make(b"\xa0", Width=3, Height=1, BitsPerComponent=1, ColorSpace=n("DeviceGray")))[3] == b"\xff\0\xff"
    assert unpng(make(b"\x01\x00", Width=2, Height=1, BitsPerComponent=8, ColorSpace=[n("Indexed"), n("DeviceRGB"), 1, b"abcdef"]))[3] == b"defabc"
    assert unpng(make(b"\0\0\0\xff\0\xff\xff\0", Width=2, Height=1, BitsPerComponent=8, ColorSpace=n("DeviceCMYK")))[3] == b"\0\0\0\xff\0\0"
    rows = zlib.compress(b"\x02" + bytes([5, 6]) + b"\x01" + bytes([1, 1]))  # up, then left
    assert unpng(make(rows, Width=2, Height=2, BitsPerComponent=8, ColorSpace=n("DeviceGray"), Filter=n("FlateDecode"), DecodeParms={"Predictor": 15, "Columns": 2}))[3] == bytes([5, 6, 1, 2])
    assert make(b"\xff\xd8jpeg", Width=1, Height=1, Filter=n("DCTDecode")) == b"\xff\xd8jpeg" and make(b"", Width=1, Height=1, ColorSpace=n("Lab")) is None


def test_faces():
    """Merged cells, double rules, two tables, a frame alone, gaps in a rule, dangling ends, nothing."""
    import numpy as np

    from termloom.operators import tables

    def found(*segments):
        return tables.faces(*np.array(segments, dtype=float).reshape(-1, 4).T)

    def box(x, y, w, h):
        return [(x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)]

    grid = [*box(0, 0, 50, 20), *box(50, 0, 50, 20), *box(0, 20, 100, 20)]
    assert found(*grid) == [(0, 0, 0, 0, 0, 50, 20), (0, 0, 1, 50, 0, 100, 20), (0, 1, 0, 0, 20, 100, 40)]
    moved = [*grid, *[(a + 200, b + 1, c + 200, d + 1) for a, b, c, d in grid]]
    assert [f[:3] for f in found(*moved)] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 0, 1), (1, 1, 0)]
    assert found(*box(0, 0, 50, 20)) == [] and found() == [] and found((0, 0, 9, 0)) == []
    doubled = [*box(0, 0, 50, 20), *box(51.5, 0, 48.5, 20)]
    assert len(found(*doubled)) == 2
    lattice = [(0, y, 90, y) for y in (0, 30, 60)] + [(x, 0, x, 60) for x in (0, 30, 60, 90)]
    assert len(found(*lattice)) == 6 and len(found(*lattice, (30, 45, 55, 45))) == 6
    open_side = [s for s in lattice if s != (90, 0, 90, 60)]
    assert len(found(*open_side)) == 4
    pieces = [(0, 0, 45, 0), (44, 0, 90, 0), *[s for s in lattice if s[1] != 0 or s[3] != 0]]
    assert len(found(*pieces)) == 6


def test_whole_documents(spark):
    """Headings, paragraphs, a table, a picture and a footnote of a file come out as blocks in order; a broken file is listed."""
    from termloom.plans.pdf_documents import document_blocks

    body = [text(0, 0, "Título mayor", 72, 60, 18.0)]
    body += [text(0, 1 + k, f"Una línea larga del cuerpo número {k} que sigue", 72, 90 + 12 * k) for k in range(3)]
    table = [(0, 20 + k, "box", None, False, 0.0, 72.0 + 100 * (k % 2), 200.0 + 20 * (k // 2), 100.0, 20.0, None) for k in range(4)]
    table += [text(0, 30 + k, f"c{k}", 76.0 + 100 * (k % 2), 214.0 + 20 * (k // 2)) for k in range(4)]
    picture = [(0, 50, "image", None, False, 0.0, 72.0, 300.0, 144.0, 60.0, b"1 1 1\nx")]
    notes = [(0, 60, "rule", None, False, 0.0, 72.0, 600.0, 100.0, 0.0, None), text(0, 61, "1 Nota al pie", 72, 620, 7.0)]
    more = [text(1, 70, "y termina aquí.", 72, 60)]
    made = pdf_write.pdf_documents(rows_of(spark, body + table + picture + notes + more))
    blocks, cells, bad = document_blocks(made.unionByName(files(spark, broken=b"x")))
    got = blocks.orderBy("pos").collect()
    assert [r["kind"] for r in got] == ["heading", "body", "table_ref", "image", "footnote", "body"] and [r["pos"] for r in got] == list(range(6))
    assert "".join(x["text"] for x in got[0]["runs"]) == "Título mayor" and got[0]["level"] == 1 and got[2]["table_index"] == 1
    assert got[3]["width_inches"] == 2.0 and unpng(got[3]["image"])[3] == b"x" and (got[4]["marker"], got[4]["text"]) == ("1", "Nota al pie")
    assert sorted((r["row_idx"], r["col_idx"], r["text"]) for r in cells.collect()) == [(0, 0, "c0"), (0, 1, "c1"), (1, 0, "c2"), (1, 1, "c3")]
    assert [r["path"] for r in bad.collect()] == ["broken"]
    assert F is not None
