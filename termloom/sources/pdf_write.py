"""PDF files from tables of texts, rules and pictures: what the reader's tests and queries read back."""

from __future__ import annotations

import io
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "page int, seq int, kind string, text string, bold boolean, size double, x double, y double, w double, h double, image binary"
#: Objects of an object stream.
PACKED = 500


class Writer:
    """Puts objects into the file as they come; text is written in codes of a font of its own, with the map back to Unicode.

    packed: objects without streams go inside object streams, PACKED at a time, as from PDF 1.5 on.
    """

    def __init__(self, packed: bool = False):
        self.out, self.packed = io.BytesIO(), packed
        self.out.write(b"%PDF-1.5\n")
        self.places = array("q", [0])  # where each object begins, 0 inside an object stream
        self.plain: list[tuple[int, bytes]] = []

    def reserved(self) -> int:
        """The number of an object that comes later."""
        self.places.append(0)
        return len(self.places) - 1

    def add(self, body: bytes, number: int | None = None) -> int:
        number = number or self.reserved()
        if self.packed and not body.endswith(b"endstream"):
            self.plain.append((number, body + b"\n"))
            if len(self.plain) >= PACKED:
                self._pack()
        else:
            self.places[number] = self.out.tell()
            self.out.write(b"%d 0 obj\n" % number + body + b"\nendobj\n")
        return number

    def stream(self, data: bytes, more: bytes = b"", number: int | None = None) -> int:
        data = zlib.compress(data)
        return self.add(b"<< /Length %d /Filter /FlateDecode %s>>\nstream\n" % (len(data), more) + data + b"\nendstream", number)

    def _pack(self) -> None:
        at = [0, *accumulate(len(b) for _, b in self.plain)]
        first = b" ".join(b"%d %d" % (k, i) for (k, _), i in zip(self.plain, at, strict=False)) + b"\n"
        self.stream(first + b"".join(b for _, b in self.plain), b"/Type /ObjStm /N %d /First %d " % (len(self.plain), len(first)))
        self.plain = []

    def file(self, root: int) -> bytes:
        """The whole, with a table of places at its end."""
        if self.plain:
            self._pack()
        at = self.out.tell()
        self.out.write(b"xref\n0 %d\n0000000000 65535 f \n" % len(self.places))
        for place in self.places[1:]:
            self.out.write(b"%010d 00000 n \n" % place if place else b"0000000000 00000 f \n")
        self.out.write(b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(self.places), root, at))
        return self.out.getvalue()


def _to_unicode(chars: list[str]) -> bytes:
    rows = [b"<%04x> <%s>" % (k, c.encode("utf-16-be").hex().encode()) for k, c in enumerate(chars)]
    parts = [b"%d beginbfchar\n" % len(rows[i : i + 100]) + b"\n".join(rows[i : i + 100]) + b"\nendbfchar\n" for i in range(0, len(rows), 100)]
    return b"/CIDInit /ProcSet findresource begin\nbegincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + b"".join(parts) + b"endcmap\nend"


def document(rows: Iterable[dict], width: float = 612, height: float = 792, packed: bool = False) -> bytes:
    """One file, written a page at a time. rows: as MARK says, by page and seq; y is the base line of texts or the top of boxes,
    from the page's top left corner."""
    w = Writer(packed)
    code: dict[str, bytes] = {}
    fonts = []
    cmap = w.reserved()
    for name in (b"Body", b"Body-Bold"):
        about = w.add(b"<< /Type /FontDescriptor /FontName /%s /Flags 4 >>" % name)
        inner = w.add(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /%s /DW 500 /FontDescriptor %d 0 R >>" % (name, about))
        fonts.append(w.add(b"<< /Type /Font /Subtype /Type0 /BaseFont /%s /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (name, inner, cmap)))
    kids, tree = array("q"), w.reserved()

    def put(own: Iterable[dict]) -> None:
        out, pictures = [], []
        for r in own:
            x, y = r["x"], height - r["y"]
            if r["kind"] == "text":
                for c in r["text"]:
                    if c not in code:
                        code[c] = b"%04x" % len(code)
                out.append(b"BT /F%d %g Tf 1 0 0 1 %g %g Tm <%s> Tj ET" % (1 if r["bold"] else 0, r["size"], x, y, b"".join(map(code.__getitem__, r["text"]))))
            elif r["kind"] == "rule":
                out.append(b"%g %g m %g %g l S" % (x, y, x + r["w"], y - r["h"]))
            elif r["kind"] == "box":
                out.append(b"%g %g %g %g re S" % (x, y - r["h"], r["w"], r["h"]))
            else:
                head, pixels = r["image"].split(b"\n", 1)  # width, height, channels, then the pixels
                wide, high, n = map(int, head.split())
                k = w.stream(pixels, b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace /%s " % (wide, high, b"DeviceGray" if n == 1 else b"DeviceRGB"))
                pictures.append(b"/I%d %d 0 R" % (k, k))
                out.append(b"q %g 0 0 %g %g %g cm /I%d Do Q" % (r["w"], r["h"], x, y - r["h"], k))
        content = w.stream(b"\n".join(out))
        kids.append(w.add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %g %g] /Contents %d 0 R /Resources << /Font << /F0 %d 0 R /F1 %d 0 R >> /XObject << %s >> >> >>" % (tree, width, height, content, *fonts, b" ".join(pictures))))

    for page, own in groupby(rows, key=lambda r: r["page"]):
        while len(kids) < page:
            put(())
        if page >= 0:
            put(own)
    if not kids:
        put(())
    w.stream(_to_unicode(list(code)), number=cmap)
    w.add(b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids)), tree)
    return w.file(w.add(b"<< /Type /Catalog /Pages %d 0 R >>" % tree))


def pdf_documents(rows: DataFrame, packed: bool = False) -> DataFrame:
    """(path, content): a file a doc_id from rows of doc_id and the columns of MARK. A document's rows meet in one task, as its
    file does: sorted, one after the other, so that the task holds a page and the file so far."""
    names = [c.split()[0] for c in MARK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    yield from zip(*(c.slice(lo, 1000).to_pylist() for c in b.columns), strict=True)

        for doc, own in groupby(stream(), key=lambda r: r[0]):
            content = document((dict(zip(names, r[1:], strict=True)) for r in own), packed=packed)
            yield pa.RecordBatch.from_arrays([pa.array([str(doc)]), pa.array([content], pa.binary())], ["path", "content"])

    # dealt by a hash of the id, as Word files are
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("doc_id", *names).repartition(n, F.xxhash64("doc_id")).sortWithinPartitions("doc_id", *names)
    return placed.mapInArrow(run, "path string, content binary")
