"""PDF files as tables: pages, what is painted on them, spans for the layout operators, pictures and rules.

A file is read once, into a row a page; pages are dealt anew, so that a long file is spread over tasks, and each page's content
is run on its own. Pieces of text become spans, lines and blocks by windows over a page. Coordinates are points from
the page's top left corner.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pdf_objects import DEEPEST, File, Font, Name, Operator, PdfError, Reader, Ref, Stream, font_of, picture
from .spool import kept

PAGES = "doc_id string, page int, width double, height double, content binary, resources binary, error string"
MARKS = "doc_id string, page int, idx int, kind string, text string, font string, size double, flags int, x0 double, y0 double, x1 double, y1 double, base double, image binary"
#: A gap of so many sizes between two pieces of a line is a space; a wider one, or a step back, starts a new line.
SPACE_GAP, LINE_GAP = 0.2, 2.5
#: Lines whose gap is over so many heights are in different blocks.
BLOCK_GAP = 0.6
#: Fonts, and sets of resources, that pages share and a file remembers.
REMEMBERED = 64
#: Ascent and descent of a line in sizes, where no font tells.
ASCENT, DESCENT = 0.8, 0.2


# ----------------------------------------------------------------------------------------------------- files to pages


class NoPages(Exception):
    """A file whose page tree has no pages."""


def _font(file: File, ref) -> Font:
    """A font, which pages share, is read once."""
    if not isinstance(ref, Ref):
        return font_of(file, ref)
    if ref not in file.fonts:
        if len(file.fonts) >= REMEMBERED:
            file.fonts.clear()
        file.fonts[ref] = font_of(file, ref)
    return file.fonts[ref]


def _resources(file: File, value, depth: int = 0) -> dict:
    """Fonts, pictures and forms by name, without references."""
    d = file.get(value) or {}
    out: dict = {"fonts": {n: _font(file, f) for n, f in (file.get(d.get("Font")) or {}).items()}, "images": {}, "forms": {}}
    for n, ref in (file.get(d.get("XObject")) or {}).items():
        s = file.get(ref)
        if not isinstance(s, Stream):
            continue
        if s.dict.get("Subtype") == "Image":
            out["images"][n] = picture(file, s)
        elif depth < 8:
            own = _resources(file, s.dict["Resources"], depth + 1) if "Resources" in s.dict else None
            out["forms"][n] = (file.decoded(s), own, file.get(s.dict.get("Matrix", [1, 0, 0, 1, 0, 0])))
    return out


def pages(files: DataFrame) -> DataFrame:
    """A row a page of the files (path, content), numbered from 0. A file that cannot be read gives one row with its error."""

    schema = pa.schema([("doc_id", pa.string()), ("page", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("content", pa.binary()), ("resources", pa.binary()), ("error", pa.string())])

    def one(path: str, data: bytes) -> Iterator[tuple]:
        file = File(data or b"")
        shared: dict = {}
        k = -1
        for k, p in enumerate(file.pages()):
            box = [float(file.get(x)) for x in file.get(p.get("CropBox") or p.get("MediaBox") or [0, 0, 612, 792])]
            key = repr(p.get("Resources"))
            if key not in shared:
                if len(shared) >= REMEMBERED:
                    shared.clear()
                shared[key] = pickle.dumps(_resources(file, p.get("Resources")))
            shift = b"1 0 0 1 %f %f cm " % (-min(box[0], box[2]), -min(box[1], box[3]))
            yield (path, k, abs(box[2] - box[0]), abs(box[3] - box[1]), shift + file.content(p["Contents"]), shared[key], None)
        if k < 0:
            raise NoPages

    def whole(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while own := list(islice(rows, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*own, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    yield from kept(whole(one(path, data.as_py())), schema)  # all or, where the file is damaged, nothing
                except Exception as x:  # any damage counts, and ends no run
                    error = "no pages" if isinstance(x, NoPages) else f"{type(x).__name__}: {x}"
                    yield from whole(iter([(path, None, None, None, None, None, error)]))

    return files.select("path", "content").mapInArrow(run, PAGES)


def failures(pages_: DataFrame) -> DataFrame:
    """(path, error) of the files that gave no pages."""
    return pages_.where("error is not null").select(F.col("doc_id").alias("path"), "error")


# ----------------------------------------------------------------------------------------------------- pages to marks

Matrix = tuple[float, float, float, float, float, float]


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


class Steps(dict):
    """How far a code moves the text on, by code; in one font and one state of the text, computed once a code."""

    def __init__(self, font: Font, size: float, char: float, word: float, wide: float):
        super().__init__()
        self.told = (font, size, char, word, wide)

    def __missing__(self, c: int) -> float:
        f, size, char, word, wide = self.told
        self[c] = step = (f.widths.get(c, f.width) * size + char + (word if c == 32 and f.code_bytes == 1 else 0)) * wide
        return step


class Painter:
    """Runs a page's content and notes what it paints: pieces of text, straight rules, whole drawings and pictures."""

    def __init__(self, height: float):
        self.height, self.marks = height, []
        self.steps: dict[tuple, Steps] = {}

    def _steps(self, f: Font, *state: float) -> Steps:
        key = (id(f), *state)
        if key not in self.steps:
            if len(self.steps) >= REMEMBERED:
                self.steps.clear()
            self.steps[key] = Steps(f, *state)
        return self.steps[key]

    def _box(self, m: Matrix, x0: float, y0: float, x1: float, y1: float) -> dict:
        xs, ys = zip(*(at(m, x, y) for x in (x0, x1) for y in (y0, y1)), strict=True)
        return {"x0": min(xs), "x1": max(xs), "y0": self.height - max(ys), "y1": self.height - min(ys)}

    def run(self, content: bytes, resources: dict, m: Matrix = (1, 0, 0, 1, 0, 0), depth: int = 0) -> None:
        read, operands = Reader(content, refs=False), []
        fonts, images, forms = resources["fonts"], resources["images"], resources["forms"]
        unknown = Font("")
        state = {"m": m, "font": unknown, "size": 0.0, "char": 0.0, "word": 0.0, "wide": 1.0, "lead": 0.0, "rise": 0.0}
        stack, text, line = [], m, m
        lines: list[tuple[float, float, float, float]] = []
        start = now = (0.0, 0.0)

        def show(s: bytes) -> None:
            nonlocal text
            f, size, wide = state["font"], state["size"], state["wide"]
            codes = f.codes(s)
            steps = self._steps(f, size, state["char"], state["word"], wide)
            width = reduce(add, map(steps.__getitem__, codes), 0.0)
            whole = times(text, state["m"])
            height = (whole[2] ** 2 + whole[3] ** 2) ** 0.5 * size
            box = self._box(whole, 0, state["rise"] - DESCENT * size, width, state["rise"] + ASCENT * size)
            said = "".join([f.text.get(c, "") for c in codes])
            if said:
                self.marks.append({"kind": "text", "text": said, "font": f.name, "size": height, "flags": f.flags, "base": self.height - at(whole, 0, 0)[1]} | box)
            text = times((1, 0, 0, 1, width, 0), text)

        def next_line(x: float, y: float) -> None:
            nonlocal text, line
            text = line = times((1, 0, 0, 1, x, y), line)

        def painted() -> None:
            if lines:
                boxes = [self._box(state["m"], *seg) for seg in lines]
                self.marks += [{"kind": "rule"} | b for b in boxes]
                self.marks.append({"kind": "drawing"} | {k: (min if k[1] == "0" else max)(b[k] for b in boxes) for k in ("x0", "y0", "x1", "y1")})
            lines.clear()

        while read.skip() < len(content):
            v = read.value()
            if not isinstance(v, Operator):
                operands.append(v)
                continue
            o, operands = operands, []
            n = [x for x in o if isinstance(x, int | float)]
            try:
                if v == b"q":
                    stack.append(dict(state))
                elif v == b"Q":
                    state = stack.pop() if stack else state
                elif v == b"cm":
                    state["m"] = times(tuple(n), state["m"])
                elif v == b"BT":
                    text = line = (1, 0, 0, 1, 0, 0)
                elif v == b"Tf":
                    state["font"], state["size"] = fonts.get(o[0], unknown), n[0]
                elif v in (b"Tc", b"Tw", b"TL", b"Ts"):
                    state[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise"}[bytes(v)]] = n[0]
                elif v == b"Tz":
                    state["wide"] = n[0] / 100
                elif v in (b"Td", b"TD"):
                    state["lead"] = -n[1] if v == b"TD" else state["lead"]
                    next_line(*n)
                elif v == b"Tm":
                    text = line = tuple(n)
                elif v == b"T*":
                    next_line(0, -state["lead"])
                elif v == b"Tj":
                    show(o[0])
                elif v in (b"'", b'"'):
                    if v == b'"':
                        state["word"], state["char"] = n
                    next_line(0, -state["lead"])
                    show(o[-1])
                elif v == b"TJ":
                    for x in o[0]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            text = times((1, 0, 0, 1, -x / 1000 * state["size"] * state["wide"], 0), text)
                elif v == b"m":
                    start = now = tuple(n)
                elif v == b"l":
                    lines.append((*now, *n))
                    now = tuple(n)
                elif v in (b"c", b"v", b"y"):
                    lines.append((*now, *n[-2:]))
                    now = tuple(n[-2:])
                elif v == b"h":
                    lines.append((*now, *start))
                    now = start
                elif v == b"re":
                    x, y, w, h = n
                    lines += [(x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)]
                    start = now = (x, y)
                elif v in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*"):
                    if v in (b"s", b"b", b"b*"):
                        lines.append((*now, *start))
                    painted()
                elif v == b"n":
                    lines.clear()
                elif v == b"Do" and o[0] in images:
                    self.marks.append({"kind": "image", "image": images[o[0]]} | self._box(state["m"], 0, 0, 1, 1))
                elif v == b"Do" and o[0] in forms and depth < DEEPEST:
                    inner, own, matrix = forms[o[0]]
                    self.run(inner, own or resources, times(tuple(matrix), state["m"]), depth + 8)
                elif v == b"ID":  # a picture inside the content ends at EI between white space
                    end = content.find(b"EI", read.at)
                    while end >= 0 and not (content[end - 1 : end].isspace() and content[end + 2 : end + 3] in (b"", b" ", b"\n", b"\r", b"\t")):
                        end = content.find(b"EI", end + 2)
                    read.at = len(content) if end < 0 else end + 2
                    self.marks.append({"kind": "image", "image": None} | self._box(state["m"], 0, 0, 1, 1))
            except (IndexError, TypeError, ValueError):  # an operator without its operands paints nothing
                continue


def marks(pages_: DataFrame) -> DataFrame:
    """What the pages paint, in order: kind text, rule (straight pieces of paths), drawing (whole paths) or image."""
    names = [c.split()[0] for c in MARKS.split(", ")]
    kinds = dict(zip(names, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), *[pa.float64()] * 5, pa.binary()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, page, height, content, resources in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                p = Painter(height)
                try:
                    p.run(content, pickle.loads(resources))
                except PdfError:  # what came before the damage stays
                    pass
                rows = [{"doc_id": doc, "page": page, "idx": k} | r for k, r in enumerate(p.marks)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[n]) for n in names], names)

    # as many tasks as shuffles have: pages are small, but running them is not
    n = int(pages_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pages_.where("error is null").repartition(n, F.col("doc_id"), F.col("page"))
    return spread.select("doc_id", "page", "height", "content", "resources").mapInArrow(run, MARKS)


# ----------------------------------------------------------------------------------------------------- marks to tables


def spans(marks_: DataFrame) -> DataFrame:
    """The span table (schema.SPANS): pieces of text of one format on one line, lines and blocks numbered within the page.

    A line goes on while the base line stays and the next piece neither steps back nor leaves a wide gap; small gaps
    become spaces. A block goes on while the next line is as near as lines are and overlaps in x.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("idx")
    was = lambda c: F.lag(c).over(page)
    t = marks_.where("kind = 'text'").drop("image", "kind")
    gap = F.col("x0") - was("x1")
    breaks = (F.abs(F.col("base") - was("base")) > F.least("size", was("size")) * 0.5) | (gap < -F.col("size")) | (gap > F.col("size") * LINE_GAP)
    t = t.withColumn("_gap", gap).withColumn("_line", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("_line", F.sum("_line").over(page))
    inside = Window.partitionBy("doc_id", "page", "_line").orderBy("idx")
    format_ = F.struct("font", F.round("size", 2), "flags")
    t = t.withColumn("_f", format_).withColumn("_new", F.coalesce(F.col("_f") != F.lag("_f").over(inside), F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(inside))
    touching = (F.lag("text").over(inside).rlike(r"\s$")) | F.col("text").rlike(r"^\s")
    spaced = F.when((F.col("_gap") > F.col("size") * SPACE_GAP) & ~touching & (F.row_number().over(inside) > 1), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    t = t.withColumn("text", spaced)
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    s = t.groupBy("doc_id", "page", "_line", "_span").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), *(F.first(c).alias(c) for c in ("size", "flags", "font")), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    # a line's box stands beside each of its spans, so that no second run over the marks finds it
    own_line = Window.partitionBy("doc_id", "page", "_line")
    s = s.withColumns({"ly0": F.min("y0").over(own_line), "ly1": F.max("y1").over(own_line), "lx0": F.min("x0").over(own_line), "lx1": F.max("x1").over(own_line)})
    down = Window.partitionBy("doc_id", "page").orderBy("_line", "_span")
    prev = lambda c: F.lag(c).over(down)
    height = F.greatest(F.col("ly1") - F.col("ly0"), prev("ly1") - prev("ly0"))
    apart = (F.col("ly0") - prev("ly1") > height * BLOCK_GAP) | (F.col("ly1") < prev("ly0")) | (F.col("lx0") > prev("lx1")) | (F.col("lx1") < prev("lx0"))
    starts = F.coalesce(F.col("_line") != prev("_line"), F.lit(True))
    s = s.withColumn("_b", (starts & F.coalesce(apart, F.lit(True))).cast("int")).withColumn("block", F.sum("_b").over(down))
    out = s.withColumn("line", F.dense_rank().over(Window.partitionBy("doc_id", "page", "block").orderBy("_line")) - 1)
    return out.select("doc_id", "page", (F.col("block") - 1).cast("int").alias("block"), F.col("line").cast("int").alias("line"), (F.col("_span") - 1).cast("int").alias("span"), "text", "size", "flags", "font", "x0", "y0", "x1", "y1")


def drawings(marks_: DataFrame) -> DataFrame:
    """(doc_id, page, draw_idx, x0, y0, x1, y1) of painted paths, for note_zones and image_regions."""
    return marks_.where("kind = 'drawing'").select("doc_id", "page", F.col("idx").alias("draw_idx"), "x0", "y0", "x1", "y1")


def images(marks_: DataFrame) -> DataFrame:
    """(doc_id, page, idx, x0, y0, x1, y1, image): pictures with their bytes, PNG or JPEG; null where the coding is not known."""
    return marks_.where("kind = 'image'").select("doc_id", "page", "idx", "x0", "y0", "x1", "y1", "image")


def rules(marks_: DataFrame) -> DataFrame:
    """(doc_id, page, idx, x0, y0, x1, y1) of straight rules, the edges of rectangles among them."""
    return marks_.where("kind = 'rule'").select("doc_id", "page", "idx", "x0", "y0", "x1", "y1")


def page_sizes(pages_: DataFrame) -> DataFrame:
    return pages_.where("error is null").select("doc_id", "page", "width", "height")
