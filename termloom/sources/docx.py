"""Word documents from their zipped XML, with the standard library only."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import stripped_length
from ..operators.numbering import resolved_numbers
from ..schema import BLOCKS
from .spool import kept

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Style names and markers that decide a paragraph's kind.
HEADING_STYLE = re.compile(r"Heading\s*(\d+)", re.I)
LIST_STYLE = re.compile(r"List\s+(Number|Bullet|Paragraph)", re.I)
LIST_START = re.compile(r"^\s*\d+[\.\)]\s+\S")
ITEM_START = re.compile(r"^\s*(?:[a-zA-Z]\)|\d+[\.\)])\s+\S")
KEY_CHARS = 40


class Docx:
    """One document's parts. numbers maps the first 40 characters of headings to their rendered numbers, if known."""

    def __init__(self, content: bytes | pa.Buffer, numbers: dict[str, str] | None = None):
        self.numbers = numbers or {}
        self.zip = z = zipfile.ZipFile(pa.BufferReader(content))
        part = lambda n: ElementTree.fromstring(z.read(n)) if n in z.NameToInfo else None
        self.styles = part("word/styles.xml")
        self.unread = {n for n in z.NameToInfo if n.startswith("word/media/")}
        self.targets = self._targets()
        self.notes, self.comments, self.numbering = part("word/footnotes.xml"), part("word/comments.xml"), part("word/numbering.xml")
        self.style_names = {s.get(f"{W}styleId"): (n.get(f"{W}val") or "") for s in (self.styles.iter(f"{W}style") if self.styles is not None else ()) if (n := s.find(f"{W}name")) is not None}
        based = lambda st: (b.get(f"{W}val") if (b := st.find(f"{W}basedOn")) is not None else None)
        self.style_props = {st.get(f"{W}styleId"): (st.find(f"{W}pPr"), based(st)) for st in (self.styles.iter(f"{W}style") if self.styles is not None else ())}
        self.note_numbers: dict[str, str] = {}

    # -- small parts

    def _targets(self) -> dict[str, str]:
        """The picture parts that relations lead to, read as a stream: there is one a picture."""
        out: dict[str, str] = {}
        name = "word/_rels/document.xml.rels"
        if name not in self.zip.NameToInfo:
            return out
        with self.zip.open(name) as source:
            depth, root = 0, None
            for event, e in ElementTree.iterparse(source, ("start", "end")):
                root = e if root is None else root
                depth += 1 if event == "start" else -1
                if event == "end" and depth == 1:
                    target = "word/" + (e.get("Target") or "")
                    if target in self.unread and e.get("Id") is not None:
                        out[e.get("Id")] = self.zip.NameToInfo[target].filename
                    root.clear()
        return out

    def footnotes(self) -> list[tuple[str, str]]:
        """(marker, text) of real notes with text, numbered 1, 2, ... in order."""
        out: list[tuple[str, str]] = []
        for n in self.notes.iter(f"{W}footnote") if self.notes is not None else ():
            text = _texts(n).strip()
            if text and n.get(f"{W}type") not in ("separator", "continuationSeparator"):
                self.note_numbers[n.get(f"{W}id") or ""] = str(len(out) + 1)
                out.append((str(len(out) + 1), text))
        return out

    def comment_rows(self, ranges: dict[str, tuple[int, list[str], bool]]) -> list[dict]:
        """Comments with text, by the place of their range in the body, those without a range last. ranges: place, texts, closed."""
        rows = []
        for c in self.comments.iter(f"{W}comment") if self.comments is not None else ():
            cid, text = c.get(f"{W}id") or "", _texts(c).strip()
            if text:
                at, inside, closed = ranges.get(cid, (float("inf"), [], False))
                rows.append((at, {"id": cid, "author": c.get(f"{W}author") or "", "date": c.get(f"{W}date") or "", "anchor": "".join(inside).strip() if closed else "", "text": text}))
        return [r for _, r in sorted(rows, key=lambda x: x[0])]

    def numbering_levels(self) -> list[dict]:
        """(num_id, abstract_id, level, fmt, template, start, restart) of every numbering definition."""
        if self.numbering is None:
            return []
        val = lambda e, tag, default: (x.get(f"{W}val") if (x := e.find(f"{W}{tag}")) is not None else default)
        shapes = {a.get(f"{W}abstractNumId"): a for a in self.numbering.iter(f"{W}abstractNum")}
        out = []
        for num in self.numbering.iter(f"{W}num"):
            abstract = val(num, "abstractNumId", None)
            restarts = {o.get(f"{W}ilvl"): int(val(o, "startOverride", "")) for o in num.iter(f"{W}lvlOverride") if val(o, "startOverride", "")}
            for lvl in shapes[abstract].iter(f"{W}lvl") if abstract in shapes else ():
                level = lvl.get(f"{W}ilvl") or "0"
                out.append({"num_id": num.get(f"{W}numId"), "abstract_id": abstract, "level": int(level), "fmt": val(lvl, "numFmt", "decimal"), "template": val(lvl, "lvlText", "%1."), "start": int(val(lvl, "start", "1")), "restart": restarts.get(level)})
        return out

    def list_place(self, p) -> tuple[str, int] | None:
        """(num_id, level) of a numbered paragraph, its own or its style's, the styles it is based on included."""
        props, level, seen = p.find(f"{W}pPr"), None, set()
        style = props.find(f"{W}pStyle").get(f"{W}val") if props is not None and props.find(f"{W}pStyle") is not None else None
        while True:
            num = props.find(f"{W}numPr") if props is not None else None
            own = {e.tag: e.get(f"{W}val") for e in num} if num is not None else {}
            level = own.get(f"{W}ilvl") if level is None else level
            if f"{W}numId" in own:
                return (own[f"{W}numId"], int(level or 0)) if own[f"{W}numId"] != "0" else None
            if style is None or style in seen:
                return None
            seen.add(style)
            props, style = self.style_props.get(style, (None, None))

    def pictures(self) -> list[tuple[bytes, float]]:
        """(bytes, width in inches) of the pictures in the body, in order."""
        return [x for what, x in self.walk() if what == "picture"]

    def picture(self, d) -> tuple[bytes, float] | None:
        size = next((e for e in d.iter() if e.tag.endswith("}extent")), None)
        blip = next((e for e in d.iter() if e.tag.endswith("}blip")), None)
        target = self.targets.get(next((v for k, v in blip.attrib.items() if k.endswith("}embed")), "")) if blip is not None else None
        if target is None:
            return None
        self.unread.discard(target)
        return self.zip.read(target), int(size.get("cx", 0)) / 914400 if size is not None else 0.0

    # -- paragraphs

    def runs(self, p) -> list[dict]:
        out: list[dict] = []
        for r in p.iter(f"{W}r"):
            text = ""
            for e in r:
                if e.tag == f"{W}t":
                    text += e.text or ""
                elif e.tag == f"{W}tab":
                    text += "\t"
                elif e.tag in (f"{W}br", f"{W}cr"):
                    text += "\n"
                elif e.tag == f"{W}footnoteReference":
                    nid = e.get(f"{W}id") or ""
                    text += f"‹FN{self.note_numbers.get(nid, nid)}›"
            if not text:
                continue
            pr = r.find(f"{W}rPr")
            size = pr.find(f"{W}sz") if pr is not None else None
            run = {"text": text, "bold": _on(pr, "b"), "italic": _on(pr, "i"), "size": float(size.get(f"{W}val")) / 2 if size is not None else 0.0}
            if out and all(out[-1][k] == run[k] for k in ("bold", "italic", "size")):
                out[-1]["text"] += text
            else:
                out.append(run)
        return out

    def numbered(self, runs: list[dict]) -> str:
        """Puts the known number of this text before its first run; returns it."""
        number = self.numbers.get("".join(r["text"] for r in runs)[:KEY_CHARS].strip(), "")
        if number:
            runs[0] = runs[0] | {"text": f"{number} {runs[0]['text']}"}
        return number

    def paragraph(self, p) -> dict | None:
        text = _texts(p)
        runs = self.runs(p)
        if not text.strip() or not runs:
            return None
        ppr = p.find(f"{W}pPr")
        style = ppr.find(f"{W}pStyle") if ppr is not None else None
        name = self.style_names.get(style.get(f"{W}val"), style.get(f"{W}val") or "").strip() if style is not None else ""
        heading = HEADING_STYLE.match(name)
        if heading:
            self.numbered(runs)
            return {"kind": "heading", "level": max(1, min(6, int(heading[1]))), "runs": runs, "place": self.list_place(p)}
        listed = LIST_STYLE.search(name) or (ppr is not None and ppr.find(f"{W}numPr") is not None) or LIST_START.match(text)
        if listed and ITEM_START.match(text):
            marker = text.split(None, 1)[0]
            return {"kind": "list_item", "title": marker, "runs": _without(runs, marker), "separator": " "}
        if listed and (number := self.numbered(runs)) and all(r["bold"] for r in runs if r["text"].strip()):
            return {"kind": "heading", "level": max(2, min(4, number.count(".") + 1)), "runs": runs}
        return {"kind": "body", "runs": runs, "place": self.list_place(p) if listed else None}

    # -- the whole

    def walk(self) -> Iterator[tuple[str, object]]:
        """("block", row), ("cell", (table, row, column, text)) and ("picture", (bytes, width)) in order: body blocks, then
        footnotes, then comments. The body is read as a stream, and what was read is let go: paragraphs, rows of tables, pictures."""
        notes = self.footnotes()
        stack: list = []
        top = tables = rows = place = 0
        table_at = row_at = drawing_at = 0  # depth of the outermost open element of the kind, 0 without
        ranges: dict[str, tuple[int, list[str], bool]] = {}
        opened: set[str] = set()
        has_body = False
        first: dict[int, bool] = {}  # whether the sdt of that depth still waits for its content
        with self.zip.open("word/document.xml") as source:
            for event, e in ElementTree.iterparse(source, ("start", "end")):
                if event == "start":
                    stack.append(e)
                    place += 1
                    n = len(stack)
                    has_body |= n == 2 and e.tag == f"{W}body"
                    if e.tag == f"{W}sdt" and n == 3:
                        first[n] = True
                    inside = n == 3 or (n == 5 and stack[2].tag == f"{W}sdt" and stack[3].tag == f"{W}sdtContent" and first.get(3, False))
                    if not top and inside and stack[1].tag == f"{W}body" and e.tag != f"{W}sdt":
                        top = n
                        if e.tag == f"{W}tbl":
                            tables, rows, table_at = tables + 1, 0, n
                            yield "block", {"kind": "table_ref", "table_index": tables}
                    if e.tag == f"{W}tr" and table_at and not row_at:
                        row_at = n
                    elif e.tag == f"{W}drawing" and not drawing_at:
                        drawing_at = n
                    elif e.tag == f"{W}commentRangeStart":
                        ranges[e.get(f"{W}id")] = (place, [], False)
                        opened.add(e.get(f"{W}id"))
                    elif e.tag == f"{W}commentRangeEnd" and e.get(f"{W}id") in opened:
                        at, said, _ = ranges[e.get(f"{W}id")]
                        ranges[e.get(f"{W}id")] = (at, said, True)
                        opened.discard(e.get(f"{W}id"))
                    continue
                n = len(stack)
                if e.tag == f"{W}t":
                    for c in opened:
                        ranges[c][1].append(e.text or "")
                if n == drawing_at:
                    drawing_at = 0
                    yield from (("picture", x) for d in e.iter(f"{W}drawing") if (x := self.picture(d)))
                if n == row_at:
                    row_at = 0
                    for tr in e.iter(f"{W}tr"):
                        yield from (("cell", (tables, rows, j, t)) for j, t in enumerate(_row(tr)))
                        rows += 1
                    del stack[-2][:]
                if n == top:
                    if e.tag == f"{W}p" and (b := self.paragraph(e)):
                        yield "block", b
                    top = table_at = 0
                    del stack[-2][:]
                elif n == 4 and e.tag == f"{W}sdtContent":
                    first[3] = False
                stack.pop()
        if not has_body:
            raise ValueError("no body")
        for n in self.unread:  # damage counts in pictures that are not shown, too
            self.zip.read(n)
        yield from (("block", {"kind": "footnote", "marker": m, "text": t}) for m, t in notes)
        yield from (("block", {"kind": "comment", "text": c.pop("text"), "comment": c}) for c in self.comment_rows(ranges))

    def extract(self) -> tuple[list[dict], list[tuple[int, int, int, str]]]:
        """(blocks in order, table cells): body blocks, then footnotes, then comments."""
        found = list(self.walk())
        return [x for what, x in found if what == "block"], [x for what, x in found if what == "cell"]


def _row(tr) -> list[str]:
    """A table row's texts; a cell that repeats the one before it is left out."""
    row: list[str] = []
    for tc in tr.iter(f"{W}tc"):
        text = "\n".join(_texts(p) for p in tc.iter(f"{W}p"))
        if not row or text != row[-1]:
            row.append(text)
    return row


def _texts(e) -> str:
    return "".join(t.text or "" for t in e.iter(f"{W}t"))


def _on(pr, tag: str) -> bool:
    e = pr.find(f"{W}{tag}") if pr is not None else None
    return e is not None and e.get(f"{W}val", "true") not in ("0", "false", "off")


def _without(runs: list[dict], marker: str) -> list[dict]:
    """The marker is the item's title, so its body begins after it."""
    rest = "".join(r["text"] for r in runs)
    skip = rest.index(marker) + len(marker)
    skip += len(rest[skip:]) - len(rest[skip:].lstrip())
    out = []
    for r in runs:
        cut = min(skip, len(r["text"]))
        skip -= cut
        if r["text"][cut:]:
            out.append(r | {"text": r["text"][cut:]})
    return out


_KINDS = {n: t for n, t in (c.split(" ", 1) for c in re.findall(r"\w+ (?:(?:array|struct)<.*?>+|\w+)(?=, |$)", BLOCKS)) if n != "doc_id"}
PARSED = f"doc_id string, blocks array<struct<{', '.join(f'{n}:{t}' for n, t in _KINDS.items())}>>, cells array<struct<table_idx:int, row_idx:int, col_idx:int, text:string>>, numbered array<struct<pos:int, num_id:string, level:int>>, levels array<struct<num_id:string, abstract_id:string, level:int, fmt:string, template:string, start:int, restart:int>>, pictures array<struct<k:int, image:binary, width_inches:double>>, error string"


#: Blocks, cells and pictures of a row of parsed().
PART_ITEMS = 2000


def parsed(files: DataFrame) -> DataFrame:
    """A file (path, content) as rows of at most PART_ITEMS of its blocks, table cells and pictures, or one row with the error
    it was not read for. Any damage counts."""

    def parts(path: str, content: pa.Buffer) -> Iterator[tuple]:
        file = Docx(content)
        levels = file.numbering_levels()
        part: dict[str, list] = {"block": [], "cell": [], "picture": []}
        count = {"block": 0, "picture": 0}

        def whole() -> tuple:
            rows = [{n: r.get(n) for n in _KINDS} | {"pos": i} for i, r in part["block"]]
            places = [{"pos": i, "num_id": r["place"][0], "level": r["place"][1]} for i, r in part["block"] if r.get("place")]
            cells = [dict(zip(("table_idx", "row_idx", "col_idx", "text"), c, strict=True)) for c in part["cell"]]
            pictures = [{"k": k, "image": x[0], "width_inches": x[1]} for k, x in part["picture"]]
            return path, rows, cells, places, levels, pictures, None

        for what, x in file.walk():
            part[what].append(x if what == "cell" else (count[what], x))
            if what != "cell":
                count[what] += 1
            if sum(map(len, part.values())) >= PART_ITEMS:
                yield whole()
                part, levels = {n: [] for n in part}, []
        yield whole()

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[tuple] = []  # files of one part go on together, as many as make up a part
        size = 0
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = parts(path, content.as_buffer())
                    own = list(islice(rows, 2))
                    if len(own) > 1:
                        yield from kept((batch([r]) for r in chain(own, rows)), schema)  # all or, where the file is damaged, nothing
                        continue
                except Exception as x:
                    own = [(path, [], [], [], [], [], f"{type(x).__name__}: {x}")]
                small += own
                # pictures may be large, so few of them go together
                size += 1 + len(own[0][1]) + len(own[0][2]) + 100 * len(own[0][5])
                if size >= PART_ITEMS:
                    yield batch(small)
                    small, size = [], 0
        if small:
            yield batch(small)

    schema = to_arrow_schema(StructType.fromDDL(PARSED))
    return files.select("path", "content").mapInArrow(run, PARSED)


def parsed_blocks(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", *[f"b.{n}" for n in _KINDS])


def parsed_numbers(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, number) of numbered headings and list paragraphs, counted here, without a renderer."""
    places = rows.select("doc_id", F.explode("numbered").alias("x")).select("doc_id", "x.*")
    levels = rows.select("doc_id", F.explode("levels").alias("x")).select("doc_id", "x.*")
    return resolved_numbers(places, levels)


def with_numbers(blocks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Blocks with their numbers before their text; a numbered list paragraph that is bold throughout is a heading."""
    x = blocks.join(numbers.withColumnRenamed("number", "_number"), ["doc_id", "pos"], "left")
    has = F.col("_number").isNotNull()
    head = F.transform("runs", lambda r, i: F.when(i == 0, F.struct(F.concat("_number", F.lit(" "), r["text"]).alias("text"), r["bold"].alias("bold"), r["italic"].alias("italic"), r["size"].alias("size"))).otherwise(r))
    strong = F.forall("runs", lambda r: r["bold"] | (stripped_length(r) == 0))
    risen = has & (F.col("kind") == "body") & strong
    dots = F.length("_number") - F.length(F.replace("_number", F.lit("."), F.lit("")))
    level = F.when(risen, F.greatest(F.lit(2), F.least(F.lit(4), dots + 1))).otherwise(F.col("level"))
    out = {"runs": F.when(has, head).otherwise(F.col("runs")), "level": level.cast("int"), "kind": F.when(risen, "heading").otherwise(F.col("kind"))}
    return x.select(*[(out[c] if c in out else F.col(c)).alias(c) for c in blocks.columns])


def parsed_pictures(rows: DataFrame) -> DataFrame:
    """(doc_id, k, image, width_inches) of the pictures of Word files, which are no blocks."""
    return rows.select("doc_id", F.explode("pictures").alias("p")).select("doc_id", "p.*")


def parsed_cells(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.explode("cells").alias("c")).select("doc_id", "c.*")


def parsed_failures(rows: DataFrame) -> DataFrame:
    """(path, error) of files that could not be read: a document's failure never ends a batch."""
    return rows.where("error is not null").select(F.col("doc_id").alias("path"), "error")


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of a binaryFile DataFrame of .docx files; files that cannot be read give no blocks (see failures)."""
    return parsed_blocks(parsed(files))


def read_cells(files: DataFrame) -> DataFrame:
    return parsed_cells(parsed(files))


def failures(files: DataFrame) -> DataFrame:
    return parsed_failures(parsed(files))


def heading_numbers(rendered: DataFrame, doc: str = "doc_id", line: str = "line") -> DataFrame:
    """(doc_id, key, number) from a document's rendered text lines: the first 40 characters of numbered lines, first wins.

    The renderer is external (an office suite); its text is an input here.
    """
    number = F.regexp_extract(line, r"(?U)^\s*(\d+(?:\.\d+)*\.)\s+", 1)
    rest = F.regexp_replace(F.regexp_replace(line, r"(?U)^\s*\d+(?:\.\d+)*\.\s+", ""), r"\t\d*$", "")
    key = F.regexp_replace(F.substring(F.trim(rest), 1, KEY_CHARS), r"(?U)^\s+|\s+$", "")
    x = rendered.withColumn("number", number).withColumn("key", key).where("number <> '' and key <> ''")
    return x.groupBy(doc, "key").agg(F.min_by("number", "line_no").alias("number"))
