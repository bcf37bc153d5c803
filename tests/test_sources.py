"""Word files, folders, sinks and the two phases end to end, with stand-ins for the models."""

import io
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from termloom import catalogue
from termloom.operators import docmodel, glossary, guards
from termloom.plans import translate
from termloom.sources import docx, files, sinks
from termloom.streaming.incremental import incrementally

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(*runs, style="", numbered=False):
    pr = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if numbered else "")
    return f"<w:p><w:pPr>{pr}</w:pPr>{''.join(runs)}</w:p>"


def r(text, bold=False, italic=False, note=None):
    pr = ("<w:b/>" if bold else "") + ('<w:i w:val="0"/>' if not italic else "<w:i/>")
    return f'<w:r><w:rPr>{pr}<w:sz w:val="22"/></w:rPr><w:t xml:space="preserve">{text}</w:t>' + (f'<w:footnoteReference w:id="{note}"/>' if note else "") + "</w:r>"


def word_file(body):
    parts = {
        "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="LP"><w:name w:val="List Paragraph"/></w:style></w:styles>',
        "word/footnotes.xml": f'<w:footnotes {NS}><w:footnote w:id="0" w:type="separator"><w:p><w:r><w:t>x</w:t></w:r></w:p></w:footnote><w:footnote w:id="5"><w:p><w:r><w:t>The note.</w:t></w:r></w:p></w:footnote></w:footnotes>',
        "word/comments.xml": f'<w:comments {NS}><w:comment w:id="2" w:author="B"><w:p><w:r><w:t>late</w:t></w:r></w:p></w:comment><w:comment w:id="1" w:author="A" w:date="2020-01-01"><w:p><w:r><w:t>early</w:t></w:r></w:p></w:comment><w:comment w:id="3"><w:p/></w:comment></w:comments>',
        "word/numbering.xml": f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


BODY = (
    paragraph(r("Title"), style="H1")
    + paragraph(r("Hello "), r("bold", bold=True), r(" text", note=5))
    + "<w:p/>"
    + paragraph(r("1. First point"), style="LP")
    + paragraph(r("Auto", bold=True), style="LP")
    + '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>word cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    + f'<w:sdt><w:sdtContent>{paragraph(r("Wrapped"))}</w:sdtContent></w:sdt>'
    + '<w:p><w:commentRangeStart w:id="1"/><w:r><w:t>anchor</w:t></w:r><w:commentRangeEnd w:id="1"/></w:p>'
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docs")
    (path / "b.docx").write_bytes(word_file(BODY))
    (path / "a.DOCX").write_bytes(b"broken")
    (path / "c.txt").write_text("no")
    return str(path)


def test_word_files(spark, folder):
    found = files.folder(spark, folder)
    assert [p["path"].rsplit("/", 1)[1] for p in files.by_path(found).collect()] == ["a.DOCX", "b.docx"]
    blocks, cells, _ = files.extracted(found)
    b = blocks.orderBy("pos").collect()
    assert [x["kind"] for x in b] == ["heading", "body", "list_item", "body", "table_ref", "body", "body", "footnote", "comment", "comment"]
    assert b[0]["level"] == 1 and b[2]["title"] == "1." and b[2]["runs"][0]["text"] == "First point"
    assert [(x["text"], x["bold"], x["size"]) for x in b[1]["runs"]] == [("Hello ", False, 11.0), ("bold", True, 11.0), (" text‹FN1›", False, 11.0)]
    assert [x["text"] for x in b[8:]] == ["early", "late"] and b[8]["comment"]["anchor"] == "anchor" and (b[7]["marker"], b[7]["text"]) == ("1", "The note.")
    assert [(c["col_idx"], c["text"]) for c in cells.orderBy("col_idx").collect()] == [(0, "a"), (1, "word cell")]
    assert [f["path"].rsplit("/", 1)[1] for f in docx.failures(found).collect()] == ["a.DOCX"]


def test_heading_numbers():
    d = docx.Docx(word_file(BODY), {"Auto": "2.1."})
    blocks, _ = d.extract()
    assert (blocks[3]["kind"], blocks[3]["level"], blocks[3]["runs"][0]["text"]) == ("heading", 3, "2.1. Auto")
    assert d.numbering_levels() == [{"num_id": "1", "abstract_id": "7", "level": 0, "fmt": "lowerLetter", "template": "%1)", "start": 3, "restart": None}]


def test_rendered_numbers(spark):
    rows = [("d", 0, "1. Intro\t3"), ("d", 1, " 1.2. Part two "), ("d", 2, "9. Intro"), ("d", 3, "plain")]
    got = {r["key"]: r["number"] for r in docx.heading_numbers(spark.createDataFrame(rows, "doc_id string, line_no int, line string")).collect()}
    assert got == {"Intro": "1.", "Part two": "1.2."}


def test_pdf_is_listed_and_ends_nothing(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.dOcX").write_bytes(word_file(BODY))
    found = files.folder(spark, str(tmp_path))
    blocks, _, bad = files.extracted(found)
    assert blocks.select("doc_id").distinct().count() == 1 and [r["path"][-5:] for r in bad.collect()] == ["x.pdf"]


def test_sinks(spark, folder, tmp_path):
    blocks, cells, _ = files.extracted(files.folder(spark, folder))
    text = docmodel.block_text(blocks)
    assert sinks.markdown_documents(text).first()["content"].startswith("# Title\n\nHello **bold** text‹FN1›\n\n- *1.* First point")
    padded = sinks.padded_cells(cells.withColumn("translated", F.upper("text"))).first()
    assert padded["cells"] == ["A", "WORD CELL"]
    notes = text.select("doc_id", "pos", F.upper("text").alias("translated"))
    assert sinks.notes_table(blocks, notes).first()["translated"] == "THE NOTE." and sinks.comments_table(blocks, notes).count() == 2
    for k in range(2):
        sinks.append_log(spark, f"{tmp_path}/log", {"run": k})
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    sinks.write_lines(spark, ["KEEP: a", "PREFER: b"], f"{tmp_path}/g")
    assert [e.kind for e in glossary.coerce(spark, f"{tmp_path}/g")] == ["verbatim", "prefer"]
    assert sinks.snapshot(cells, f"{tmp_path}/s", "cells").count() == 2 and sinks.snapshot(cells, None, "x") is cells


def identify(segments):
    return ["KEEP: data_x\nTERM: Corte Suprema | la Corte\nTERM: invented thing" for _ in segments]


def to_target(names, contexts):
    return [f"T:{n}" for n in names]


def test_phase_one(spark):
    rows = [("d1", "La Corte Suprema usa data_x.\nVer www.site.org aquí. La Corte dice."), ("d2", "nada")]
    blocks = files.line_blocks(spark.createDataFrame(rows, "doc_id string, text string"))
    got = translate.extracted_terms(blocks, identify, to_target, translate.keeper(spark)).orderBy("entry_idx").collect()
    assert [(e["doc_id"], e["source_terms"], e["target"], e["kind"]) for e in got] == [("d1", ["data_x"], "data_x", "verbatim"), ("d1", ["Corte Suprema", "la Corte"], "T:Corte Suprema", "require")]
    assert {(e["target"]) for e in translate.symbolic_entries(blocks).collect()} == {"site.org", "data_x"}


def test_phase_two(spark, folder):
    blocks, cells, _ = files.extracted(files.folder(spark, folder))
    blocks, cells = blocks.checkpoint(), cells.checkpoint()
    out = translate.run(blocks, cells, guards.Dictionary({"Hello": "Hola", "word cell": "celda", "First": "Primer"}), [glossary.Entry(["title"], "Title")])
    done = {r["pos"]: r for r in out["blocks"].collect()}
    assert done[1]["translated"] == "Hola **bold** text‹FN1›" and done[0]["translated"] == "Title"
    assert done[2]["title_translated"] == "1." and done[2]["translated"] == "Primer point"
    assert sorted(r["translated"] for r in out["cells"].collect()) == ["a", "celda"]
    assert out["check"].count() == 0 and out["stats"].first()["n_footnote"] == 1


class Garbled:
    """Loses the tags of chunks, so that each piece is asked for again on its own."""

    def __call__(self, prompts, texts, budgets, temperature, seed):
        return [t.replace("[0]", "").replace("[1]", "").replace("[2]", "") if t.startswith("[0]") else t.upper() for t in texts]


def test_pieces_that_do_not_fit_are_translated_alone(spark):
    blocks = files.line_blocks(spark.createDataFrame([("d", "one line\ntwo line\nthree line\nfour line")], "doc_id string, text string"))
    got = translate.translated_blocks(blocks, Garbled(), None, translate.keeper(spark)).orderBy("pos").collect()
    assert [r["translated"] for r in got] == ["ONE LINE", "TWO LINE", "THREE LINE", "FOUR LINE"]


def test_incremental_folder(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("d", "a\nb")], "doc_id string, text string").write.mode("append").parquet(source)
    go = lambda: incrementally(spark, source, "doc_id string, text string", files.line_blocks, target, f"{tmp_path}/check").awaitTermination()
    go()
    spark.createDataFrame([("e", "c")], "doc_id string, text string").write.mode("append").parquet(source)
    go()
    assert spark.read.parquet(target).count() == 3


def test_catalogue(spark):
    import duckdb

    sql, queries = catalogue.oracle_sql(), catalogue.queries()
    assert set(sql) <= set(queries) and len(queries) > 55
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "nation", "region", "part", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name in ("greedy_chunks", "glossary_live_entries", "glossary_violations", "marker_sentence_map", "run_consolidate", "paragraph_islands"):
        got = queries[name](spark, "/root/testdata/sf0.001")
        want = con.execute(sql[name])
        cols = [c[0] for c in want.description]
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(repr, want.fetchall())), name


def test_folder_run(spark, folder, tmp_path):
    from termloom.plans import batch

    target = f"file://{tmp_path}/o"
    with pytest.raises(ValueError, match="no glossary: b"):
        batch.run_folder(spark, folder, target, guards.Echo(), phases=("translate",))
    out = batch.run_folder(spark, folder, target, guards.Dictionary({"Hello": "Hola"}), identify_title, to_target, snapshots=f"{tmp_path}/shots")
    assert out["failed"].count() == 1 and out["documents"].first()["content"].startswith("# ")
    assert ["Wrapped"] in [e.source_terms for e in glossary.coerce(spark, f"{target}/b_glossary.txt")]
    assert spark.read.parquet(f"{tmp_path}/shots/groups").count() == 1
    with open(f"{tmp_path}/o/b_translated.docx", "rb") as f:
        blocks, cells = docx.Docx(f.read()).extract()
    assert [b["kind"] for b in blocks][:5] == ["heading", "body", "list_item", "body", "table_ref"] and cells[-1][-1] == "word cell"
    assert [(r["text"], r["bold"]) for r in blocks[1]["runs"]] == [("Hola ", False), ("bold", True), (" text‹FN1›", False)]
    n = out["blocks"].count()
    again = batch.run_folder(spark, folder, target, guards.Echo(), None, None, phases=("translate",), archive=True)
    assert again["blocks"].count() == n > 5 and spark.read.json(f"{tmp_path}/o/runs").count() == 2
    assert not sinks.listed(spark, target, "*_glossary.txt")
    with pytest.raises(ValueError, match="nothing to build"):
        batch.run_folder(spark, folder, f"file://{tmp_path}/p", guards.Echo(), user=False, phases=("glossary",))
    assert batch.chosen_phases(None, True, True) == ("glossary",) and batch.chosen_phases(["translate"], True) == ("translate",)
    assert batch.output_names("/x/a.b.docx", "2020")["tables"] == "a.b_translated_2020_tables"
    assert sinks.append_report(again["check"], f"{tmp_path}/r") == again["check"].count() and sinks.delete_file(spark, f"{tmp_path}/o")


class Wild:
    """Answers cells at length at first; at low temperature briefly, but for some."""

    def __call__(self, prompts, texts, budgets, temperature, seed):
        return ["y" * 300 if temperature > 0.2 or "bad" in t else t.upper() for t in texts]


def test_cells_that_run_away_are_asked_for_again(spark):
    cells = spark.createDataFrame([("d", 1, 0, k, t) for k, t in enumerate(["a long table cell", "bad cell here", "42", None, ""])], "doc_id string, table_idx int, row_idx int, col_idx int, text string")
    keep = translate.keeper(spark)
    out = guards.translated_cells(cells, lambda d: guards.guarded_translation(d, "cell_key", "text", Wild(), keep), guards.cell_retry(Wild()), keep)
    assert [r["translated"] for r in out.orderBy("col_idx").collect()] == ["A LONG TABLE CELL", "bad cell here", "42", None, ""]
    calm = guards.translated_cells(cells, lambda d: d.select("cell_key", F.lit("a long table cell").alias("translated")))
    assert calm.orderBy("col_idx").first()["translated"] == "a long table cell"


def identify_title(segments):
    return ["TERM: Title\nTERM: Wrapped" if "Wrapped" in s else "" for s in segments]


def test_numbers_by_counting(spark):
    """Counters of nested levels, restarts, lists of one shape, skipped levels and every format, against a plain walk."""
    import random

    from termloom.operators.numbering import resolved_numbers

    levels = [("d", n, a, k, f, t, s, r) for n, a, restart in (("1", "0", None), ("2", "0", 7), ("3", "9", None)) for k, (f, t, s) in enumerate((("upperRoman", "%1.", 1), ("decimal", "%1.%2", 3), ("lowerLetter", "%3)", 1), ("decimalZero", "%4-%2", 1), ("bullet", "o", 1))) for r in [restart if k == 0 else None]]
    rng = random.Random(1)
    places = [("d", 10 * p, rng.choice("1123"), rng.choice((0, 1, 1, 2, 2, 3, 4))) for p in range(300)]
    shape = {(x[1], x[3]): x for x in levels}
    of = {x[1]: x[2] for x in levels}

    def low_roman(n):
        out = ""
        for v, s in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + s * (n // v), n % v
        return out

    write = {"upperRoman": lambda n: low_roman(n).upper(), "decimal": str, "lowerLetter": lambda n: chr(97 + (n - 1) % 26) * ((n - 1) // 26 + 1), "decimalZero": lambda n: f"{n:02d}", "bullet": lambda n: ""}
    counts, seen, want = {}, set(), {}
    for _, pos, num, level in places:
        own = counts.setdefault(of[num], {})
        start = lambda k: shape[num, k][7] if shape[num, k][7] is not None else shape[num, k][6]  # noqa: B023, E731
        if num not in seen and shape[num, 0][7] is not None:
            own.pop(0, None)
        seen.add(num)
        own[level] = own[level] + 1 if level in own else start(level)
        for k in range(level + 1, 5):
            own.pop(k, None)
        if shape[num, level][4] != "bullet":
            text = shape[num, level][5]
            for k in range(5):
                text = text.replace(f"%{k + 1}", write[shape[num, k][4]](own.get(k, start(k))))
            want[pos] = (num, text)
    got = resolved_numbers(spark.createDataFrame(places, "doc_id string, pos int, num_id string, level int"), spark.createDataFrame(levels, "doc_id string, num_id string, abstract_id string, level int, fmt string, template string, start int, restart int"))
    got = {r["pos"]: r["number"] for r in got.collect()}
    # a list with a restart has starts of its own, so the lists of its shape are held against the walk before it comes
    first = min(p for _, p, num, _ in places if num == "2")
    assert set(got) == set(want) and all(got[p] == t for p, (num, t) in want.items() if num == "3" or p <= first)
