"""What grows with the input: shuffles of the plans, and rows a task or worker holds at once."""

import os
import re

import pytest
from pyspark.sql import functions as F

from termloom import catalogue
from termloom.operators import terms


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """A folder with a documents table."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, f"Alpha Béta alpha gamma\n\nbeta Delta{chr(97 + i)} épsilon\nAlpha beta") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(os.path.join(path, "documents.parquet"))
    return path


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_word_pairs_are_dealt_once(spark, texts):
    merged = terms.merged_groups(catalogue.word_pairs(spark, texts), "doc_id", "pos")
    assert exchanges(merged) == 1
    assert exchanges(catalogue.queries()["group_components"](spark, texts)) == 1
    got = {(r["canon_key"], r["var_key"], r["variant"], r["support"]) for r in merged.where("doc_id = 0").collect()}
    assert got == {("alpha", "alpha", "Alpha", 3), ("alpha", "beta", "Béta", 2), ("alpha", "gamma", "gamma", 1), ("beta", "beta", "beta", 1), ("beta", "deltaa", "Deltaa", 1), ("epsilon", "epsilon", "épsilon", 1)}


def test_word_files_are_written_and_read_as_streams(spark):
    from termloom.catalogue_files import as_blocks, files_of
    from termloom.sources import docx, docx_write

    cells = spark.range(3000).selectExpr("'d' AS doc_id", "1 AS table_idx", "int(id div 3) AS row_idx", "int(id % 3) AS col_idx", "concat('c', id) AS translated")
    blocks = as_blocks(spark.createDataFrame([("d", 0)], "doc_id string, pos int"), kind=F.lit("table_ref"), table_index=F.lit(1))
    made = docx_write.word_documents(blocks, cells)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    rows = docx.parsed(files_of(made)).cache()
    assert max(len(r["cells"]) for r in rows.collect()) <= docx.PART_ITEMS
    assert docx.parsed_cells(rows).count() == 3000 and docx.parsed_blocks(rows).count() == 1
    last = docx.parsed_cells(rows).where("row_idx = 999").orderBy("col_idx").collect()
    assert [r["text"] for r in last] == ["c2997", "c2998", "c2999"]


def test_pictures_of_word_files_wait_in_the_file():
    from termloom.sources import docx, docx_write
    from termloom.sources.pdf_objects import png

    one = lambda k: {"kind": "image", "image": png(3, 1, 1, b"%03d" % (k % 5)), "width_inches": 2.0}
    file = docx.Docx(docx_write.word_file((one(k) for k in range(20)), {}, [], []))
    assert len(file.unread) == 5 and not hasattr(file, "media")  # equal pictures are one part, read where they are shown
    assert [image for image, _ in file.pictures()] == [one(k)["image"] for k in range(20)] and not file.unread


def test_a_damaged_file_gives_its_error_alone(spark):
    from termloom.catalogue_files import files_of
    from termloom.sources import docx, docx_write
    from termloom.sources.pdf_objects import png

    said = [{"kind": "body", "runs": [{"text": f"t{k}", "bold": False, "italic": False, "size": 0.0}]} for k in range(docx.PART_ITEMS + 5)]
    good = docx_write.word_file([*said, {"kind": "image", "image": png(3, 1, 1, b"abc"), "width_inches": 2.0}])
    bad = good.replace(b"\x89PNG", b"\x89PNX", 1)  # fails after a whole part of blocks
    rows = docx.parsed(files_of(spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(bad))], "doc_id string, content binary"))).cache()
    assert [r["path"] for r in docx.parsed_failures(rows).collect()] == ["bad"]
    assert {r["doc_id"]: r["count"] for r in docx.parsed_blocks(rows).groupBy("doc_id").count().collect()} == {"good": docx.PART_ITEMS + 5}


def test_pdf_files_are_written_and_read_a_page_at_a_time(spark):
    from termloom.sources import pdf, pdf_objects, pdf_write

    mark = lambda k: {"page": k // 2, "seq": k, "kind": "text", "text": f"t{k}", "bold": False, "size": 10.0, "x": 72.0, "y": 80.0 + k % 2 * 20, "w": 0.0, "h": 0.0, "image": None}
    n = 2 * pdf_write.PACKED + 6
    content = pdf_write.document((mark(k) for k in range(2 * n)), packed=True)
    assert content.count(b"/ObjStm") > 2  # not all objects in one
    file = pdf_objects.File(content)
    pages = sum(1 for _ in file.pages())
    assert pages == n and not hasattr(file, "objects") and len(file.read) <= pdf_objects.READ
    made = pdf_write.pdf_documents(spark.createDataFrame([("d", *mark(k).values()) for k in range(2 * n)], "doc_id string, " + pdf_write.MARK), packed=True)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = pdf.marks(pdf.pages(made)).orderBy("page", "idx").collect()
    assert [r["text"] for r in got] == [f"t{k}" for k in range(2 * n)]


def test_numbers_sort_paragraphs_once_for_all_levels(spark):
    from termloom.operators.numbering import resolved_numbers

    levels = spark.createDataFrame([("d", "1", "0", k, "decimal", t, 1, None) for k, t in enumerate(("%1.", "%1.%2", "%1.%2.%3"))], "doc_id string, num_id string, abstract_id string, level int, fmt string, template string, start int, restart int")
    places = spark.createDataFrame([("d", i, "1", v) for i, v in enumerate((1, 0, 1, 1, 2, 0, 2, 1))], "doc_id string, pos int, num_id string, level int")
    made = resolved_numbers(places, levels)
    assert [r["number"] for r in made.orderBy("pos").collect()] == ["1.1", "1.", "1.1", "1.2", "1.2.1", "2.", "2.1.1", "2.1"]
    assert len(re.findall(r"^[ :|+-]*Window ", made._jdf.queryExecution().optimizedPlan().toString(), re.M)) <= 3


def test_fonts_that_pages_share_are_read_once(monkeypatch):
    from termloom.sources import pdf, pdf_objects, pdf_write

    rows = ({"page": k, "seq": 0, "kind": "image", "text": None, "bold": None, "size": 0.0, "x": 100.0, "y": 100.0, "w": 50.0, "h": 60.0, "image": b"3 1 1\n%03d" % k} for k in range(100))
    file, calls = pdf_objects.File(pdf_write.document(rows)), []
    monkeypatch.setattr(pdf, "font_of", lambda f, ref: calls.append(ref) or pdf_objects.font_of(f, ref))
    own = [pdf._resources(file, p["Resources"]) for p in file.pages()]
    assert len({i for r in own for i in r["images"].values()}) == 100 and len(calls) == 2


def test_a_brand_with_many_pictures_is_a_set_of_files(spark, tmp_path, monkeypatch):
    from termloom import catalogue_files
    from termloom.sources import pdf_write

    n, sizes = 250, []
    parts = spark.range(n).selectExpr("id * 7 AS p_partkey", "concat('p', id) AS p_name", "if(id % 5 = 0, 'a/b', 'c') AS p_brand", "int(id % 60) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(catalogue_files, "VOLUME_PAGES", 20)
    monkeypatch.setattr(catalogue_files, "KEY_RANGE", 100)
    made = pdf_write.pdf_documents
    monkeypatch.setattr(pdf_write, "pdf_documents", lambda rows: sizes.append(rows.groupBy("doc_id").count().agg({"count": "max"}).first()[0]) or made(rows))
    rows = catalogue.queries()["pdf_pictures"](spark, str(tmp_path)).collect()
    assert sizes == [20]  # a file holds so many pages, however many pictures a brand has
    want = {}
    for k in range(n):
        own = want.setdefault("a/b" if k % 5 == 0 else "c", [])
        own.append((len(own), f"p{k}".encode().hex().upper()))
    assert {b: sorted((r["page"], r["pixels"]) for r in rows if r["doc_id"] == b) for b in want} == want


def test_a_check_runs_once_and_its_texts_stay(spark, tmp_path):
    from termloom.catalogue_files import as_blocks
    from termloom.functions.text import has_text, plain_run, squash, strip
    from termloom.operators import quality
    from termloom.sources import sinks

    runs = spark.sparkContext.accumulator(0)
    b = as_blocks(spark.range(2).selectExpr("string(id) AS doc_id", "0 AS pos"), kind=F.lit("body"), runs=plain_run(F.when(F.col("doc_id") == "0", " [TABLE 1] ").otherwise("long " * 9)))
    found = quality.report(b, b.withColumn("doc_id", F.lit("0"))).rdd.map(lambda r: runs.add(1) or r).toDF("doc_id string, check string, place string, message string")
    assert sinks.append_report(found, f"{tmp_path}/r") == runs.value == spark.read.json(f"{tmp_path}/r").count() > 0
    plan = quality.body_ratios(b, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "plain" not in plan.split("Join")[0] and [r["n"] for r in quality.counted(b).where("what = 'tables'").orderBy("doc_id").collect()] == [1, 0]
    white = spark.createDataFrame([(" \n a\u2003\u00a0b\u0085 c\u3000",), ("\u2028",), (" ",)], "t string")
    assert [tuple(r) for r in white.select(squash(F.col("t")), strip(F.col("t")), has_text(F.col("t"))).collect()] == [("a b c", "a\u2003\u00a0b\u0085 c", True), ("", "", False), ("", "", False)]


def test_words_of_a_document_are_dealt_once(spark, texts):
    for name in ("keep_reclassify", "keep_conflict_resolution"):
        plan = catalogue.queries()[name](spark, texts)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [doc_id" in plan and "array_distinct" in plan.split("RepartitionByExpression [doc_id")[-1], name
    got = catalogue.queries()["keep_reclassify"](spark, texts).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, 4) for i in range(6)]
    asked = spark.createDataFrame([("see a.org",), ("x.y",), ("U.N.",), ("",), ("a/b",), ("plain word",), ("http:x",)], "t string")
    assert [r[0] for r in asked.select(terms.is_real_keep(F.col("t"))).collect()] == [True, False, True, False, True, False, False]


def test_spans_are_found_in_one_run_over_the_marks(spark):
    from termloom.sources import pdf, pdf_objects, pdf_write

    rows = [{"page": 0, "seq": k, "kind": "text", "text": f"Wörd {k} (x)", "bold": k == 1, "size": 10.0, "x": 72.0 + 60 * (k == 1), "y": y, "w": 0.0, "h": 0.0, "image": None} for k, y in enumerate((80.0, 80.0, 94.0, 150.0))]
    made = pdf_write.pdf_documents(spark.createDataFrame([("d", *r.values()) for r in rows], "doc_id string, " + pdf_write.MARK), packed=True)
    found = pdf.spans(pdf.marks(pdf.pages(made)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 3  # write, read, run
    got = [tuple(r) for r in found.select("block", "line", "span", "text", F.round("x1", 3)).orderBy("block", "line", "span").collect()]
    assert got == [(0, 0, 0, "Wörd 0 (x)", 122.0), (0, 0, 1, " Wörd 1 (x)", 182.0), (0, 1, 0, "Wörd 2 (x)", 122.0), (1, 0, 0, "Wörd 3 (x)", 122.0)]
    read = lambda s: pdf_objects.Reader(s, refs=False).value()
    assert [read(s) for s in (b"<4142>", b"<4 14 2>", b"<414>", b"<>", b"<41", b"/A#42c", b"/A#4")] == [b"AB", b"AB", b"A@", b"", b"A", "ABc", "A#4"]


def test_small_word_files_go_on_together(spark):
    import pyarrow as pa

    from termloom.sources import docx, docx_write

    class Files:  # what the task does, without a session
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    said = lambda n: [{"kind": "body", "runs": [{"text": f"t{k}", "bold": False, "italic": False, "size": 0.0}]} for k in range(n)]
    contents = [*(docx_write.word_file(said(3)) for _ in range(50)), b"broken", docx_write.word_file(said(docx.PART_ITEMS + 5)), docx_write.word_file([])]
    given = pa.RecordBatch.from_pydict({"path": [f"f{k}" for k in range(len(contents))], "content": pa.array(contents, pa.binary())})
    made = list(docx.parsed(Files())(iter([given])))
    assert len(made) == 3  # two parts of the long file, and all others
    rows = [r for b in made for r in b.to_pylist()]
    assert {r["doc_id"] for r in rows if r["error"]} == {"f50"} and len({r["doc_id"] for r in rows}) == 53
    assert sum(len(r["blocks"]) for r in rows) == 150 + docx.PART_ITEMS + 5


def test_notes_are_read_from_the_files_once(spark, tmp_path, monkeypatch):
    from termloom.sources import docx

    spark.sql("SELECT 1L AS conv_id, 0 AS turn, 'user' AS role, 'Hi  there' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    plans, parsed = [], docx.parsed
    monkeypatch.setattr(docx, "parsed", lambda files: plans.append(1) or parsed(files))
    made = catalogue.queries()["word_notes"](spark, str(tmp_path))
    assert plans == [1] and "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()  # what was read is written down
    assert {(r["kind"], r["original"]) for r in made.collect()} == {("footnote", "NHi there"), ("comment", "CHi there"), ("body", "user‹FN1›")}


def test_texts_are_python_objects_a_slice_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from termloom.operators import glossary, guards

    class Rows:  # what the task does
        mapInArrow = lambda self, run, _: run
        schema = type("S", (), {"fields": []})

    given = pa.RecordBatch.from_pydict({"prompt": ["p"] * 1000, "masked": [str(k) for k in range(1000)], "budget": [30] * 1000})
    sizes = []
    made = guards.called(Rows(), lambda prompts, texts, budgets, t, seed: sizes.append(len(texts)) or texts, "answer")(iter([given]))
    assert [x for b in made for x in b.column("answer").to_pylist()] == [str(k) for k in range(1000)] and max(sizes) == guards.CALL_ROWS
    assert [b.num_rows for b in glossary.pieces(iter([given.slice(0, 0), given, given]))] == [glossary.TEXT_ROWS] * 2
    chunks = spark.range(30).selectExpr("id", "string(id % 10) AS scope", "concat('term', id % 10, ' other') AS text")
    entries = spark.range(10).selectExpr("string(id) AS scope", "int(1) AS entry_idx", "array(concat('term', id)) AS source_terms", "'t' AS target", "array() AS target_alts", "'require' AS kind")
    found = glossary.live_terms(chunks, entries, "id", "text")
    assert re.search(r"Exchange hashpartitioning\(scope#\d+, part#\d+, salt#\d+, 4\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert sorted(r["id"] for r in found.collect()) == list(range(30))


def test_presence_folds_and_tests_in_one_pass(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from termloom.functions.text import presence_fold, squash

    docs = [(1, "La CORTE\n\nNotícia de la corte"), (None, "corte"), (2, "Corte"), (2, "x dé"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Corte dé x"), (2, "noticia y LA"), (1, "a"), (3, "1"), (None, "corte")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = catalogue.queries()["presence_filter"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan and plan.count("Join") == 1  # a task runs one Python worker
    assert "_text" not in plan.split("MapInArrow")[0]  # texts are not dealt
    got = {(r["doc_id"], r["pos"]): r["variants"] for r in made.collect()}
    assert got == {(1, 0): ["Corte"], (1, 2): ["noticia", "LA"], (None, 0): ["Corte"], (2, 0): ["Corte", "dé", "x"]}

    segments = spark.createDataFrame([("s", " la Corte \n\n SUPREMA"), ("t", None)], "s string, t string")
    groups = [("s", 1, "group", ["corte  suprema", None, "", "CORTE\x1cSUPREMA", "x"]), ("s", 2, "keep", ["x"]), ("s", 3, "keep", []), ("s", 4, "keep", None), ("t", 1, "keep", ["x"])]
    parsed = spark.createDataFrame(groups, "s string, ord int, kind string, variants array<string>")
    assert [tuple(r) for r in terms.present_only(parsed, segments, "s", "t").collect()] == [("s", 1, "group", ["corte  suprema", ""])]
    texts = [" \n a  b\u0085 c\u3000", " ", " ", "", "a\x1cÉ  ﬁ "]
    assert [presence_fold(t) for t in texts] == ["a b c", "", "", "", "a\x1ce fi"]
    assert [r[0].lower() for r in spark.createDataFrame([(t,) for t in texts[:4]], "t string").select(squash(F.col("t"))).collect()] == [presence_fold(t) for t in texts[:4]]

    class Rows:  # what the task does
        dtypes = [("k", "bigint")]
        select = groupBy = lambda self, *_: self
        mapInArrow = lambda self, run, _: setattr(self, "run", run) or self
        agg = lambda self, _: self.run

    monkeypatch.setattr(terms, "FOUND_VARIANTS", 3)
    given = pa.RecordBatch.from_pydict({"k": range(11), "_text": ["b a"] * 10 + ["-"], "variants": [["a", "x", "B"]] * 11})
    sent = list(terms.present_beside(Rows(), ["k"], "t")(iter([given.slice(0, 0), given])))
    assert [b.num_rows for b in sent] == [2] * 5
    assert [tuple(r.values()) for b in sent for r in b.to_pylist()] == [(k, [0, 2], ["a", "B"]) for k in range(10)]
