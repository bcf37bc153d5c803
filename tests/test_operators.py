"""Single operators on small tables, the hard cases spelled out."""

import random
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from termloom.functions import text as X
from termloom.functions.text import fold_text
from termloom.operators import chunking, docmodel, glossary, guards, layout, quality, terms
from termloom.operators.glossary import Entry
from termloom.schema import BLOCKS, ENTRIES

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, column, **values):
    """The value of a column expression over one row."""
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def run(text, bold=False, italic=False, size=0.0):
    return {"text": text, "bold": bold, "italic": italic, "size": size}


def runs_frame(spark, runs):
    return spark.createDataFrame([(runs,)], f"runs array<{X.RUN}>")


def test_whitespace(spark):
    assert one(spark, X.squash(F.col("t")), t="  a \n b\t") == "a b"
    assert one(spark, X.strip(F.col("t")), t=" a b ") == "a b"
    assert X.fold_text("Comisión ﬁn Ñ") == "comision fin n"


def test_consolidation(spark):
    runs = [run("a", True), run("b", True), run("", False), run("c"), run("d", False, True), run(" ", False, True)]
    df = runs_frame(spark, runs)
    got = df.select(X.consolidated(F.col("runs")).alias("r"), X.runs_markdown(F.col("runs")).alias("m"), X.runs_text(F.col("runs")).alias("t")).first()
    assert [r["text"] for r in got["r"]] == ["ab", "c", "d "]
    assert got["m"] == "**ab**c*d *" and got["t"] == "abcd"
    again = runs_frame(spark, [r.asDict() for r in got["r"]]).select(X.consolidated(F.col("runs")).alias("r")).first()["r"]
    assert again == got["r"]


def blocks(spark, rows):
    names = [c.split()[0] for c in ("doc_id", "pos", "kind", "level", "runs", "title", "separator", "marker", "text", "comment", "image", "width_inches", "table_index")]
    return spark.createDataFrame([tuple({"doc_id": "d", "pos": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], BLOCKS)


def body(text, **more):
    return {"kind": "body", "runs": [run(text)], **more}


def test_flat_texts_and_routes(spark):
    b = blocks(spark, [{"kind": "heading", "level": 1, "runs": [run("H")]}, body("P‹FN1›"), {"kind": "list_item", "title": "1.", "runs": [run("item")], "separator": " "}, {"kind": "footnote", "marker": "1", "text": "note"}, {"kind": "image"}, body("Q"), {"kind": "table_ref", "table_index": 1}])
    assert [r["part"] for r in docmodel.flat_texts(b).orderBy("pos").collect()] == ["H", "P‹FN1›", "1. item", "note", "Q"]
    assert [r["part"] for r in docmodel.flat_texts(b, notes=False, headings=False).orderBy("pos").collect()] == ["P‹FN1›", "1. item", "Q"]
    assert [r["route"] for r in docmodel.routed(b).orderBy("pos").collect()] == ["heading", "marked", "list_item", "footnote", "none", "body", "table"]
    s = docmodel.doc_stats(b).first()
    assert (s["n_body"], s["n_image"], s["chars_in"]) == (2, 1, 1 + 6 + 2 + 4 + 1)


def greedy(sizes, limit, most=None):
    groups, n, length = [], 0, 0
    for s in sizes:
        if n and (length + s + 1 > limit or (most and n >= most)):
            groups.append(groups[-1] + 1)
            n = length = 0
        else:
            groups.append(groups[-1] if groups else 0)
        n, length = n + 1, length + s + 1
    return groups


def test_greedy_packing(spark):
    rng = random.Random(2)
    rows = [(k, i, "x" * rng.choice((0, 5, 30, 90))) for k in range(30) for i in range(rng.randint(1, 20))]
    got = chunking.packed(spark.createDataFrame(rows, "k int, i int, t string"), "k", "i", "t", 100, 3).collect()
    for k in range(30):
        own = sorted((r["i"], r["grp"]) for r in got if r["k"] == k)
        assert [g for _, g in own] == greedy([len(t) for kk, _, t in rows if kk == k], 100, 3)


def test_packing_of_a_long_document_and_of_nulls(spark):
    n = 400_000
    long = spark.range(n).select(F.lit("d").alias("k"), F.col("id").alias("i"), F.repeat(F.lit("x"), (F.col("id") % 41).cast("int")).alias("t"))
    got = [r["grp"] for r in chunking.packed(long, "k", "i", "t", 100, 3).orderBy("i").select("grp").collect()]
    assert got == greedy([i % 41 for i in range(n)], 100, 3)
    rows = [(None, 1, None), (None, 2, "x" * 99), ("a", None, "x"), ("a", 1, ""), ("a", 1, "")]
    odd = chunking.packed(spark.createDataFrame(rows, "k string, i int, t string"), "k", "i", "t", 100).collect()
    assert sorted(((r["k"] or "", r["i"] or 0, r["grp"]) for r in odd)) == [("", 1, 0), ("", 2, 1), ("a", 0, 0), ("a", 1, 0), ("a", 1, 0)]
    assert chunking.packed(spark.createDataFrame([], "k string, i int, t string"), "k", "i", "t", 100).count() == 0


def test_many_runs_take_linear_time(spark):
    n = 200_000
    runs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.lit("a").alias("text"), (i % 3 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit(1.0).alias("size")))
    got = spark.range(1).select(X.consolidated(runs).alias("r")).select(F.size("r"), F.get("r", F.lit(1))["text"]).first()
    assert got[1] == "aa" and got[0] == 2 * -(-n // 3)  # every third is bold


def test_marker_carry_over(spark):
    text = "First one‹FN1› here. Second?‹FN2› Third‹FN3›‹FN4›"
    m = [(r["id"], r["sent"]) for r in one(spark, chunking.marker_sentences(F.col("t")), t=text)]
    assert m == [("1", 0), ("2", 1), ("3", 2), ("4", 2)]
    put = lambda translated: one(spark, chunking.with_markers(F.col("o"), chunking.marker_sentences(F.col("t"))), o=translated, t=text)
    assert put("Uno aquí. ¿Dos? Tres") == "Uno aquí.‹FN1› ¿Dos?‹FN2› Tres‹FN3›‹FN4›"
    assert put("Uno. Dos.") == "Uno.‹FN1› Dos.‹FN2›‹FN3›‹FN4›" and put("") == ""
    assert one(spark, chunking.marker_sentences(F.col("t")), t="‹FN1›")[0]["sent"] == -1
    assert one(spark, chunking.sentences(F.col("t")), t='He said "no." Then left.  Yes!') == ['He said "no."', "Then left.", "Yes!"]


def test_realignment(spark):
    raw = "Sure!\n[0] one\nmore\n[2] three\n[9] odd\n[0] again"
    got = {r["n"]: r["cand"] for r in chunking.realigned(spark.createDataFrame([(1, 3, raw)], "k int, c int, raw string"), "k", "c", "raw").collect()}
    assert got == {0: "again", 2: "three [9] odd"}
    assert one(spark, chunking.accepted(F.col("a"), F.col("b")), a="xxxx", b="x" * 10) and not one(spark, chunking.accepted(F.col("a"), F.col("b")), a="xxx", b="x" * 10)


def test_term_tests(spark):
    flag = lambda f, t: one(spark, f(F.col("t")), t=t)
    assert [flag(terms.is_candidate, t) for t in ("Cajar vs. Colombia", "plain words", "A sentence. Then", "(Done.)", "x_y", "A")] == [True, False, False, False, True, False]
    assert [flag(terms.is_acronym, t) for t in ("CIDH", "Cidh", "A", "AB CD", "ABCDEFGH")] == [True, False, False, False, False]
    assert [flag(terms.is_real_keep, t) for t in ("medios de comunicación", "Corte", "a/b", "v2", "x_y", "PDF", "site.org")] == [False, True, True, True, True, True, True]
    assert one(spark, terms.paren_variants(F.col("t")), t=" Full Name (FN) ") == ["Full Name", "FN"]
    case = lambda v: spark.createDataFrame([(v,)], "v array<string>").select(terms.normal_case(F.col("v")).alias("x")).first()["x"]
    assert case(["CORTE DE DERECHOS CIDH", "Corte de Derechos"]) == ["Corte de Derechos CIDH", "Corte de Derechos"]
    assert case(["CORTE SUPREMA", "corte"]) == ["corte suprema", "corte"]
    lists = lambda v: spark.createDataFrame([(v,)], "v array<string>").select(terms.is_entity_list(F.col("v")).alias("x")).first()["x"]
    assert lists(["Perú", "Chile", "Bolivia"]) and not lists(["Corte Suprema", "Corte", "Tribunal"]) and not lists(["Corte", "Sala", "CIDH"]) and not lists(["a", "b"])


def test_clean_variants(spark):
    said = {
        "| A | b |": ["A", "b"], "X → Y": ["X"], "BLUEPRINT: blueprint": ["blueprint"], "Org: meaning": ["Org", "meaning"], "Full (Ab) | full": ["Full", "Ab"],
        "KEEP": [], "PREFER: Corte | x": ["Corte", "x"], " ".join(["word"] * 19): [], "": [], None: [], " | ": [], "→ x": [], '"Corte Suprema" | corte suprema.': ["Corte Suprema"],
        "one: two: three": ["one", "two: three"], "A: a | B: c": ["a", "B: c"], "term:x;": ["x"], " keep : y ": ["y"], "'q' | \"'r'\"": ["q", "r"], "N (ab) → z": ["N", "ab"], "a||b": ["a", "b"],
    }
    rows = spark.createDataFrame([(k,) for k in said], "s string").select("s", terms.cleaned(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in rows} == said


def test_lines_to_entries(spark):
    raw = "KEEP: data_x\nTERM: Corte Suprema (CS) | corte suprema\n- TRANSLATE: Perú | Chile | Bolivia\nMinisterio Público\nCorte Suprema\nprose line here.\n# no"
    got = terms.parsed_lines(spark.createDataFrame([("s", raw)], "s string, raw string"), "s", "raw").orderBy("ord").collect()
    assert [(r["kind"], r["variants"]) for r in got] == [("keep", ["data_x"]), ("group", ["Corte Suprema", "CS"]), ("group", ["Bolivia"]), ("group", ["Chile"]), ("group", ["Perú"]), ("group", ["Ministerio Público"])]
    present = terms.present_only(spark.createDataFrame(got), spark.createDataFrame([("s", "la CORTE\nSUPREMA y data_x en chile")], "s string, t string"), "s", "t")
    assert sorted(r["variants"] for r in present.collect()) == [["Chile"], ["Corte Suprema"], ["data_x"]]


def support(spark, rows):
    """(doc, seg, ord, variants) -> merged groups."""
    return terms.merged_groups(spark.createDataFrame([("d", s, o, "group", v) for s, o, v in rows], "doc string, seg int, ord int, kind string, variants array<string>"), "doc", "seg")


def test_voting_and_union(spark):
    rows = [(i, 1, ["Comisión Interamericana", "CIDH"]) for i in range(3)] + [(4, 1, ["Corte", "CIDH"]), (5, 1, ["corte", "Tribunal"]), (6, 1, ["Tribunal", "Tribunal Superior"])]
    out = {tuple(r["variants"]) for r in terms.united(terms.voted(support(spark, rows), "doc"), "doc").collect()}
    assert out == {("Comisión Interamericana", "CIDH"), ("Tribunal Superior", "Corte", "Tribunal")}


def brute_union(groups):
    sets = [set(g) for g in groups]
    merged = True
    while merged:
        merged = False
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if sets[i] & sets[j]:
                    sets[i] |= sets.pop(j)
                    merged = True
                    break
            if merged:
                break
    return {frozenset(s) for s in sets}


def test_union_of_random_groups(spark):
    rng = random.Random(6)
    groups = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 3))] for _ in range(50)]
    got = terms.united(support(spark, [(i, 1, list(dict.fromkeys(g))) for i, g in enumerate(groups)]), "doc").collect()
    assert {frozenset(r["variants"]) for r in got} == brute_union(groups)


def test_symbols(spark):
    text = "See https://Ex.org/a_b_c/. and https://ex.org/A_B_C/ then www.site.gov, user_id, user_id and x_2"
    got = terms.symbols(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("ord").collect()
    assert [(r["symbol"], r["what"]) for r in got] == [("https://Ex.org/a_b_c/", "url"), ("site.gov", "url"), ("user_id", "identifier"), ("x_2", "identifier")]


def test_context(spark):
    text = 'Before it. The "Corte" decided here. After it! ' + "x" * 300
    long = "alpha " * 40 + "Corte " + "omega " * 40
    rows = [("corte", text), ("zzz", text), ("", text), (None, text), ("corte", None), ("corte", long), ("b", "a? x\nq! c b d\ne. f"), ("a", "a"), ("w", "v" * 150 + " w " + "u" * 150), ("Q" * 220, "Q" * 220)]
    got = [r["c"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, term string, text string").select("i", terms.term_context(F.col("term"), F.col("text")).alias("c")).orderBy("i").collect()]
    assert got[0] == "The 'Corte' decided here." and got[1:5] == [None] * 4
    assert got[5].startswith("alpha alpha") and got[5].endswith("omega omega") and len(got[5]) <= 200
    assert got[6:] == ["c b d e.", "a", "w", "Q" * 197 + "..."]


def entries(spark, rows):
    return spark.createDataFrame([(i, s, t, a, k, "", "", "", []) for i, (s, t, a, k) in enumerate(rows)], ENTRIES)


GLOSSARY = [(["Comisión"], "Commission", [], "require"), (["Comisión Interamericana de Derechos Humanos", "CIDH"], "Inter-American Commission", ["IACHR"], "require"), (["ministerio público"], "Public Ministry", [], "require"), (["data_x"], "data_x", [], "verbatim"), (["hint"], "tip", [], "prefer")]


def live(spark, text, rows=GLOSSARY):
    chunks = spark.createDataFrame([(1, text)], "k int, t string")
    return sorted(r["entry_idx"] for r in glossary.live_entries(glossary.occurrences(chunks, entries(spark, rows), "k", "t"), "k").collect())


def test_longest_match(spark):
    assert live(spark, "la COMISION INTERAMERICANA DE DERECHOS HUMANOS") == [1]
    assert live(spark, "la Comisión Interamericana de Derechos Humanos y la comisión") == [0, 1]
    assert live(spark, "nothing") == []
    chain = [(["abcd"], "1", [], "require"), (["cdef"], "2", [], "require"), (["cdefgh"], "3", [], "require")]
    assert live(spark, "abcdefgh", chain) == [2] and live(spark, "abcdef", chain) == [0, 1]


def brute_live(text, rows):
    folded = X.fold_text(text)
    spans = {i: [(at, at + len(t)) for t in map(X.fold_text, s) for at in glossary.find_all(folded, t)] for i, (s, *_ ) in enumerate(rows)}
    return sorted(i for i, own in spans.items() if any(not any(oe - os > e - s and s < oe and os < e for j, o in spans.items() if j != i for os, oe in o) for s, e in own))


def test_longest_match_on_random_texts(spark):
    rng = random.Random(9)
    rows = [(["".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))], "t", [], "require") for _ in range(6)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in range(150)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in glossary.live_entries(glossary.occurrences(chunks, entries(spark, rows), "k", "t"), "k").collect():
        got.setdefault(r["k"], []).append(r["entry_idx"])
    assert all(sorted(got.get(k, [])) == brute_live(t, rows) for k, t in enumerate(texts))
    once = {}
    for r in glossary.live_terms(chunks, entries(spark, rows), "k", "t").collect():
        once.setdefault(r["k"], []).append(r["entry_idx"])
    assert once == {k: v for k, v in ((k, brute_live(t, rows)) for k, t in enumerate(texts)) if v}


def test_many_terms_use_one_pass(spark, monkeypatch):
    rows = [([f"term{i}x"], "t", [], "require") for i in range(60)]
    text = " ".join(f"term{i}x" for i in range(0, 60, 2))
    assert live(spark, text, rows) == list(range(0, 60, 2))
    monkeypatch.setattr(glossary, "BROADCAST_BYTES", 100)
    assert live(spark, text, rows) == list(range(0, 60, 2))


def test_violations_and_hints(spark):
    source = "La CIDH y el ministerio público usan data_x"
    pairs = spark.createDataFrame([(1, source, "The court and the prosecutors use it"), (2, source, "The IACHR and the public ministry use data_x")], "k int, s string, t string")
    found = glossary.violations(pairs, entries(spark, GLOSSARY), "k", "s", "t").orderBy("entry_idx").collect()
    assert [(r["k"], r["message"]) for r in found] == [(1, "render 'Comisión Interamericana de Derechos Humanos' as Inter-American Commission (or: IACHR)"), (1, "render 'ministerio público' as Public Ministry"), (1, "render 'data_x' as data_x")]
    hint = glossary.hints(spark.createDataFrame(found), "k").first()["hint"]
    assert hint.count("  - ") == 3
    section = glossary.prompt_sections(pairs.where("k = 1"), entries(spark, GLOSSARY), "k", "s").first()["section"]
    assert section.splitlines()[-1] == "  data_x → data_x  (leave as is)"


def test_glossary_lines(spark, tmp_path):
    lines = ["TRANSLATE: a | b → x | y", "keep: K1 | K2", "PREFER: p", "PREFER: q → r", "# note", "", "TRANSLATE: lost", "KEEP: odd → t", "Nonsense", "TRANSLATE: s -> t", "KEEP:", "PREFER: → x"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), glossary.LINES)
    got = glossary.numbered(glossary.parsed(df), "line_no", "var_no").orderBy("entry_idx").collect()
    assert [(r["source_terms"], r["target"], r["kind"]) for r in got][:6] == [(["a", "b"], "x", "require"), (["K1"], "K1", "verbatim"), (["K2"], "K2", "verbatim"), (["p"], "p", "prefer"), (["q"], "r", "prefer"), (["odd"], "odd", "verbatim")]
    levels = [(r["line_no"], r["level"]) for r in glossary.issues(df).orderBy("line_no").collect()]
    assert levels == [(7, "error"), (8, "warning"), (9, "error"), (10, "error"), (11, "error"), (12, "error")]
    items = [Entry(["a", "b"], "x", ["y"]), Entry(["q"], "r", kind="prefer"), Entry(["p"], "p", kind="prefer")]
    path = tmp_path / "g.txt"
    path.write_text("\n".join(glossary.file_lines(items, ["which?"])))
    back = glossary.coerce(spark, str(path))
    assert [(e.source_terms, e.target, e.target_alts, e.kind) for e in back] == [(e.source_terms, e.target, e.target_alts, e.kind) for e in items]
    assert glossary.coerce(spark, {}) is None and glossary.coerce(spark, False) is False and glossary.coerce(spark, {"a": "b"})[0].kind == "prefer"
    with pytest.raises(TypeError):
        glossary.coerce(spark, 7)


def test_merge_algebra():
    low, high = [Entry(["Comisión", "CIDH"], "A"), Entry(["otro"], "B")], [Entry(["cidh"], "C", source="mine"), Entry(["nuevo"], "D")]
    out = glossary.combined(low, None, high)
    assert [e.target for e in out] == ["B", "C", "D"] and out[1].alt_versions == [("another glossary", "A")]
    assert glossary.combined() is None and glossary.combined(None) is None
    # a dropped entry claims nothing: its other term stays free for an earlier glossary
    assert [e.target for e in glossary.combined([Entry(["b"], "1")], [Entry(["a", "b"], "2")], [Entry(["a"], "3")])] == ["1", "3"]
    new, report = glossary.upserted([Entry(["a"], "x", ["y"]), Entry(["c"], "z")], [Entry(["Á"], "Y"), Entry(["c"], "w"), Entry(["d"], "v"), Entry(["d"], "u")], ["C"])
    assert report == {"added": 1, "unchanged": ["Á"], "conflicts": [{"term": "d", "kept": "v", "offered": "u"}], "updated": ["c"]}
    assert [e.target for e in new] == ["x", "w", "v"]
    user = [Entry(["Corte"], "Court"), Entry(["Sala"], "Chamber")]
    final, notes = glossary.final_merge([Entry(["corte", "Corte IDH"], "Tribunal"), Entry(["corte", "sala", "pleno"], "X"), Entry(["fiscal"], "prosecutor")], [Entry(["x_y"], "x_y", kind="verbatim")], user)
    assert [e.source_terms for e in final] == [["fiscal"], ["x_y"], ["Corte", "Corte IDH"], ["Sala"]]
    assert [e.origin for e in final] == ["draft", "draft", "approved", "approved"] and len(notes) == 2
    assert user[0].source_terms == ["Corte"]


def test_masking(spark):
    text = "use user_id and user_id or a_b1; not A_b, x_"
    masked = one(spark, guards.masked(F.col("t")), t=text)
    assert masked == "use ⟪V0⟫ and ⟪V1⟫ or ⟪V2⟫; not A_b, x_"
    assert one(spark, guards.unmasked(guards.masked(F.col("t")), guards.identifiers(F.col("t"))), t=text) == text
    assert one(spark, guards.unmasked(F.lit("⟪V0⟫ ⟪V9⟫"), guards.identifiers(F.col("t"))), t=text) == "user_id ⟪V9⟫"


def test_guards(spark):
    assert one(spark, guards.is_echo(F.lit("render 'a' as b"))) and not one(spark, guards.is_echo(F.lit("a clean answer")))
    assert one(spark, guards.is_echo(F.lit("THE DOCUMENTS BELONG TO THIS FIELD: LAW"), "law"))
    assert [one(spark, guards.is_data_cell(F.lit(c))) for c in ("42", "$100", "12 kg", "CAT 1", "No", "word", "", " ", "01/15/2024")] == [True, True, True, True, True, False, False, False, True]
    assert [one(spark, guards.output_budget(F.lit(n))) for n in (0, 45, 46, 300)] == [30, 30, 30, 200]
    assert not one(spark, guards.is_runaway(F.lit("ab"), F.lit("x" * 58))) and one(spark, guards.is_runaway(F.lit("ab"), F.lit("x" * 59)))
    assert guards.emphasis_pieces("a **b‹FN2›c** *d* ***e***‹FN1›") == [("a ", False, False, False), ("b", True, False, False), ("2", False, False, True), ("c", True, False, False), (" ", False, False, False), ("d", False, True, False), (" ", False, False, False), ("e", True, True, False), ("1", False, False, True)]
    assert guards.language_code("Chinese", "en") == "zh-CN" and len(guards.LANGUAGES) == 51


class Mute:
    """Never answers."""

    def __call__(self, prompts, texts, budgets, temperature, seed):
        return [None] * len(texts)


class Leaky:
    """Echoes the prompt for texts with LEAK, at first or always; uses the wrong term unless the hint is there."""

    def __call__(self, prompts, texts, budgets, temperature, seed):
        out = []
        for p, t in zip(prompts, texts, strict=True):
            if "ALWAYS" in t or ("LEAK" in t and temperature > 0.1):
                out.append("Return nothing but the translation. " + t)
            elif glossary.MEND_HEAD in p:
                out.append(t.replace("corte", "court"))
            else:
                out.append(t.replace("corte", "tribunal"))
        return out


def test_guarded_translation(spark):
    texts = spark.createDataFrame([(1, "la corte usa user_id"), (2, "LEAK now"), (3, "ALWAYS"), (4, "nada")], "k int, t string")
    got = {r["k"]: r for r in guards.guarded_translation(texts, "k", "t", Leaky(), lambda d: d.checkpoint(), entries(spark, [(["corte"], "court", [], "require")])).collect()}
    assert got[1]["translated"] == "la court usa user_id" and got[1]["retry_taken"] and got[1]["n_violations"] == 1
    assert got[2]["translated"] == "LEAK now" and not got[2]["kept_source"]
    assert got[3]["translated"] == "ALWAYS" and got[3]["kept_source"]
    assert got[4]["translated"] == "nada"
    nulls = spark.createDataFrame([(1, None), (2, "x")], "k int, t string")
    mute = guards.guarded_translation(nulls, "k", "t", Mute(), lambda d: d.checkpoint()).orderBy("k").collect()
    assert [(r["translated"], r["kept_source"]) for r in mute] == [(None, False), ("x", True)]
    words = guards.Dictionary({"la corte": "the court", "corte": "cut"})
    assert words([], ["La corte, corte"], [], 0, 0) == ["the court, cut"]


def test_quality(spark):
    source = blocks(spark, [{"kind": "heading", "level": 1, "runs": [run("1. Title")]}, body("x" * 40), body("y" * 40), body("short"), {"kind": "table_ref", "table_index": 1}])
    output = blocks(spark, [{"kind": "heading", "level": 1, "runs": [run("Title")]}, body("x" * 11), body("y" * 120), body("a very long line that does not matter"), body("[TABLE 1]"), body("more")])
    r = sorted((x["check"], x["place"]) for x in quality.report(source, output).collect())
    assert r == [("body", "1"), ("count", "body"), ("number", "1")]
    cells = lambda rows: spark.createDataFrame([("d", 1, 0, i, t) for i, t in enumerate(rows)], "doc_id string, table_idx int, row_idx int, col_idx int, text string")
    bad = quality.cell_ratios(cells(["abcdefghij", "abcdefghij", "abc"]), cells(["ab", "abcdefghij", "x" * 90])).collect()
    assert [r["col_idx"] for r in bad] == [0]


def spans(spark, rows):
    base = {"doc_id": "d", "page": 1, "block": 0, "line": 0, "span": 0, "size": 10.0, "flags": 0, "font": "Serif", "x0": 0.0, "y0": 0.0, "x1": 100.0, "y1": 10.0}
    names = ("doc_id", "page", "block", "line", "span", "text", "size", "flags", "font", "x0", "y0", "x1", "y1")
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], "doc_id string, page int, block int, line int, span int, text string, size double, flags int, font string, x0 double, y0 double, x1 double, y1 double")


def test_fonts_and_lines(spark):
    s = spans(spark, [{"line": 0, "text": "1", "size": 6.0}, {"line": 0, "span": 1, "text": "note text here", "size": 9.0}, {"line": 1, "text": "   "}, {"block": 1, "text": "Body words body words", "size": 10.04}, {"block": 2, "text": "Big", "size": 20.0, "font": "X-Bold"}, {"block": 3, "text": "equal many chars 12345", "size": 12.0}])
    f = layout.font_stats(s).first()
    assert f["body_size"] == 12.0 and f["heading_sizes"] == [20.0] and f["n_larger"] == 1 and not f["body_bold"]
    lines = layout.lines_of(s).orderBy("block", "line").collect()
    assert [(r["marker"], r["runs"][0]["text"]) for r in lines] == [("1", "note text here"), (None, "Body words body words"), (None, "Big"), (None, "equal many chars 12345")]
    assert lines[2]["runs"][0]["bold"]
    values = spark.createDataFrame([(1, 4.0), (1, 1.0), (1, 3.0), (1, 2.0), (2, None), (3, 5.0), (3, 7.0), (3, 6.0)], "k int, v double")
    assert set(values.select("k", layout.upper_median("v", "k")).collect()) == {(1, 3.0), (2, None), (3, 6.0)}


def test_paragraphs_and_classes(spark):
    s = spans(spark, [
        {"block": 0, "line": 0, "text": "IV. Findings", "size": 10.0, "flags": 16, "y0": 0.0, "y1": 10.0},
        {"block": 1, "line": 0, "text": "Body line one is long and plain,", "y0": 30.0, "y1": 40.0},
        {"block": 1, "line": 1, "text": "and goes on here.", "y0": 41.0, "y1": 51.0},
        {"block": 1, "line": 2, "text": "3) next item", "y0": 52.0, "y1": 62.0},
        {"block": 2, "line": 0, "text": "A title in italics", "flags": 2, "y0": 70.0, "y1": 80.0},
        {"block": 2, "line": 0, "span": 1, "text": " - its body text follows", "y0": 70.0, "y1": 80.0},
        {"block": 3, "line": 0, "text": "-----", "y0": 90.0, "y1": 95.0},
        {"block": 4, "line": 0, "text": "* a small note", "size": 7.0, "y0": 700.0, "y1": 707.0},
        {"block": 5, "line": 0, "text": "12", "size": 7.0, "y0": 720.0, "y1": 727.0},
    ])
    zones = layout.note_zones(spark.createDataFrame([("d", 1, 0, 0.0, 600.0, 100.0, 601.0)], "doc_id string, page int, draw_idx int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame([("d", 1, 800.0)], "doc_id string, page int, height double"))
    assert zones.first()["zone_y"] == 600.0
    b = layout.assembled(layout.classified(layout.paragraphs(layout.lines_of(s)), layout.font_stats(s), zones)).orderBy("pos").collect()
    assert [r["kind"] for r in b] == ["heading", "body", "body", "list_item", "separator", "footnote", "body"]
    assert b[0]["level"] == 1 and b[3]["title"] == "A title in italics" and b[3]["separator"] == " - " and (b[5]["marker"], b[5]["text"]) == ("*", "a small note")


def test_fold_and_stitch(spark):
    heads = ["IV.", "Findings", "I.", "II.", "III.", "Last"]
    b = blocks(spark, [{"kind": "heading", "level": 2, "runs": [run(h)]} for h in heads] + [{"kind": "footnote", "marker": "*", "text": "3"}, {"kind": "footnote", "marker": "*", "text": "the note"}])
    got = layout.folded_markers(b).orderBy("pos").collect()
    assert [r["runs"][0]["text"] for r in got[:3]] == ["IV. Findings", "I. II.", "III. Last"] and (got[3]["marker"], got[3]["text"]) == ("3", "the note")
    c = blocks(spark, [body("One that goes"), body("on here"), body("(and on)."), body("next one."), {"kind": "list_item", "title": "T", "runs": [run("item")], "separator": " "}, body("more"), body("Big")])
    text = [r["plain"] for r in docmodel.block_text(layout.stitched(c)).orderBy("pos").collect()]
    assert text == ["One that goes on here (and on).", "next one.", "item more", "Big"]


def test_boxes_and_tables(spark):
    box = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"
    images = spark.createDataFrame([("d", 1, 0.0, 0.0, 60.0, 60.0), ("d", 1, 0.2, 0.0, 60.1, 60.0), ("d", 1, 0.0, 0.0, 40.0, 90.0), ("d", 1, 200.0, 0.0, 300.0, 80.0)], box)
    tables = spark.createDataFrame([("d", 1, 303.0, 0.0, 400.0, 80.0)], box)
    drawn = spark.createDataFrame([("d", 1, 0.0, 100.0 + 10 * i, 600.0, 110.0 + 10 * i) for i in range(10)], box)
    got = sorted((r["y0"], r["width_inches"]) for r in layout.image_regions(images, drawn, tables).collect())
    assert [round(w, 2) for _, w in got] == [0.83, 6.0]
    t = spark.createDataFrame([("d", 1, 0, ["a", "", "b", " "]), ("d", 1, 1, ["", "", " ", ""]), ("d", 1, 2, [" c ", "d", "", "e"])], "doc_id string, table_idx int, row_idx int, cells array<string>")
    assert [r["cells"] for r in layout.collapsed_table(t).orderBy("row_idx").collect()] == [["a", "b", ""], ["", "", ""], [" c ", "d", "e"]]
    cells = spark.createDataFrame([("d", 1, 0, i, x) for i, x in enumerate("aabba")], "doc_id string, table_idx int, row_idx int, col_idx int, text string")
    assert [(r["col_idx"], r["text"]) for r in layout.deduped_cells(cells).orderBy("col_idx").collect()] == [(0, "a"), (1, "b"), (2, "a")]


def test_fold_parity_rule_equals_greedy_pairs(spark):
    rng = random.Random(3)
    for _ in range(3):
        kinds = [rng.choice(("I.", "Text")) for _ in range(25)]
        b = blocks(spark, [{"kind": "heading", "level": 1, "runs": [run(k)]} for k in kinds])
        want, i = [], 0
        while i < len(kinds):
            if kinds[i] == "I." and i + 1 < len(kinds):
                want.append(f"I. {kinds[i + 1]}")
                i += 2
            else:
                want.append(kinds[i])
                i += 1
        assert [r["runs"][0]["text"] for r in layout.folded_markers(b).orderBy("pos").collect()] == want


def plain_live(chunks, entries):
    """{(key, entry_idx)} by comparing all spans of a text."""
    out = set()
    for key, scope, text in chunks:
        spans = [(at, at + len(f), i) for s, i, terms, *_ in entries if s is None or s == scope for f in {fold_text(t) for t in terms if t} if f for at in glossary.find_all(fold_text(text or ""), f)]
        out |= {(key, i) for s, e, i in spans if not any(j != i and b < e and s < c and c - b > e - s for b, c, j in spans)}
    return out


def scoped_tables(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "b c", "Çá", "ca", "a", "bca ab"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    entries = [(None, i, [words[i], words[i + 2]], text(1), [], "require") for i in range(3)]
    for d in range(40):
        entries += [(f"d{d}", 3 + k, [text(rng.randint(1, 2)), None, ""][: rng.randint(1, 3)], text(1), [text(1)], rng.choice(["require", "verbatim", "prefer"])) for k in range(rng.randint(0, 6))]
    # texts without a scope, of a scope without entries, empty and null ones; a third of all texts has one scope
    chunks = [(2**60 + n, None if n % 17 == 0 else "lone" if n % 19 == 0 else "d0" if n % 3 == 0 else f"d{rng.randrange(40)}", None if n % 23 == 0 else text(rng.randint(0, 9)), text(2)) for n in range(400)]
    e = spark.createDataFrame(entries, "scope string, entry_idx int, source_terms array<string>, target string, target_alts array<string>, kind string")
    return chunks, entries, spark.createDataFrame(chunks, "id long, scope string, text string, told string"), e


@pytest.mark.parametrize("sizes", [(8 << 20, 300), (12, 300)])
def test_a_glossary_for_each_document(spark, monkeypatch, sizes):
    monkeypatch.setattr(glossary, "BROADCAST_BYTES", sizes[0])
    monkeypatch.setattr(glossary, "SCOPE_BYTES", sizes[1])
    chunks, entries, c, e = scoped_tables(spark)
    want = plain_live([x[:3] for x in chunks], entries)
    got = glossary.live_terms(c, e, "id", "text").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want
    told = {k: fold_text(t) for k, _, _, t in chunks}
    scope = {k: s for k, s, *_ in chunks}
    rule = {(s, i): (terms, [target, *alts]) for s, i, terms, target, alts, kind in entries if kind != "prefer"}
    owner = lambda k, i: (None if i < 3 else scope[k], i)
    broken = {(k, i) for k, i in want if owner(k, i) in rule and not any(fold_text(t) in told[k] for t in rule[owner(k, i)][1])}
    rows = glossary.violations(c, e, "id", "text", "told").collect()
    assert {(r["id"], r["entry_idx"]) for r in rows} == broken and len(rows) == len(broken)
    assert all(f"render '{rule[owner(r['id'], r['entry_idx'])][0][0]}' as" in r["message"] for r in rows)
    sections = glossary.prompt_sections(c, e, "id", "text").collect()
    assert {r["id"]: r["section"].count("\n") for r in sections} == Counter(k for k, _ in want)


def test_no_glossaries_and_no_texts(spark):
    _, _, c, e = scoped_tables(spark)
    assert glossary.live_terms(c, e.limit(0), "id", "text").count() == 0 and glossary.live_terms(c.limit(0), e, "id", "text").count() == 0


def test_merges_of_tables_are_those_of_lists(spark):
    rng = random.Random(5)
    names = [*"abcdefgh", "É", "e", ""]
    some = lambda n: [Entry(rng.sample(names, rng.randint(0 if k else 1, 3)), rng.choice("xyz"), rng.sample("xyz", rng.randint(0, 1)), source=rng.choice(["", "mine"])) for k in range(n)]
    keep = lambda df: df.checkpoint()
    schema = "turn int, entry_idx int, source_terms array<string>, target string, target_alts array<string>, source string"
    frame = lambda gs: spark.createDataFrame([(t, i, e.source_terms, e.target, e.target_alts, e.source) for t, g in enumerate(gs) for i, e in enumerate(g)], schema)
    for sizes in ((5, 7, 6), (0, 12, 0), (0, 0, 0)):
        parts = [some(n) for n in sizes]
        got = glossary.combined_rows(frame(parts), keep).orderBy("turn", "entry_idx").collect()
        want = glossary.combined(*parts)
        assert [(r["source_terms"], r["target"], [tuple(v) for v in r["alt_versions"]]) for r in got] == [(e.source_terms, e.target, e.alt_versions) for e in want]
    for n, m in ((6, 12), (0, 9), (5, 0)):
        old, new = some(n), [e for e in some(m) if e.source_terms]
        want, report = glossary.upserted(old, new, ["A", "b", "é"])
        out, told = glossary.upserted_rows(frame([old]).drop("turn"), frame([new]).drop("turn"), keep, spark.createDataFrame([("A",), ("b",), ("é",)], "term string"))
        got = out.orderBy("turn", "entry_idx").collect()
        assert [(r["source_terms"], r["target"], r["target_alts"]) for r in got] == [(e.source_terms, e.target, e.target_alts) for e in want]
        rows = told.orderBy("entry_idx").collect()
        of = lambda outcome: [r["term"] for r in rows if r["outcome"] == outcome]
        assert (len(of("added")), of("unchanged"), of("updated")) == (report["added"], report["unchanged"], report["updated"])
        assert [{"term": r["term"], "kept": r["kept"], "offered": r["offered"]} for r in rows if r["outcome"] == "conflict"] == report["conflicts"]
