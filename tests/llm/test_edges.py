"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every text operator and stage."""

import re

import corpus_pipeline
from termloom.llm import byte_bpe, language, mixing, pii, simhash, token_files


def ids(df, name="doc_id"):
    return sorted((r[name] for r in df.collect()), key=lambda v: (v is None, v))


def test_byte_bpe(nasty, empty):
    out = byte_bpe.round_trip(nasty, byte_bpe.ranks_file())
    assert ids(out) == ids(nasty)
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()}[3] == 0
    assert byte_bpe.round_trip(empty, byte_bpe.ranks_file()).count() == 0
    enc = byte_bpe.encode(nasty, byte_bpe.ranks_file())
    back = {r["doc_id"]: bytes(r["content"]).decode() for r in byte_bpe.decode(enc, byte_bpe.ranks_file()).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in nasty.collect() if r["doc_id"] is not None)


def test_simhash(nasty, empty):
    rows = simhash.simhash_groups(nasty).collect()
    assert len(rows) == nasty.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    assert by[3]["fingerprint"] == by[4]["fingerprint"] == "0" * 16 and by[5]["component_id"] == 3
    assert simhash.simhash_groups(empty).count() == 0
    kept = simhash.one_of_each(nasty)
    assert kept.columns == nasty.columns
    assert ids(kept) == [1, 3, 6, 7, 8, 9, None]
    assert simhash.one_of_each(empty).count() == 0


def test_language(nasty, empty):
    model = language.fit(nasty)
    rows = {r["doc_id"]: r for r in language.identify(nasty, model).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[8]["lang_pred"] == "und" and rows[3]["score"] == 0
    assert language.identify(nasty, model).count() == nasty.count()
    assert language.fit(empty) is None
    assert {r["lang_pred"] for r in language.identify(nasty, None).collect()} == {"und"}
    assert language.identify(empty, None).count() == 0


def test_pii(nasty, empty):
    model = pii.fit()
    rows = {r["doc_id"]: r for r in pii.detect(nasty, model).collect()}
    assert (rows[9]["n_email"], rows[9]["n_ip"], rows[9]["n_phone"], rows[9]["n_card"]) == (1, 1, 1, 0)
    assert rows[3]["spans"] == "" and rows[4]["base_sha256"].startswith("e3b0c442")
    assert pii.detect(empty, model).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.redact(nasty, model).collect()}
    assert clean[9] == "write to [EMAIL] or [IP] or [PHONE] now" and clean[3] is None
    assert pii.redact(nasty, model).columns == nasty.columns


def test_mixing(nasty, empty):
    rows = mixing.mix(nasty).collect()
    assert len(rows) == nasty.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_rows(nasty).columns == nasty.columns
    assert mixing.mixed_rows(empty).count() == 0


def test_token_files(spark, nasty, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(nasty, path, token_files.vocabulary_file())
    rows = token_files.read_tokens(spark, path).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"]) for r in rows), key=str) == sorted(((i is None, i) for i in ids(nasty)), key=str)
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    token_files.write_tokens(empty, f"{path}-empty", token_files.vocabulary_file())
    assert token_files.read_tokens(spark, f"{path}-empty").count() == 0


def test_stages(spark, nasty, empty):
    """Each stage keeps the columns, takes empty input, and its decisions take effect on the next one's input."""
    for docs in (nasty, empty):
        for _name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
    kept = corpus_pipeline.language_stage(spark, nasty, "")
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 6, 7, 9} and 3 not in ids(kept)
    assert len(corpus_pipeline.STAGES) == 5 and all(re.fullmatch(r"\w+", n) for n, _ in corpus_pipeline.STAGES)
