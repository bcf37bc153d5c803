"""The two phases: build a glossary from documents, translate documents with it; and the check."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, docmodel, glossary, guards, terms
from ..operators.quality import report
from ..sources.sinks import snapshot


class Identifier(Protocol):
    """A model that names terms: segment texts to replies of KEEP: and TERM: lines."""

    def __call__(self, segments: list[str]) -> list[str]: ...


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where all runs on one machine."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="termloom-")
    return path.rstrip("/")


def keeper(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a table into the shared folder and reads it back, so that no model is called twice for one row."""
    folder = shared_folder(spark)

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/translate-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


#: Our own wording of the call that names a segment's terms, with the rules of the reply that parsed_lines reads.
IDENTIFY = """Below is a passage in {language}. Name its technical terms, institutions and identifiers, one a line and nothing else.
Write a line as one of
KEEP: name            for codes, addresses and proper names that no translation changes
TERM: full name | short form | other form            for all other terms, every form as the passage has it
Name nothing that the passage does not contain.

{text}"""
#: Our own wording of the call that translates terms; the reply's lines are read by parsed_targets.
TRANSLATE_TERMS = """Translate these {source} terms to {target}. Answer with one line a term: term → translation.

{lines}"""


def identified(segments: DataFrame, model: Identifier) -> DataFrame:
    """segments (doc_id, grp, text) with the model's reply."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(raw=model(list(pdf["text"])))

    return segments.select("doc_id", "grp", "text").mapInPandas(run, f"doc_id {dict(segments.dtypes)['doc_id']}, grp int, text string, raw string")


def extracted_terms(blocks: DataFrame, model: Identifier, translate: Callable[[list[str], list[str]], list[str]], keep: Callable[[DataFrame], DataFrame], snapshots: str | None = None) -> DataFrame:
    """Entries (doc_id, entry_idx, source_terms, target, kind) found in documents: segment, identify, parse, presence,
    merge, reclassify, disjoin, vote, unite, case, translate the first variants with their contexts, build.

    With snapshots, a folder, the tables of the stages are written there too."""
    shot = lambda df, name: snapshot(df, snapshots, name)
    segs = keep(identified(chunking.segments(docmodel.flat_texts(blocks, notes=False, headings=False)), model)).withColumn("seg", F.concat_ws("/", "doc_id", "grp"))
    lines = terms.present_only(terms.parsed_lines(segs, "seg", "raw"), segs, "seg", "text")
    lines = shot(keep(lines.join(segs.select("seg", "doc_id", "grp"), "seg")), "parsed")
    shot(segs, "segments")
    groups, kept = terms.merged_groups(lines, "doc_id", "grp"), terms.kept_terms(lines, "doc_id")
    kept, groups = terms.reclassified(kept, groups, "doc_id")
    kept = terms.without_conflicts(kept, groups, "doc_id")
    united = keep(terms.united(terms.voted(groups, "doc_id"), "doc_id").withColumn("variants", terms.normal_case(F.col("variants"))))
    shot(united, "groups")
    whole = segs.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "text"))), lambda s: s["text"]), "\n").alias("whole"))
    wanted = united.select("doc_id", F.element_at("variants", 1).alias("term")).distinct().join(whole, "doc_id").withColumn("context", terms.term_context(F.col("term"), F.col("whole"))).drop("whole")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), chunking.TERM_BATCH):
                part = pdf.iloc[at : at + chunking.TERM_BATCH]
                yield part[["doc_id", "term"]].assign(target=translate(list(part["term"]), [c or "" for c in part["context"]]))

    targets = keep(wanted.mapInPandas(ask, f"doc_id {dict(blocks.dtypes)['doc_id']}, term string, target string"))
    return shot(terms.built_entries(kept, united, shot(targets, "targets"), "doc_id"), "entries")


def batched_targets(ask: Callable[[list[str]], list[str]], source: str, target: str) -> Callable[[list[str], list[str]], list[str]]:
    """Translates a batch of terms in one call; a term whose line is missing in the reply has no target."""

    def translated(names: list[str], contexts: list[str]) -> list[str]:
        lines = "\n".join(f'- {n} [context: "{c}"]' if c else f"- {n}" for n, c in zip(names, contexts, strict=True))
        got = {}
        for line in ask([TRANSLATE_TERMS.format(source=source, target=target, lines=lines)])[0].split("\n"):
            name, arrow, told = line.strip().lstrip("-* ").partition("→")
            if arrow and told.strip():
                got[name.strip().lower()] = told.strip()
        return [got.get(n.lower(), "") for n in names]

    return translated


def symbolic_entries(blocks: DataFrame) -> DataFrame:
    """Verbatim entries for addresses and identifiers of documents, notes and headings included."""
    texts = docmodel.flat_texts(blocks)
    whole = texts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda s: s["part"]), "\n").alias("whole"))
    return terms.symbols(whole, "doc_id", "whole").select("doc_id", F.col("ord").alias("entry_idx"), F.array("symbol").alias("source_terms"), F.col("symbol").alias("target"), F.lit("verbatim").alias("kind"))


def translated_blocks(blocks: DataFrame, backend: guards.Backend, entries: DataFrame | None, keep: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    """(doc_id, pos, translated, title_translated) of every block with text.

    Headings without their number; list titles with their marker repaired; note markers back at their sentences; plain
    body paragraphs in chunks of three, each piece realigned, or on its own where the answer does not fit.
    """
    rows = keep(docmodel.routed(blocks).where("route <> 'none' and route <> 'table'"))
    number, rest = docmodel.split_number(F.col("markdown"))
    rows = rows.withColumn("number", F.when(F.col("kind") == "heading", number).otherwise("")).withColumn("own", F.when(F.col("kind") == "heading", rest).otherwise(F.col("markdown")))
    rows = rows.withColumn("markers", chunking.marker_sentences(F.col("own"))).withColumn("bare", F.regexp_replace("own", docmodel.NOTE_MARKER, ""))
    key = lambda *more: F.concat_ws("\1", F.col("doc_id"), F.col("pos").cast("string"), *map(F.lit, more))

    def run(texts: DataFrame) -> DataFrame:
        return guards.guarded_translation(texts.withColumn("scope", F.substring_index("key", "\1", 1)), "key", "text", backend, keep, entries, **options).select("key", "translated")

    alone = rows.where("route <> 'body'").select(key("b").alias("key"), F.col("bare").alias("text"))
    titles = rows.where("kind = 'list_item' and title <> ''").select(key("t").alias("key"), F.col("title").alias("text"))
    plain = rows.where("route = 'body'").withColumn("size", F.col("plain"))
    grouped = chunking.packed(plain.select("doc_id", "pos", "size"), "doc_id", "pos", "size", chunking.CHUNK_CHARS, chunking.CHUNK_BLOCKS).select("doc_id", "pos", "grp").join(plain.select("doc_id", "pos", "markdown"), ["doc_id", "pos"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "markdown"))), lambda s: s["markdown"])
    chunks = grouped.groupBy("doc_id", "grp").agg(parts.alias("parts"), F.array_sort(F.collect_list("pos")).alias("poss"))
    chunks = keep(chunks.withColumn("key", F.concat_ws("\1", "doc_id", F.col("grp").cast("string"), F.lit("c"))))
    text = F.when(F.size("parts") == 1, F.element_at("parts", 1)).otherwise(chunking.indexed_lines(F.col("parts")))
    done = keep(run(alone.unionByName(titles).unionByName(chunks.select("key", text.alias("text")))))
    answered = chunks.join(done, "key").withColumn("n_parts", F.size("parts"))
    pieces = chunking.realigned(answered.where("n_parts > 1"), "key", "n_parts", "translated")
    each = answered.select("key", "doc_id", "n_parts", F.col("translated").alias("whole"), F.posexplode(F.arrays_zip("poss", "parts")).alias("n", "x")).select("key", "doc_id", "n_parts", "whole", "n", F.col("x.poss").alias("pos"), F.col("x.parts").alias("source"))
    each = each.join(pieces, ["key", "n"], "left").withColumn("fits", (F.col("n_parts") == 1) | chunking.accepted(F.col("cand"), F.col("source")))
    each = keep(each.withColumn("translated", F.when(F.col("n_parts") == 1, F.col("whole")).otherwise(F.col("cand"))))
    again = run(each.where(~F.col("fits")).select(key("a").alias("key"), F.col("source").alias("text")))
    lone = each.where(~F.col("fits")).select("doc_id", "pos", key("a").alias("key")).join(again, "key").select("doc_id", "pos", "translated")
    body = each.where("fits").select("doc_id", "pos", "translated").unionByName(lone)
    other = rows.where("route <> 'body'").withColumn("key", key("b")).join(done, "key").withColumn("translated", F.concat("number", chunking.with_markers(F.col("translated"), F.col("markers"))))
    t = rows.where("kind = 'list_item'").withColumn("key", key("t")).join(done, "key").select("doc_id", "pos", docmodel.repaired_marker(F.col("title"), F.col("translated")).alias("title_translated"))
    return other.select("doc_id", "pos", "translated").unionByName(body).join(t, ["doc_id", "pos"], "left")


def run(blocks: DataFrame, cells: DataFrame, backend: guards.Backend, entries: list[glossary.Entry] | DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Phase two over whole collections: translated blocks, cells, statistics and the check of source against output.

    entries is one glossary for all documents, or a table whose scope names the document each entry is for.
    """
    spark = blocks.sparkSession
    keep = keeper(spark)
    table = glossary.entries_frame(spark, entries) if isinstance(entries, list) and entries else entries if isinstance(entries, DataFrame) else None
    done = keep(translated_blocks(blocks, backend, table, keep, **options))
    told = ("source", "target", "domain", "seed", "model", "ledger")
    again = guards.cell_retry(backend, **{k: v for k, v in options.items() if k in told})
    to_cells = lambda d: guards.guarded_translation(d, "cell_key", "text", backend, keep, table, **options).select("cell_key", "translated")
    new_cells = keep(guards.translated_cells(cells, to_cells, again, keep))
    new = blocks.join(done, ["doc_id", "pos"], "left")
    out_blocks = new.withColumn("runs", F.when(F.col("runs").isNotNull(), F.transform(F.slice("runs", 1, 1), lambda r: F.struct(F.coalesce("translated", r["text"]).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), r["size"].alias("size"))))).withColumn("text", F.coalesce(F.when(F.col("runs").isNull(), F.col("translated")), "text")).select(*blocks.columns)
    return {"blocks": done, "cells": new_cells, "stats": docmodel.doc_stats(blocks), "check": report(blocks, out_blocks, cells, new_cells.withColumn("text", F.col("translated")))}
