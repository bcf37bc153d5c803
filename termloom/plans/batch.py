"""A folder of documents through the phases: names of outputs, glossary files, run log; and the command line.

    python -m termloom.plans.batch IN OUT --url http://host/api/chat --model NAME [--glossary-only | --translate-only]
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary, guards
from ..operators.docmodel import block_text
from ..operators.ledger import Ledger
from ..sources import files, sinks
from ..sources.docx_write import word_documents
from . import translate

PHASES = ("glossary", "translate")
GLOSSARY_END = "_glossary.txt"


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def output_names(path: str, stamp: str | None = None) -> dict[str, str]:
    """Names that go with a document: translation, siblings and glossary; a stamp comes before the suffix."""
    base = stem(path) + "_translated" + (f"_{stamp}" if stamp else "")
    return {"document": base, "tables": f"{base}_tables", "footnotes": f"{base}_footnotes", "comments": f"{base}_comments", "glossary": stem(path) + GLOSSARY_END}


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y-%m-%d_%H%M")


def chosen_phases(phases: list[str] | None = None, glossary_only: bool = False, translate_only: bool = False) -> tuple[str, ...]:
    """An explicit list first, then glossary only, then translation only; both by default. Unknown names are refused."""
    got = tuple(phases) if phases else PHASES[:1] if glossary_only else PHASES[1:] if translate_only else PHASES
    if not set(got) <= set(PHASES):
        raise ValueError(f"phases are {', '.join(PHASES)}")
    return got


def glossary_files(blocks: DataFrame, user: list[glossary.Entry] | None, identify: translate.Identifier, to_target: Callable[[list[str], list[str]], list[str]], snapshots: str | None = None) -> DataFrame:
    """(doc_id, lines): each document's glossary file: its extracted and symbolic entries merged with the user's, and notes.

    Documents are merged by the executors; the user's glossary, a hand-edited file, goes to each.
    """
    spark = blocks.sparkSession
    found = translate.extracted_terms(blocks, identify, to_target, translate.keeper(spark), snapshots).select("doc_id", F.lit(0).alias("part"), "entry_idx", "source_terms", "target", "kind")
    both = found.unionByName(translate.symbolic_entries(blocks).withColumn("part", F.lit(1)))
    every = blocks.select("doc_id").distinct().join(both, "doc_id", "left")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: tuple[list, list] = ([], [])
        seen: set[str] = set()
        for r in pdf.dropna(subset=["part"]).sort_values(["part", "entry_idx"], kind="stable").itertuples():
            terms = [t for t in r.source_terms if t.lower() not in seen]
            if terms:
                parts[int(r.part)].append(glossary.Entry(terms, r.target, kind=r.kind))
                seen.update(t.lower() for t in terms)
        entries, notes = glossary.final_merge(*parts, user)
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[:1], "lines": [glossary.file_lines(entries, notes)]})

    return every.groupBy("doc_id").applyInPandas(merged, f"doc_id {dict(blocks.dtypes)['doc_id']}, lines array<string>")


def read_glossaries(spark: SparkSession, paths: DataFrame, folder: str, user: list[glossary.Entry] | None) -> tuple[DataFrame, DataFrame]:
    """(entries with their document as scope, documents without a glossary file) of the documents paths (doc_id).

    Entries are numbered a document, after the user's, which concern every document.
    """
    name = F.concat(F.regexp_replace(F.regexp_extract("doc_id", "([^/]+)$", 1), r"\.[^.]*$", ""), F.lit(GLOSSARY_END))
    wanted = paths.select("doc_id", name.alias("name"))
    if any(True for _ in sinks.listed(spark, folder, "*" + GLOSSARY_END)):
        whole = spark.read.option("wholetext", True).text(f"{folder}/*{GLOSSARY_END}").select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), "value")
        whole = whole.withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B")))
    else:
        whole = spark.createDataFrame([], "file string, value string")
    files = wanted.join(whole, F.col("name") == F.col("file"), "left")
    lines = files.select("doc_id", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line"))
    own = lines.select(F.struct("doc_id", "n").alias("line_no"), "line")
    entries = glossary.parsed(own).select(F.col("line_no.doc_id").alias("scope"), F.col("line_no.n").alias("n"), "var_no", "source_terms", "target", "target_alts", "kind")
    entries = glossary.numbered(entries, "n", "var_no", scope="scope", after=len(user or ())).drop("n", "var_no")
    if user:
        entries = entries.unionByName(glossary.entries_frame(spark, user).select(F.lit(None).cast("string").alias("scope"), "source_terms", "target", "target_alts", "kind", "entry_idx"))
    return entries, files.where("value is null").select("doc_id")


def run_folder(spark: SparkSession, source: str, target: str, backend: guards.Backend, identify: translate.Identifier | None = None, to_target: Callable | None = None, user: object = None, phases: tuple[str, ...] = PHASES, rebuild: bool = False, archive: bool = False, snapshots: str | None = None, stamp: str | None = None, target_lang: str = "English", **options) -> dict[str, DataFrame]:
    """Both phases over a folder's documents, or one document's path. Files that cannot be read are listed under failed and
    end nothing.

    Each document has its own glossary file under target; one that is there is read and not built again, unless rebuild.
    user=False means no glossary at all; translating alone needs one for every document. Results under target: a Word
    file and the glossary a document, and Parquet of blocks, cells, statistics, the check and markdown. archive deletes
    the glossary files at the end.
    """
    found = files.folder(spark, source)
    keep = translate.keeper(spark)
    blocks, cells, bad = files.extracted(found, keep)
    blocks, cells = keep(blocks), keep(cells)
    paths = blocks.select("doc_id").distinct()
    given = glossary.coerce(spark, user)
    if given is False and phases == PHASES[:1]:
        raise ValueError("there is nothing to build without a glossary")
    entries = None
    if given is not False:
        entries, lacking = read_glossaries(spark, paths, target, given or None)
        if "glossary" in phases and identify is not None:
            todo = blocks if rebuild else blocks.join(lacking, "doc_id", "left_semi")
            made = keep(glossary_files(todo, given or None, identify, to_target, snapshots))
            name = F.concat(F.regexp_replace(F.regexp_extract("doc_id", "([^/]+)$", 1), r"\.[^.]*$", ""), F.lit(GLOSSARY_END))
            sinks.write_files(made.select(name.alias("name"), F.concat(F.array_join("lines", "\n"), F.lit("\n")).cast("binary").alias("content")), target)
            entries, lacking = read_glossaries(spark, paths, target, given or None)
        elif "translate" in phases and "glossary" not in phases and not given and lacking.limit(1).count():
            raise ValueError("no glossary: " + ", ".join(sorted(stem(r["doc_id"]) for r in lacking.limit(20).collect())))
    out: dict[str, DataFrame] = {"failed": bad}
    if "translate" in phases:
        done = translate.run(blocks, cells, backend, entries, target=target_lang, **options)
        for name, df in done.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}")
            out[name] = spark.read.parquet(f"{target}/{name}")
        whole = blocks.join(out["blocks"], ["doc_id", "pos"], "left")
        text = block_text(whole).withColumn("markdown", F.coalesce("translated", "markdown")).withColumn("title", F.coalesce("title_translated", "title"))
        sinks.markdown_documents(text).write.mode("overwrite").parquet(f"{target}/documents")
        out["documents"] = spark.read.parquet(f"{target}/documents")
        name = F.concat(F.regexp_replace(F.regexp_extract("doc_id", "([^/]+)$", 1), r"\.[^.]*$", ""), F.lit("_translated" + (f"_{stamp}" if stamp else "") + ".docx"))
        sinks.write_files(word_documents(whole, out["cells"]).select(name.alias("name"), "content"), target)
        sinks.append_report(out["check"], f"{target}/warnings")
    sinks.append_log(spark, f"{target}/runs", {"timestamp": run_stamp(), "input": source, "output": target, "glossary": given is not False, "phases": list(phases), "model": options.get("model", "")})
    if archive:
        for path in sinks.listed(spark, target, "*" + GLOSSARY_END):
            sinks.delete_file(spark, path)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="termloom", description="Translate a folder of documents.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--source-lang", default="Spanish")
    p.add_argument("--target-lang", default="English")
    p.add_argument("--url", default="http://localhost:11434/api/chat")
    p.add_argument("--model", required=True)
    p.add_argument("--phases", nargs="*")
    p.add_argument("--glossary-only", action="store_true")
    p.add_argument("--translate-only", action="store_true")
    p.add_argument("--no-glossary", action="store_true")
    p.add_argument("--base-glossary")
    p.add_argument("--domain", default="")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--review-model", help="the model that names and translates terms, if another one")
    p.add_argument("--force-rebuild", action="store_true")
    p.add_argument("--archive-glossary", action="store_true")
    p.add_argument("--dump-dir")
    p.add_argument("--timestamp", action="store_true")
    p.add_argument("--ledger", help="a shared folder of answers: a run that is started again asks for what is missing there")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    model, reviewer = guards.Http(a.url, a.model), guards.Http(a.url, a.review_model or a.model)
    try:
        phases = chosen_phases(a.phases, a.glossary_only, a.translate_only)
        ask = lambda prompts, n: reviewer(prompts, prompts, [n] * len(prompts), 0.1, a.seed)
        identify = lambda texts: ask([translate.IDENTIFY.format(language=a.source_lang, text=t) for t in texts], 512)
        to_target = translate.batched_targets(lambda prompts: ask(prompts, 1024), a.source_lang, a.target_lang)
        run_folder(spark, a.source, a.target, model, identify, to_target, False if a.no_glossary else a.base_glossary, phases, a.force_rebuild, a.archive_glossary, a.dump_dir, run_stamp() if a.timestamp else None, source=a.source_lang, target_lang=a.target_lang, domain=a.domain, seed=a.seed, model=a.model, ledger=Ledger(a.ledger) if a.ledger else None)
    except ValueError as x:
        raise SystemExit(str(x)) from x


if __name__ == "__main__":
    main()
