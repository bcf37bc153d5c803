"""Translation guards: masking, prompt parts, echo and runaway detection, cells, and the guarded translation itself."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import contains_any, strip
from . import glossary as G
from .ledger import Ledger

IDENTIFIER = r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"
#: Placeholders of masked identifiers, and the characters that make a cell data.
PLACEHOLDER = r"⟪V(\d+)⟫"
DATA_CHARS = r"(?U)[\d\s.,\-/+:%·–—$€£¥@#()\[\]]+"
#: Our own prompt wording, in two templates: for chat models, and for models made for translation only.
INSTRUCTIONS = (
    "You translate documents from {source} ({source_code}) to {target} ({target_code}).",
    "Return nothing but the translation.",
    "Keep asterisks around emphasised words, and leave codes in ⟪⟫ brackets as they are.",
)
SHORT_INSTRUCTIONS = ("Render the following {source} ({source_code}) passage in {target} ({target_code}), marks and codes unchanged.",)
SHORT_MODELS = ("translate",)
DOMAIN_CLAUSE = "The documents belong to this field: {domain}."
#: What could only come from a prompt: the fixed beginnings of everything that prompts are made of.
LEAKS = tuple(t.split("{")[0].strip(" :.\n").lower() for t in (*INSTRUCTIONS, *SHORT_INSTRUCTIONS, DOMAIN_CLAUSE, G.SECTION_HEAD, G.HINT_HEAD, G.ATTEMPT_HEAD, G.MEND_HEAD))
HINT_BULLET = re.escape(G.RENDER) + "[^']+" + re.escape(G.AS)
#: Language names and their codes.
LANGUAGES = {
    "Arabic": "ar", "Bengali": "bn", "Bulgarian": "bg", "Catalan": "ca", "Chinese": "zh-CN", "Croatian": "hr", "Czech": "cs",
    "Danish": "da", "Dutch": "nl", "English": "en", "Estonian": "et", "Filipino": "fil-PH", "Finnish": "fi", "French": "fr",
    "German": "de", "Greek": "el", "Gujarati": "gu", "Hebrew": "he", "Hindi": "hi", "Hungarian": "hu", "Icelandic": "is",
    "Indonesian": "id", "Italian": "it", "Japanese": "ja", "Kannada": "kn", "Korean": "ko", "Latvian": "lv", "Lithuanian": "lt",
    "Malayalam": "ml", "Marathi": "mr", "Norwegian": "no", "Persian": "fa", "Polish": "pl", "Portuguese": "pt", "Punjabi": "pa",
    "Romanian": "ro", "Russian": "ru", "Serbian": "sr", "Slovak": "sk", "Slovenian": "sl", "Spanish": "es", "Swahili": "sw",
    "Swedish": "sv", "Tamil": "ta", "Telugu": "te", "Thai": "th", "Turkish": "tr", "Ukrainian": "uk", "Urdu": "ur",
    "Vietnamese": "vi", "Zulu": "zu",
}


# ------------------------------------------------------------------------------------------------------- masking


def identifiers(text: Column) -> Column:
    """Every identifier occurrence, in order, repeats included: the registry, numbered from 0."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), 1)


def masked(text: Column) -> Column:
    """Each identifier occurrence replaced by its numbered placeholder."""
    pieces = F.split(text, r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("⟪V"), (i - 1).cast("string"), F.lit("⟫"), p))), "")


def unmasked(text: Column, registry: Column) -> Column:
    """Placeholders back to their identifiers; numbers outside the registry stay as they are."""
    pieces = F.split(text, "⟪V\\d+⟫", -1)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1), lambda n: n.cast("int"))
    name = lambda i: F.coalesce(F.get(registry, F.get(numbers, i - 1)), F.concat(F.lit("⟪V"), F.get(numbers, i - 1).cast("string"), F.lit("⟫")))
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(name(i), p))), "")


# --------------------------------------------------------------------------------------------------- prompt parts


def language_code(name: str, default: str) -> str:
    return LANGUAGES.get(name, default)


def prompt(text: Column, source: str, target: str, domain: str = "", section: Column | None = None, hint: Column | None = None, model: str = "") -> Column:
    """Instructions, terminology section, hint and text; models with one of SHORT_MODELS in their name get the short template."""
    short = any(m in model.lower() for m in SHORT_MODELS)
    head = " ".join(SHORT_INSTRUCTIONS if short else INSTRUCTIONS).format(source=source, target=target, source_code=language_code(source, "es"), target_code=language_code(target, "en"))
    if domain:
        head += " " + DOMAIN_CLAUSE.format(domain=domain)
    more = [F.coalesce(F.concat(p, F.lit("\n")), F.lit("")) for p in (section, hint) if p is not None]
    return F.concat(F.lit(head + "\n\n"), *more, text)


def is_echo(result: Column, domain: str = "") -> Column:
    """Output that repeats the prompt: a watched phrase in any case, or a terminology bullet."""
    phrases = [*LEAKS, *([DOMAIN_CLAUSE.format(domain=domain).lower()] if domain else [])]
    return contains_any(F.lower(result), phrases) | result.rlike(HINT_BULLET)


def output_budget(n: Column) -> Column:
    return F.greatest(F.lit(30), F.floor(n * 2 / 3)).cast("int")


def retry_budget(n: Column) -> Column:
    return F.greatest(F.lit(20), F.floor(n / 2) + 10).cast("int")


def is_data_cell(cell: Column) -> Column:
    """Blank cells are not data; others are if at most three letters remain without digits, currency and punctuation."""
    letters = F.regexp_replace(F.regexp_replace(cell, DATA_CHARS, ""), r"[^\p{L}]", "")
    return (strip(cell) != "") & (F.length(letters) <= 3)


def is_runaway(source: Column, output: Column, ratio: float = 4.0) -> Column:
    return (output != "") & (F.length(output) > F.length(source) * ratio + 50)


#: Texts that a backend is given at once; a task holds so many of them as Python texts, however large its batches are.
CALL_ROWS = 256


# ------------------------------------------------------------------------------------------------------- backends


class Backend(Protocol):
    """A translation model as seen from a task. Calls are external: results are written down before they are used twice."""

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str]: ...


class Echo:
    """Returns the text: for tests and dry runs."""

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str]:
        return list(texts)


class Dictionary:
    """Replaces whole words and phrases by a table, longest first; case is kept as in the table."""

    def __init__(self, table: dict[str, str]):
        self.table = {k.lower(): v for k, v in table.items()}
        self.find = re.compile("|".join(rf"\b{re.escape(k)}\b" for k in sorted(self.table, key=len, reverse=True)) or r"(?!)", re.I)

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str]:
        return [self.find.sub(lambda m: self.table[m[0].lower()], t) for t in texts]


class Http:
    """A model server with a chat interface that takes JSON; not verified against a real model here."""

    def __init__(self, url: str, model: str, timeout: float = 600):
        self.url, self.model, self.timeout = url, model, timeout

    def __call__(self, prompts: list[str], texts: list[str], budgets: list[int], temperature: float, seed: int) -> list[str]:
        import json
        import urllib.request

        out = []
        for p, n in zip(prompts, budgets, strict=True):
            body = {"model": self.model, "stream": False, "messages": [{"role": "user", "content": p}], "options": {"temperature": temperature, "num_predict": n, "seed": seed}}
            req = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(req, timeout=self.timeout) as r:
                out.append(json.load(r)["message"]["content"].strip())
        return out


def called(rows: DataFrame, backend: Backend, out: str, temperature: float = 0.3, seed: int = 42, model: str = "", ledger: Ledger | None = None) -> DataFrame:
    """rows with the backend's answer to prompt / masked / budget as a new column; with a ledger only what it lacks is asked."""
    if ledger is not None:
        return ledger.answered(rows, backend, out, temperature, seed, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, CALL_ROWS):
                part = b.slice(lo, CALL_ROWS)
                prompts, texts, budgets = (part.column(n).to_pylist() for n in ("prompt", "masked", "budget"))
                answers = backend(prompts, texts, [int(n) for n in budgets], temperature, seed)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*part.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


def guarded_translation(texts: DataFrame, key: str, text: str, backend: Backend, keep: Callable[[DataFrame], DataFrame], entries: DataFrame | None = None, source: str = "Spanish", target: str = "English", domain: str = "", seed: int = 42, model: str = "", ledger: Ledger | None = None) -> DataFrame:
    """(key, translated, kept_source, n_violations, retry_taken): mask, call, retry echoes, retry violations with a hint, unmask.

    An answer that repeats the prompt, or none, is asked for again at low temperature, and the source stays if that fails
    too. Violations are retried once with the previous attempt shown; the retry counts only without echo and with strictly
    fewer violations. Null texts stay null and are not sent. keep(df) must write df down (checkpoint or table): it is
    called after each model call. A ledger keeps answers over lost tasks and from run to run.
    """
    ask = lambda rows, out, temperature=0.3: called(rows, backend, out, temperature, seed, model, ledger)
    scope = ["scope"] if "scope" in texts.columns else []
    base = texts.select(F.col(key), *scope, F.col(text).alias("original"), masked(F.col(text)).alias("masked"), identifiers(F.col(text)).alias("registry")).where("original is not null")
    base = base.withColumn("budget", output_budget(F.length("masked")))
    if entries is not None:
        base = base.join(G.prompt_sections(base, entries, key, "masked"), key, "left")
        section = F.col("section")
    else:
        base, section = base.withColumn("section", F.lit(None).cast("string")), None
    failed = lambda c: F.coalesce(is_echo(F.col(c), domain), F.lit(True))
    first = keep(ask(base.withColumn("prompt", prompt(F.col("masked"), source, target, domain, section, model=model)), "answer")).withColumn("failed", failed("answer"))
    again = ask(first.where("failed"), "second", 0.1)
    now = first.where("not failed").withColumn("second", F.lit(None).cast("string")).unionByName(again)
    now = keep(now.withColumn("result", F.coalesce("second", "answer")).withColumn("echo", failed("result")))
    out = now.select(key, *scope, "original", "masked", "registry", "budget", "section", "result", "echo")
    retried = None
    if entries is not None:
        wrong = keep(G.violations(out.where(~F.col("echo")), entries, key, "masked", "result"))
        n = wrong.groupBy(key).agg(F.count(F.lit(1)).alias("n_wrong"))
        hint = G.hints(wrong.join(out.select(key, "result"), key), key, F.col("result"))
        todo = out.join(n, key).join(hint, key).withColumn("prompt", prompt(F.col("masked"), source, target, domain, section, F.col("hint"), model))
        retry = keep(ask(todo, "retry", 0.1)).withColumn("bad", failed("retry"))
        left = G.violations(retry, entries, key, "masked", "retry").groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
        better = ~F.col("bad") & (F.coalesce("n_left", F.lit(0)) < F.col("n_wrong"))
        retried = retry.join(left, key, "left").select(key, "retry", "n_wrong", better.alias("better"))
    if retried is not None:
        out = out.join(retried, key, "left")
    else:
        out = out.withColumns({"retry": F.lit(None).cast("string"), "n_wrong": F.lit(None).cast("long"), "better": F.lit(None).cast("boolean")})
    chosen = F.when(F.col("echo"), F.col("original")).otherwise(unmasked(F.when(F.coalesce("better", F.lit(False)), F.col("retry")).otherwise(F.col("result")), F.col("registry")))
    out = out.select(key, chosen.alias("translated"), F.col("echo").alias("kept_source"), F.coalesce("n_wrong", F.lit(0)).alias("n_violations"), F.coalesce("better", F.lit(False)).alias("retry_taken"))
    blank = texts.where(F.col(text).isNull()).select(key, F.lit(None).cast("string").alias("translated"), F.lit(False).alias("kept_source"), F.lit(0).cast("long").alias("n_violations"), F.lit(False).alias("retry_taken"))
    return out.unionByName(blank)


def cell_retry(backend: Backend, source: str = "Spanish", target: str = "English", domain: str = "", seed: int = 42, model: str = "", ledger: Ledger | None = None) -> Callable[[DataFrame], DataFrame]:
    """(cell_key, text) to (cell_key, retried): one more call at low temperature with a small budget."""

    def again(keys: DataFrame) -> DataFrame:
        asked = keys.withColumn("masked", F.col("text")).withColumn("prompt", prompt(F.col("text"), source, target, domain, model=model)).withColumn("budget", retry_budget(F.length("text")))
        return called(asked, backend, "retried", 0.1, seed, model, ledger).select("cell_key", F.col("retried"))

    return again


def translated_cells(cells: DataFrame, translate: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """table_cells with a translated column: each distinct stripped cell of a document is translated once.

    Blank, null and data cells pass through. translate takes (cell_key, text) and returns (cell_key, translated). An output
    over four times and 50 characters longer than its cell is asked for once more by again, and the cell stays unless
    that answer is there, is short enough and does not repeat the prompt.
    """
    c = cells.withColumn("_text", strip(F.col("text")))
    keys = c.where((F.col("_text") != "") & ~is_data_cell(F.col("_text"))).select("doc_id", "_text").distinct()
    keys = keys.withColumn("cell_key", F.sha2(F.concat_ws("\0", "doc_id", "_text"), 256))
    done = keep(keys.join(translate(keys.select("cell_key", F.col("_text").alias("text"))), "cell_key", "left"))
    wild = F.coalesce(is_runaway(F.col("_text"), F.col("translated")), F.lit(True))
    known = done.where(~wild).select("doc_id", "_text", F.col("translated").alias("_done"))
    if again is not None:
        runaway = done.where(wild)
        retried = keep(runaway.join(again(runaway.select("cell_key", F.col("_text").alias("text"))), "cell_key", "left"))
        fine = F.coalesce((F.col("retried") != "") & ~is_runaway(F.col("_text"), F.col("retried")) & ~is_echo(F.col("retried")), F.lit(False))
        known = known.unionByName(retried.where(fine).select("doc_id", "_text", F.col("retried").alias("_done")))
    return c.join(known, ["doc_id", "_text"], "left").withColumn("translated", F.coalesce("_done", "text")).drop("_text", "_done")


# ------------------------------------------------------------------------------------------------------- emphasis

#: Fixed value: emphasis of one to three asterisks, or a note marker.
EMPHASIS = re.compile(r"\*\*\*(?P<both>.+?)\*\*\*|\*\*(?P<bold>.+?)\*\*|\*(?P<italic>.+?)\*|‹FN(?P<note>\d+)›")
NOTE = re.compile(r"‹FN(\d+)›")
PIECE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.BooleanType()) for n in ("bold", "italic", "superscript"))]))


def emphasis_pieces(text: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, bold, italic, superscript) pieces of inline emphasis; note markers are plain superscripts wherever they stand."""
    out: list[tuple[str, bool, bool, bool]] = []

    def add(part: str, bold: bool, italic: bool) -> None:
        for k, piece in enumerate(NOTE.split(part)):
            if piece:
                out.append((piece, False, False, True) if k % 2 else (piece, bold, italic, False))

    at = 0
    for m in EMPHASIS.finditer(text):
        add(text[at : m.start()], False, False)
        kind = m.lastgroup
        if kind == "note":
            out.append((m["note"], False, False, True))
        else:
            add(m[kind], kind != "italic", kind != "bold")
        at = m.end()
    add(text[at:], False, False)
    return out


@F.pandas_udf(PIECE)
def emphasised(text: pd.Series) -> pd.Series:
    names = ("text", "bold", "italic", "superscript")
    return text.map(lambda t: [dict(zip(names, p, strict=True)) for p in emphasis_pieces(t or "")])
