"""Glossary lines, matching with longest-match precedence, violations and merge algebra."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_each, fold_text, strip

#: The rule lines' form.
RULE = r"(?iU)^(TRANSLATE|KEEP|PREFER):\s*(.+?)(?:\s*→\s*(.+))?$"
PREFIX = r"(?iU)^(TRANSLATE|KEEP|PREFER):\s*(.*)$"
LINES = "line_no int, line string"
HEADER = ("# Glossary of this document. Edit freely before translation.", "# TRANSLATE: source → target  (checked)", "# KEEP: term  (stays as it is)", "# PREFER: source → target  (a hint)", "# Several source forms of one thing: a | b | c", "# Lines that begin with # are notes.")
#: Beyond so many bytes of terms the glossary is not sent to every task at once but slice by slice.
BROADCAST_BYTES = 8 << 20
#: Texts that are Python objects at once, however large a task's batches are.
TEXT_ROWS = 1000
#: A document's texts beyond so many bytes are dealt to several tasks.
SCOPE_BYTES = 64 << 20
#: So many documents with more than one task are sent to all tasks as a table.
MANY_SCOPES = 100_000
#: Our own wording of what a model is told about terms; guards watch for it in answers.
SECTION_HEAD = "Vocabulary of this document (source → target); use it wherever it applies:"
UNCHANGED = "  (leave as is)"
HINT_HEAD = "Vocabulary this passage needs:"
ATTEMPT_HEAD = "Earlier attempt at this passage:"
MEND_HEAD = "It misses some vocabulary. Mend only the following:"
RENDER, AS = "render '", "' as "


def variants(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), strip), lambda v: v != "")


# ------------------------------------------------------------------------------------------------ lines and entries


def parsed(lines: DataFrame) -> DataFrame:
    """Entries of rule lines (line_no, line): line_no, var_no, source_terms, target, target_alts, kind.

    KEEP gives an entry a variant; TRANSLATE needs a target, which may list alternates; PREFER's target is by default
    the first variant. Notes, blank and unknown lines give nothing.
    """
    x = lines.withColumn("line", strip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    x = x.withColumn("rule", F.upper(F.regexp_extract("line", RULE, 1))).where("rule <> ''")
    x = x.withColumn("src", strip(F.regexp_extract("line", RULE, 2))).withColumn("tgt", strip(F.regexp_extract("line", RULE, 3)))
    v = variants(F.col("src"))
    x = x.withColumn("v", F.when(F.size(v) > 0, v).otherwise(F.array("src")))
    t = variants(F.col("tgt"))
    x = x.withColumn("t", F.when(F.size(t) > 0, t).otherwise(F.array("tgt")))
    none = F.array().cast("array<string>")
    entry = lambda s, g, a, k: F.struct(s.alias("source_terms"), g.alias("target"), a.alias("target_alts"), F.lit(k).alias("kind"))
    made = (
        F.when(F.col("rule") == "KEEP", F.transform("v", lambda s: entry(F.array(s), s, none, "verbatim")))
        .when((F.col("rule") == "TRANSLATE") & (F.col("tgt") != ""), F.array(entry(F.col("v"), F.element_at("t", 1), F.slice("t", F.lit(2), F.greatest(F.size("t"), F.lit(1))), "require")))
        .when(F.col("rule") == "PREFER", F.array(entry(F.col("v"), F.when(F.col("tgt") != "", F.col("tgt")).otherwise(F.element_at("v", 1)), none, "prefer")))
    )
    return x.select("line_no", F.posexplode(made).alias("var_no", "e")).select("line_no", "var_no", "e.*")


def numbered(entries: DataFrame, *order: str, scope: str | None = None, after: int = 0) -> DataFrame:
    """entry_idx in the given order, from after on: of one small glossary, or of each scope's."""
    window = Window.partitionBy(scope) if scope else Window.partitionBy(F.lit(0))
    return entries.withColumn("entry_idx", F.row_number().over(window.orderBy(*order)) + (after - 1))


def issues(lines: DataFrame) -> DataFrame:
    """(line_no, level, message) of rule lines (numbered from 1) that would be dropped (error) or misread (warning)."""
    x = lines.withColumn("line", strip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rule, rest = F.upper(F.regexp_extract("line", PREFIX, 1)), strip(F.regexp_extract("line", PREFIX, 2))
    arrow = F.contains("rest", F.lit("→"))
    ascii_arrow = F.contains("line", F.lit("->")) & ~F.contains("line", F.lit("→"))
    x = x.withColumn("rule", rule).withColumn("rest", rest).withColumn("ascii", ascii_arrow)
    x = x.withColumn("src", F.when(arrow, strip(F.substring_index("rest", "→", 1))).otherwise(F.col("rest"))).withColumn("tgt", F.when(arrow, strip(F.regexp_replace("rest", "^[^→]*→", ""))).otherwise(F.lit("")))
    say = lambda level, text: F.array(F.struct(F.lit(level).alias("level"), F.lit(text).alias("message")))
    none = F.array().cast("array<struct<level:string,message:string>>")
    soft = F.concat(
        F.when((F.col("rule") == "KEEP") & (F.col("tgt") != ""), say("warning", "KEEP takes no target")).otherwise(none),
        F.when((F.col("rule") == "PREFER") & (F.col("tgt") == "") & F.col("ascii"), say("warning", "the arrow must be →")).otherwise(none),
        F.when(F.size(variants(F.col("src"))) == 0, say("error", "no source term")).otherwise(none),
    )
    found = (
        F.when(F.col("rule") == "", say("error", "unknown rule"))
        .when(F.col("rest") == "", say("error", "nothing after the colon"))
        .when(F.col("rest").startswith("→"), say("error", "no source term"))
        .when((F.col("rule") == "TRANSLATE") & (F.col("tgt") == "") & F.col("ascii"), say("error", "the arrow must be →"))
        .when((F.col("rule") == "TRANSLATE") & (F.col("tgt") == ""), say("error", "no target"))
        .otherwise(soft)
    )
    return x.select("line_no", F.explode(found).alias("i")).select("line_no", "i.level", "i.message")


def entry_line(source_terms: Column, target: Column, alts: Column, kind: Column) -> Column:
    src = F.array_join(source_terms, " | ")
    tgt = F.array_join(F.concat(F.array(target), alts), " | ")
    plain = (target == "") | (target == F.coalesce(F.try_element_at(source_terms, F.lit(1)), F.lit("")))
    return F.when(kind == "verbatim", F.concat(F.lit("KEEP: "), src)).when(kind == "require", F.concat(F.lit("TRANSLATE: "), src, F.lit(" → "), tgt)).when(plain, F.concat(F.lit("PREFER: "), src)).otherwise(F.concat(F.lit("PREFER: "), src, F.lit(" → "), target))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a glossary file, numbered from 1."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line")).select((F.col("n") + 1).alias("line_no"), "line")


def file_lines(entries: Iterable[Entry], notes: Iterable[str] = ()) -> list[str]:
    """Lines of a glossary file: drafts before approved entries where every entry is one of these and both occur."""
    entries = list(entries)
    drafts, approved = ([e for e in entries if e.origin == o] for o in ("draft", "approved"))
    out = [*HEADER, ""]
    if drafts and approved and len(drafts) + len(approved) == len(entries):
        out += ["# --- new in this document, not reviewed:", *map(Entry.line, drafts), "", "# --- approved before:", *map(Entry.line, approved)]
    else:
        out += map(Entry.line, entries)
    return [*out, *(f"# NEEDS A DECISION: {n}" for n in notes)]


# ------------------------------------------------------------------------------------------------------- matching


def folded_terms(entries: DataFrame) -> DataFrame:
    """(entry_idx, term): folded, non-empty source terms."""
    return entries.select("entry_idx", F.explode("source_terms").alias("t")).select("entry_idx", fold(F.col("t")).alias("term")).where("term <> ''").distinct()


def find_all(text: str, term: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too."""
    out, at = [], text.find(term)
    while at >= 0:
        out.append(at)
        at = text.find(term, at + 1)
    return out


def term_slices(entries: DataFrame) -> list[pd.DataFrame]:
    """The folded terms, checked for their size: one table up to 8 MB, else slices of that size."""
    terms = folded_terms(entries)
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n = int(size // BROADCAST_BYTES) + 1
    return [(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) if n > 1 else terms).toPandas() for k in range(n)]


def occurrences(chunks: DataFrame, entries: DataFrame, key: str, text: str, slices: list[pd.DataFrame] | None = None) -> DataFrame:
    """(key, entry_idx, s, e): every substring occurrence of a folded term in the folded text, overlapping ones included.

    The texts are folded and searched in one pass for each slice of the glossary's terms.
    """
    out = None
    for part in slices or term_slices(entries):
        find = _finder(zip(part["entry_idx"], part["term"], strict=True))

        def run(batches: Iterator[pa.RecordBatch], find: Callable = find) -> Iterator[pa.RecordBatch]:
            for own in pieces(batches):
                rows = [(k, i, s, e) for k, text in zip(*(c.to_pylist() for c in own.columns), strict=True) if text for s, e, i in find(fold_text(text))]
                yield found_rows(rows, [own.schema.field(0).type, *[pa.int32()] * 3], [key, "entry_idx", "s", "e"])

        found = chunks.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {dict(chunks.dtypes)[key]}, entry_idx int, s int, e int")
        out = found if out is None else out.unionByName(found)
    return out


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches by TEXT_ROWS rows."""
    return (b.slice(lo, TEXT_ROWS) for b in batches for lo in range(0, b.num_rows, TEXT_ROWS))


def found_rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], names)


def _finder(terms: Iterable[tuple[int, str]]) -> Callable[[str], list[tuple[int, int, int]]]:
    """A search for all (start, end, entry) of the terms (entry, term) in a folded text; an automaton where there are many terms."""
    owners: dict[str, list[int]] = {}
    for i, t in terms:
        owners.setdefault(t, []).append(int(i))
    made: list = []

    def find(text: str) -> list[tuple[int, int, int]]:
        if len(owners) <= 40:
            return [(at, at + len(t), i) for t, own in owners.items() if t in text for at in find_all(text, t) for i in own]
        if not made:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for t, own in owners.items():
                automaton.add_word(t, (len(t), own))
            automaton.make_automaton()
            made.append(automaton)
        return [(end + 1 - n, end + 1, i) for end, (n, own) in made[0].iter(text) for i in own]

    return find


def live(spans: list[tuple[int, int, int]]) -> list[int]:
    """Entries of (start, end, entry) spans of one text with a span that no strictly longer span of another entry overlaps.

    Spans of one length are kept in order, so those that overlap a span are a slice of each longer length, and a slice
    holds another entry if its first span or the next different one does.
    """
    by: dict[int, list[tuple[int, int]]] = {}
    for s, e, i in spans:
        by.setdefault(e - s, []).append((s, i))
    if len(by) < 2:
        return sorted({i for _, _, i in spans})
    longer: list[tuple[int, list[int], list[int], list[int]]] = []
    out: set[int] = set()
    for n in sorted(by, reverse=True):
        own = sorted(by[n])
        for s, i in own:
            if i in out:
                continue
            for m, starts, entries, change in longer:
                lo, hi = bisect_right(starts, s - m), bisect_left(starts, s + n)
                if lo < hi and (entries[lo] != i or change[lo] < hi):
                    break
            else:
                out.add(i)
        change = [len(own)] * len(own)
        for k in range(len(own) - 2, -1, -1):
            change[k] = k + 1 if own[k][1] != own[k + 1][1] else change[k + 1]
        longer.append((n, [s for s, _ in own], [i for _, i in own], change))
    return sorted(out)


def live_terms(chunks: DataFrame, entries: DataFrame, key: str, text: str, told: str | None = None, accepted: dict[int, list[str]] | None = None) -> DataFrame:
    """(key, entry_idx) of the live entries of each text; with told and accepted only those none of whose accepted folded
    forms the folded told has. One pass over the texts, where liveness is decided too; a glossary beyond 8 MB takes a pass
    a slice and joins the spans by key. Where both tables have a scope, see live_in_scopes."""
    if scoped(chunks, entries):
        return live_in_scopes(chunks, entries, key, text, told=told).select(key, "entry_idx")
    slices = term_slices(entries)
    src = chunks.select(F.col(key), F.col(text).alias("_text"), *([F.col(told).alias("_told")] if told else []))
    if len(slices) > 1:
        found = live_entries(occurrences(chunks, entries, key, text, slices), key)
        if not told:
            return found
        src = src.drop("_text").join(found.groupBy(key).agg(F.collect_set("entry_idx").alias("_live")), key)
        of_row = lambda b: b.column("_live").to_pylist()
    else:
        find = _finder(zip(slices[0]["entry_idx"], slices[0]["term"], strict=True))
        of_row = lambda b: (live(find(fold_text(t))) if t else () for t in b.column("_text").to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, keys = [], b.column(key).to_pylist()
            for k, own, said in zip(keys, of_row(b), b.column("_told").to_pylist() if told else keys, strict=True):
                if told and len(own):
                    said = fold_text(said or "")
                    own = [i for i in own if i in accepted and not any(t in said for t in accepted[i])]
                rows += [(k, i) for i in own]
            yield found_rows(rows, [b.schema.field(key).type, pa.int32()], [key, "entry_idx"])

    return src.mapInArrow(run, f"`{key}` {dict(chunks.dtypes)[key]}, entry_idx int")


def scoped(chunks: DataFrame, entries: DataFrame) -> bool:
    return "scope" in chunks.columns and "scope" in entries.columns


def is_rule() -> Column:
    return F.col("kind").isin("require", "verbatim")


def live_in_scopes(chunks: DataFrame, entries: DataFrame, key: str, text: str, payload: Column | None = None, told: str | None = None) -> DataFrame:
    """(key, entry_idx, payload) of the live entries of each text where each document (scope) has a glossary of its own.

    Entries without a scope concern every text, texts without a scope meet only these. entry_idx is unique among the
    entries of a scope and those of none, which are numbered first. With told only rules that the told text breaks.

    One shuffle by scope: a task meets a scope's entries first and streams the scope's texts through their search, so no
    text meets the terms of another document. A scope with much text is dealt to several tasks, each with its entries; a
    glossary of more than BROADCAST_BYTES is dealt by term, and liveness is decided from the spans by key.
    """
    accepted = F.when(is_rule(), F.concat(F.array("target"), F.coalesce("target_alts", F.array().cast("array<string>"))))
    e = entries.select("scope", "entry_idx", "source_terms", accepted.alias("accepted"), (F.lit(None) if payload is None else payload).cast("string").alias("payload"))
    size = F.coalesce(F.octet_length(F.concat_ws("", "source_terms", "accepted", "payload")), F.lit(0)).cast("long")
    common = e.where("scope is null")
    last, common_bytes = common.agg(F.max("entry_idx"), F.sum(size)).first()
    wide = (common_bytes or 0) > BROADCAST_BYTES
    share = lambda n, most: (1 + F.floor(F.coalesce(n, F.lit(0)) / most)).cast("int")
    of_terms = e.where("scope is not null").groupBy("scope").agg(share(F.sum(size), BROADCAST_BYTES).alias("parts"), F.lit(1).alias("salts"))
    of_texts = chunks.groupBy("scope").agg(F.lit(1).alias("parts"), share(F.sum(F.octet_length(text)), SCOPE_BYTES).alias("salts"))
    odd = of_terms.where("parts > 1").unionByName(of_texts.where("salts > 1")).groupBy("scope").agg(F.max("parts").alias("parts"), F.max("salts").alias("salts"))
    few = odd.limit(MANY_SCOPES + 1).collect()
    spans_only = wide or any(r["parts"] > 1 for r in few) or (len(few) > MANY_SCOPES and odd.where("parts > 1").limit(1).count() > 0)
    if len(few) <= MANY_SCOPES:
        odd = F.broadcast(chunks.sparkSession.createDataFrame(few, "scope string, parts int, salts int"))
    odd = odd.withColumnRenamed("scope", "_scope")

    def dealt(df: DataFrame) -> DataFrame:
        more = df.join(odd, F.col("scope").eqNullSafe(F.col("_scope")), "left") if few else df.withColumns({"parts": F.lit(1), "salts": F.lit(1)})
        return more.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("parts", "salts")})

    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    texts = dealt(chunks.select("scope", F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(told or text).alias("_told")))
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("_key"), F.col("salts")).cast("int")).withColumn("part", every("parts"))
    own = dealt(e.where("scope is not null")).withColumn("salt", every("salts")).withColumn("part", every("parts"))
    own = own.withColumn("source_terms", F.filter("source_terms", lambda t: F.pmod(F.xxhash64(t), F.col("parts")) == F.col("part")))
    both = own.unionByName(texts, allowMissingColumns=True).withColumn("is_text", F.col("entry_idx").isNull())
    # as many tasks as shuffles have: the search takes longer than the bytes tell
    both = both.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "scope", "part", "salt").sortWithinPartitions("scope", "part", "salt", "is_text")
    names = ("scope", "part", "salt", "is_text", "_key", "_text", "_told", "entry_idx", "source_terms", "accepted", "payload")
    # at most BROADCAST_BYTES
    shared = [] if wide else [(r["entry_idx"], r["source_terms"], r["accepted"], r["payload"]) for r in common.collect()]
    broken = told is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_all, known = _entries_of(shared)
        here, own_rows, of_own = None, [], None
        for batch in pieces(batches):
            keys, out = [], []
            for scope, part, salt, is_text, k, t, said, *entry in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if (scope, part, salt) != here:
                    here, own_rows, of_own = (scope, part, salt), [], None
                if not is_text:
                    own_rows.append(entry)
                    continue
                if of_own is None:
                    of_own, rules = _entries_of(own_rows)
                    rules.update(known)
                if not t:
                    continue
                folded = fold_text(t)
                spans = of_own(folded) + (of_all(folded) if part == 0 else [])
                if spans_only:
                    got = [(i, s, e, None) for s, e, i in spans]
                else:
                    got = [(i, None, None, rules[i][1]) for i in live(spans)]
                    if broken and got:
                        said = fold_text(said or "")
                        got = [g for g in got if rules[g[0]][0] is not None and not any(a in said for a in rules[g[0]][0])]
                keys += [k] * len(got)
                out += got
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field("_key").type), *(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[key, "entry_idx", "s", "e", "payload"]
            )

    found = both.select(*names).mapInArrow(run, f"`{key}` {dict(chunks.dtypes)[key]}, entry_idx int, s int, e int, payload string")
    if not spans_only:
        return found.select(key, "entry_idx", "payload")
    spans = found.drop("payload")
    if wide:
        spans = spans.unionByName(occurrences(chunks, common, key, text))
    at = live_entries(spans, key).join(chunks.select(key, F.col("scope").alias("_own"), F.col(told or text).alias("_told")), key)
    at = at.withColumn("_own", F.when(F.col("entry_idx") > F.lit(-1 if last is None else last), F.col("_own")))
    at = at.join(e.withColumnRenamed("entry_idx", "_idx"), (F.col("entry_idx") == F.col("_idx")) & F.col("_own").eqNullSafe(F.col("scope")))
    if broken:
        at = at.where("accepted is not null").withColumns({"_said": fold(F.coalesce("_told", F.lit(""))), "_forms": fold_each(F.col("accepted"))})
        at = at.where(~F.exists("_forms", lambda a: F.contains(F.col("_said"), a)))
    return at.select(key, "entry_idx", "payload")


def _entries_of(rows: list) -> tuple[Callable[[str], list[tuple[int, int, int]]], dict[int, tuple[list[str] | None, str | None]]]:
    """The search for the terms of (entry_idx, source_terms, accepted, payload) rows; accepted folded forms and payload by entry."""
    terms = sorted({(i, f) for i, own, _, _ in rows for f in map(fold_text, filter(None, own or ())) if f})
    rules = {i: (None if a is None else [fold_text(x or "") for x in a], p) for i, _, a, p in rows}
    return _finder(terms), rules


def live_entries(spans: DataFrame, key: str) -> DataFrame:
    """(key, entry_idx) with an occurrence that no strictly longer occurrence of another entry overlaps.

    An interval-overlap anti join with the chunk as its equi key.
    """
    other = spans.select(F.col(key).alias("_k"), F.col("entry_idx").alias("_i"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    over = (F.col(key) == F.col("_k")) & (F.col("entry_idx") != F.col("_i")) & (F.col("_s") < F.col("e")) & (F.col("s") < F.col("_e")) & (F.col("_e") - F.col("_s") > F.col("e") - F.col("s"))
    return spans.join(other, over, "left_anti").select(key, "entry_idx").distinct()


def target_present(translation: Column, target: Column, alts: Column) -> Column:
    """translation folded; target and alts folded: whether any accepted form is in it."""
    return F.exists(F.concat(F.array(target), alts), lambda t: F.contains(translation, t))


def violations(pairs: DataFrame, entries: DataFrame, key: str, source: str, translation: str) -> DataFrame:
    """(key, entry_idx, message): live require and verbatim entries of the source none of whose targets the translation has."""
    also = F.when(F.size("target_alts") > 0, F.concat(F.lit(" (or: "), F.array_join("target_alts", ", "), F.lit(")"))).otherwise("")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" — "), "note")).otherwise("") if "note" in entries.columns else F.lit("")
    message = F.concat(F.lit(RENDER), F.element_at("source_terms", 1), F.lit(AS), "target", also, note)
    if scoped(pairs, entries):
        return live_in_scopes(pairs, entries, key, source, message, translation).select(key, "entry_idx", F.col("payload").alias("message"))
    rules = entries.where(is_rule())
    # as many rows as the glossary has checked rules
    accepted = {r["entry_idx"]: [fold_text(t) for t in (r["target"], *r["target_alts"])] for r in rules.select("entry_idx", "target", "target_alts").collect()}
    missing = live_terms(pairs, entries, key, source, translation, accepted)
    return missing.join(rules, "entry_idx").select(key, "entry_idx", message.alias("message"))


def prompt_sections(chunks: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section): a heading that says what they are, and the live entries as lines in order; chunks without any have no row."""
    mark = F.when(F.col("kind") == "verbatim", UNCHANGED).otherwise("")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("  ["), "note", F.lit("]"))).otherwise("") if "note" in entries.columns else F.lit("")
    line = F.concat(F.lit("  "), F.element_at("source_terms", 1), F.lit(" → "), "target", mark, note)
    if scoped(chunks, entries):
        lines = live_in_scopes(chunks, entries, key, text, line).withColumnRenamed("payload", "line")
    else:
        lines = live_terms(chunks, entries, key, text).join(entries.select("entry_idx", line.alias("line")), "entry_idx")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("entry_idx", "line"))), lambda s: s["line"])
    return lines.groupBy(key).agg(F.concat(F.lit(SECTION_HEAD + "\n"), F.array_join(ordered, "\n")).alias("section"))


def hints(found: DataFrame, key: str, previous: Column | None = None) -> DataFrame:
    """(key, hint) of violations: the terms to use, or, with the previous attempt, the terms to correct in it."""
    bullet = F.concat(F.lit("  - "), F.substring_index("message", " — ", 1))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("entry_idx", bullet.alias("line")))), lambda s: s["line"])
    one = found.groupBy(key).agg(F.array_join(lines, "\n").alias("lines"), *([F.first(previous).alias("previous")] if previous is not None else []))
    head = F.lit(HINT_HEAD + "\n") if previous is None else F.concat(F.lit(ATTEMPT_HEAD + "\n---\n"), strip(F.col("previous")), F.lit("\n---\n" + MEND_HEAD + "\n"))
    return one.select(key, F.concat(head, "lines").alias("hint"))


# -------------------------------------------------------------------------------------------------- merge algebra


@dataclass
class Entry:
    """One entry on the driver: glossaries are small, hand-edited files, and their merges depend on order."""

    source_terms: list[str]
    target: str
    target_alts: list[str] = field(default_factory=list)
    kind: str = "require"
    note: str = ""
    origin: str = ""
    source: str = ""
    alt_versions: list[tuple[str, str]] = field(default_factory=list)

    def line(self) -> str:
        src = " | ".join(self.source_terms)
        if self.kind == "verbatim":
            return f"KEEP: {src}"
        if self.kind == "require":
            return f"TRANSLATE: {src} → {' | '.join([self.target, *self.target_alts])}"
        first = self.source_terms[0] if self.source_terms else ""
        return f"PREFER: {src}" + (f" → {self.target}" if self.target and self.target != first else "")

    def folded(self) -> set[str]:
        return set(map(fold_text, self.source_terms))

    def accepts(self, target: str) -> bool:
        return fold_text(target) in set(map(fold_text, [self.target, *self.target_alts]))


def collect_entries(entries: DataFrame) -> list[Entry]:
    names = ("source_terms", "target", "target_alts", "kind", "note", "origin", "source")
    have = [n for n in names if n in entries.columns]
    return [Entry(**{n: (list(r[n]) if isinstance(r[n], list) else r[n]) for n in have}) for r in entries.orderBy("entry_idx").select(*have).collect()]


def entries_frame(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    from ..schema import ENTRIES

    rows = [(i, e.source_terms, e.target, e.target_alts, e.kind, e.note, e.origin, e.source, [tuple(v) for v in e.alt_versions]) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, ENTRIES)


def combined(*glossaries: list[Entry] | None) -> list[Entry] | None:
    """Later glossaries win: an entry whose folded terms meet a claimed one goes as a whole and claims nothing.

    Within one glossary the first wins. A different target of a dropped entry is noted on the winner, which is the
    holder of its first term (in its own order) that is claimed. None if nothing was given.
    """
    given = [g for g in glossaries if g is not None]
    if not given:
        return None
    claimed: dict[str, Entry] = {}
    parts: list[list[Entry]] = []
    for g in reversed(given):
        own = []
        for e in g:
            winner = next((claimed[k] for k in map(fold_text, e.source_terms) if k in claimed), None)
            if winner is None:
                own.append(copy := replace(e, source_terms=list(e.source_terms), alt_versions=list(e.alt_versions)))
                claimed.update(dict.fromkeys(copy.folded(), copy))
            elif not winner.accepts(e.target):
                winner.alt_versions.append((e.source or "another glossary", e.target))
        parts.append(own)
    return [e for own in reversed(parts) for e in own]


def upserted(existing: list[Entry], offered: list[Entry], overwrite: Iterable[str] = ()) -> tuple[list[Entry], dict]:
    """Offered entries added where no term is known; else unchanged, in conflict, or put in place of the known one.

    Returns the new list and a report {added, unchanged, conflicts, updated} like the one a file upsert gives.
    """
    out = list(existing)
    holder = {k: e for e in existing for k in e.folded()}
    may = set(map(fold_text, overwrite))
    report: dict = {"added": 0, "unchanged": [], "conflicts": [], "updated": []}
    for e in offered:
        hit = next((holder[k] for k in map(fold_text, e.source_terms) if k in holder), None)
        if hit is None:
            out.append(e)
            holder.update(dict.fromkeys(e.folded(), e))
            report["added"] += 1
        elif hit.accepts(e.target):
            report["unchanged"].append(e.source_terms[0])
        elif may & e.folded():
            out = [e if x is hit else x for x in out]
            report["updated"].append(e.source_terms[0])
        else:
            report["conflicts"].append({"term": e.source_terms[0], "kept": hit.target, "offered": e.target})
    return out, report


#: Ranks of entries: the glossary's turn and the number in it.
_TURN = 1 << 40


def ranked_terms(entries: DataFrame, rank: Column) -> DataFrame:
    """(rank, n, term): the folded source terms of entries in their order."""
    return entries.select(rank.alias("rank"), F.posexplode("source_terms").alias("n", "t")).where("t is not null").select("rank", "n", fold(F.col("t")).alias("term"))


def first_come(terms: DataFrame, keep: Callable[[DataFrame], DataFrame], taken: DataFrame | None = None) -> DataFrame:
    """(rank) of the entries that claim all their terms (rank, term) if each comes in turn, and one that meets a claimed
    or taken term claims nothing.

    In rounds: an entry that is the first of all undecided ones at each of its terms claims them, and those that meet it
    go. A round decides the first at least, and with many unrelated entries nearly all; a chain in which each meets
    the next takes a round for two. Nothing is gathered: a term's minimum is partly taken before the shuffle.
    """
    left = terms.select("rank", "term").distinct()
    if taken is not None:
        left = left.join(left.join(taken.select("term").distinct(), "term", "left_semi").select("rank").distinct(), "rank", "left_anti")
    left = keep(left)
    kept = terms.select("rank").limit(0)
    while left.limit(1).count():
        first = left.groupBy("term").agg(F.min("rank").alias("first"))
        won = keep(left.join(first, "term").groupBy("rank").agg(F.bool_and(F.col("first") == F.col("rank")).alias("won")).where("won").select("rank"))
        claimed = left.join(won, "rank", "left_semi").select("term")
        left = keep(left.join(left.join(claimed, "term", "left_semi").select("rank").distinct(), "rank", "left_anti"))
        kept = kept.unionByName(won)
    return kept


def _met(terms: DataFrame, claims: DataFrame) -> DataFrame:
    """(rank, holder): the holder of the first term of each entry, in its own order, that an earlier rank has claimed."""
    return terms.join(claims.select("term", F.col("rank").alias("holder")), "term").where("holder < rank").groupBy("rank").agg(F.min_by("holder", "n").alias("holder"))


def _with_target(met: DataFrame, entries: DataFrame) -> DataFrame:
    """met with the offered target, what the holder has, and whether that accepts it."""
    mine = entries.select("rank", F.col("target").alias("offered"), F.element_at("source_terms", 1).alias("term"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("another glossary")).alias("label"))
    theirs = entries.select(F.col("rank").alias("holder"), F.col("target").alias("held"), F.concat(F.array("target"), F.coalesce("target_alts", F.array().cast("array<string>"))).alias("forms"))
    x = met.join(mine, "rank").join(theirs, "holder")
    x = x.withColumns({"_offered": fold(F.col("offered")), "_forms": fold_each(F.col("forms"))})
    return x.withColumn("accepted", F.array_contains("_forms", F.col("_offered"))).drop("_offered", "_forms", "forms")


def combined_rows(entries: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """combined for tables: entries (turn, entry_idx, source_terms, target, target_alts, source, ...), a later turn wins.

    Returns the entries that stay, with alt_versions: the targets, in the order of the ranks, of those they displace.
    """
    e = entries.withColumn("rank", F.col("entry_idx") - F.col("turn") * F.lit(_TURN))
    terms = keep(ranked_terms(e, F.col("rank")))
    kept = first_come(terms, keep)
    claims = terms.join(kept, "rank", "left_semi").select("term", "rank").distinct()
    lost = terms.join(kept, "rank", "left_anti")
    other = _with_target(_met(lost, claims), e).where("not accepted").select(F.col("holder").alias("rank"), F.struct(F.col("rank").alias("r"), F.struct("label", F.col("offered").alias("target")).alias("v")).alias("o"))
    versions = other.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["v"]).alias("alt_versions"))
    stay = e.join(lost.select("rank").distinct(), "rank", "left_anti").drop("alt_versions").join(versions, "rank", "left")
    return stay.withColumn("alt_versions", F.coalesce("alt_versions", F.array().cast("array<struct<label:string,target:string>>"))).drop("rank")


def upserted_rows(existing: DataFrame, offered: DataFrame, keep: Callable[[DataFrame], DataFrame], overwrite: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """upserted for tables: (entries, report), overwrite (term) naming entries that may take the place of a known one.

    Both tables have entry_idx, source_terms, target, target_alts, source. entries keep these with their turn: 0 in the place of
    an existing one, 1 for added ones. The report has a row an offered entry: entry_idx, term, outcome (added,
    unchanged, conflict, updated), kept (the known target), offered.
    """
    names = ["turn", "entry_idx", "source_terms", "target", "target_alts", "source"]
    e = existing.withColumn("turn", F.lit(0)).select(*names).unionByName(offered.withColumn("turn", F.lit(1)).select(*names)).withColumn("rank", F.col("entry_idx") + F.col("turn") * F.lit(_TURN))
    terms = keep(ranked_terms(e, F.col("rank")))
    old, new = terms.where(F.col("rank") < _TURN), terms.where(F.col("rank") >= _TURN)
    added = first_come(new, keep, old)
    held = old.groupBy("term").agg(F.max("rank").alias("rank")).unionByName(new.join(added, "rank", "left_semi").select("term", "rank").distinct())
    met = _with_target(_met(new.join(added, "rank", "left_anti"), held), e)
    may = F.lit(False)
    if overwrite is not None:
        named = new.join(overwrite.select(fold(F.col("term")).alias("term")).distinct(), "term", "left_semi").select("rank", F.lit(True).alias("may")).distinct()
        met, may = met.join(named, "rank", "left"), F.coalesce("may", F.lit(False))
    met = keep(met.select("rank", "holder", "term", "held", "offered", F.when(F.col("accepted"), "unchanged").when(may, "updated").otherwise("conflict").alias("outcome")))
    swap = met.where("outcome = 'updated'").groupBy("holder").agg(F.min("rank").alias("by"))
    gone = met.select("rank").distinct()
    place = e.join(gone, "rank", "left_anti").select("rank", "turn", F.col("entry_idx").alias("at")).join(swap.withColumnRenamed("holder", "rank"), "rank", "left")
    out = place.select(F.coalesce("by", "rank").alias("rank"), F.col("turn").alias("_turn"), "at").join(e, "rank").select(F.col("_turn").alias("turn"), F.col("at").alias("entry_idx"), *names[2:])
    report = e.where("turn = 1").select("rank", "entry_idx", F.element_at("source_terms", 1).alias("term"), F.col("target").alias("offered")).join(met.select("rank", "outcome", F.col("held").alias("kept")), "rank", "left")
    return out, report.select("entry_idx", "term", F.coalesce("outcome", F.lit("added")).alias("outcome"), "kept", "offered")


def final_merge(primary: list[Entry], symbolic: list[Entry], user: list[Entry] | None, origin: str = "draft") -> tuple[list[Entry], list[str]]:
    """Primary and symbolic entries that meet no user entry, then the user's; keys are lower case, not folded.

    A meeting entry goes, but its new variants join the one user entry it meets; if it meets several, a note says so.
    A different required target is noted too. Returns (entries, notes).
    """
    own = [replace(e, source_terms=list(e.source_terms)) for e in user or []]
    holder = {t.lower(): e for e in own for t in e.source_terms}
    seen = set(holder)
    kept, notes, drafts = [], [], {}
    for e in [*primary, *symbolic]:
        met = {id(holder[t.lower()]): holder[t.lower()] for t in e.source_terms if t.lower() in holder}
        if not met:
            kept.append(replace(e, origin=origin))
            seen.update(t.lower() for t in e.source_terms)
            continue
        fresh = [t for t in e.source_terms if t.lower() not in seen]
        if len(met) > 1:
            if fresh:
                notes.append(f"{', '.join(map(repr, fresh))} may belong to {' or '.join(o.source_terms[0] for o in met.values())}")
            continue
        (o,) = met.values()
        if e.kind == "require" and e.target and not o.accepts(e.target):
            drafts[id(o)] = e.target
        for t in fresh:
            if t.lower() not in seen:
                o.source_terms.append(t)
                seen.add(t.lower())
                holder[t.lower()] = o
    for o in own:
        o.origin = "approved"
        others = [f"{label}: {target}" for label, target in o.alt_versions] + ([f"this document: {drafts[id(o)]}"] if id(o) in drafts else [])
        if others:
            notes.append(f"{o.source_terms[0]!r} is {o.target!r}; elsewhere {'; '.join(others)}")
    return [*kept, *own], notes


def coerce(spark: SparkSession, value) -> list[Entry] | None | bool:
    """None and False stay; a dict becomes prefer entries (an empty one None), a path is read, a list stays; else TypeError."""
    if value is None or value is False:
        return value
    if isinstance(value, dict):
        return [Entry([s], t, kind="prefer") for s, t in value.items()] or None
    if isinstance(value, list) and all(isinstance(e, Entry) for e in value):
        return value
    if isinstance(value, str) or hasattr(value, "__fspath__"):
        return collect_entries(numbered(parsed(read_lines(spark, str(value))), "line_no", "var_no"))
    raise TypeError(f"no glossary can be made of {type(value).__name__}")
