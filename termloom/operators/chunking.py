"""Segmentation, chunking and realignment."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, running_total, strip
from .docmodel import NOTE_MARKER

SEGMENT_CHARS = 6000
CHUNK_CHARS = 1500
CHUNK_BLOCKS = 3
TERM_BATCH = 40
#: Fixed value: a sentence ends after . ! ? with an optional closing quote or bracket, at white space.
SENTENCE_END = r"(?U)(?<=[.!?][\"”’')])\s+|(?<=[.!?])\s+"
INLINE_MARKER = r"‹(?:FN|C)\d+›"


def packed(rows: DataFrame, key: str, pos: str, text: str, max_chars: int, max_rows: int | None = None) -> DataFrame:
    """(key, pos, text, grp): rows with their group number (from 0), packed in order of pos within key.

    A group closes before it would pass max_chars (one more for each row), or at max_rows. Packing restarts at each
    overflow, so it is no window but a fold over the sorted rows of a partition, which carries the open group from batch
    to batch: one shuffle on key, and no document is ever held whole. A null text counts as empty; rows of a null key
    are one document.
    """
    ordered = rows.select(key, pos, text).repartition(key).sortWithinPartitions(key, pos, text)
    schema = T.StructType([*ordered.schema.fields, T.StructField("grp", T.IntegerType())])
    most = max_rows or sys.maxsize

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, last, group, length, n = False, None, 0, 0, 0
        for batch in batches:
            groups = []
            sizes = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            for own, size in zip(batch.column(0).to_pylist(), sizes, strict=True):
                if not began or own != last:
                    began, last, group, length, n = True, own, 0, 0, 0
                elif length + size + 1 > max_chars or n >= most:
                    group, length, n = group + 1, 0, 0
                length, n = length + size + 1, n + 1
                groups.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int32())], schema.names)

    return ordered.mapInArrow(fold, schema)


def joined_groups(rows: DataFrame, key: str, pos: str, text: str, glue: str = "\n") -> DataFrame:
    """One row a group: its rows' texts joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return rows.groupBy(key, "grp").agg(F.array_join(F.transform(parts, lambda r: r[text]), glue).alias("text"), F.count(F.lit(1)).alias("n_rows"), F.min(pos).alias("first_pos"))


def segments(texts: DataFrame, max_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(doc_id, grp, text): body and list parts without inline markers, packed into segments; blank parts left out."""
    parts = texts.where(strip(F.col("part")) != "").withColumn("part", F.regexp_replace("part", INLINE_MARKER, ""))
    return joined_groups(packed(parts, "doc_id", "pos", "part", max_chars), "doc_id", "pos", "part")


def term_batches(terms: DataFrame, order: str, size: int = TERM_BATCH) -> DataFrame:
    """Batches of a term list: a glossary's terms are few, so one ordering window over them."""
    return terms.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("int"))


def sentences(text: Column) -> Column:
    """Array of the non-blank sentences."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: strip(s) != "")


def marker_sentences(text: Column) -> Column:
    """For each note marker of a text: struct(id, sent), the number of its sentence.

    A marker's offset counts characters without markers; its sentence is the first whose running length (one for each
    gap) passes the offset, else the last. Text that is only markers has no sentence (sent -1).
    """
    sents = sentences(F.regexp_replace(text, NOTE_MARKER, ""))
    ends = running_total(F.transform(sents, lambda s: F.length(s) + 1))
    # a marker's offset is the running length of the pieces before it
    offsets = running_total(F.transform(F.split(text, NOTE_MARKER, -1), F.length))
    ids = F.regexp_extract_all(text, F.lit(NOTE_MARKER), 1)

    def place(x: Column) -> Column:
        def one(z: Column, i: Column) -> Column:
            at = F.size(F.filter(x["ends"], lambda e: e <= F.get(x["offsets"], i)))
            return F.struct(z.alias("id"), F.least(at, F.size(x["ends"]) - 1).alias("sent"))

        return F.transform(x["ids"], one)

    return let(F.struct(ends.alias("ends"), offsets.alias("offsets"), ids.alias("ids")), place)


def with_markers(translated: Column, markers: Column) -> Column:
    """Markers put back at the end of the sentence of the same number, or of the last one; text without a sentence stays."""

    def put(x: Column) -> Column:
        last = F.size(x["sents"]) - 1

        def one(s: Column, i: Column) -> Column:
            own = F.filter(x["markers"], lambda m: F.least(m["sent"], last) == i)
            end = F.array_join(F.transform(own, lambda m: F.concat(F.lit("‹FN"), m["id"], F.lit("›"))), "")
            return F.when(F.size(own) > 0, F.concat(F.regexp_replace(s, r"(?U)\s+$", ""), end)).otherwise(s)

        return F.when((F.size(x["markers"]) > 0) & (last >= 0), F.array_join(F.transform(x["sents"], one), " "))

    return F.coalesce(let(F.struct(sentences(translated).alias("sents"), markers.alias("markers")), put), translated)


def indexed_lines(texts: Column) -> Column:
    """[n] text lines of an ordered array, n from 0."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), t)), "\n")


def realigned(replies: DataFrame, key: str, count: str, raw: str) -> DataFrame:
    """(key, n, cand): the pieces of indexed replies.

    A line that begins with [n], n below count, opens piece n; other lines continue the open one; lines before the
    first tag go. Of a repeated tag the last piece counts.
    """
    lines = replies.select(key, count, F.posexplode(F.split(raw, "\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))
    tag = F.expr(r"try_cast(nullif(regexp_extract(line, '^\\[(\\d+)\\]\\s*', 1), '') as bigint)")
    lines = lines.withColumn("tag", F.when(tag < F.col(count), tag))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("island", F.count("tag").over(w)).where("island > 0")
    body = F.when(F.col("tag").isNotNull(), strip(F.regexp_replace("line", r"^\[\d+\]\s*", ""))).otherwise(F.col("line"))
    pieces = lines.withColumn("body", body).groupBy(key, "island").agg(F.max("tag").cast("int").alias("n"), strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda s: s["body"]), " ")).alias("cand"))
    return pieces.groupBy(key, "n").agg(F.max_by("cand", "island").alias("cand"))


def accepted(cand: Column, source: Column) -> Column:
    """Whether a realigned piece is kept: not empty and between 0.4 and 2.5 times its source's length."""
    ratio = F.length(cand) / F.greatest(F.length(source), F.lit(1))
    return F.coalesce((cand != "") & (ratio >= 0.4) & (ratio <= 2.5), F.lit(False))
