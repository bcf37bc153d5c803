"""Text expressions shared by all operators: whitespace, folding, runs as text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any kind, as (?U)\\s has it.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RUNS = re.compile(f"[{WHITE}]{{2,}}|[{WHITE.replace(' ', '')}]")  # a lone blank, most of them, is no match
RUN = "struct<text:string,bold:boolean,italic:boolean,size:double>"


def squash(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))  # a lone blank, most of them, is no match


def strip(text: Column) -> Column:
    """No white space (of any kind) at the ends. trim() would take spaces only."""
    return F.trim(text, F.lit(WHITE))


def has_text(text: Column) -> Column:
    """Whether anything but white space (of any kind) is there."""
    return text.rlike(r"(?U)\S")


def fold_text(s: str) -> str:
    """Lower case, compatibility-decomposed, without combining marks."""
    if s.isascii():
        return s.lower()
    return "".join([c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)])


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """fold_text for a column; Spark has no normal form function, so this is an Arrow UDF."""
    return s.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def fold_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: [None if t is None else fold_text(t) for t in ts], na_action="ignore")


def presence_fold(s: str) -> str:
    """Folded and white-space-normalised (as squash has it), for presence tests across line breaks."""
    return fold_text(_RUNS.sub(" ", s).strip(" "))


def stripped_length(run: Column) -> Column:
    return F.length(strip(run["text"]))


def runs_text(runs: Column) -> Column:
    return squash(F.array_join(F.transform(runs, lambda r: r["text"]), ""))


def same_format(a: Column, b: Column) -> Column:
    return (a["bold"] == b["bold"]) & (a["italic"] == b["italic"]) & (a["size"] == b["size"])


def consolidated(runs: Column) -> Column:
    """Neighbouring runs of equal bold, italic and size become one.

    The positions where the format changes cut the array into slices, each joined once, so the cost is linear in the runs.
    """

    def cut(all_runs: Column) -> Column:
        changes = lambda r, i: (i == 0) | ~F.coalesce(same_format(F.get(all_runs, i - 1), r), F.lit(False))
        starts = F.filter(F.transform(all_runs, lambda r, i: F.when(changes(r, i), i)), lambda i: i.isNotNull())

        def join(at: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                first = F.get(all_runs, start)
                own = F.slice(all_runs, start + 1, F.coalesce(F.get(at, k + 1), F.size(all_runs)) - start)
                text = F.array_join(F.transform(own, lambda r: r["text"]), "")
                return F.struct(text.alias("text"), first["bold"].alias("bold"), first["italic"].alias("italic"), first["size"].alias("size"))

            return F.transform(at, one)

        return let(starts, join)

    return let(runs, cut)


def runs_markdown(runs: Column) -> Column:
    """Runs as text with asterisks: three for bold italic, two for bold, one for italic; empty runs left out."""

    def mark(r: Column) -> Column:
        stars = F.when(r["bold"] & r["italic"], "***").when(r["bold"], "**").when(r["italic"], "*").otherwise("")
        return F.concat(stars, r["text"], stars)

    return squash(F.array_join(F.transform(F.filter(consolidated(runs), lambda r: r["text"] != ""), mark), ""))


def plain_run(text: Column) -> Column:
    """A text as the one plain run of a block."""
    return F.array(F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(0.0).alias("size")))


def contains_any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)) if phrases else F.lit(False)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: a lambda variable holds it, where plain nesting would compute it at each use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running_total(sizes: Column) -> Column:
    """Array of the running sums of an int array."""
    return F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n).cast("int"))))
