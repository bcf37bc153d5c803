"""Numbers of numbered paragraphs, from counters a level: running counts in windows, no renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

#: Levels that a Word list has.
LEVELS = 9
#: Roman digits by place.
ROMAN = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))


def roman(n: Column) -> Column:
    """1 to 3999 in lower-case Roman digits; other numbers as they are."""
    digit = lambda k: F.get(F.array(*map(F.lit, ROMAN[k])), (F.floor(n / 10 ** (3 - k)) % 10).cast("int"))
    return F.when(n.between(1, 3999), F.concat(*[digit(k) for k in range(4)])).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a to z, then aa to zz and so on, as lists count."""
    return F.when(n >= 1, F.repeat(F.char((n - 1) % 26 + 97), (F.floor((n - 1) / 26) + 1).cast("int"))).otherwise(n.cast("string"))


def written(n: Column, fmt: Column) -> Column:
    """A counter in a level's format; bullets and no format give nothing."""
    return F.when(fmt.isin("none", "bullet"), "").when(fmt.endswith("Roman"), _cased(roman(n), fmt)).when(fmt.endswith("Letter"), _cased(letters(n), fmt)).when(fmt == "decimalZero", F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def _cased(text: Column, fmt: Column) -> Column:
    return let(text, lambda t: F.when(fmt.startswith("upper"), F.upper(t)).otherwise(t))


def resolved_numbers(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, pos, number) of paragraphs (doc_id, pos, num_id, level).

    levels: (doc_id, num_id, abstract_id, level, fmt, template, start, restart). Lists of one abstract_id count on together;
    a paragraph counts its level up and sets the deeper ones back; the first paragraph of a list with a restart starts its
    level at it. %n in a template stands for level n's counter, which is its start where no paragraph has counted it.
    Documents are independent: all counters run in one window by document and list, so rows are sorted once for all levels.
    """
    of_num = levels.groupBy("doc_id", "num_id", "abstract_id").agg(F.map_from_entries(F.collect_list(F.struct("level", F.struct("fmt", "template", "start", "restart")))).alias("is"))
    x = paragraphs.select("doc_id", "pos", "num_id", "level").join(of_num, ["doc_id", "num_id"])
    listed = Window.partitionBy("doc_id", "abstract_id").orderBy("pos")
    x = x.withColumn("_first", F.row_number().over(Window.partitionBy("doc_id", "num_id").orderBy("pos")) == 1)
    shape = lambda k, f: F.try_element_at("is", F.lit(k))[f]
    hit = lambda k: F.coalesce((F.col("level") == k).cast("int"), F.lit(0))
    x = x.withColumns({"_row": F.row_number().over(listed), **{f"_c{k}": F.sum(hit(k)).over(listed) for k in range(LEVELS)}})
    last = lambda when, v: F.last(F.when(when, v), ignorenulls=True).over(listed)
    now: dict[str, Column] = {}
    for k in range(LEVELS):
        back = (F.col("level") < k) | (F.col("_first") & shape(k, "restart").isNotNull())
        start = F.coalesce(shape(k, "restart"), shape(k, "start"), F.lit(1))
        # counted up with the paragraphs of the level since it was set back; one of a deeper level alone shows the start
        since = F.col(f"_c{k}") - F.coalesce(last(back, F.col(f"_c{k}") - hit(k)), F.lit(0))
        now[f"_n{k}"] = F.greatest(since, F.lit(1)) - 1 + last(back | (F.col("_row") == 1), start)
    x = x.withColumns(now)
    counters = F.array(*[F.struct(F.col(f"_n{k}").alias("n"), F.coalesce(shape(k, "fmt"), F.lit("decimal")).alias("fmt")) for k in range(LEVELS)])
    texts = F.transform(counters, lambda c: written(c["n"], c["fmt"]))
    template = F.coalesce(F.element_at("is", F.col("level"))["template"], F.lit(""))
    number = let(texts, lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), template, lambda acc, k: F.replace(acc, F.concat(F.lit("%"), k.cast("string")), F.get(t, k - 1))))
    own = F.element_at("is", F.col("level"))["fmt"]
    return x.select("doc_id", "pos", F.when(own == "bullet", "").otherwise(number).alias("number")).where("number <> ''")
