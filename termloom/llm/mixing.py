"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all words by its weight, capped at a multiple of its size (the excess is shared again).
The rates that meet those word constraints and stay closest to one, in relative entropy over words, are
exp(sum of the multipliers of a row's groups); Newton steps on the convex dual find the multipliers from per-cell word
sums that are computed in a distributed way. Rates are rounded into whole copies so that every source's words come out
near its target.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_name, pick, settled, sized, stage_table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
#: Rounding happens in groups of about this many documents of one source.
GROUP_DOCS = 1000
#: Rows that are alike are handled together in pieces of so many.
PIECE_ROWS = 1000
TOLERANCE = 1e-10
MAX_STEPS = 60
#: Files of the cell table between Newton steps: it has a row for each combination of groups, not for each document.
CELL_PARTS = 8


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) -> source, source_size, target: shares by weight, capped, the excess shared again.

    With sources in order of size over weight, the capped ones are a prefix: the level at which the rest share what is
    left is found from running sums, without a loop. Sources order by code point (UTF-8 bytes), null last.
    The table has one row a source, so its windows run over that table only.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pattern = F.array(*map(F.lit, weights))
    n = F.row_number().over(order)
    s = sizes.withColumn("w", F.element_at(pattern, ((n - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("rank", n)
    by_level = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    s = s.withColumn("full", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap)))
    s = s.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # a source is capped while the level would give it more than its cap
    s = s.withColumn("over", F.col("level") * F.col("w") > F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("even", F.min(F.when(~F.col("over"), F.struct(F.col("source_size") / F.col("w"), "rank", "level"))).over(every)["level"])
    cap_size = F.col("source_size") * F.lit(float(cap))
    return s.select("source", F.col("source_size").cast("long"), F.coalesce(F.least(cap_size, F.col("even") * F.col("w")), cap_size).alias("target"))


def entropy_balance(cells: DataFrame, margins: dict[str, DataFrame], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """Rates that meet word constraints: cells (one column a margin, words) and, by margin, (group, target).

    The convex dual is sum(words * exp(l)) - sum(target * l), l the sum of the multipliers of a cell's groups. Groups of
    one margin share no cell, so their Hessian block is diagonal, and a Newton step moves each multiplier by
    (target - now) / now, now being the words its cells take at present (kept within +-2, which only shortens the first
    steps). Margins take their steps in turn. Gradient and Hessian are distributed aggregations over the cells, and
    multipliers never leave the tables. A group without words or target keeps its rate. Returns (cells with their
    rate exp(l), number of steps).
    """
    state = stage_table(cells.withColumn("rate", F.lit(1.0)).coalesce(CELL_PARTS), "mix")
    steps = 0
    while steps < max_steps:
        worst = 0.0
        for name, targets in margins.items():
            now = state.groupBy(name).agg(F.sum(F.col("words") * F.col("rate")).alias("now"))
            t = targets.select(F.col("group").alias("_group"), "target")
            step = now.join(t, now[name].eqNullSafe(t["_group"]), "left").select(F.col(name).alias("_key"), F.when((F.col("now") > 0) & (F.col("target") > 0), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("target") / F.col("now") - 1))).alias("_move"))
            worst = max(worst, step.agg(F.max(F.abs("_move"))).first()[0] or 0.0)
            state = state.join(step, state[name].eqNullSafe(step["_key"]), "left").withColumn("rate", F.col("rate") * F.exp(F.coalesce("_move", F.lit(0.0)))).drop("_key", "_move")
            state = stage_table(state.coalesce(CELL_PARTS), "mix")
        steps += 1
        if worst <= tolerance:
            return state, steps
    warnings.warn(f"mix: after {steps} steps targets are still missed by up to {worst:.2g} of their size", RuntimeWarning, stacklevel=2)
    return state, steps


def whole_copies(sizes: np.ndarray, rate: float, order: np.ndarray) -> np.ndarray:
    """Copies of each document: floor(rate) each, and one more where the words still missing reach half the document.

    Documents go from large to small (ties by order), so what a large one leaves is made up by smaller ones.
    """
    low = int(np.floor(rate + 1e-9))
    part = max(0.0, rate - low)
    out = np.full(len(sizes), low, dtype=np.int64)
    if part <= 1e-9:
        return out
    missing = 0.0
    for i in np.lexsort((order, -sizes)):
        missing += part * sizes[i]
        if missing >= sizes[i] / 2 and missing > 0:
            out[i] += 1
            missing -= sizes[i]
    return out


def planned(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, mark: Column | None = None) -> DataFrame:
    """What the mix takes of rows that are alike: source, doc_id, size, mark, source_size, target, n, copies.

    Rows with one source, id, size and mark are alike; they come in pieces of up to PIECE_ROWS rows, and n rows of a
    piece get copies each. Rounding groups hold whole pieces, so no group grows with the rows that share a key.
    """
    spark = df.sparkSession
    src = pick(df, id_col, source_col, text_col)
    src = src.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), sized(F.col(text_col)).alias("size"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"))
    alike = stage_table(src.groupBy("source", "doc_id", "size", "mark").agg(F.count(F.lit(1)).alias("rows")), "mix")
    cells = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.sum("rows").alias("docs"))

    def rated() -> DataFrame:
        targets = stage_table(source_targets(cells.select("source", F.col("words").alias("source_size")), weights, cap), "mix")
        rates, _ = entropy_balance(cells, {"source": targets.select(F.col("source").alias("group"), "target")})
        return rates.join(targets, rates["source"].eqNullSafe(targets["source"])).select(rates["source"].alias("_source"), "docs", "source_size", "target", "rate")

    plan = settled(spark, "mix", rated)
    pieces = alike.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PIECE_ROWS))))
    pieces = pieces.withColumn("rows", F.least(F.lit(PIECE_ROWS), F.col("rows") - F.col("piece") * PIECE_ROWS))
    spread = F.pmod(F.xxhash64("doc_id", "size", "piece", F.lit(5)), F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP_DOCS)))
    dealt = pieces.join(plan, pieces["source"].eqNullSafe(plan["_source"])).withColumn("_part", spread).drop("_source", "docs")

    def deal(t: pa.Table) -> pa.Table:
        sizes, rows, piece, mark = (t.column(c).to_numpy() for c in ("size", "rows", "piece", "mark"))
        known = t.column("doc_id").is_valid().to_numpy()
        ids = t.column("doc_id").fill_null(0).to_numpy()
        rate = t.column("rate")[0].as_py()
        rank = np.empty(len(ids), dtype=np.int64)
        rank[np.lexsort((mark, piece, known, ids, _scatter(ids)))] = np.arange(len(ids))
        low = int(np.floor(rate + 1e-9))
        more = whole_copies(np.repeat(sizes, rows), rate, np.repeat(rank, rows)) - low
        high = np.add.reduceat(more, np.cumsum(rows) - rows)
        low = np.full(len(rows), low)
        low[sizes == 0], high[sizes == 0] = 1, 0
        both = pa.concat_tables([t.append_column("n", pa.array(n)).append_column("copies", pa.array(c)) for n, c in ((rows - high, low), (high, low + 1))])
        return both.filter(pa.array(np.r_[rows - high, high] > 0)).select(["source", "doc_id", "size", "mark", "source_size", "target", "n", "copies"])

    kind = dict(df.dtypes)[source_col]
    return dealt.groupBy("source", "_part").applyInArrow(deal, f"source {kind}, doc_id long, size long, mark long, source_size long, target double, n long, copies long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of df: doc_id, size, source_size, target, taken, copies, source.

    Sizes count words of whole texts (null and empty: 0). Documents without words get copies 1 and take 0 words. A
    document's copies are the floor or the ceiling of its source's rate, so it takes at most cap times its size. Null
    is a source of its own, the last. Reruns agree: rounding depends on ids, sizes and sources only. Rows that repeat
    count separately, however many they are; ids may repeat across sources.
    """
    each = planned(df, id_col, text_col, source_col, weights, cap).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def _scatter(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df, each as often as the mix takes it (documents without words stay once); columns of any name stay.

    Rows with one source, id and text share what the mix takes of them: each comes as often as that goes into them
    evenly, and one of them as often again as is left.
    """
    spark = df.sparkSession
    total, rows, key, words, text, source, piece = (fresh_name(df, n) for n in ("mix_total", "mix_rows", "mix_id", "mix_words", "mix_text", "mix_source", "mix_piece"))
    plan = planned(df, id_col, text_col, source_col, mark=F.xxhash64(text_col)).groupBy("source", "doc_id", "size", "mark").agg(F.sum(F.col("n") * F.col("copies")).alias(total), F.sum("n").alias(rows))
    plan = stage_table(plan.toDF(source, key, words, text, total, rows), "mix")

    def matched(plan: DataFrame) -> DataFrame:
        # size is a function of the text, so the text's hash stands for it and words are not counted again
        return df.join(plan, df[f"`{id_col}`"].cast("long").eqNullSafe(plan[key]) & df[f"`{source_col}`"].eqNullSafe(plan[source]) & (F.xxhash64(df[f"`{text_col}`"]) == plan[text]))

    def repeated(x: DataFrame, n: Column) -> DataFrame:
        return x.withColumn(piece, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*[x[f"`{c}`"] for c in df.columns])

    out = repeated(matched(plan), F.floor(F.col(total) / F.col(rows)))
    left = plan.where(F.col(total) % F.col(rows) > 0)
    if left.limit(1).count():
        one = matched(left).dropDuplicates([key, source, text])
        rest = F.col(total) % F.col(rows)
        cut = one.withColumn(piece, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((rest - 1) / PIECE_ROWS)))).repartition(F.col(key), F.col(piece))
        out = out.unionByName(repeated(cut, F.least(F.lit(PIECE_ROWS), rest - F.col(piece) * PIECE_ROWS)))
    return out


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
