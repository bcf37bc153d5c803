"""Tables on pages: cells as the faces between ruling lines, and the texts in them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points within which rules count as one, and ends as touching.
SNAP = 3.0
#: Rules shorter than this are dots and ticks.
SHORTEST = 4.0
CELLS = "doc_id string, page int, on_page int, row_idx int, col_idx int, x0 double, y0 double, x1 double, y1 double"


def snapped(values: np.ndarray) -> np.ndarray:
    """Sorted positions, those within SNAP of the one before as one, in the middle."""
    v = np.sort(values)
    if not len(v):
        return v
    group = np.cumsum(np.r_[0, np.diff(v) > SNAP])
    return np.bincount(group, v) / np.bincount(group)


def nearest(places: np.ndarray, v: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(places, v), 1, max(1, len(places) - 1)) if len(places) > 1 else np.zeros(len(v), dtype=int)
    return np.where(np.abs(places[k - 1] - v) <= np.abs(places[k] - v), k - 1, k) if len(places) > 1 else k


def walls(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, lines: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which stretch between neighbouring stops is covered on which line: rules at, from lo to hi."""
    out = np.zeros((len(lines), len(stops) + 1), dtype=int)
    k = nearest(lines, at)
    order = np.lexsort((lo, k))
    k, lo, hi = k[order], lo[order], hi[order]
    far = k * 1e7  # rules of one line that touch are one rule
    reach = np.maximum.accumulate(hi + far) - far
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (lo[1:] > reach[:-1] + SNAP)])
    k, lo, hi = k[new], lo[new], np.maximum.reduceat(hi, new)
    first = np.searchsorted(stops, lo - SNAP)
    last = np.searchsorted(stops, hi + SNAP, "right") - 1
    on = last > first
    np.add.at(out, (k[on], first[on] + 1), 1)
    np.add.at(out, (k[on], last[on] + 1), -1)
    return np.cumsum(out, axis=1) > 0


def spread(labels: np.ndarray, down: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least label that each place reaches through what is open below and to the right."""
    while True:
        new = labels.copy()
        for a, b, way in ((new[:-1], new[1:], down), (new[:, :-1], new[:, 1:], right)):
            low = np.minimum(a, b)
            a[way], b[way] = low[way], low[way]
        flat = new.reshape(-1)
        jumped = flat[flat].reshape(labels.shape)
        if np.array_equal(jumped, labels):
            return labels
        labels = jumped


def faces(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> list[tuple[int, int, int, float, float, float, float]]:
    """(table, row, column, box) of the rectangles between rules. A table is two cells or more that border on each other."""
    x0, x1, y0, y1 = np.minimum(x0, x1), np.maximum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1)
    across = (y1 - y0 <= 1) & (x1 - x0 >= SHORTEST)
    upright = (x1 - x0 <= 1) & (y1 - y0 >= SHORTEST)
    ys, xs = snapped(y0[across]), snapped(x0[upright])
    if len(ys) < 2 or len(xs) < 2:
        return []
    # places lie between neighbouring positions; the first and last of each direction are outside
    down = ~walls(y0[across], x0[across], x1[across], ys, xs)
    right = ~walls(x0[upright], y0[upright], y1[upright], xs, ys).T
    shape = (len(ys) + 1, len(xs) + 1)
    labels = spread(np.arange(shape[0] * shape[1]).reshape(shape), down, right)
    inside = labels != labels[0, 0]
    together = spread(np.arange(shape[0] * shape[1]).reshape(shape), inside[:-1] & inside[1:], inside[:, :-1] & inside[:, 1:])
    r, c = np.nonzero(inside)
    names, at = np.unique(labels[r, c], return_inverse=True)
    r0, c0, r1, c1 = np.full(len(names), 1 << 30), np.full(len(names), 1 << 30), np.zeros(len(names), int), np.zeros(len(names), int)
    np.minimum.at(r0, at, r)
    np.minimum.at(c0, at, c)
    np.maximum.at(r1, at, r)
    np.maximum.at(c1, at, c)
    whole = np.bincount(at, minlength=len(names)) == (r1 - r0 + 1) * (c1 - c0 + 1)
    table = together[r0, c0] if len(names) else np.zeros(0, int)
    table[~whole] = -1
    out, k = [], 0
    for t in sorted(set(table[whole].tolist()), key=lambda t: (r0[table == t].min(), c0[table == t].min())):
        own = np.flatnonzero(table == t)
        if len(own) < 2:
            continue
        rows, columns = np.unique(r0[own]), np.unique(c0[own])
        for i in own[np.lexsort((c0[own], r0[own]))].tolist():
            out.append((k, int(np.searchsorted(rows, r0[i])), int(np.searchsorted(columns, c0[i])), float(xs[c0[i] - 1]), float(ys[r0[i] - 1]), float(xs[c1[i]]), float(ys[r1[i]])))
        k += 1
    return out


def ruled_cells(rules: DataFrame) -> DataFrame:
    """Cells of the tables that rules (doc_id, page, x0, y0, x1, y1) draw, each with its table's number in the document, from 1.

    A cell over several rows or columns has the number of its first ones; its other places have no cell. A page's rules meet in one task.
    """

    def run(key: tuple, t: pa.Table) -> pa.Table:
        found = faces(*(t.column(n).to_numpy() for n in ("x0", "y0", "x1", "y1")))
        rows = [(key[0].as_py(), key[1].as_py(), *f) for f in found]
        names = [c.split()[0] for c in CELLS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    cells = rules.select("doc_id", "page", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInArrow(run, CELLS)
    each = Window.partitionBy("doc_id").orderBy("page", "on_page")
    return cells.withColumn("table_idx", F.dense_rank().over(each)).drop("on_page")


def table_boxes(cells: DataFrame) -> DataFrame:
    """(doc_id, table_idx, page, x0, y0, x1, y1) of whole tables."""
    return cells.groupBy("doc_id", "table_idx", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _middle(a: str, b: str) -> Column:
    return (F.col(f"m.{a}") + F.col(f"m.{b}")) / 2


def cell_texts(cells: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, table_idx, row_idx, cells): rows of texts; places without a cell or text are empty.

    pieces (doc_id, page, idx, text, base, x0, y0, x1, y1) belong to the cell that their middle is in; pieces of one base line
    are joined by a space where they do not touch, lines by a line feed.
    """
    inside = (F.col("c.doc_id") == F.col("m.doc_id")) & (F.col("c.page") == F.col("m.page")) & _middle("x0", "x1").between(F.col("c.x0"), F.col("c.x1")) & _middle("y0", "y1").between(F.col("c.y0"), F.col("c.y1"))
    hit = cells.alias("c").join(pieces.alias("m"), inside).select("c.doc_id", "c.table_idx", "c.row_idx", "c.col_idx", "m.idx", "m.text", "m.base", "m.x0", "m.x1")
    hit = hit.dropDuplicates(["doc_id", "table_idx", "idx"])
    w = Window.partitionBy("doc_id", "table_idx", "row_idx", "col_idx").orderBy("idx")
    was = lambda c: F.lag(c).over(w)
    lead = F.when(was("base").isNull(), "").when(F.abs(F.col("base") - was("base")) > 2, "\n").when((F.col("x0") - was("x1") > 1) & ~F.col("text").startswith(" ") & ~was("text").endswith(" "), " ").otherwise("")
    said = hit.withColumn("text", F.concat(lead, "text")).groupBy("doc_id", "table_idx", "row_idx", "col_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda p: p["text"]), "").alias("text"))
    each = cells.select("doc_id", "table_idx", "row_idx", "col_idx").join(said, ["doc_id", "table_idx", "row_idx", "col_idx"], "left")
    wide = cells.groupBy("doc_id", "table_idx").agg((F.max("col_idx") + 1).alias("n"))
    rows = each.groupBy("doc_id", "table_idx", "row_idx").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", F.coalesce("text", F.lit(""))))).alias("at")).join(wide, ["doc_id", "table_idx"])
    return rows.select("doc_id", "table_idx", "row_idx", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.coalesce(F.try_element_at("at", k), F.lit(""))).alias("cells"))
