"""Embedding near-duplicates by spherical-cap filters.

A seeded rotation cuts each vector into two blocks, each with its own random code of unit directions; a pair of
codewords is one filter direction of the product code. List decoding walks only the codewords of either block that
can still take part and yields every filter whose score lies within a margin of the best one, so each vector falls
into the spherical caps around all those directions. Vectors that share a filter and a label meet and are verified
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import block_pairs, bucket_links, connected_components, every_pair, pick, settled, stage_table

THRESHOLD = 0.98
#: Width of the accepted score range below a vector's best filter, in standard deviations of what two linked vectors can differ by.
MARGIN = 1.5
SEED = 20240611


def code_size(rows: int) -> int:
    """Codewords a block: filters (its square) keep well ahead of the rows, so few unrelated vectors share one at any size."""
    k = 64
    while k < 4096 and k * k < 16 * rows:
        k *= 2
    return k


def product_code(dim: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation (dim, dim) and the unit codewords (k, block) of the two blocks."""
    rng = np.random.default_rng([seed, dim, k])
    turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
    first = (dim + 1) // 2
    codes = [rng.standard_normal((k, max(1, n))) for n in (first, dim - first)]
    a, b = (c / np.linalg.norm(c, axis=1, keepdims=True) for c in codes)
    return turn, a, b


def list_decode(unit: np.ndarray, k: int, threshold: float = THRESHOLD, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that exceed the rows' own score bound, filters ascending within a row."""
    n, dim = unit.shape
    turn, first, second = product_code(dim, k)
    x = unit @ turn
    s1 = x[:, : first.shape[1]] @ first.T
    s2 = x[:, first.shape[1] :] @ second.T if dim > 1 else np.zeros((n, 1))
    g1, g2 = s1.max(axis=1, keepdims=True) - s1, s2.max(axis=1, keepdims=True) - s2
    delta = margin * 2 * np.sqrt((1 - threshold) * 2 / dim)
    r1, c1 = np.nonzero(g1 <= delta)
    r2, c2 = np.nonzero(g2 <= delta)
    width = np.bincount(r2, minlength=n)
    start = np.cumsum(width) - width
    rep = width[r1]
    i = np.repeat(np.arange(len(r1)), rep)
    j = np.arange(len(i)) - np.repeat(np.cumsum(rep) - rep, rep) + start[r1[i]]
    keep = g1[r1[i], c1[i]] + g2[r2[j], c2[j]] <= delta
    i, j = i[keep], j[keep]
    return r1[i], c1[i].astype(np.int64) * g2.shape[1] + c2[j]


def _units(vectors: list | np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(x: np.ndarray) -> list[bytes]:
    """The rows as bytes: single precision where that loses nothing (a first byte tells), else double."""
    low = x.astype(np.float32)
    same = (low.astype(np.float64) == x).all(axis=1)
    return [b"\4" + s.tobytes() if ok else b"\10" + d.tobytes() for s, d, ok in zip(low, x, same, strict=True)]


def unpacked(rows: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(r, np.float32 if r[0] == 4 else np.float64, offset=1).astype(np.float64) for r in rows]


def _mix(label: np.ndarray, dim: int, code: np.ndarray) -> np.ndarray:
    """A bucket number of (label, dim, filter); equal numbers of different labels are told apart on verification."""
    with np.errstate(over="ignore"):
        h = label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + code.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and the cosine is at least threshold. Null, empty, zero and non-finite
    vectors, null labels and null ids link with nothing and are their own component. Equal vectors of a label are
    one class: the class is compared once and counts with its size, so copies never become pairs (two rows with the
    same id count as two vectors). Vectors of different lengths never link. An empty table gives an empty result.
    """
    spark = df.sparkSession
    x = F.col(vector_col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    base = pick(df, id_col, label_col, vector_col).withColumn("ok", F.coalesce(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & fine, F.lit(False)))
    base = base.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("lab"), "ok", x.alias("vec"), F.when(F.col("ok"), F.xxhash64(label_col, vector_col)).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), vector_col, label_col)).alias("k2"))
    keyed = base.select("vec_id", "ok", "k1", "k2")
    label = F.col("lab").cast("long") if dict(df.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("lab")
    classes = stage_table(base.where("ok").select("k1", "k2", "vec_id", label.alias("label"), F.col("vec")).groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("vec").alias("vec")), "caps")
    k = code_size(classes.count())

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["vec"].map(len)
            for dim, part in pdf.groupby(size):
                for at in range(0, len(part), 2048):
                    p = part.iloc[at : at + 2048]
                    raw = np.array(list(p["vec"]), dtype=np.float64)
                    row, code = list_decode(_units(raw), k, threshold)
                    bucket = _mix(p["label"].to_numpy()[row], dim, code)
                    order = np.lexsort((bucket, row))
                    cut = np.searchsorted(row, np.arange(1, len(p)))
                    yield pd.DataFrame({"id": p["id"].to_numpy(), "weight": p["weight"].to_numpy(), "label": p["label"].to_numpy(), "keys": np.split(bucket[order], cut), "vec": packed(raw)})

    payload = stage_table(classes.select("id", "weight", "label", "vec").mapInPandas(decode, "id long, weight long, label long, keys array<long>, vec binary"), "caps")

    def screen(t: pa.Table, own: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a large block pair that come near: one product of matrices (for vectors of one length; else all)."""
        vec = unpacked(t.column("vec").to_pylist())
        i, j = block_pairs(own, cross)
        if not len(i) or len({len(v) for v in vec}) > 1:
            return every_pair(t, own, cross)
        m = _units(vec)
        a, b = np.nonzero(m[i] @ m[j].T >= threshold - 1e-6)
        a, b = i[a], j[b]
        return (a, b) if cross else (a[a < b], b[a < b])

    def verify(t: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Cosine in double precision and equal labels."""
        label, vec = t.column("label").to_numpy(), t.column("vec")
        hit = np.zeros(len(a), dtype=bool)
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            used, place = np.unique(np.concatenate([p, q]), return_inverse=True)
            rows = unpacked(vec.take(pa.array(used)).to_pylist())
            size = np.array([len(v) for v in rows])
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                unit = np.zeros((len(rows), dim))
                unit[own] = _units([rows[k] for k in own])
                x, y = place[: len(p)], place[len(p) :]
                both = np.flatnonzero((size[x] == dim) & (size[y] == dim) & (label[p] == label[q]))
                hit[at + both] = np.einsum("ij,ij->i", unit[x[both]], unit[y[both]]) >= threshold
        return hit

    rows = payload.select(F.explode("keys").alias("bucket"), "id")
    links = settled(spark, "caps", lambda: bucket_links(rows, payload.drop("keys"), verify, screen=screen))
    comp = connected_components(links.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    n = links.groupBy("id").agg(F.sum("n").alias("n"))
    known = classes.select("k1", "k2", "id", "weight").join(n, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = keyed.join(known, ["k1", "k2"], "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))


def op3_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id,
       vec_id = coalesce(c, vec_id) AS kept
FROM v LEFT JOIN deg ON deg.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""
