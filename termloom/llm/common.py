"""Shared pieces of the corpus operators: stage tables, connected components, blocked bucket comparison."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one bucket that meet in one task; larger buckets are compared block by block.
BLOCK_ROWS = 1024
#: Groups of up to so many rows have their pairs verified together with those of other groups.
SMALL_GROUP = 12


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where it is unset and all run on one machine a temporary one.

    On a cluster the setting is needed: executors have no other folder in common.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("termloom.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("termloom.checkpoint.dir", path)
    return path


#: Paths of the stage tables made in the innermost open scratch() of this thread or task.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("termloom_scratch", default=None)
#: Stage writes under way, by session, with the setting found by the first of them.
_CLEANING: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    return path


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files are deleted when a query ends, from the first of overlapping stage writes to the last."""
    key = id(spark)
    with _LOCK:
        n, before = _CLEANING.get(key) or (0, spark.conf.get(_CLEANUP, "false"))
        _CLEANING[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            n, before = _CLEANING.pop(key)
            if n > 1:
                _CLEANING[key] = n - 1, before
            else:
                spark.conf.set(_CLEANUP, before)


def write_stage(df: DataFrame, path: str) -> None:
    """Write df as Parquet; the shuffle files of that one run are deleted at its end, since nothing reads them again."""
    with _cleaning(df.sparkSession):
        df.write.parquet(path)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    write_stage(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage folder that nothing reads any more."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stage tables made inside are deleted at the end."""
    paths: list[str] = []
    token = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            drop_stage(spark, path)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make gives as a stage table; the stage tables it is made from are deleted."""
    path = stage_path(spark, name)
    with scratch(spark):
        df = make()
        write_stage(df, path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; further columns, whatever they are called, go no further."""
    return df.select(*[df[n] for n in names])


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (src, dst); component is the smallest node that can be reached.

    Alternates the large-star and small-star rewrites until the edge set no longer changes, which takes
    O(log^2 n) rounds whatever the diameter. Minima are combined map-side before the shuffle, and each round is
    written down. Loops and null ends are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = e.where("u is not null and v is not null and u <> v").distinct()

    def mark(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def stars(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        near = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return near.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def rounds() -> DataFrame:
        now = stage_table(e, "edges")
        before = mark(now)
        while before[0]:
            now = stage_table(stars(now), "edges")
            after = mark(now)
            if after == before:
                break
            before = after
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

    return settled(spark, "components", rounds)


def shared_buckets(light: DataFrame) -> DataFrame:
    """The (bucket, id) rows whose bucket has two rows or more, with that number as n."""
    n = light.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return light.select("bucket", "id").join(n, "bucket")


def blocked(shared: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(bucket, id, n) rows dealt into pairs of blocks: adds bi, bj and own.

    A bucket of up to block_rows rows stays whole. A larger one is cut by a hash of id into blocks, and every row
    goes to each pair of blocks its own takes part in, so that no task holds more than two blocks and no pair is lost.
    """
    rows = shared.withColumn("nb", F.ceil(F.col("n") / block_rows).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return rows.select("bucket", "id", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of a stream that is sorted by them; a run may span batches. Yields (table, starts)."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            t = pa.concat_tables([rest, t])
        cut = np.zeros(t.num_rows, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            cut[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(cut)
        if not len(starts):
            rest = t
            continue
        rest = t.slice(int(starts[-1]))
        yield t.slice(0, int(starts[-1])).combine_chunks(), np.r_[0, starts]
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index for each of n nodes under the links a-b."""
    lab = np.arange(n)
    while len(a):
        new = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        new = np.minimum(new, new[lab])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def first_shared(keys: list[np.ndarray], bucket: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs a-b of one bucket: whether no smaller bucket holds both, so that each pair counts in one bucket only."""
    used = np.unique(np.concatenate([a, b]))
    low = [keys[i][keys[i] < bucket] for i in used]
    names, at = np.unique(np.concatenate(low), return_inverse=True) if sum(map(len, low)) else (np.zeros(0), np.zeros(0, int))
    if not len(names):
        return np.ones(len(a), dtype=bool)
    place = np.zeros(int(used.max()) + 1, dtype=np.int64)
    place[used] = np.arange(len(used))
    has = np.zeros((len(used), len(names)), dtype=np.float32)
    has[np.repeat(np.arange(len(used)), [len(x) for x in low]), at] = 1
    if len(a) * 4 > len(used) ** 2:
        return (has @ has.T)[place[a], place[b]] == 0
    out = np.empty(len(a), dtype=bool)
    for i in range(0, len(a), 4096):
        out[i : i + 4096] = np.einsum("ij,ij->i", has[place[a[i : i + 4096]]], has[place[b[i : i + 4096]]]) == 0
    return out


LINK_SCHEMA = "id long, root long, n long"


def bucket_links(rows: DataFrame, payload: DataFrame, verify: Callable, block_rows: int = BLOCK_ROWS, screen: Callable | None = None) -> DataFrame:
    """Links inside buckets: rows (bucket, id) without repeats; payload (id, weight, ...), one row an id.

    verify(table, a, b) says which of the pairs of row numbers a, b link; it gets the pairs of many small buckets at
    once. screen(table, own, cross) may give the pairs of one large block pair that are worth it (all by default). A pair
    counts in the first bucket it shares. Returns (id, root, n): n adds the weights of the rows that id is linked with
    there, root is the smallest id its links reach in that bucket, so the output grows with the rows, not the pairs.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = stage_table(shared_buckets(rows), "buckets")
    keys = shared.groupBy("id").agg(F.collect_list("bucket").alias("keys"))
    near = blocked(shared, block_rows).join(payload.join(keys, "id"), "id")
    near = near.repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["bucket", "bi", "bj"]):
            ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
            own, bi, bj = (t.column(c).to_numpy() for c in ("own", "bi", "bj"))
            bucket = t.column("bucket").to_numpy()
            lists = t.column("keys").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            few: list[tuple[int, int]] = []
            many: list[tuple[np.ndarray, np.ndarray]] = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                if e - s <= SMALL_GROUP and bi[s] == bj[s]:
                    k = bucket[s]
                    low = [{x for x in flat[ends[i] : ends[i + 1]].tolist() if x < k} for i in range(s, e)]
                    few += [(s + i, s + j) for i in range(e - s) for j in range(i + 1, e - s) if low[i].isdisjoint(low[j])]
                    continue
                a, b = (screen or every_pair)(t.slice(s, e - s), own[s:e], bi[s] != bj[s])
                if len(a):
                    first = first_shared([flat[ends[i] : ends[i + 1]] for i in range(s, e)], bucket[s], a, b)
                    many.append((a[first] + s, b[first] + s))
            many.append(tuple(np.array(few, dtype=np.int64).reshape(-1, 2).T))
            a, b = (np.concatenate(x) for x in zip(*many, strict=True))
            if len(a):
                hit = verify(t, a, b)
                a, b = a[hit], b[hit]
            if len(a):
                n = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
                lab = merge_labels(len(ids), a, b)
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[lab[hit]]), pa.array(n[hit].astype(np.int64))], ["id", "root", "n"])

    return near.mapInArrow(run, LINK_SCHEMA)


def every_pair(t: pa.Table, own: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = block_pairs(own, cross)
    a, b = np.repeat(i, len(j)), np.tile(j, len(i))
    return (a, b) if cross else (a[a < b], b[a < b])


def block_pairs(own: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row indices of the two sides that are to be compared: one block with itself or two different ones."""
    if not cross:
        i = np.arange(len(own))
        return i, i
    low = own == own.min()
    if low.all():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.flatnonzero(low), np.flatnonzero(~low)


class Memory(dict):
    """Results of make by short key, kept as they come; reading a key that is not there makes it."""

    def __init__(self, make: Callable, longest: int = 64):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value


def words_regex() -> str:
    return r"[^\x20\x09-\x0D]+"


def sized(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(words_regex())), F.lit(0)).cast("long")
