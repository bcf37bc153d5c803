"""Prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is known by its depth and two 64-bit sums over the turns before it, each turn salted by its place, so that equal
prefixes meet by key without any walk over texts. The largest child of a node continues its path (heavy), the others start
paths of their own (light); a path from the root meets at most log2(conversations) light nodes. Running values along a conversation
or a path come from scans of tables dealt by range, in which one long conversation or path is spread over many tasks:
each task scans what it has, and one short row a task says what goes before. Sums of whole light paths are added to their parents'
paths one level of light nodes after the other, the deepest first; then one suffix sum along all path arrays gives
the sums of all subtrees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, scratch, sized, stage_path, stage_table, write_stage

#: Conversations of a block take their first turns from the block's first one.
BLOCK = 20
#: So many different numbers of first turns are taken over.
TAKEN = 4
#: Ids of a group whose text is put down as one piece.
PIECE_IDS = 1 << 16


# ------------------------------------------------------------------------------------------------ scans over ranges


def scanned(df: DataFrame, key: list[str], order: list, keep: list[str], sums: dict[str, str] | None = None, under: dict[str, str] | None = None, last: dict[str, str] | None = None, prior: dict[str, str] | None = None, back: dict[str, str] | None = None, deal: list | None = None) -> DataFrame:
    """The columns keep of df with running values within each key (longs without nulls), in the order given.

    sums: new column -> column whose sum up to and with the row it gets, modulo 2^64; under: without the row. last: new column -> column whose
    latest value that is not null it gets, the row's own included; prior: the same without the row's own. back: new column ->
    column whose value in the row before it gets. deal: what rows of a key are dealt by, if not by order. Keys of any
    size are spread over tasks; the driver gets one short row a task. The rows are a stage table, read with the scan's end.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = df.repartitionByRange(parts, *key, *(deal or order)).sortWithinPartitions(*key, *order)
    under, last, prior, back = under or {}, last or {}, prior or {}, back or {}
    sums = (sums or {}) | under
    fresh = [*sums, *last, *prior, *back]
    near = near.select(*dict.fromkeys([*key, *keep, *sums.values(), *last.values(), *prior.values(), *back.values()]))
    kinds = {f.name: f.dataType.simpleString() for f in near.schema}
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in keep), *(f"`{n}` long" for n in fresh), "_part int, _lead boolean, _first boolean, _told string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        from pyspark import TaskContext

        part, first, now = TaskContext.get().partitionId(), None, None
        value: dict[str, int | None] = {}
        types = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
            cut = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0) if n > 1 else np.zeros(0, bool)]
            begin = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
            head = [int(k[0]) for k in keys]
            start = first is None
            first = first or head
            goes_on = now == head
            now = [int(k[-1]) for k in keys]
            out = {}
            for name, col in sums.items():
                x = b.column(col).to_numpy(zero_copy_only=False).astype(np.int64)
                run_sum = np.cumsum(x)
                got = run_sum - (run_sum[begin] - x[begin])
                if goes_on:
                    got[begin == 0] += np.int64(value[name])
                out[name], value[name] = pa.array(got - x if name in under else got), int(got[-1])
            for name, col in (last | prior | back).items():
                v = b.column(col)
                known = v.is_valid().to_numpy(zero_copy_only=False)
                raw = v.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                latest = np.arange(n) if name in back else np.maximum.accumulate(np.where(known, np.arange(n), -1))
                at = latest if name in last else np.r_[-1, latest[:-1]]
                inside = at >= begin
                got, ok = raw[np.maximum(at, 0)], inside & known[np.maximum(at, 0)]
                after = int(raw[latest[-1]]) if latest[-1] >= begin[-1] and known[latest[-1]] else None
                if goes_on and value[name] is not None:
                    rest = (begin == 0) & ~inside
                    got, ok = np.where(rest, value[name], got), ok | rest
                if after is None and goes_on and begin[-1] == 0 and name not in back:
                    after = value[name]
                out[name], value[name] = pa.array(got, mask=~ok), after
            lead = np.all([k == f for k, f in zip(keys, first, strict=True)], axis=0)
            fore = np.zeros(n, dtype=bool)
            fore[0] = start
            columns = [*(b.column(c) for c in keep), *(out[c] for c in fresh), pa.array(np.full(n, part, np.int32)), pa.array(lead), pa.array(fore), pa.nulls(n, pa.string())]
            types = [c.type for c in columns]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *fresh, "_part", "_lead", "_first", "_told"])
        if first is not None:
            told = [pa.nulls(1, t) for t in types]
            told[-4], told[-1] = pa.array([part], pa.int32()), pa.array([json.dumps([first, now, value])])
            yield pa.RecordBatch.from_arrays(told, [*keep, *fresh, "_part", "_lead", "_first", "_told"])

    local = stage_table(near.mapInArrow(run, schema), "scan")
    carried = _carried([(r["_part"], r["_told"]) for r in local.where("_told is not null").select("_part", "_told").collect()], set(sums), set(back))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part, lead, fore = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_lead", "_first"))
            new = {c: b.column(c) for c in fresh}
            for p in np.unique(part).tolist():
                if p not in carried:
                    continue
                for name, v in carried[p].items():
                    mine = (part == p) & (fore if name in back else lead)
                    if v is None or not mine.any():
                        continue
                    known = new[name].is_valid().to_numpy(zero_copy_only=False)
                    raw = new[name].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    if name in sums:
                        new[name] = pa.array(raw + np.where(mine, np.int64(v), 0))
                    else:
                        fill = mine & ~known
                        new[name] = pa.array(np.where(fill, v, raw), mask=~(known | fill))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(new[c] for c in fresh)], [*keep, *fresh])

    return local.where("_told is null").mapInArrow(finish, schema.split(", _part")[0])


def _carried(told: list[tuple[int, str]], sums: set[str], back: set[str]) -> dict[int, dict[str, int | None]]:
    """What the rows of each task's first key must know of the tasks before; told: (task, its first and last key and running values at its end)."""
    import json

    out: dict[int, dict[str, int | None]] = {}
    before = None
    for part, text in sorted(told):
        first, last, value = json.loads(text)
        if before is not None and before[0] == first:
            out[part] = before[1]
        if first == last and part in out:
            value = {n: _wrapped(v + out[part][n]) if n in sums else out[part][n] if v is None and n not in back else v for n, v in value.items()}
        before = (last, value)
    return out


def _wrapped(v: int) -> int:
    return (v + (1 << 63)) % (1 << 64) - (1 << 63)


# ------------------------------------------------------------------------------------------------------ id digests


def id_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """key, ends_sha256: SHA-256 hex of the ids c of each key, in numeric order, joined by commas. Key columns are longs.

    Ids are dealt by range; a group that reaches over a task's end, or is long, goes on as pieces of text, whose hash is taken as
    they stream by.
    """
    spark = ends.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ", ".join(f"`{k}` long" for k in key)
    near = ends.select(*key, "c").repartitionByRange(parts, *key, "c").sortWithinPartitions(*key, "c")
    names = [*key, "part", "seq", "text", "digest"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [*[pa.int64()] * len(key), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, whole, ids, seq = TaskContext.get().partitionId(), None, False, [], 0
        for b in batches:
            out = []
            for *k, c in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if k != now:
                    if now is not None:
                        text = ",".join(ids)
                        seq += 1
                        out.append((*now, part, seq, None, hashlib.sha256(text.encode()).digest()) if whole else (*now, part, seq, text, None))
                    now, whole, ids = k, now is not None, []
                ids.append(str(c))
                if len(ids) == PIECE_IDS:
                    seq += 1
                    out.append((*now, part, seq, ",".join(ids), None))
                    whole, ids = False, []
            if out:
                yield batch(out)
        if now is not None and ids:
            yield batch([(*now, part, seq + 1, ",".join(ids), None)])

    stage = stage_table(near.mapInArrow(run, f"{keys}, part int, seq long, text string, digest binary"), "digests")
    pieces = stage.where("text is not null").repartition(parts, *key).sortWithinPartitions(*key, "part", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for *k, text in zip(*(b.column(c).to_pylist() for c in [*key, "text"]), strict=True):
                if k != now:
                    if now is not None:
                        out.append((*now, 0, 0, None, sha.digest()))
                    now, sha = k, hashlib.sha256(text.encode())
                elif text:
                    sha.update(("," + text).encode())
            if out:
                yield batch(out)
        if now is not None:
            yield batch([(*now, 0, 0, None, sha.digest())])

    done = stage.where("digest is not null").unionByName(pieces.mapInArrow(fold, f"{keys}, part int, seq long, text string, digest binary"))
    return done.select(*key, F.lower(F.hex("digest")).alias("ends_sha256"))


# -------------------------------------------------------------------------------------------------------- the trie


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, d, v1, v2, words, fin) of every turn of every rebuilt conversation, d from 1; and the ids c without turns."""
    src = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    src = src.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.lit(1).cast("long").alias("one"))
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
    src = src.withColumns({"words": sized(F.col("text")), "v1": F.conv(F.substring(digest, 1, 16), 16, -10).cast("long"), "v2": F.conv(F.substring(digest, 17, 16), 16, -10).cast("long")})
    turn = F.col("turn").asc_nulls_first()
    turns = stage_table(scanned(src, ["c"], [turn, "role", "text"], ["c", "v1", "v2", "words"], sums={"k": "one"}, deal=[turn, "role", F.substring("text", 1, 32), "v1"]), "turns")
    turns = turns.withColumn("pos", F.col("k") - 1).drop("k")
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(TAKEN)), "r": F.col("c") - F.col("c") % BLOCK})
    convs = stage_table(convs, "convs")
    first = convs.select(F.col("c").alias("r"), F.col("n").alias("n_r"))
    convs = convs.join(first, "r", "left").withColumn("got", F.least("h", F.coalesce("n_r", F.lit(0))))
    convs = stage_table(convs.select("c", "r", "n", "h", "got"), "convs")
    heads = turns.where(F.col("pos") < TAKEN - 1).withColumnRenamed("c", "r")
    taken = heads.join(convs, "r").where("pos < h").select("c", (F.col("pos") + 1).alias("d"), "v1", "v2", "words", ((F.col("n") <= F.col("h")) & (F.col("pos") == F.col("got") - 1)).cast("int").alias("fin"))
    own = turns.join(convs, "c").where("pos >= h").select("c", (F.col("got") + F.col("pos") - F.col("h") + 1).alias("d"), "v1", "v2", "words", (F.col("pos") == F.col("n") - 1).cast("int").alias("fin"))
    return taken.unionByName(own), convs.where((F.col("got") == 0) & (F.col("n") <= F.col("h"))).select("c")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text. Rows with a null conv_id are left out; null turns come first, ties go by role
    and text, a null role or text is empty, rows that repeat are turns of their own. Every conversation takes its first
    turns from the first of its block of 20 (crc32 of its id modulo 4 of them). Nodes, members and sums are those of
    the op13 contract. An empty table gives no rows, not even a root. One conversation, path or node may hold any share of the rows.
    """
    spark = conversations.sparkSession
    path = stage_path(spark, "trie")
    with scratch(spark):
        out = _trie(conversations)
        write_stage(out, path)
    return spark.read.schema(out.schema).parquet(path)


def _trie(conversations: DataFrame) -> DataFrame:
    turns, turnless = rebuilt(conversations)
    salted = turns.withColumns({f"a{k}": F.xxhash64(F.lit(k), "d", "v1", "v2") for k in (1, 2)})
    # a turn's node is (d, s1, s2), its parent (d - 1, p1, p2); the root is (0, 0, 0)
    node, zero = ["d", "s1", "s2"], F.lit(0).cast("long")
    rows = stage_table(scanned(salted, ["c"], ["d"], ["c", "d", "words", "fin"], sums={"s1": "a1", "s2": "a2"}, under={"p1": "a1", "p2": "a2"}), "rows")
    ends = rows.where("fin = 1").select(*node, "c").unionByName(turnless.select(*(zero.alias(k) for k in node), "c"))
    ends = stage_table(ends, "ends")
    reps = stage_table(ends.groupBy(*node).agg(F.min("c").alias("c")).select("c"), "reps")  # one of each kind of conversation
    root = rows.where("d = 1").select("c").unionByName(turnless).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    nodes = rows.groupBy(*node).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n"), *(F.min(k).alias(k) for k in ("words", "p1", "p2")))
    nodes = stage_table(nodes, "nodes")
    # the largest child, of equals the one with the smallest member, goes on; a node is its smallest member and its depth, too
    biggest = F.max(F.struct("n", F.bitwise_not("conv_id").alias("m"))).alias("x")
    kids = nodes.groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count(F.lit(1)).alias("n_children"), biggest)
    kids = stage_table(kids.select(*node, "n_children", F.bitwise_not("x.m").alias("heavy")), "kids")
    heavy = kids.select(F.col("heavy").alias("conv_id"), (F.col("d") + 1).alias("d"), zero.alias("heavy"))
    nodes = nodes.join(heavy, ["conv_id", "d"], "left").withColumn("light", F.coalesce("heavy", F.lit(1).cast("long"))).drop("heavy", "p1", "p2")
    nodes = stage_table(nodes, "nodes")
    # the way of one conversation of each kind from the root down; copies go no further
    walk = rows.join(reps, "c", "left_semi").select("c", *node).join(nodes, node).select("c", *node, "conv_id", "n", "words", "light")
    top = reps.select("c", *(zero.alias(k) for k in node), F.lit(root["conv_id"]).cast("long").alias("conv_id"), F.lit(root["n"]).cast("long").alias("n"), zero.alias("words"), F.lit(1).cast("long").alias("light"))
    marked = walk.unionByName(top).withColumns({"lc": F.when(F.col("light") == 1, F.col("conv_id")), "ld": F.when(F.col("light") == 1, F.col("d"))})
    led = scanned(marked, ["c"], ["d"], ["c", *node, "conv_id", "n", "words", "light"], sums={"level": "light"}, last={"hc": "lc", "hd": "ld"}, prior={"phc": "lc", "phd": "ld"}, back={"parent": "conv_id"})
    each = led.where("c = conv_id").drop("c").join(kids.drop("heavy"), node, "left").withColumn("n_children", F.coalesce("n_children", zero))
    each = each.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("words")})
    each = stage_table(each, "each")
    # whole paths, then the light ones into their parents', the deepest level first
    of_head = [F.max(F.when(F.col("light") == 1, F.col(k))).alias(k) for k in ("level", "phc", "phd", "parent")]
    paths = stage_table(each.groupBy("hc", "hd").agg(*of_head, F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "paths")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    whole = None
    levels = []
    for level in range(deepest, 1, -1):
        now = paths.where(F.col("level") == level)
        if whole is not None:
            add = whole.groupBy(F.col("phc").alias("hc"), F.col("phd").alias("hd")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
            now = now.join(add, ["hc", "hd"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        whole = stage_table(now, "level")
        levels.append(whole)
    values = each
    if levels:
        attached = levels[0]
        for x in levels[1:]:
            attached = attached.unionByName(x)
        attached = attached.groupBy(F.col("parent").alias("conv_id"), (F.col("hd") - 1).alias("d")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"))
        values = each.join(attached, ["conv_id", "d"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
    summed = scanned(values, ["hc", "hd"], [F.col("d").desc()], [*node, "conv_id", "parent", "n", "n_children"], sums={"n_leaves": "leaf", "saved_tokens": "saved"})
    out = summed.join(id_digests(ends, node), node, "left")
    return out.select("conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
