"""WARC fixity audit by Merkle trees.

Records are hashed, ordered ranges of 16 neighbours are hashed together, and so on up to one root a file and one root
over all files. Two replicas compare roots; only below nodes that differ are the children fetched and compared, down
to the records. Everything is DataFrame expressions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, settled, stage_table

FANOUT_BITS = 4
RECORDS_PER_FILE_BITS = 10
#: A gzip file is fed to the decoder in pieces of so many bytes.
PIECE_BYTES = 1 << 15


def warc_record(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 response record as a string; nulls count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def parse_warc(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file, plain or with one gzip member a record; offsets are those in the file as stored.

    A damaged head ends the file: the rest is one last record, so that no byte escapes the audit.
    """
    if content[:2] == b"\x1f\x8b":
        at, whole = 0, memoryview(content)
        while at < len(content):
            d, begin, parts = zlib.decompressobj(31), at, []
            try:
                while not d.eof and at < len(content):  # piece by piece, so that each byte is read once
                    parts.append(d.decompress(whole[at : at + PIECE_BYTES]))
                    at = min(at + PIECE_BYTES, len(content))
            except zlib.error:
                yield begin, bytes(whole[begin:])
                return
            yield begin, b"".join([*parts, d.flush()])
            at -= len(d.unused_data)
        return
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        size = -1
        if content.startswith(b"WARC/", at) and end >= 0:
            for line in content[at:end].split(b"\r\n"):
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    size = int(value)
        if size < 0:
            yield at, content[at:]
            return
        stop = min(len(content), end + 4 + size + 4)
        yield at, content[at:stop]
        at = stop


def read_records(files: DataFrame) -> DataFrame:
    """(path, offset, length, sha256) of the records of WARC files in a binaryFile DataFrame."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(path, at, len(r), hashlib.sha256(r).hexdigest()) for at, r in parse_warc(content.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "offset", "length", "sha256"])

    return pick(files, "path", "content").mapInArrow(run, "path string, offset long, length long, sha256 string")


def leaves(records: DataFrame) -> DataFrame:
    """records (file, position, length, sha256, ...) get idx and offset: their order and byte range within the file.

    position orders the records of a file (ties by hash). A file is one bounded unit of storage, so its records fit one window.
    """
    order = Window.partitionBy("file").orderBy("position", "sha256")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("idx", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def _parents(nodes: DataFrame, inside: bool) -> DataFrame:
    """Nodes one level up: neighbours share the idx shifted by the fanout; the hash covers the children's numbers, byte
    ranges and hashes in order, so a node vouches for where its records lie as well as for what they say."""
    up = F.shiftright("idx" if inside else "file", FANOUT_BITS)
    key = {"file": F.col("file"), "idx": up} if inside else {"file": up, "idx": F.lit(0).cast("long")}
    child = F.struct(F.col("idx" if inside else "file").alias("k"), "lo", "hi", "hash")
    ordered = F.array_sort(F.collect_list("child"))
    joined = F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["k"].cast("string"), c["lo"].cast("string"), c["hi"].cast("string"), c["hash"])), ",")
    keyed = nodes.select(*[c.alias(n) for n, c in key.items()], child.alias("child"), "lo", "hi")
    return keyed.groupBy("file", "idx").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(joined, 256).alias("hash"))


def tree(leaf: DataFrame, levels_inside: int, levels_over: int) -> list[DataFrame]:
    """Levels of the Merkle tree, leaves first: nodes (file, idx, lo, hi, hash); lo and hi are the byte range in the file."""
    level = leaf.select("file", "idx", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), F.col("sha256").alias("hash"))
    out = [level]
    for step in range(levels_inside + levels_over):
        level = stage_table(_parents(level, step < levels_inside), "merkle")
        out.append(level)
    return out


def depth(*replicas: DataFrame) -> tuple[int, int]:
    """Levels that bring every file to one node, and all files to one (two where numbers are negative too)."""
    inside = over = 0
    for r in replicas:
        idx, low, high = r.agg(F.max("idx"), F.min("file"), F.max("file")).first()
        while (idx or 0) >> (FANOUT_BITS * inside):
            inside += 1
        while any(v is not None and (v >> (FANOUT_BITS * over)) not in (0, -1) for v in (low, high)):
            over += 1
    return inside, over


def differing_leaves(a: list[DataFrame], b: list[DataFrame], inside: int) -> DataFrame:
    """(file, idx, in_a, in_b) of leaves that differ, found from the roots down: children are read only below differing nodes."""

    def unequal(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.select("file", "idx", F.col("hash").alias("ha"))
        y = y.select("file", "idx", F.col("hash").alias("hb"))
        return x.join(y, ["file", "idx"], "full").where(~F.col("ha").eqNullSafe(F.col("hb")))

    wrong = unequal(a[-1], b[-1])
    for level in range(len(a) - 2, -1, -1):
        up_idx = F.shiftright("idx", FANOUT_BITS) if level < inside else F.lit(0).cast("long")
        up_file = F.col("file") if level < inside else F.shiftright("file", FANOUT_BITS)
        keys = wrong.select(F.col("file").alias("_f"), F.col("idx").alias("_i"))
        below = [n.withColumn("_uf", up_file).withColumn("_ui", up_idx).join(keys, (F.col("_uf") == F.col("_f")) & (F.col("_ui") == F.col("_i")), "left_semi") for n in (a[level], b[level])]
        wrong = stage_table(unequal(*below), "merkle")
    return wrong.select("file", "idx", F.col("ha").isNotNull().alias("in_a"), F.col("hb").isNotNull().alias("in_b"))


def realigned(a: DataFrame, b: DataFrame, wrong: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Differing leaves in pairs: (file, idx, status) of the master's that are not intact, and (file, idx) of the extra ones.

    Leaves of a file pair by hash, then by id (repeats of either in their order). What is left, where an id is null, pairs
    by its order between the same two neighbours.
    """

    def ranked(x: DataFrame, name: str, *by: str) -> DataFrame:
        return x.withColumn("rank", F.row_number().over(Window.partitionBy("file", *by).orderBy("idx"))).withColumnRenamed("idx", name)

    def pairs(x: DataFrame, y: DataFrame, *by: str) -> DataFrame:
        keys = ["file", *by, "rank"]
        return stage_table(ranked(x, "ia", *by).join(ranked(y, "ib", *by).select(*keys, "ib"), keys).select("file", "ia", "ib"), "merkle")

    def without(x: DataFrame, done: DataFrame, name: str) -> DataFrame:
        return x.join(done.select("file", F.col(name).alias("idx")), ["file", "idx"], "left_anti")

    cols = ["file", "idx", "id", "sha256"]
    in_a, in_b = (stage_table(x.select(*cols).join(wrong.where(k), ["file", "idx"], "left_semi"), "merkle") for x, k in ((a, "in_a"), (b, "in_b")))
    same = pairs(in_a, in_b, "sha256")
    rest_a, rest_b = without(in_a, same, "ia"), without(in_b, same, "ib")
    named = pairs(rest_a.where("id is not null"), rest_b.where("id is not null"), "id")
    rest_a, rest_b = (stage_table(without(x, named, k), "merkle") for x, k in ((rest_a, "ia"), (rest_b, "ib")))
    # the last leaf before each that has a partner, as the master numbers it
    alike = a.select("file", "idx").join(wrong, ["file", "idx"], "left_anti").select("file", F.col("idx").alias("ia"), F.col("idx").alias("ib"))
    fixed = alike.unionByName(same).unionByName(named).join(rest_a.select("file").intersect(rest_b.select("file")), "file", "left_semi")
    before = Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)

    def placed(rest: DataFrame, name: str) -> DataFrame:
        marked = fixed.select("file", F.col(name).alias("idx"), F.col("ia").alias("at")).unionByName(rest.select("file", "idx", "id"), allowMissingColumns=True)
        marked = marked.withColumn("gap", F.coalesce(F.last("at", True).over(before), F.lit(-1).cast("long")))
        return marked.where("at is null").withColumnRenamed("id", f"id_{name}")

    keys = ["file", "gap", "rank"]
    unnamed = ranked(placed(rest_a, "ia"), "ia", "gap").select(*keys, "ia", "id_ia").join(ranked(placed(rest_b, "ib"), "ib", "gap").select(*keys, "ib", "id_ib"), keys)
    unnamed = stage_table(unnamed.where("id_ia is null or id_ib is null").select("file", "ia", "ib"), "merkle")
    corrupt = named.unionByName(unnamed).select("file", F.col("ia").alias("idx"), F.lit("corrupt").alias("status"))
    missing = without(rest_a, unnamed, "ia").select("file", "idx", F.lit("missing").alias("status"))
    return corrupt.unionByName(missing), without(rest_b, unnamed, "ib").select("file", "idx")


def audit(master: DataFrame, replica: DataFrame) -> DataFrame:
    """The master's records with status: intact, corrupt (the replica's bytes differ) or missing; and the replica's extra ones.

    Both are (id, file, position, length, sha256). Empty replicas leave every record missing, empty masters every one
    extra; equal rows are separate records. The trees say which leaves differ; those are realigned, so that records lost
    from or put into the middle of a file mark no others. A record whose bytes lie elsewhere in its file is intact.
    """
    a, b = stage_table(leaves(master), "merkle"), stage_table(leaves(replica), "merkle")
    inside, over = depth(a, b)
    wrong = settled(master.sparkSession, "merkle", lambda: differing_leaves(tree(a, inside, over), tree(b, inside, over), inside))
    found, extra = realigned(a, b, wrong)
    cols = ["id", "file", "idx", "offset", "length", "sha256"]
    known = a.join(found, ["file", "idx"], "left").select(*cols, F.coalesce("status", F.lit("intact")).alias("status"))
    return known.unionByName(b.join(extra, ["file", "idx"], "left_semi").select(*cols, F.lit("extra").alias("status")))


def page_records(pages: DataFrame) -> DataFrame:
    """pages as WARC records in files of 1024 consecutive ids; rows without an id are dealt into files by their content."""
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    file = F.coalesce(F.shiftright(F.col("page_id").cast("long"), RECORDS_PER_FILE_BITS), F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)) + (1 << 40))
    return pick(pages, "page_id", "url", "html").select(F.col("page_id").alias("id"), file.alias("file"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("position"), record.alias("record"), F.md5(F.coalesce("html", F.lit(""))).alias("mark"))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits pages, stored as WARC, against a replica with known damage: one bit of the last byte flipped in records
    whose html has an md5 that begins with 0, and each file's last record lost where it begins with 1 to 7."""
    records = page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    hashed = lambda r: r.select("id", "file", "position", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"), "mark")
    master = hashed(records)
    rotten = F.when(F.col("mark").startswith("0"), F.concat(F.expr("left(record, length(record) - 1)"), F.lit("\x0b"))).otherwise(F.col("record"))
    copy = hashed(records.withColumn("record", rotten))
    last = copy.groupBy("file").agg(F.max(F.struct("position", "sha256")).alias("top"))
    lost = copy.join(last, "file").where((F.struct("position", "sha256") == F.col("top")) & F.substring("mark", 1, 1).between("1", "7"))
    kept = copy.join(lost.select("file", "position", "sha256"), ["file", "position", "sha256"], "left_anti")
    out = audit(master.drop("mark"), kept.drop("mark"))
    return out.select(F.col("id").alias("page_id"), F.col("file").alias("file_no"), F.col("idx").alias("record_no"), F.col("offset").alias("byte_offset"), F.col("length").alias("n_bytes"), "sha256", "status")


ORACLE = r"""
WITH r AS (
  SELECT page_id, page_id >> 10 AS file_no, md5(coalesce(html, '')) AS mark,
    'WARC/1.0' || e'\r\n' || 'WARC-Type: response' || e'\r\n' || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
    || '>' || e'\r\n' || 'WARC-Target-URI: ' || coalesce(url, '') || e'\r\n' || 'Content-Type: text/html; charset=utf-8'
    || e'\r\n' || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || e'\r\n\r\n' || coalesce(html, '') || e'\r\n\r\n' AS record
  FROM pages
), s AS (
  SELECT page_id, file_no, mark, strlen(record)::BIGINT AS n_bytes, sha256(record) AS sha256 FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY file_no ORDER BY page_id, sha256) - 1 AS record_no,
    count(*) OVER (PARTITION BY file_no) AS n,
    coalesce(sum(n_bytes) OVER (PARTITION BY file_no ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset
  FROM s
)
SELECT page_id, file_no, record_no::BIGINT AS record_no, byte_offset, n_bytes, sha256,
  CASE WHEN record_no = n - 1 AND mark[1] BETWEEN '1' AND '7' THEN 'missing' WHEN mark[1] = '0' THEN 'corrupt' ELSE 'intact' END AS status
FROM o
"""
