"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that lie within the radius agree on two of five bit fields, so ten keys (two fields each) bring every
such pair into one bucket. There the fingerprints stand as vertical bit planes, 64 to a machine word: one XOR a
plane and a carry-save counter update 64 distances at once, and words all of whose lanes have passed the radius are
dropped while the planes go by.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_ROWS, blocked, connected_components, fresh_name, merge_labels, pick, shared_buckets, sorted_groups, stage_table

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Widths of the bit fields, from bit 0 up: fixed by 64 bits and RADIUS + 2 fields.
FIELDS = (13, 13, 13, 13, 12)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a whole text: bits set in over half of the shingles' hashes; 0 where there is no word."""
    if not text:
        return 0
    words = text.encode().translate(_LOWER).translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - shingle + 1]
    n = len(starts)
    h = np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n)
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(count * 2 > n, bitorder="little").tobytes(), "little")


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of uint64 fingerprints: bit l of word w of plane b is bit b of fingerprint 64 w + l."""
    width = -(-len(fps) // 64)
    bits = np.zeros((width * 64, 64), dtype=np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within(query: np.ndarray, plane: np.ndarray, word: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within RADIUS bits, for work items (query fingerprint, word of the planes, lanes that count).

    Two bit counters and a sticky overflow bit hold 64 distances an item; items whose lanes have all overflowed are
    abandoned after every eighth plane. Returns (item, lane mask) of the items that are left.
    """
    item = np.arange(len(query))
    one = np.zeros(len(query), dtype=np.uint64)
    two, over = one.copy(), ~lanes
    for b in range(64):
        x = plane[b, word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & _ONE))
        carry = one & x
        one ^= x
        up = two & carry
        two ^= carry
        over |= up
        if b % 8 == 7:
            live = over != _ALL
            if not live.all():
                item, query, word, one, two, over = (v[live] for v in (item, query, word, one, two, over))
                if not len(item):
                    break
    return item, ~over


def group_links(fps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a < b) within RADIUS bits inside each run of rows that starts delimits."""
    size = np.diff(starts)
    words = -(-size // 64)
    base = np.cumsum(words) - words
    total = int(words.sum())
    slot = np.repeat(base * 64 - starts[:-1], size) + np.arange(starts[-1])
    packed = np.zeros(total * 64, dtype=np.uint64)
    packed[slot] = fps
    plane = planes(packed)
    used = np.zeros(total * 64, dtype=np.uint8)
    used[slot] = 1
    full = np.packbits(used, bitorder="little").view("<u8").astype(np.uint64)
    row_of = np.full(total * 64, -1)
    row_of[slot] = np.arange(len(fps))
    own = slot // 64
    last = np.repeat(base + words, size)
    reach = last - own
    out = []
    step = 1 << 18
    bound = np.cumsum(reach)
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(bound, (bound[lo - 1] if lo else 0) + step)))
        r = reach[lo:hi]
        q = np.repeat(np.arange(lo, hi), r)
        w = own[q] + np.arange(len(q)) - np.repeat(np.cumsum(r) - r, r)
        lane = (slot[q] % 64).astype(np.uint64)
        later = np.where(w == own[q], (_ALL << lane) << _ONE, _ALL)
        item, mask = within(fps[q], plane, w, full[w] & later)
        if len(item):
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane_hit = np.nonzero(bits)
            out.append((q[item[k]], row_of[w[item[k]] * 64 + lane_hit]))
        lo = hi
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _keys(fp) -> list:
    """The ten bucket numbers of a fingerprint column: a pair of fields and which pair it is."""
    at = [sum(FIELDS[:i]) for i in range(len(FIELDS))]
    field = [F.shiftrightunsigned(fp, at[i]).bitwiseAND(F.lit((1 << FIELDS[i]) - 1)) for i in range(len(FIELDS))]
    return [field[i] * (1 << 17) + field[j] * 16 + n for n, (i, j) in enumerate(combinations(range(len(FIELDS)), 2))]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """(id, fp, *keep): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["id", "fp", *keep])

    src = pick(df, id_col, text_col, *keep)
    kind = dict(df.dtypes)
    return src.mapInArrow(run, ", ".join([f"id {kind[id_col]}", "fp long", *(f"`{c}` {kind[c]}" for c in keep)]))


def near_fingerprints(spark: SparkSession, fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(fp, component) of the distinct fingerprints that link with another one; component is the smallest fp reachable."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    light = fps.select(F.col("fp").alias("id"), F.explode(F.array(*_keys(F.col("fp")))).alias("bucket"))
    near = blocked(shared_buckets(light), block_rows).repartition(parts, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in sorted_groups(batches, ["bucket", "bi", "bj"]):
            fp = t.column("id").to_numpy()
            a, b = group_links(fp.view(np.uint64), np.asarray(starts))
            if len(a):
                # a spanning star of each linked set: no more edges than rows
                order = np.argsort(fp, kind="stable")
                rank = np.empty(len(fp), dtype=np.int64)
                rank[order] = np.arange(len(fp))
                lab = merge_labels(len(fp), rank[a], rank[b])
                hit = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays([pa.array(fp[hit]), pa.array(fp[order[lab[rank[hit]]]])], ["src", "dst"])

    return connected_components(near.mapInArrow(run, "src long, dst long")).select(F.col("node").alias("fp"), "component")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links), *keep.

    Documents link when their fingerprints differ in at most three bits. Equal fingerprints are one class and are
    compared once, so groups of copies never become pairs. Null, empty and blank texts have fingerprint zero and link
    like any other; a null id takes part but is never a component's id unless nothing else is there. Rows that repeat
    come back as often as they came in.
    """
    spark = df.sparkSession
    docs = stage_table(fingerprints(df, id_col, text_col, *keep), "simhash")
    classes = stage_table(docs.groupBy("fp").agg(F.min("id").alias("low")), "simhash")
    comp = near_fingerprints(spark, classes.select("fp"))
    low = comp.join(classes, "fp").groupBy("component").agg(F.min("low").alias("low"))
    known = classes.join(comp, "fp", "left").join(low.withColumnRenamed("low", "least"), "component", "left")
    known = known.select("fp", F.coalesce("least", "low").alias("component_id"))
    out = docs.join(known, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the smallest of their SimHash group; of rows that repeat an id, one.

    Rows without an id stay only where their group has none with an id (all such rows stay then).
    """
    key, mark, own, n = (fresh_name(df, x) for x in ("key", "mark", "own_mark", "kept_rows"))
    marked = df.withColumn(mark, F.xxhash64(text_col))
    rows = stage_table(simhash_groups(marked, id_col, text_col, mark).where("doc_id <=> component_id").groupBy("doc_id", mark).agg(F.count(F.lit(1)).alias("c")), "simhash")
    many = rows.groupBy("doc_id").agg(F.sum("c").alias("total")).where("total > 1 and doc_id is not null").select(F.col("doc_id").alias("d"), F.lit(2).alias(n))
    plan = rows.join(many, rows["doc_id"] == many["d"], "left").select(F.col("doc_id").alias(key), F.col(mark).alias(own), F.coalesce(n, F.lit(1)).alias(n))
    plan = stage_table(plan, "simhash")
    kept = marked.join(plan, marked[id_col].eqNullSafe(plan[key]) & (marked[mark] == plan[own]))
    # both halves read one exchange of the rows; only ids that repeat need the second one
    once, again = kept.where(kept[n] == 1), kept.where(kept[n] == 2).dropDuplicates([id_col])
    return once.unionByName(again).select(*[f"`{c}`" for c in df.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


