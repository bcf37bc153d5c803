"""Best-fit packing of token pieces into sequences by linear grouping.

Everything about the packing is decided on the histogram of piece lengths, whose size is that of a sequence, not of the
data. Large lengths are rounded up within groups of equal cardinality; few-size configurations are optimised over the
groups (column generation: a linear program over configurations, new ones by a knapsack); actual lengths then take the
places of the rounded ones, and what is left, small pieces above all, goes by best fit into the room that remains. The
result is a table of ranges: the pieces of one length with ranks from a to b take one place of the sequences of one layout.
Pieces find their places by their rank within their length, so documents are never gathered.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import WHITE
from .common import Memory, pick, scratch, stage_path, stage_table, write_stage
from .token_files import byte_letters

SEQUENCE = 1024
END_ID = 2
#: Pieces longer than this share of a sequence are large: packed by configurations, the others by best fit.
LARGE_SHARE = 1 / 4
#: Groups of large pieces; with fewer than GROUP_PIECES pieces a group there are fewer groups.
GROUPS = 96
GROUP_PIECES = 6
#: Chunks remembered by a Python worker, and ids in its pool; beyond either the memory starts anew.
CACHE_CHUNKS = 500_000
POOL_IDS = 4_000_000
#: Texts are encoded together up to about this many characters.
BATCH_CHARS = 1 << 21


# ------------------------------------------------------------------------------------------------- configurations


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Groups of (length, number) with equally many pieces each, longest first; a group's size is its first length."""
    total = int(counts.sum())
    stops = [total * (k + 1) // groups for k in range(groups)]
    out, own, seen, k = [], [], 0, 0
    for length, n in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while n:
            take = min(n, stops[k] - seen)
            if take:
                own.append((length, take))
            seen, n = seen + take, n - take
            if seen == stops[k]:
                if own:
                    out.append(own)
                own, k = [], k + 1
    return out


def best_configuration(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits into the room: (value, number of each)."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    useful = np.flatnonzero(worth > 1e-12)
    useful = useful[np.argsort(sizes[useful])]
    s, y = sizes[useful], worth[useful]
    for w in range(1, room + 1):
        k = int(np.searchsorted(s, w, "right"))
        best[w], last[w] = best[w - 1], -1
        if k:
            v = best[w - s[:k]] + y[:k]
            i = int(v.argmax())
            if v[i] > best[w] + 1e-12:
                best[w], last[w] = v[i], i
    out, w = np.zeros(len(sizes), dtype=np.int64), room
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            out[useful[last[w]]] += 1
            w -= int(s[last[w]])
    return float(best[room]), out


def fractional(sizes: np.ndarray, demand: np.ndarray, room: int, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (one a column) and how many sequences take each, with the least sum that covers the demand.

    The revised simplex method, starting from sequences of one size; a knapsack under the dual prices gives each new
    configuration, until none is worth more than one sequence.
    """
    n = len(sizes)
    configs = np.diag(room // sizes).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(configs))
    x = inverse @ demand
    for _ in range(most):
        prices = inverse.sum(axis=0)
        value, column = best_configuration(sizes, prices, room)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.full(n, np.inf)
        np.divide(x, step, out=ratio, where=step > 1e-9)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        configs[:, out] = column
        inverse[out] /= step[out]
        other = np.arange(n) != out
        inverse[other] -= np.outer(step[other], inverse[out])
    return configs.astype(np.int64), x


@dataclass
class Layout:
    """Sequences that are alike: their number and the lengths in them, in order."""

    n: int
    lengths: list[int] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(self.lengths)


class Pool:
    """Layouts by the room left, for best fit."""

    def __init__(self, room: int):
        self.room, self.by_room, self.rooms = room, {}, []

    def add(self, layout: Layout) -> None:
        left = self.room - layout.used
        if left not in self.by_room:
            self.by_room[left] = []
            insort(self.rooms, left)
        self.by_room[left].append(layout)

    def best(self, length: int) -> Layout | None:
        """A layout with the least room that length fits into, taken out."""
        k = bisect_left(self.rooms, length)
        if k == len(self.rooms):
            return None
        left = self.rooms[k]
        own = self.by_room[left]
        layout = own.pop()
        if not own:
            del self.by_room[left]
            self.rooms.pop(k)
        return layout

    def fit(self, length: int, n: int) -> None:
        """Puts n pieces of one length where they fit best; new sequences take the rest."""
        while n:
            layout = self.best(length)
            if layout is None:
                a_sequence = self.room // length
                full, rest = divmod(n, a_sequence)
                if full:
                    self.add(Layout(full, [length] * a_sequence))
                if rest:
                    self.add(Layout(1, [length] * rest))
                return
            take = min(n, layout.n)
            if take < layout.n:
                self.add(Layout(layout.n - take, list(layout.lengths)))
            self.add(Layout(take, [*layout.lengths, length]))
            n -= take


def substituted(groups: list[list[tuple[int, int]]], configs: np.ndarray, times: np.ndarray) -> tuple[list[Layout], list[tuple[int, int]]]:
    """Layouts of the configurations with actual lengths in the places of rounded ones, and the (length, number) left over."""
    left = [list(g) for g in groups]
    out = []
    for c in np.flatnonzero(times):
        todo = [Layout(int(times[c]))]
        for g in np.flatnonzero(configs[:, c]):
            for _ in range(int(configs[g, c])):
                done = []
                for layout in todo:
                    n = layout.n
                    while n and left[g]:
                        length, have = left[g][0]
                        take = min(n, have)
                        done.append(Layout(take, [*layout.lengths, length]))
                        n -= take
                        left[g][0] = (length, have - take)
                        if have == take:
                            left[g].pop(0)
                    if n:
                        done.append(Layout(n, list(layout.lengths)))
                todo = done
        out += [x for x in todo if x.lengths]
    return out, [x for g in left for x in g]


def planned(counts: np.ndarray, groups: int = GROUPS) -> list[Layout]:
    """Layouts that hold counts[length] pieces of each length; a sequence has room for len(counts) - 1 tokens.

    Rounded lengths make the optimum of the configurations too large by what is rounded up. So no more sequences are
    laid out than the tokens of all pieces fill, those with the longest pieces first, and the shortest place of each configuration stays open: the pieces
    meant for it go by best fit, longest first, with the small ones, and so use up what rounding left.
    """
    room = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    pool = Pool(room)
    if left[room]:
        pool.add(Layout(int(left[room]), [room]))
        left[room] = 0
    lengths = np.flatnonzero(left)
    lengths = lengths[lengths > room * LARGE_SHARE]
    n_groups = min(groups, int(left[lengths].sum()) // GROUP_PIECES)
    if n_groups > 1:
        own = grouped(lengths, left[lengths], n_groups)
        sizes = np.array([g[0][0] for g in own])
        demand = np.array([sum(n for _, n in g) for g in own], dtype=np.float64)
        configs, times = fractional(sizes, demand, room)
        filled = int((left * np.arange(room + 1)).sum()) // room
        by_longest = np.argsort((configs > 0).argmax(axis=0), kind="stable")
        times = np.floor(times + 1e-6).astype(np.int64)[by_longest]
        configs, times = configs[:, by_longest], np.diff(np.minimum(np.cumsum(times), filled), prepend=0)
        for c in range(configs.shape[1]):
            places = np.flatnonzero(configs[:, c])
            if configs[:, c].sum() > 1:
                configs[places[-1], c] -= 1  # groups go from long to short
        layouts, rest = substituted(own, configs, times)
        for x in layouts:
            pool.add(x)
        left[lengths] = 0
        for length, n in rest:
            left[length] += n
    for length in np.flatnonzero(left)[::-1].tolist():
        pool.fit(length, int(left[length]))
    return [x for own in pool.by_room.values() for x in own]


# ------------------------------------------------------------------------------------------------------ token ids


class ByteIds:
    """Ids of whole texts by a byte-level vocabulary of the tokenizers library, its special tokens found in the text included.

    No match of the vocabulary's splitting pattern spans a space that a visible character follows, so texts are cut before
    such spaces into chunks. A chunk is encoded once and remembered: its ids lie in a pool, and the ids of a batch of
    texts are gathered from there. Texts that may hold a special token go through the library whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        own = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(own.__getitem__, token)): rank for token, rank in file["model"]["vocab"].items() if all(c in own for c in token)}
        special = [t["content"] for t in file["added_tokens"]]
        ranks = {t: r for t, r in ranks.items() if t not in {x.encode() for x in special}}
        self.merge = tiktoken.Encoding("chunks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.special = re.compile("|".join(map(re.escape, special))).search if special else lambda t: None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        white = "".join(map(chr, [*WHITE, *range(0x1C, 0x20)]))
        self.odd = re.compile(f" [{white}]").search
        self.cut = re.compile(f" (?=[^{white}])").split
        self._forget()

    def _forget(self) -> None:
        """Chunk 0 is the end id."""
        self.slices = Memory(self._slice)
        self.first, self.later = Memory(lambda c: self._chunk(c), 1 << 30), Memory(lambda c: self._chunk(" " + c), 1 << 30)
        self.pool, self.stops = array("i", [END_ID]), array("q", [0, 1])

    def _slice(self, match: str) -> bytes:
        return array("i", self.merge(match.encode("utf-8", "surrogatepass"))).tobytes()

    def _put(self, ids: bytes) -> int:
        self.pool.frombytes(ids)
        self.stops.append(len(self.pool))
        return len(self.stops) - 2

    def _chunk(self, chunk: str) -> int:
        if chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self._put(self.slices[chunk])
        return self._put(b"".join(map(self.slices.__getitem__, self.find(chunk))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, each with the end id; number of ids of each)."""
        if len(self.first) + len(self.later) + len(self.slices) > CACHE_CHUNKS or len(self.pool) > POOL_IDS:
            self._forget()
        rows: list[Iterator[int]] = []
        sizes = []
        later = self.later.__getitem__
        for t in texts:
            if self.special(t):
                own = [self._put(array("i", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes())]
            elif not t:
                own = []
            else:
                chunks = self.cut(t) if t[-1] == " " or self.odd(t) else t.split(" ")
                head = chunks.pop(0)
                own = [self.first[head]] if head else []
                own += map(later, chunks)
            rows.append(own)
            sizes.append(len(own) + 1)
        ends = np.cumsum(np.array(sizes, dtype=np.int64))
        numbers = np.zeros(int(ends[-1]) if sizes else 0, dtype=np.int64)
        keep = np.ones(len(numbers), dtype=bool)
        keep[ends - 1] = False
        numbers[keep] = np.fromiter(chain.from_iterable(rows), np.int64, len(numbers) - len(sizes))
        stops = np.frombuffer(self.stops, dtype=np.int64)
        n = np.diff(stops)[numbers]
        after = np.cumsum(n)
        ids = np.frombuffer(self.pool, dtype=np.int32)[np.arange(after[-1]) + np.repeat(stops[numbers] - (after - n), n)]
        return ids, np.diff(after[ends - 1], prepend=0)


_CODERS: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """One encoder a Python worker and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = ByteIds(path)
    return _CODERS[path]


# ---------------------------------------------------------------------------------------------------- the pieces

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def pieces(df: DataFrame, vocabulary: str, room: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most room tokens of every document, numbered among the pieces of their length in their task (part, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = byte_ids(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(room + 1, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + BATCH_CHARS)))
                ids, sizes = coder.encode(texts[lo:hi])
                n = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (sizes - 1) % room + 1  # tokens of the first piece
                start = np.where(k == 0, 0, head[doc] + (k - 1) * room)
                length = np.where(k == 0, head[doc], room)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(flat[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                new = np.r_[True, length[order][1:] != length[order][:-1]]
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] + seen[length[order]]
                seen += np.bincount(length, minlength=room + 1)
                columns = [pa.array(np.full(len(doc), part, np.int32)), batch.column(0).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(doc)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rank)]
                names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"]
                if with_ids:  # the pieces of a batch lie in a row
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    return pick(df, id_col, text_col).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def placed(table: DataFrame, room: int) -> DataFrame:
    """Pieces with sequence_id and offset. table: a written one of pieces()."""
    per_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(room + 1, dtype=np.int64)
    for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        counts[r["length"]] = r["n"]
    layouts = planned(counts)
    taken = np.zeros(room + 1, dtype=np.int64)
    ranges, sequence = [], 0
    for x in layouts:
        offset = 0
        for length in x.lengths:
            ranges.append((length, taken[length], sequence, offset))
            taken[length] += x.n
            offset += length
        sequence += x.n
    length, first, base, offset = np.array(sorted(ranges), dtype=np.int64).reshape(-1, 4).T
    keys = (length << 44) + first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(keys, (b.column("length").to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(base[at] + rank - first[at]), pa.array(offset[at])], [*kept, "sequence_id", "offset"])

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    kept = [c for c in table.columns if c not in ("part", "rank")]
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes if n in kept)
    return table.join(per_part.select("part", "length", before), ["part", "length"]).mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(df: DataFrame, vocabulary: str, room: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces (and their ids).

    A document is the ids of its whole text and the end id; null and empty texts are the end id alone. Only documents longer than
    room are cut, the first piece being the one that may be shorter. Rows that repeat an id, null included, are
    documents of their own. An empty table gives no rows. The driver and each task hold the histogram of lengths and
    the table of ranges, both bounded by room alone.
    """
    spark = df.sparkSession
    path = stage_path(spark, "packed")
    with scratch(spark):
        out = placed(stage_table(pieces(df, vocabulary, room, id_col, text_col, with_ids), "pieces"), room)
        write_stage(out, path)
    return spark.read.schema(out.schema).parquet(path)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths: the sequences put together from packed pieces with ids; one has at most room tokens."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("x")
    return packed.groupBy("sequence_id").agg(own).select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.length").alias("lengths"))


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_file())
