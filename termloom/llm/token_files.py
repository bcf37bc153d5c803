"""Token-id files: canonical length-limited Huffman coding, decoded by table in independent blocks.

A file is two Parquet folders, so that any file system Spark knows can hold it: `code` has one row, the code length of
every id (the code itself is canonical), and `blocks` has one row a block: its place (part, seq), the ids before it in
its part, and the content: a header, the directory of its documents, bit offsets of every 64th id (the checkpoints) and
the bits. Parts and blocks ascend by document id. All checkpoints of a block decode side by side.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memory, drop_stage, pick, shared_dir, stage_path

MAGIC = b"TLH1"
MAX_BITS = 20
CHECKPOINT_IDS = 64
BLOCK_IDS = 1 << 16
END_ID = 2
#: Words and chunks remembered by a Python worker, and ids in its pool; beyond either the memory starts anew.
CACHE_WORDS = 600_000
POOL_IDS = 4_000_000
#: Marks that end a word, each a match of its own there.
CLOSING = frozenset(".,;:!?")
#: Texts are encoded together up to about this many bytes.
BATCH_BYTES = 4 << 20
#: Fixed value: how the vocabulary file splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# ---------------------------------------------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; ids that never occur get 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more symbols than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, row = [], leaf
    for level in range(limit):
        if level:
            pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaf, pairs])
            at = np.argsort(both, kind="stable")
            row = both[at]
            levels.append(at < len(leaf))
        else:
            levels.append(np.ones(len(leaf), dtype=bool))
    need = 2 * len(leaf) - 2
    length = np.zeros(len(leaf), dtype=np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:need].sum())
        length[:n] += 1
        need = 2 * (need - n)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: codes ascend by length, then by id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    if len(order):
        n = lengths[order].astype(np.uint64)
        steps = np.uint64(1) << (np.uint64(63) - n)  # as fractions of 2^63
        codes[order] = np.r_[np.uint64(0), np.cumsum(steps)[:-1]] >> (np.uint64(63) - n)
    return codes


def decode_table(lengths: np.ndarray, limit: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of the next limit bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = 1 << (limit - lengths[order].astype(np.int64))
    ids, n = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.uint8)
    total = int(width.sum())
    ids[:total], n[:total] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, n


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(big-endian 64-bit words, checkpoint bit offsets) of an array of ids."""
    if not len(ids):
        return np.zeros(1, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    pos = ends - n
    word = pos >> 6
    free = 64 - (pos & 63) - n
    code = codes[ids]
    head = np.where(free >= 0, code << np.maximum(free, 0).astype(np.uint64), code >> np.maximum(-free, 0).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    out[word[first]] = np.add.reduceat(head, first)
    spill = np.flatnonzero(free < 0)
    out[word[spill] + 1] |= code[spill] << (64 + free[spill]).astype(np.uint64)
    return out, pos[::CHECKPOINT_IDS].astype(np.uint32 if ends[-1] < 1 << 32 else np.uint64)


def unpack(words: np.ndarray, at: np.ndarray, table: tuple[np.ndarray, np.ndarray], limit: int = MAX_BITS) -> np.ndarray:
    """Ids of lanes that start at bit offsets at, CHECKPOINT_IDS each and all in step."""
    ids, n = table
    pos = at.astype(np.int64)
    out = np.zeros((CHECKPOINT_IDS, len(at)), dtype=np.uint32)
    top = len(words) - 2
    drop = np.uint64(64 - limit)
    for k in range(CHECKPOINT_IDS):
        w = np.minimum(pos >> 6, top)
        off = (pos & 63).astype(np.uint64)
        bits = (words[w] << off) | ((words[w + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        peek = bits >> drop
        out[k] = ids[peek]
        pos += n[peek]
    return out.T


def write_block(doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    words, at = pack(ids, lengths, codes)
    head = struct.pack("<4sIQIIQ", MAGIC, len(doc_ids), len(ids), len(at), at.itemsize, len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), at.tobytes(), words.astype(">u8").tobytes()])


def read_blocks(contents: list[bytes], table: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block (document ids, whether they are not null, ids of each document, all ids); the blocks' lanes run together."""
    heads, words, lanes, base = [], [], [], 0
    for content in contents:
        magic, docs, total, marks, width, n = struct.unpack_from("<4sIQIIQ", content)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at, own = struct.calcsize("<4sIQIIQ"), []
        for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), (f"<u{width}", marks), (">u8", n)):
            own.append(np.frombuffer(content, kind, k, at))
            at += own[-1].nbytes
        words.append(own[4])
        lanes.append(own[3].astype(np.int64) + base)
        base += 64 * n
        heads.append((own[0], own[1].astype(bool), own[2], total, marks))
    ids = unpack(np.concatenate(words).astype(np.uint64), np.concatenate(lanes), table)
    at = 0
    for doc_ids, known, sizes, total, marks in heads:
        yield doc_ids, known, sizes, ids[at : at + marks].reshape(-1)[:total]
        at += marks


# ----------------------------------------------------------------------------------------------- the tokenizer


class WordIds:
    """Ids of whole texts by the tokenizers library, as 16-bit (or 32-bit) numbers.

    No token spans white space in this kind of vocabulary, so texts are cut at spaces into chunks, and each chunk is
    encoded once and remembered: its ids lie in a pool, and the ids of a batch of texts are gathered from there.
    Chunks of Latin letters take the library's model directly, word by word; all others, and chunks that could hold a
    special token, go through its whole chain.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.find = regex.compile(SPLIT).findall
        self.model = self.tokenizer.model
        self.letter = byte_letters()
        self._forget()

    def _forget(self) -> None:
        """An empty pool: only the end id, as chunk number 0."""
        self.words = Memory(self._word)
        self.place = Memory(self._remembered, 1 << 30)
        self.pool = array(self.code, [END_ID])
        self.stops = array("q", [0, 1])

    def _word(self, word: str) -> bytes:
        if not (word.isascii() and word.isalnum()):  # bytes of letters and digits stand for themselves
            word = "".join(map(self.letter.__getitem__, word.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _remembered(self, chunk: str) -> int:
        """The number of a chunk that is new here."""
        if (chunk.isascii() or (max(chunk) < "ɐ" and "İ" not in chunk)) and "<|" not in chunk:
            low = chunk.lower()
            if low.isalpha():
                self.pool.frombytes(self.words[low])
            elif low[-1:] in CLOSING and low[:-1].isalpha():
                self.pool.frombytes(self.words[low[:-1]] + self.words[low[-1]])
            else:
                self.pool.frombytes(b"".join(map(self.words.__getitem__, self.find(low))))
        else:
            self.pool.extend(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        self.stops.append(len(self.pool))
        return len(self.stops) - 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other, each with the end id; number of ids of each)."""
        if len(self.place) > CACHE_WORDS or len(self.words) > CACHE_WORDS or len(self.pool) > POOL_IDS:
            self._forget()
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        rows = np.fromiter(map(self.place.__getitem__, chain.from_iterable(chunks)), np.int64, int(ends[-1]))
        numbers = np.insert(rows, ends, 0)  # number 0, the end id, after each text
        stops = np.frombuffer(self.stops, dtype=np.int64)
        n = np.diff(stops)[numbers]
        after = np.cumsum(n)
        ids = np.frombuffer(self.pool, dtype=self.kind)[np.arange(after[-1]) + np.repeat(stops[numbers] - (after - n), n)]
        return ids, np.diff(after[ends + np.arange(len(ends))], prepend=0)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a Python worker and vocabulary."""
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


# --------------------------------------------------------------------------------------------------- the files


RAW_SCHEMA = "part int, seq long, start long, docs binary, known binary, sizes binary, ids binary"
RAW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), *((n, pa.binary()) for n in ("docs", "known", "sizes", "ids"))])
COUNTS = -1


def tokenized(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of raw ids in ascending order of document id: part, seq, start, docs, known, sizes, ids.

    The last row of a part, with seq COUNTS, holds how often the part has each id of the vocabulary. Rows that repeat
    an id, null included, may be in several parts, by their text.
    """
    from pyspark import TaskContext

    spark = df.sparkSession
    src = pick(df, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = src.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        part, seq, start, own, total = TaskContext.get().partitionId(), 0, 0, [], 0
        counts = np.zeros(coder.size, dtype=np.int64)

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, RAW, strict=True)], schema=RAW)

        def block() -> pa.RecordBatch:
            docs, known, sizes, ids = (np.concatenate(x) for x in zip(*own, strict=True))
            return row(part, seq, start, docs.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), ids.tobytes())

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_BYTES)))
                piece = batch.slice(lo, hi - lo)
                docs = pc.fill_null(piece.column(0), 0).to_numpy(zero_copy_only=False).astype("<i8")
                known = pc.is_valid(piece.column(0)).to_numpy(zero_copy_only=False).astype(np.uint8)
                ids, sizes = coder.encode([t or "" for t in piece.column(1).to_pylist()])
                counts += np.bincount(ids, minlength=coder.size)
                stops = np.cumsum(sizes)
                at = 0
                while at < len(sizes):  # blocks end after the document that fills them
                    used = int(stops[at - 1]) if at else 0
                    to = min(len(sizes), int(np.searchsorted(stops, used + BLOCK_IDS - total)) + 1)
                    own.append((docs[at:to], known[at:to], sizes[at:to], ids[used : stops[to - 1]]))
                    total += int(stops[to - 1]) - used
                    if total >= BLOCK_IDS:
                        yield block()
                        seq, start, own, total = seq + 1, start + total, [], 0
                    at = to
                lo = hi
        if own:
            yield block()
        if counts.any():
            yield row(part, COUNTS, 0, b"", b"", b"", counts.tobytes())

    return near.mapInArrow(run, RAW_SCHEMA)


def write_tokens(df: DataFrame, target: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise whole texts, append the end id to each, and write the file under target.

    Null and empty texts are the end id alone. Null ids come first; rows that repeat an id stay next to each other.
    """
    spark = df.sparkSession
    coder = WordIds(vocabulary)
    kind, size = coder.kind, coder.size
    raw_path = stage_path(spark, "tokens")
    tokenized(df, vocabulary, id_col, text_col).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.schema(RAW_SCHEMA).parquet(raw_path)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0):
                n = np.frombuffer(v.as_buffer(), np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    counts = np.zeros(size, dtype=np.int64)
    for r in raw.where(F.col("seq") == COUNTS).select("ids").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most one row an id of the vocabulary
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, seq, start, docs, known, sizes, ids = (b.column(c)[k] for c in range(7))
                docs, known, sizes, ids = (np.frombuffer(v.as_buffer(), t) for v, t in ((docs, "<i8"), (known, "u1"), (sizes, "<u4"), (ids, kind)))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), pa.array([seq.as_py()]), pa.array([start.as_py()]), pa.array([len(ids)]), pa.array([write_block(docs, known, sizes, ids, lengths, codes)], pa.binary())], ["part", "seq", "start", "n", "content"])

    raw.where(F.col("seq") != COUNTS).mapInArrow(code, "part int, seq long, start long, n long, content binary").write.mode("overwrite").option("compression", "none").parquet(f"{target}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.mode("overwrite").parquet(f"{target}/code")
    drop_stage(spark, raw_path)


def read_tokens(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file; start counts the ids before it."""
    lengths = np.frombuffer(spark.read.parquet(f"{source}/code").first()["lengths"], np.uint8)
    blocks = spark.read.schema("part int, seq long, start long, n long, content binary").parquet(f"{source}/blocks")
    # one row a part: as many as the writer had partitions
    per_part = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = per_part.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            for k, (docs, known, sizes, ids) in ((lo + j, x) for lo in range(0, b.num_rows, 8) for j, x in enumerate(read_blocks(b.column(2).slice(lo, 8).to_pylist(), table))):
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                flat = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[k].as_py()] * len(docs), pa.int32()), pa.array(docs, mask=~known), pa.array(starts + b.column(1)[k].as_py()), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    out = blocks.select("part", "start", "content").mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    out = out.join(before, out["part"] == before["_part"])
    return out.select("doc_id", (F.col("at") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark)}/{stage_path(spark, 'tokenfile').rsplit('/', 1)[1]}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), target, vocabulary_file())
    return read_tokens(spark, target)
