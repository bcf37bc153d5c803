"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text becomes an array of codepoint classes; each class stands for a transition function of a small automaton.
Composition of such functions is associative, and all compositions that occur form a finite table, so the state before
every character comes from a blocked scan over table lookups: no regular expression runs. Boundaries cut the text into
slices, each slice is merged once by the ranks and cached, and the token offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from .common import Memory, pick

#: The contraction endings of the pattern, after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: The code points that the pattern's \\s stands for (the Unicode property White_Space).
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# classes of a character, what follows it included
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, SPACE_IN, BLANK_LAST, SPACE_LAST, END = range(9)
# states before a character
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: Texts are scanned together up to about this many characters.
SCAN_CHARS = 1 << 18
COLUMNS = 64
#: Slices remembered by a task; beyond it the memory starts anew.
CACHE_SLICES = 250_000


@cache
def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 2, OTHER, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[list(WHITE)] = SPACE_IN
    table[sys.maxunicode + 1] = END
    return table


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and cut[class, state] (a token starts before the character)."""
    nxt = np.zeros((9, STATES), dtype=np.uint8)
    cut = np.ones((9, STATES), dtype=bool)
    for kind, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        nxt[kind] = state
        cut[kind, [state, AFTER_BLANK]] = False
    nxt[LETTER, ONE_MORE], nxt[LETTER, TWO_MORE] = START, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    for kind, state in ((QUOTE1, ONE_MORE), (QUOTE2, TWO_MORE)):
        nxt[kind] = state
        nxt[kind, [IN_OTHERS, AFTER_BLANK]] = IN_OTHERS
        cut[kind, [IN_OTHERS, AFTER_BLANK]] = False
    nxt[SPACE_IN], cut[SPACE_IN, IN_SPACE] = IN_SPACE, False
    nxt[BLANK_LAST] = AFTER_BLANK
    nxt[SPACE_LAST] = START
    nxt[END] = START
    return nxt, cut


@cache
def compositions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the classes' functions: comp[f, g] is "f, then g"; each class's function; the functions."""
    nxt, _ = automaton()
    found = {}
    for row in nxt:
        found.setdefault(bytes(row), len(found))
    rename = np.array([found[bytes(row)] for row in nxt], dtype=np.uint8)
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in [bytes(row) for row in nxt]:
            h = bytes(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    maps = list(found)
    comp = np.array([[found[bytes(g[s] for s in f)] for g in maps] for f in maps], dtype=np.uint8)
    return comp, rename, np.array([list(f) for f in maps], dtype=np.uint8)


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state before each character: a scan in three passes (columns up, row ends across, columns down)."""
    nxt, _ = automaton()
    comp, rename, maps = compositions()
    n = len(kinds)
    rows = -(-n // COLUMNS)
    grid = np.full(rows * COLUMNS, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = grid.reshape(rows, COLUMNS).T.copy()
    total = rename[grid[0]]
    for c in range(1, COLUMNS):
        total = comp[total, rename[grid[c]]]
    step = 1
    while step < rows:  # doubling over the row totals
        total[step:] = comp[total[:-step], total[step:]]
        step *= 2
    state = np.full(rows, START, dtype=np.uint8)
    state[1:] = maps[total[:-1], START]
    out = np.empty((COLUMNS, rows), dtype=np.uint8)
    for c in range(COLUMNS):
        out[c] = state
        state = nxt[grid[c], state]
    return out.T.reshape(-1)[:n]


def boundaries(text: str, ends: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in texts that are joined by one separator each; ends: the separators' places."""
    table = class_table()
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = table[cps]
    kinds[ends] = END
    after = np.r_[kinds[1:], np.uint8(END)]
    white = kinds == SPACE_IN
    last = white & (after != SPACE_IN) & (after != END)
    kinds[last] = SPACE_LAST
    kinds[last & (cps == 0x20)] = BLANK_LAST
    quote = np.flatnonzero((cps == 0x27) & (kinds == OTHER))
    if len(quote):
        padded = np.r_[cps, np.zeros(2, np.uint32)]
        a, b = padded[quote + 1], padded[quote + 2]
        two = np.zeros(len(quote), dtype=bool)
        for x, y in LONG_ENDINGS:
            two |= (a == ord(x)) & (b == ord(y))
        kinds[quote[two]] = QUOTE2
        kinds[quote[np.isin(a, [ord(x) for x in SHORT_ENDINGS])]] = QUOTE1
        kinds[ends] = END
    _, cut = automaton()
    return np.flatnonzero(cut[kinds, states_before(kinds)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Encoder and decoder over a rank file."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known = Memory(self._merged)
        # the library's own splitting pattern is never used here: it gets one slice at a time
        self.pair_merge = tiktoken.Encoding("slices", pat_str=r"\S+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece

    def merge_by_ranks(self, piece: bytes) -> list[int]:
        """The same spelled out: the pair of lowest rank merges first, the leftmost of equals. For tests."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in ranks else [piece]
        while len(parts) > 1:
            low, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if low == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[list[tuple], np.ndarray]]:
        """Per text: its slices' cached (ids, ids as text, number of ids, bytes) and the slices' code point offsets."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to]) <= SCAN_CHARS):
                size += len(texts[to]) + 1
                to += 1
            part = texts[at:to]
            joined = "\n".join(part) + "\n"
            ends = np.cumsum([len(t) + 1 for t in part]) - 1
            cuts = boundaries(joined, ends)
            place = np.searchsorted(cuts, ends)
            lo = start = 0
            for k, hi in enumerate(place.tolist()):
                own = cuts[lo : hi + 1] - start
                yield self._slices(part[k], own.tolist()), own[:-1]
                lo, start = hi + 1, int(ends[k]) + 1
            at = to

    def _merged(self, piece: str) -> tuple:
        ids = tuple(self.pair_merge(piece.encode("utf-8", "surrogatepass")))
        return ids, " ".join(map(str, ids)), len(ids)

    def _slices(self, text: str, own: list[int]) -> list[tuple]:
        if len(self.known) > CACHE_SLICES:
            self.known.clear()
        return list(map(self.known.__getitem__, map(text.__getitem__, map(slice, own, own[1:]))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One coder a Python worker and rank file."""
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


ENCODED = "doc_id long, ids array<int>, offsets array<int>"


def encode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, offsets: the ids of each whole text and, for each id, the code point where its slice starts.

    Null and empty texts have no ids. Repeated rows and null ids are kept as they are; any length of text or slice works.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids, offsets = [], []
                for slices, starts in bpe.encode_batch([t or "" for t in part.column(1).to_pylist()]):
                    ids.append(list(chain.from_iterable([v[0] for v in slices])))
                    offsets.append(np.repeat(starts, [v[2] for v in slices]).astype(np.int32) if slices else [])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return pick(df, id_col, text_col).mapInArrow(run, ENCODED)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, content (bytes): the inverse of encode; null ids give empty content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([bpe.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "content"])

    return pick(df, id_col, ids_col).mapInArrow(run, "doc_id long, content binary")


def round_trip(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode the ids, in one pass that keeps only digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, ids_sha, text_sha = [], [], []
                for slices, _ in bpe.encode_batch([t or "" for t in part.column(1).to_pylist()]):
                    ids = list(chain.from_iterable([v[0] for v in slices]))
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join([v[1] for v in slices]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ranks_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks_file())
