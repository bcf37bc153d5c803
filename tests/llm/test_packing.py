"""Packing against the tokenizers library, the plain bound on sequences, and best fit piece by piece."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from termloom.llm import packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.vocabulary_file())


def test_ids_are_the_librarys(library):
    coder = packing.ByteIds(packing.vocabulary_file())
    rng = random.Random(4)
    alphabet = "aA'sS réllve\tΣσİıǅ.,!1²３中ﬁ́\n\r\x1c ß \x85\xa0\u3000\u200b\u180e<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2500)]
    texts += ["".join(rng.choice("ab  \n\n\t'1.") for _ in range(rng.randint(0, 25))) for _ in range(2500)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> x", "a <|endoftext", " ", "  ", " a", "a ", "", "x" * 3000, " \n" * 500]
    ids, sizes = coder.encode(texts)
    at = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert ids[at : at + n].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], repr(t)
        at += n
    assert at == len(ids)


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_CHUNKS", 5)
    coder = packing.ByteIds(packing.vocabulary_file())
    for t in ("one two three", "four five six seven", "one two"):
        assert coder.encode([t])[0].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def held(layouts, room):
    got = np.zeros(room + 1, dtype=int)
    for x in layouts:
        assert x.n > 0 and 0 < x.used <= room
        for length in x.lengths:
            got[length] += x.n
    return got


def test_best_configuration():
    """The knapsack against all multisets."""
    from itertools import combinations_with_replacement

    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes, worth = np.unique(rng.integers(3, 12, 4))[::-1], rng.random(4)
        worth = worth[: len(sizes)]
        value, config = packing.best_configuration(sizes, worth, 20)
        best = max(sum(worth[i] for i in c) for n in range(7) for c in combinations_with_replacement(range(len(sizes)), n) if sum(sizes[i] for i in c) <= 20)
        assert value == pytest.approx(best) and config @ worth == pytest.approx(best) and config @ sizes <= 20


def test_fractional_optimum():
    """Halves and thirds: prices of 1/2, 1/2 and 1/4 prove the value."""
    configs, times = packing.fractional(np.array([50, 34, 33]), np.array([10.0, 6.0, 6.0]), 100)
    assert times.sum() == pytest.approx(5 + 3 + 1.5) and (configs @ times >= [10 - 1e-9, 6 - 1e-9, 6 - 1e-9]).all()


@pytest.mark.parametrize("shape", ["even", "large", "one", "three", "none", "few"])
def test_plans_hold_all_and_are_short(shape):
    rng = np.random.default_rng(6)
    room = 1024
    lengths = {
        "even": rng.integers(1, room + 1, 20000), "large": rng.integers(500, 700, 5000), "one": np.full(3001, 400), "three": rng.choice([341, 342, 600], 9000),
        "none": np.zeros(0, int), "few": np.array([1024, 1, 5, 1000, 20]),
    }[shape]
    counts = np.bincount(lengths, minlength=room + 1)
    layouts = packing.planned(counts)
    assert (held(layouts, room) == counts).all()
    n, bound = sum(x.n for x in layouts), -(-int(lengths.sum()) // room)
    pool = packing.Pool(room)
    for length in np.flatnonzero(counts)[::-1].tolist():
        pool.fit(length, int(counts[length]))
    assert n <= 1.003 * sum(x.n for own in pool.by_room.values() for x in own) + 1
    if shape == "even":
        assert n <= 1.002 * bound + 1


def test_whole_query(spark, library):
    """Every piece of every document, its ids, and gapless sequences of at most 1024 tokens, near the bound in number."""
    rows = packing.op11_packing(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got, spans = {}, {}
    for r in rows:
        got[r["doc_id"], r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want, total = {}, 0
    for d, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert got == want and len(rows) == len(want)
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(spans) <= 1.005 * -(-total // 1024)


def test_odd_documents(spark, nasty, empty, library):
    rows = packing.pack(nasty, packing.vocabulary_file(), 64, with_ids=True)
    built = packing.sequences(rows).collect()
    texts = sorted((r["text"] or "") for r in nasty.collect())
    want = sorted(i for t in texts for i in [*library.encode(t, add_special_tokens=False).ids, 2])
    assert sorted(i for r in built for i in r["ids"]) == want and all(len(r["ids"]) <= 64 and sum(r["lengths"]) == len(r["ids"]) for r in built)
    assert rows.where("piece = 0").count() == nasty.count()
    assert packing.pack(empty, packing.vocabulary_file()).collect() == []
