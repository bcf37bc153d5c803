"""The prefix trie against a plain one that walks from node to node."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort()
    nodes = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        seq = tuple(x[2:] for x in [*turns.get(conv - conv % 20, [])[:h], *own[h:]])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((conv, len(seq)))
    kids, leaves, saved = {}, {}, {}
    for seq in nodes:
        if seq:
            kids.setdefault(seq[:-1], []).append(seq)
    out = []
    for seq in sorted(nodes, key=len, reverse=True):
        own = kids.get(seq, [])
        leaves[seq] = sum(leaves[k] for k in own) if own else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        saved[seq] = (len(nodes[seq]) - 1) * words + sum(saved[k] for k in own)
        ends = ",".join(str(c) for c, n in sorted(nodes[seq]) if n == len(seq))
        parent = min(nodes[seq[:-1]])[0] if seq else None
        out.append((min(nodes[seq])[0], len(seq), parent, len(nodes[seq]), len(own), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, prefix_trie.trie(df).collect()), key=str)


def some_rows(rng, n, texts, depth):
    return [(c, t, rng.choice(("user", "assistant")) if rng.random() < 0.2 else "user", " ".join(["w"] * rng.randint(0, texts))) for c in range(n) for t in range(min(depth, int(rng.expovariate(0.4)) + 1))]


def test_whole_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()]
    assert sorted(map(tuple, prefix_trie.op13_prefix_trie(spark, "/root/testdata/sf0.01").collect()), key=str) == plain(rows)


@pytest.mark.parametrize("parts", [3, 11])
def test_like_the_plain_trie(spark, parts):
    """Much sharing, copies, one conversation that is most of the table and spans several tasks, and one path as long."""
    rng = random.Random(parts)
    rows = some_rows(rng, 150, 2, 8) + [(7, t, "user", "a b c") for t in range(100, 400)] + [(300 + k, t, "user", "same words") for k in range(60) for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = found(spark.createDataFrame(rows, COLUMNS))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain(rows)


def test_odd_conversations(spark):
    """Nulls in any column, turnless and repeated rows, absent first ones of a block, ties, clashing names, empty tables."""
    rows = [(41, None, None, None), (41, 3, "user", " a\tb "), (41, 3, "user", " a\tb "), (43, 1, None, "x"), (None, 1, "user", "x"), (20, None, "user", ""), (20, 0, "", "z" * 40_000), (21, 5, "b", "y"), (21, 5, "a", "y"), (22, 1, "a", "y"), (61, 1, "a", "y")]
    df = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], COLUMNS + ", c int, d string, part int")
    assert found(df) == plain(rows)
    assert found(spark.createDataFrame([], COLUMNS)) == []
    turnless = next(c for c in range(61, 80) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark.createDataFrame([(turnless, 1, "a", "b")], COLUMNS)) == plain([(turnless, 1, "a", "b")])


def test_scans_over_tasks(spark):
    """Running sums, latest values and values before, over keys that span tasks, against a walk row by row."""
    rng = random.Random(2)
    rows = [(rng.choice((1, 1, 1, 2, 3)), i, rng.randint(-(1 << 62), 1 << 62), rng.choice((None, i))) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, x long, y long").repartition(4)
    got = {(r["k"], r["o"]): (r["s"], r["u"], r["l"], r["p"], r["b"]) for r in prefix_trie.scanned(df, ["k"], ["o"], ["k", "o"], sums={"s": "x"}, under={"u": "x"}, last={"l": "y"}, prior={"p": "y"}, back={"b": "y"}).collect()}
    state, want = {}, {}
    for k, o, x, y in sorted(rows):
        total, latest, before = state.get(k, (0, None, None))
        now = (total + x + (1 << 63)) % (1 << 64) - (1 << 63)
        want[k, o] = (now, total, y if y is not None else latest, latest, before)
        state[k] = (now, y if y is not None else latest, y)
    assert got == want


def test_digests_in_pieces(spark, monkeypatch):
    rows = [(1, i) for i in range(-3, 40)] + [(2, 5)] + [(k, k * k) for k in range(3, 40)]
    got = {r["k"]: r["ends_sha256"] for r in prefix_trie.id_digests(spark.createDataFrame(rows, "k long, c long").withColumn("c", F.col("c")), ["k"]).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for q, c in sorted(rows) if q == k).encode()).hexdigest() for k, _ in rows}
