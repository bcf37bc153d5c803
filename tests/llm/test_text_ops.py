"""Text operators against plain versions of what they compute."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import byte_bpe, language, mixing, pii, simhash, token_files

ALPHABET = " '  \n\tabsStmdrevl1²é!?.,ñ  中😀"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


def test_bpe_equals_the_library(documents, texts):
    import public_tokenizers as P

    bpe = byte_bpe.ByteBpe(byte_bpe.ranks_file())
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(1)
    samples = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "'s", "it's's", " 's", "a" * 3000, "<|endoftext|>", "  \n "]
    got = [[i for v in slices for i in v[0]] for slices, _ in bpe.encode_batch(samples)]
    assert got == [lib.encode_ordinary(t) for t in samples]
    for t, (slices, starts) in zip(samples, bpe.encode_batch(samples), strict=True):
        assert len(slices) == len(starts) and bpe.decode([i for v in slices for i in v[0]]).decode() == t
    for word in samples[:300]:
        if word:
            assert list(bpe.pair_merge(word.encode())) == bpe.merge_by_ranks(word.encode())
    for r in byte_bpe.round_trip(documents, byte_bpe.ranks_file()).collect():
        want = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), min_size=1, max_size=5))
def test_boundaries_equal_the_pattern(parts):
    import public_tokenizers as P
    import regex

    joined = "\n".join(parts) + "\n"
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    want, at = [], 0
    for p in parts:
        want += [at + m.start() for m in regex.finditer(P.PATTERN, p)] + [at + len(p)]
        at += len(p) + 1
    assert byte_bpe.boundaries(joined, ends).tolist() == want


def test_token_files(spark, documents, texts, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(documents, path, token_files.vocabulary_file())
    lib = Tokenizer.from_file(token_files.vocabulary_file())
    start, want = 0, {}
    for d in sorted(texts):
        ids = [*lib.encode(texts[d], add_special_tokens=False).ids, 2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_tokens(spark, path).collect()} == want


def test_word_ids_on_odd_texts():
    words = token_files.WordIds(token_files.vocabulary_file())
    rng = random.Random(5)
    alphabet = "aA'sS ré\tΣσİıǅ.,!1²３中ﬁ́\n\x1c ß"
    for t in ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["a<|endoftext|>b", "x <|startoftext|> y"]:
        ids, sizes = words.encode([t])
        assert ids.tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 2] and sizes.tolist() == [len(ids)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700))
def test_huffman_round_trip(ids):
    ids = np.array(ids, dtype=np.int64)
    lengths = token_files.code_lengths(np.bincount(ids, minlength=301))
    block = token_files.write_block(np.array([7]), np.array([1]), np.array([len(ids)]), ids, lengths, token_files.canonical(lengths))
    (doc, known, sizes, back), = token_files.read_blocks([block], token_files.decode_table(lengths))
    assert back.tolist() == ids.tolist() and doc.tolist() == [7] and known.all() and sizes.tolist() == [len(ids)]


def test_code_lengths_are_optimal_and_limited():
    import heapq

    counts = np.random.default_rng(3).integers(1, 5000, 80)
    heap = [(int(c), i, [i]) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    plain = np.zeros(80, dtype=int)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        plain[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    assert (plain * counts).sum() == (token_files.code_lengths(counts).astype(int) * counts).sum()
    steep = np.array([1 << i for i in range(30)])
    short = token_files.code_lengths(steep, 6)
    assert short.max() <= 6 and (2.0 ** -short.astype(float)).sum() <= 1


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark, documents, texts):
    rows = {r["doc_id"]: r for r in simhash.simhash_groups(documents).collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {d: r["fingerprint"] for d, r in rows.items()} == {d: f"{f:016x}" for d, f in fps.items()}
    parent = {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert {d: r["component_id"] for d, r in rows.items()} == {d: find(d) for d in fps}


def test_bit_sliced_links_in_blocks(spark):
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**62, 200, dtype=np.uint64)
    near = fps[:120].copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            near[i] ^= np.uint64(1) << np.uint64(b)
    pool = np.unique(np.concatenate([fps, near]))
    starts = np.array([0, 90, 91, 200, len(pool)])
    rng.shuffle(pool)
    a, b = simhash.group_links(pool, starts)
    want = {(i, j) for s, e in zip(starts[:-1], starts[1:], strict=True) for i in range(s, e) for j in range(i + 1, e) if (int(pool[i]) ^ int(pool[j])).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    # the distributed form finds the same links with tiny blocks as without blocks
    table = spark.createDataFrame([(int(x),) for x in pool.view(np.int64)], "fp long")
    small = {(r[0], r[1]) for r in simhash.near_fingerprints(spark, table, block_rows=2).collect()}
    assert small == {(r[0], r[1]) for r in simhash.near_fingerprints(spark, table).collect()} and small


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    assert {language._FAMILY_OF[x] for x in model.langs} == set(model.families)
    pred = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    test = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(pred[r["doc_id"]]["lang_pred"] == r["lang"] for r in test) / len(test) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in pred.values())


def test_unclear_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    assert 0.5 < model.least < 1
    odd = ["wszystkie ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "все люди рождаются свободными и равными в своем достоинстве", "xqzv kjwp zzxq vbnm qwpx jjkq wvxz pqzk zxcv bnmq", "人人生而自由在尊严和权利上一律平等", "kaikki ihmiset syntyvät vapaina ja tasavertaisina"]
    assert language.with_known_language(spark.createDataFrame([(t,) for t in odd], "text string"), model).count() == 0
    known = [r["text"] for r in docs.select("text").collect() if language.has_letter(r["text"])]
    assert language.with_known_language(docs, model).count() >= 0.995 * len(known)


MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.b-1 %+()0", max_size=40))
def test_base_spans_equal_the_patterns(text):
    mail, ip, card, phone = pii.base_spans(text)
    assert mail == [m.span() for m in MAIL.finditer(text)]
    assert ip == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert phone == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    assert card == [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= sum(c.isdigit() for c in m[0]) <= 19 and pii.luhn("".join(c for c in m[0] if c.isdigit()))]


def test_boosted_trees_on_cases_not_seen():
    model = pii.fit()
    hit = miss = wrong = clean = 0
    for marked, span, good in pii.labelled(1500, 99):
        text = marked.replace("\0", "")
        found = [text[a:b] for _, a, b in pii.all_spans(text, model)[1]]
        if good:
            hit += any(span.strip("()") in f or f in span for f in found)
            miss += not found
        else:
            wrong += len(found) > sum(map(len, pii.base_spans(text)))
            clean += 1
    assert hit / (hit + miss) > 0.85 and wrong / clean < 0.05


def test_numbers_beside_each_other():
    model = pii.fit()
    for text, want in (
        ("(555) 123-4567 / 555-987-6543", ["(555) 123-4567", "555-987-6543"]),
        ("555-123-4567. 2024-01-02", ["555-123-4567"]),
        ("2011 555-123-4567", ["555-123-4567"]),
        ("phone 555-123-4567 555-987-6543 555-222-1111", ["555-123-4567", "555-987-6543", "555-222-1111"]),
    ):
        assert [text[a:b] for _, a, b in pii.all_spans(text, model)[1]] == want
    for text in ("12 (345) 678-90 / 1234567", "1234567" * 9 + " 1234567"):  # every run of groups with 7 to 19 digits
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        runs = {(g[0], h[1]) for i, g in enumerate(groups) for h in groups[i:] if 7 <= sum(c.isdigit() for c in text[g[0] : h[1]]) <= 19}
        assert {(a + (text[a] == "("), b) for a, b, _ in pii.digit_runs(text)} == runs


def test_secrets_are_spanned_to_their_end():
    rng = np.random.default_rng(6)
    part = lambda k: "".join(rng.choice(list("abcdefABCDEF0123456789_-"), k))
    for value in (part(449) + "7", f"{part(40)}.{part(380)}.{part(42)}a", part(2999) + "x"):
        text = f'set token = "{value}" and go'
        assert pii.redacted(text, pii.all_spans(text, pii.fit())[1]) == 'set token = "[SECRET]" and go'


def test_redaction_keeps_the_rest():
    assert pii.redacted("ab cd ef", [("email", 3, 5), ("phone", 4, 7)]) == "ab [EMAIL]f"


def water(sizes, weights):
    """Shares by weight with caps of three times the size, the excess shared again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > 3 * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets_and_rounding(spark):
    names = ["a", "B", "c", None, "é", "aa", ""]
    sizes = [10, 1000, 20000, 300, 5, 0, 7000]
    order = sorted(range(7), key=lambda i: (names[i] is None, (names[i] or "").encode()))
    weights = [0.0] * 7
    for k, i in enumerate(order):
        weights[i] = (5, 2, 1)[k % 3]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    for i, t in enumerate(water(sizes, weights)):
        assert got[names[i]] == pytest.approx(t, rel=1e-9)


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = (sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert first == second
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = {}, {}
    for doc, size, _own, t, words, *_ in first:
        assert words <= 3 * size
        taken[source[doc]] = taken.get(source[doc], 0) + words
        target[source[doc]] = t
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target)


def test_entropy_balance_of_two_margins(spark):
    cells = spark.createDataFrame([("x", "p", 100), ("x", "q", 50), ("y", "p", 80), ("y", "q", 70)], "a string, b string, words long")
    a = spark.createDataFrame([("x", 200.0), ("y", 100.0)], "`group` string, target double")
    b = spark.createDataFrame([("p", 180.0), ("q", 120.0)], "`group` string, target double")
    rated, _steps = mixing.entropy_balance(cells, {"a": a, "b": b}, tolerance=1e-7)
    got = {(r["a"], r["b"]): r["words"] * r["rate"] for r in rated.collect()}
    assert got["x", "p"] + got["x", "q"] == pytest.approx(200, rel=1e-5) and got["x", "p"] + got["y", "p"] == pytest.approx(180, rel=1e-5)
    # an exponential tilt keeps the odds ratio of the cells
    assert got["x", "p"] * got["y", "q"] / (got["x", "q"] * got["y", "p"]) == pytest.approx(100 * 70 / (50 * 80), rel=1e-5)
