"""Language, personal data, mixing and every pipeline stage against plain versions, and rows that once went wrong."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from termloom.llm import byte_bpe, language, mixing, pii, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


# ------------------------------------------------------------------------------------------------------- language


def plain_grams(text: str) -> Counter:
    """Hashed grams of the folded letters, one character at a time (for text inside the basic plane)."""
    out: Counter = Counter()
    letters = []
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif letters and letters[-1] != 32:
            letters.append(32)
    cut = lambda v: v & 0xFFFFFFFF
    one = [cut(c * 2654435761) for c in letters]
    two = [cut(cut((a ^ (a >> 15)) * 2246822519) + b) for a, b in zip(one, one[1:])]
    three = [cut(cut((a ^ (a >> 13)) * 3266489917) + b) for a, b in zip(two, one[2:])]
    for h in (*one, *two, *three):
        out[h >> 20] += 1
    return out


def test_grams_and_predictions(documents):
    model = language.fit(documents)
    for r in documents.collect()[:60]:
        if not language.has_letter(r["text"]):
            continue
        want = plain_grams(r["text"])
        assert {k: v for k, v in enumerate(language.grams(r["text"]).tolist()) if v} == want
        x = {k: math.log1p(v) * float(model.idf[k]) for k, v in want.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        margin = [sum(v / size * float(model.weights[k, c]) for k, v in x.items()) + float(model.bias[c]) for c in range(model.weights.shape[1])]
        family = max(zip(margin, model.families, strict=False))[1]
        votes = {x: [0, 0.0] for x in model.members[family]}
        for m, (a, b) in zip(margin[len(model.families) :], model.pairs, strict=True):
            if a in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        assert language.predictions(model, [r["text"]])[0][0] == max(votes, key=lambda k: (*votes[k], k))


def test_sample_does_not_depend_on_ids(spark):
    """Null and repeated ids, and copies of one text, leave every language its share of a bounded sample."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'fr')").selectExpr("cast(null as long) doc_id", "text", "lang")
    one = docs.limit(1)
    many = docs.unionByName(one.crossJoin(spark.range(3000)).drop("id"))
    model = language.fit(many, per_lang=50)
    assert model.langs == ["de", "fr"]
    told = language.identify(docs.selectExpr("lang as doc_id", "text"), model).collect()
    assert sum(r["doc_id"] == r["lang_pred"] for r in told) > 0.95 * len(told)


# -------------------------------------------------------------------------------------------------- personal data


def plain_score(trees: pii.Boosted, row: list[float]) -> float:
    f = trees.base
    for feature, cut, value in trees.trees:
        node = 0
        for _ in range(trees.depth):
            j = int(feature[node])
            node = 2 * node + 1 + (sum(e < row[j] for e in trees.edges[j].tolist()) > cut[node])
        f += value[node - len(feature)]
    return 1 / (1 + math.exp(-f))


def plain_spans(text: str, model: pii.PiiModel) -> set:
    base = [(k, *m.span()) for k, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+")) for m in re.finditer(pattern, text)]
    digits = lambda a, b: re.sub("[^0-9]", "", text[a:b])
    fits = {"email": lambda a, b: True, "phone": lambda a, b: 8 <= len(digits(a, b)) <= 15, "ip": lambda a, b: all(int(p) <= 255 for p in text[a:b].split(".")), "card": lambda a, b: 16 <= len(digits(a, b)) <= 19 and pii.luhn(digits(a, b))}
    base = [s for s in base if fits[s[0]](*s[1:])]
    free = lambda s, spans: all(s[2] <= a or b <= s[1] for _, a, b in spans)
    scored = sorted(((plain_score(model.trees, pii.features(text, *c)), c) for c in set(pii.candidates(text)) if free(c, base)), key=lambda z: (-z[0], z[1][1], -z[1][2], z[1][0]))
    added = []
    for q, c in scored:
        if q >= model.threshold[c[0]] and free(c, added):
            added.append(c)
    return {*base, *added}


EXTRA = [
    "JOHN (AT) EXAMPLE.COM", "write to " + "a" * 200 + " at " + "b" * 150 + ".example.org now", "call 555-123-4567. 2024-01-02 or (555) 987-6543 / 555-111-2222",
    "iban DE89 3704 0044 0532 0130 00 and password: hunter2!x", "1.2.3.4.5.6.7.8 and 1.2.3.999 and 001.002.003.004", "ssn 123-45-6789 then 12345 67 8",
]


def test_spans_are_those_of_a_plain_version(documents):
    model = pii.fit()
    for text in [*(r["text"] or "" for r in documents.collect()[:120]), *EXTRA]:
        got = pii.all_spans(text, model)[1]
        assert set(got) == plain_spans(text, model) and len(got) == len(set(got))


def test_mail_in_capitals_and_long_names():
    assert pii.all_spans(EXTRA[0], pii.fit())[1] == [("email", 0, 21)]
    assert pii.all_spans(EXTRA[1], pii.fit())[1] == [("email", 9, 375)]


@pytest.mark.parametrize(
    "form", ["tel: 01 23 45 67 8{}", "tel: 612 345 67{}", "tel: 030/1234567{}", "tel: 020 7946 095{}", "write to john{} @ example.com", "write to jöhn{} (at) example.org", "key AKIAIOSFODNN7EXAMPL{}"]
)
def test_shapes_of_other_lands(form):
    lead = form.index(" ") + 1 if not form.startswith("write") else len("write to ")
    for k in range(10):
        text = form.format(k) + " please"
        assert (lead, len(text) - len(" please")) in {(a, b) for _, a, b in pii.all_spans(text, pii.fit())[1]}, text


def test_accounts_in_small_letters():
    text = "iban de89370400440532013000 now, and de89 3704 0044 0532 0130 00 too"
    assert [text[a:b] for _, a, b in pii.all_spans(text, pii.fit())[1]] == ["de89370400440532013000", "de89 3704 0044 0532 0130 00"]


@pytest.mark.parametrize("text", ["1" * 300_000, "1." * 60_000, ("1" + " " * 50) * 6000, "a at " * 40_000, "+1 " * 60_000, "token=" * 40_000, "ab12" + "x" * 300_000, "ab12 " + "xyz9 " * 40_000])
def test_odd_runs_take_linear_time(text):
    import time

    began = time.process_time()
    pii.all_spans(text, pii.fit())
    assert time.process_time() - began < 10


# --------------------------------------------------------------------------------------------------------- mixing


def test_copies_against_plain_rates(documents):
    rows = mixing.mix(documents).collect()
    size, source = {}, {}
    for r in documents.collect():
        size[r["doc_id"]], source[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]
    total, taken, largest = Counter(), Counter(), Counter()
    for d, s in source.items():
        total[s] += size[d]
        largest[s] = max(largest[s], size[d])
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    for r in rows:
        s = source[r["doc_id"]]
        rate = r["target"] / total[s]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s])
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) if r["size"] else r["copies"] == 1
        taken[s] += r["taken"]
    for s in total:
        target = next(r["target"] for r in rows if source[r["doc_id"]] == s)
        assert abs(taken[s] - target) <= largest[s]


def test_large_ids_and_ids_that_sources_share(spark):
    big = 9007199254740993
    rows = [(big, "a b c d", None, "x", 0), (None, "a b c d", None, "x", 0)] + [(i, "one two three four", None, s, 0) for i in range(50) for s in ("x", "y")]
    docs = spark.createDataFrame(rows, DOC)
    plan = mixing.mix(docs).collect()
    assert big in {r["doc_id"] for r in plan} and len(plan) == len(rows)
    got = Counter((r["source"], r["doc_id"]) for r in mixing.mixed_rows(docs).collect())
    want: Counter = Counter()
    for r in plan:
        want[r["source"], r["doc_id"]] += r["copies"]
    assert got == +want


def test_rows_that_are_alike_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 7)
    rows = [(None, "a b c", None, "x", k) for k in range(100)] + [(k, "a b c", None, "y", k) for k in range(30)]
    docs = spark.createDataFrame(rows, DOC)
    plan = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(plan) == 130 and all(abs(taken[s] - target[s]) <= 3 for s in target)
    got = Counter(r["source"] for r in mixing.mixed_rows(docs).collect())
    assert {s: n * 3 for s, n in got.items()} == dict(taken)


# --------------------------------------------------------------------------------------------------------- stages


def test_stages_against_plain_versions(spark, documents):
    docs = documents
    kept = corpus_pipeline.language_stage(spark, docs, "").cache()
    model = language.fit(docs)
    told = {r["doc_id"]: language._told(model, [r["text"]])[0] for r in docs.collect()}
    sure = {d for d, (lang, score, like) in told.items() if lang != "und" and like >= 0.2 * model.familiar and (score >= model.least or like >= 0.5 * model.familiar)}
    assert {r["doc_id"] for r in kept.collect()} == sure

    unique = corpus_pipeline.near_duplicate_stage(spark, kept, "").cache()
    fps = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in kept.collect()}
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(d for d in fps if find(d) == d)

    clean = corpus_pipeline.personal_data_stage(spark, unique, "").cache()
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in clean.collect():
        text = before[r["doc_id"]]
        for kind, a, b in sorted(plain_spans(text, pii.fit()), key=lambda s: -s[1]):
            if len([1 for k, x, y in plain_spans(text, pii.fit()) if x < b and a < y]) == 1:
                text = text[:a] + f"[{kind.upper()}]" + text[b:]
        assert r["text"] == text and r["n_chars"] == len(text)

    mixed = corpus_pipeline.mixing_stage(spark, clean, "").cache()
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter(want)

    import public_tokenizers as P

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.ranks_file()), special_tokens={})
    texts = defaultdict(str, {r["doc_id"]: r["text"] for r in clean.collect()})
    tokens = corpus_pipeline.token_stage(spark, mixed, "").collect()
    assert len(tokens) == mixed.count()
    for r in tokens:
        text = texts[r["doc_id"]]
        assert list(r["ids"]) == lib.encode_ordinary(text)
        assert len(r["offsets"]) == len(r["ids"]) and (np.diff(r["offsets"]) >= 0).all()
