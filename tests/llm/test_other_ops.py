"""Embeddings, images, pages, WARC and the shared graph pieces against plain versions."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import common, embedding_caps, html_text, image_copies, warc_fixity


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    pairs = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    linked = {x for a, b in pairs for x in (a, b) if a != b}
    want = roots(pairs, linked)
    assert got == want
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors():
    """Clusters at every angle around the threshold, copies, scaled copies, and vectors that link with nothing."""
    rng = np.random.default_rng(4)
    out = []
    for _ in range(120):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        label = int(rng.integers(0, 3))
        out.append((u, label))
        for c in rng.uniform(0.975, 0.9999, rng.integers(0, 5)):
            w = rng.standard_normal(64)
            w -= (w @ u) * u
            out.append((c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w), label))
        if rng.random() < 0.3:
            out += [(u, label), (2 * u, label), (u, label + 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(out)]
    n = len(rows)
    odd = [(None, 0), ([], 0), ([0.0] * 64, 0), ([float("nan")] + [1.0] * 63, 0), ([float("inf")] + [1.0] * 63, 0), ([None] + [1.0] * 63, 0), (rows[0][1], None), ([1.0, 0.0, 0.0], 0), ([1.0, 0.01, 0.0], 0)]
    return rows + [(n + k, v, label) for k, (v, label) in enumerate(odd)]


@pytest.mark.parametrize(("block", "small"), [(1024, 12), (3, 1)])
def test_near_vectors(spark, monkeypatch, block, small):
    rows = vectors()
    monkeypatch.setattr(common, "SMALL_GROUP", small)
    monkeypatch.setattr(embedding_caps, "bucket_links", lambda r, p, f, screen: common.bucket_links(r, p, f, block, screen))
    table = spark.createDataFrame([(*r, 0, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, id int, component_id string, n_links long")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_caps.near_vectors(table).collect()}
    fine = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = []
    for i, v, a in fine:
        for j, w, b in fine:
            if i < j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                pairs.append((i, j))
    want = roots(pairs, [r[0] for r in rows])
    links = dict.fromkeys(want, 0)
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    assert len(pairs) > 150
    assert got == {i: (links[i], c, i == c) for i, c in want.items()}


def test_near_vectors_of_nothing(spark):
    assert embedding_caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_list_decoding_recall():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((4000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal(u.shape)
    w -= (w * u).sum(axis=1, keepdims=True) * u
    v = 0.9801 * u + np.sqrt(1 - 0.9801**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    (r1, c1), (r2, c2) = embedding_caps.list_decode(u, 256), embedding_caps.list_decode(v, 256)
    both = np.intersect1d(r1 * 10**7 + c1, r2 * 10**7 + c2) // 10**7
    assert len(np.unique(both)) >= 0.9995 * len(u)


def test_image_copies(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 64))
    noisy = base[:25] + 0.02 * rng.standard_normal((25, 64))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([base, noisy, base[:5]]))]
    rows += [(100, None, 0), (101, [0.0] * 64, 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, label int, rid string, n_links int")
    pics = image_copies.pictures(table)
    got = {r["vec_id"]: r for r in image_copies.image_copies(pics, "vec_id", "image").collect() if r["vec_id"] is not None}
    assert sum(got[40 + k]["component_id"] == k for k in range(25)) >= 24
    assert all(got[65 + k]["component_id"] == k for k in range(5))
    assert all(got[k]["kept"] for k in range(40)) and got[100]["component_id"] == 100 and got[101]["component_id"] == 101
    # every pair, checked in full, finds what the tables found
    images = {r["vec_id"]: image_copies.read_pgm(r["image"]) for r in pics.collect() if r["vec_id"] is not None and r["image"] is not None}
    found = {i: image_copies.describe(img[None])[0] for i, img in images.items()}
    packed = [image_copies._packed(*v) for v in found.values()]
    hit = [(i, j) for i in range(len(packed)) for j in range(i) if image_copies.are_copies(packed[i], packed[j])]
    names = list(found)
    want = roots([(names[i], names[j]) for i, j in hit], names)
    assert np.mean([got[i]["component_id"] == want[i] for i in names]) >= 0.95


def moved(img, scale, turn, shape):
    """The picture scaled and turned about its middle."""
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]].astype(float)
    x, y = (x - (shape[1] - 1) / 2) / scale, (y - (shape[0] - 1) / 2) / scale
    c, s = np.cos(turn), np.sin(turn)
    sx, sy = c * x + s * y + (img.shape[1] - 1) / 2, c * y - s * x + (img.shape[0] - 1) / 2
    inside = (sx >= 0) & (sy >= 0) & (sx <= img.shape[1] - 1) & (sy <= img.shape[0] - 1)
    v = image_copies._between(img[None].astype(np.float32), 0, np.clip(sy, 0, img.shape[0] - 1.01), np.clip(sx, 0, img.shape[1] - 1.01))
    return np.where(inside, v, 128)


EDITS = {
    "paler": lambda a: a * 0.8 + 20,
    "a third of the area": lambda a: a[19:77, 19:77],
    "half": lambda a: a.reshape(48, 2, 48, 2).mean(axis=(1, 3)),
    "three quarters": lambda a: image_copies._resampler(96, 72) @ a.astype(np.float32) @ image_copies._resampler(96, 72).T,
    "one and a half": lambda a: moved(a, 1.5, 0, (144, 144)),
    "turned by 20 degrees": lambda a: moved(a, 1, np.deg2rad(20), a.shape),
    "turned by 45 degrees": lambda a: moved(a, 1, np.deg2rad(45), a.shape),
    "noise": lambda a: a + np.random.default_rng(1).normal(0, 4, a.shape),
}


def test_edited_copies_are_found():
    """Pairs that share a table entry and agree on a transform: of every kind of edit at least 0.8, of all at least 0.9."""
    pics = image_copies.render(np.random.default_rng(3).standard_normal((24, 64)), np.zeros(24, dtype=int))
    own = [image_copies.describe(p[None])[0] for p in pics]
    found = {}
    for name, edit in EDITS.items():
        other = [image_copies.describe(np.clip(edit(p), 0, 255)[None])[0] for p in pics]
        found[name] = np.mean([len(np.intersect1d(image_copies.table_keys(a[0]), image_copies.table_keys(b[0]))) > 0 and image_copies.consensus(*a, *b) >= image_copies.AGREE for a, b in zip(own, other, strict=True)])
    assert min(found.values()) >= 0.8 and np.mean(list(found.values())) >= 0.9, found
    assert not any(image_copies.consensus(*own[i], *own[j]) >= image_copies.AGREE for i in range(24) for j in range(i))


@pytest.mark.parametrize("leaders", [1, 64])
def test_buckets_lose_no_link(spark, monkeypatch, leaders):
    """Leaders of a bucket that match nothing do not hide the links of the others, however large the bucket is."""
    monkeypatch.setattr(image_copies, "LEADERS", leaders)
    truth = [(7, 9), (9, 30), (12, 40), (41, 42)]
    monkeypatch.setattr(image_copies, "verified", lambda edges, payload: edges.join(edges.sparkSession.createDataFrame(truth, "a long, b long"), (edges["src"] == F.col("a")) & (edges["dst"] == F.col("b"))).select("src", "dst"))
    rows = [(1, i) for i in (1, 2, 7, 9, 30, 12, 40)] + [(2, 41), (2, 42), (3, 5)]
    got = image_copies.linked_components(spark.createDataFrame(rows, "bucket long, id long"), None).collect()
    assert {(r["node"], r["component"]) for r in got} == {(7, 7), (9, 7), (30, 7), (12, 12), (40, 12), (41, 41), (42, 41)}


def test_payloads_are_shipped_in_slices(spark, monkeypatch):
    """However many pairs there are, payloads shuffled at once are about as many as images, and no link is lost."""
    pics = image_copies.render(np.random.default_rng(5).standard_normal((12, 64)), np.zeros(12, dtype=int))
    images = [*pics, *(p * 0.8 + 20 for p in pics)]
    packed = [image_copies._packed(*image_copies.describe(p[None])[0]) for p in images]
    payload = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(packed)], "id long, packed binary")
    edges = [(i, j) for j in range(len(images)) for i in range(j)]
    sizes, compared = [], image_copies.compared

    def counted(edges, payload, others):
        sizes.append((edges.count(), payload.count() + others.count()))
        return compared(edges, payload, others)

    monkeypatch.setattr(image_copies, "compared", counted)
    monkeypatch.setattr(image_copies, "SHIPPED", 1)
    got = {(r["src"], r["dst"]) for r in image_copies.verified(spark.createDataFrame(edges, "src long, dst long"), payload).collect()}
    assert got == {(i, j) for i, j in edges if image_copies.are_copies(packed[i], packed[j])} and len(got) >= 12
    assert sum(n for n, _ in sizes) == len(edges) > 11 * len(images)
    assert max(a + b for a, b in sizes) <= 3 * len(images)  # so few images fall unevenly into groups


def test_tables_and_pairs_in_turn(spark, monkeypatch):
    """Tables shuffled one by one, and pairs listed a few at a time, give the components of all rows at once."""
    rng = np.random.default_rng(6)
    rows = sorted({(int(b), int(i)) for b, i in zip(rng.integers(0, 12, 70), rng.integers(0, 40, 70), strict=True)})
    truth = [(i, j) for j in range(40) for i in range(j) if (i + j) % 3 == 0]
    listed = []

    def verified(edges, payload):
        listed.append(edges.count())
        return edges.join(edges.sparkSession.createDataFrame(truth, "a long, b long"), (edges["src"] == F.col("a")) & (edges["dst"] == F.col("b"))).select("src", "dst")

    monkeypatch.setattr(image_copies, "verified", verified)
    monkeypatch.setattr(image_copies, "PAIRS", 100)
    tables = [spark.createDataFrame([r for r in rows if r[0] % 4 == t], "bucket long, id long") for t in range(4)]
    got = {r["node"]: r["component"] for r in image_copies.linked_components(tables[0], None, *tables[1:]).collect()}
    share = {(i, j) for a, i in rows for b, j in rows if a == b and i < j}
    linked = [x for x in truth if x in share]
    assert got == roots(linked, {x for pair in linked for x in pair})
    assert len(listed) > 3


def test_large_tables_of_images(spark, monkeypatch):
    """Pictures taken in parts, a Hamming table at a time, give what they give at once."""
    base = np.random.default_rng(9).standard_normal((10, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, base[:6]]))] + [(30, None), (None, [1.0] * 64)]
    pics = image_copies.pictures(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    once = sorted(map(str, image_copies.image_copies(pics, "vec_id", "image").collect()))
    asked, keys = [], image_copies.linked_components
    monkeypatch.setattr(image_copies, "linked_components", lambda rows, payload, *more: asked.append(len(more)) or keys(rows, payload, *more))
    monkeypatch.setattr(image_copies, "SHIPPED", 1)
    assert sorted(map(str, image_copies.image_copies(pics, "vec_id", "image").collect())) == once
    assert asked == [3] and sum("kept=False" in x for x in once) >= 5


def test_textures_are_smoothed_twice():
    f = image_copies.textures(8)
    near = [np.corrcoef(a[:, 1:].ravel(), a[:, :-1].ravel())[0, 1] for a in f]
    assert np.mean(near) == pytest.approx(34 / 37, abs=0.02)  # smoothed once it is 2 / 3


def test_pgm():
    img = np.arange(30, dtype=float).reshape(5, 6)
    assert (image_copies.read_pgm(image_copies.write_pgm(img)) == img).all()
    assert image_copies.read_pgm(b"P6 # colour\n2 1\n255\n" + bytes([255, 0, 0, 0, 0, 0]))[0, 0] == pytest.approx(76.2, abs=0.1)
    for bad in (None, b"", b"P5 2 2 255\n\0", b"PNG", b"P5 x 2 255\n0000", b"P5 0 0 255\n"):
        assert image_copies.read_pgm(bad) is None


def brute_marginals(parent, edge, unary, pair):
    n = len(parent)
    total = np.zeros((n, 2))
    for bits in np.ndindex(*[2] * n):
        s = sum(unary[i, b] for i, b in enumerate(bits)) + sum(pair[edge[i], bits[p], bits[i]] for i, p in enumerate(parent) if p >= 0)
        for i, b in enumerate(bits):
            total[i, b] += np.exp(s)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(3)
    forest = html_text.Forest([html_text.parse("<body><div><p>a<p>b</div><ul><li>c<li>d</ul></body>"), html_text.parse("<p>x</p>")])
    unary, pair = rng.standard_normal((len(forest.parent), 2)), rng.standard_normal((html_text.KINDS**2, 2, 2))
    p, joint, _ = html_text.messages(forest, unary, pair)
    first = int(forest.first[1])
    for lo, hi in ((0, first), (first, len(forest.parent))):
        parent = [v - lo if v >= 0 else -1 for v in forest.parent[lo:hi]]
        assert np.allclose(p[lo:hi], brute_marginals(parent, forest.edge[lo:hi], unary[lo:hi], pair))
    child = forest.parent >= 0
    assert np.allclose(joint[child].sum(axis=1), p[child])


def test_main_text_on_held_out_layouts():
    model = html_text.fit()
    forest = html_text.Forest([html_text.parse(p, labelled=True) for p in html_text.labelled_pages(150, seed=77)])
    has = np.zeros(len(forest.parent), dtype=bool)
    has[[n for rows in forest.texts for n, _ in rows]] = True
    assert ((model.marginals(forest) > 0.5) == forest.label)[has].mean() > 0.97


def test_main_text(spark):
    model = html_text.fit()
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
      <div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n line.<br><p>Second&nbsp;one, here.<ul><li>Item one.<li>Item two.</ul></article>
      <section class="comments"><p>Nice read, thanks.</p></section><form><p>Sign up</p></form><footer>&copy; x</footer></body></html>"""
    rows = [(1, "u", page, 0, "t"), (2, None, None, 0, None), (3, "v", "", 0, None), (None, "w", "<" * 50 + "p>", 0, None), (4, "x", "<div>" * 400 + "deep text here." + "</div>" * 400, 0, None), (1, "u", page, 0, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_text.main_text(table, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "A & B\n\nFirst bold line.\n\nSecond one, here.\n\nItem one.\n\nItem two."
    assert by[2]["text"] == by[3]["text"] == "" and by[3]["n_chars"] == 0 and by[1]["n_chars"] == len(by[1]["text"])
    assert html_text.main_text(table.limit(0), model).count() == 0


def test_heads_that_no_tag_ends():
    rest = "<article><h1>A</h1><p>First line of the text, in full.<p>Second line.</article>"
    inner = '<meta charset="utf-8"><title>T</title><link rel="x"><script>var a = "<p>no</p>";</script><noscript><p>no</p></noscript><noframes><p>no</p></noframes>'
    whole = [r[1] for r in html_text.parse(f"<html><head>{inner}</head><body>{rest}</body></html>").runs]
    assert whole == [["A"], ["First line of the text, in full."], ["Second line."]]
    for head in (f"<html><head>{inner}", f"<head><head>\n{inner}\n", f"<!doctype html><html><head>{inner}<!-- c --><svg><p>no</p></svg>"):
        assert [r[1] for r in html_text.parse(head + rest).runs] == whole
    assert [r[1] for r in html_text.parse(f"<head>{inner} text first<p>then").runs] == [[" text first"], ["then"]]


def test_fixity(spark):
    rows = [(i, f"u{i}", "x" * (i % 90), 1) for i in range(3000)] + [(None, None, None, 1), (5, "u5", "xxxxx", 1), (-4, "neg", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file int")
    records = warc_fixity.page_records(pages).select("id", "file", "position", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))
    hit = (F.col("id") % 997 == 3) & (F.col("id") >= 0)
    replica = records.withColumn("sha256", F.when(hit, F.sha2(F.lit("rot"), 256)).otherwise(F.col("sha256"))).where("id is null or id <> 2999")
    got = {(r["id"], r["offset"]): r["status"] for r in warc_fixity.audit(records, replica).collect()}
    assert len(got) == len(rows)
    assert {k[0] for k, s in got.items() if s == "corrupt"} == {3, 1000, 1997, 2994} and {k[0] for k, s in got.items() if s == "missing"} == {2999}
    assert {r["status"] for r in warc_fixity.audit(records, records).collect()} == {"intact"}
    none = records.limit(0)
    assert {r["status"] for r in warc_fixity.audit(records, none).collect()} == {"missing"}
    assert {r["status"] for r in warc_fixity.audit(none, records).collect()} == {"extra"}
    assert warc_fixity.audit(none, none).count() == 0


@pytest.mark.parametrize("named", [True, False])
def test_fixity_of_files_that_lost_or_gained_records(spark, named):
    schema = "id long, file long, position long, length long, sha256 string"
    rows = [(i, i >> 10, i, 10, f"h{i}") for i in range(3000)] + [(40, 0, 40, 10, "h40")]
    lost, rot = {7, 500, 501, 1024, 2047, 2500, 2999}, {8, 600, 2048, 2600}
    copy = [(i, f, p, n, f"rot{i}" if i in rot else h) for i, f, p, n, h in rows if i not in lost]
    copy += [(9000, 1, 1500, 10, "new"), (9001, 5, 0, 10, "new")]
    if not named:  # the replica's numbers are only its own order, and nothing but the bytes tells a record
        lost, rot = lost | {8}, rot - {8}
        copy = [(None, f, k, n, h) for k, (i, f, p, n, h) in enumerate(sorted(copy, key=lambda r: (r[1], r[2], r[4]))) if i != 8]
    got = warc_fixity.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(copy, schema)).collect()
    by = lambda status: sorted(r["id"] for r in got if r["status"] == status)
    assert by("missing") == sorted(lost) and by("corrupt") == sorted(rot)
    assert [r["sha256"] for r in got if r["status"] == "extra"] == ["new", "new"]
    assert len(by("intact")) == len(rows) - len(lost) - len(rot)


def test_audit_descends_only_into_differing_branches(spark):
    leaf = spark.range(4096).select(F.lit(1).cast("long").alias("file"), F.col("id").alias("position"), F.lit(10).cast("long").alias("length"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    a = warc_fixity.leaves(leaf)
    inside, over = warc_fixity.depth(a)
    levels = warc_fixity.tree(a, inside, over)
    assert [level.count() for level in levels[: inside + 1]] == [4096, 256, 16, 1]
    top = levels[inside].first()
    assert (top["lo"], top["hi"]) == (0, 40960)


def test_read_warc(spark, tmp_path):
    record = lambda body: b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    parts = [record(b"one"), record(b""), record(b"three\r\n\r\nlines")]
    plain = b"".join(parts)
    packed = b"".join(gzip.compress(p) for p in parts)
    assert [r for _, r in warc_fixity.parse_warc(plain)] == parts == [r for _, r in warc_fixity.parse_warc(packed)]
    assert [r for _, r in warc_fixity.parse_warc(plain + b"rubbish")][-1] == b"rubbish" and list(warc_fixity.parse_warc(b"")) == []
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(packed)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert warc_fixity.read_records(files).groupBy("sha256").count().where("count = 2").count() == 3


def test_members_of_a_gzip_file_are_read_in_linear_time():
    import gzip
    import time

    from termloom.llm import warc_fixity

    one = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    big = gzip.compress(bytes(range(256)) * 2000, 0)
    content = one * 20_000 + big + one
    began = time.process_time()
    got = list(warc_fixity.parse_warc(content))
    assert time.process_time() - began < 20 and len(got) == 20_002
    assert [at for at, _ in got[:3]] == [0, len(one), 2 * len(one)] and got[20_000][1] == bytes(range(256)) * 2000 and got[-1][0] == len(content) - len(one)
    cut = list(warc_fixity.parse_warc(one + big[:1000]))
    assert cut[0] == (0, gzip.decompress(one)) and cut[1][0] == len(one)


def test_nodes_vouch_for_byte_ranges(spark):
    from termloom.llm import warc_fixity

    leaf = "file long, idx long, offset long, length long, sha256 string"
    roots = [warc_fixity.tree(spark.createDataFrame([(0, 0, 0, n, "x"), (0, 1, n, 5, "y")], leaf), 1, 0)[-1].first()["hash"] for n in (3, 4)]
    assert roots[0] != roots[1]


def test_operators_at_once(spark):
    """Three threads, each with stage tables and scratch folders of its own, give what they give alone."""
    from concurrent.futures import ThreadPoolExecutor

    from termloom.llm import common

    rng = np.random.default_rng(8)
    tables = [spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60 + 20 * k, (50, 2))], "src long, dst long") for k in range(3)]

    def twice(edges):
        return [sorted(map(tuple, common.connected_components(edges).collect())) for _ in range(2)]

    alone = [twice(t)[0] for t in tables]
    with ThreadPoolExecutor(3) as pool:
        for got, want in zip(pool.map(twice, tables), alone, strict=True):
            assert got == [want, want]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
