"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Texts become hashed counts of letter unigrams to trigrams over the whole text, weighted by idf and normalised. A
one-versus-rest linear SVM scores the families; inside the winning family one linear SVM for each pair of its languages
votes, and the summed margins break ties.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick

BUCKETS = 1 << 12
#: Distinct texts of each language that the classifier is fitted on at most, chosen by a hash of text and language.
SAMPLE_PER_LANG = 400
#: Languages that are learned at most: the most frequent ones, of equals the one that sorts first.
MOST_LANGS = 1000
EPOCHS = 12
RIDGE = 1e-4
#: Shares of the lower quartile of held-back texts' likeness: below the first a text is in letters that were never learned,
#: below the second it is odd enough to go if its prediction is unclear as well.
STRANGE, ODD = 0.2, 0.5
#: ISO 639-1 codes by family; codes that are not here form families by likeness of their letters.
FAMILIES = {
    "germanic": "da de en is nb nl nn no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he",
    "east_asian": "ja ko zh",
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def grams(text: str) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the folded letters; all other characters act as one space."""
    low = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
    cp = low.astype(np.uint32)
    letter = _letters()[low]
    cp[~letter] = 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    cp = cp[keep]
    if not len(cp):
        return np.zeros(BUCKETS, dtype=np.int64)
    h1 = cp * np.uint32(2654435761)
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(2246822519) + h1[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(13))) * np.uint32(3266489917) + h1[2:]
    top = np.uint32(32 - 12)
    return np.bincount(np.concatenate([(h >> top) for h in (h1, h2, h3)]), minlength=BUCKETS)


_LETTER_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER_TABLE:
        _LETTER_TABLE.append(np.array([chr(c).isalpha() or 0xD800 <= c < 0xE000 for c in range(1 << 16)]))
    return _LETTER_TABLE[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class LanguageModel:
    """Family scorer and pairwise scorers; weights (BUCKETS, columns) over idf-weighted, normalised counts."""

    def __init__(self, langs: list[str], families: dict[str, str]):
        self.langs = langs
        self.family_of = families
        self.families = sorted(set(families.values()))
        self.members = {f: [x for x in langs if families[x] == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        self.idf = np.ones(BUCKETS, dtype=np.float32)
        self.weights = np.zeros((BUCKETS, len(self.families) + len(self.pairs)), dtype=np.float32)
        self.bias = np.zeros(self.weights.shape[1])
        self.slope = 4.0
        self.least = 0.5
        self.centers = np.zeros((BUCKETS, len(langs)), dtype=np.float32)
        self.familiar = 0.0

    def vector(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts, dtype=np.float32)
        x *= self.idf
        n = np.sqrt(np.einsum("...i,...i->...", x, x))[..., None]
        x /= np.where(n == 0, 1, n)
        return x

    def likeness(self, x: np.ndarray, lang: list[str]) -> np.ndarray:
        """Cosine of each vector with the mean text of its language: low for letters that were never learned."""
        return (x @ self.centers)[np.arange(len(x)), [self.langs.index(k) for k in lang]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def decide(self, m: np.ndarray) -> tuple[str, float]:
        """Language and the margin that decided it least clearly."""
        nf = len(self.families)
        order = np.argsort(-m[:nf], kind="stable")
        family = self.families[order[0]]
        clear = float(m[order[0]] - m[order[1]]) / 2 if nf > 1 else float("inf")
        votes = {x: [0, 0.0] for x in self.members[family]}
        low = {x: float("inf") for x in votes}
        for k, (a, b) in enumerate(self.pairs):
            if a in votes:
                v = float(m[nf + k])
                votes[a if v >= 0 else b][0] += 1
                votes[a][1] += v
                votes[b][1] -= v
                low[a], low[b] = min(low[a], v), min(low[b], -v)
        best = max(votes, key=lambda x: (votes[x][0], votes[x][1], x))
        return best, min(clear, low[best])

    def score(self, margin: float) -> float:
        return 1.0 if margin == float("inf") else float(1 / (1 + np.exp(-self.slope * margin)))


def families_of(langs: list[str], centroids: np.ndarray) -> dict[str, str]:
    """Known codes by the table; any other language joins the family of the known one whose letters are most alike, if they are."""
    out = {x: _FAMILY_OF[x.split("-")[0].lower()] for x in langs if x.split("-")[0].lower() in _FAMILY_OF}
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    for i, x in enumerate(langs):
        if x not in out:
            near = sorted(((float(unit[i] @ unit[langs.index(y)]), y) for y in out if y in langs), reverse=True)
            out[x] = out[near[0][1]] if near and near[0][0] > 0.8 else f"family of {x}"
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge) by averaged seeded stochastic gradient steps; y is +1 or -1."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, n = np.zeros_like(w), 0.0, 0
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            i = order[at : at + 32]
            step += 1
            rate = 2.0 / (1 + 0.01 * step)
            slack = np.maximum(0, 1 - y[i] * (x[i] @ w + b)) * y[i] * weight[i]
            w += rate * (x[i].T @ slack / len(i) - ridge * w)
            b += rate * slack.mean() * 0.1
            if epoch >= epochs // 2:
                n += 1
                mean_w += (w - mean_w) / n
                mean_b += (b - mean_b) / n
    return mean_w, mean_b


def train(counts: np.ndarray, labels: list[str]) -> LanguageModel:
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    df = (counts > 0).sum(axis=0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1.0).astype(np.float32)
    x = np.log1p(counts, dtype=np.float32) * idf
    centroids = np.array([x[y == k].mean(axis=0) for k in range(len(langs))])
    model = LanguageModel(langs, families_of(langs, centroids - centroids.mean(axis=0) * (len(langs) > 1)))
    model.idf = idf
    x = model.vector(counts)
    nf = len(model.families)
    fam = np.array([model.families.index(model.family_of[langs[k]]) for k in y])
    hold = np.arange(len(x)) % 5 == 4
    for k in range(nf if nf > 1 else 0):
        sign = np.where(fam == k, 1.0, -1.0)
        balance = np.where(fam == k, 0.5 / max(1e-9, (fam == k).mean()), 0.5 / max(1e-9, (fam != k).mean()))
        model.weights[:, k], model.bias[k] = linear_svm(x[~hold], sign[~hold], np.minimum(balance, 10)[~hold])
    for k, (a, b) in enumerate(model.pairs):
        ia, ib = langs.index(a), langs.index(b)
        own = ((y == ia) | (y == ib)) & ~hold
        sign = np.where(y[own] == ia, 1.0, -1.0)
        model.weights[:, nf + k], model.bias[nf + k] = linear_svm(x[own], sign, np.ones(int(own.sum())))
    centers = np.array([x[(y == k) & ~hold].mean(axis=0) if ((y == k) & ~hold).any() else x[y == k].mean(axis=0) for k in range(len(langs))])
    model.centers = (centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)).T.astype(np.float32)
    if hold.any():
        model.familiar = float(np.quantile(model.likeness(x[hold], [langs[k] for k in y[hold]]), 0.25))
    model.slope, model.least = _calibrated(model, x[hold], [langs[k] for k in y[hold]])
    return model


def _calibrated(model: LanguageModel, x: np.ndarray, truth: list[str]) -> tuple[float, float]:
    """From held-back sample rows: the slope of the score, of a fixed list the one with the least log loss, and the score
    below which a prediction is unclear, that of half the least margin of a right one.
    """
    if not len(x):
        return model.slope, model.least
    told = [model.decide(m) for m in model.margins(x)]
    right = np.array([a == t for (a, _), t in zip(told, truth, strict=True)])
    margin = np.minimum(np.array([c for _, c in told]), 50)

    def loss(s: float) -> float:
        p = np.clip(1 / (1 + np.exp(-s * margin)), 1e-6, 1 - 1e-6)
        return float(-np.where(right, np.log(p), np.log(1 - p)).mean())

    slope = min((1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0), key=loss)
    half = max(0.0, float(margin[right].min())) / 2 if right.any() else 0.0
    return slope, float(1 / (1 + np.exp(-slope * half)))


def held_out(doc_id: Column) -> Column:
    """The contract's held-out quarter: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> LanguageModel | None:
    """Fit on a bounded sample of labelled rows that are not held out; None where there is no labelled text with letters.

    The bound is per_lang distinct texts for each of at most MOST_LANGS languages: those with the smallest hashes of text
    and language, so rows that repeat an id, null included, or a text do not crowd out others. A draw by the same hash
    at twice the expected share comes first, so that only few texts are shuffled.
    """
    src = pick(df, id_col, text_col, lang_col).toDF("id", "text", "lang")
    src = src.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("id"))).select("lang", "text", F.xxhash64("text", "lang").alias("h"))
    distinct = src.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGS)
    n = {r["lang"]: r["n"] for r in distinct.collect()}
    if not n:
        return None
    share = F.element_at(F.create_map(*[F.lit(v) for k, c in sorted(n.items()) for v in (k, min(1.0, 2.0 * per_lang / c))]), F.col("lang"))
    drawn = src.where(F.pmod(F.col("h"), F.lit(1 << 20)) / float(1 << 20) < share).groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= per_lang).select("h", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, x, grams(t).astype(np.int32)) for i, t, x in zip(*(c.to_pylist() for c in b.columns), strict=True) if has_letter(t)]
            at = [np.flatnonzero(c) for _, _, c in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([r[2][k] for r, k in zip(rows, at, strict=True)], pa.list_(pa.int32()))], ["id", "lang", "at", "n"])

    got = drawn.mapInArrow(run, "id long, lang string, at array<int>, n array<int>").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["id", "lang"], kind="stable")
    counts = np.zeros((len(got), BUCKETS), dtype=np.float32)
    for k, (at, c) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[k, np.asarray(at)] = c
    return train(counts, list(got["lang"]))


def identify(df: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing could be learned; ties go to
    the language that sorts last. Texts of any length are read whole; only the text enters the prediction.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                told = predictions(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(df, id_col, text_col).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, lang_pred string, score double")


def predictions(model: LanguageModel | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    return [(lang, score) for lang, score, _ in _told(model, texts)]


def _told(model: LanguageModel | None, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, likeness to the language's mean text) of each text."""
    out = [("und", 0.0, 0.0)] * len(texts)
    known = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
    if known:
        x = model.vector(np.array([grams(texts[i]) for i in known], dtype=np.float32))
        said = [model.decide(m) for m in model.margins(x)]
        for i, (lang, low), like in zip(known, said, model.likeness(x, [k for k, _ in said]).tolist(), strict=True):
            out[i] = (lang, model.score(low), like)
    return out


def is_known(model: LanguageModel | None, least: float, lang: str, score: float, like: float) -> bool:
    return lang != "und" and like >= STRANGE * model.familiar and (score >= least or like >= ODD * model.familiar)


def with_known_language(df: DataFrame, model: LanguageModel | None, least: float | None = None, text_col: str = "text") -> DataFrame:
    """The rows of df whose language can be told; rows pass by as they are, without a shuffle.

    A text without letters goes, one whose letters are unlike the mean text of its language, and one that is somewhat
    unlike it and unclear too (a score under `least`, by default the model's own bound). An unclear text in known letters stays.
    """
    at = df.columns.index(text_col)
    if least is None:
        least = model.least if model is not None else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                keep = [is_known(model, least, *x) for x in _told(model, part.column(at).to_pylist())]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
