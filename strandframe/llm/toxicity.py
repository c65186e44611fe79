"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated bigram models, one for toxic and one for ordinary texts, share the lowest order: the
continuation counts of both classes together.  A word too rare to have its own estimate backs off to
those shared counts in both models and so says nothing.  A text's evidence is its length-normalised
log-likelihood ratio over the whole text, over its most toxic window and over its most toxic words; a
logistic curve fitted on labelled rows that the models have not seen turns that into a probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import bytes_of, documents, give_back, lean_batches, map_rows, pieces, written
from .wordhash import mix, words

DISCOUNT = 0.75
WINDOW = 8
TOP_WORDS = 3
#: Bound of the labelled sample: at most this many rows of each class train the models, and as many again
#: of each fit the curve.  Model size and driver memory follow from it, not from the corpus.
SAMPLE_ROWS = 12_000
#: Bytes of text counted or scored at once: counts of word pairs take many times their text's size.
COUNT_BYTES, SCORE_BYTES = 1 << 19, 1 << 21
#: A word or word pair of the sample has an estimate of its own unless it is a singleton: one token says
#: nothing of a class.  Above that only discount and shared continuation counts smooth.
LEAST_TOKENS = 2
CALIBRATION_FOLD = 4


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


#: Letters, digits, _ and all bytes outside ASCII make words; A-Z are folded by the hash.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() or b == 95 else 32 for b in range(256))
_SLICE = 1 << 18


def _parts(text: bytes):
    """A long text in parts of about _SLICE bytes that end between words."""
    at = 0
    while len(text) - at > 2 * _SLICE:
        end = text.find(b" ", at + _SLICE)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text); no word's hash is 0."""
    sizes = np.zeros(len(texts), np.int64)
    found: list[np.ndarray] = [np.zeros(0, np.uint64)]
    group: list[bytes] = []
    owner: list[int] = []

    def flush() -> None:
        data = np.frombuffer(b" ".join(group), np.uint8)
        start, _, h = words(data)
        ends = np.cumsum([len(x) + 1 for x in group])
        np.add(sizes, np.bincount(np.array(owner)[np.searchsorted(ends, start, side="right")], minlength=len(sizes)), out=sizes)
        found.append(np.maximum(h, np.uint64(1)))
        group.clear(), owner.clear()

    held = 0
    for i, text in enumerate(texts):
        for part in _parts(text.translate(_WORD_BYTES)):
            group.append(part), owner.append(i)
            held += len(part)
            if held >= _SLICE:
                flush()
                held = 0
    if group:
        flush()
    return np.concatenate(found), sizes


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, calibrating, text) of a bounded sample without the held-out fold, and all its rows by class.

    The sample is the first `rows` of each class and part in the order of a hash of doc_id; its ids, at
    most 4 * rows, are broadcast, so texts outside it never move.  Texts that
    stand twice in it count once.  Labels that are null or disagree about a document are left out.
    """
    agreed = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high")).filter("toxic = high").select("doc_id", "toxic")
    open_rows = agreed.filter(fold(F.col("doc_id")) != 0).withColumn("calibrating", fold(F.col("doc_id")) == CALIBRATION_FOLD)
    sizes = {r["toxic"]: r["count"] for r in open_rows.groupBy("toxic").count().collect()}
    parts = [
        open_rows.filter((F.col("toxic") == c) & (F.col("calibrating") == F.lit(k))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for c in (0, 1) for k in (False, True)
    ]
    chosen = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "calibrating", "text").filter("text is not null")
    return sample.dropDuplicates(["text", "toxic"]), sizes


GRAMS = "a long, b long, n0 long, n1 long, t0 long, t1 long"


def count_grams(sample: DataFrame) -> DataFrame:
    """(a, b, n0, n1, t0, t1): tokens and texts by class of the word pairs (a, b) of training texts, and of the words
    b, for which a is 0.  Words are their hashes; null and empty texts have none."""

    def kernel(batch: pa.RecordBatch) -> dict:
        h, sizes = hashed_words(bytes_of(batch))
        text = np.repeat(np.arange(len(sizes)), sizes)
        pair = np.flatnonzero(text[1:] == text[:-1])
        a = np.concatenate((np.zeros(len(h), np.uint64), h[pair]))
        b = np.concatenate((h, h[pair + 1]))
        text = np.concatenate((text, text[pair]))
        key = pair_keys(a, b)
        order = np.argsort(key, kind="stable")  # a key's texts stay in order
        a, b, text, key = a[order], b[order], text[order], key[order]
        toxic = batch.column(0).to_numpy()[text]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = new.copy()
        first[1:] |= text[1:] != text[:-1]
        at = np.flatnonzero(new)
        sums = lambda x: np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        n1, t1 = sums(toxic == 1), sums(first & (toxic == 1))
        return {"a": a[at].view(np.int64), "b": b[at].view(np.int64), "n0": sums(toxic != 1), "n1": n1, "t0": sums(first & (toxic != 1)), "t1": t1}

    part = map_rows(sample.filter("not calibrating"), ["toxic", "text"], kernel, GRAMS, COUNT_BYTES)
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")])


def reliability(n: np.ndarray, texts: tuple[int, int], noise: float) -> np.ndarray:
    """How far grams' counts by class tell more than chance: (g / (g + noise)) squared, where g is the
    likelihood-ratio statistic against the classes' shares of texts and noise about what the largest g of as
    many grams without a class reaches.  It grows with the counts and cuts none off."""
    share = np.array(texts, float)[:, None] / max(sum(texts), 1)
    g = 2 * (n * np.log(np.maximum(n, 1e-300) / np.maximum(n.sum(axis=0) * share, 1e-300))).sum(axis=0)
    g = np.maximum(g, 0)
    return (g / (g + noise)) ** 2


class KneserNey:
    """Log-likelihood ratios of words and word pairs, from counts by class of the grams that have estimates.

    words, pairs: hashes and (n0, n1), (t0, t1) of each, of pairs both words'; continuations: of each word, after how many
    different words it stands in either class.  totals: of all grams, with estimates or not: tokens by class, different
    words and pairs, and the different words of each class together; texts by class.
    """

    def __init__(self, words: tuple, pairs: tuple, continuations: np.ndarray, totals: dict):
        h, n, t = words
        order = np.argsort(h)
        self.words, n, t, kinds_before = h[order], n[:, order].astype(float), t[:, order].astype(float), continuations[order]
        shared = (1.0 + kinds_before) / (totals["pairs"] + totals["words"] + 1)
        back = DISCOUNT * totals["types"] / max(sum(totals["tokens"]), 1)  # one weight for both: backing off says nothing
        uni = np.stack([np.maximum(n[c] - DISCOUNT, 0) / max(totals["tokens"][c], 1) + back * shared for c in (0, 1)])
        a, b, two, two_texts = pairs
        first, last = np.searchsorted(self.words, a), np.searchsorted(self.words, b)
        ratios = np.zeros(len(a))
        out = np.zeros((2, len(a)))
        for c in (0, 1):
            share = np.maximum(two[c] - DISCOUNT, 0) / np.maximum(n[c][first], 1.0)
            left = 1 - np.bincount(first, weights=share, minlength=len(h))[first]
            out[c] = share + np.maximum(left, 1e-3) * uni[c][last]
        noise = 2 * math.log(len(h) + len(a) + 2)
        ratios = (np.log(out[1]) - np.log(out[0])) * reliability(two_texts.astype(float), totals["texts"], noise)
        key = pair_keys(a, b)
        order = np.argsort(key)
        self.pairs, self.pair_ratio = key[order], ratios[order]
        self.word_ratio = (np.log(uni[1]) - np.log(uni[0])) * reliability(t, totals["texts"], noise)

    @staticmethod
    def _found(keys: np.ndarray, ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys there are, their values)."""
        if not len(ordered):
            return np.zeros(0, np.int64), values
        at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
        hit = np.flatnonzero(ordered[at] == keys)
        return hit, values[at[hit]]

    def ratios(self, h: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Log ratio of each word; follows: whether the word before it is of the same text."""
        out = np.zeros(len(h))
        hit, value = self._found(h, self.words, self.word_ratio)
        out[hit] = value
        second = np.flatnonzero(follows[1:]) + 1
        hit, value = self._found(pair_keys(h[second - 1], h[second]), self.pairs, self.pair_ratio)
        out[second[hit]] = value
        return out

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Per text: mean log ratio, the largest, the largest mean over WINDOW words in a row, and the mean of
        the TOP_WORDS largest; a shorter text is taken as filled up with words that say nothing."""
        h, sizes = hashed_words(texts)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        follows = np.ones(len(h), bool)
        follows[starts[sizes > 0]] = False
        ratio = self.ratios(h, follows)
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        out = np.zeros((len(texts), 4))
        out[:, 0] = (total[ends] - total[starts]) / np.maximum(sizes, 1)
        for i in np.flatnonzero(sizes).tolist():
            r, s = ratio[starts[i] : ends[i]], total[starts[i] : ends[i] + 1]
            out[i, 1] = r.max()
            out[i, 2] = ((s[WINDOW:] - s[:-WINDOW]).max() if len(r) > WINDOW else r.sum()) / WINDOW
            out[i, 3] = (np.partition(r, -TOP_WORDS)[-TOP_WORDS:].sum() if len(r) > TOP_WORDS else r.sum()) / TOP_WORDS
        return out


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a ridge logistic regression, by Newton steps."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [1e-1] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([w[0]], w[1:] / scale))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """(model, curve); (None, prior) where a class has no usable row."""
    sample, sizes = labelled(docs, labels, rows)
    sample = written(sample)
    train = {r["toxic"]: r["count"] for r in sample.filter("not calibrating").groupBy("toxic").count().collect()}
    size = (train.get(0, 0), train.get(1, 0))
    if min(size) == 0:
        share = (sizes.get(1, 0) + 1) / (sizes.get(0, 0) + sizes.get(1, 0) + 2)
        return None, np.array([math.log(min(share, 0.49) / (1 - min(share, 0.49)))])
    grams = written(count_grams(sample))
    single = F.col("a") == 0
    t = grams.agg(
        F.sum(F.when(single, F.col("n0"))).alias("s0"), F.sum(F.when(single, F.col("n1"))).alias("s1"),
        F.count(F.when(single, 1)).alias("words"), F.count(F.when(~single, 1)).alias("pairs"),
        F.sum(F.when(single, (F.col("n0") > 0).cast("int") + (F.col("n1") > 0).cast("int"))).alias("types"),
    ).first()
    totals = {"tokens": (t["s0"] or 0, t["s1"] or 0), "words": t["words"], "pairs": t["pairs"], "types": t["types"] or 0, "texts": size}
    often = F.col("n0") + F.col("n1") >= LEAST_TOKENS
    before = grams.filter(~single).groupBy("b").agg(F.count("*").alias("kinds"))
    own = grams.filter(single & often).join(before, "b", "left").select("b", "n0", "n1", "t0", "t1", F.coalesce("kinds", F.lit(0)).alias("kinds")).toArrow()
    two = grams.filter(~single & often).select("a", "b", "n0", "n1", "t0", "t1").toArrow()
    column = lambda x, c: x.column(c).to_numpy()
    counts = lambda x: [np.stack([column(x, c) for c in cs]) for cs in (("n0", "n1"), ("t0", "t1"))]
    model = KneserNey((column(own, "b").view(np.uint64), *counts(own)), (column(two, "a").view(np.uint64), column(two, "b").view(np.uint64), *counts(two)), column(own, "kinds"), totals)
    del own, two
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch: pa.RecordBatch) -> dict:
        e = shared.value.evidence(bytes_of(batch))
        return {"toxic": batch.column(0), "e": list(e)}

    seen = map_rows(sample.filter("calibrating"), ["toxic", "text"], kernel, "toxic int, e array<double>", SCORE_BYTES).collect()
    y = np.array([r["toxic"] for r in seen], float)
    x = np.array([r["e"] for r in seen]).reshape(-1, 4)
    if not 0 < y.sum() < len(y):
        return model, np.array([-1.0, 1.0, 0.0, 0.0, 0.0])
    true_share = sizes[1] / (sizes[0] + sizes[1])
    weight = np.where(y == 1, true_share / y.mean(), (1 - true_share) / (1 - y.mean()))
    return model, fit_curve(x, y, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Null and empty texts have no evidence and get the curve's value there.  Without labels of both
    classes every text gets the labels' smoothed share, held under one half.  Repeated rows score alike.
    """
    model, curve = fit(docs, labels, rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, curve))

    def kernel(batch: pa.RecordBatch) -> dict:
        model, curve = shared.value
        z = np.full(batch.num_rows, curve[0])
        if model is not None:
            z = z + model.evidence(bytes_of(batch)) @ curve[1:]
        return {"doc_id": batch.column(0), "score": 1 / (1 + np.exp(-np.clip(z, -700, 700)))}

    scored = map_rows(docs, ["doc_id", "text"], kernel, "doc_id long, score double", SCORE_BYTES)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the rows predicted toxic, all columns as they are; rows are judged where they stand."""
    ship_package(docs.sparkSession)
    lean_batches(docs.sparkSession)
    model, curve = fit(docs, labels, rows)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model, curve))
    at = docs.columns.index("text")

    def keep(batches):
        give_back()
        model, curve = shared.value
        for batch in pieces(batches, "text", SCORE_BYTES):
            texts = [b"" if t is None else t for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(curve[0] + model.evidence(texts) @ curve[1:] < 0))

    return docs.mapInArrow(keep, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, as score_toxicity() has them."""
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
