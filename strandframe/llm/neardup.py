"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its word shingles; equal sets are one class.  SimHash fingerprints over the shingles
retrieve the first candidates, by deletion variants.  What they can't reach at the similarity asked for, BANDS
bands of ROWS min-hashes each retrieve: two sets of similarity 0.8 share a band but for 2 in a million cases.
Every link is verified on the whole sets.  Bands are only asked about classes that the fingerprints have not put
into one group: classes are compared with the smallest of each band first, and then with those of the band that this
has not put into their group, so a large group of near copies is linked by a star.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, components, free_shuffles, give_back, map_rows, written
from .hamming import close_pairs
from .lines import Flags, _slices, longs, united
from .wordhash import mix, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 4
#: A pair whose min-hashes agree by this much less than the similarity is not verified: five standard deviations.
SLACK = 0.2
#: Rows of bands that one reducer compares at a time, about.
BUCKET_ROWS = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(31).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingles:
    """The sets of word shingles of some texts; a text of fewer words is one shingle, one without words has none."""

    def __init__(self, texts: list[bytes], shingle: int = SHINGLE):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        first, _, h = words(data)
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = np.searchsorted(ends, first, side="right")
        count = np.bincount(owner, minlength=len(texts))
        begin = np.cumsum(count) - count
        owners, tokens = [], []
        for k in range(1, shingle + 1):
            if k < shingle:
                at = begin[count == k]
            else:
                at = np.flatnonzero(owner[: max(0, len(owner) - k + 1)] == owner[k - 1 :])
            x = np.full(len(at), k, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(k):
                    x = (x + h[at + j]) * _STEP
            owners.append(owner[at]), tokens.append(mix(x))
        owner, token = np.concatenate(owners), np.concatenate(tokens)
        order = np.lexsort((token, owner))
        owner, token = owner[order], token[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (token[1:] != token[:-1])
        self.tokens = token[new]
        self.sizes = np.bincount(owner[new], minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.some = np.flatnonzero(self.sizes)
        self.keys = np.zeros(len(texts), np.int64)
        if len(self.some):
            with np.errstate(over="ignore"):
                self.keys[self.some] = np.add.reduceat(mix(self.tokens), self.starts[self.some]).view(np.int64)

    def sketches(self) -> np.ndarray:
        """Min-hashes of the texts in `some`, a row each."""
        out = np.empty((len(self.some), BANDS * ROWS), np.uint32)
        if len(self.some):
            with np.errstate(over="ignore"):
                for i, (a, b) in enumerate(_FACTORS.T):
                    out[:, i] = np.minimum.reduceat(((self.tokens * a + b) >> np.uint64(32)).astype(np.uint32), self.starts[self.some])
        return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key per band, which other bands don't share."""
    x = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sketches), BANDS))
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            x = mix((x + sketches[:, j::ROWS].astype(np.uint64)) * _STEP)
    return x.view(np.int64)


def sketched(docs: DataFrame, shingle: int, fingerprint) -> DataFrame:
    """(doc_id, set_key, n, sketch, keys, fp) of every row; without words all but doc_id are 0, empty and empty.

    fingerprint(text, shingle) is the text's SimHash as a signed number."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = bytes_of(batch)
        keys, sizes, sketch, bands = [], [], [], []
        fps = np.array([fingerprint(t, shingle) for t in texts], np.int64)
        for a, b in _slices(texts):
            x = Shingles(texts[a:b], shingle)
            s = x.sketches()
            own, own_bands = [b""] * (b - a), [[]] * (b - a)
            for i, row, band in zip(x.some.tolist(), s, band_keys(s)):
                own[i], own_bands[i] = row.tobytes(), band
            keys.append(x.keys), sizes.append(x.sizes)
            sketch += own
            bands += own_bands
        return {"doc_id": batch.column(0), "set_key": np.concatenate(keys), "n": np.concatenate(sizes), "sketch": sketch, "keys": bands, "fp": fps}

    return map_rows(docs, ["doc_id", "text"], kernel, "doc_id long, set_key long, n long, sketch binary, keys array<long>, fp long")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(set_key, tokens): the whole sets of wanted(set_key, doc_id)."""
    flags = docs.sparkSession.sparkContext.broadcast((united(wanted, ["doc_id"], lambda b: [longs(b.column(0))]) or [Flags()])[0])

    def kernel(batch: pa.RecordBatch) -> dict:
        batch = batch.filter(pa.array(flags.value.has(longs(batch.column(0))), pa.bool_()))
        texts = bytes_of(batch)
        keys, sets = [], []
        for a, b in _slices(texts):
            x = Shingles(texts[a:b], shingle)
            raw = x.tokens.tobytes()
            keys += x.keys[x.some].tolist()
            sets += [raw[8 * s : 8 * (s + n)] for s, n in zip(x.starts[x.some].tolist(), x.sizes[x.some].tolist())]
        return {"set_key": keys, "tokens": sets}

    found = map_rows(docs.filter("doc_id is not null"), ["doc_id", "text"], kernel, "set_key long, tokens binary")
    return found.join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, t: float) -> DataFrame:
    """The pairs(a, b) whose whole sets are t or more alike."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
    sets = written(_sets_of(docs, written(classes.select("set_key", "doc_id").join(ends, "set_key")), shingle))
    x = pairs.join(sets.select(F.col("set_key").alias("a"), F.col("tokens").alias("ta")), "a")
    x = x.join(sets.select(F.col("set_key").alias("b"), F.col("tokens").alias("tb")), "b")

    def kernel(batch: pa.RecordBatch) -> dict:
        ok = []
        for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            ok.append(common >= t * (len(p) + len(q) - common) - 1e-9)
        keep = pa.array(ok, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return written(map_rows(x, ["a", "b", "ta", "tb"], kernel, "a long, b long"))


def _across(members: DataFrame, t: float) -> DataFrame:
    """(a, b): pairs of members(key, set_key, n, sketch, component) of a band in different components that may be t alike."""

    def compare(table: pa.Table) -> pa.Table:
        give_back()
        key, name, size, group = (table.column(c).to_numpy() for c in ("key", "set_key", "n", "component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(key), -1)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        seen: set = set()
        for rows in np.split(order, cuts):
            n, g, s, c = size[rows], group[rows], sketch[rows], name[rows]
            for i in range(len(rows) - 1):
                j = i + 1 + np.flatnonzero((g[i + 1 :] != g[i]) & (np.minimum(n[i + 1 :], n[i]) >= t * np.maximum(n[i + 1 :], n[i]) - 1e-9))
                if len(j):
                    j = j[(s[j] == s[i]).mean(axis=1) >= t - SLACK]
                    seen.update((min(c[i], x), max(c[i], x)) for x in c[j].tolist())
        a, b = zip(*seen) if seen else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    buckets = max(1, math.ceil(members.count() / BUCKET_ROWS))
    dealt = members.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def _groups(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_key, component) of every class: the smallest doc_id that links(a, b) of classes reach."""
    name = lambda c: classes.select(F.col("set_key").alias(c), F.col("doc_id").alias(f"d{c}"))
    found = components(links.join(name("a"), "a").join(name("b"), "b").select("da", "db"), "da", "db")
    x = classes.select("set_key", "doc_id").join(found, F.col("doc_id") == F.col("id"), "left")
    return written(x.select("set_key", F.coalesce("component", "doc_id").alias("component")))


def fingerprint_pairs(prints: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: candidate pairs of prints(set_key, fp) by fingerprints at most `distance` bits apart.

    Classes of one fingerprint go with the smallest of them, and a fingerprint with the smallest of those close to it, so
    there are at most two pairs a class."""
    first = written(prints.groupBy("fp").agg(F.min("set_key").alias("low")))
    close = close_pairs(first.select("fp"), distance, distance // 2 + 1).groupBy("b").agg(F.min("a").alias("a"))
    x = close.join(first.select(F.col("fp").alias("a"), F.col("low").alias("la")), "a").join(first.select(F.col("fp").alias("b"), F.col("low").alias("lb")), "b")
    x = x.select(F.col("la").alias("x"), F.col("lb").alias("y")).unionAll(prints.join(first, "fp").select("set_key", "low"))
    return x.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs(a, b) whose ends are in different groups(set_key, component)."""
    name = lambda c: groups.select(F.col("set_key").alias(c), F.col("component").alias(f"g{c}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").filter("ga <> gb").select("a", "b")


def near_copies(docs: DataFrame, fingerprint, distance: int, shingle: int = SHINGLE, t: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row: documents linked directly or through others share a component,
    which is named by its smallest doc_id.  Documents without words are one class.  A null doc_id is in the
    component of its own set and links nothing."""
    narrow = docs.select("doc_id", "text")
    rows = written(sketched(narrow, shingle, fingerprint))
    known = rows.filter("doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n", "sketch", "keys")).alias("x"))
    classes = written(known.select("set_key", "x.*"))
    prints = rows.filter("doc_id is not null and n > 0").select("set_key", "fp").distinct()
    printed = _verified(written(fingerprint_pairs(prints, distance)), narrow, classes, shingle, t)
    by_print = _groups(printed, classes)
    bands = classes.filter("n > 0").select("set_key", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.min("set_key").alias("low"), F.count("*").alias("size")).filter("size > 1").select("key", "low")
    bands = written(bands.join(written(shared), "key"))
    stars = bands.filter("set_key <> low").select(F.col("low").alias("a"), F.col("set_key").alias("b")).distinct()
    stars = written(_apart(stars, by_print))
    links = printed.unionAll(_verified(stars, narrow, classes, shingle, t))
    groups = _groups(links, classes)
    placed = written(bands.join(groups, "set_key").select("key", "set_key", "component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    members = written(placed.join(mixed, "key").join(classes.select("set_key", "n", "sketch"), "set_key"))
    across = _across(members, t).join(stars, ["a", "b"], "left_anti")
    links = links.unionAll(_verified(written(across), narrow, classes, shingle, t))
    free_shuffles(docs.sparkSession)
    named = _groups(links, classes).withColumnRenamed("component", "component_id")
    return rows.select("doc_id", "set_key").join(named, "set_key", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
