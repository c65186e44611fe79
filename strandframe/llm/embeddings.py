"""Embedding near-dedup by iterative quantisation.

A rotation learned on a bounded sample (Gong & Lazebnik 2011) turns unit vectors into balanced binary
codes.  Codes are retrieved through multi-index Hamming tables: four segments, each with its one-wildcard
variants, verified on the whole code.  Vectors of one code form a cell, cells are cut into blocks, and
pairs of blocks are reranked with the original vectors in double precision.  Where the sample shows that one
rotation's tables retrieve too few, as with vectors that have much in common, other rotations add theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_rows, written
from .hamming import close_pairs, cut

#: At most so many vectors, the first in the order of a hash, teach the rotations, and so many of them measure recall.
SAMPLE, MEASURED = 20_000, 1_000
ROUNDS = 40
BITS = 64
#: Codes further apart are not reranked, unless the sample's links need more.  A bit differs with probability
#: acos(0.95)/pi = 0.10, so of 64 bits more than 14 differ in fewer than one pair in 500 at the threshold itself.
RADIUS, WIDEST = 14, 22
SEGMENTS = 4
#: Rotations are added until this share of the sample's links and of pairs made at the threshold is retrieved.
RECALL, RECALL_AT_THRESHOLD, MOST_ROTATIONS = 0.99, 0.9, 8
#: Vectors of a block, on average at most.
BLOCK = 256
#: Rows of a table of large cells that are broadcast at most.
MOST_BROADCAST = 100_000


def normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows in double precision, usable): rows with non-finite parts and zero rows are not usable, and zero."""
    x = x.astype(np.float64)
    usable = np.isfinite(x).all(axis=1)
    x[~usable] = 0
    top = np.abs(x).max(axis=1, initial=0)
    usable &= top > 0
    x = x / np.where(top > 0, top, 1)[:, None]  # keeps squares of very large and very small parts finite
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], usable


def parts_of(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, all of that length, as a matrix; null parts are NaN."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width) if len(flat) else np.zeros((0, width))


def _rotation(x: np.ndarray, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    z = x - mean
    _, axes = np.linalg.eigh(z.T @ z)
    bits = min(BITS, x.shape[1])
    p = axes[:, ::-1][:, :bits]
    v = z @ p
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, p @ turn


def learn_rotation(x: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection on BITS axes): principal axes turned so that signs lose least.  Vectors of fewer parts
    than BITS get several rotations side by side, so that codes have no constant bits."""
    mean, p = _rotation(x, seed, rounds)
    while p.shape[1] < BITS:
        seed += 1000
        p = np.concatenate((p, _rotation(x, seed, rounds)[1]), axis=1)
    return mean, p[:, :BITS]


def codes(x: np.ndarray, rotation: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, p = rotation
    return np.packbits((x - mean) @ p >= 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)


def retrieved(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether the tables of one rotation bring codes together, as close_pairs() does; equal ones are a cell."""
    d = (a ^ b).view(np.uint64)
    near = np.zeros(d.shape, bool)
    for low, width in cut(SEGMENTS, BITS):
        near |= np.bitwise_count((d >> np.uint64(low)) & np.uint64((1 << width) - 1)) <= 1
    return near & (np.bitwise_count(d) <= radius)


def _some_links(some: np.ndarray, x: np.ndarray, least: float, draw, most: int = 100_000, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the links between some, which are x's first, and x: all, or `most` drawn from all of them.

    A few rows' cosines are held at a time: first to count the links, and then to take those that were drawn."""

    def linked(at: int) -> np.ndarray:
        s = some[at : at + rows] @ x.T >= least
        s[np.arange(len(s)), at + np.arange(len(s))] = False
        return s

    total = sum(int(linked(at).sum()) for at in range(0, len(some), rows))
    wanted = np.arange(total) if total <= most else np.unique(draw.integers(total, size=most))
    i, j, seen = [], [], 0
    for at in range(0, len(some), rows):
        a, b = np.nonzero(linked(at))
        own = wanted[np.searchsorted(wanted, seen) : np.searchsorted(wanted, seen + len(a))] - seen
        i.append(at + a[own])
        j.append(b[own])
        seen += len(a)
    return np.concatenate(i or [np.zeros(0, int)]), np.concatenate(j or [np.zeros(0, int)])


def learn_tables(x: np.ndarray, least: float) -> tuple[list, int]:
    """(rotations, radius) that retrieve enough of the links between MEASURED vectors of the sample x and all of
    it, and of pairs made of them at the threshold, half of them turned at random and half towards others."""
    draw = np.random.default_rng(9)
    some = x[:MEASURED]
    i, j = _some_links(some, x, least, draw)
    to = np.where((np.arange(len(some)) % 2 == 0)[:, None], draw.normal(size=some.shape), x[draw.integers(len(x), size=len(some))])
    away = to - (to * some).sum(axis=1)[:, None] * some
    size = np.sqrt((away * away).sum(axis=1))
    turned = some[size > 1e-9] * least + (away / np.maximum(size, 1e-9)[:, None])[size > 1e-9] * np.sqrt(1 - least * least)
    pairs = [(x[i], x[j], RECALL), (some[size > 1e-9], turned, RECALL_AT_THRESHOLD)]
    pairs = [p for p in pairs if len(p[0]) >= 50]
    rotations, radius = [], RADIUS
    hit = [np.zeros(len(p[0]), bool) for p in pairs]
    while len(rotations) < MOST_ROTATIONS:
        rotation = learn_rotation(x, seed=5 + len(rotations))
        rotations.append(rotation)
        both = [(codes(a, rotation), codes(b, rotation)) for a, b, _ in pairs]
        if len(rotations) == 1:
            far = [np.quantile(np.bitwise_count((a ^ b).view(np.uint64)), 0.995) for a, b in both]
            radius = int(min(WIDEST, max([RADIUS, *far])))
        for h, (a, b) in zip(hit, both):
            h |= retrieved(a, b, radius)
        if all(h.mean() >= p[2] for h, p in zip(hit, pairs)):
            break
    return rotations, radius


def _links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> np.ndarray:
    s = a @ b.T >= least
    return np.triu(s, 1) if same else s


def _spans(s: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row number, root number) over the stacked vectors of both sides that join what s links."""
    na, nb = s.shape
    if same:
        adj = s | s.T
        label = np.arange(na)
        while True:
            low = np.minimum(label, np.where(adj, label[None, :], na).min(axis=1, initial=na))
            low = low[low]
            if (low == label).all():
                break
            label = low
        touched = np.flatnonzero(adj.any(axis=1))
    else:
        label = np.arange(na + nb)
        while True:
            low = label.copy()
            low[:na] = np.minimum(low[:na], np.where(s, label[None, na:], na + nb).min(axis=1, initial=na + nb))
            low[na:] = np.minimum(low[na:], np.where(s, low[:na, None], na + nb).min(axis=0, initial=na + nb))
            low = low[low]
            if (low == label).all():
                break
            label = low
        touched = np.concatenate((np.flatnonzero(s.any(axis=1)), na + np.flatnonzero(s.any(axis=0))))
    touched = touched[label[touched] != touched]
    return touched, label[touched]


def _cells(coded: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(code) and (code, block, rows) of rotation k.  Only a cell of over BLOCK vectors needs to be told how many
    blocks it has, so no cell's vectors have to come together to be dealt."""
    cells = coded.withColumn("code", F.col("codes")[k])
    sizes = written(cells.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    large = sizes.filter("blocks > 1")
    few = large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    placed = cells.join(F.broadcast(large) if few else large, "code", "left").withColumn("block", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
    packed = placed.repartition("code", "block").groupBy("code", "block").agg(F.collect_list(F.struct("rep", "n", "raw", "codes")).alias("rows"))
    return sizes.select("code"), written(packed)


def _first_by_hash(vectors: DataFrame, rows: int, sample: int) -> DataFrame:
    """The first `sample` of so many rows in the order of a hash of vec_id.

    Rows above twice the hash that should bound them are left out before the sort, so that not every task sends `sample`
    rows to the one that merges them; where ids repeat so much that too few are below it, all are sorted."""
    hashed = vectors.withColumn("_h", F.xxhash64("vec_id"))
    if rows > 4 * sample:
        below = hashed.filter(F.col("_h") < -(2**63) + int(2**64 * (2 * sample / rows)))
        if below.count() >= sample:
            hashed = below
    return hashed.orderBy("_h", "vec_id").limit(sample).drop("_h")


def _of_width(whole: DataFrame, width: int, rows: int, least: float, sample: int) -> DataFrame:
    """(embedding, links, comp) of the different usable vectors of that length, which so many rows have."""
    spark = whole.sparkSession
    distinct = whole.filter(F.size("embedding") == width).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    few = _first_by_hash(whole.filter(F.size("embedding") == width), rows, sample).select("embedding").toArrow()
    taught = [normalised(parts_of(b.column(0), width)) for b in few.to_batches() if b.num_rows]
    taught = np.concatenate([x[ok] for x, ok in taught])
    rotations, radius = learn_tables(taught, least) if len(taught) else ([learn_rotation(np.eye(width))], RADIUS)
    tables = spark.sparkContext.broadcast(rotations)
    kind = np.dtype("<f4" if dict(whole.dtypes)["embedding"] == "array<float>" else "<f8")

    def code(batch: pa.RecordBatch) -> dict:
        raw = parts_of(batch.column(2), width)
        x, ok = normalised(raw)
        own = np.stack([codes(x, r) for r in tables.value], axis=1) if len(x) else np.zeros((0, len(tables.value)), np.int64)
        use = pa.array(ok)
        return {"rep": batch.column(0).filter(use), "n": batch.column(1).filter(use), "codes": list(own[ok]), "raw": [v.tobytes() for v in raw[ok].astype(kind)]}

    coded = written(map_rows(distinct, ["rep", "n", "embedding"], code, "rep long, n long, codes array<long>, raw binary"))

    def unpack(rows):
        x = np.frombuffer(b"".join([r["raw"] for r in rows]), kind).reshape(-1, width)
        return np.array([r["rep"] for r in rows]), np.array([r["n"] for r in rows]), normalised(x)[0], np.array([r["codes"] for r in rows], np.int64)

    def rerank(k: int):
        def kernel(batch: pa.RecordBatch) -> dict:
            ids, counts, roots = [], [], []
            for i in range(batch.num_rows):
                same = bool(batch.column(2)[i].as_py())
                ia, na, xa, ca = unpack(batch.column(0)[i].as_py())
                ib, nb, xb, cb = (ia, na, xa, ca) if same else unpack(batch.column(1)[i].as_py())
                s = _links(xa, xb, least, same)
                for t in range(k):  # an earlier rotation's tables have had these
                    s &= ~retrieved(ca[:, t][:, None], cb[:, t][None, :], radius)
                own = (s @ nb, s.T @ na)
                who, root = _spans(s, same)
                both = ia if same else np.concatenate((ia, ib))
                ids += [ia, ib, both[who]]
                counts += [own[0], own[1], np.zeros(len(who), np.int64)]
                roots += [ia, ib, both[root]]
            flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            a, c, r = flat(ids), flat(counts), flat(roots)
            use = (c > 0) | (a != r)
            return {"a": a[use], "b": r[use], "links": c[use]}

        return kernel

    found: DataFrame | None = None
    for k in range(len(rotations)):
        different, packed = _cells(coded, k)
        pairs = close_pairs(different.withColumnRenamed("code", "fp"), radius, SEGMENTS).select(F.col("a").alias("ca"), F.col("b").alias("cb"))
        pairs = pairs.unionAll(different.select(F.col("code").alias("ca"), F.col("code").alias("cb")))
        side = lambda c, b, r: packed.select(F.col("code").alias(c), F.col("block").alias(b), F.col("rows").alias(r))  # noqa: E731, B023
        tasks = pairs.join(side("ca", "ka", "ra"), "ca").join(side("cb", "kb", "rb"), "cb").filter("ca <> cb or ka <= kb")
        tasks = tasks.select("ra", "rb", ((F.col("ca") == F.col("cb")) & (F.col("ka") == F.col("kb"))).alias("same"))
        own = written(map_rows(tasks, ["ra", "rb", "same"], rerank(k), "a long, b long, links long"))
        found = own if found is None else found.unionAll(own)
    counted = found.groupBy("a").agg(F.sum("links").alias("other"))
    groups = components(found.filter("a <> b"))
    return (
        distinct.join(coded.select("rep"), "rep")
        .join(counted, F.col("rep") == F.col("a"), "left")
        .join(groups, F.col("rep") == F.col("id"), "left")
        .select("embedding", (F.coalesce("other", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    )


def near_vectors(vectors: DataFrame, least: float = 0.95, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    Equal vectors are one class before anything is compared and count as links of each other.  Vectors
    that are null, empty, zero, or hold null or non-finite parts link with nothing.  Vectors of different lengths don't
    link; each length is compared for itself.  vec_id names rows and is taken as unique; an empty table gives no rows.
    """
    whole = vectors.select("vec_id", "embedding")
    lengths = whole.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).collect()
    out: DataFrame | None = None
    for r in lengths:
        own = _of_width(whole, r["width"], r["count"], least, sample)
        out = own if out is None else out.unionAll(own)
    if out is None:
        return whole.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = whole.join(out, "embedding", "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), (comp == F.col("vec_id")).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector, as near_vectors() has them."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
