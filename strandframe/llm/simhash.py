"""SimHash near-dedup with deletion-variant signatures.

Fingerprints at most `distance` bits apart agree, up to one bit, in at least one of
distance // 2 + 1 segments: if every segment differed in two bits or more, the total would be above
`distance`.  A segment's one-wildcard variants (one bit blanked, its place named) are the index keys, so
an equality join finds every such pair, and the join's condition verifies the whole fingerprint.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, components, documents, map_rows, written
from .hamming import close_pairs
from .neardup import SHINGLE, SIMILARITY, near_copies

SEED = 42
#: Bytes of text, and hashes, that are held at a time.
_PART, _HASHES = 1 << 20, 1 << 14
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: bytes):
    """A text in parts of about _PART bytes that end between words."""
    at = 0
    while len(text) - at > 2 * _PART:
        m = _SPACE.search(text, at + _PART)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def bit_counts(text: bytes, shingle: int) -> tuple[np.ndarray, int]:
    """(how many shingles' hashes have each bit, highest first; how many shingles); a long text goes by parts."""
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), 0
    carry: list[bytes] = []
    for part in _parts(text):
        words = carry + part.lower().split()
        carry = words[max(0, len(words) - shingle + 1) :]
        if len(words) < shingle:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist())
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)
        for at in range(0, len(h), _HASHES):
            ones += np.unpackbits(h[at : at + _HASHES].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    if not n and carry:
        ones += np.unpackbits(np.array([digest(b" ".join(carry), SEED)], ">u8").view(np.uint8))
        n = 1
    return ones, n


def fingerprint(text: bytes, shingle: int) -> int:
    """The text's SimHash as a signed number: a bit is 1 if set in over half of the shingles' hashes."""
    ones, n = bit_counts(text, shingle)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long): a bit is 1 if set in over half of the word shingles' XXH64.

    A-Z is lower-cased; words are runs without ASCII white space; a text of fewer words is one shingle;
    null and wordless texts have fingerprint zero.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": np.array([fingerprint(text, shingle) for text in bytes_of(batch)], np.int64)}

    return map_rows(docs, ["doc_id", "text"], kernel, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked directly or through others share a component.

    Rows of one fingerprint, repeated rows among them, are one class before the index is built, so a
    group of copies adds one fingerprint however large it is.  An empty table gives no rows.
    A null doc_id is in a component of its own fingerprint but never names it.
    """
    fps = written(fingerprints(docs, shingle))
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    pairs = close_pairs(first.select("fp"), distance, distance // 2 + 1)
    a, b = first.select(F.col("fp").alias("a"), F.col("first_doc").alias("da")), first.select(F.col("fp").alias("b"), F.col("first_doc").alias("db"))
    links = pairs.join(a, "a").join(b, "b").select("da", "db").filter("da is not null and db is not null")
    found = components(links, "da", "db")
    classes = first.join(found, F.col("first_doc") == F.col("id"), "left").select("fp", F.coalesce("component", "first_doc").alias("component_id"))
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, distance: int = 4) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id.

    Links are near_copies(): pairs of close fingerprints, verified on the whole sets of shingles.  Fingerprints 4 bits
    apart find few of the pairs at that similarity, so bands of min-hashes add those that they leave.
    Rows that share a doc_id are one document and one of them stays; rows without a doc_id all stay.
    """
    groups = near_copies(docs, fingerprint, distance, shingle, similarity)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct().withColumn("_stays", F.lit(True))
    x = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id")).join(kept, "_id", "left").filter("_stays or _id is null")
    one = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_row.text")))
    return x.withColumn("_nth", F.when(F.col("_id").isNull(), 1).otherwise(one)).filter("_nth = 1").select("_row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document, as near_duplicates() has them."""
    return near_duplicates(documents(spark, sf_dir))
