"""Exact substring dedup by merging Burrows-Wheeler transforms of text shards.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id.

Equal 50-byte strings ("windows") must meet without any task seeing all text.  A window's key is its
minimiser, the smallest hash of the 20-byte strings inside it; a document's windows of one key in a row
are one segment.  Keys that only one document has are dropped first.  The segments of the others are
dealt by key; each reducer cuts its segments into shards, builds a BWT for every shard and merges them by
interleave refinement: the merged order by h symbols turns into that by h + 1 symbols by stepping every
entry through its shard's LF mapping and sorting stably by the BWT symbol.  A border that first appears
in round h + 1 is a common prefix of length h, so after 50 rounds the intervals left without a border
are the repeated windows, with no suffix compared again.  An interval's smallest doc_id decides.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import bytes_of, documents, free_shuffles, map_rows, written
from .wordhash import Powers, mix, xxhash_long

LENGTH = 50
MINIMISER = 20
#: A segment's most windows: their flags fit one 32-bit mask.
MOST_WINDOWS = 32
#: Bytes of text that one group of documents, and of segments that one reducer, holds, about.
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 6 << 20
#: Bytes of one shard's text.
SHARD_BYTES = 1 << 19
#: Keys with more documents than this are dealt by whole windows instead: a passage that many documents
#: share has as many segments at its ends.  Keys above the bound are at most rows / bound in number.
HOT_DOCUMENTS, HOT_KEYS = 4096, 100_000
_SLICE = 1 << 18
_NO_DOC = 2**63 - 1
_VALUES = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Segments:
    """The segments of some texts: owner (text), start, windows, key, and a hash of the bytes."""

    def load(self, data: np.ndarray) -> None:
        self.data = data
        up, self.down = Powers.of(len(data) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[data] * up[: len(data)], out=self.prefix[1:])

    def __init__(self, texts: list[bytes]):
        self.load(np.frombuffer(b"".join(texts), np.uint8))
        n = len(self.data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.cumsum(sizes) - sizes
        if n < LENGTH:
            z = np.zeros(0, np.int64)
            self.owner, self.start, self.windows, self.key = z, z, z, np.zeros(0, np.uint64)
            return
        with np.errstate(over="ignore"):
            m = mix((self.prefix[MINIMISER:] - self.prefix[:-MINIMISER]) * self.down[: n - MINIMISER + 1])
        w, most = 1, LENGTH - MINIMISER + 1
        while 2 * w <= most:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < most:
            m = np.minimum(m[: -(most - w)], m[most - w :])
        last = np.zeros(n + 1, np.int64)
        np.add.at(last, self.text_starts[sizes > 0], 1)
        owner_of = np.flatnonzero(sizes > 0)[np.cumsum(last[: len(m)]) - 1]
        inside = np.arange(len(m)) + LENGTH <= (self.text_starts + sizes)[owner_of]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | (owner_of[1:] != owner_of[:-1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        windows = np.diff(np.append(start, len(m)))
        use = inside[start]
        start, windows = start[use], windows[use]
        if len(windows) and windows.max() > MOST_WINDOWS:  # the same key again and again, as in a run of one letter
            parts = -(-windows // MOST_WINDOWS)
            first = np.repeat(start, parts)
            k = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, windows = first + k * MOST_WINDOWS, np.minimum(np.repeat(windows, parts) - k * MOST_WINDOWS, MOST_WINDOWS)
        self.owner, self.start, self.windows, self.key = owner_of[start], start, windows, m[start]

    def take(self, keep: np.ndarray) -> None:
        self.owner, self.start, self.windows, self.key = self.owner[keep], self.start[keep], self.windows[keep], self.key[keep]

    def split(self, hot: np.ndarray) -> None:
        """Cut segments of hot keys into single windows, which get their own bytes' hash as key."""
        if not len(hot) or not len(self.key):
            return
        is_hot = _member(self.key, hot)
        if not is_hot.any():
            return
        o, s, w = self.owner[is_hot], self.start[is_hot], self.windows[is_hot]
        start = np.repeat(s, w) + np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        one = np.ones(len(start), np.int64)
        rest = ~is_hot
        self.owner = np.concatenate((self.owner[rest], np.repeat(o, w)))
        self.start, self.windows = np.concatenate((self.start[rest], start)), np.concatenate((self.windows[rest], one))
        self.key = np.concatenate((self.key[rest], self._hash(start, one)))

    def _hash(self, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        end = start + windows + LENGTH - 1
        with np.errstate(over="ignore"):
            return mix(mix((self.prefix[end] - self.prefix[start]) * self.down[start]) + windows.astype(np.uint64))

    def content(self) -> np.ndarray:
        return self._hash(self.start, self.windows)


def _different(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each different (key, content) the row of the smallest doc."""
    order = np.lexsort((doc, content, key))
    k, c = key[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order[new]


def _contents(body: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Segments.content() of segments that stand one after another in body, a cache's worth at a time."""
    ends = np.cumsum(length)
    out = np.zeros(len(length), np.uint64)
    at = 0
    while at < len(length):
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + _SLICE, side="right")))
        x = Segments.__new__(Segments)
        x.load(body[base : int(ends[to - 1])])
        out[at:to] = x._hash(ends[at:to] - length[at:to] - base, length[at:to] - LENGTH + 1)
        at = to
    return out


def _member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _ranges(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)] if total else pool[:0]


def _slices(texts: list[bytes]):
    """(pieces, owners, offset, last): the texts in slices of about _SLICE bytes.

    owners are the pieces' text numbers.  A long text is cut into pieces that overlap by all but one byte of a window, a
    slice each, which begin at offset in the text, and last says that no more follow; each of its windows is whole in
    one piece only."""
    own: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > 2 * _SLICE:
            if own:
                yield [texts[k] for k in own], np.array(own), 0, True
                own, size = [], 0
            for at in range(0, len(t), _SLICE):
                yield [t[at : at + _SLICE + LENGTH - 1]], np.array([i]), at, at + _SLICE >= len(t)
            continue
        own.append(i)
        size += len(t)
        if size >= _SLICE:
            yield [texts[k] for k in own], np.array(own), 0, True
            own, size = [], 0
    if own:
        yield [texts[k] for k in own], np.array(own), 0, True


# ---- Burrows-Wheeler transforms ----------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Cyclic suffixes of a text of bytes in order, by prefix doubling from eight symbols."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    ring = np.concatenate((text, text[np.arange(8) % n]))
    for k in range(8):
        key = (key << np.uint64(8)) | ring[k : k + n]
    h = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
        if h >= n or rank[order[-1]] == n - 1:
            return order
        key = (rank.astype(np.uint64) << np.uint64(32)) | np.roll(rank, -(h % n)).astype(np.uint64)
        h *= 2


def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols before the ordered suffixes, LF mapping, suffix starts) of one shard."""
    order = suffix_order(text)
    rank = np.empty(len(text), np.int32)
    rank[order] = np.arange(len(text), dtype=np.int32)
    return text[order - 1], rank[order - 1], order


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries, interval, common): entries of all shards whose first `depth` symbols stand twice or more.

    entries number the shards' rows one shard after another and come in merged order; interval numbers
    their groups.  common: how many entries got their border to the one before at each prefix length, the
    histogram of common prefixes.  An entry alone in its interval is dropped at once: a longer string
    that ends in a unique one is unique.
    """
    sizes = [len(b) for b, _, _ in shards]
    offsets = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    symbol = np.concatenate([b for b, _, _ in shards])
    step = np.concatenate([lf.astype(np.int64) + o for (_, lf, _), o in zip(shards, offsets)])
    place = np.arange(len(symbol))
    block = np.zeros(len(symbol), np.int64)
    common = np.zeros(depth, np.int64)
    for h in range(depth):
        s = symbol[place]
        order = np.argsort(s, kind="stable")
        s, was = s[order], block[order]
        border = np.ones(len(s) + 1, bool)
        border[1:-1] = (s[1:] != s[:-1]) | (was[1:] != was[:-1])
        common[h] = border[:-1].sum()
        twice = ~(border[:-1] & border[1:])
        place = step[place[order[twice]]]
        block = np.cumsum(border[:-1])[twice]
        if not len(place):
            break
    return place, block, common


def smallest_documents(contents: list[np.ndarray], docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For the windows of all contents, one content after another: the smallest doc of a content that has
    the same 50 bytes anywhere among its windows.  contents: their bytes; docs: their smallest doc."""
    ends = np.cumsum(windows)
    out = np.repeat(docs, windows)
    shards, at, size = [], 0, 0
    owners, places = [], []
    lengths = np.fromiter(map(len, contents), np.int64, len(contents))

    def shard(a: int, b: int) -> None:
        flat = np.concatenate([x for c in contents[a:b] for x in (c + np.uint8(1), np.zeros(1, np.uint8))])  # UTF-8 has no byte 255
        shards.append(transform(flat))
        owner = np.repeat(np.arange(a, b), lengths[a:b] + 1)
        begin = np.cumsum(lengths[a:b] + 1) - (lengths[a:b] + 1)
        order = shards[-1][2]
        owners.append(owner[order])
        places.append(order - np.repeat(begin, lengths[a:b] + 1)[order])

    for i in range(len(contents)):
        size += lengths[i] + 1
        if size >= SHARD_BYTES or i + 1 == len(contents):
            shard(at, i + 1)
            at, size = i + 1, 0
    entries, block, _ = merge(shards, LENGTH)
    owner, place = np.concatenate(owners)[entries], np.concatenate(places)[entries]
    real = place < windows[owner]
    owner, place, block = owner[real], place[real], block[real]
    if len(owner):
        order = np.argsort(block, kind="stable")
        owner, place, block = owner[order], place[order], block[order]
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        low = np.minimum.reduceat(docs[owner], at)
        out[(ends - windows)[owner] + place] = np.repeat(low, np.diff(np.append(at, len(block))))
    return out


# ---- The distributed phases ---------------------------------------------------------------------------

_ASK = np.dtype([("key", "<u8"), ("doc", "<i8")])
_TOLD = np.dtype([("doc", "<i8"), ("key", "<u8")])
#: What travels with a segment's bytes.  Half a key will do: keys that fall together are judged together.
_SEG = np.dtype([("key", "<u4"), ("doc", "<i8"), ("windows", "u1"), ("group", "<u4")])
_FLAG = np.dtype([("content", "<u8"), ("mask", "<u4")])


def _doc_ids(column) -> np.ndarray:
    return np.array([_NO_DOC if x is None else x for x in column.to_pylist()], np.int64)


def _grouped(part: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[bytes]]:
    """rows packed by their part."""
    if not len(rows):
        return [], []
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return part[np.concatenate(([0], cuts))].tolist(), [x.tobytes() for x in np.split(rows, cuts)]


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return xxhash_long(doc) % groups


def shared_keys(docs: DataFrame, buckets: int, groups: int, hot_above: int) -> DataFrame:
    """(part, told, hot, n): packed (doc, key) pairs of keys that two documents or more have, by group of
    documents; the keys above hot_above; and how many pairs those are.

    A batch asks about a key once: if two of its documents have it, it is told already and only one row
    goes on, with the number of documents, so a passage in a third of the corpus costs a row a batch.
    """

    def ask(batch: pa.RecordBatch) -> dict:
        ids, texts = _doc_ids(batch.column(0)), bytes_of(batch)
        keys, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for pieces, owners, *_ in _slices(texts):
            x = Segments(pieces)
            keys.append(x.key), own.append(ids[owners[x.owner]])
        key, doc = np.concatenate(keys), np.concatenate(own)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        key, doc = key[new], doc[new]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(key)))
        one = np.zeros(len(at), _ASK)
        one["key"] = key[at]
        one["doc"] = np.where(count > 1, -count, doc[at])  # a negative doc: so many documents, all told
        told = np.zeros(int(count[count > 1].sum()), _TOLD)
        many = np.repeat(count > 1, count)
        told["doc"], told["key"] = doc[many], key[many]
        negative = (count == 1) & (doc[at] < 0)
        odd = np.zeros(int(negative.sum()), _TOLD)  # negative ids need their own way: they are told unasked
        odd["doc"], odd["key"] = doc[at][negative], key[at][negative]
        one["doc"][negative] = -1
        told = np.concatenate((told, odd))
        b_ask, ask_rows = _grouped((mix(one["key"]) % np.uint64(buckets)).astype(np.int64), one)
        b_told, told_rows = _grouped(_group_of(told["doc"], groups), told)
        return {
            "bucket": b_ask + [buckets + g for g in b_told], "part": [-1] * len(b_ask) + b_told,
            "rows": ask_rows + told_rows,
        }

    def answer(table: pa.Table) -> pa.Table:
        parts = np.array(table.column("part").to_pylist())
        raw = table.column("rows").to_pylist()
        out_part, out_rows, hot_rows, n = [], [], [], []
        for p, r in zip(parts.tolist(), raw):
            if p >= 0:
                out_part.append(p), out_rows.append(r), hot_rows.append(None), n.append(len(r) // 16)
        asked = np.frombuffer(b"".join(r for p, r in zip(parts.tolist(), raw) if p < 0), _ASK)
        if len(asked):
            asked = asked[np.argsort(asked["key"], kind="stable")]
            at = np.flatnonzero(np.concatenate(([True], asked["key"][1:] != asked["key"][:-1])))
            size = np.diff(np.append(at, len(asked)))
            single = asked["doc"] >= 0
            number = np.add.reduceat(np.where(single, 1, -asked["doc"]), at)
            low = np.minimum.reduceat(np.where(single, asked["doc"], -1), at)
            high = np.maximum.reduceat(asked["doc"], at)
            is_shared = (low < 0) | (low != high)
            use = np.repeat(is_shared, size) & single
            told = np.zeros(int(use.sum()), _TOLD)
            told["doc"], told["key"] = asked["doc"][use], asked["key"][use]
            p, r = _grouped(_group_of(told["doc"], groups), told)
            out_part += p
            out_rows += r
            hot_rows += [None] * len(p)
            n += [len(x) // 16 for x in r]
            hot = asked["key"][at][number > hot_above]
            if len(hot):
                out_part.append(-1), out_rows.append(None), hot_rows.append(hot.tobytes()), n.append(0)
        return pa.Table.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_rows, pa.binary()), pa.array(hot_rows, pa.binary()), pa.array(n, pa.int64())], names=["part", "told", "hot", "n"])

    asked = map_rows(docs, ["doc_id", "text"], ask, "bucket int, part int, rows binary")
    return asked.groupBy("bucket").applyInArrow(answer, "part int, told binary, hot binary, n long")


def _told_segments(texts: list[bytes], ids: np.ndarray, told: np.ndarray, hot: np.ndarray):
    """(owners, offset, last, Segments) per slice, of the segments whose key their document was told to be shared."""
    told = told[np.argsort(told["doc"], kind="stable")]
    for pieces, owners, offset, last in _slices(texts):
        x = Segments(pieces)
        if len(x.key):
            doc = ids[owners[x.owner]]
            some = np.unique(ids[owners])
            lo, hi = np.searchsorted(told["doc"], some), np.searchsorted(told["doc"], some, side="right")
            mine = told[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)]
            with np.errstate(over="ignore"):
                pair = lambda d, k: mix(mix(d.view(np.uint64)) + k)
                x.take(_member(pair(doc, x.key), np.sort(pair(np.ascontiguousarray(mine["doc"]), mine["key"]))))
            x.split(hot)
        yield owners, offset, last, x


def _told_of(right: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(right.column("told").to_pylist()), _TOLD)


def dealt_segments(grouped, told, buckets: int, hot) -> DataFrame:
    """(bucket, heads, bytes): the different segments of each group of documents, dealt by key."""

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        heads, bodies = [], []
        if left.num_rows and right.num_rows:
            ids = _doc_ids(left.column("doc_id"))
            texts = [t or b"" for t in left.column("text").cast(pa.binary()).to_pylist()]
            seen: list[np.ndarray] = []
            for owners, _, _, x in _told_segments(texts, ids, _told_of(right), hot.value):
                content, doc = x.content(), ids[owners[x.owner]]
                order = _different(x.key, content, doc)
                heads.append((x.key[order], content[order], doc[order], x.windows[order]))
                bodies.append(_ranges(x.data, x.start[order], x.windows[order] + LENGTH - 1))
        out: tuple[list, list, list] = ([], [], [])
        if heads and sum(len(h[0]) for h in heads):
            key, content, doc, windows = (np.concatenate(c) for c in zip(*heads))
            body = np.concatenate(bodies)
            length = windows + LENGTH - 1
            start = np.cumsum(length) - length
            order = _different(key, content, doc)
            bucket = (mix(key[order]) % np.uint64(buckets)).astype(np.int64)
            order = order[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            h = np.zeros(len(order), _SEG)
            h["key"], h["doc"], h["windows"] = (key[order] >> np.uint64(32)).astype(np.uint32), doc[order], windows[order]
            h["group"] = left.column("part")[0].as_py()
            squeeze = zstandard.ZstdCompressor(level=1)
            for rows in np.split(np.arange(len(order)), np.flatnonzero(np.diff(bucket)) + 1):
                own = order[rows]
                out[0].append(int(bucket[rows[0]])), out[1].append(h[rows].tobytes()), out[2].append(squeeze.compress(_ranges(body, start[own], length[own]).tobytes()))
        return pa.Table.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["bucket", "heads", "bytes"])

    return grouped.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(deal, "bucket int, heads binary, bytes binary")


def judged_segments(dealt: DataFrame) -> DataFrame:
    """(part, flags): per group of documents, masks of its segments' windows that start in a smaller document
    than the group's smallest with that segment."""

    def judge(table: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(table.column("heads").to_pylist()), _SEG)
        whole = zstandard.ZstdDecompressor()
        body = np.frombuffer(b"".join(map(whole.decompress, table.column("bytes").to_pylist())), np.uint8)
        length = h["windows"].astype(np.int64) + LENGTH - 1
        start = np.cumsum(length) - length
        content = _contents(body, length)
        order = np.lexsort((h["doc"], content, h["key"]))
        k, c = h["key"][order], content[order]
        new = np.ones(len(h), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        content_of = np.empty(len(h), np.int64)
        content_of[order] = np.cumsum(new) - 1
        first = order[at]  # of each content, the entry of the smallest document
        low = h["doc"][first]
        windows = h["windows"][first].astype(np.int64)
        key = h["key"][first]
        alone = np.ones(len(first), bool)
        if len(first) > 1:
            alone[1:] &= key[1:] != key[:-1]
            alone[:-1] &= key[1:] != key[:-1]
        least = np.repeat(low, windows)  # a key's only content: its windows stand nowhere else
        ends = np.cumsum(windows)
        many = np.flatnonzero(~alone)
        if len(many):
            found = smallest_documents([body[s : s + n] for s, n in zip(start[first[many]].tolist(), length[first[many]].tolist())], low[many], windows[many])
            least[_ranges(np.arange(len(least)), (ends - windows)[many], windows[many])] = found
        n = h["windows"].astype(np.int64)
        flat = _ranges(least, (ends - windows)[content_of], n)
        bit = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        value = np.where(flat < np.repeat(h["doc"], n), np.uint32(1) << bit.astype(np.uint32), np.uint32(0)).astype(np.uint32)
        mask = np.bitwise_or.reduceat(value, np.cumsum(n) - n) if len(n) else np.zeros(0, np.uint32)
        some = mask != 0
        out = np.zeros(int(some.sum()), _FLAG)
        out["content"], out["mask"] = content[some], mask[some]
        parts, rows = _grouped(h["group"][some].astype(np.int64), out)
        return pa.Table.from_arrays([pa.array(parts, pa.int32()), pa.array(rows, pa.binary())], names=["part", "flags"])

    return dealt.groupBy("bucket").applyInArrow(judge, "part int, flags binary")


def dedup_substrings(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) per row of docs.

    Texts are UTF-8 bytes, null is empty; texts under 50 bytes lose nothing.  Documents are judged on the
    input, so the smallest doc_id of a repeated string keeps it whole.  Rows that share a doc_id don't
    remove each other's strings; a null doc_id counts as larger than all.  An empty table gives no rows.
    kept are the bytes that stay, which may begin or end inside a character.
    """
    spark = docs.sparkSession
    ship_package(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    groups = max(1, math.ceil(total / GROUP_BYTES))
    rows = total * 2 // (LENGTH - MINIMISER + 2)
    narrow = docs.select("doc_id", "text")
    keys = written(shared_keys(narrow, max(1, math.ceil(rows / 600_000)), groups, max(HOT_DOCUMENTS, rows // HOT_KEYS)))
    free_shuffles(spark)
    n = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [np.frombuffer(r["hot"], np.uint64) for r in keys.filter("hot is not null").select("hot").collect()]
    hot = spark.sparkContext.broadcast(np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.uint64))
    deal = lambda df: df.repartition(2 * groups, "part")  # noqa: E731  so that partitions follow the groups
    told = deal(keys.filter("told is not null").select("part", "told"))
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_NO_DOC))), F.lit(groups)).cast("int")  # as _group_of() has it
    grouped = deal(narrow.select(part.alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text"))
    buckets = max(1, math.ceil(n * (LENGTH + 16) / BUCKET_BYTES))
    flags = written(judged_segments(dealt_segments(grouped, told, buckets, hot)))
    free_shuffles(spark)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        ids = _doc_ids(left.column("doc_id")) if left.num_rows else np.zeros(0, np.int64)
        texts = [t or b"" for t in left.column("text").cast(pa.binary()).to_pylist()] if left.num_rows else []
        rows = right.column("rows").to_pylist()
        is_told = right.column("is_told").to_pylist()
        keys = np.frombuffer(b"".join(r for r, k in zip(rows, is_told) if k), _TOLD)
        flag = np.frombuffer(b"".join(r for r, k in zip(rows, is_told) if not k), _FLAG)
        flag = flag[np.argsort(flag["content"], kind="stable")]
        slices, contents, own = [], [], []
        for owners, offset, last, x in _told_segments(texts, ids, keys, hot.value):
            slices.append((owners, offset, last, x))
            contents.append(x.content() if len(x.key) else np.zeros(0, np.uint64))
            own.append(ids[owners[x.owner]])
            x.prefix = x.key = x.owner = None  # as large as many texts
        every = np.concatenate(contents) if contents else np.zeros(0, np.uint64)
        names, inverse = np.unique(every, return_inverse=True)
        low = np.full(len(names), _NO_DOC)
        if len(every):
            np.minimum.at(low, inverse, np.concatenate(own))
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        part_of_long: dict[int, np.ndarray] = {}
        for (owners, offset, last, x), content, doc in zip(slices, contents, own):
            n = len(x.data)
            cover = np.zeros(n + 1, np.int32)
            if len(content):
                smallest = low[np.searchsorted(names, content)]
                full = doc > smallest
                np.add.at(cover, x.start[full], 1)
                np.add.at(cover, (x.start + x.windows + LENGTH - 1)[full], -1)
                part = np.flatnonzero(~full)
                at = np.minimum(np.searchsorted(flag["content"], content[part]), max(0, len(flag) - 1))
                if len(flag):
                    hit = flag["content"][at] == content[part]
                    part, mask = part[hit], flag["mask"][at[hit]]
                    for bit in range(MOST_WINDOWS):
                        on = part[(mask >> np.uint32(bit)) & np.uint32(1) == 1]
                        np.add.at(cover, x.start[on] + bit, 1)
                        np.add.at(cover, x.start[on] + bit + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            bounds = np.append(x.text_starts, n)
            for k, i in enumerate(owners.tolist()):
                g, d = gone[bounds[k] : bounds[k + 1]], x.data[bounds[k] : bounds[k + 1]]
                if len(g) < len(texts[i]):
                    whole = part_of_long.setdefault(i, np.zeros(len(texts[i]), bool))
                    whole[offset : offset + n] |= g
                    if not last:
                        continue
                    g, d = part_of_long.pop(i), np.frombuffer(texts[i], np.uint8)
                removed = int(np.count_nonzero(g))
                kept = d[~g].tobytes() if removed else d.tobytes()
                out["n_bytes"].append(len(d))
                out["n_removed"].append(removed)
                out["n_spans"].append(int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1])) if removed else 0)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if with_bytes else None)
        arrays = [left.column("doc_id").cast(pa.int64()), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string())]
        names_out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            arrays.append(pa.array(out["kept"], pa.binary()))
            names_out.append("kept")
        return pa.Table.from_arrays(arrays, names=names_out)

    both = keys.filter("told is not null").select("part", F.col("told").alias("rows"), F.lit(True).alias("is_told"))
    notes = deal(both.unionAll(flags.select("part", F.col("flags").alias("rows"), F.lit(False).alias("is_told"))))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return grouped.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document, as dedup_substrings() has them."""
    return dedup_substrings(documents(spark, sf_dir), with_bytes=False)
