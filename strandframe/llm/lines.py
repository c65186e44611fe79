"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Words are ordered by rarity; two lines of Jaccard similarity t or more
share a word in their prefixes of n - ceil(t * n) + 1 rarest words.  Candidates from prefix words pass
length, positional and bitmap filters, Jaccard is verified on the whole sets, and a line goes if an
earlier line of the corpus matches it.  Lines of equal sets are one class before the join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import bytes_of, documents, free_shuffles, give_back, map_rows, written
from .wordhash import mix, words

SIMILARITY = 0.8
#: Rarity comes from a table of word counts of this fixed size, so what is broadcast never grows.  Words
#: that share a counter count together; any fixed order of words gives the same matches.
COUNTERS = 1 << 18
_HASH_BITS = 42
#: Bytes of text tokenised at a time: what stays in a core's cache.
_SLICE = 1 << 18
#: Rows of the prefix index that one reducer holds at a time, about.
BUCKET_ROWS = 150_000
_NO_DOC = 2**63 - 1


def _slices(texts: list[bytes]):
    """Index ranges of texts of about _SLICE bytes, whole texts only."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Lines:
    """The lines with words of some texts: which text, which line, and the lines' sets of words."""

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, _, h = words(data)
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, starts)  # numbered through all texts
        token = h >> np.uint64(64 - _HASH_BITS)
        if rarity is not None:
            token |= rarity[_counter(token)].astype(np.uint64) << np.uint64(_HASH_BITS)
        order = np.lexsort((token, line)) if len(breaks) > 60_000 else None
        if order is None:  # line number and token fit one word when sorted apart from each other's bits
            first = np.argsort(token, kind="stable")
            order = first[np.argsort(line[first].astype(np.uint16), kind="stable")]
        line, token = line[order], token[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
        line, self.tokens = line[new], token[new]
        at = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.starts = at
        self.sizes = np.diff(np.concatenate((at, [len(line)])))
        text_ends = np.cumsum([t.count(b"\n") + 1 for t in texts])
        self.text = np.searchsorted(text_ends, line[at], side="right")
        self.number = line[at] - np.concatenate(([0], text_ends))[self.text]
        with np.errstate(over="ignore"):
            self.keys = np.add.reduceat(mix(self.tokens & np.uint64((1 << _HASH_BITS) - 1)), at).view(np.int64) if len(at) else np.zeros(0, np.int64)

    def bitmaps(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits per line, of which each word sets one."""
        out = []
        for k in range(2):
            bit = np.where(((self.tokens >> np.uint64(6)) & np.uint64(1)) == k, np.uint64(1) << (self.tokens & np.uint64(63)), np.uint64(0))
            out.append(np.bitwise_or.reduceat(bit, self.starts).view(np.int64) if len(self.starts) else np.zeros(0, np.int64))
        return out[0], out[1]


def _need(size: np.ndarray, t: float) -> np.ndarray:
    return np.ceil(t * size - 1e-9).astype(np.int64)


def prefix_lengths(sizes: np.ndarray, t: float) -> np.ndarray:
    return sizes - _need(sizes, t) + 1


def table_parts(table: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.split(table, 16)]


def summed_table(parts: DataFrame) -> np.ndarray:
    """The sum of tables of COUNTERS numbers that arrive in 16 parts (part, counts); its size never grows."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(v.as_buffer(), np.int64)
                total[part] = total[part] + x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    table = np.zeros((16, COUNTERS // 16), np.int64)
    local = parts.mapInArrow(add, "part int, counts binary")
    for r in local.repartition(16, "part").mapInArrow(add, "part int, counts binary").collect():
        table[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return table.ravel()


#: Flags of a set of keys, words or places that is sent to all tasks: of fixed size, so it never grows.  What
#: shares a flag with a member passes too, which costs work but changes nothing.
FLAGS = 1 << 23


def _flag(x: np.ndarray) -> np.ndarray:
    return (mix(x.view(np.uint64)) >> np.uint64(41)).astype(np.int64)


class Flags:
    """A set of flags, packed."""

    def __init__(self, packed: np.ndarray | None = None):
        self.packed = np.zeros(FLAGS // 8, np.uint8) if packed is None else packed

    def add(self, x: np.ndarray) -> None:
        at = np.unique(_flag(x))
        np.bitwise_or.at(self.packed, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))

    def has(self, x: np.ndarray) -> np.ndarray:
        at = _flag(x)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def united(df: DataFrame, columns: list[str], members) -> list[Flags]:
    """The flags of members(record batch), a list of arrays of 64-bit numbers, over all rows of df[columns]; a task
    hands on one table of each, in parts that are united apart."""
    ship_package(df.sparkSession)

    def collect(batches):
        give_back()
        own: list[Flags] = []
        for batch in batches:
            for i, x in enumerate(members(batch)):
                if i == len(own):
                    own.append(Flags())
                own[i].add(x)
        parts = [(16 * i + k, x.tobytes()) for i, f in enumerate(own) for k, x in enumerate(np.split(f.packed, 16))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "flags"])

    def unite(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(v.as_buffer(), np.uint8)
                total[part] = total[part] | x if part in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "flags"])

    schema = "part int, flags binary"
    rows = df.select(*columns).mapInArrow(collect, schema).repartition(16, "part").mapInArrow(unite, schema).collect()
    by_part = {r["part"]: np.frombuffer(r["flags"], np.uint8) for r in rows}
    n = max(by_part, default=-1) // 16 + 1
    return [Flags(np.concatenate([by_part[16 * i + k] for k in range(16)])) for i in range(n)]


def longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def open_flags(still: DataFrame) -> Flags:
    """Flags of the keys of still(set_key); the classes needn't be joined to know which are open."""
    found = united(still, ["set_key"], lambda b: [longs(b.column(0))])
    return found[0] if found else Flags()


def words_of_open(classes: DataFrame, is_open: Flags) -> Flags:
    """Flags of the prefix words of open classes: in a later round the index holds no others."""
    shared = classes.sparkSession.sparkContext.broadcast(is_open)

    def members(batch: pa.RecordBatch) -> list[np.ndarray]:
        use = shared.value.has(longs(batch.column(0)))
        return [np.frombuffer(b"".join(p for p, k in zip(batch.column(1).to_pylist(), use) if k), np.uint64)]

    found = united(classes, ["set_key", "prefix"], members)
    return found[0] if found else Flags()


def _counter(tokens: np.ndarray) -> np.ndarray:
    return ((tokens >> np.uint64(_HASH_BITS - 18)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def count_words(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The rarity class of each counter (halves of its binary logarithm) and (doc_id, n_lines) of lines with words."""

    def kernel(batch: pa.RecordBatch) -> dict:
        ids = batch.column(0).to_pylist()
        texts = bytes_of(batch)
        total = np.zeros(COUNTERS, np.int64)
        lines = np.zeros(len(texts), np.int64)
        for a, b in _slices(texts):
            data = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
            starts, _, h = words(data)
            total += np.bincount(_counter(h >> np.uint64(64 - _HASH_BITS)), minlength=COUNTERS)
            line = np.searchsorted(np.flatnonzero(data == 10), starts)
            line = line[np.concatenate(([True], line[1:] != line[:-1]))] if len(line) else line
            text_ends = np.cumsum([t.count(b"\n") + 1 for t in texts[a:b]])
            lines[a:b] = np.bincount(np.searchsorted(text_ends, line, side="right"), minlength=b - a)
        return {"doc_id": ids + [None] * 16, "n_lines": lines.tolist() + [0] * 16, "part": [None] * len(ids) + list(range(16)), "counts": [None] * len(ids) + table_parts(total)}

    seen = written(map_rows(docs, ["doc_id", "text"], kernel, "doc_id long, n_lines long, part int, counts binary"))

    table = summed_table(seen.filter("part is not null").select("part", "counts"))
    rarity = np.minimum(np.floor(2 * np.log2(np.maximum(table, 1))), 63).astype(np.uint8)
    return rarity, seen.filter("part is null").select("doc_id", "n_lines")


CLASS = "set_key long, doc long, line int, n int, b0 long, b1 long, prefix binary"


def line_classes(docs: DataFrame, rarity: np.ndarray, t: float) -> DataFrame:
    """One row per different set of words: its first line, size, bitmap and prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def kernel(batch: pa.RecordBatch) -> dict:
        ids = np.array([_NO_DOC if i is None else i for i in batch.column(0).to_pylist()], np.int64)
        texts = bytes_of(batch)
        cols: list[list] = [[] for _ in range(6)]
        prefixes: list[bytes] = []
        for a, b in _slices(texts):
            x = Lines(texts[a:b], shared.value)
            if not len(x.keys):
                continue
            low, high = x.bitmaps()
            for c, v in zip(cols, (x.keys, ids[a:b][x.text], x.number, x.sizes, low, high)):
                c.append(v)
            p = prefix_lengths(x.sizes, t)
            raw = x.tokens.tobytes()
            prefixes += [raw[8 * i : 8 * (i + k)] for i, k in zip(x.starts.tolist(), p.tolist())]
        names = [c.split()[0] for c in CLASS.split(", ")]
        if not prefixes:
            return {name: [] for name in names}
        flat = [np.concatenate(c) for c in cols]
        order = np.lexsort((flat[2], flat[1], flat[0]))
        first = order[np.concatenate(([True], np.diff(flat[0][order]) != 0))]  # of equal sets in the batch, the earliest
        return {**{name: v[first] for name, v in zip(names, flat)}, "prefix": [prefixes[i] for i in first.tolist()]}

    local = map_rows(docs, ["doc_id", "text"], kernel, CLASS)
    first = local.groupBy("set_key").agg(F.min(F.struct("doc", "line", "n", "b0", "b1", "prefix")).alias("x"))
    return written(first.select("set_key", "x.*"))


#: A row of the prefix index; size is below 0 where the class is no longer open.
_ROW = np.dtype([("token", "<u8"), ("key", "<i8"), ("doc", "<i8"), ("b0", "<u8"), ("b1", "<u8"), ("line", "<i4"), ("size", "<i4"), ("place", "<i4")])
#: A later line's candidates per word and round, and how much they grow by round.
FEW, GROWTH = 64, 8
#: Candidates that all open classes of a later round may have between them, about.
CANDIDATES = 1 << 22
#: Candidate pairs that a reducer looks at or holds at a time, about.
_KEEP = 300_000


def _bands(size: np.ndarray, t: float) -> np.ndarray:
    """Sets whose sizes' ratio is t or more are in the same band or in neighbours."""
    return np.floor(np.log(size) / -math.log(t) * (1 - 1e-9)).astype(np.int64) if t < 1 else size.astype(np.int64) * 2


def earlier_few(rows: np.ndarray, t: float, few: int, part_of=None):
    """For each open row, in blocks: (row, an earlier row of its word that passes all filters), and (row, whether
    it has more than are given).  A row gets its earliest `few` at least, if it has as many.

    A word's rows stand in size bands, and by document and line within a band.  A row looks at its own and the
    two next bands from the earliest row on, in windows that grow, until it has enough; so a group of near
    copies costs in proportion to its size, and no more than _KEEP pairs are held at a time or a row's own.
    part_of(token, key): where rows are of two parts of a word, their parts; pairs within one are in another bucket."""
    by_token = np.argsort(rows["token"], kind="stable")
    ordered = rows["token"][by_token]
    again = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(rows), bool)
    shared[1:] = again
    shared[:-1] |= again
    origin = np.sort(by_token[shared])  # a word that one class has pairs nothing
    rows = rows[origin]
    n = len(rows)
    if n < 2:
        return
    opened = rows["size"] > 0
    rows["size"] = np.abs(rows["size"])
    band = _bands(rows["size"], t)
    place_in_corpus = np.empty(n, np.int64)
    by_place = np.lexsort((rows["line"], rows["doc"]))
    place_in_corpus[by_place] = np.cumsum(np.concatenate(([0], (rows["doc"][by_place][1:] != rows["doc"][by_place][:-1]) | (rows["line"][by_place][1:] != rows["line"][by_place][:-1]))))
    order = np.lexsort((place_in_corpus, band, rows["token"]))
    r = rows[order]
    token, band, when = r["token"], band[order], place_in_corpus[order]
    size, left = r["size"].astype(np.int64), (r["size"] - r["place"]).astype(np.int64)
    b0, b1 = (np.ascontiguousarray(r[c]) for c in ("b0", "b1"))
    part = part_of(np.ascontiguousarray(token), np.ascontiguousarray(r["key"])) if part_of is not None else np.zeros(n, np.int64)
    across = len(np.unique(part)) > 1
    new = np.ones(n, bool)
    new[1:] = (token[1:] != token[:-1]) | (band[1:] != band[:-1])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    line = group * (n + 1) + when
    late = np.flatnonzero(opened[order])
    order = origin[order]
    step = max(1, _KEEP // few)
    for lo in range(0, len(late), step):
        own = late[lo : lo + step]
        early_rows, late_rows, unfinished = [], [], np.zeros(len(own), bool)
        for shift in (-1, 0, 1):
            target = group[own] + shift
            inside = np.clip(target, 0, len(first) - 1)
            ok = (target == inside) & (token[first[inside]] == token[own]) & (band[first[inside]] == band[own] + shift)
            at = first[inside]
            stop = np.where(ok, np.searchsorted(line, inside * (n + 1) + when[own]), at)
            have = np.zeros(len(own), np.int64)
            window = 2 * few
            while True:
                active = np.flatnonzero((at < stop) & (have < few))
                if not len(active):
                    break
                take = np.minimum(stop[active] - at[active], window)
                ends = np.cumsum(take)
                k = 0
                while k < len(active):
                    base = int(ends[k - 1]) if k else 0
                    to = max(k + 1, int(np.searchsorted(ends, base + _KEEP, side="right")))
                    c = take[k:to]
                    who = np.repeat(active[k:to], c)
                    i = own[who]
                    j = np.repeat(at[active[k:to]] - np.cumsum(c) + c, c) + np.arange(len(who))
                    both = size[i] + size[j]
                    need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
                    use = np.minimum(left[i], left[j]) >= need
                    use &= np.minimum(size[i], size[j]) >= need
                    if across:
                        use &= part[i] != part[j]
                    use = np.flatnonzero(use)
                    i, j, who = i[use], j[use], who[use]
                    differ = np.bitwise_count(b0[i] ^ b0[j]).astype(np.int64) + np.bitwise_count(b1[i] ^ b1[j])
                    use = differ <= (both - 2 * need)[use]
                    late_rows.append(who[use]), early_rows.append(j[use])
                    have += np.bincount(who[use], minlength=len(own))
                    k = to
                at[active] += take
                window *= 4
            unfinished |= at < stop
        who, early = np.concatenate(late_rows or [np.zeros(0, np.int64)]), np.concatenate(early_rows or [np.zeros(0, np.int64)])
        sort = np.lexsort((when[early], who))
        who, early = who[sort], early[sort]
        begin = np.searchsorted(who, np.arange(len(own)))
        many = np.bincount(who, minlength=len(own))
        keep = np.arange(len(who)) - begin[who] < few
        yield order[early[keep]], order[own[who[keep]]], order[own[unfinished | (many > few)]]


#: Flags of words that some, and that several, classes have in their prefixes.
SEEN = 1 << 25


def _seen(token: np.ndarray) -> np.ndarray:
    return (mix(token ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(39)).astype(np.int64)


def prefix_tables(classes: DataFrame, wanted) -> tuple[np.ndarray, np.ndarray]:
    """(index rows of each counter's words, packed flags of words that two classes or more have).

    A word that one class has pairs nothing and needn't be in the index.  Both tables are of fixed size; words that
    share a flag count as one, which lets a few through."""
    ship_package(classes.sparkSession)
    size = SEEN // 8 // 16

    def tally(batches):
        give_back()
        count, seen = np.zeros(COUNTERS, np.int64), np.zeros(SEEN, np.uint8)
        for batch in batches:
            token = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            only = wanted.value[1]
            if only is not None:
                token = token[only.has(token)]
            count += np.bincount(_counter(token), minlength=COUNTERS)
            at, n = np.unique(_seen(token), return_counts=True)
            seen[at] = np.minimum(seen[at] + np.minimum(n, 2), 2).astype(np.uint8)
        once, twice = np.split(np.packbits(seen > 0), 16), np.split(np.packbits(seen > 1), 16)
        arrays = [pa.array(range(16), pa.int32()), pa.array(table_parts(count), pa.binary()), pa.array([x.tobytes() for x in once], pa.binary()), pa.array([x.tobytes() for x in twice], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "counts", "once", "twice"])

    def merge(batches):
        give_back()
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, *own in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in (1, 2, 3))):
                c, once, twice = np.frombuffer(own[0].as_buffer(), np.int64), *(np.frombuffer(v.as_buffer(), np.uint8) for v in own[1:])
                if part not in total:
                    total[part] = [np.zeros(COUNTERS // 16, np.int64), np.zeros(size, np.uint8), np.zeros(size, np.uint8)]
                t = total[part]
                t[0], t[2], t[1] = t[0] + c, t[2] | twice | (t[1] & once), t[1] | once
        arrays = [pa.array(list(total), pa.int32()), *[pa.array([t[i].tobytes() for t in total.values()], pa.binary()) for i in range(3)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "counts", "once", "twice"])

    schema = "part int, counts binary, once binary, twice binary"
    count, twice = np.zeros((16, COUNTERS // 16), np.int64), np.zeros((16, size), np.uint8)
    for r in classes.select("prefix").mapInArrow(tally, schema).repartition(16, "part").mapInArrow(merge, schema).select("part", "counts", "twice").collect():
        count[r["part"]], twice[r["part"]] = np.frombuffer(r["counts"], np.int64), np.frombuffer(r["twice"], np.uint8)
    return count.ravel(), twice.ravel()


def _part(key: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The part of a cut word's rows that a class is in."""
    return (mix(key.view(np.uint64)) % cut.astype(np.uint64)).astype(np.int64)


def least_size(t: float) -> int:
    """Smaller sets are t alike to no different set: one word more is the nearest that there is."""
    n = 1
    while n < t * (n + 1) - 1e-9:
        n += 1
    return n


def candidate_lists(classes: DataFrame, t: float, few: int, is_open: Flags | None = None) -> DataFrame:
    """(later, doc, line, first_key, keys, more), a row per open class and word of its prefix that earlier candidates
    share; None: all are open.

    keys are the earliest `few` of them, first_key the first, which stands at doc and line; more says that there
    are others.  So a group of near copies, in which all are candidates of all, makes rows in proportion to its
    size.  A word of more rows than a bucket holds has its rows cut into parts, and a bucket for each two parts.
    """
    spark = classes.sparkSession
    only = None if is_open is None else words_of_open(classes, is_open)
    tables = spark.sparkContext.broadcast((is_open, only))
    count, twice = prefix_tables(classes, tables)
    buckets = max(1, math.ceil(int(count.sum()) / BUCKET_ROWS))
    parts = np.where(count > BUCKET_ROWS, -(-2 * count // BUCKET_ROWS), 1)
    own_buckets = np.where(parts > 1, parts * (parts + 1) // 2, 0)
    dealt = spark.sparkContext.broadcast((parts, buckets + np.cumsum(own_buckets) - own_buckets, twice))

    def pack(batches):
        give_back()
        for batch in batches:
            key, doc, line, size, b0, b1 = (batch.column(i).to_numpy() for i in range(6))
            opened, wanted = tables.value
            parts, base, twice = dealt.value
            prefix = batch.column(6).to_pylist()
            p = np.fromiter(map(len, prefix), np.int64, len(prefix)) // 8
            row = np.repeat(np.arange(len(p)), p)
            token, place = np.frombuffer(b"".join(prefix), np.uint64), np.arange(len(row)) - np.repeat(np.cumsum(p) - p, p)
            at = _seen(token)
            use = (twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & np.uint8(1) == 1
            if wanted is not None:
                use &= wanted.has(token)
            row, token, place = row[use], token[use], place[use]
            bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
            counter = _counter(token)
            cut = parts[counter]
            if (cut > 1).any():
                again = np.repeat(np.arange(len(token)), cut)
                other = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
                mine = _part(key[row], cut)[again]
                high, low = np.maximum(mine, other), np.minimum(mine, other)
                bucket = np.where(cut[again] > 1, base[counter[again]] + high * (high + 1) // 2 + low, bucket[again])
                row, token, place = row[again], token[again], place[again]
            out = np.zeros(len(row), _ROW)
            size = size if opened is None else np.where(opened.has(key), size, -size)
            for name, v in (("key", key), ("doc", doc), ("line", line), ("size", size), ("b0", b0.view(np.uint64)), ("b1", b1.view(np.uint64))):
                out[name] = v[row]
            out["token"], out["place"] = token, place
            order = np.argsort(bucket, kind="stable")
            bucket, out = bucket[order], out[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            ids = bucket[np.concatenate(([0], cuts))] if len(bucket) else []
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in np.split(out, cuts)] if len(bucket) else [], pa.binary())], names=["bucket", "rows"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        rows = np.concatenate([np.frombuffer(x.as_buffer(), _ROW) for b in batches for x in b.column(b.schema.get_field_index("rows"))])
        parts = dealt.value[0]
        part_of = lambda token, key: _part(key, parts[_counter(token)])
        for a, b, more in earlier_few(rows, t, few, part_of):
            at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
            first, own = a[at], b[at]
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(b)), pa.int32()), pa.array(rows["key"][a], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["key"][own], pa.int64()), pa.array(rows["doc"][first], pa.int64()), pa.array(rows["line"][first], pa.int32()), pa.array(rows["key"][first], pa.int64()),
                 lists, pa.array(np.isin(own, more), pa.bool_())],
                names=["later", "doc", "line", "first_key", "keys", "more"],
            )

    index = classes.select("set_key", "doc", "line", "n", "b0", "b1", "prefix").mapInArrow(pack, "bucket long, rows binary")
    return written(index.groupBy("bucket").applyInArrow(join, "later long, doc long, line int, first_key long, keys array<long>, more boolean"))


def class_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_key, words): the whole sets of the wanted(set_key, doc, line) lines, from their texts.

    Flags of the documents and of the places pick out the lines, and few others; texts don't move."""
    place = lambda doc, line: mix(doc.view(np.uint64)) + line.astype(np.uint64)
    flags = united(wanted, ["doc", "line"], lambda b: [longs(b.column(0)), place(longs(b.column(0)), longs(b.column(1)))])
    shared = docs.sparkSession.sparkContext.broadcast(flags or [Flags(), Flags()])

    def kernel(batch: pa.RecordBatch) -> dict:
        documents, places = shared.value
        ids = longs(batch.column(0))
        use = documents.has(ids)
        ids, texts = ids[use], bytes_of(batch.filter(pa.array(use)))
        keys, sets = [np.zeros(0, np.int64)], []
        for a, b in _slices(texts):
            x = Lines(texts[a:b], None)
            at = np.flatnonzero(places.has(place(ids[a:b][x.text], x.number)))
            raw = x.tokens.tobytes()
            keys.append(x.keys[at])
            sets += [raw[8 * s : 8 * (s + n)] for s, n in zip(x.starts[at].tolist(), x.sizes[at].tolist())]
        return {"set_key": np.concatenate(keys), "words": sets}

    found = map_rows(docs.select(F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), "text"), ["doc", "text"], kernel, "set_key long, words binary")
    return found.join(wanted.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])


def _verified(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The later classes of pairs(later, earlier) whose sets are t or more alike."""
    x = pairs.join(sets.select(F.col("set_key").alias("later"), F.col("words").alias("wl")), "later")
    x = x.join(sets.select(F.col("set_key").alias("earlier"), F.col("words").alias("we")), "earlier")

    def kernel(batch: pa.RecordBatch) -> dict:
        later = batch.column(0).to_pylist()
        out = []
        for k, a, b in zip(later, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            if common >= t * (len(a) + len(b) - common) - 1e-9:
                out.append(k)
        return {"later": out}

    return map_rows(x, ["later", "wl", "we"], kernel, "later long").distinct()


def matched_classes(docs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """(later): the classes that an earlier, different class matches.

    A class is verified against its earliest candidate, which settles near all of a group of near copies,
    then against its few others.  Only classes that are still open and had more candidates go into another
    round with more of them each, until none is left.
    """
    classes = classes.filter(F.col("n") >= least_size(t))
    place = classes.select("set_key", "doc", "line")
    matched: DataFrame | None = None
    few, is_open = FEW, None
    sets: DataFrame | None = None
    still: DataFrame | None = None
    while True:
        lists = candidate_lists(classes, t, few, is_open)
        free_shuffles(docs.sparkSession)
        ends = lists.select(F.explode(F.concat(F.array("later"), "keys")).alias("set_key")).distinct()
        missing = ends if sets is None else written(ends.join(sets.select("set_key"), "set_key", "left_anti"))
        if sets is None or not missing.isEmpty():  # all that may be compared, in one pass over the texts
            more = written(class_words(docs, written(place.join(missing, "set_key"))))
            sets = more if sets is None else sets.unionAll(more)
        heads = written(lists.groupBy("later").agg(F.min(F.struct("doc", "line", "first_key")).getField("first_key").alias("earlier"), F.bool_or("more").alias("more")))
        first = written(_verified(heads.select("later", "earlier"), sets, t))
        left = heads.join(first, "later", "left_anti")
        pairs = lists.select("later", "keys").join(left.select("later", F.col("earlier").alias("head")), "later").select("later", "head", F.explode("keys").alias("earlier"))
        second = written(_verified(pairs.filter("earlier <> head").select("later", "earlier").distinct(), sets, t))
        found = first.unionAll(second)
        matched = found if matched is None else matched.unionAll(found)
        rest = left.filter("more").select("later").join(second, "later", "left_anti").withColumnRenamed("later", "set_key")
        still = written(rest if still is None else rest.join(still, "set_key", "left_semi"))
        free_shuffles(docs.sparkSession)
        if still.isEmpty():
            return matched
        few = max(few * GROWTH, CANDIDATES // still.count())
        is_open = open_flags(still)


def kept_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, kept): a document's lines with words and, of those, the numbers that stay, in order.

    Lines come from splitting at \\n, A-Z is folded, and the order of lines is that of doc_id (null last)
    and line number.  A line goes if any earlier one matches, judged on the input.  Lines without words
    are not counted and always stay; null and empty texts have none.  Rows that share a doc_id share the
    decision about a line number.  Words are compared by 42-bit hashes.
    """
    narrow = docs.select("doc_id", "text")
    rarity, counted = count_words(narrow)
    classes = line_classes(narrow, rarity, t)
    free_shuffles(docs.sparkSession)
    gone = matched_classes(narrow, classes, t)
    kept = classes.join(gone.select(F.col("later").alias("set_key")), "set_key", "left_anti").groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("kept"))
    own = F.coalesce("doc_id", F.lit(_NO_DOC))
    return counted.join(kept, own == F.col("doc"), "left").select("doc_id", "n_lines", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def dedup_lines(docs: DataFrame, t: float = SIMILARITY) -> DataFrame:
    """docs with only the kept lines in text, and n_chars to fit; a text whose lines all go is empty."""
    kept = kept_lines(docs, t).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("_kept_id"), F.col("kept").alias("_kept"))
    x = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")), "left")
    stays = lambda line, i: F.array_contains(F.col("_kept"), i) | ~line.rlike(r"[^\x20\x09-\x0D]")
    text = F.array_join(F.filter(F.split("_text", "\n"), stays), "\n")
    x = x.withColumn("_new", F.when(F.size("_kept") > 0, text).otherwise(F.when(F.col("_text").isNotNull(), F.lit(""))))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return x.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): the kept lines' numbers, comma-joined."""
    x = kept_lines(documents(spark, sf_dir))
    return x.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.array_join(F.transform("kept", lambda i: i.cast("string")), ",").alias("kept"))
