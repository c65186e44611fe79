"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text becomes chunks, runs of the space mark followed by what stands before the next one; no piece of
the vocabulary crosses a chunk's border.  Inside a chunk an agenda holds the candidate merges by score.
A candidate is skipped when a keyed hash of (seed, document, copy, place, span) falls below the dropout
rate, so a run is repeatable and every occurrence of a chunk has a segmentation of its own.  Chunks
of one length go through their agendas side by side.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bytes_of, documents, map_rows

#: Where the vocabulary file is; a parameter of every function below.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a mark in the text itself: no valid text holds a lone surrogate.
LITERAL_MARK = "\udfff"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: Longer chunks use the heap; places in a block's numbers have six bits.
LONGEST_ROW = 48
#: Chunks of one length that are segmented together, and characters that are collected before that.
_COLUMNS, _WAITING = 1 << 12, 1 << 20
_NEVER, _GONE = np.int32(2**31 - 1), np.int32(-(2**31))
_ALL = 2**64 - 1
_ODD = 0x9E3779B1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x):
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Pieces, merge order and bytes of a BPE model with byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.size = n
        self.ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int32)
        texts: list[bytes] = []
        scores = np.zeros(n)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                texts.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                texts.append(b"")
            else:
                self.ids[piece] = i
                texts.append(piece.replace(MARK, " ").encode())
            scores[i] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses a chunk border")
        order = np.argsort(-scores, kind="stable")
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        same = np.concatenate(([False], scores[order][1:] == scores[order][:-1]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        rank[order] = first.astype(np.int32)  # equal scores are equal ranks: the leftmost goes first
        self.rank = rank
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pair_map = pairs
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_lengths = np.array([len(t) for t in texts], np.int64)
        self.piece_starts = np.concatenate(([0], np.cumsum(self.piece_lengths)[:-1]))
        self.symbol_of = -np.arange(0x110000, dtype=np.int32) - 1
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        self.mark = int(self.symbol_of[ord(MARK)])
        self._place_pairs()

    def _place_pairs(self) -> None:
        """Pairs in one table: that of (a, b) is at a * odd + shift[b], where no other pair's place is.  An odd
        factor keeps the places of one b apart, so a shift is tried until they are free."""
        by_right: dict[int, list[int]] = {}
        for key in self.pair_map:
            by_right.setdefault(key & 0xFFFFFFFF, []).append(key >> 32)
        bits = max(10, (8 * len(self.pair_map) + self.size).bit_length())
        self.mask = (1 << bits) - 1
        self.shift = np.zeros(self.size + 1, np.int64)
        self.right = np.full(1 << bits, -1, np.int32)
        self.makes = np.full(1 << bits, -1, np.int32)
        draw = np.random.default_rng(1)
        for b, lefts in sorted(by_right.items(), key=lambda x: (-len(x[1]), x[0])):
            left = np.array(lefts, np.int64) * _ODD
            while True:
                shift = int(draw.integers(1 << bits))
                at = (left + shift) & self.mask
                if (self.right[at] < 0).all():
                    break
            self.shift[b], self.right[at] = shift, b
            self.makes[at] = [self.pair_map[a << 32 | b] for a in lefts]

    def symbol(self, ch: str) -> int:
        """The id of a character, or for one outside the vocabulary a negative code of its code point."""
        return self.ids.get(ch, -ord(ch) - 1)

    def fallback(self, code: int) -> list[int]:
        ch = chr(-code - 1)
        return self.byte_ids[np.frombuffer((MARK if ch == LITERAL_MARK else ch).encode(), np.uint8)].tolist()

    def symbols_of(self, text: str) -> np.ndarray:
        return self.symbol_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs make, -1 where they make none."""
        b = np.where(b < 0, self.size, b)
        at = (np.where(a < 0, self.size, a).astype(np.int64) * _ODD + self.shift[b]) & self.mask
        return np.where(self.right[at] == b, self.makes[at], np.int32(-1))


def chunk_key(chunk: str, seed: int, draw: int) -> int:
    return (xxhash.xxh64_intdigest(chunk.encode("utf-8", "surrogatepass"), seed & (2**64 - 1)) + draw * 0x9E3779B97F4A7C15) & (2**64 - 1)


def _dropped(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys + starts.astype(np.uint64) * np.uint64(0x100000001B3) + (ends.astype(np.uint64) << np.uint64(40))) < limit


def _is_dropped(key: int, start: int, end: int, limit: int) -> bool:
    """_dropped() of one span, in plain integers."""
    x = (key + start * 0x100000001B3 + (end << 40)) & _ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _ALL
    return (x ^ (x >> 31)) < limit


def _limit(dropout: float) -> np.uint64:
    return np.uint64(min(2**64 - 1, int(dropout * 2**64)))


def agenda(chunk: str | list[int], vocab: Vocabulary, key: int, dropout: float) -> list[int]:
    """Symbols of one chunk, which may be given as such: the candidates leave a heap by rank and place, skipped ones for good."""
    ids = [vocab.symbol(c) for c in chunk] if isinstance(chunk, str) else chunk
    n = len(ids)
    right = list(range(1, n)) + [-1]
    left = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    limit, ranks, pairs = int(_limit(dropout)), vocab.rank, vocab.pair_map
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < 0 or ids[i] < 0 or ids[j] < 0:
            return
        made = pairs.get((ids[i] << 32) | ids[j])
        if made is not None:
            heapq.heappush(heap, (int(ranks[made]), i, made, ids[i], end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, made, was, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or ids[i] != was or end[j] != stop or pairs.get((ids[i] << 32) | ids[j]) != made:
            continue
        if limit and _is_dropped(key, i, stop, limit):
            continue
        ids[i], end[i], alive[j] = made, end[j], False
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [ids[i] for i in range(n) if alive[i]]


def _block(sym: np.ndarray, keys: np.ndarray, vocab: Vocabulary, limit: np.uint64) -> np.ndarray:
    """agenda() for a block of chunks of one length, a column each: symbols as they are left, -2**31 where merged.

    A symbol stands at its first place; behind[c] is the place of the next one, so a pair's span is known.
    Every turn takes each column's best candidate and merges it or, if its draw says so, skips it."""
    width, n = sym.shape
    behind = np.repeat(np.arange(1, width + 3, dtype=np.int64), n).reshape(width + 2, n)
    before = np.repeat(np.arange(-1, width + 1, dtype=np.int64), n).reshape(width + 2, n)
    made = np.full((width, n), -1, np.int32)
    order = np.full((width, n), _NEVER, np.int32)  # rank and place in one number, so ties go to the left
    made[:-1] = vocab.merged(sym[:-1], sym[1:])
    order[:-1] = np.where(made[:-1] >= 0, vocab.rank[made[:-1]] * np.int32(64) + np.arange(width - 1, dtype=np.int32)[:, None], _NEVER)
    flat_sym, flat_made, flat_order, next_of, last_of = sym.ravel(), made.ravel(), order.ravel(), behind.ravel(), before.ravel()
    while True:
        best = order.min(axis=0)
        col = np.flatnonzero(best != _NEVER)
        if not len(col):
            return sym
        place = (best[col] & 63).astype(np.int64)
        here = place * n + col
        mid = next_of[here]
        end = next_of[mid * n + col]
        if limit:
            skip = _dropped(keys[col], place, end, limit)
            flat_order[here[skip]] = _NEVER
            go = ~skip
            col, place, here, mid, end = col[go], place[go], here[go], mid[go], end[go]
        gone = mid * n + col
        flat_sym[here] = flat_made[here]
        flat_sym[gone], flat_order[gone] = _GONE, _NEVER
        next_of[here] = end
        last_of[end * n + col] = place
        for at, right in ((place, end), (last_of[here], place)):
            ok = np.flatnonzero((at >= 0) & (right < width))
            x = at[ok] * n + col[ok]
            new = vocab.merged(flat_sym[x], flat_sym[right[ok] * n + col[ok]])
            flat_made[x] = new
            flat_order[x] = np.where(new >= 0, vocab.rank[new] * np.int32(64) + at[ok].astype(np.int32), _NEVER)
            flat_order[at[right >= width] * n + col[right >= width]] = _NEVER


def _segment(codes: np.ndarray, start: np.ndarray, length: np.ndarray, keys: np.ndarray, vocab: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) of chunks, given as ranges of codes, the symbols of characters.  What is outside the
    vocabulary becomes byte pieces."""
    limit = _limit(dropout)
    count = np.ones(len(start), np.int64)
    order, parts = [], []
    by_length = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[by_length])) + 1
    for group in np.split(by_length, cuts) if len(by_length) else ():
        width = int(length[group[0]])
        for lo in range(0, len(group), _COLUMNS):
            rows = group[lo : lo + _COLUMNS]
            if width > LONGEST_ROW:
                got = [np.array(agenda(codes[a : a + width].tolist(), vocab, k, dropout), np.int32) for a, k in zip(start[rows].tolist(), keys[rows].tolist())]
                count[rows] = [len(x) for x in got]
                parts += got
            else:
                sym = codes[start[rows][None, :] + np.arange(width)[:, None]]
                if width > 1:
                    sym = _block(sym, keys[rows], vocab, limit)
                sym = sym.T
                alive = sym != _GONE
                count[rows] = alive.sum(axis=1)
                parts.append(sym[alive])
            order.append(rows)
    if not order:
        return np.zeros(0, np.int32), count
    flat, at = np.concatenate(parts), np.concatenate(order)
    begin = np.empty(len(at), np.int64)
    begin[at] = np.cumsum(count[at]) - count[at]
    flat = _gather(flat, begin, count)
    odd = flat < 0
    if odd.any():
        kinds, which = np.unique(flat[odd], return_inverse=True)
        spelled = [vocab.fallback(c) for c in kinds.tolist()]
        long = np.array([len(x) for x in spelled], np.int64)
        first, size = flat.astype(np.int64), np.ones(len(flat), np.int64)
        first[odd], size[odd] = (vocab.size + np.cumsum(long) - long)[which], long[which]
        count = np.add.reduceat(size, np.cumsum(count) - count)
        flat = _gather(np.concatenate((np.arange(vocab.size, dtype=np.int32), np.array([y for x in spelled for y in x], np.int32))), first, size)
    return flat, count


def segment(chunks: list[str], keys: np.ndarray, vocab: Vocabulary, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, lengths) for (chunk, key) pairs; characters outside the vocabulary become byte pieces."""
    length = np.fromiter(map(len, chunks), np.int64, len(chunks))
    return _segment(vocab.symbols_of("".join(chunks)), np.cumsum(length) - length, length, keys, vocab, dropout)


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated pool[start : start + length]."""
    total = int(lengths.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(lengths)
    index = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
    return pool[index]


def chunks_of(text: str) -> list[str]:
    if not text:
        return []
    return _CHUNK.findall(MARK + text.replace(MARK, LITERAL_MARK).replace(" ", MARK))


def parts_of(text: str, size: int = 1 << 19):
    """A text in parts that have its chunks between them: a part ends before the space that begins a chunk."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        while end > 0 and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        if end < 0 or end + 1 == len(text):
            break
        yield text[at:end]
        at = end + 1  # encoding puts a mark before each part
    if text:
        yield text[at:]


def occurrence_keys(doc_keys: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(doc_keys + np.uint64(seed & (2**64 - 1)) * _M1) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def encode_batch(texts: list[str], doc_keys: np.ndarray, vocab: Vocabulary, dropout: float, seed: int, draws: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text).

    draws caps the segmentations of a chunk; 0 gives every occurrence its own draw.
    """
    counts = np.zeros(len(texts), np.int64)
    placed = np.zeros(len(texts), np.int64)  # chunks before the part
    out = [np.zeros(0, np.int32)]
    parts: list[str] = []
    owners: list[int] = []

    def flush() -> None:
        text = " ".join(["", *parts])  # the space that encoding puts before each
        codes = vocab.symbols_of(text.replace(MARK, LITERAL_MARK).replace(" ", MARK))
        own = np.array(owners)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        begin = np.cumsum(sizes) - sizes
        space = codes == vocab.mark
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[begin] = True
        start = np.flatnonzero(first)
        length = np.diff(np.append(start, len(codes)))
        of = np.searchsorted(begin, start, side="right") - 1
        number = np.bincount(of, minlength=len(parts))
        keys = np.zeros(len(start), np.uint64)
        if dropout > 0:
            base = placed[own]
            after = np.cumsum(number) - number
            same = np.flatnonzero(np.diff(own) == 0) + 1  # a text's parts stand in a row
            for k in same.tolist():
                base[k] = base[k - 1] + number[k - 1]
            keys = occurrence_keys(doc_keys[own[of]], np.arange(len(start)) - (after - base)[of], seed)
            if draws:
                chunk = [text[a:b].replace(" ", MARK) for a, b in zip(start.tolist(), (start + length).tolist())]
                with np.errstate(over="ignore"):
                    keys = np.array([chunk_key(c, seed, 0) for c in chunk], np.uint64) + keys % np.uint64(draws) * np.uint64(0x9E3779B97F4A7C15)
        np.add.at(placed, own, number)
        flat, lengths = _segment(codes, start, length, keys, vocab, dropout)
        out.append(flat)
        np.add.at(counts, own[of], lengths)
        parts.clear(), owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for part in parts_of(text):
            parts.append(part), owners.append(i)
            waiting += len(part) + 1
            if waiting >= _WAITING:
                flush()
                waiting = 0
    if parts:
        flush()
    return np.concatenate(out), counts


def decode_batch(flat: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 bytes of each run of ids, without the space that encoding puts before a text."""
    lengths = vocab.piece_lengths[flat]
    data = _gather(vocab.piece_bytes, vocab.piece_starts[flat], lengths).tobytes()
    ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends, ends[1:])]


def _shared_vocabulary(proto: bytes, cache: dict = {}) -> Vocabulary:  # noqa: B006  one per worker process
    key = xxhash.xxh64_intdigest(proto)
    if key not in cache:
        cache.clear()
        cache[key] = Vocabulary(proto)
    return cache[key]


def encode(docs: DataFrame, model: str = MODEL, dropout: float = 0.1, seed: int = 7, draws: int = 0, copies: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless): a segmentation of every whole text, decoded again and compared.

    Null and empty texts have no ids and are lossless.  Repeated rows with one doc_id and text get the
    same ids, unless `copies` numbers the rows of a doc_id and draws by that number too, which shuffles the
    texts; a null doc_id counts as 0 in the draw.  The model file is read on the driver and sent.
    """
    with open(model, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    if copies:
        rows = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
        docs = docs.select("doc_id", "text").withColumn("copy", F.row_number().over(rows).cast("long") - 1)
    else:
        docs = docs.select("doc_id", F.lit(0).cast("long").alias("copy"), "text")

    def kernel(batch: pa.RecordBatch) -> dict:
        vocab = _shared_vocabulary(proto.value)
        raw = bytes_of(batch)
        keys = np.array([x or 0 for x in batch.column(0).to_pylist()], np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            keys = keys + _mix(batch.column(1).to_numpy().astype(np.uint64))
        flat, counts = encode_batch([b.decode() for b in raw], keys, vocab, dropout, seed, draws)
        back = decode_batch(flat, counts, vocab)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
        return {"doc_id": batch.column(0), "n_pieces": counts, "ids": ids, "lossless": [a == b for a, b in zip(raw, back)]}

    return map_rows(docs, ["doc_id", "copy", "text"], kernel, "doc_id long, n_pieces long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ids; null ids decode to the empty text."""
    with open(model, "rb") as f:
        proto = encoded.sparkSession.sparkContext.broadcast(f.read())

    def kernel(batch: pa.RecordBatch) -> dict:
        vocab = _shared_vocabulary(proto.value)
        lists = [x or [] for x in batch.column(1).to_pylist()]
        flat = np.array([i for x in lists for i in x], np.int64)
        back = decode_batch(flat, np.array([len(x) for x in lists], np.int64), vocab)
        return {"doc_id": batch.column(0), "text": [b.decode() for b in back]}

    return map_rows(encoded, ["doc_id", "ids"], kernel, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, lossless) of every document, as encode() has them."""
    return encode(documents(spark, sf_dir))
