"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get equal-token blocks by highest quotients, a source's blocks are apportioned to its shards the
same way, and each shard takes a seeded run of its blocks.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written

WEIGHTS = (5.0, 2.0, 1.0)
#: Tokens in a block, and in a shard on average.
BLOCK_TOKENS = 64
SHARD_TOKENS = 1 << 20
MOST_REPEATS = 3
#: Blocks that the least target has at least.
BLOCKS_OF_LEAST = 100
#: Rows of a table of sources that are broadcast at most.
MOST_BROADCAST = 100_000
#: Shards grow with the corpus beyond this many, so the driver's table of quotas stays small.
MOST_SHARDS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MOST_REPEATS) -> list[float]:
    """Tokens wanted of each source: weights share out all sizes; a target above most x size stops there and
    the excess goes to the others by weight, until none is above."""
    total = share * sum(sizes)
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0]
    left = total
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left = max(0.0, left - sum(out[i] for i in over))
        free = [i for i in free if i not in set(over)]
    return out


def sainte_lague(claims: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotient claim / (2 * seats so far + 1); ties go to the earlier party.

    The first seats come from a divisor just too large, so the heap only deals the last few: a seat's
    rank in the quotient order is the same either way.
    """
    n = len(claims)
    most = most or [seats] * n
    got = [0] * n
    total = sum(claims)
    if total <= 0 or seats <= 0:
        return got
    low, high = 0.0, max(claims) * 2 + 1
    given = lambda d: [min(most[i], int(math.floor(claims[i] / d + 0.5))) for i in range(n)]
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(given(mid)) > seats:
            low = mid
        else:
            high = mid
    got = given(high)
    heap = [(-claims[i] / (2 * got[i] + 1), i) for i in range(n) if got[i] < most[i] and claims[i] > 0]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def plan(sized: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> tuple[int, DataFrame]:
    """The tokens of a block; and per source and shard its size, quota in tokens, and its source's size and target.

    A block is so small that the least target has BLOCKS_OF_LEAST of them, down to one token, so rounding to
    blocks leaves no source short.  The driver holds one row per source and one per shard of shard_tokens
    tokens: both are metadata.
    """
    spark = sized.sparkSession
    by_source = [r.asDict() for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    by_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in by_source]
    shard_tokens = max(shard_tokens, sum(sizes) // MOST_SHARDS)
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    for r, t in zip(by_source, wanted):
        r["target"], r["shards"] = t, max(1, math.ceil(r["size"] / shard_tokens))
    block = max(1, min([block, *[int(t / BLOCKS_OF_LEAST) for t in wanted if t > 0]]))
    quota = sainte_lague(wanted, round(sum(wanted) / block), [math.floor(MOST_REPEATS * s / block) for s in sizes])
    shards = spark.createDataFrame([(r["source"], i, r["shards"]) for i, r in enumerate(by_source)], "of string, source_no int, shards int")
    dealt = _placed(sized, shards)
    per: dict[int, list] = {}
    for r in dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).orderBy("source_no", "shard").collect():
        per.setdefault(r["source_no"], []).append((r["shard"], r["size"]))
    rows = []
    for i, own in per.items():
        room = [math.floor(MOST_REPEATS * s / block) for _, s in own]
        for (shard, size), q in zip(own, sainte_lague([float(s) for _, s in own], quota[i], room)):
            rows.append((by_source[i]["source"], i, shard, by_source[i]["shards"], by_source[i]["size"], by_source[i]["target"], size, q * block))
    return block, spark.createDataFrame(rows, "of string, source_no int, shard int, shards int, source_size long, target double, shard_size long, quota long")


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's source number and shard; sources has one row per source, which is broadcast up to a bound."""
    few = sources.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    x = sized.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("of")))
    return x.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit("shard")), F.col("shards")).cast("int")).drop("of", "shards")


def mix(docs: DataFrame, seed: int = 17, weights: tuple = WEIGHTS, block: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, extra_from, extra_to) for every document.

    A shard's documents stand on a token line in seeded order.  Its quota is whole passes over the line
    plus a run of blocks that starts at a seeded block and goes round; taken counts a document's words in
    both, extra_from and extra_to the word range of the run's larger part inside it.  Texts without words
    take nothing; rows with a repeated doc_id are told apart by their text's hash.
    """
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")))
    block, quotas = plan(sized, weights, block, shard_tokens)
    placed = _placed(sized, quotas.select("of", "source_no", "shards").distinct())
    line = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(seed)), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    on_line = placed.withColumn("end", F.sum("size").over(line)).join(quotas.drop("of", "shards"), ["source_no", "shard"])
    span = F.greatest(F.col("shard_size"), F.lit(1))
    rest = F.pmod(F.col("quota"), span)
    first = F.pmod(F.xxhash64("source_no", "shard", F.lit(seed), F.lit("start")), F.greatest(F.ceil(span / block), F.lit(1))) * block
    begin = F.col("end") - F.col("size")
    over = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(begin, lo))
    x = on_line.withColumn("rest", rest).withColumn("lo", first).withColumn("hi", F.col("lo") + F.col("rest"))
    x = x.withColumn("run", over(F.col("lo"), F.least(F.col("hi"), F.col("shard_size")))).withColumn("wrap", over(F.lit(0).cast("long"), F.greatest(F.col("hi") - F.col("shard_size"), F.lit(0))))
    taken = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(F.col("quota") / span) * F.col("size") + F.col("run") + F.col("wrap"))
    from_run = F.greatest(F.col("lo") - begin, F.lit(0))
    use_run = F.col("run") >= F.col("wrap")
    return x.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(use_run, from_run).otherwise(F.lit(0)).cast("long").alias("extra_from"),
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs as the mix reads them: a row for each whole pass, and a row with the words of the partial one.

    Only documents at an end of their shard's run have a partial row.  Texts without words are dropped.
    """
    took = mix(docs, seed).filter("taken > 0").select(F.col("doc_id").alias("_took_id"), F.col("text_hash").alias("_took_hash"), F.col("size").alias("_words"), F.col("taken").alias("_taken"), F.col("extra_from").alias("_from")).distinct()
    x = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_hash"))
    x = x.join(took, F.col("_id").eqNullSafe(F.col("_took_id")) & (F.col("_hash") == F.col("_took_hash")))
    passes = F.floor(F.col("_taken") / F.col("_words")).cast("int")
    rest = (F.col("_taken") - passes * F.col("_words")).cast("int")
    pieces = F.split(F.regexp_replace("_text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    start = F.least(F.col("_from"), F.col("_words") - rest).cast("int")
    part = F.when(rest > 0, F.array_join(F.slice(pieces, start + 1, F.greatest(rest, F.lit(1))), ""))
    copies = F.concat(F.array_repeat(F.col("_text"), passes), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    x = x.withColumn("_new", F.explode(copies))
    new = {"text": F.col("_new"), "n_chars": F.length("_new").cast("long")}
    return x.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, as mix() has them."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")
