"""k-mer counts and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import RNA, all_kmers, kmer_array, symbols


def count_kmers(seqs: DataFrame, k: int, seeds: str | None = RNA) -> DataFrame:
    """(kmer, n): overlapping k-mers of seqs.seq; with seeds also a zero for each absent word over that alphabet."""
    counted = seqs.select(symbols("seq").alias("chars")).select(F.explode(kmer_array("chars", k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    if seeds is None:
        return counted
    return all_kmers(seqs.sparkSession, k, seeds).join(counted, "kmer", "full_outer").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def enrichment(n: Column, total: Column, k: int, letters: int = 4) -> Column:
    """Count over what a uniform composition gives."""
    return F.try_divide(n.cast("double"), total * F.lit(float(letters) ** -k))


def log_enrichment(n: Column, total: Column, k: int, letters: int = 4) -> Column:
    """log2 of the enrichment, minus infinity for a count of 0."""
    return F.when(n == 0, F.lit(float("-inf"))).otherwise(F.log2(enrichment(n, total, k, letters)))


def enriched_kmers(seqs: DataFrame, sizes: list[int] = [3, 4, 5], log: bool = False) -> DataFrame:  # noqa: B006
    """(k, kmer, n, enrichment) for several sizes; seeds have count 0 and don't change the total."""
    out = None
    for k in sizes:
        c = count_kmers(seqs, k)
        total = c.agg(F.sum("n").alias("total"))
        f = log_enrichment if log else enrichment
        part = c.crossJoin(F.broadcast(total)).select(F.lit(k).alias("k"), "kmer", "n", f(F.col("n"), F.col("total"), k).alias("enrichment"))  # one row
        out = part if out is None else out.unionByName(part)
    return out


def alphabet_of(seqs: DataFrame) -> DataFrame:
    """(ch): the different characters of all sequences."""
    return seqs.select(F.explode(F.array_distinct(symbols("seq"))).alias("ch")).distinct()
