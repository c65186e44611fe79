"""Mutual information, permutation tests and multiple-testing correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ALPHABETS, DNA
from ..plans.numbering import numbered

#: Protein states that don't count.
NOT_STATES = ["-", ".", "X", "?"]
#: Decimal digits to which a permutation's value ties with the observed one.
TIE = 9


def _finite(w: Column) -> Column:
    return w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf"))


def valid_states(df: DataFrame, x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Rows with a base in x, a residue in y and a finite weight above zero."""
    return df.filter(F.col(x).isin(list(DNA)) & ~F.col(y).isin(NOT_STATES) & F.col(y).isNotNull() & _finite(F.col(w)))


def _information(joint: DataFrame, by: list[str]) -> DataFrame:
    """by..., mi in bits from joint(by..., x, y, s, rows); groups of fewer than two rows have 0."""
    over = lambda *c: Window.partitionBy(*by, *c)
    total, px, py = F.sum("s").over(over()), F.sum("s").over(over("x")), F.sum("s").over(over("y"))
    part = F.col("s") / total * F.log2(F.col("s") * total / (px * py))
    g = joint.withColumn("_part", part).groupBy(*by).agg(F.sum("_part").alias("mi"), F.sum("rows").alias("_n"))
    return g.select(*by, F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(F.greatest(F.col("mi") + F.lit(0.0), F.lit(0.0))).alias("mi"))


def weighted_mi(df: DataFrame, by: list[str] | None = None, valid: bool = True) -> DataFrame:
    """(by..., mi) of df(by..., x, y, w)."""
    by = by or []
    d = valid_states(df) if valid else df
    return _information(d.groupBy(*by, "x", "y").agg(F.sum("w").alias("s"), F.count("*").alias("rows")), by)


def mi_matrix(dna: DataFrame, protein: DataFrame, weights: DataFrame) -> DataFrame:
    """(prot_pos, dna_pos, mi): every protein column with every DNA column of cells(seq_id, pos, ch), in one aggregate."""
    d = dna.select("seq_id", F.col("pos").alias("dna_pos"), F.col("ch").alias("x"))
    p = protein.select("seq_id", F.col("pos").alias("prot_pos"), F.col("ch").alias("y"))
    return weighted_mi(d.join(p, "seq_id").join(weights.select("seq_id", F.col("weight").alias("w")), "seq_id"), ["prot_pos", "dna_pos"])


def benjamini_hochberg(df: DataFrame, p: str = "p", by: list[str] | None = None, id: str = "id") -> DataFrame:
    """df with q: the smallest p * n / rank from each rank upwards, at most 1."""
    if not by:
        return _whole_table_q(df, p, id)
    part = Window.partitionBy(*by)
    order = [F.col(p), F.col(id)]
    x = df.withColumn("_r", F.row_number().over(part.orderBy(*order))).withColumn("_n", F.count("*").over(part))
    back = part.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back))).drop("_r", "_n")


def _whole_table_q(df: DataFrame, p: str, id: str, chunk: int = 1 << 16) -> DataFrame:
    """The same over a whole table: ranks by ranges, and the running minimum by chunks of ranks, so no task has all rows."""
    x = numbered(df, [F.col(p), F.col(id)], "_q_r")
    n = x.agg(F.count("*").alias("_q_n"))
    x = x.crossJoin(F.broadcast(n)).withColumn("_q_v", F.col(p) * F.col("_q_n") / F.col("_q_r")).withColumn("_q_chunk", F.floor((F.col("_q_r") - 1) / chunk))  # one row
    least = x.groupBy("_q_chunk").agg(F.min("_q_v").alias("_q_least"))
    later = least.select("_q_chunk", F.min("_q_least").over(Window.orderBy(F.col("_q_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_q_later"))  # a row per chunk
    own = F.min("_q_v").over(Window.partitionBy("_q_chunk").orderBy(F.col("_q_r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    y = x.withColumn("_q_own", own).join(F.broadcast(later), "_q_chunk")
    return y.withColumn("q", F.least(F.lit(1.0), "_q_own", "_q_later")).drop("_q_r", "_q_n", "_q_v", "_q_chunk", "_q_own", "_q_later")


def shuffled_within(df: DataFrame, group: str, seed: int, n: int) -> DataFrame:
    """(perm_id, seq_id, partner): n seeded permutations of ids inside their groups."""
    perms = df.select("seq_id", group).crossJoin(df.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("perm_id")))
    own = perms.withColumn("nth", F.row_number().over(Window.partitionBy("perm_id", group).orderBy("seq_id")))
    other = perms.withColumn("nth", F.row_number().over(Window.partitionBy("perm_id", group).orderBy(F.xxhash64("seq_id", "perm_id", F.lit(seed)), "seq_id")))
    return own.join(other.select("perm_id", group, "nth", F.col("seq_id").alias("partner")), ["perm_id", group, "nth"]).select("perm_id", "seq_id", "partner")


def permutation_test(dna: DataFrame, protein: DataFrame, weights: DataFrame, permutations: DataFrame, weight_with_protein: bool = True) -> DataFrame:
    """(prot_pos, dna_pos, mi, p, q, fwer_p) from a table of permutations(perm_id, seq_id, partner).

    A protein is read from the partner; its weight goes with it unless weight_with_protein is false.
    p-values add one, and exceedance counts ties; fwer_p uses each permutation's largest value.  Values are compared
    to TIE digits, since one table's sums in another order differ in the last bits."""
    n = permutations.select("perm_id").distinct()
    own = dna.select("seq_id").distinct().select(F.lit(0).alias("perm_id"), "seq_id", F.col("seq_id").alias("partner"))
    pairs = own.unionByName(permutations.select("perm_id", "seq_id", "partner"))
    d = dna.select("seq_id", F.col("pos").alias("dna_pos"), F.col("ch").alias("x"))
    p = protein.select(F.col("seq_id").alias("partner"), F.col("pos").alias("prot_pos"), F.col("ch").alias("y"))
    w = weights.select(F.col("seq_id").alias("partner" if weight_with_protein else "seq_id"), F.col("weight").alias("w"))
    x = pairs.join(d, "seq_id").join(p, "partner").join(w, "partner" if weight_with_protein else "seq_id")
    mi = weighted_mi(x, ["perm_id", "prot_pos", "dna_pos"]).withColumn("mi", F.round("mi", TIE))
    seen = mi.filter("perm_id = 0").drop("perm_id")
    null = mi.filter("perm_id > 0")
    count = n.agg(F.count("*").alias("_n"))
    exceed = null.select("prot_pos", "dna_pos", F.col("mi").alias("null_mi")).join(seen, ["prot_pos", "dna_pos"]).groupBy("prot_pos", "dna_pos").agg(F.count_if(F.col("null_mi") >= F.col("mi")).alias("_e"))
    tops = null.groupBy("perm_id").agg(F.max("mi").alias("top")).agg(F.collect_list("top").alias("_tops"))  # a number per permutation
    out = seen.join(exceed, ["prot_pos", "dna_pos"], "left").crossJoin(F.broadcast(count)).crossJoin(F.broadcast(tops))
    out = out.withColumn("p", (F.coalesce("_e", F.lit(0)) + 1.0) / (F.col("_n") + 1))
    out = out.withColumn("fwer_p", (F.size(F.filter("_tops", lambda t: t >= F.col("mi"))) + 1.0) / (F.col("_n") + 1)).withColumn("_id", F.struct("prot_pos", "dna_pos"))
    return benjamini_hochberg(out, "p", id="_id").select("prot_pos", "dna_pos", "mi", "p", "q", "fwer_p")


def conditional_table(df: DataFrame) -> DataFrame:
    """(y, x, p): weighted P(base | residue) with a row for every base."""
    d = valid_states(df)
    s = d.groupBy("y", "x").agg(F.sum("w").alias("s"))
    every = s.select("y").distinct().withColumn("x", F.explode(F.array(*[F.lit(c) for c in DNA])))
    t = every.join(s, ["y", "x"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return t.select("y", "x", (F.col("s") / F.sum("s").over(Window.partitionBy("y"))).alias("p"))


def filled_frequencies(freq: DataFrame, molecule: str) -> DataFrame:
    """(ch, freq) over a molecule's whole alphabet, upper case, absent symbols 0; foreign symbols raise."""
    alphabet = ALPHABETS[molecule]
    up = freq.select(F.upper("ch").alias("ch"), "freq")
    odd = up.filter(~F.col("ch").isin(alphabet)).limit(1).collect()
    if odd:
        raise ValueError(f"{odd[0][0]!r} isn't in the {molecule} alphabet")
    letters = freq.sparkSession.createDataFrame([(c,) for c in alphabet], "ch string")
    return letters.join(up, "ch", "left").select("ch", F.coalesce("freq", F.lit(0.0)).alias("freq"))


def expected_frequencies(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, expected): the outer product of two symbol frequency tables, alphabets' size."""
    return a.select(F.col("ch").alias("x"), F.col("freq").alias("_p")).crossJoin(b.select(F.col("ch").alias("y"), F.col("freq").alias("_q"))).select("x", "y", (F.col("_p") * F.col("_q")).alias("expected"))


def joint_counts(pairs: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
    """(x, y, n, p) over the product of two alphabets, absent pairs 0."""
    s = pairs.sparkSession
    every = s.createDataFrame([(x, y) for x in xs for y in ys], "x string, y string")
    n = every.join(pairs.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("p", F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy())))
