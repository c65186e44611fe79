"""Alignments in long form: one row per cell (aln_id, seq_id, pos, ch), pos from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import chi_square_upper
from ..functions.sequence import ALPHABETS, AMINO_ACIDS, DNA, codon_map, degap, pad_right, symbols
from ..plans.session import compare

KEY = ["aln_id"]


def cells(alignments: DataFrame) -> DataFrame:
    """Upper-case characters of alignments(aln_id, seq_id, seq)."""
    return alignments.select("aln_id", "seq_id", F.posexplode(symbols(F.upper("seq"))).alias("pos", "ch"))


def rejoin(cell: DataFrame) -> DataFrame:
    """(aln_id, seq_id, seq): the remaining cells of each sequence in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return cell.groupBy("aln_id", "seq_id").agg(F.array_join(F.transform(ordered, lambda x: x["ch"]), "").alias("seq"))


def require_equal_lengths(alignments: DataFrame) -> None:
    bad = alignments.groupBy("aln_id").agg(F.countDistinct(F.length("seq")).alias("n")).filter("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"sequences of alignment {bad[0][0]} differ in length")


def column_frequency(cell: DataFrame) -> DataFrame:
    """(aln_id, pos, ch, n, freq): freq is over all sequences that have the column."""
    n = cell.groupBy("aln_id", "pos", "ch").agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("aln_id", "pos")))


def frequency_with_zeros(cell: DataFrame, alphabet: list[str], keep_others: bool = True) -> DataFrame:
    """column_frequency with a row for every symbol of an alphabet in every column."""
    f = column_frequency(cell)
    seeds = f.select("aln_id", "pos").distinct().withColumn("ch", F.explode(F.array(*[F.lit(c) for c in alphabet])))
    how = "full_outer" if keep_others else "left"
    filled = seeds.join(f, ["aln_id", "pos", "ch"], how)
    return filled.select("aln_id", "pos", "ch", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("freq", F.lit(0.0)).alias("freq"))


def frequency_matrix(cell: DataFrame, molecule: str = "prot") -> DataFrame:
    """One row per column, one frequency per symbol of the molecule's alphabet with '-'; wide form for the edge."""
    alphabet = ALPHABETS[molecule]
    return frequency_with_zeros(cell, alphabet, keep_others=False).groupBy("aln_id", "pos").pivot("ch", alphabet).agg(F.first("freq"))


def position_matrix(cell: DataFrame, molecule: str = "prot", kind: str = "probability") -> DataFrame:
    """(aln_id, ch, pos, value): counts or counts per sequence of ungapped symbols."""
    alphabet = [c for c in ALPHABETS[molecule] if c != "-"]
    f = frequency_with_zeros(cell, alphabet, keep_others=False)
    return f.select("aln_id", "ch", "pos", (F.col("freq") if kind == "probability" else F.col("n").cast("double")).alias("value"))


def columns_where(cell: DataFrame, symbol: str = "-", op: str = ">=", threshold: float = 1.0) -> DataFrame:
    """(aln_id, pos): columns whose share of a symbol passes the comparison."""
    share = cell.groupBy("aln_id", "pos").agg(F.avg((F.col("ch") == symbol).cast("double")).alias("share"))
    return share.filter(compare(F.col("share"), op, threshold)).select("aln_id", "pos")


def drop_columns(cell: DataFrame, bad: DataFrame) -> DataFrame:
    return cell.join(bad, ["aln_id", "pos"], "left_anti")


def keep_columns(cell: DataFrame, good: DataFrame) -> DataFrame:
    return cell.join(good, ["aln_id", "pos"], "left_semi")


def drop_gappy_columns(cell: DataFrame, threshold: float = 0.8, op: str = "<", gap: str = "-") -> DataFrame:
    """Cells of the columns whose gap share passes; op '<' drops a column at the threshold, '<=' keeps it."""
    return keep_columns(cell, columns_where(cell, gap, op, threshold))


def drop_homogeneous_columns(cell: DataFrame, threshold: float = 0.98, alphabet: list[str] | None = None) -> DataFrame:
    """Cells of the columns in which no symbol of the alphabet (protein with '-') is above the threshold."""
    allowed = alphabet or ALPHABETS["prot"]
    top = column_frequency(cell).groupBy("aln_id", "pos").agg(F.max(F.when(F.col("ch").isin(allowed), F.col("freq"))).alias("top"))
    return keep_columns(cell, top.filter((F.col("top") <= threshold) | F.col("top").isNull()).select("aln_id", "pos"))


def renumber(cell: DataFrame) -> DataFrame:
    """Cells with columns numbered from 0 again after some were dropped."""
    order = cell.select("aln_id", "pos").distinct().withColumn("new", (F.row_number().over(Window.partitionBy("aln_id").orderBy("pos")) - 1).cast("int"))
    return cell.join(order, ["aln_id", "pos"]).select("aln_id", "seq_id", F.col("new").alias("pos"), "ch")


def curated_columns(cell: DataFrame, homogeneous: float = 0.98, gaps: float = 0.8) -> DataFrame:
    """Homogeneous columns go first, then gappy ones, columns renumbered."""
    return renumber(drop_gappy_columns(drop_homogeneous_columns(cell, homogeneous), gaps))


def column_entropy(cell: DataFrame, ignore_gaps: bool = True, renormalise: bool = False, gap: str = "-") -> DataFrame:
    """(aln_id, pos, entropy) in bits.  Ignored gaps leave the sum but stay in the denominator unless
    renormalise; a column of gaps has entropy 0."""
    f = column_frequency(cell)
    used = (F.col("ch") != gap) if ignore_gaps else F.lit(True)
    if ignore_gaps and renormalise:
        whole = F.sum(F.when(used, F.col("n"))).over(Window.partitionBy("aln_id", "pos"))
        f = f.withColumn("freq", F.try_divide(F.col("n"), whole))
    h = -F.sum(F.when(used, F.col("freq") * F.log2("freq")).otherwise(0.0))
    return f.groupBy("aln_id", "pos").agg((h + F.lit(0.0)).alias("entropy"))


def map_unaligned_to_aligned(cell: DataFrame, gap: str = "-") -> DataFrame:
    """(aln_id, seq_id, ungapped, pos): where each residue of the ungapped sequence stands."""
    w = Window.partitionBy("aln_id", "seq_id").orderBy("pos")
    return cell.filter(F.col("ch") != gap).select("aln_id", "seq_id", (F.row_number().over(w) - 1).cast("int").alias("ungapped"), "pos")


def require_same_residues(unaligned: DataFrame, aligned: DataFrame) -> None:
    """Raise where an aligned sequence without gaps and stops isn't the unaligned one without stops."""
    clean = lambda c: F.replace(degap(F.upper(c)), F.lit("*"), F.lit(""))
    x = unaligned.select("seq_id", clean("seq").alias("u")).join(aligned.select("seq_id", clean("seq").alias("a")), "seq_id")
    bad = x.filter("u <> a").limit(1).collect()
    if bad:
        raise ValueError(f"aligned sequence {bad[0][0]} differs from its source")


def by_column_commonness(alignments: DataFrame, column: int) -> DataFrame:
    """Sequences with the rank of their symbol's commonness at one column, most common first, then by ord.

    A sequence that doesn't reach the column comes last."""
    ch = F.nullif(F.substring("seq", column + 1, 1), F.lit(""))
    x = alignments.withColumn("symbol", ch).withColumn("n", F.when(F.col("symbol").isNotNull(), F.count("symbol").over(Window.partitionBy("aln_id", "symbol"))))
    w = Window.partitionBy("aln_id").orderBy(F.col("n").desc_nulls_last(), "ord")
    return x.withColumn("place", F.row_number().over(w))


def align_by_motif(seqs: DataFrame, motif: str = "GGA", by: list[str] | None = None) -> DataFrame:
    """Pads so that first motif occurrences line up, then to one length.  A missing motif counts as at -1."""
    w = Window.partitionBy(*(by or []))
    at = F.instr("seq", motif) - 1
    shifted = F.concat(F.repeat(F.lit("-"), F.max(at).over(w) - at), F.col("seq"))
    x = seqs.withColumn("aligned", shifted)
    return x.withColumn("aligned", pad_right("aligned", F.max(F.length("aligned")).over(w)))


def alignment_stats(cell: DataFrame, ignored: tuple = ("-", ".", "?", "X")) -> DataFrame:
    """(aln_id, taxa, length, variable_sites, gap_percent)."""
    per = cell.groupBy("aln_id", "pos").agg(
        F.count("*").alias("n"), F.countDistinct(F.when(~F.col("ch").isin(*ignored), F.col("ch"))).alias("kinds"), F.count_if(F.col("ch").isin("-", ".")).alias("gaps")
    )
    return per.groupBy("aln_id").agg(
        F.max("n").alias("taxa"), F.count("*").alias("length"), F.count_if(F.col("kinds") > 1).alias("variable_sites"), (100.0 * F.sum("gaps") / F.sum("n")).alias("gap_percent")
    )


def identity_distances(alignments: DataFrame, gap: str = "-") -> DataFrame:
    """(aln_id, a, b, dist), a < b: 1 - identity over columns where neither has a gap; null where none."""
    x = alignments.select("aln_id", F.col("seq_id").alias("a"), symbols(F.upper("seq")).alias("ca"))
    y = alignments.select("aln_id", F.col("seq_id").alias("b"), symbols(F.upper("seq")).alias("cb"))
    pairs = x.join(y, (x["aln_id"] == y["aln_id"]) & (F.col("a") < F.col("b"))).drop(y["aln_id"])
    both = F.zip_with("ca", "cb", lambda p, q: F.when((p != gap) & (q != gap), F.when(p == q, 0).otherwise(1)))
    seen = F.filter(both, lambda v: v.isNotNull())
    differ = F.aggregate(seen, F.lit(0), lambda acc, v: acc + v)
    return pairs.select("aln_id", "a", "b", F.try_divide(differ.cast("double"), F.size(seen)).alias("dist"))


def model_distances(alignments: DataFrame, model: str = "identity", scores: DataFrame | None = None) -> DataFrame:
    """Pairwise distances of a model: identity, jc69 or k2p, or a substitution table scores(x, y, score).

    A table's distance is 1 - score of the pair over the larger self score, on columns without gaps."""
    if model == "identity":
        return identity_distances(alignments)
    c = cells(alignments).filter("ch <> '-'")
    x, y = c.select("aln_id", "pos", F.col("seq_id").alias("a"), F.col("ch").alias("x")), c.select("aln_id", "pos", F.col("seq_id").alias("b"), F.col("ch").alias("y"))
    both = x.join(y, ["aln_id", "pos"]).filter("a < b")
    if model in ("jc69", "k2p"):
        purine = lambda k: F.col(k).isin("A", "G")
        differ = F.col("x") != F.col("y")
        transition = differ & (purine("x") == purine("y"))
        g = both.groupBy("aln_id", "a", "b").agg(F.avg(differ.cast("double")).alias("p"), F.avg(transition.cast("double")).alias("ts"))
        tv = F.col("p") - F.col("ts")
        if model == "jc69":
            inner = 1 - F.col("p") * 4 / 3
            d = F.when(inner > 0, -0.75 * F.ln(inner)).otherwise(F.lit(float("inf")))
        else:
            u, v = 1 - 2 * F.col("ts") - tv, 1 - 2 * tv
            d = F.when((u > 0) & (v > 0), -0.5 * F.ln(u) - 0.25 * F.ln(v)).otherwise(F.lit(float("inf")))
        return g.select("aln_id", "a", "b", (d + F.lit(0.0)).alias("dist"))
    if scores is None:
        raise ValueError(f"model {model!r} needs a table of scores")
    s = F.broadcast(scores)  # an alphabet's square
    t = both.join(s, ["x", "y"]).join(s.select(F.col("x").alias("p"), F.col("y").alias("q"), F.col("score").alias("sx")), (F.col("x") == F.col("p")) & (F.col("x") == F.col("q"))).drop("p", "q")
    t = t.join(s.select(F.col("x").alias("p"), F.col("y").alias("q"), F.col("score").alias("sy")), (F.col("y") == F.col("p")) & (F.col("y") == F.col("q"))).drop("p", "q")
    g = t.groupBy("aln_id", "a", "b").agg(F.sum("score").alias("s"), F.greatest(F.sum("sx"), F.sum("sy")).alias("top"))
    return g.select("aln_id", "a", "b", (1 - F.try_divide(F.col("s").cast("double"), F.col("top"))).alias("dist"))


# ---- codons --------------------------------------------------------------------------------------------


def codon_cells(cell: DataFrame) -> DataFrame:
    """(aln_id, seq_id, codon_no from 0, codon): whole codons of the columns in threes."""
    w = F.array_sort(F.collect_list(F.struct("pos", "ch")))
    return cell.groupBy("aln_id", "seq_id", F.floor(F.col("pos") / 3).cast("int").alias("codon_no")).agg(F.array_join(F.transform(w, lambda x: x["ch"]), "").alias("codon"))


def trim_gap_rich_codons(cell: DataFrame, most: float = 0.8, gap: str = "-") -> DataFrame:
    """Cells of the codons of which at most this share of sequences has a gap anywhere."""
    c = codon_cells(cell).filter(F.length("codon") == 3)
    good = c.groupBy("aln_id", "codon_no").agg(F.avg(F.col("codon").contains(gap).cast("double")).alias("share")).filter(F.col("share") <= most)
    return cell.withColumn("codon_no", F.floor(F.col("pos") / 3).cast("int")).join(good.select("aln_id", "codon_no"), ["aln_id", "codon_no"], "left_semi").drop("codon_no")


def codon_sequence_qc(alignments: DataFrame, gap: str = "-") -> DataFrame:
    """Per sequence: length in threes, internal and final stops, split gap runs, ambiguous bases."""
    up = F.replace(F.upper("seq"), F.lit("U"), F.lit("T"))
    n = F.length(up)
    bare = degap(up)
    table = codon_map()
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int") - 1), lambda i: F.substring(up, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    amino = F.transform(three, lambda c: F.try_element_at(table, c))
    last = F.size(F.array_compact(amino))
    stops = F.size(F.filter(F.array_compact(amino), lambda a: a == "*"))
    ends = F.coalesce(F.try_element_at(F.array_compact(amino), F.greatest(last, F.lit(1))) == "*", F.lit(False))
    runs = F.regexp_extract_all(up, F.lit(f"({gap}+)"), F.lit(1))
    return alignments.select(
        "aln_id", "seq_id", n.alias("length"), (n % 3 == 0).alias("in_frame"), F.length(bare).alias("bases"),
        (stops - ends.cast("int")).alias("internal_stops"), ends.alias("final_stop"),
        F.size(F.filter(runs, lambda r: F.length(r) % 3 != 0)).alias("frame_breaking_gaps"),
        F.size(F.filter(three, lambda c: c.contains(gap) & (c != gap * 3))).alias("partial_gap_codons"),
        F.length(F.regexp_replace(bare, f"[{DNA}]", "")).alias("ambiguous_bases"),
    )


def codon_column_qc(cell: DataFrame, gap_rich: float = 0.8, gap: str = "-") -> DataFrame:
    """Per codon number from 1: start column from 1, gap share, distinct codons, flags."""
    c = codon_cells(cell).filter(F.length("codon") == 3)
    real = ~F.col("codon").contains(gap)
    g = c.groupBy("aln_id", "codon_no").agg(F.avg(F.col("codon").contains(gap).cast("double")).alias("gap_share"), F.countDistinct(F.when(real, F.col("codon"))).alias("kinds"))
    return g.select("aln_id", (F.col("codon_no") + 1).alias("codon"), (F.col("codon_no") * 3 + 1).alias("start_column"), "gap_share", "kinds",
                    (F.col("gap_share") >= gap_rich).alias("gap_rich"), (F.col("kinds") <= 1).alias("invariant"))


def codon_summary(alignments: DataFrame, gap_rich: float = 0.8) -> DataFrame:
    """Per alignment: fatal problems (unequal lengths, frame, internal stops) and warnings, with a verdict."""
    s = codon_sequence_qc(alignments).groupBy("aln_id").agg(
        F.count("*").alias("sequences"), F.countDistinct("length").alias("lengths"), F.count_if(~F.col("in_frame")).alias("out_of_frame"),
        F.count_if(F.col("internal_stops") > 0).alias("with_internal_stops"), F.count_if(F.col("frame_breaking_gaps") > 0).alias("with_frame_breaking_gaps"),
        F.count_if(F.col("ambiguous_bases") > 0).alias("with_ambiguous_bases"),
    )
    c = codon_column_qc(cells(alignments), gap_rich).groupBy("aln_id").agg(F.count("*").alias("codons"), F.count_if("gap_rich").alias("gap_rich_codons"))
    x = s.join(c, "aln_id", "left")
    fatal = (F.col("lengths") > 1) | (F.col("out_of_frame") > 0) | (F.col("with_internal_stops") > 0)
    warn = (F.col("with_frame_breaking_gaps") > 0) | (F.col("with_ambiguous_bases") > 0) | (F.col("gap_rich_codons") > 0)
    return x.withColumn("verdict", F.when(fatal, "fatal").when(warn, "warning").otherwise("ok"))


def summary_text(summary: DataFrame) -> DataFrame:
    """One line of text per alignment."""
    return summary.select("aln_id", F.format_string("%s: %s; %d sequences, %d codons, %d gap-rich", "aln_id", "verdict", "sequences", "codons", "gap_rich_codons").alias("text"))


# ---- supermatrix ---------------------------------------------------------------------------------------


def supermatrix_partitions(alignments: DataFrame) -> DataFrame:
    """(aln_id, start, end, sites, taxa_present), columns from 1, alignments in the order of their ids."""
    g = alignments.groupBy("aln_id").agg(F.max(F.length("seq")).alias("sites"), F.countDistinct("seq_id").alias("taxa_present"))
    end = F.sum("sites").over(Window.orderBy("aln_id").rowsBetween(Window.unboundedPreceding, 0))  # a row per locus
    return g.select("aln_id", (end - F.col("sites") + 1).alias("start"), end.alias("end"), "sites", "taxa_present")


def supermatrix(alignments: DataFrame, taxa: DataFrame | None = None, gap: str = "-") -> DataFrame:
    """(seq_id, seq): loci in the order of their ids, an absent taxon as gaps of the locus's length."""
    names = (taxa or alignments).select("seq_id").distinct()
    loci = alignments.groupBy("aln_id").agg(F.max(F.length("seq")).alias("sites"))
    x = names.crossJoin(loci).join(alignments.select("aln_id", "seq_id", "seq"), ["aln_id", "seq_id"], "left")
    filled = F.coalesce("seq", F.expr(f"repeat('{gap}', sites)"))
    parts = F.array_sort(F.collect_list(F.struct("aln_id", filled.alias("seq"))))
    return x.groupBy("seq_id").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))


# ---- logos and composition -----------------------------------------------------------------------------


def logo_matrix(cell: DataFrame, molecule: str = "dna", kind: str = "bit") -> DataFrame:
    """(aln_id, pos from 1, ch, value): frequencies with gaps in the denominator, or those times the
    column's information (log2 of the alphabet's size less its entropy, 0 log 0 as 0)."""
    alphabet = list({"dna": DNA, "rna": "ACGU", "prot": AMINO_ACIDS}[molecule])
    f = frequency_with_zeros(cell, alphabet, keep_others=False)
    if kind == "frequency":
        return f.select("aln_id", (F.col("pos") + 1).alias("pos"), "ch", F.col("freq").alias("value"))
    h = -F.sum(F.when(F.col("freq") > 0, F.col("freq") * F.log2("freq")).otherwise(0.0)).over(Window.partitionBy("aln_id", "pos"))
    return f.select("aln_id", (F.col("pos") + 1).alias("pos"), "ch", (F.col("freq") * (F.log2(F.lit(float(len(alphabet)))) - h) + F.lit(0.0)).alias("value"))


def composition_chi2(cell: DataFrame, alphabet: str = AMINO_ACIDS, with_p: bool = True) -> DataFrame:
    """Per sequence: share of gaps and ambiguous symbols, and the chi-square distance of its composition from
    all sequences' (expected by overall frequency; degrees of freedom: alphabet less one)."""
    letters = list(alphabet)
    known = cell.filter(F.col("ch").isin(letters))
    total = known.groupBy("aln_id", "ch").agg(F.count("*").alias("all"))
    total = total.withColumn("share", F.col("all") / F.sum("all").over(Window.partitionBy("aln_id"))).select("aln_id", "ch", "share")
    own = known.groupBy("aln_id", "seq_id").agg(F.count("*").alias("n"))
    seen = known.groupBy("aln_id", "seq_id", "ch").agg(F.count("*").alias("o"))
    x = own.join(total, "aln_id").join(seen, ["aln_id", "seq_id", "ch"], "left")
    e = F.col("n") * F.col("share")
    chi = x.groupBy("aln_id", "seq_id").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - e, F.lit(2)) / e).alias("chi2"))
    gaps = cell.groupBy("aln_id", "seq_id").agg(F.avg((~F.col("ch").isin(letters)).cast("double")).alias("gap_ambiguity_share"))
    out = gaps.join(chi, ["aln_id", "seq_id"], "left")
    return out.withColumn("p", chi_square_upper("chi2", F.lit(float(len(letters) - 1)))) if with_p else out


def passes_composition(report: DataFrame, most_gaps: float = 0.5, least_p: float = 0.05) -> DataFrame:
    return report.withColumn("passes", (F.col("gap_ambiguity_share") <= most_gaps) & (F.coalesce("p", F.lit(1.0)) >= least_p))


def ungapped_length(seq) -> Column:
    return F.length(degap(seq))
