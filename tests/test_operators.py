"""Operators on hand-made fixtures, with mirrors in NumPy where numbers matter."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import maths, sequence
from strandframe.operators import alignment, ancestral, cluster, expression, genome, information, kmers, newick, plotdata, structure, tables, tree
from strandframe.plans import tools


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def aln(spark):
    return spark.createDataFrame([("x", "a", "AC-T"), ("x", "b", "AC-T"), ("x", "c", "AG-A")], "aln_id string, seq_id string, seq string")


def test_alignment(spark, aln):
    c = alignment.cells(aln)
    assert dict((r.pos, r.freq) for r in alignment.column_frequency(c).filter("ch = '-'").collect()) == {2: 1.0}
    assert rows(alignment.rejoin(alignment.drop_gappy_columns(c)), "seq") == [("ACT",), ("ACT",), ("AGA",)]
    e = {r.pos: r.entropy for r in alignment.column_entropy(c).collect()}
    assert e[1] == pytest.approx(0.9182958) and e[2] == 0
    assert rows(alignment.columns_where(c, "-", ">=", 1.0), "pos") == [(2,)]
    assert rows(alignment.renumber(alignment.drop_gappy_columns(c)).select("pos").distinct(), "pos") == [(0,), (1,), (2,)]
    s = alignment.alignment_stats(c).first()
    assert (s.taxa, s.length, s.variable_sites, s.gap_percent) == (3, 4, 2, 25.0)
    d = {(r.a, r.b): r.dist for r in alignment.identity_distances(aln).collect()}
    assert d[("a", "b")] == 0 and d[("a", "c")] == pytest.approx(2 / 3)
    p = {(r.a, r.b): r.dist for r in alignment.model_distances(aln, "jc69").collect()}
    assert p[("a", "b")] == 0 and p[("a", "c")] == pytest.approx(-0.75 * math.log(1 - 2 / 3 * 4 / 3))


def test_gap_threshold_edges(spark):
    x = spark.createDataFrame([("x", str(i), "A-" if i < 4 else "AC") for i in range(5)], "aln_id string, seq_id string, seq string")
    c = alignment.cells(x)
    assert alignment.drop_gappy_columns(c, 0.8, "<").filter("pos = 1").count() == 0
    assert alignment.drop_gappy_columns(c, 0.8, "<=").filter("pos = 1").count() == 5


def test_codons(spark):
    x = spark.createDataFrame([("x", "a", "ATGTAAGCC"), ("x", "b", "ATG--AGCN")], "aln_id string, seq_id string, seq string")
    q = {r.seq_id: r for r in alignment.codon_sequence_qc(x).collect()}
    assert q["a"].internal_stops == 1 and not q["a"].final_stop and q["b"].frame_breaking_gaps == 1 and q["b"].ambiguous_bases == 1
    assert alignment.codon_summary(x).first().verdict == "fatal"
    assert rows(alignment.rejoin(alignment.trim_gap_rich_codons(alignment.cells(x), 0.4)), "seq") == [("ATGGCC",), ("ATGGCN",)]


def test_supermatrix_and_logo(spark):
    x = spark.createDataFrame([("l1", "a", "AC"), ("l1", "b", "AG"), ("l2", "a", "TTT")], "aln_id string, seq_id string, seq string")
    assert rows(alignment.supermatrix(x), "seq_id", "seq") == [("a", "ACTTT"), ("b", "AG---")]
    assert rows(alignment.supermatrix_partitions(x), "aln_id", "start", "end", "taxa_present") == [("l1", 1, 2, 2), ("l2", 3, 5, 1)]
    bits = {(r.pos, r.ch): r.value for r in alignment.logo_matrix(alignment.cells(x.filter("aln_id = 'l1'"))).collect()}
    assert bits[(1, "A")] == 2.0 and bits[(2, "C")] == 0.5


def test_motif_and_commonness(spark):
    x = spark.createDataFrame([("x", "a", "GGAT", 0), ("x", "b", "CCGGA", 1), ("x", "c", "T", 2)], "aln_id string, seq_id string, seq string, ord int")
    assert rows(alignment.align_by_motif(x, "GGA"), "aligned") == [("---T--",), ("--GGAT",), ("CCGGA-",)]
    assert rows(alignment.by_column_commonness(x, 2), "place", "seq_id")[2] == (3, "c")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ACGTRYKMSWBDHVN", max_size=12), min_size=1, max_size=4))
def test_reverse_complement_twice(spark, seqs):
    x = spark.createDataFrame([(s,) for s in seqs], "s string")
    r = x.select("s", sequence.reverse_complement(sequence.reverse_complement("s")).alias("r")).collect()
    assert all(a.s == a.r for a in r)


def test_sequence_functions(spark):
    x = spark.createDataFrame([("ATGRuu",)], "s string")
    r = x.select(sequence.rna_to_dna("s").alias("d"), sequence.degenerate_regex("s").alias("p"), F.sort_array(sequence.expand_degenerate(F.lit("AR"))).alias("e"), sequence.translate_codons(F.lit("ATG---TAAGC")).alias("t")).first()
    assert (r.d, r.p, r.e, r.t) == ("ATGRTT", "ATG[AG]TT", ["AA", "AG"], "M-*")
    with pytest.raises(Exception, match="IUPAC"):
        x.select(sequence.reverse_complement(F.lit("AC-"))).collect()
    assert x.select(sequence.reverse_complement_lenient(F.lit("aC-")).alias("r")).first().r == "-Gt"
    assert x.select(sequence.pad_right(F.lit("abc"), 2).alias("r")).first().r == "abc"
    assert x.select(sequence.accession_of_protein(F.lit("GCA_000001_1_prot")).alias("r")).first().r == "GCA_000001_1_p".replace("_1_p", "_1.p") + "r"
    assert x.select(sequence.hex_colour(F.lit(1.0), F.lit(0.5), F.lit(0.0)).alias("r")).first().r == "#FF8000"


def test_kmers(spark):
    x = spark.createDataFrame([("ACGA",), ("AC",), ("",)], "seq string")
    n = {r.kmer: r.n for r in kmers.count_kmers(x, 2).collect()}
    assert n["AC"] == 2 and n["GA"] == 1 and n["UU"] == 0 and len(n) == 16
    assert sum(n.values()) == sum(max(0, len(s) - 1) for s in ("ACGA", "AC", ""))
    e = {r.kmer: r.enrichment for r in kmers.enriched_kmers(x, [2], log=True).collect()}
    assert e["UU"] == -math.inf and e["AC"] == pytest.approx(math.log2(2 / (4 / 16)))


def test_primers_and_structure(spark):
    s = spark.createDataFrame([("s", "ttACGTTTTTTGGCAtt")], "seq_id string, seq string")
    assert rows(genome.amplicons(s, "AC", "GC", 5, 20), "start", "end", "length", "amplicon") == [(2, 14, 12, "ACGTTTTTTGGC")]
    f = spark.createDataFrame([("h", "ggGGGAAAACCCCgg", "..(((....))))..")], "id string, seq string, structure string")
    assert rows(structure.hairpins(f), "start", "end") == [(2, 12)]
    assert rows(structure.loops(f), "start", "end", "loop_seq") == [(5, 8, "AAAA")]
    assert structure.smith_waterman("ACGT", "TTACGTTT") == (8.0, 2, 6)
    assert structure.smith_waterman("ACGT", "") == (0.0, 0, 0)


def test_weighted_mi_and_bh(spark):
    x = spark.createDataFrame([(a, b, 1.0) for a, b in zip("AACC", "KKRR")], "x string, y string, w double")
    assert information.weighted_mi(x).first().mi == pytest.approx(1.0)
    y = spark.createDataFrame([(a, b, 1.0) for a, b in zip("AACC", "KRKR")], "x string, y string, w double")
    assert information.weighted_mi(y).first().mi == 0
    assert information.weighted_mi(x.limit(1)).first().mi == 0
    p = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "id int, p double")
    assert [round(r[1], 9) for r in rows(information.benjamini_hochberg(p), "id", "q")] == [0.04, 0.04, 0.04, 0.5]


def test_permutations(spark):
    c = spark.createDataFrame([(f"s{i}", 0, "ACGT"[i % 4]) for i in range(8)], "seq_id string, pos int, ch string")
    p = spark.createDataFrame([(f"s{i}", 0, "KRLE"[i % 4]) for i in range(8)], "seq_id string, pos int, ch string")
    w = spark.createDataFrame([(f"s{i}", 1.0, i % 2) for i in range(8)], "seq_id string, weight double, g int")
    perm = information.shuffled_within(w, "g", 3, 5)
    assert perm.count() == 40 and perm.groupBy("perm_id").agg(F.countDistinct("partner").alias("k")).filter("k <> 8").count() == 0
    r = information.permutation_test(c, p, w, perm).first()
    assert r.mi == pytest.approx(2.0) and 0 < r.p <= 1 and r.q >= r.p and 0 < r.fwer_p <= 1


def test_permutation_ties(spark):
    """Partners of one base and one residue change no value, in whatever order their weights are added."""
    n = 60
    c = spark.createDataFrame([(i, 0, "AC"[i % 2]) for i in range(n)], "seq_id int, pos int, ch string")
    p = spark.createDataFrame([(i, 0, "KR"[i % 2] if i % 6 else "E") for i in range(n)], "seq_id int, pos int, ch string")
    w = spark.createDataFrame([(i, 0.1 + (i * 0.377) % 1) for i in range(n)], "seq_id int, weight double")
    perm = spark.createDataFrame([(k, i, (i + 6 * k) % n) for k in range(1, 9) for i in range(n)], "perm_id int, seq_id int, partner int")
    r = information.permutation_test(c, p, w, perm).first()
    assert r.p == r.fwer_p == 1


def test_special_functions():
    assert maths.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)
    assert maths.upper_gamma(1, 2.0) == pytest.approx(math.exp(-2))
    assert maths.upper_gamma(0.5, 1.92072941) == pytest.approx(0.05, abs=1e-4)


def test_expression(spark):
    rng = np.random.default_rng(0)
    data = [(f"g{g}", f"s{s}", float(rng.integers(1, 100)) + (200 if g == 0 and s < 2 else 0)) for g in range(4) for s in range(4)]
    n = spark.createDataFrame(data, "gene string, sample string, n double")
    assert all(r[1] == pytest.approx(1e6) for r in rows(expression.reads_per_million(n).groupBy("sample").agg(F.sum("rpm").alias("t")), "sample", "t"))
    samples = spark.createDataFrame([(f"s{s}", "t", "u" if s < 2 else "r") for s in range(4)], "sample string, variable string, value string")
    con = spark.createDataFrame([("c", "t", "u", "r")], "id string, variable string, up string, reference string")
    stats = {r.gene: r for r in expression.contrast_stats(expression.contrast_values(n, samples, con)).collect()}
    v = {(r.gene, r.sample): r.rpm for r in expression.reads_per_million(n).collect()}
    a, b = np.array([v["g0", "s0"], v["g0", "s1"]]), np.array([v["g0", "s2"], v["g0", "s3"]])
    t = (a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2 * (1 / 2 + 1 / 2))
    assert stats["g0"].t == pytest.approx(t) and stats["g0"].pval == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t))


def test_tables(spark):
    f = spark.createDataFrame([("CDS", None, "t1", "p1"), ("CDS", None, "g2", "p2"), ("CDS", None, "g9", "p1"), ("mRNA", "t1", "g1", None)], "type string, id string, parent string, protein_id string")
    assert rows(tables.resolve_genes(f), "protein_id", "gene_id") == [("p2", "g2")]
    t = spark.createDataFrame([("a", "b1", "Complete", "s", 5.0), ("a", "b1", "Duplicated", "s", 4.0), ("c", "b2", "Complete", "s", 1.0)], "assembly string, busco_id string, status string, sequence string, score double")
    long = tables.status_long(tables.collapse_statuses(t))
    assert rows(long, "busco_id", "assembly", "status") == [("b1", "a", "Duplicated"), ("b1", "c", "Missing"), ("b2", "a", "Missing"), ("b2", "c", "Complete")]
    assert rows(tables.select_markers(long, 1, ["c"]).filter("selected"), "busco_id") == [("b2",)]
    with pytest.raises(ValueError):
        tables.select_markers(long, 3)
    with pytest.raises(ValueError, match="repeated"):
        tables.union_unique([spark.createDataFrame([("a", "x")], "seq_id string, seq string")] * 2)
    m = spark.createDataFrame([(1, 1, "root"), (2, 1, "phylum"), (3, 2, "genus")], "taxid int, parent int, rank string")
    assert rows(tables.lineage_ranks(m, 3), "rank", "taxid") == [("genus", 3), ("phylum", 2), ("root", 1)]


def test_genome(spark):
    g = spark.createDataFrame([("g1", "c", 3, 5, "+"), ("g2", "c", 8, 10, "-"), ("g3", "c", 14, 16, "+")], "gene_id string, contig string, start long, end long, strand string")
    c = spark.createDataFrame([("c", "AACCGGTTACGTTTGCAA")], "seq_id string, seq string")
    assert rows(genome.start_windows(g, c, 2, 3), "gene_id", "region") == [("g1", "AACCG"), ("g2", "ACGTA"), ("g3", "TTTGC")]
    pairs = genome.divergent_pairs(g)
    assert rows(genome.intergenic_sequences(pairs, c), "left_gene", "right_gene", "region") == [("g2", "g3", "GTT")]
    far = {r.gene_id: (r.before, r.after) for r in genome.neighbour_clearance(g).collect()}
    assert far["g1"] == (math.inf, 9.0) and far["g2"] == (math.inf, math.inf)
    assert rows(genome.flip_block(g), "gene_id", "start", "end", "strand")[2] == ("g3", 0, 2, "-")
    cov = spark.createDataFrame([("c", p, "+", float(p)) for p in range(1, 20)], "contig string, pos int, strand string, n double")
    assert genome.coverage_windows(g, cov, 1, 1).filter("gene_id = 'g1'").count() == 5
    assert rows(genome.neighbourhood(g, "g2", 1), "gene_id") == [("g1",), ("g2",)]
    d = spark.range(1).select(maths.shortest_distance(F.lit(1), F.lit(5), F.lit(9), F.lit(12)).alias("a"), maths.shortest_distance(F.lit(1), F.lit(5), F.lit(5), F.lit(9)).alias("b")).first()
    assert (d.a, d.b) == (4, 0)


def test_coverage_windows_of_large_groups(spark, monkeypatch):
    """All rows come, with null and repeated counts, whatever genes and counts a task or a row may hold."""
    r = np.random.default_rng(7)
    g = [(i, int(r.integers(2)), "+-"[i % 2], s, s + int(r.integers(60))) for i, s in enumerate(map(int, r.integers(1, 300, 80)))] + [(99, 0, "+", None, 5)]
    c = [(int(r.integers(2)), int(r.choice([50, r.integers(-20, 400)])), "+-"[i % 2], None if i % 9 == 0 else float(r.integers(4))) for i in range(500)] + [(0, None, "+", 1.0), (None, 50, "+", 1.0)]
    genes = spark.createDataFrame(g, "gene_id long, contig long, strand string, start long, end long")
    coverage = spark.createDataFrame(c, "contig long, pos long, strand string, n double")
    want = sorted(((a, pos, n) for a, k, s, lo, hi in g if lo for contig, pos, strand, n in c if pos is not None and contig == k and strand == s and lo - 10 <= pos <= hi + 10), key=repr)
    for width, most, counts in ((None, (genome.GENES, genome.BIN_COUNTS), genome.COUNTS), (None, (3, 5), 4), (1000, (7, 11), 1)):
        monkeypatch.setattr(genome.counts_by_position, "__defaults__", (counts,))
        assert genome.counts_by_position(coverage).filter(F.size("counts") > counts).isEmpty()
        got = genome.coverage_windows(genes, coverage, 10, 10, width, most)
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_coverage_windows_come_in_runs(spark, tmp_path):
    """The rows of copies take little of a file: a gene's stand together, and in them a position's and a count's."""
    k = spark.range(40).select(F.col("id").alias("copy"))
    g = spark.range(40).crossJoin(k).select((F.col("id") + 40 * F.col("copy")).alias("gene_id"), F.lit(1).alias("contig"), F.lit("+").alias("strand"), (F.col("id") * 37 % 300 + 1).alias("start"), (F.col("id") * 37 % 300 + 91).alias("end"))
    c = spark.range(400).crossJoin(k).select(F.lit(1).alias("contig"), (F.col("id") * 13 % 520).alias("pos"), F.lit("+").alias("strand"), (F.xxhash64("id") % 9973 / 100).alias("n"))
    x = genome.coverage_windows(g.repartition(5), c.repartition(7))
    x.write.parquet(f"{tmp_path}/x")
    size = sum(p.stat().st_size for p in (tmp_path / "x").glob("*.parquet"))
    assert size < 0.1 * spark.read.parquet(f"{tmp_path}/x").count()


def test_coverage_windows_of_differing_counts(spark, tmp_path):
    """Counts of which hardly two are alike take little of a file too, and lists that are cut for it lose no row."""
    g = spark.range(600).select(F.col("id").alias("gene_id"), F.lit(1).alias("contig"), F.lit("+").alias("strand"), (F.col("id") * 37 % 300 + 1).alias("start"), (F.col("id") * 37 % 300 + 91).alias("end"))
    c = spark.range(40 * 117).select(F.lit(1).alias("contig"), (F.col("id") % 40 * 13).alias("pos"), F.lit("+").alias("strand"), F.when(F.col("id") % 500 > 0, F.xxhash64("id") % 99991 / 100).alias("n"))
    cut = genome.counts_by_position(c)
    assert {(r.rest > 0, r.k) for r in cut.select("rest", F.size("counts").alias("k")).collect()} == {(False, 112), (True, 1)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        genome.coverage_windows(g.repartition(5), c.repartition(7)).write.parquet(f"{tmp_path}/x")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    x = spark.read.parquet(f"{tmp_path}/x")
    want = g.join(c, ["contig", "strand"]).filter("pos between start - 100 and end + 100")
    of_all = [F.count("*"), F.count("n"), F.sum(F.xxhash64("gene_id", "pos", "n").cast("decimal(20, 0)"))]
    assert x.agg(*of_all).first() == want.agg(*of_all).first()
    size = sum(p.stat().st_size for p in (tmp_path / "x").glob("*.parquet"))
    assert size < 0.3 * x.count()


def test_clusters(spark):
    e = spark.createDataFrame([("x", "a", "b", 0.01), ("x", "b", "c", 0.02), ("x", "a", "c", 0.03), ("x", "c", "d", 0.5), ("x", "a", "d", 0.5), ("x", "b", "d", 0.5)], "aln_id string, a string, b string, dist double")
    assert rows(cluster.single_linkage(e, 0.98), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert rows(cluster.upgma_clusters(e, 0.1), "genome", "cluster") == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    assert cluster.upgma_newick(e).first().newick == "(d:0.500000,(c:0.025000,(a:0.010000,b:0.010000):0.015000):0.475000);"
    m = spark.createDataFrame([(x, 1) for x in "abc"], "id string, cluster int")
    assert rows(cluster.medoids(e, m), "id") == [("b",)]
    assert cluster.full_matrix(e).count() == 16


TREE = "((A:1,B:2)90/96:1,(C:1,D:1)70/99:1);"


def trees(spark, *texts):
    return tree.parse_newick(spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "tree_id string, newick string"))


def test_trees(spark):
    t = trees(spark, TREE)
    assert tree.to_newick(t).first().newick == TREE
    assert rows(tree.root_to_tip(t), "name", "distance") == [("A", 2.0), ("B", 3.0), ("C", 2.0), ("D", 2.0)]
    assert tree.to_newick(tree.collapse_weak(t)).first().newick == "((A:1,B:2)90/96:1,C:2,D:2);"
    assert tree.to_newick(tree.prune_to(t, {"A", "C", "D"})).first().newick == "(A:2,(C:1,D:1)70/99:1);"
    kept = spark.createDataFrame([("A",), ("C",), ("D",), ("Z",)], "seq_id string")
    assert tree.to_newick(tree.prune_to_sequences(t, kept)).first().newick == "(A:2,(C:1,D:1)70/99:1);"
    c = tree.ancestors(t)
    tips = spark.createDataFrame([("t0", "A"), ("t0", "B")], "tree_id string, name string")
    assert tree.common_ancestor(t, c, tips).first().anc_id == 1
    targets = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    assert rows(tree.monophyletic_ancestors(t, c, targets), "node_id") == [(1,), (5,)]
    a = tree.id_agreement(t, kept).first()
    assert (a.tips, a.ids, a.only_tips, a.only_ids) == (4, 4, ["B"], ["Z"])
    s = t.select(tree.branch_support("label").alias("s")).filter("s is not null").orderBy("s.alrt").collect()
    assert [r.s.alrt for r in s] == [70.0, 90.0]
    new = spark.createDataFrame([(x, f"n_{x}") for x in "ABCD"], "name string, new_name string")
    assert "n_A" in tree.to_newick(tree.rename_tips(t, new)).first().newick
    with pytest.raises(ValueError):
        tree.rename_tips(t, new.limit(1))
    assert tree.to_newick(tree.reverse_children(t, ["90/96"])).first().newick.startswith("((B:2,A:1)")


def test_rf_consensus_and_rooting(spark):
    t = trees(spark, "((A,B),(C,(D,E)));", "((A,C),(B,(D,E)));", "((A,B),(C,(D,E)));")
    assert rows(tree.rf_distances(t), "a", "b", "rf") == [("t0", "t1", 0.5), ("t0", "t2", 0.0), ("t1", "t2", 0.5)]
    assert tree.discordance(tree.rf_distances(t)).filter("tree_id = 't1'").first().max_rf == 0.5
    n = tree.to_newick(tree.consensus(t)).first().newick
    assert newick.robinson_foulds(newick.parse(n), newick.parse("((A,B),(C,(D,E)));")) == 0
    assert tree.to_newick(tree.root_on_outgroup(trees(spark, TREE), {"C", "D"})).first().newick.count("(") == 3
    with pytest.raises(Exception, match="clade"):
        tree.root_on_outgroup(trees(spark, TREE), {"A", "C"}).collect()
    assert newick.reconcile(newick.parse("((a1,a2),b);"), newick.parse("(A,B);"), lambda x: x[0].upper()) == (1, 0)
    assert newick.reconcile(newick.parse("((a,b),c);"), newick.parse("((A,B),C);"), str.upper) == (0, 0)
    g = tree.reconciliation(trees(spark, "((a,b),c);"), "((A,B),C);", {"a": "A", "b": "B", "c": "C"})
    assert g.filter("optimal").agg(F.min("cost").alias("m")).first().m == 0
    assert newick.robinson_foulds(newick.parse("(A,B,C);"), newick.parse("(A,B,C);")) is None


def test_ancestral(spark):
    s = spark.createDataFrame([("N1", 1, "A", 0.9, 0.1), ("N1", 2, "C", 0.2, 0.7)], "Node string, Site int, State string, p_A double, p_C double")
    assert rows(ancestral.node_sequences(s, threshold=0.7), "seq") == [("AX",)]
    clade = spark.createDataFrame([("x", "a", "A-"), ("x", "b", "A-")], "aln_id string, seq_id string, seq string")
    assert ancestral.gapped_sequence(s, "N1", clade).first().seq == "A-"


def test_plot_data(spark):
    x = spark.createDataFrame([(float(i),) for i in (0, 1, 1, 150)], "v double")
    assert rows(plotdata.overflow_histogram(x, "v"), "bin", "n") == [("0", 1), ("1", 2), (">100", 1)]
    k = plotdata.kernel_density(x.withColumn("g", F.lit(1)), "v", "g")
    assert k.count() == 4 and k.filter("density > 0").count() == 4


def test_tools():
    t = tools.TOOLS
    assert t["mafft"].argv({"auto": True, "thread": 4, "quiet": None}, input="in.fa") == ["mafft", "--auto", "--thread", "4", "in.fa"]
    with pytest.raises(ValueError, match="no option"):
        t["mafft"].argv({"nonsense": 1}, input="x")
    assert t["hmmscan"].argv({"E": 1e-5, "cut_ga": True, "dom_E": 3}, table="t", domains="d", raw="r", database="db", input="q")[7:] == ["-E", "1e-05", "--cut_ga", "--dom-E", "3", "db", "q"]
    assert t["iqtree_ancestral"].argv({"rlen": [0.1, 1], "B": 1000}, input="a", model="MFP", threads=2, prefix="p")[-6:] == ["--ancestral", "--rlen", "0.1", "1", "-B", "1000"]
    assert t["busco"].argv({"force": True}, input="i", name="n", output="o", lineage="l", cpu=8)[-1] == "--force"
    assert tools.outgroup_option("a, b,a") == "a,b" and tools.outgroup_option(None) is None
    assert "seqfile = s" in tools.codeml_control("s", "t", "o")
    with pytest.raises(ValueError):
        tools.reconciliation_families(["a"], [], [])
    assert tools.available("no-such-program") == {"no-such-program": None}


def test_stream(spark, sf, tmp_path):
    from strandframe.streaming import events

    src = spark.read.parquet(f"{sf}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes)
    got = events.tumbling(events.event_stream(spark, str(tmp_path / "in"), schema, "1 day"), "1 day")
    events.run_to_table(got, str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.count() <= events.tumbling(src, "1 day").count()


def test_pipelines_and_files(tmp_path, spark):
    from strandframe.plans import numbering, pipelines
    from strandframe.sources import readers, sinks

    steps = pipelines.reciprocal_search({"b": "b.faa", "a": "a.faa"}, "q.faa", "r.faa", str(tmp_path))
    assert [s[0] for s in steps] == ["makeblastdb"] * 3 + ["blastp"] * 4
    assert len(pipelines.marker_gene_tree({"a": "a.faa"}, ["m1", "m2"], str(tmp_path / "new"), "db.hmm")) == 5
    with pytest.raises(FileExistsError):
        pipelines.marker_gene_tree({}, [], str(tmp_path), "db.hmm")
    assert len(pipelines.status_runs({"a": "a.faa"}, str(tmp_path), "l")) == 1 and len(pipelines.gene_trees({"l": "l.fa"}, str(tmp_path))) == 1
    for a in ("x", "y"):
        (tmp_path / "in" / a).mkdir(parents=True)
    (tmp_path / "in" / "x" / "p.faa").write_text(">a\nA")
    assert sinks.copy_per_accession(str(tmp_path / "in"), str(tmp_path / "out")) == ["y"] and (tmp_path / "out" / "x.faa").exists()
    assert sinks.concatenate_files(str(tmp_path / "out"), str(tmp_path / "all.faa"), ".faa") == 1
    n = numbering.numbered(spark.range(1000).withColumn("k", (F.col("id") * 7919) % 1009), [F.col("k"), F.col("id")]).collect()
    assert [r.nth for r in sorted(n, key=lambda r: (r.k, r.id))] == list(range(1, 1001))
    r = spark.createDataFrame([("@a", "ACGT")], "read_id string, seq string")
    assert readers.reads_alignment(r, 1, 3).first().seq == "CG"
