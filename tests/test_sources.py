"""Readers and writers on small hand-made files."""

import gzip

import pytest

from strandframe.sources import readers as R
from strandframe.sources import sinks as W


def put(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1 d > x\nacg\nTTT\n\n>s2\nGG GG\n")
    assert rows(R.read_fasta(spark, p), "seq_id", "seq") == [("s1", "ACGTTT"), ("s2", "GGGG")]
    assert rows(R.read_fasta(spark, p, full_header=True), "seq_id")[0] == ("s1 d > x",)
    two = put(tmp_path, "b.fa", ">a b c\nAc\n>a d\nGg\n")
    assert rows(R.read_fasta_two_words(spark, two), "seq_id", "seq") == [("a_b", "Ac"), ("a_d", "Gg")]
    again = put(tmp_path, "c.fa", ">a\nA\n>a\nC\n")
    assert rows(R.read_fasta(spark, again), "seq") == [("C",)]
    with pytest.raises(Exception, match="no FASTA header"):
        R.read_fasta(spark, put(tmp_path, "d.fa", "ACGT\n")).collect()
    z = tmp_path / "e.fa.gz"
    z.write_bytes(gzip.compress(b">z\nac\ngt\n"))
    assert rows(R.read_fasta(spark, str(z)), "seq_id", "seq") == [("z", "ACGT")]


def test_fasta_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("a", "ACGTAC", 0), ("b", "GG", 1)], "seq_id string, seq string, ord long")
    W.write_fasta(x, str(tmp_path / "out"), width=4)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text == ">a\nACGT\nAC\n>b\nGG\n"
    W.write_phylip(x.filter("seq_id = 'a'"), str(tmp_path / "phy"))
    assert "".join(p.read_text() for p in (tmp_path / "phy").glob("part*")) == "1 6\na  ACGTAC\n"


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "r.fq", "@a x\nACG\n+\nIII\n@b\nGG\n+\nII\n\n@c\nT\n+\nI\n")
    r = R.read_fastq(spark, p)
    assert rows(r, "read_id", "length", "seq", "quality") == [("@a", 3, "ACG", "III"), ("@b", 2, "GG", "II")]
    assert R.sample_reads(r, 10).count() == 2 and R.sample_reads(r, 1).count() == 1
    a, b = R.sample_mates(r, r, 1)
    assert rows(a, "ord") == rows(b, "ord")


GFF = """##gff-version 3
#!genome-build B1
##species S9
c1\tx\tregion\t1\t900\t.\t+\t.\tID=r1;mol=dna
c1\tx\tgene\t1\t90\t.\t+\t.\tID=gene-g1;Name=abc
c1\tx\tCDS\t1\t50\t.\t+\t0\tID=cds-p1;Parent=gene-g1;product=a=b%2Cc+d
c1\tx\tCDS\t60\t90\t.\t+\t0\tID=cds-p1;Parent=gene-g1;product=late;flag
c1\tx\tgene\t100\t190\t.\t-\t.\tName=no_id
"""


def test_gff(spark, tmp_path):
    p = put(tmp_path, "a.gff", GFF)
    genes = R.read_gff(spark, p, "gene")
    assert rows(genes, "id", "start", "end") == [("gene-g1", 1, 90)]
    cds = R.read_gff(spark, p, "CDS")
    assert rows(cds, "start") == [(60,)]
    first = R.read_gff(spark, p, "CDS", keep="all", decode=True).select("start", R.attribute("product").alias("product"))
    assert rows(first, "start", "product") == [(1, "a=b,c+d"), (60, "late")]
    s = R.gff_summary(spark, p).first()
    assert (s.build, s.species) == ("B1", "S9") and set(s.regions) == {"c1"}
    assert rows(R.simple_annotation(cds, genes, True), "gene_id", "common_name", "product", "start") == [("gene-g1", "abc", "late", 60)]
    assert rows(R.saf(genes), "GeneID") == [("g1",)]
    changed = R.change_attribute(genes, spark.createDataFrame([("gene-g1", "new")], "id string, value string"), "Name")
    assert "Name=new" in W.gff_lines(changed).first().value
    with pytest.raises(Exception, match="too few fields"):
        R.read_gff(spark, put(tmp_path, "bad.gff", "c1\tx\tgene\n")).collect()
    assert R.read_gff(spark, put(tmp_path, "bad2.gff", "c1\tx\tgene\n"), strict=False).count() == 0


def test_gtf(spark, tmp_path):
    p = put(tmp_path, "a.gtf", 'c1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "g1"; gene_name "a b"; n 3;\n')
    r = R.read_gtf(spark, p).first()
    assert (r.id, r.attributes["gene_name"], r.attributes["n"]) == ("g1", "a b", "3")


GBK = """LOCUS       NC_1 100 bp
VERSION     NC_1.2
FEATURES             Location/Qualifiers
     gene            1..30
                     /locus_tag="L1"
     CDS             complement(join(4..9,
                     13..30))
                     /locus_tag="L1"
                     /gene="abc"
                     /product="long
                     name"
                     /protein_id="P1"
ORIGIN
"""


def test_genbank(spark, tmp_path):
    r = R.read_genbank(spark, put(tmp_path, "a.gbk", GBK)).first()
    assert (r.contig, r.locus_tag, r.gene, r.product, r.start, r.end, r.strand) == ("NC_1.2", "L1", "abc", "long name", 3, 30, -1)


def test_hit_tables(spark, tmp_path):
    scan = "# c\nT1 A.1 Q1 - 1e-5 30.5 0.1 1e-4 29 0.2 1.1 1 2 3 4 5 6 7 some text here \nT2 - Q2 - x 1 1 1 1 1 1 1 1 1 1 1 1 1\n"
    p = put(tmp_path, "s.tbl", scan)
    assert rows(R.read_hmmscan(spark, p), "target_name", "full_score", "inc", "description") == [("T1", 30.5, 7, "some text here"), ("T2", 1.0, 1, "")]
    assert R.read_hmmscan(spark, p).filter("full_evalue is null").count() == 1
    with pytest.raises(Exception):
        R.read_hmmsearch(spark, p).collect()
    good = put(tmp_path, "g.tbl", scan.split("\nT2")[0] + "\n")
    assert R.read_hmmsearch(spark, good, cutoff=30.5).count() == 1 and R.read_hmmsearch(spark, good, cutoff=31).count() == 0
    dom = put(tmp_path, "d.tbl", "T P.3 10 Q - 20 1e-9 50 0 1 2 1e-3 1e-4 40 0 1 9 2 8 1 10 0.9 the end\n")
    assert rows(R.read_domains(spark, dom), "ali_from", "acc", "description") == [(2, 0.9, "the end")]
    b = put(tmp_path, "b.tsv", "# c\nq\ts\tacc\ttitle\t1e-3\tbad\t90\t80\torg\n")
    assert rows(R.read_blast9(spark, b), "evalue", "identity") == [(0.001, 90.0)] and R.read_blast9(spark, b).first().bit_score is None
    rep = put(tmp_path, "GCA_000000001.1_x.txt", "Sequences producing significant alignments:\n\nhit1 10\n\n> hit1 x\n> hit2\n")
    assert rows(R.read_blast_best_hits(spark, rep), "accession", "hit") == [("GCA_000000001.1", "hit1")]
    assert rows(R.read_blast_subjects(spark, rep, "last", 13), "hit") == [("hit2",)]


def test_reports(spark, tmp_path):
    t = put(tmp_path, "full.tsv", "# x\nb1\tComplete\ts1\t10.5\t100\nb2\tMissing\n")
    assert rows(R.read_status_table(spark, t, "a"), "busco_id", "status") == [("b1", "Complete"), ("b2", "Missing")]
    f = put(tmp_path, "f.txt", "# cmd\nGeneid\tC\tS\tE\tSt\tL\tx.bam\ng1\tc\t1\t2\t+\t2\t7\n")
    assert rows(R.read_feature_counts(spark, f), "gene", "sample", "n") == [("g1", "x", 7)]
    m = put(tmp_path, "m.txt", "3\nd/AAA\nd/BBB\t0.1\nd/CCC\t0.2\t0.3\n")
    assert rows(R.read_distance_triangle(spark, m), "a", "b", "dist") == [("BBB", "AAA", 0.1), ("CCC", "AAA", 0.2), ("CCC", "BBB", 0.3)]
    c = put(tmp_path, "c.clstr", ">Cluster 0\n0\t9aa, >p1... *\n1\t8aa, >p2... at 99%\n>Cluster 1\n0\t5aa, >p3... *\n")
    assert rows(R.read_clusters(spark, c), "cluster_id", "name", "is_rep") == [(0, "p1", True), (0, "p2", False), (1, "p3", True)]
    r = put(tmp_path, "r.txt", ">h1\nGGGAAACCC\n(((...))) ( -1.20)\n")
    assert rows(R.read_folds(spark, r), "id", "structure", "energy") == [("h1", "(((...)))", -1.2)]
    k = put(tmp_path, "o.txt", "lnL(ntime:  5  np:  8):  -123.45  +0.0\nkappa (ts/tv) =  2.5\nw (dN/dS) for branches:  0.1 0.9\n")
    assert rows(R.read_codeml(spark, k), "np", "lnl", "kappa", "background_omega", "foreground_omega") == [(8, -123.45, 2.5, 0.1, 0.9)]
    s = put(tmp_path, "x.sto", "# STOCKHOLM\nseq1  ac.gt\nseq2  aaagt\n//\n")
    assert rows(R.read_stockholm(spark, s), "seq_id", "seq") == [("seq1", "AC-GT"), ("seq2", "AAAGT")]
    a = put(tmp_path, "x.a2m", ">s1\nAc-GT\n>s2\nA.CGT\n")
    assert rows(R.read_a2m_matches(spark, a), "seq_id", "seq") == [("s1", "A-GT"), ("s2", "ACGT")]
    n = put(tmp_path, "t.nwk", "((A:1,B_x:2)90/96:1,C:3);\n")
    assert rows(R.read_newick(spark, n).filter("is_leaf"), "name") == [("A",), ("B_x",), ("C",)]
    v = put(tmp_path, "p.hmm", "NAME x\nACC   PF1.2\nACC   PF1.3\n")
    assert rows(R.profile_versions(spark, v), "accession", "versioned") == [("PF1", "PF1.3")]


def test_json_reports(spark, tmp_path):
    from strandframe.operators.tables import flatten_assembly_reports

    p = put(tmp_path, "r.json", '{"reports": [{"accession": "G1", "organism": {"organism_name": "X y", "tax_id": 5, "infraspecific_names": {"strain": "s"}}}, {"accession": "G2", "organism": {"organism_name": "Z"}}]}')
    x = flatten_assembly_reports(R.read_assembly_reports(spark, p))
    assert rows(x, "accession", "full_name") == [("G1", "X y__s"), ("G2", "Z")] and x.filter("completeness is null").count() == 2


def test_directories_and_datasets(spark, tmp_path):
    (tmp_path / "GCA1").mkdir()
    (tmp_path / "GCA1" / "a.faa").write_text(">x\nA\n")
    (tmp_path / "GCA2").mkdir()
    (tmp_path / "GCA2" / "b.txt").write_text("x")
    f = R.list_files(spark, str(tmp_path), recursive=True)
    assert rows(R.folders_without(f), "folder") == [("GCA2",)]
    assert rows(R.folders_with_one(f), "folder") == [("GCA1",)]
    v = spark.createDataFrame([("n1", 3, 4)], "node string, a int, b int")
    assert "FIELD_LABELS,a,b" in W.pie_dataset(v, ["a", "b"]) and "n1,3,4" in W.multi_bar_dataset(v, ["a", "b"])
    with pytest.raises(ValueError):
        W.field_lines([str(i) for i in range(11)])
    strip = W.colour_strip(spark.createDataFrame([("n1", "#1", "g", 0), ("n2", "#1", "g", 1)], "node string, colour string, group string, ord int"))
    assert strip.count("g") >= 3 and "LEGEND_LABELS,g\n" in strip
    assert W.write_if_changed(str(tmp_path / "w.txt"), "a") and not W.write_if_changed(str(tmp_path / "w.txt"), "a")


def test_count_files_keep_their_order(spark, tmp_path):
    """Enough genes that the writer's own sort would not leave a file's header first."""
    from pyspark.sql import functions as F

    from strandframe import file_queries

    spark.range(900_000).selectExpr("id div 6 as l_partkey", "id % 6 as l_suppkey", "1.0d as l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = file_queries.feature_count_files(spark, str(tmp_path)).groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("gene").alias("genes")).collect()
    assert sorted((r["sample"], r.n, r.genes) for r in got) == [(str(k), 150_000, 150_000) for k in range(6)]
