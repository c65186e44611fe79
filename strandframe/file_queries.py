"""Sources and sinks as queries: the driver's tables written in each format, and what the readers make of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import tables, tree
from .plans.session import rounded
from .plans.shared import fresh, put_file
from .plans.tools import codeml_control, reconciliation_families
from .queries import _long, _six, order_genes, order_statuses, part_alignment, place_tree, query, supplier_alignment, table
from .sources import readers, sinks


def put(lines: DataFrame, name: str, order: list | None = None) -> str:
    """lines(value) as text files in the shared folder; order: one file, in that order."""
    path = fresh(lines.sparkSession, name)
    sinks.write_lines(lines, path, order, single=order is not None)
    return path


def text(*parts) -> F.Column:
    """Parts as one text; strings are literal, columns are cast."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("value")


def tabbed(*parts) -> F.Column:
    return F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


def blanks(*parts) -> F.Column:
    return F.concat_ws("  ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


# ---- sequences ------------------------------------------------------------------------------------------------


@query("select cast(p_partkey as varchar) as seq_id, upper(replace(p_name, ' ', '')) as seq from part")
def fasta_file(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("seq_id"), F.col("p_name").alias("seq"), F.col("p_partkey").alias("ord"))
    path = fresh(spark, "parts")
    sinks.write_fasta(x, path, width=7, single=False)
    return readers.read_fasta(spark, path).select("seq_id", "seq")


@query("select 'r' || n_regionkey as seq_id, arg_max(upper(n_name), n_nationkey) as seq from nation group by 1")
def fasta_last_of_id(spark, d):
    x = table(spark, d, "nation").select(text(">r", F.col("n_regionkey"), " nation ", F.col("n_nationkey"), "\n", F.col("n_name")), "n_nationkey")
    return readers.read_fasta(spark, put(x, "nations", ["n_nationkey"])).select("seq_id", "seq")


@query("select p_brand || '_' || p_partkey as seq_id, replace(p_name, ' ', '') as seq from part")
def fasta_two_word_keys(spark, d):
    x = table(spark, d, "part").select(text(">", F.col("p_brand"), " ", F.col("p_partkey"), " of > many\n", F.col("p_name")))
    return readers.read_fasta_two_words(spark, put(x, "two-words")).select("seq_id", "seq")


@query("select p_brand || ' size ' || p_size || '/' || p_partkey as seq_id, split_part(p_brand, '#', 2) as number from part")
def fasta_key_function(spark, d):
    x = table(spark, d, "part").select(text(">", F.col("p_brand"), " size ", F.col("p_size"), "/", F.col("p_partkey"), "\nACGT"))
    y = readers.read_fasta(spark, put(x, "headers"), key=lambda header: F.concat_ws("|", header, F.regexp_extract(header, r"#(\d+)", 1)))
    return y.select(F.split_part("seq_id", F.lit("|"), F.lit(1)).alias("seq_id"), F.split_part("seq_id", F.lit("|"), F.lit(2)).alias("number"))


@query("select n_name || '_' || s_suppkey as seq_id, upper(s_name) as seq from supplier join nation on s_nationkey = n_nationkey")
def prefixed_proteomes(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("source"), F.col("s_suppkey").cast("string").alias("seq_id"), F.upper("s_name").alias("seq"))
    p = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("prefix"))
    return readers.read_fasta(spark, put(sinks.fasta_lines(readers.prefix_ids(x, p)), "prefixed")).select("seq_id", "seq")


def part_reads(spark, d):
    x = table(spark, d, "part")
    return x.select(F.concat(F.lit("@p"), F.col("p_partkey").cast("string")).alias("read_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("seq"), F.expr("repeat('I', length(replace(p_name, ' ', '')))").alias("quality"), F.col("p_partkey").alias("ord"))


@query("select '@p' || p_partkey as read_id, length(replace(p_name, ' ', '')) as length, replace(p_name, ' ', '') as seq, repeat('I', length(replace(p_name, ' ', ''))) as quality from part")
def fastq_file(spark, d):
    path = fresh(spark, "reads")
    sinks.write_fastq(part_reads(spark, d), path)
    return _long(readers.read_fastq(spark, path).select("read_id", "length", "seq", "quality"))


@query("select least(150, count(*)) as n, least(150, count(*)) as different, least(150, count(*)) as known from part")
def fastq_sample(spark, d):
    path = fresh(spark, "sampled")
    reads = part_reads(spark, d)
    sinks.write_fastq(readers.sample_reads(reads, 150), path)
    s = readers.read_fastq(spark, path)
    return s.join(reads.select("read_id", F.lit(1).alias("one")), "read_id", "left").agg(F.count("*").alias("n"), F.countDistinct("read_id").alias("different"), F.count("one").alias("known"))


@query("""with a as (select s_nationkey, s_suppkey, translate(s_name, '0', '-') as seq from supplier where s_nationkey = 3)
select cast(count(*) as varchar) || ' ' || cast(max(length(seq)) as varchar) as line from a union all select s_suppkey || '  ' || seq from a""")
def phylip_file(spark, d):
    path = fresh(spark, "phylip")
    sinks.write_phylip(supplier_alignment(spark, d).filter("aln_id = 3"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""with n as (select distinct p_name as name from part)
select name, 'T' || lpad(cast(row_number() over (order by name) as varchar), 6, '0') as new_name from n""")
def sequential_ids(spark, d):
    path = fresh(spark, "id-map")
    sinks.write_table(tree.safe_names(table(spark, d, "part").select(F.col("p_name").alias("name"))), path)
    return spark.read.csv(path, sep="\t", header=True)


@query("select p_name as name, min(p_partkey) as first, string_agg(cast(p_partkey as varchar), ';' order by p_partkey) as members from part group by 1")
def tsv_report(spark, d):
    x = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("first"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ";").alias("members"))
    path = fresh(spark, "report")
    sinks.write_table(x, path, order=["name"])
    return spark.read.csv(path, sep="\t", header=True, schema="name string, first long, members string")


# ---- annotation -----------------------------------------------------------------------------------------------


def gene_file(spark, d) -> str:
    """Orders as genes and CDS features of one file, a CDS per gene but with the id of its customer."""
    g = order_genes(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("gene_id"), "o_custkey", "o_orderpriority"), "gene_id")
    attrs = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in kv])
    row = lambda kind, a, o: g.select(F.concat(F.lit("c"), F.col("contig").cast("string")).alias("seqid"), F.lit("x").alias("source"), F.lit(kind).alias("type"), "start", "end", F.lit(None).cast("string").alias("score"), "strand", F.lit(None).cast("string").alias("phase"), a.alias("attributes"), (F.col("gene_id") * 2 + o).alias("ord"))
    gene = row("gene", attrs("ID", F.concat(F.lit("gene-"), F.col("gene_id").cast("string")), "Name", F.col("o_orderpriority")), 0)
    cds = row("CDS", attrs("ID", F.concat(F.lit("cds-"), F.col("o_custkey").cast("string")), "Parent", F.concat(F.lit("gene-"), F.col("gene_id").cast("string")), "product", F.col("o_custkey")), 1)
    path = fresh(spark, "genes")
    sinks.write_gff(gene.unionByName(cds), path)
    return path


_PLACES = "select o_orderkey as k, o_custkey as c, o_custkey % 50 as contig, o_orderkey * 37 % 5000 + 1 as s, o_orderkey * 37 % 5000 + 91 as e, case when o_orderstatus = 'O' then '+' else '-' end as strand, o_orderpriority as name from orders"


@query(f"select 'gene-' || k as id, 'c' || contig as seqid, s as start, e as \"end\", strand, name from ({_PLACES})")
def gff_file(spark, d):
    x = readers.read_gff(spark, gene_file(spark, d), "gene")
    return _long(x.select("id", "seqid", "start", "end", "strand", readers.attribute("Name").alias("name")))


@query(f"""select 'cds-' || c as protein, 'gene-' || max(k) as gene, cast(c as varchar) as product, arg_max(s, k) as start, arg_max(e, k) as "end", arg_max(strand, k) as strand, arg_max(name, k) as common_name from ({_PLACES}) group by c""")
def gff_simple_annotation(spark, d):
    path = gene_file(spark, d)
    x = readers.simple_annotation(readers.read_gff(spark, path, "CDS"), readers.read_gff(spark, path, "gene"), coordinates=True)
    return _long(x.select(F.col("protein_id").alias("protein"), F.col("gene_id").alias("gene"), "product", "start", "end", "strand", "common_name"))


@query(f"""with p as (select 'cds-' || c as protein, 'gene-' || max(k) as gene from ({_PLACES}) group by c)
select gene, protein from p""")
def gff_protein_of_gene(spark, d):
    cds = readers.read_gff(spark, gene_file(spark, d), "CDS")
    return readers.protein_of_gene(cds).join(readers.gene_of_protein(cds), ["protein", "gene"]).select("gene", "protein")


@query(f"select cast(k as varchar) as \"GeneID\", 'c' || contig as \"Chr\", s as \"Start\", e as \"End\", strand as \"Strand\" from ({_PLACES}) where strand = '+'")
def saf_of_strand(spark, d):
    return _long(readers.saf(readers.on_strand(readers.read_gff(spark, gene_file(spark, d), "gene"), "+")))


@query(f"select distinct 'c' || contig as seqid from ({_PLACES})")
def gff_contigs(spark, d):
    return readers.contig_names(readers.read_gff(spark, gene_file(spark, d), None, keep="all"))


@query("select 'p' || p_partkey as id, p_size::bigint as start, p_name || ';%+=' || p_type as note from part where p_partkey % 3 <> 0")
def gff_tolerant_decoding(spark, d):
    encoded = F.concat(F.url_encode(F.concat("p_name", F.lit(";%"))), F.lit("+%3D"), F.col("p_type"))
    note = F.replace(F.substring_index(encoded, "+%3D", 1), F.lit("+"), F.lit("%20"))
    whole = tabbed("c1", "x", "gene", F.col("p_size"), F.col("p_size") + 9, ".", "+", ".", F.concat(F.lit("flag; ID=p"), F.col("p_partkey").cast("string"), F.lit(";No%74e="), note, F.lit("+%3D"), F.col("p_type")))
    short = tabbed("c1", "x", "gene", F.col("p_size"))
    x = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 != 0, whole).otherwise(short).alias("value"))
    y = readers.read_gff(spark, put(x, "tolerant"), "gene", strict=False, decode=True)
    return _long(y.select("id", "start", readers.attribute("Note").alias("note")))


@query("select 'B_' || max(n_nationkey) as build, 'GCA_1' as build_accession, 'S_9606' as species, cast(null as varchar) as processor, count(*) as regions, max('r' || n_nationkey) as last_region from nation")
def gff_pragmas(spark, d):
    n = table(spark, d, "nation")
    head = n.agg(F.max("n_nationkey").alias("n")).select(text("##gff-version 3\n#!genome-build NCBI B_", F.col("n"), "\n#!genome-build-accession NCBI_Assembly:x GCA_1\n##species https://taxonomy/ S_9606"), F.lit(-1).alias("ord"))
    rows = n.select(tabbed(F.concat(F.lit("c"), F.col("n_nationkey").cast("string")), "x", "region", "1", "9", ".", "+", ".", F.concat(F.lit("ID=r"), F.col("n_nationkey").cast("string"))), F.col("n_nationkey").alias("ord"))
    s = readers.gff_summary(spark, put(head.unionByName(rows), "pragmas", ["ord"]))
    ids = F.transform(F.map_values("regions"), lambda a: F.get_json_object(a, "$.ID"))
    return s.select("build", "build_accession", "species", "processor", F.size("regions").cast("long").alias("regions"), F.array_max(ids).alias("last_region"))


@query("select 'g' || p_partkey as id, p_name as name, p_size::bigint as start, cast(p_size as varchar) as n from part")
def gtf_file(spark, d):
    attrs = F.concat(F.lit('gene_id "g'), F.col("p_partkey").cast("string"), F.lit('"; gene_name "'), "p_name", F.lit('"; n '), F.col("p_size").cast("string"), F.lit(";"))
    x = table(spark, d, "part").select(tabbed("c1", "x", "gene", F.col("p_size"), F.col("p_size") + 5, ".", "-", ".", attrs))
    return _long(readers.read_gtf(spark, put(x, "gtf")).select("id", readers.attribute("gene_name").alias("name"), "start", readers.attribute("n").alias("n")))


@query("""select 'N_' || s_nationkey || '.1' as contig, 'L' || s_suppkey as gene_id, 'P' || s_suppkey as protein_id, '' as common_name, s_name || ' of ' || s_nationkey as product,
  s_suppkey as start, s_suppkey + 30 as "end", case when s_suppkey % 2 = 0 then -1 else 1 end::bigint as strand from supplier""")
def genbank_file(spark, d):
    at = F.concat((F.col("s_suppkey") + 1).cast("string"), F.lit(".."), (F.col("s_suppkey") + 12).cast("string"), F.lit(",\n" + " " * 21), (F.col("s_suppkey") + 20).cast("string"), F.lit(".."), (F.col("s_suppkey") + 30).cast("string"))
    place = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("complement(join("), at, F.lit("))"))).otherwise(F.concat(F.lit("join("), at, F.lit(")")))
    q = "\n" + " " * 21
    record = text(
        "LOCUS       x 100 bp\nVERSION     N_", F.col("s_nationkey"), ".1\nFEATURES             Location/Qualifiers\n     gene            1..9" + q + '/locus_tag="other"\n     CDS             ', place,
        q + '/locus_tag="L', F.col("s_suppkey"), '"' + q + '/product="', F.col("s_name"), q + "of ", F.col("s_nationkey"), '"' + q + '/protein_id="P', F.col("s_suppkey"), '"\nORIGIN\n        1 acgt\n//',
    )
    cds = readers.read_genbank(spark, put(table(spark, d, "supplier").select(record), "genbank"))
    return _long(readers.genbank_annotation(cds, coordinates=True).join(cds.select(F.col("locus_tag").alias("gene_id"), "contig"), "gene_id"))


# ---- hit tables -----------------------------------------------------------------------------------------------


def scan_file(spark, d) -> str:
    """Parts as hits of brands: price as score, a number of their own as E-value; every 11th has none."""
    k = F.col("p_partkey")
    evalue = F.when(k % 11 == 0, F.lit("-")).otherwise(F.concat((k % 9 + 1).cast("string"), F.lit("e-"), (k % 10).cast("string")))
    ints = [(k % m).cast("string") for m in (2, 3, 4, 5, 6, 7, 8)]
    x = table(spark, d, "part").select(blanks(F.col("p_brand"), F.concat(F.lit("PF"), F.col("p_size").cast("string"), F.lit(".3")), F.concat(F.lit("q"), k.cast("string")), "-", evalue, F.col("p_retailprice"), "0.5", evalue, "7.25", "0", "1.5", *ints, F.concat("p_name", F.lit(" made "))))
    return put(spark.createDataFrame([("# a comment",), ("",)], "value string").unionByName(x), "scan")


_EVALUE = "case when p_partkey % 11 = 0 then null else cast((p_partkey % 9 + 1) || 'e-' || (p_partkey % 10) as double) end"


@query(f"""select p_brand as target_name, 'PF' || p_size || '.3' as target_accession, 'q' || p_partkey as query_name, {_EVALUE} as full_evalue, p_retailprice as full_score, p_partkey % 8 as inc, p_name || ' made' as description from part""")
def hmmscan_file(spark, d):
    return _long(readers.read_hmmscan(spark, scan_file(spark, d)).select("target_name", "target_accession", "query_name", "full_evalue", "full_score", "inc", "description"))


@query("select 'q' || p_partkey as query_name, p_retailprice as full_score from part where p_partkey % 11 <> 0 and p_retailprice >= 950.5")
def hmmsearch_cutoff(spark, d):
    """Without the rows that have no E-value, which this reader would refuse."""
    lines = spark.read.text(scan_file(spark, d)).filter(~F.col("value").rlike(r"\s-\s+-\s"))
    return readers.read_hmmsearch(spark, put(lines, "search"), cutoff=950.5).select("query_name", "full_score")


@query("select 'q' || p_partkey as query_name, p_retailprice as full_score from part where p_retailprice >= 1000")
def gathering_cutoff(spark, d):
    return tables.above_gathering_cutoff(readers.read_hmmscan(spark, scan_file(spark, d)), 1000.0).select("query_name", "full_score")


@query(f"""with s as (select p_brand as target_name, max(p_type) as seq from part where p_brand < 'Brand#2' group by 1)
select 'q' || p_partkey as query_name, target_name, seq, 'g1' as genome from part join s on target_name = p_brand where {_EVALUE} < 3e-6""")
def hits_with_sequences(spark, d):
    s = table(spark, d, "part").filter("p_brand < 'Brand#2'").groupBy(F.col("p_brand").alias("seq_id")).agg(F.max("p_type").alias("seq"))
    return tables.filtered_hits(readers.read_hmmscan(spark, scan_file(spark, d)), s, "g1", 3e-6).select("query_name", "target_name", "seq", "genome")


@query(f"select p_brand as target, '-' as accession, {_EVALUE} as evalue from part")
def minimal_hit_table(spark, d):
    return readers.read_minimal_hits(spark, scan_file(spark, d)).select("target", "accession", "evalue")


@query("""select 'd' || l_linenumber as target_name, 'PF' || l_suppkey || '.1' as target_accession, 'o' || l_orderkey as query_name, l_quantity as domain_score, l_discount as i_evalue,
  l_partkey as env_from, l_partkey + l_suppkey as env_to, l_returnflag || ' ' || l_linestatus as description from lineitem""")
def domain_table_file(spark, d):
    c = F.col
    x = table(spark, d, "lineitem").select(blanks(
        F.concat(F.lit("d"), c("l_linenumber").cast("string")), F.concat(F.lit("PF"), c("l_suppkey").cast("string"), F.lit(".1")), "9", F.concat(F.lit("o"), c("l_orderkey").cast("string")), "-", "10",
        "1e-9", "50", "0", "1", "2", "1e-3", c("l_discount"), c("l_quantity"), "0.1", "1", "9", "2", "8", c("l_partkey"), c("l_partkey") + c("l_suppkey"), "0.9", F.concat("l_returnflag", F.lit(" "), "l_linestatus"),
    ))
    y = readers.read_domains(spark, put(x, "domains"))
    return _long(y.select("target_name", "target_accession", "query_name", "domain_score", "i_evalue", "env_from", "env_to", "description"))


@query("select 'q' || p_partkey as query, p_brand as subject, p_retailprice as identity, p_size::bigint as length, p_partkey as query_start from part")
def blast_table(spark, d):
    k = F.col("p_partkey")
    x = table(spark, d, "part").select(tabbed(F.concat(F.lit("q"), k.cast("string")), F.col("p_brand"), F.col("p_retailprice"), F.col("p_size"), "1", "0", k, k + 9, "1", "10", "1e-20", "55.5"))
    return _long(readers.read_blast12(spark, put(x, "blast12")).select("query", "subject", "identity", "length", "query_start"))


@query("select 'q' || p_partkey as query, p_brand as subject_id, p_name as subject_title, case when p_size % 7 <> 0 then p_retailprice end as bit_score, p_type as organism from part")
def blast_annotated_table(spark, d):
    k = F.concat(F.lit("q"), F.col("p_partkey").cast("string"))
    score = F.when(F.col("p_size") % 7 == 0, F.lit("n/a")).otherwise(F.col("p_retailprice").cast("string"))
    x = spark.createDataFrame([("# fields: query",)], "value string").unionByName(table(spark, d, "part").select(tabbed(k, F.col("p_brand"), "x", F.col("p_name"), "1e-5", score, "50", "100", F.col("p_type"))))
    return readers.read_blast9(spark, put(x, "blast9")).select("query", "subject_id", "subject_title", "bit_score", "organism")


def region_reports(spark, d) -> str:
    """A search report per region in a file named after an accession; regions are five."""
    folder = fresh(spark, "reports")
    for r in table(spark, d, "region").collect():
        k, name = r["r_regionkey"], r["r_name"].replace(" ", "_")
        body = f"BLASTP\n\nSequences producing significant alignments:\n\n{name}_top 50 1e-5\n{name}_next 40 1e-3\n\n> {name}_top some text\nLength=9\n>{name}_last more\nmany significant alignments\n"
        put_file(spark, f"{folder}/GCF_00000000{k}.1.txt", body)
    return folder


@query("select 'GCF_00000000' || r_regionkey || '.1' as accession, replace(r_name, ' ', '_') || '_top' as hit, replace(r_name, ' ', '_') || '_last' as last from region")
def blast_reports(spark, d):
    path = region_reports(spark, d)
    best = readers.read_blast_best_hits(spark, path).join(readers.read_blast_subjects(spark, path, "first", 15), ["accession", "hit"])
    return best.join(readers.read_blast_subjects(spark, path, "last", 15).withColumnRenamed("hit", "last"), "accession")


@query("select 'GCF_00000000' || r_regionkey || '.1' as assembly, cast(2 * length(replace(r_name, ' ', '_')) > 0 as boolean) as named from region")
def listed_files(spark, d):
    folder = region_reports(spark, d)
    put_file(spark, f"{folder}/readme.md", "not a report")
    x = readers.proteome_files(spark, folder, ".txt").join(readers.list_files(spark, folder, ends=".txt").select("path", "length"), "path")
    return x.select("assembly", (F.col("length") > 100).alias("named"))


@query("select 'PF' || n_regionkey as accession, 'PF' || n_regionkey || '.' || max(n_nationkey) as versioned from nation group by n_regionkey")
def profile_accessions(spark, d):
    n = table(spark, d, "nation")
    x = n.select(text("HMMER3/f\nNAME  n", F.col("n_nationkey"), "\nACC   PF", F.col("n_regionkey"), ".", F.col("n_nationkey"), "\nDESC  text"), "n_nationkey")
    return readers.profile_versions(spark, put(x, "profiles", ["n_nationkey"]))


# ---- reports --------------------------------------------------------------------------------------------------


@query("""select o_custkey % 997 as busco_id, case o_orderstatus when 'O' then 'Complete' when 'F' then 'Duplicated' else 'Missing' end as status,
  case when o_orderstatus <> 'P' then cast(o_orderkey as varchar) end as sequence, case when o_orderstatus <> 'P' then o_totalprice end as score from orders""")
def status_table_file(spark, d):
    x = order_statuses(spark, d)
    whole = tabbed(F.col("busco_id"), F.col("status"), F.col("sequence"), F.col("score"), "120")
    lines = x.select(F.when(F.col("status") == "Fragmented", tabbed(F.col("busco_id"), "Missing")).otherwise(whole).alias("value"))
    y = readers.read_status_table(spark, put(spark.createDataFrame([("# Busco id\tStatus",)], "value string").unionByName(lines), "status"), "a1")
    return y.select(F.col("busco_id").cast("long").alias("busco_id"), "status", "sequence", "score")


@query("select l_partkey as gene, cast(l_suppkey % 6 as varchar) as sample, sum(l_quantity)::bigint as n from lineitem group by 1, 2")
def feature_count_files(spark, d):
    """A file per sample: a comment, a header whose 7th name is the sample's, and its genes.

    Rows are sorted by the folder's own column, which is a number, so the writer has no sort to add that would mix a file's lines."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 6).cast("string").alias("sample")).agg(F.sum("l_quantity").cast("long").alias("n"))
    samples = c.select("sample").distinct()
    rows = samples.select("sample", F.lit("# Program:counts").alias("value"), F.lit(-2).cast("long").alias("ord"))
    rows = rows.unionByName(samples.select("sample", tabbed("Geneid", "Chr", "Start", "End", "Strand", "Length", F.concat("sample", F.lit(".bam"))), F.lit(-1).cast("long").alias("ord")))
    rows = rows.unionByName(c.select("sample", tabbed(F.col("gene"), "c", "1", "2", "+", "2", F.col("n")), F.col("gene").alias("ord")))
    path = fresh(spark, "counts")
    rows.withColumn("of", F.col("sample").cast("long")).repartition("of").sortWithinPartitions("of", "ord").select("value", "of").write.partitionBy("of").text(path)
    y = readers.read_feature_counts(spark, path)
    return y.select(F.col("gene").cast("long").alias("gene"), "sample", "n")


@query("select (event_id * 13)::bigint as genomic_position, case when event_id % 3 = 0 then 0e0 else value end as plus, user_id * 1e0 as minus from events")
def coverage_file(spark, d):
    x = table(spark, d, "events").select((F.col("event_id") * 13).alias("genomic_position"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("plus"), F.col("user_id").cast("double").alias("minus"))
    path = fresh(spark, "coverage")
    sinks.write_table(x, path, sep=",")
    return _long(readers.read_coverage(spark, path))


@query("""select 'GCF_' || n_nationkey as accession, n_name as organism_name, case when n_nationkey % 2 = 0 then n_name || '__s' || n_regionkey else n_name end as full_name,
  case when n_nationkey % 3 = 0 then n_nationkey + 0.5e0 end as completeness, n_nationkey * 1000::bigint as genome_size from nation""")
def flattened_reports(spark, d):
    """Nations as reports of one JSON file, with branches that some lack."""
    k = F.col("n_nationkey")
    report = F.struct(
        F.concat(F.lit("GCF_"), k.cast("string")).alias("accession"),
        F.struct(F.col("n_name").alias("organism_name"), F.when(k % 2 == 0, F.struct(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("strain"))).alias("infraspecific_names")).alias("organism"),
        F.when(k % 3 == 0, F.struct((k + 0.5).alias("completeness"))).alias("checkm_info"),
        F.struct((k * 1000).alias("total_sequence_length")).alias("assembly_stats"),
    )
    x = table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list(report).alias("reports"))).alias("value"))
    y = tables.flatten_assembly_reports(readers.read_assembly_reports(spark, put(x, "reports-json")))
    return _long(y.select("accession", "organism_name", "full_name", "completeness", F.col("genome_size").cast("long").alias("genome_size")))


@query("select event_type as \"Node\", event_id as \"Site\", substr('ACDE', (user_id % 4 + 1)::int, 1) as \"State\", value as \"p_A\" from events")
def site_states_file(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("Node"), F.col("event_id").alias("Site"), F.expr("substring('ACDE', cast(user_id % 4 + 1 as int), 1)").alias("State"), F.col("value").alias("p_A"))
    path = fresh(spark, "states")
    sinks.write_table(x, path)
    return _long(readers.read_states(spark, path))


@query("select a.n_name as a, b.n_name as b, abs(a.n_nationkey - b.n_nationkey) / 1e2 as dist from nation a join nation b on b.n_nationkey < a.n_nationkey")
def distance_triangle_file(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    low = n.select(F.col("n_nationkey").alias("j"))
    cells = n.join(low, F.col("j") < F.col("n_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.array_sort(F.collect_list("j")).alias("js"))  # nations only
    dist = F.transform("js", lambda j: ((F.col("n_nationkey") - j) / 100.0).cast("string"))
    lines = cells.select(F.concat_ws("\t", F.concat(F.lit("folder/of/"), "n_name"), dist).alias("value"), F.col("n_nationkey").alias("ord"))
    head = n.agg(F.count("*").cast("string").alias("value")).withColumn("ord", F.lit(-1))
    return readers.read_distance_triangle(spark, put(head.unionByName(lines), "triangle", ["ord"]))


@query("""with p as (select p_brand, dense_rank() over (order by p_brand) - 1 as cluster_id, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r from part)
select cluster_id, max(case when r = 1 then 'p' || p_partkey end) as rep, count(*) as member_count, string_agg('p' || p_partkey, ';' order by p_partkey) as members from p group by 1""")
def cluster_listing(spark, d):
    p = table(spark, d, "part")
    least = p.groupBy("p_brand").agg(F.min("p_partkey").alias("rep"))
    heads = least.select(text(">Cluster ", F.col("p_brand")), "p_brand", F.lit(-1).cast("long").alias("ord"))
    rows = p.join(least, "p_brand").select(text("0\t50aa, >p", F.col("p_partkey"), "... ", F.when(F.col("p_partkey") == F.col("rep"), "*").otherwise("at 98%")), "p_brand", F.col("p_partkey").alias("ord"))
    return _long(tables.cluster_table(readers.read_clusters(spark, put(heads.unionByName(rows), "clusters", ["p_brand", "ord"]))))


@query("select 'p' || p_partkey as id, repeat('g', (p_size + 8)::int) as seq, '(((' || repeat('.', (p_size + 2)::int) || ')))' as structure, -p_size / 1e1 as energy from part")
def fold_file(spark, d):
    x = table(spark, d, "part").select(text(">p", F.col("p_partkey"), " a fold\n", F.expr("repeat('g', p_size + 8)"), "\n(((", F.expr("repeat('.', p_size + 2)"), "))) ( ", F.format_string("%.1f", -F.col("p_size") / 10), ")"))
    return readers.read_folds(spark, put(x, "folds"))


@query("""select 'r' || r_regionkey || '.txt' as file, (r_regionkey + 5)::bigint as np, -100.5e0 - r_regionkey as lnl, 2.5e0 as kappa, case when r_regionkey % 2 = 0 then 0.25e0 end as omega,
  case when r_regionkey % 2 = 1 then 0.125e0 end as background_omega, case when r_regionkey % 2 = 1 then 3e0 end as foreground_omega from region""")
def codon_model_reports(spark, d):
    folder = fresh(spark, "codeml")
    for r in table(spark, d, "region").collect():  # five
        k = r["r_regionkey"]
        tail = "w (dN/dS) for branches:  0.125 3.0\n" if k % 2 else "omega (dN/dS) =  0.25\n"
        put_file(spark, f"{folder}/r{k}.txt", f"CODONML\nlnL(ntime: 9  np: {k + 5}):  {-100.5 - k}  +0.0\nkappa (ts/tv) =  2.5\n{tail}")
    return _long(readers.read_codeml(spark, folder))


@query("select cast(s_suppkey as varchar) as seq_id, upper(s_name) || replace(upper(cast(s_nationkey as varchar)), '1', '-') || 'TAIL' as seq from supplier")
def stockholm_file(spark, d):
    """Two blocks, gaps as dots."""
    s = table(spark, d, "supplier")
    first = s.select(blanks(F.col("s_suppkey"), F.lower("s_name")), F.lit(1).alias("block"), F.col("s_suppkey").alias("ord"))
    second = s.select(blanks(F.col("s_suppkey"), F.concat(F.replace(F.col("s_nationkey").cast("string"), F.lit("1"), F.lit(".")), F.lit("tail"))), F.lit(2).alias("block"), F.col("s_suppkey").alias("ord"))
    note = spark.createDataFrame([("# STOCKHOLM 1.0", 0, -1), ("#=GC RF xxx", 3, -1), ("//", 4, -1)], "value string, block int, ord long")
    return readers.read_stockholm(spark, put(note.unionByName(first).unionByName(second), "stockholm", ["block", "ord"])).select("seq_id", "seq")


@query("select cast(p_partkey as varchar) as seq_id, rpad(upper(replace(p_name, ' ', '')), 16, '-') as seq from part")
def a2m_match_columns(spark, d):
    inserted = F.concat(F.lower("p_brand"), F.rpad(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))), 16, "-"), F.lit(".ins."))
    x = table(spark, d, "part").select(text(">", F.col("p_partkey"), "\n", F.regexp_replace(inserted, "[#0-9]", "")))
    return readers.read_a2m_matches(spark, put(x, "a2m", ["value"])).select("seq_id", "seq")


@query("select c_name as name, round(c_custkey % 9 + n_nationkey % 4 + 5e-1 + 1, 6) + 0e0 as distance from customer join nation on c_nationkey = n_nationkey")
def newick_file(spark, d):
    path = fresh(spark, "tree")
    sinks.write_newick(place_tree(spark, d), path)
    return _six(tree.root_to_tip(readers.read_newick(spark, path)).select("name", "distance"), "distance")


# ---- small texts ------------------------------------------------------------------------------------------------


@query("""with g as (select p_partkey % 7 as aln_id, 16::bigint as sites from part group by 1)
select '#nexus' || chr(10) || 'begin sets;' || chr(10) || string_agg('    charset ' || aln_id || ' = ' || (aln_id * 16 + 1) || '-' || (aln_id * 16 + 16) || ';' || chr(10), '' order by aln_id) || 'end;' || chr(10) as text from g""")
def partition_file(spark, d):
    from .operators.alignment import supermatrix_partitions

    rows = supermatrix_partitions(part_alignment(spark, d)).orderBy("start").collect()  # a row per locus
    path = fresh(spark, "partitions")
    put_file(spark, path, sinks.partition_text(rows))
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


@query("select n_name || '__' || s_suppkey || ' ' || n_name as line from supplier join nation on s_nationkey = n_nationkey")
def gene_species_file(spark, d):
    x = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    lines = sinks.gene_species_lines(x.select(F.concat("n_name", F.lit("__"), F.col("s_suppkey").cast("string")).alias("seq_id")))
    return spark.read.text(put(lines, "mapping")).select(F.col("value").alias("line"))


@query("""with n as (select n_name, n_regionkey, n_nationkey from nation)
select 'bars' as kind, concat_ws(chr(10), 'DATASET_SIMPLEBAR', 'SEPARATOR COMMA', 'DATASET_LABEL,keys', 'COLOR,#848991', 'DATA', string_agg(n_name || ',' || n_nationkey, chr(10) order by n_name)) || chr(10) as text from n
union all select 'traits', concat_ws(chr(10), 'DATASET_BINARY', 'SEPARATOR COMMA', 'DATASET_LABEL,odd', 'COLOR,#848991', 'FIELD_LABELS,odd,even', 'FIELD_COLORS,#1F77B4,#FF7F0E', 'FIELD_SHAPES,1,1', 'DATA',
  string_agg(n_name || ',' || n_nationkey % 2 || ',' || (n_nationkey + 1) % 2, chr(10) order by n_name)) || chr(10) from n
union all select 'labels', concat_ws(chr(10), 'LABELS', 'SEPARATOR COMMA', 'DATA', string_agg(n_name || ',N' || n_nationkey, chr(10) order by n_name)) || chr(10) from n
union all select 'strip', concat_ws(chr(10), 'DATASET_COLORSTRIP', 'SEPARATOR COMMA', 'DATASET_LABEL,side', 'COLOR,#848991', 'LEGEND_TITLE,side', 'LEGEND_SHAPES,1,1', 'LEGEND_COLORS,#FF0000,#0000FF', 'LEGEND_LABELS,even,odd', 'DATA',
  string_agg(n_name || ',' || case when n_nationkey % 2 = 0 then '#FF0000,even' else '#0000FF,odd' end, chr(10) order by n_name)) || chr(10) from n
union all select 'pies', concat_ws(chr(10), 'DATASET_PIECHART', 'SEPARATOR COMMA', 'DATASET_LABEL,pies', 'COLOR,#848991', 'FIELD_LABELS,x,y', 'FIELD_COLORS,#1F77B4,#FF7F0E', 'DATA',
  string_agg(n_name || ',0.5,1,' || n_regionkey || ',' || n_nationkey, chr(10) order by n_name)) || chr(10) from n""")
def viewer_datasets(spark, d):
    """Texts for a tree viewer over the nations, which are a tree's leaves."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("node"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("x"))
    odd = n.select("node", (F.col("k") % 2).alias("odd"), ((F.col("k") + 1) % 2).alias("even"))
    even = F.col("k") % 2 == 0
    strip = n.select("node", F.when(even, "#FF0000").otherwise("#0000FF").alias("colour"), F.when(even, "even").otherwise("odd").alias("group"), F.col("k").alias("ord"))
    texts = [
        ("bars", sinks.bar_dataset(n.withColumnRenamed("k", "value"), "keys")), ("traits", sinks.binary_dataset(odd, ["odd", "even"], "odd")),
        ("labels", sinks.leaf_labels(n.select(F.col("node").alias("name"), F.concat(F.lit("N"), F.col("k").cast("string")).alias("new_name")))),
        ("strip", sinks.colour_strip(strip, "side")), ("pies", sinks.pie_dataset(n.withColumn("y", F.col("k")), ["x", "y"])),
    ]
    return spark.createDataFrame(texts, "kind string, text string")


@query("""select 'families' as kind, '[FAMILIES]' || chr(10) || string_agg('- ' || r_name || chr(10) || 'alignment = a' || r_regionkey || chr(10) || 'mapping = m' || r_regionkey || chr(10) || 'subst_model = LG+G' || chr(10), '' order by r_regionkey) as text from region
union all select 'control', '     seqfile = s' || chr(10) || '    treefile = t' || chr(10) || '     outfile = o' from region where r_regionkey = 0""")
def control_files(spark, d):
    r = sorted((x["r_regionkey"], x["r_name"]) for x in table(spark, d, "region").collect())  # five
    families = reconciliation_families([n for _, n in r], [f"a{k}" for k, _ in r], [f"m{k}" for k, _ in r])
    control = "\n".join(codeml_control("s", "t", "o").split("\n")[:3])
    return spark.createDataFrame([("families", families), ("control", control)], "kind string, text string")


@query("select o_orderpriority as priority, round(avg(o_totalprice), 2) + 0e0 as mean, round(median(o_totalprice), 2) + 0e0 as median, round(max(o_totalprice), 2) + 0e0 as most from orders group by 1")
def grouped_report(spark, d):
    """A headed report of means, medians and maxima, and a second without a header, from files."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.avg("o_totalprice").alias("mean"), F.median("o_totalprice").alias("median"), F.max("o_totalprice").alias("most"))
    x = g.select("priority", *[rounded(F.col(c), 2).alias(c) for c in ("mean", "median", "most")])
    path, bare = fresh(spark, "grouped"), fresh(spark, "bare")
    sinks.write_table(x, path, sep=",")
    sinks.write_table(x.select("priority"), bare, header=False)
    own = spark.read.csv(bare, schema="priority string")
    return spark.read.csv(path, header=True, schema="priority string, mean double, median double, most double").join(own, "priority", "left_semi")
