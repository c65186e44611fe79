"""Every operator on the driver's tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import maths, sequence
from .operators import alignment, ancestral, cluster, expression, genome, information, kmers, plotdata, structure, tables, tree
from .plans.session import rounded, spread
from .sources import readers
from .streaming import events as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(x) if name == "documents" else x  # long texts: a row is work


def _long(df: DataFrame) -> DataFrame:
    """Integer columns as long, so that both engines name one type."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _six(df: DataFrame, *names: str) -> DataFrame:
    return _long(df.withColumns({n: rounded(F.col(n)) for n in names}))


# ---- alignments: part names as sequences -----------------------------------------------------------------


def part_alignment(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    return x.select((F.col("p_partkey") % 7).alias("aln_id"), F.col("p_partkey").alias("seq_id"), F.rpad("p_name", 16, "-").alias("seq"), F.col("p_partkey").alias("ord"))


def part_cells(spark: SparkSession, d: str) -> DataFrame:
    return alignment.cells(part_alignment(spark, d))


_ALN = "aln as (select p_partkey % 7 as aln_id, p_partkey as seq_id, rpad(p_name, 16, '-') as seq from part)"
_CELLS = _ALN + ", cells as (select aln_id, seq_id, i - 1 as pos, upper(substr(seq, i, 1)) as ch from aln, generate_series(1, 16) t(i))"
_FREQ = _CELLS + ", freq as (select aln_id, pos, ch, count(*) as n, count(*) * 1e0 / sum(count(*)) over (partition by aln_id, pos) as freq from cells group by 1, 2, 3)"
_R = "round({}, 6) + 0e0"


@query(f"with {_CELLS} select aln_id, seq_id, pos, ch from cells")
def aln_cells(spark, d):
    return _long(part_cells(spark, d))


@query(f"with {_FREQ} select aln_id, pos, ch, n, round(freq, 6) + 0e0 as freq from freq")
def column_frequency(spark, d):
    return _six(alignment.column_frequency(part_cells(spark, d)), "freq")


@query(f"with {_FREQ} select aln_id, pos, round(-sum(case when ch <> '-' then freq * log2(freq) else 0 end), 6) + 0e0 as entropy from freq group by 1, 2")
def column_entropy(spark, d):
    return _six(alignment.column_entropy(part_cells(spark, d)), "entropy")


@query(f"""with {_CELLS}, good as (select aln_id, pos from cells group by 1, 2 having avg(case when ch = '-' then 1e0 else 0e0 end) < 0.2)
select aln_id, seq_id, string_agg(ch, '' order by pos) as seq from cells join good using (aln_id, pos) group by 1, 2""")
def drop_gappy_columns(spark, d):
    return alignment.rejoin(alignment.drop_gappy_columns(part_cells(spark, d), 0.2))


@query(f"""with {_FREQ}, good as (select aln_id, pos from freq group by 1, 2
  having coalesce(max(freq) filter (ch in ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y','-')), 0) <= 0.3)
select aln_id, pos from good""")
def drop_homogeneous_columns(spark, d):
    return _long(alignment.drop_homogeneous_columns(part_cells(spark, d), 0.3).select("aln_id", "pos").distinct())


@query(f"with {_CELLS} select aln_id, seq_id, pos, row_number() over (partition by aln_id, seq_id order by pos) - 1 as ungapped from cells where ch <> '-'")
def map_unaligned_to_aligned(spark, d):
    return _long(alignment.map_unaligned_to_aligned(part_cells(spark, d)))


@query(f"""with {_CELLS}, per as (select aln_id, pos, count(*) as n, count(distinct case when ch not in ('-', '.', '?', 'X') then ch end) as kinds,
  count(*) filter (ch in ('-', '.')) as gaps from cells group by 1, 2)
select aln_id, max(n) as taxa, count(*) as length, count(*) filter (kinds > 1) as variable_sites, round(1e2 * sum(gaps) / sum(n), 6) + 0e0 as gap_percent from per group by 1""")
def alignment_stats(spark, d):
    return _six(alignment.alignment_stats(part_cells(spark, d)), "gap_percent")


@query(f"""with {_CELLS}, cod as (select aln_id, seq_id, pos // 3 as k, string_agg(ch, '' order by pos) as codon from cells group by 1, 2, 3),
  good as (select aln_id, k from cod where length(codon) = 3 group by 1, 2 having avg(case when contains(codon, '-') then 1e0 else 0e0 end) <= 0.4)
select cells.aln_id, seq_id, string_agg(ch, '' order by pos) as seq from cells join good on good.aln_id = cells.aln_id and good.k = cells.pos // 3 group by 1, 2""")
def trim_gap_rich_codons(spark, d):
    return alignment.rejoin(alignment.trim_gap_rich_codons(part_cells(spark, d), 0.4))


@query(f"""with {_CELLS}, cod as (select aln_id, seq_id, pos // 3 as k, string_agg(ch, '' order by pos) as codon from cells group by 1, 2, 3)
select aln_id, k + 1 as codon, k * 3 + 1 as start_column, round(avg(case when contains(codon, '-') then 1e0 else 0e0 end), 6) + 0e0 as gap_share,
  count(distinct case when not contains(codon, '-') then codon end) as kinds,
  avg(case when contains(codon, '-') then 1e0 else 0e0 end) >= 0.4 as gap_rich, count(distinct case when not contains(codon, '-') then codon end) <= 1 as invariant
from cod where length(codon) = 3 group by aln_id, k""")
def codon_column_qc(spark, d):
    return _six(alignment.codon_column_qc(part_cells(spark, d), 0.4), "gap_share")


@query("""with x as (select s_nationkey as aln_id, s_suppkey as seq_id, translate(s_name || cast(s_suppkey * 7919 as varchar), '0123456789', 'ACGTACGTA-') as seq from supplier)
select aln_id, seq_id, length(seq) as length, length(seq) % 3 = 0 as in_frame, length(replace(upper(seq), '-', '')) as bases,
  length(regexp_replace(replace(replace(upper(seq), '-', ''), 'U', 'T'), '[ACGT]', '', 'g')) as ambiguous_bases,
  len(list_filter(regexp_extract_all(seq, '-+'), lambda r: length(r) % 3 <> 0)) as frame_breaking_gaps from x""")
def codon_sequence_qc(spark, d):
    x = table(spark, d, "supplier").select(F.col("s_nationkey").alias("aln_id"), F.col("s_suppkey").alias("seq_id"), F.translate(F.concat("s_name", (F.col("s_suppkey") * 7919).cast("string")), "0123456789", "ACGTACGTA-").alias("seq"))
    return _long(alignment.codon_sequence_qc(x).select("aln_id", "seq_id", "length", "in_frame", "bases", "ambiguous_bases", "frame_breaking_gaps"))


_SUPP = "aln as (select s_nationkey as aln_id, s_suppkey as seq_id, translate(s_name, '0', '-') as seq from supplier)"


def supplier_alignment(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("aln_id"), F.col("s_suppkey").alias("seq_id"), F.translate("s_name", "0", "-").alias("seq"))


@query(f"""with {_CELLS}, known as (select * from cells where ch in ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')),
  share as (select aln_id, ch, count(*) * 1e0 / sum(count(*)) over (partition by aln_id) as share from known group by 1, 2),
  own as (select aln_id, seq_id, count(*) as n from known group by 1, 2), seen as (select aln_id, seq_id, ch, count(*) as o from known group by 1, 2, 3),
  chi as (select own.aln_id, own.seq_id, sum(pow(coalesce(o, 0) - n * share, 2) / (n * share)) as chi2 from own join share on own.aln_id = share.aln_id
    left join seen on seen.aln_id = own.aln_id and seen.seq_id = own.seq_id and seen.ch = share.ch group by 1, 2)
select c.aln_id, c.seq_id, c.g as gap_ambiguity_share, round(chi2, 6) + 0e0 as chi2 from
  (select aln_id, seq_id, round(avg(case when ch in ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y') then 0e0 else 1e0 end), 6) + 0e0 as g from cells group by 1, 2) c
  left join chi using (aln_id, seq_id)""")
def composition_chi2(spark, d):
    return _six(alignment.composition_chi2(part_cells(spark, d), with_p=False), "gap_ambiguity_share", "chi2")


@query(f"""with {_CELLS}, known as (select * from cells where ch in ('A','C','D','E','F','G','H','I','K','L','M','N','P','Q','R','S','T','V','W','Y')),
  share as (select aln_id, ch, count(*) * 1e0 / sum(count(*)) over (partition by aln_id) as share from known group by 1, 2),
  own as (select aln_id, seq_id, count(*) as n from known group by 1, 2), seen as (select aln_id, seq_id, ch, count(*) as o from known group by 1, 2, 3),
  chi as (select own.aln_id, own.seq_id, sum(pow(coalesce(o, 0) - n * share, 2) / (n * share)) as chi2 from own join share on own.aln_id = share.aln_id
    left join seen on seen.aln_id = own.aln_id and seen.seq_id = own.seq_id and seen.ch = share.ch group by 1, 2),
  p as (select aln_id, seq_id, chi2, greatest(0, 1 - list_sum(list_transform(generate_series(0, 300), lambda i: exp(-chi2 / 2 + (95e-1 + i) * ln(chi2 / 2) - lgamma(105e-1 + i))))) as p from chi)
select aln_id, seq_id, round(chi2, 6) + 0e0 as chi2, round(p, 6) + 0e0 as p, p >= 0.05 as passes from p""")
def composition_p_values(spark, d):
    x = alignment.passes_composition(alignment.composition_chi2(part_cells(spark, d)), most_gaps=1.0)
    return _six(x.select("aln_id", "seq_id", "chi2", "p", "passes"), "chi2", "p")


@query(f"""with {_ALN}, g as (select aln_id, max(length(seq)) as sites, count(distinct seq_id) as taxa_present from aln group by 1)
select aln_id, sum(sites) over (order by aln_id)::bigint - sites + 1 as start, sum(sites) over (order by aln_id)::bigint as "end", sites, taxa_present from g""")
def supermatrix_partitions(spark, d):
    return _long(alignment.supermatrix_partitions(part_alignment(spark, d)))


@query("""with a as (select o_orderpriority as aln_id, c_nationkey as seq_id, lpad(cast(count(*) as varchar), 6, 'A') as seq from orders join customer on o_custkey = c_custkey
    group by 1, 2),
  x as (select l.aln_id, n.seq_id, coalesce(a.seq, repeat('-', l.sites)) as seq from (select distinct seq_id from a) n
    cross join (select aln_id, max(length(seq)) as sites from a group by 1) l left join a on a.aln_id = l.aln_id and a.seq_id = n.seq_id)
select seq_id, string_agg(seq, '' order by aln_id) as seq from x group by 1""")
def supermatrix_sequences(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    a = o.groupBy(F.col("o_orderpriority").alias("aln_id"), F.col("c_nationkey").alias("seq_id")).agg(F.lpad(F.count("*").cast("string"), 6, "A").alias("seq"))
    return _long(alignment.supermatrix(a))


@query(f"""with {_FREQ}, every as (select aln_id, pos, ch from (select distinct aln_id, pos from freq), (values ('A'), ('C'), ('G'), ('T')) v(ch)),
  f as (select e.aln_id, e.pos, e.ch, coalesce(freq, 0) as f from every e left join freq using (aln_id, pos, ch)),
  h as (select aln_id, pos, -sum(case when f > 0 then f * log2(f) else 0 end) as h from f group by 1, 2)
select aln_id, pos + 1 as pos, ch, round(f * (2 - h), 6) + 0e0 as value from f join h using (aln_id, pos)""")
def logo_bits(spark, d):
    return _six(alignment.logo_matrix(part_cells(spark, d), "dna"), "value")


@query("""with x as (select p_brand as b, p_partkey as id, p_type as seq, case when instr(p_type, 'AN') = 0 then -1 else instr(p_type, 'AN') - 1 end as place from part),
  y as (select b, id, repeat('-', (max(place) over (partition by b) - place)::int) || seq as a from x)
select b, id, rpad(a, max(length(a)) over (partition by b)::int, '-') as aligned from y""")
def align_by_motif(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("id"), F.col("p_type").alias("seq"))
    return alignment.align_by_motif(x, "AN", ["b"]).select("b", "id", "aligned")


@query(f"""with {_ALN}, x as (select aln_id, seq_id, substr(seq, 3, 1) as symbol from aln), n as (select *, count(*) over (partition by aln_id, symbol) as n from x)
select *, row_number() over (partition by aln_id order by n desc, seq_id) as place from n""")
def by_column_commonness(spark, d):
    return _long(alignment.by_column_commonness(part_alignment(spark, d), 2).select("aln_id", "seq_id", "symbol", "n", "place"))


@query(f"""with {_SUPP}, p as (select a.aln_id, a.seq_id as a, b.seq_id as b, a.seq as x, b.seq as y from aln a join aln b on a.aln_id = b.aln_id and a.seq_id < b.seq_id),
  c as (select aln_id, a, b, upper(substr(x, i, 1)) as p, upper(substr(y, i, 1)) as q from p, generate_series(1, 18) t(i))
select aln_id, a, b, round(avg(case when p = q then 0e0 else 1e0 end) filter (p <> '-' and q <> '-'), 6) + 0e0 as dist from c where p <> '' and q <> '' group by 1, 2, 3""")
def identity_distance(spark, d):
    return _six(alignment.identity_distances(supplier_alignment(spark, d)), "dist")


_ID = """c as (select a.aln_id, a.seq_id as a, b.seq_id as b, upper(substr(a.seq, i, 1)) as p, upper(substr(b.seq, i, 1)) as q
    from aln a join aln b on a.aln_id = b.aln_id and a.seq_id < b.seq_id, generate_series(1, 18) t(i)),
  e as (select aln_id, a, b, avg(case when p = q then 0e0 else 1e0 end) filter (p <> '-' and q <> '-') as dist from c where p <> '' and q <> '' group by 1, 2, 3)"""


@query(f"""with {_SUPP}, {_ID}, f as (select aln_id, a, b, dist from e union all select aln_id, b, a, dist from e union all select aln_id, seq_id, seq_id, 0e0 from aln),
  m as (select aln_id as cluster, a as id, round(avg(dist), 9) as mean from f group by 1, 2)
select cluster, id from (select *, row_number() over (partition by cluster order by mean, id) as r from m) where r = 1""")
def cluster_medoid(spark, d):
    a = supplier_alignment(spark, d)
    e = alignment.identity_distances(a).withColumn("dist", F.round("dist", 12))
    return _long(cluster.medoids(e, a.select(F.col("seq_id").alias("id"), F.col("aln_id").alias("cluster"))))


@query(f"""with recursive {_SUPP}, {_ID}, g as (select a, b from e where dist <= 0.1 union select b, a from e where dist <= 0.1),
  ids as (select a as id from e union select b from e),
  walk(id, c) as (select id, id from ids union select g.b, walk.c from walk join g on g.a = walk.id)
select id, min(c) as component from walk group by 1""")
def single_linkage(spark, d):
    return cluster.single_linkage_of_rows(supplier_alignment(spark, d), 0.9)


@query()
def upgma_cut(spark, d):
    e = alignment.identity_distances(supplier_alignment(spark, d)).na.fill(1.0, ["dist"])
    return cluster.upgma_clusters(e, 0.1)


@query()
def upgma_newick(spark, d):
    return cluster.upgma_newick(alignment.identity_distances(supplier_alignment(spark, d)).na.fill(1.0, ["dist"]))


# ---- sequences -------------------------------------------------------------------------------------------


@query("""with c as (select string_split(text, '') as l from documents where length(text) >= 3),
  k as (select unnest(list_transform(generate_series(1, len(l) - 2), lambda i: l[i] || l[i + 1] || l[i + 2])) as kmer from c)
select kmer, count(*) as n from k group by 1""")
def kmer_count_3(spark, d):
    return kmers.count_kmers(table(spark, d, "documents").select(F.col("text").alias("seq")), 3, None)


@query("""with c as (select string_split(text, '') as l from documents where length(text) >= 2),
  k as (select unnest(list_transform(generate_series(1, len(l) - 1), lambda i: l[i] || l[i + 1])) as kmer from c), n as (select kmer, count(*) as n from k group by 1)
select kmer, n, round(log2(n / (sum(n) over () / 16e0)), 6) + 0e0 as enrichment from n""")
def kmer_enrichment_log2(spark, d):
    c = kmers.count_kmers(table(spark, d, "documents").select(F.col("text").alias("seq")), 2, None)
    x = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))  # one row
    return _six(x.select("kmer", "n", kmers.log_enrichment(F.col("n"), F.col("total"), 2).alias("enrichment")), "enrichment")


_DNA = "translate(cast(p_partkey * 7919 as varchar), '0123456789', 'ACGTRYKMNA')"


def part_dna(spark, d):
    return table(spark, d, "part").select("p_partkey", F.translate((F.col("p_partkey") * 7919).cast("string"), "0123456789", "ACGTRYKMNA").alias("seq"))


@query(f"select p_partkey, reverse(translate({_DNA}, 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) as rc, translate({_DNA}, 'T', 'U') as rna from part")
def reverse_complement(spark, d):
    return part_dna(spark, d).select("p_partkey", sequence.reverse_complement("seq").alias("rc"), sequence.dna_to_rna("seq").alias("rna"))


@query(f"""with x as (select p_partkey, {_DNA} as seq from part), c as (select p_partkey, i, substr(seq, i, 1) as ch from x, generate_series(1, 10) t(i) where i <= length(seq))
select p_partkey, string_agg(case ch when 'R' then '[AG]' when 'Y' then '[CT]' when 'K' then '[GT]' when 'M' then '[AC]' when 'N' then '[ACGT]' else ch end, '' order by i) as pattern from c group by 1""")
def degenerate_regex(spark, d):
    return part_dna(spark, d).select("p_partkey", sequence.degenerate_regex("seq").alias("pattern"))


@query(f"""with x as (select p_partkey, {_DNA} as seq from part), c as (select p_partkey, substr(seq, i, 1) as ch from x, generate_series(1, 10) t(i) where i <= length(seq))
select p_partkey, cast(round(exp(sum(ln(case when ch in ('R', 'Y', 'K', 'M') then 2 when ch = 'N' then 4 else 1 end)))) as bigint) as n from c group by 1""")
def expand_degenerate(spark, d):
    return part_dna(spark, d).select("p_partkey", F.size(F.array_distinct(sequence.expand_degenerate("seq"))).cast("long").alias("n"))


@query(f"""with x as (select p_partkey, replace(upper({_DNA}), 'U', 'T') as seq from part), c as (select p_partkey, i, substr(seq, 3 * i + 1, 3) as c from x, generate_series(0, 9) t(i) where 3 * i + 3 <= length(seq)),
  a as (select p_partkey, i, case when regexp_full_match(c, '[TCAG][TCAG][TCAG]') then substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG',
    (16 * (instr('TCAG', c[1]) - 1) + 4 * (instr('TCAG', c[2]) - 1) + instr('TCAG', c[3]))::int, 1) else 'X' end as aa from c)
select p.p_partkey, coalesce(string_agg(aa, '' order by i), '') as protein from part p left join a on a.p_partkey = p.p_partkey group by 1""")
def translated_codons(spark, d):
    return part_dna(spark, d).select("p_partkey", sequence.translate_codons("seq").alias("protein"))


@query("""with s as (select p_partkey as seq_id, p_name || p_type as seq from part),
  h as (select seq_id, seq, i - 1 as place from s, generate_series(1, 80) t(i) where i <= length(seq)),
  f as (select seq_id, seq, place from h where lower(substr(seq, place + 1, 1)) = 'a'), r as (select seq_id, place + 2 as e from h where lower(substr(seq, place + 1, 2)) = 'an')
select f.seq_id, place as start, e as "end", e - place as length, substr(seq, place + 1, e - place) as amplicon from f join r using (seq_id) where e - place between 5 and 20""")
def primer_amplicons(spark, d):
    s = table(spark, d, "part").select(F.col("p_partkey").alias("seq_id"), F.concat("p_name", "p_type").alias("seq"))
    return _long(genome.amplicons(s, "a", "an", 5, 20))


@query("""with x as (select p_partkey as id, 3 + p_partkey % 5 as k, 2 + p_size % 7 as n from part)
select id, 0::bigint as start, (2 * k + n - 1)::bigint as "end", repeat('(', k::int) || repeat('.', n::int) || repeat(')', k::int) as hairpin_structure, repeat('G', (2 * k + n)::int) as hairpin_seq from x where n >= 3""")
def hairpin_spans(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.expr("repeat('(', 3 + p_partkey % 5)"), F.expr("repeat('.', 2 + p_size % 7)"), F.expr("repeat(')', 3 + p_partkey % 5)")).alias("structure"))
    return _long(structure.hairpins(x.withColumn("seq", F.expr("repeat('g', length(structure))"))))


@query("select s_suppkey as id, 14e0 as score, (instr(s_name, 'lier#00') - 1)::bigint as start, (instr(s_name, 'lier#00') + 6)::bigint as \"end\" from supplier")
def local_alignments(spark, d):
    return _long(structure.local_alignments(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("lier#00").alias("primer"), F.col("s_name").alias("sequence"))))


# ---- grouped tables ---------------------------------------------------------------------------------------

_LINE_ORDER = "l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax"


@query(f"""select l_suppkey, l_orderkey, l_linenumber, round(l_extendedprice, 6) + 0e0 as l_extendedprice from
  (select *, row_number() over (partition by l_suppkey order by {_LINE_ORDER}) as r from lineitem) where r = 1""")
def best_hit_per_group(spark, d):
    ties = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax")]
    x = tables.best_hits(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_extendedprice").desc(), ties)
    return _six(x.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice")


@query("""with f as (select l_suppkey as accession, l_partkey as hit, row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_partkey) as r from lineitem group by 1, 2),
  b as (select l_suppkey as accession, l_orderkey as hit, row_number() over (partition by l_suppkey order by sum(l_quantity) desc, l_orderkey) as r from lineitem group by 1, 2)
select f.accession, f.hit as forward_hit, b.hit as reverse_hit, b.hit = 1 as recip_best_hit from f join b using (accession) where f.r = 1 and b.r = 1""")
def reciprocal_best_hit(spark, d):
    x = table(spark, d, "lineitem")
    best = lambda c: tables.first_per_group(x.groupBy(F.col("l_suppkey").alias("accession"), F.col(c).alias("hit")).agg(F.sum("l_quantity").alias("q")), ["accession"], [F.col("q").desc(), F.col("hit")])
    return tables.reciprocal_best_hits(best("l_partkey"), best("l_orderkey"), 1).select("accession", "forward_hit", "reverse_hit", "recip_best_hit")


def line_domains(spark, d):
    """Orders as proteins, their lines as domains."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("query_name"), F.concat("l_returnflag", "l_linestatus").alias("target_name"), F.concat_ws(".", F.concat(F.lit("PF"), "l_returnflag"), F.lit("1")).alias("target_accession"),
        F.col("l_partkey").alias("ali_from"), F.col("l_suppkey").alias("ali_to"), F.col("l_discount").alias("i_evalue"),
    )


@query("""select l_orderkey as query_name, count(*) as domain_count,
  string_agg(l_returnflag || l_linestatus, '  |  ' order by l_partkey, l_suppkey, l_discount, l_returnflag || l_linestatus) as domains,
  string_agg('PF' || l_returnflag, '  |  ' order by l_partkey, l_suppkey, l_discount, l_returnflag || l_linestatus) as accessions from lineitem group by 1""")
def domain_architecture(spark, d):
    return _long(tables.domain_architectures(line_domains(spark, d)))


@query("""with f as (select l_orderkey as query_name, min(l_partkey) filter (l_returnflag = 'A') as a, min(l_partkey) filter (l_returnflag = 'N') as n, min(l_partkey) filter (l_returnflag = 'R') as r from lineitem group by 1)
select query_name, a as a_from, n as n_from, r as r_from, case when n is null then 'no_n' when a < n then 'a_first' when r < n then 'r_first' else 'n_first' end as class from f""")
def architecture_class(spark, d):
    kinds = {k: F.col("target_name").startswith(k.upper()) for k in ("a", "n", "r")}
    ladder = lambda c: F.when(c["n"].isNull(), "no_n").when(c["a"] < c["n"], "a_first").when(c["r"] < c["n"], "r_first").otherwise("n_first")
    return tables.classify_architectures(line_domains(spark, d), kinds, ladder)


@query("""with x as (select o_custkey as gene_locus_id, l_orderkey as query_name, l_extendedprice as s, l_partkey - l_suppkey as cov, o_totalprice as len, l_suppkey as f, l_partkey as t from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R')
select gene_locus_id, query_name, round(s, 6) + 0e0 as domain_score, f as env_from, t as env_to from
  (select *, row_number() over (partition by gene_locus_id order by s desc, cov desc, len desc, query_name, f) as r from x) where r = 1""")
def locus_representatives(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_name"), F.concat(F.lit("PF"), "l_returnflag", F.lit(".2")).alias("target_accession"), F.col("l_extendedprice").alias("domain_score"), F.col("l_suppkey").alias("env_from"), F.col("l_partkey").alias("env_to"))
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("sequence_id"), F.col("o_custkey").alias("gene_locus_id"), F.col("o_totalprice").alias("protein_length"))
    return _six(tables.locus_representatives(hits, meta, "PFR").select("gene_locus_id", "query_name", "domain_score", "env_from", "env_to"), "domain_score")


@query("""with x as (select doc_id as protein_id, n_chars as length, case when doc_id % 11 = 0 then null else lang || source end as gene_id from documents),
  y as (select *, row_number() over (partition by coalesce('gene:' || gene_id, 'protein:' || protein_id) order by length desc, protein_id) as r,
    count(*) over (partition by coalesce('gene:' || gene_id, 'protein:' || protein_id)) as isoforms from x)
select protein_id, length, gene_id, isoforms, r = 1 as selected,
  case when gene_id is null then 'unmapped' when isoforms = 1 then 'only_isoform' when r = 1 then 'longest' else 'shorter' end as reason from y""")
def longest_isoform_audit(spark, d):
    x = table(spark, d, "documents")
    genes = x.filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("protein_id"), F.concat("lang", "source").alias("gene_id"))
    return tables.longest_isoforms(x.select(F.col("doc_id").alias("protein_id"), F.col("n_chars").alias("length")), genes)


@query("""with c as (select l_orderkey as protein_id, case when l_linenumber = 5 then l_partkey else l_orderkey end as parent from lineitem), t as (select o_orderkey as parent, o_custkey as gene from orders where o_orderkey % 3 <> 0),
  x as (select protein_id, coalesce(gene, c.parent) as gene_id from c left join t on t.parent = c.parent)
select protein_id, min(gene_id) as gene_id from x group by 1 having min(gene_id) = max(gene_id)""")
def gene_resolution(spark, d):
    none = F.lit(None).cast("long")
    cds = table(spark, d, "lineitem").select(F.lit("CDS").alias("type"), none.alias("id"), F.when(F.col("l_linenumber") == 5, F.col("l_partkey")).otherwise(F.col("l_orderkey")).alias("parent"), F.col("l_orderkey").alias("protein_id"))
    mrna = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.lit("mRNA").alias("type"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"), none.alias("protein_id"))
    return tables.resolve_genes(cds.unionByName(mrna))


@query("""select c_custkey, 'd__' || r_name || ';p__' || n_name || ';c__;o__;f__' || n_nationkey || ';g__;s__' as lineage from customer
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def taxonomy_lineage(spark, d):
    none = F.lit(None).cast("string")
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = t.select(F.col("n_nationkey").alias("taxid"), F.col("r_name").alias("domain"), F.col("n_name").alias("phylum"), none.alias("class"), none.alias("order"), F.col("n_nationkey").cast("string").alias("family"), none.alias("genus"), none.alias("species"))
    a = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("taxid"))
    return tables.taxonomy_lineage(a, t).select("c_custkey", "lineage")


def order_statuses(spark, d):
    """Markers by customer bucket, assemblies by priority; repeated records collapse."""
    s = F.element_at(F.create_map(*[F.lit(x) for x in ("O", "Complete", "F", "Duplicated", "P", "Fragmented")]), F.col("o_orderstatus"))
    return table(spark, d, "orders").select((F.col("o_custkey") % 997).alias("busco_id"), F.col("o_orderpriority").alias("assembly"), s.alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").cast("string").alias("sequence"))


_STATUS = """r as (select o_custkey % 997 as busco_id, o_orderpriority as assembly, case o_orderstatus when 'O' then 'Complete' when 'F' then 'Duplicated' else 'Fragmented' end as status,
    o_totalprice as score, cast(o_orderkey as varchar) as sequence from orders),
  c as (select * from (select *, row_number() over (partition by busco_id, assembly order by case status when 'Duplicated' then 1 when 'Complete' then 2 else 3 end, score desc, sequence) as k from r) where k = 1),
  m as (select b.busco_id, a.assembly, coalesce(c.status, 'Missing') as status, coalesce(c.sequence, '') as sequence from (select distinct busco_id from c) b cross join (select distinct assembly from c) a
    left join c on c.busco_id = b.busco_id and c.assembly = a.assembly)"""


@query(f"with {_STATUS} select busco_id, assembly, status, sequence from m")
def status_matrix(spark, d):
    return tables.status_long(tables.collapse_statuses(order_statuses(spark, d)))


@query(f"""with {_STATUS} select assembly, count(*) as total, count(*) filter (status = 'Complete') as complete, count(*) filter (status = 'Duplicated') as duplicated,
  round(1e2 * count(*) filter (status in ('Complete', 'Duplicated')) / count(*), 6) + 0e0 as complete_percent,
  case when 1e2 * count(*) filter (status in ('Complete', 'Duplicated')) / count(*) < 80 then 'exclude' when 1e2 * count(*) filter (status in ('Complete', 'Duplicated')) / count(*) < 90 then 'marginal' else 'preferred' end as category
from m group by 1""")
def assembly_completeness(spark, d):
    x = tables.classify_completeness(tables.summarise_assemblies(status_matrix(spark, d)))
    return _six(x.select("assembly", "total", "complete", "duplicated", "complete_percent", "category"), "complete_percent")


@query(f"""with {_STATUS} select busco_id, count(*) filter (status = 'Duplicated') as duplicated, count(*) filter (status = 'Complete') as complete, count(*) filter (status = 'Fragmented') as fragmented,
  count(*) filter (status = 'Missing') as missing, bool_or(status = 'Complete' and assembly = '1-URGENT') as in_outgroup,
  count(*) filter (status = 'Complete') >= 2 and bool_or(status = 'Complete' and assembly = '1-URGENT') and count(*) filter (status = 'Duplicated') = 0 as selected from m group by 1""")
def marker_selection(spark, d):
    return tables.select_markers(status_matrix(spark, d), 2, ["1-URGENT"])


@query("select l_suppkey, max(case when l_shipdate is not null and l_returnflag = 'A' then 1 else 0 end)::bigint as \"A\", max(case when l_returnflag = 'N' then 1 else 0 end)::bigint as \"N\", max(case when l_returnflag = 'R' then 1 else 0 end)::bigint as \"R\" from lineitem group by 1")
def presence_matrix(spark, d):
    return _long(tables.presence_matrix(table(spark, d, "lineitem"), "l_suppkey", "l_returnflag", ["A", "N", "R"]))


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey) as r from part) where r = 1")
def rank_representative(spark, d):
    return tables.rank_representatives(table(spark, d, "part").withColumn("accession", F.col("p_partkey")), "p_brand").select("p_brand", "p_partkey")


@query("select p_partkey, (row_number() over (order by p_partkey) - 1) // 100 as chunk from part")
def fixed_chunks(spark, d):
    return _long(tables.fixed_chunks(table(spark, d, "part"), 100, [F.col("p_partkey")]).select("p_partkey", "chunk"))


@query("""select event_type, count(*) as n, count(json_extract_string(props, '$.k')) as known, sum(coalesce(cast(json_extract_string(props, '$.k') as bigint), 0))::bigint as total from events group by 1""")
def nested_summary(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("known"), F.sum(F.coalesce(k, F.lit(0))).alias("total"))


@query("select p_partkey, 'p' || p_partkey as id, p_brand as name, cast(p_size as varchar) || '=x' as note from part")
def gff_attribute_map(spark, d):
    text = F.concat(F.lit("ID=old;ID=p"), F.col("p_partkey").cast("string"), F.lit(";flag;Name="), "p_brand", F.lit(";Note="), F.col("p_size").cast("string"), F.lit("=x"))
    m = table(spark, d, "part").select("p_partkey", readers.attribute_map(text).alias("attributes"))
    return m.select("p_partkey", readers.attribute("ID").alias("id"), readers.attribute("Name").alias("name"), readers.attribute("Note").alias("note"))


# ---- genome geometry: lineitem as genes, documents as contigs ------------------------------------------------


def order_genes(spark, d):
    """Orders as genes on customers' contigs, strand by status."""
    x = table(spark, d, "orders")
    start = (F.col("o_orderkey") * 37 % 5000 + 1).cast("long")
    return x.select(F.col("o_orderkey").alias("gene_id"), (F.col("o_custkey") % 50).alias("contig"), start.alias("start"), (start + 90).alias("end"), F.when(F.col("o_orderstatus") == "O", "+").otherwise("-").alias("strand"))


_GENES = "g as (select o_orderkey as gene_id, o_custkey % 50 as contig, o_orderkey * 37 % 5000 + 1 as s, o_orderkey * 37 % 5000 + 91 as e, case when o_orderstatus = 'O' then '+' else '-' end as strand from orders)"


@query(f"""with {_GENES}, x as (select gene_id, coalesce(s - lag(e) over w, 'infinity'::double) as before, coalesce(lead(s) over w - e, 'infinity'::double) as after from g window w as (partition by contig, strand order by s, e, gene_id))
select gene_id, before, after from x where before > -50 and after > -50""")
def neighbor_clearance(spark, d):
    return genome.without_neighbours(order_genes(spark, d), -50).select("gene_id", "before", "after")


@query(f"""with {_GENES}, x as (select contig, gene_id, s, strand, lag(gene_id) over w as lg, lag(strand) over w as ls, lag(e) over w as le from g window w as (partition by contig order by s, e, gene_id))
select contig, lg as left_gene, gene_id as right_gene, le as left_end, s as right_start from x where ls = '-' and strand = '+' and s > le + 1""")
def divergent_pairs(spark, d):
    return genome.divergent_pairs(order_genes(spark, d))


_DOCS = "documents as c on c.doc_id = g.contig"


@query(f"""with {_GENES}, x as (select gene_id, strand, text, case when strand = '-' then greatest(e - 9, 1) else greatest(s - 20, 1) end as a, case when strand = '-' then least(e + 20, length(text)) else least(s + 9, length(text)) end as b from g join {_DOCS}),
  y as (select gene_id, strand, case when b >= a then substr(text, a, b - a + 1) else '' end as r from x)
select gene_id, case when strand = '-' then reverse(translate(r, 'ACGTRYSWKMBDHVNacgtryswkmbdhvnUu', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbnAa')) else r end as region from y""")
def gene_window_sequence(spark, d):
    contigs = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))
    return genome.start_windows(order_genes(spark, d), contigs, 20, 10).select("gene_id", "region")


@query(f"""with {_GENES}, n as (select contig, gene_id, row_number() over (partition by contig order by s, e, gene_id) as r from g)
select a.gene_id, a.contig, b.r - a.r as "offset", b.gene_id as neighbour from n a join n b on a.contig = b.contig and b.r >= a.r - 2 and b.r <= a.r + 1""")
def neighbourhood_k(spark, d):
    return _long(genome.neighbourhoods(order_genes(spark, d), 2))


@query(f"""with {_GENES}, t as (select contig, max(e) as top from g group by 1)
select gene_id, contig, top - e as start, top - s as "end", case when strand = '+' then '-' else '+' end as strand from g join t using (contig)""")
def flip_block(spark, d):
    return genome.flip_block(order_genes(spark, d), ["contig"]).select("gene_id", "contig", "start", "end", "strand")


@query(f"""with {_GENES}, c as (select event_id * 13 % 5200 as pos, user_id % 50 as contig, case when event_type in ('click', 'view') then '+' else '-' end as strand, value as n from events)
select gene_id, pos, round(n, 6) + 0e0 as n from g join c on g.contig = c.contig and g.strand = c.strand and pos between s - 100 and e + 100""")
def range_coverage(spark, d):
    c = table(spark, d, "events").select((F.col("event_id") * 13 % 5200).alias("pos"), (F.col("user_id") % 50).alias("contig"), F.when(F.col("event_type").isin("click", "view"), "+").otherwise("-").alias("strand"), rounded(F.col("value")).alias("n"))  # before counts meet genes
    return _long(genome.coverage_windows(order_genes(spark, d), c))


@query(f"""with {_GENES}, p as (select * from g where strand = '+'), m as (select * from g where strand = '-')
select p.contig, p.gene_id as a_id, m.gene_id as b_id from p join m on p.contig = m.contig and p.e >= m.s and m.e >= p.s""")
def interval_overlap(spark, d):
    g = order_genes(spark, d).withColumnRenamed("gene_id", "id")
    return genome.overlapping_intervals(g.filter("strand = '+'"), g.filter("strand = '-'"))


@query(f"""with {_GENES} select gene_id, case when e >= 2000 and 2100 >= s then 0 else least(abs(s - 2100), abs(2000 - e)) end as distance from g""")
def shortest_distance(spark, d):
    return order_genes(spark, d).select("gene_id", maths.shortest_distance("start", "end", F.lit(2000), F.lit(2100)).cast("long").alias("distance"))


@query(f"""with {_GENES} select gene_id, round(coalesce((s - min(s) over w) * 1e0 / nullif(max(s) over w - min(s) over w, 0), 0), 6) + 0e0 as scaled from g window w as (partition by contig)""")
def min_max_scaled(spark, d):
    return _six(order_genes(spark, d).select("gene_id", maths.min_max("start", ["contig"]).alias("scaled")), "scaled")


# ---- expression and information -------------------------------------------------------------------------------


def line_counts(spark, d):
    """Parts as genes, suppliers' buckets as samples."""
    x = table(spark, d, "lineitem")
    return x.groupBy(F.col("l_partkey").alias("gene"), (F.col("l_suppkey") % 6).cast("string").alias("sample")).agg(F.sum("l_quantity").alias("n"))


_COUNTS = "k as (select l_partkey as gene, cast(l_suppkey % 6 as varchar) as sample, sum(l_quantity) as n from lineitem group by 1, 2), rpm as (select *, n * 1e6 / sum(n) over (partition by sample) as rpm from k)"


@query(f"with {_COUNTS} select gene, sample, round(n, 6) + 0e0 as n, round(rpm, 4) + 0e0 as rpm from rpm")
def reads_per_million(spark, d):
    x = expression.reads_per_million(line_counts(spark, d))
    return x.select("gene", "sample", rounded(F.col("n")).alias("n"), rounded(F.col("rpm"), 4).alias("rpm"))


def line_contrasts(spark, d, with_p: bool):
    samples = spark.createDataFrame([(str(i), "bucket", "a" if i < 3 else "b") for i in range(6)], "sample string, variable string, value string")
    contrasts = spark.createDataFrame([("a_vs_b", "bucket", "a", "b"), ("b_vs_a", "bucket", "b", "a")], "id string, variable string, up string, reference string")
    return expression.contrast_stats(expression.contrast_values(line_counts(spark, d), samples, contrasts), with_p=with_p)


_STATS = f"""{_COUNTS}, v as (select 'a_vs_b' as contrast, gene, sample < '3' as up, rpm from rpm union all select 'b_vs_a', gene, sample >= '3', rpm from rpm),
  g as (select contrast, gene, avg(rpm) filter (up) as um, avg(rpm) filter (not up) as rm, var_samp(rpm) filter (up) as vu, var_samp(rpm) filter (not up) as vr,
    count(*) filter (up) as nu, count(*) filter (not up) as nr from v group by 1, 2),
  s as (select *, least(min(case when um > 0 then um end) over (partition by contrast), min(case when rm > 0 then rm end) over (partition by contrast)) * 1e-4 as pc,
    ((nu - 1) * vu + (nr - 1) * vr) / nullif(nu + nr - 2, 0) as pooled from g),
  z as (select contrast, gene, um as up_mean, rm as ref_mean, log2((um + pc) / (rm + pc)) as log2_fc, (um - rm) / nullif(sqrt(pooled * (1e0 / nullif(nu, 0) + 1e0 / nullif(nr, 0))), 0) as t, nu + nr - 2 as df from s)"""


@query(f"with {_STATS} select contrast, gene, round(up_mean, 4) + 0e0 as up_mean, round(ref_mean, 4) + 0e0 as ref_mean, round(log2_fc, 6) + 0e0 as log2_fc, round(t, 4) + 0e0 as t, df from z")
def contrast_statistics(spark, d):
    x = line_contrasts(spark, d, False)
    return _long(x.select("contrast", "gene", *[rounded(F.col(c), 4).alias(c) for c in ("up_mean", "ref_mean")], rounded(F.col("log2_fc")).alias("log2_fc"), rounded(F.col("t"), 4).alias("t"), "df"))


@query(f"with {_STATS} select contrast, gene, p_name, case when log2_fc > 1 then 'up' else 'down' end as regulation from z left join part on p_partkey = gene where abs(log2_fc) > 1")
def fold_change_genes(spark, d):
    x = line_contrasts(spark, d, False).withColumn("pval", F.lit(0.0))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("gene"), "p_name")
    return expression.significant_genes(x, 0.05, 2.0, names).select("contrast", "gene", "p_name", "regulation")


@query(f"""with {_STATS}, p as (select *, case df when 1 then 1 - 2 / pi() * atan(abs(t)) when 2 then 1 - abs(t) / sqrt(2 + t * t)
    when 3 then 1 - 2 / pi() * (atan(abs(t) / sqrt(3)) + abs(t) / sqrt(3) / (1 + t * t / 3)) when 4 then 1 - 3e0 / 4 * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (12 * (1 + t * t / 4))) end as p from z)
select contrast, gene, round(p, 6) + 0e0 as pval, case when log2_fc > 0 then 'up' else 'down' end as regulation from p where p < 0.05 and abs(log2_fc) > log2(1.2)""")
def contrast_p_values(spark, d):
    x = expression.significant_genes(line_contrasts(spark, d, True), 0.05, 1.2)
    return x.select("contrast", "gene", rounded(F.col("pval")).alias("pval"), "regulation")


@query("""with v as (select l_returnflag as x, l_linestatus as y, sum(l_quantity) as s from lineitem group by 1, 2), t as (select *, sum(s) over () as n, sum(s) over (partition by x) as px, sum(s) over (partition by y) as py from v)
select round(sum(s / n * log2(s * n / (px * py))), 6) + 0e0 as mi from t""")
def weighted_mi(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"), F.col("l_quantity").alias("w"))
    return _six(information.weighted_mi(x, valid=False), "mi")


def mi_inputs(spark, d):
    """Digits of suppliers' keys as bases, letters of their nations' names as residues."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    dna = alignment.cells(s.select(F.lit(0).alias("aln_id"), F.col("s_suppkey").alias("seq_id"), F.translate(F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0"), "0123456789", "ACGTACGTA-").alias("seq"))).drop("aln_id")
    prot = alignment.cells(s.select(F.lit(0).alias("aln_id"), F.col("s_suppkey").alias("seq_id"), F.rpad("n_name", 9, "-").alias("seq"))).drop("aln_id")
    return dna, prot, s.select(F.col("s_suppkey").alias("seq_id"), (F.col("s_acctbal") + 2000).alias("weight"), "n_regionkey")


_MI = """s as (select s_suppkey as seq_id, translate(lpad(cast(s_suppkey * 7919 % 1000000 as varchar), 6, '0'), '0123456789', 'ACGTACGTA-') as dna, rpad(n_name, 9, '-') as prot, s_acctbal + 2000 as w, n_regionkey as grp
    from supplier join nation on s_nationkey = n_nationkey),
  d as (select seq_id, i - 1 as dna_pos, substr(dna, i, 1) as x from s, generate_series(1, 6) t(i)), p as (select seq_id, i - 1 as prot_pos, upper(substr(prot, i, 1)) as y from s, generate_series(1, 9) t(i))"""
_VALID = "x in ('A', 'C', 'G', 'T') and y not in ('-', '.', 'X', '?') and w > 0"


@query(f"""with {_MI}, v as (select prot_pos, dna_pos, x, y, sum(w) as s from d join p using (seq_id) join s using (seq_id) where {_VALID} group by 1, 2, 3, 4),
  t as (select *, sum(s) over (partition by prot_pos, dna_pos) as n, sum(s) over (partition by prot_pos, dna_pos, x) as px, sum(s) over (partition by prot_pos, dna_pos, y) as py from v)
select prot_pos, dna_pos, round(greatest(sum(s / n * log2(s * n / (px * py))), 0), 6) + 0e0 as mi from t group by 1, 2""")
def weighted_mi_matrix(spark, d):
    dna, prot, w = mi_inputs(spark, d)
    return _six(information.mi_matrix(dna, prot, w), "mi")


@query(f"""with {_MI}, v as (select y, x, sum(w) as s from d join p using (seq_id) join s using (seq_id) where dna_pos = 5 and prot_pos = 0 and {_VALID} group by 1, 2),
  f as (select q.y, b as x, coalesce((select s from v where v.y = q.y and v.x = b), 0) as s from (select distinct y from v) q cross join (values ('A'), ('C'), ('G'), ('T')) t(b))
select y, x, round(s / sum(s) over (partition by y), 6) + 0e0 as p from f""")
def conditional_table(spark, d):
    dna, prot, w = mi_inputs(spark, d)
    x = dna.filter("pos = 5").select("seq_id", F.col("ch").alias("x")).join(prot.filter("pos = 0").select("seq_id", F.col("ch").alias("y")), "seq_id").join(w.select("seq_id", F.col("weight").alias("w")), "seq_id")
    return _six(information.conditional_table(x), "p")


@query("""with x as (select p_partkey as id, p_brand as g, (p_partkey * 7919 % 10007) / 10007e0 as p from part), r as (select *, row_number() over (partition by g order by p, id) as k, count(*) over (partition by g) as n from x)
select id, round(least(1, min(p * n / k) over (partition by g order by k desc rows unbounded preceding)), 9) + 0e0 as q from r""")
def benjamini_hochberg(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), ((F.col("p_partkey") * 7919 % 10007) / 10007.0).alias("p"))
    return information.benjamini_hochberg(x, "p", ["g"]).select("id", rounded(F.col("q"), 9).alias("q"))


@query(f"""with {_MI}, o as (select seq_id, grp, row_number() over (partition by grp order by seq_id) as k, count(*) over (partition by grp) as m from s),
  perm as (select 0 as perm_id, seq_id, seq_id as partner from s union all
    select q.i, a.seq_id, b.seq_id from o a join o b on a.grp = b.grp, generate_series(1, 3) q(i) where b.k = (a.k + q.i * 5) % a.m + 1),
  v as (select perm_id, prot_pos, dna_pos, x, y, sum(s.w) as s from perm join d on d.seq_id = perm.seq_id join p on p.seq_id = perm.partner join s on s.seq_id = perm.partner where x in ('A', 'C', 'G', 'T') and y not in ('-', '.', 'X', '?') and s.w > 0 group by 1, 2, 3, 4, 5),
  t as (select *, sum(s) over (partition by perm_id, prot_pos, dna_pos) as n, sum(s) over (partition by perm_id, prot_pos, dna_pos, x) as px, sum(s) over (partition by perm_id, prot_pos, dna_pos, y) as py from v),
  mi as (select perm_id, prot_pos, dna_pos, round(greatest(sum(s / n * log2(s * n / (px * py))), 0), 9) as mi from t group by 1, 2, 3)
select a.prot_pos, a.dna_pos, round(any_value(a.mi), 6) + 0e0 as mi, round((count(b.mi) filter (b.mi >= a.mi) + 1) / 4e0, 6) + 0e0 as p from mi a left join mi b on a.prot_pos = b.prot_pos and a.dna_pos = b.dna_pos and b.perm_id > 0
where a.perm_id = 0 group by 1, 2""")
def permutation_mi(spark, d):
    from pyspark.sql import Window

    dna, prot, w = mi_inputs(spark, d)
    o = w.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("seq_id"))).withColumn("m", F.count("*").over(Window.partitionBy("n_regionkey")))
    a = o.select("seq_id", "n_regionkey", "m", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("perm_id"), "k").withColumn("j", (F.col("k") + F.col("perm_id") * 5) % F.col("m") + 1)
    perm = a.join(o.select("n_regionkey", F.col("k").alias("j"), F.col("seq_id").alias("partner")), ["n_regionkey", "j"]).select("perm_id", "seq_id", "partner")
    return _six(information.permutation_test(dna, prot, w, perm).select("prot_pos", "dna_pos", "mi", "p"), "mi", "p")


@query("""with a as (select l_returnflag as x, count(*) * 1e0 / sum(count(*)) over () as f from lineitem group by 1), b as (select l_linestatus as y, count(*) * 1e0 / sum(count(*)) over () as f from lineitem group by 1)
select x, y, round(a.f * b.f, 6) + 0e0 as expected from a cross join b""")
def expected_frequency(spark, d):
    from pyspark.sql import Window

    x = table(spark, d, "lineitem")
    f = lambda c: x.groupBy(F.col(c).alias("ch")).agg(F.count("*").alias("n")).withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return _six(information.expected_frequencies(f("l_returnflag"), f("l_linestatus")), "expected")


@query("""with e as (select x, y from (values ('A'), ('N'), ('R')) a(x), (values ('F'), ('O')) b(y)), n as (select l_returnflag as x, l_linestatus as y, count(*) as n from lineitem group by 1, 2)
select x, y, coalesce(n, 0) as n, round(coalesce(n, 0) * 1e0 / sum(coalesce(n, 0)) over (), 6) + 0e0 as p from e left join n using (x, y)""")
def joint_counts(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"))
    return _six(information.joint_counts(x, ["A", "N", "R"], ["F", "O"]), "p")


# ---- trees: customer, nation, region as one hierarchy -----------------------------------------------------------


def place_tree(spark, d):
    none = F.lit(None)
    node = lambda x, i, p, name, leaf, length: x.select(F.lit("t").alias("tree_id"), i.cast("int").alias("node_id"), p.cast("int").alias("parent_id"), i.cast("int").alias("child_ord"), (name if leaf else none).cast("string").alias("name"), (none if leaf else name).cast("string").alias("label"), length.cast("double").alias("branch_length"), F.lit(leaf).alias("is_leaf"))
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    x = node(c, F.col("c_custkey") + 100, F.col("c_nationkey") + 10, F.col("c_name"), True, F.col("c_custkey") % 9)
    x = x.unionByName(node(n, F.col("n_nationkey") + 10, F.col("n_regionkey") + 1, F.col("n_name"), False, F.col("n_nationkey") % 4 + 0.5))
    x = x.unionByName(node(r, F.col("r_regionkey") + 1, F.lit(0), F.col("r_name"), False, F.lit(1.0)))
    return x.unionByName(spark.createDataFrame([("t", 0, None, 0, None, "world", None, False)], x.schema))


@query("""with n as (select c_custkey + 100 as id, c_nationkey + 10 as p, c_custkey % 9 * 1e0 as l from customer union all select n_nationkey + 10, n_regionkey + 1, n_nationkey % 4 + 5e-1 from nation union all select r_regionkey + 1, 0, 1e0 from region),
  a as (select id as node_id, id as anc_id, 0 as hops, 0e0 as path_len from n union all select 0, 0, 0, 0e0 union all select id, p, 1, l from n
    union all select x.id, y.p, 2, x.l + y.l from n x join n y on x.p = y.id union all select x.id, z.p, 3, x.l + y.l + z.l from n x join n y on x.p = y.id join n z on y.p = z.id)
select node_id, anc_id, hops, round(path_len, 6) + 0e0 as path_len from a""")
def tree_closure(spark, d):
    return _six(tree.ancestors(place_tree(spark, d)).drop("tree_id"), "path_len")


@query("select c_name as name, round(c_custkey % 9 + n_nationkey % 4 + 5e-1 + 1, 6) + 0e0 as distance from customer join nation on c_nationkey = n_nationkey")
def root_to_tip(spark, d):
    return _six(tree.root_to_tip(place_tree(spark, d)).select("name", "distance"), "distance")


@query("""with c as (select c_nationkey as n, n_regionkey as r, bool_and(c_custkey % 9 < 9 and c_nationkey % 3 <> 1) as pure from customer join nation on c_nationkey = n_nationkey group by 1, 2),
  rr as (select r, bool_and(pure) as pure from c group by 1)
select n + 10 as node_id from c join rr using (r) where c.pure and not rr.pure union all select r + 1 from rr where pure and not (select bool_and(pure) from rr) union all select 0 from rr having bool_and(pure)""")
def monophyletic_lcas(spark, d):
    t = place_tree(spark, d)
    targets = table(spark, d, "customer").filter("c_nationkey % 3 <> 1").select(F.col("c_name").alias("name"))
    return _long(tree.monophyletic_ancestors(t, tree.ancestors(t), targets).select("node_id"))


def segment_trees(spark, d):
    """A tree per market segment: regions over the nations that its richer customers live in, as Newick text."""
    x = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    inner = x.groupBy("c_mktsegment", "n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("t"), F.countDistinct("n_name").alias("k"))
    side = F.when(F.col("k") > 1, F.concat(F.lit("("), "t", F.lit(")"))).otherwise(F.col("t"))
    g = inner.groupBy(F.col("c_mktsegment").alias("tree_id")).agg(F.array_join(F.array_sort(F.collect_list(side)), ",").alias("t"))
    return g.select("tree_id", F.concat(F.lit("("), F.regexp_replace("t", "[ ']", "_"), F.lit(");")).alias("newick"))


_SEGMENTS = "x as (select distinct c_mktsegment as t, n_regionkey as r, replace(n_name, ' ', '_') as n from customer join nation on c_nationkey = n_nationkey)"
_NEWICK = """i as (select t, r, string_agg(n, ',' order by n) as s, count(*) as k from y group by 1, 2), o as (select t, string_agg(case when k > 1 then '(' || s || ')' else s end, ',' order by case when k > 1 then '(' || s || ')' else s end) as s, count(*) as k from i group by 1)
select t as tree_id, case when k > 1 then '(' || s || ');' else s || ';' end as newick from o"""


@query(f"with {_SEGMENTS}, y as (select * from x), {_NEWICK}")
def newick_round_trip(spark, d):
    return tree.to_newick(tree.parse_newick(segment_trees(spark, d)))


@query("""with x as (select c_mktsegment as t, string_agg(distinct n_name, ',' order by n_name) as leaves, count(distinct n_name) as n from customer join nation on c_nationkey = n_nationkey group by 1)
select a.t as a, b.t as b, case when a.leaves = b.leaves and a.n >= 4 then 0e0 end as rf from x a join x b on a.t < b.t""")
def rf_distance(spark, d):
    return tree.rf_distances(tree.parse_newick(segment_trees(spark, d)))


@query("""select count(distinct c_name) as tips, (select count(distinct o_custkey) from orders) as ids, (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as only_tips,
  (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer)) as only_ids from customer""")
def tree_alignment_match(spark, d):
    t = table(spark, d, "customer").select(F.lit(True).alias("is_leaf"), F.col("c_custkey").cast("string").alias("name"))
    s = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("seq_id"))
    x = tree.id_agreement(t, s)
    return x.select("tips", "ids", F.size("only_tips").cast("long").alias("only_tips"), F.size("only_ids").cast("long").alias("only_ids"))


@query(f"with {_SEGMENTS}, y as (select * from x where r < 3), {_NEWICK}")
def pruned_trees(spark, d):
    names = table(spark, d, "nation").filter("n_regionkey < 3").select(F.regexp_replace("n_name", "[ ']", "_").alias("seq_id"))
    return tree.to_newick(tree.prune_to_sequences(tree.parse_newick(segment_trees(spark, d)), names))


@query()
def consensus_tree(spark, d):
    return tree.to_newick(tree.consensus(tree.parse_newick(segment_trees(spark, d))))


@query()
def tree_layout(spark, d):
    return tree.layout(tree.parse_newick(segment_trees(spark, d)))


@query("""with e as (select event_id as "Site", event_type as "Node", value, user_id % 7 as u from events)
select "Node", string_agg(case when value / (abs(value) + 10) > 0.5 then substr('ACDEFGH', (u + 1)::int, 1) else 'X' end, '' order by "Site") as seq from e group by 1""")
def masked_ancestral_sequences(spark, d):
    x = table(spark, d, "events").select(F.col("event_id").alias("Site"), F.col("event_type").alias("Node"), F.expr("substring('ACDEFGH', cast(user_id % 7 + 1 as int), 1)").alias("State"), (F.col("value") / (F.abs("value") + 10)).alias("p_A"), F.lit(-1e9).alias("p_C"))
    return ancestral.node_sequences(x, threshold=0.5)


# ---- plot data and streams -------------------------------------------------------------------------------------


@query("select case when l_quantity > 40 then '>40' else cast(floor(l_quantity)::bigint as varchar) end as bin, count(*) as n from lineitem group by 1")
def overflow_histogram(spark, d):
    return plotdata.overflow_histogram(table(spark, d, "lineitem"), "l_quantity", 40)


@query("""with w as (select event_type, value, min(value) over e as low, (max(value) over e - min(value) over e) / 512 as step, stddev_samp(value) over e * pow(count(*) over e, -0.2) as h from events window e as (partition by event_type)),
  b as (select *, floor((value - low) / step) as bin from w), c as (select event_type, bin, count(*) as n, avg(value) as at from b group by 1, 2), v as (select event_type, value, any_value(h) as h from b group by 1, 2),
  k as (select v.event_type, v.value, any_value(v.h) as h, sum(c.n * exp(-0.5 * pow((v.value - c.at) / v.h, 2))) as s, sum(c.n) as total from v join c on v.event_type = c.event_type group by 1, 2)
select event_type, value, round(s / (total * h * 2.5066282746310002), 8) + 0e0 as density from k""")
def density(spark, d):
    x = plotdata.kernel_density(table(spark, d, "events").select("event_type", "value"), "value", "event_type")
    return x.groupBy("event_type", "value").agg(F.max(rounded(F.col("density"), 8)).alias("density"))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) + 0e0 as total from events group by 1, 2")
def tumbling_windows(spark, d):
    x = streams.tumbling(table(spark, d, "events"), "1 day")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"))


@query("""with x as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
  y as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from y group by user_id, s""")
def user_sessions(spark, d):
    x = streams.sessions(table(spark, d, "events"), "30 minutes")
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


from . import file_queries, table_queries  # noqa: E402, F401  they register theirs
