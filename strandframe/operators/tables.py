"""Grouped tables: best hits, representatives, architectures, isoforms, status matrices, taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.session import require_columns, require_matches, require_unique


def first_per_group(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group in a total order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_nth = 1").drop("_nth")


def last_wins(df: DataFrame, key: list[str], ord: str = "ord") -> DataFrame:
    return first_per_group(df, key, [F.col(ord).desc()])


def first_wins(df: DataFrame, key: list[str], ord: str = "ord") -> DataFrame:
    return first_per_group(df, key, [F.col(ord)])


def distinct_in_order(df: DataFrame, key: list[str], ord: str = "ord") -> DataFrame:
    return df.groupBy(*key).agg(F.min(ord).alias(ord))


def best_hits(hits: DataFrame, by: list[str], score: Column, ties: list) -> DataFrame:
    """The best hit per group by a score column in its order, then ties."""
    return first_per_group(hits, by, [score, *ties])


def filtered_hits(hits: DataFrame, sequences: DataFrame, genome: str | None = None, most_evalue: float = 1e-6) -> DataFrame:
    """Hits below an E-value with their sequences, tagged with the genome."""
    x = hits.filter(F.col("full_evalue") < most_evalue).join(sequences.select(F.col("seq_id").alias("target_name"), "seq"), "target_name")
    return x.withColumn("genome", F.lit(genome)) if genome else x


def above_gathering_cutoff(hits: DataFrame, cutoff: float) -> DataFrame:
    return hits.filter(F.col("full_score") >= cutoff)


def reciprocal_best_hits(forward: DataFrame, reverse: DataFrame, query: str) -> DataFrame:
    """(accession, forward_hit, reverse_hit, recip_best_hit) of accessions in both."""
    x = reverse.select("accession", F.col("hit").alias("reverse_hit")).join(forward.select("accession", F.col("hit").alias("forward_hit")), "accession")
    return x.select("accession", "forward_hit", "reverse_hit", (F.col("reverse_hit") == query).alias("recip_best_hit"))


def presence_matrix(hits: DataFrame, rows: str, columns: str, values: list[str] | None = None) -> DataFrame:
    """One row per genome, one 0/1 column per profile."""
    p = hits.groupBy(rows).pivot(columns, values) if values else hits.groupBy(rows).pivot(columns)
    wide = p.agg(F.lit(1))
    return wide.na.fill(0)


def unversioned(accession) -> Column:
    return F.split_part(F.col(accession) if isinstance(accession, str) else accession, F.lit("."), F.lit(1))


def domain_architectures(hits: DataFrame, ids: DataFrame | None = None, separator: str = "  |  ") -> DataFrame:
    """(query_name, domain_count, domains, accessions) in the order of position; ids without a hit have 0 and ''."""
    key = F.struct("ali_from", "ali_to", "i_evalue", F.col("target_name").alias("name"), unversioned("target_accession").alias("acc"))
    rows = F.array_sort(F.collect_list(key))
    g = hits.groupBy("query_name").agg(F.count("*").alias("domain_count"), rows.alias("rows"))
    g = g.select("query_name", "domain_count", F.array_join(F.transform("rows", lambda r: r["name"]), separator).alias("domains"), F.array_join(F.transform("rows", lambda r: r["acc"]), separator).alias("accessions"))
    if ids is None:
        return g
    x = ids.select("query_name").distinct().join(g, "query_name", "left")
    return x.select("query_name", F.coalesce("domain_count", F.lit(0)).alias("domain_count"), F.coalesce("domains", F.lit("")).alias("domains"), F.coalesce("accessions", F.lit("")).alias("accessions"))


def classify_architectures(hits: DataFrame, kinds: dict[str, Column], ladder, ids: DataFrame | None = None) -> DataFrame:
    """(query_name, <kind>_from..., class): the first position of each kind of domain, and a label from them.

    kinds: a condition on hits per kind; ladder: a function of {kind: column of its first position} to a label."""
    g = hits.groupBy("query_name").agg(*[F.min(F.when(c, F.col("ali_from"))).alias(f"{k}_from") for k, c in kinds.items()])
    x = ids.select("query_name").distinct().join(g, "query_name", "left") if ids is not None else g
    return x.withColumn("class", ladder({k: F.col(f"{k}_from") for k in kinds}))


def hint_kinds() -> dict[str, Column]:
    """Domain kinds of hedgehog-like proteins: the signal, VWA (anywhere in the name, any case) and Hint."""
    acc = unversioned("target_accession")
    return {"signal": acc == "PF01085", "vwa": F.col("target_name").rlike("(?i)vwa"), "hint": acc == "PF01079"}


def hint_ladder(first: dict[str, Column]) -> Column:
    hint, signal, vwa = first["hint"], first["signal"], first["vwa"]
    return (
        F.when(hint.isNull(), "no_hint").when(signal.isNotNull() & (signal < hint), "signal_then_hint")
        .when(vwa.isNotNull() & (vwa < hint), "vwa_then_hint").when(signal.isNull() & vwa.isNull(), "hint_only").otherwise("other")
    )


def locus_representatives(hits: DataFrame, metadata: DataFrame, accession: str = "PF01079") -> DataFrame:
    """The best domain per gene locus: score, then covered length, then protein length, then names."""
    require_columns(hits, ["query_name", "target_accession", "domain_score", "env_from", "env_to"], "domain hits")
    require_columns(metadata, ["sequence_id", "gene_locus_id", "protein_length"], "protein metadata")
    require_unique(metadata, ["sequence_id"], "protein metadata")
    own = hits.filter(unversioned("target_accession") == accession)
    require_matches(own.select(F.col("query_name").alias("sequence_id")), metadata, ["sequence_id"], "domain hits")
    x = own.join(metadata, own["query_name"] == metadata["sequence_id"])
    order = [F.col("domain_score").desc(), (F.col("env_to") - F.col("env_from")).desc(), F.col("protein_length").desc(), F.col("sequence_id"), F.col("env_from")]
    return first_per_group(x, ["gene_locus_id"], order)


def domain_sequences(representatives: DataFrame, sequences: DataFrame, start: str = "env_from", end: str = "env_to") -> DataFrame:
    """Sequences cut to 1-based inclusive coordinates; coordinates outside the sequence are an error."""
    x = representatives.join(sequences.select(F.col("seq_id").alias("sequence_id"), "seq"), "sequence_id")
    ok = (F.col(start) >= 1) & (F.col(end) >= F.col(start)) & (F.col(end) <= F.length("seq"))
    cut = F.when(ok, F.expr(f"substring(seq, {start}, {end} - {start} + 1)")).otherwise(F.raise_error(F.lit("domain coordinates outside the sequence")))
    return x.withColumn("domain_seq", cut)


def resolve_genes(features: DataFrame) -> DataFrame:
    """(protein_id, gene_id) of features(type, id, parent, protein_id): CDS to transcript to gene; a CDS whose
    parent is no transcript has that parent as gene; proteins with two genes are dropped."""
    cds = features.filter("type = 'CDS' and protein_id is not null").select("protein_id", "parent")
    up = features.filter("type <> 'CDS' and type <> 'gene'").select(F.col("id").alias("parent"), F.col("parent").alias("gene")).distinct()
    x = cds.join(up, "parent", "left").select("protein_id", F.coalesce("gene", "parent").alias("gene_id")).filter("gene_id is not null")
    return x.groupBy("protein_id").agg(F.min("gene_id").alias("gene_id"), F.max("gene_id").alias("_high")).filter("gene_id = _high").drop("_high")


def longest_isoforms(proteins: DataFrame, genes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """proteins(protein_id, length) with gene_id, selected and reason: the longest per gene, ties by id;
    proteins without a gene are kept on their own."""
    by = by or []
    x = proteins.join(genes, [*by, "protein_id"], "left")
    group = F.coalesce(F.concat(F.lit("gene:"), "gene_id"), F.concat(F.lit("protein:"), "protein_id"))
    w = Window.partitionBy(*by, group)
    x = x.withColumn("_nth", F.row_number().over(w.orderBy(F.col("length").desc(), "protein_id"))).withColumn("isoforms", F.count("*").over(w))
    reason = F.when(F.col("gene_id").isNull(), "unmapped").when(F.col("isoforms") == 1, "only_isoform").when(F.col("_nth") == 1, "longest").otherwise("shorter")
    return x.withColumn("selected", F.col("_nth") == 1).withColumn("reason", reason).drop("_nth")


# ---- status matrices -----------------------------------------------------------------------------------

# Statuses in the order in which duplicated records collapse.
STATUSES = ["Duplicated", "Complete", "Fragmented", "Missing"]


def collapse_statuses(table: DataFrame) -> DataFrame:
    """One row per (assembly, busco_id): the highest status, then the highest score, then the sequence."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("status")), F.lit(99))
    return first_per_group(table, ["assembly", "busco_id"], [rank, F.col("score").desc_nulls_last(), F.col("sequence").asc_nulls_last()])


def status_long(collapsed: DataFrame) -> DataFrame:
    """(busco_id, assembly, status, sequence) for every marker and assembly; absent ones are Missing and ''."""
    every = collapsed.select("busco_id").distinct().crossJoin(collapsed.select("assembly").distinct())
    x = every.join(collapsed, ["busco_id", "assembly"], "left")
    return x.select("busco_id", "assembly", F.coalesce("status", F.lit("Missing")).alias("status"), F.coalesce("sequence", F.lit("")).alias("sequence"))


def status_wide(long: DataFrame, assemblies: list[str], value: str = "status") -> DataFrame:
    return long.groupBy("busco_id").pivot("assembly", assemblies).agg(F.first(value))


def summarise_markers(long: DataFrame) -> DataFrame:
    return long.groupBy("busco_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])


def summarise_assemblies(long: DataFrame) -> DataFrame:
    """Counts and percents per assembly; complete_percent counts single-copy and duplicated markers."""
    g = long.groupBy("assembly").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    pct = lambda c: (100.0 * c / F.col("total"))
    g = g.withColumn("complete_percent", pct(F.col("complete") + F.col("duplicated")))
    for s in STATUSES:
        g = g.withColumn("single_copy_percent" if s == "Complete" else f"{s.lower()}_percent", pct(F.col(s.lower())))
    return g


def classify_completeness(assemblies: DataFrame, minimum: float = 80.0, preferred: float = 90.0) -> DataFrame:
    c = F.col("complete_percent")
    return assemblies.withColumn("category", F.when(c < minimum, "exclude").when(c < preferred, "marginal").otherwise("preferred")).withColumn("retained", c >= minimum)


def select_markers(long: DataFrame, least: int, outgroups: list[str] = [], reject_duplicated: bool = True) -> DataFrame:  # noqa: B006
    """Marker summary with selected: single-copy in enough assemblies, none duplicated, and in an outgroup."""
    n = long.select("assembly").distinct().count()
    if not 1 <= least <= n:
        raise ValueError(f"occupancy must be between 1 and {n}")
    lost = set(outgroups) - {r[0] for r in long.select("assembly").distinct().filter(F.col("assembly").isin(outgroups)).collect()} if outgroups else set()
    if lost:
        raise ValueError(f"outgroups not in the matrix: {sorted(lost)}")
    g = long.groupBy("busco_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
        (F.bool_or((F.col("status") == "Complete") & F.col("assembly").isin(outgroups)) if outgroups else F.lit(True)).alias("in_outgroup"),
    )
    ok = (F.col("complete") >= least) & F.col("in_outgroup")
    return g.withColumn("selected", ok & (F.col("duplicated") == 0) if reject_duplicated else ok)


def marker_sequences(markers: DataFrame, long: DataFrame, sequences: DataFrame) -> DataFrame:
    """(busco_id, assembly, seq_id, seq): one protein per assembly of the selected markers."""
    x = long.join(markers.filter("selected").select("busco_id"), "busco_id", "left_semi").filter("status = 'Complete'")
    return x.join(sequences.select(F.col("source").alias("assembly"), F.col("seq_id").alias("sequence"), "seq"), ["assembly", "sequence"]).select("busco_id", "assembly", F.col("sequence").alias("seq_id"), "seq")


# ---- taxonomy and names --------------------------------------------------------------------------------

# Ranks and their prefixes.
RANKS = {"domain": "d", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}


def taxonomy_lineage(assemblies: DataFrame, taxonomy: DataFrame, key: str = "taxid") -> DataFrame:
    """Assemblies with a 'd__...;p__...' lineage; taxids must be unique in taxonomy and all matched."""
    require_columns(taxonomy, [key, *RANKS], "taxonomy")
    require_unique(taxonomy, [key], "taxonomy")
    require_matches(assemblies, taxonomy, [key], "assemblies")
    parts = [F.concat(F.lit(f"{p}__"), F.coalesce(F.col(r), F.lit(""))) for r, p in RANKS.items()]
    return assemblies.join(taxonomy.select(key, *RANKS), key).withColumn("lineage", F.concat_ws(";", *parts))


def flatten_assembly_reports(raw: DataFrame) -> DataFrame:
    """One row per accession of a report file with a reports array; absent branches are null, the last wins."""
    r = raw.select(F.posexplode("reports").alias("ord", "r"))
    kinds = dict(r.select("r.*").dtypes)

    def at(path: str):
        head, *rest = path.split(".")
        if head not in kinds:
            return F.lit(None).cast("string")
        kind = kinds[head]
        for name in rest:
            if f"{name}:" not in kind:
                return F.lit(None).cast("string")
        return F.col(f"r.{path}")

    strain = at("organism.infraspecific_names.strain")
    name = at("organism.organism_name")
    cols = {
        "accession": at("accession"), "organism_name": name, "tax_id": at("organism.tax_id"), "strain": strain,
        "completeness": at("checkm_info.completeness"), "contamination": at("checkm_info.contamination"),
        "genome_size": at("assembly_stats.total_sequence_length"), "gc_percent": at("assembly_stats.gc_percent"),
        "assembly_level": at("assembly_info.assembly_level"), "full_name": F.when(strain.isNotNull(), F.concat(name, F.lit("__"), strain)).otherwise(name),
    }
    return last_wins(r.select("ord", *[c.alias(k) for k, c in cols.items()]), ["accession"]).drop("ord")


def scientific_strain_name(name, strain) -> Column:
    """The first two words with the strain, or the whole name where there is none."""
    n, s = F.col(name), F.col(strain)
    return F.when(s.isNotNull(), F.concat_ws(" ", F.array_join(F.slice(F.split(n, " "), 1, 2), " "), s)).otherwise(n)


def rank_representatives(taxa: DataFrame, rank: str = "phylum", leaves: DataFrame | None = None) -> DataFrame:
    """One genome per value of a rank, the first accession; with leaves only those whose last 15 characters are one."""
    x = taxa.filter(F.col(rank).isNotNull())
    if leaves is not None:
        x = x.withColumn("leaf", F.right("accession", F.lit(15))).join(leaves.select(F.col("name").alias("leaf")).distinct(), "leaf", "left_semi")
    return first_per_group(x, [rank], [F.col("accession")])


def lineage_ranks(parents: DataFrame, taxid: int) -> DataFrame:
    """(rank, taxid) from a node up to the root of parents(taxid, parent, rank); of a repeated rank the one nearer the node."""
    parents.createOrReplaceTempView("_parents")
    up = parents.sparkSession.sql(f"""
        with recursive walk(taxid, parent, rank, hops) as (
          select taxid, parent, rank, 0 from _parents where taxid = {int(taxid)}
          union all
          select p.taxid, p.parent, p.rank, w.hops + 1 from walk w join _parents p on p.taxid = w.parent where w.parent <> w.taxid)
        select * from walk""")
    return first_per_group(up, ["rank"], [F.col("hops")]).select("rank", "taxid")


def mate_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The first pattern of a priority list that a sample's files match: files(base, name)."""
    rank = F.coalesce(*[F.when(F.col("name").like(F.concat("base", F.lit(p))) if isinstance(p, str) else p, F.lit(i)) for i, p in enumerate(patterns)])
    return first_per_group(files.withColumn("_rank", rank).filter("_rank is not null"), ["base"], [F.col("_rank"), F.col("name")]).drop("_rank")


def fixed_chunks(df: DataFrame, size: int, order: list) -> DataFrame:
    """chunk from 0 in groups of `size` rows of one total order."""
    return numbered(df, order, "_nth").withColumn("chunk", F.floor((F.col("_nth") - 1) / size).cast("int")).drop("_nth")


def cluster_table(members: DataFrame) -> DataFrame:
    """(cluster_id, rep, member_count, members) of members(cluster_id, ord, name, is_rep)."""
    m = F.array_sort(F.collect_list(F.struct("ord", "name")))
    return members.groupBy("cluster_id").agg(F.max(F.when(F.col("is_rep"), F.col("name"))).alias("rep"), F.count("*").alias("member_count"), F.array_join(F.transform(m, lambda x: x["name"]), ";").alias("members"))


def requested_records(sequences: DataFrame, ids: DataFrame, strict: bool = True) -> DataFrame:
    """The records of ids(seq_id, ord), each once, in the order of their first request; strict raises on a missing one."""
    want = ids.groupBy("seq_id").agg(F.min("ord").alias("ord"))
    if strict:
        require_matches(want, sequences, ["seq_id"], "requested ids")
    return want.join(sequences.select("seq_id", "seq"), "seq_id").orderBy("ord")


def union_unique(parts: list[DataFrame]) -> DataFrame:
    """Union of sequence tables whose ids may not repeat."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    require_unique(out, ["seq_id"], "sequences")
    return out
