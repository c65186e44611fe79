"""Readers of sequence, annotation, hit-table, tree and report formats.  All return lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import last_wins
from ..plans import schemas as S


def _file() -> Column:
    return F.col("_metadata.file_name")


def _lines(spark: SparkSession, path, numbered: bool = False, separator: str | None = None) -> DataFrame:
    """(path, file, line[, ord]); ord numbers a file's lines from 0, exactly, however the file is split.

    A split's rows come in order, so a line's number is its place in the split plus the rows of the splits
    before it.  One pass counts those, so nothing but a row per split is gathered, and no file is read whole."""
    x = spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)
    x = x.select(F.col("_metadata.file_path").alias("path"), _file().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    if not numbered:
        return x.select("path", "file", "line")
    splits = x.groupBy("path", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = splits.select("path", "_block", (before - F.col("_first")).alias("_shift"))
    return x.join(F.broadcast(shift), ["path", "_block"]).select("path", "file", "line", (F.col("_row") + F.col("_shift")).alias("ord"))  # a row per split


def _running(lines: DataFrame, flag: Column, name: str, chunk: int = 1 << 16) -> DataFrame:
    """lines with how many of a file's lines up to each have the flag; by chunks of lines, so that no file is one task."""
    x = lines.withColumn("_flag", flag.cast("long")).withColumn("_chunk", F.floor(F.col("ord") / chunk))
    sums = x.groupBy("path", "_chunk").agg(F.sum("_flag").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_flag").over(Window.partitionBy("path", "_chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_own", own).join(sums.select("path", "_chunk", before.alias("_before")), ["path", "_chunk"])
    return x.withColumn(name, F.col("_own") + F.col("_before")).drop("_flag", "_chunk", "_own", "_before")


# ---- sequences ------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path, full_header: bool = False, key=None, upper: bool = True, keep: str = "last") -> DataFrame:
    """(seq_id, seq, ord, source) of FASTA files, compressed or not.

    Records are split at '\\n>', so a '>' inside a header is safe and files split among tasks.  The id is
    the header's first word, the whole header, or key(header column).  White space leaves the sequence.
    Of a repeated id the last record stays unless keep='all'; a file without any header is an error."""
    raw = _lines(spark, path, numbered=True, separator="\n>").select("path", F.col("file").alias("source"), "ord", F.regexp_replace("line", r"^\s*>?", "").alias("r"), F.col("line").alias("v"))
    first = F.trim(F.regexp_extract("r", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("r", r"^[^\r\n]*", ""), r"\s+", "")
    head = first if full_header else F.regexp_extract(first, r"^(\S*)", 1)
    head = key(first) if key is not None else head
    bad = (F.col("ord") == 0) & ~F.ltrim("v").startswith(">")
    x = raw.filter(F.trim("r") != "").select("path", "source", "ord", F.when(bad, F.raise_error(F.lit("no FASTA header before the first sequence"))).otherwise(head).alias("seq_id"), (F.upper(body) if upper else body).alias("seq"))
    x = last_wins(x, ["path", "seq_id"]) if keep == "last" else x
    return x.select("seq_id", "seq", "ord", "source")


def two_word_key(header: Column) -> Column:
    """The first two words of a header joined by '_'; fewer are an error."""
    w = F.split(F.trim(header), r"\s+")
    return F.when(F.size(w) >= 2, F.concat_ws("_", F.get(w, 0), F.get(w, 1))).otherwise(F.raise_error(F.lit("a FASTA header needs two words")))


def read_fasta_two_words(spark: SparkSession, path) -> DataFrame:
    return read_fasta(spark, path, key=two_word_key, upper=False)


def prefix_ids(sequences: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Ids as <prefix>_<id> by prefixes(source, prefix)."""
    return sequences.join(F.broadcast(prefixes), "source").withColumn("seq_id", F.concat_ws("_", "prefix", "seq_id")).drop("prefix")  # a row per file


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """(ord, read_id, length, seq, quality) of four-line records up to the first blank header; ids keep '@'."""
    x = _lines(spark, path, numbered=True).withColumn("rec", F.floor(F.col("ord") / 4)).withColumn("k", F.col("ord") % 4)
    pick = lambda i: F.max(F.when(F.col("k") == i, F.trim("line")))
    r = x.groupBy("path", "file", "rec").agg(pick(0).alias("h"), pick(1).alias("seq"), pick(3).alias("quality"))
    stop = x.filter((F.col("k") == 0) & (F.trim("line") == "")).groupBy("path").agg(F.min("rec").alias("_stop"))
    r = r.join(F.broadcast(stop), "path", "left").filter("_stop is null or rec < _stop")  # a row per file
    return r.select("file", F.col("rec").alias("ord"), F.split_part("h", F.lit(" "), F.lit(1)).alias("read_id"), F.length("seq").alias("length"), "seq", "quality")


def sample_reads(reads: DataFrame, k: int = 10_000, seed: int = 1) -> DataFrame:
    """k reads without replacement, in their order; all where there are not more."""
    return reads.orderBy(F.xxhash64("ord", F.lit(seed)), "ord").limit(k).orderBy("ord")


def sample_mates(first: DataFrame, second: DataFrame, k: int = 10_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Samples of both mates by the same record numbers."""
    a = sample_reads(first, k, seed)
    return a, second.join(a.select("ord"), "ord", "left_semi").orderBy("ord")


def record_starts(n_lines: int) -> list[int]:
    """Line numbers of the record headers of a FASTQ file."""
    return list(range(0, n_lines, 4))


def count_lines(spark: SparkSession, path) -> int:
    return spark.read.text(path).count()


# ---- annotation -----------------------------------------------------------------------------------------


def attribute_map(text, decode: bool = False) -> Column:
    """map of 'k=v;k=v': a value keeps further '=', items without one are skipped, the last of a key wins."""
    c = F.col(text) if isinstance(text, str) else text
    items = F.filter(F.transform(F.split(c, ";"), lambda i: F.trim(i)), lambda i: i.contains("="))
    un = (lambda s: F.url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))) if decode else (lambda s: s)
    key = lambda i: F.substring_index(i, "=", 1)
    value = lambda i: F.regexp_replace(i, "^[^=]*=", "")
    keys = F.array_distinct(F.transform(items, lambda i: un(key(i))))
    last = lambda k: un(value(F.element_at(F.filter(items, lambda i: un(key(i)) == k), -1)))
    return F.map_from_arrays(keys, F.transform(keys, last))


def gtf_attribute_map(text) -> Column:
    """map of 'k "v"; k "v"', values whole, the last of a key wins."""
    c = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(r'([A-Za-z0-9_.-]+)\s+(?:"([^"]*)"|([^;"\s]+))')
    k, q, b = (F.regexp_extract_all(c, pattern, F.lit(i)) for i in (1, 2, 3))
    v = F.zip_with(q, b, lambda x, y: F.when(x != "", x).otherwise(y))
    pairs = F.arrays_zip(k.alias("k"), v.alias("v"))
    keys = F.array_distinct(k)
    return F.map_from_arrays(keys, F.transform(keys, lambda key: F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]))


def _features(spark: SparkSession, path, attributes, least: int, strict: bool) -> DataFrame:
    skipped = F.col("line").startswith("#") | (F.trim("line") == "") | F.col("line").startswith(" ")
    x = _lines(spark, path, numbered=True).filter(~skipped)
    f = F.split("line", "\t")
    x = x.withColumn("f", F.when(skipped | (F.size(f) >= least), f).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.col("line")))) if strict else f)
    x = x if strict else x.filter(F.size("f") >= least)
    part = lambda i: F.get("f", i)
    return x.select(
        "path", "file", part(0).alias("seqid"), part(1).alias("source"), part(2).alias("type"), part(3).try_cast("int").alias("start"), part(4).try_cast("int").alias("end"),
        part(5).alias("score"), part(6).alias("strand"), part(7).alias("phase"), attributes(F.coalesce(part(8), F.lit(""))).alias("attributes"), "ord",
    )


def read_gff(spark: SparkSession, path, feature_type: str | None = "gene", strict: bool = True, decode: bool = False, keep: str = "last") -> DataFrame:
    """GFF3 features with an ID.  strict: lines with fewer than six fields raise; else fewer than nine are skipped.

    Of rows with one ID the last stays unless keep='all'."""
    x = _features(spark, path, lambda t: attribute_map(t, decode), 6 if strict else 9, strict).withColumn("id", F.try_element_at("attributes", F.lit("ID"))).filter("id is not null")
    x = x.filter(F.col("type") == feature_type) if feature_type else x
    return (last_wins(x, ["path", "id"]) if keep == "last" else x).drop("path")


def read_gtf(spark: SparkSession, path, feature_type: str | None = "gene", keep: str = "last") -> DataFrame:
    x = _features(spark, path, gtf_attribute_map, 6, True).withColumn("id", F.try_element_at("attributes", F.lit("gene_id"))).filter("id is not null")
    x = x.filter(F.col("type") == feature_type) if feature_type else x
    return (last_wins(x, ["path", "id"]) if keep == "last" else x).drop("path")


def gff_summary(spark: SparkSession, path) -> DataFrame:
    """(file, build, build_accession, species, processor, regions): pragmas' last words, and all region rows' attributes."""
    x = _lines(spark, path)
    last = lambda p: F.max(F.when(F.col("line").startswith(p), F.regexp_extract("line", r"(\S+)\s*$", 1)))
    p = x.groupBy("file").agg(last("#!genome-build ").alias("build"), last("#!genome-build-accession").alias("build_accession"), last("##species ").alias("species"), last("#!processor ").alias("processor"))
    r = read_gff(spark, path, "region", strict=False, keep="all").groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("seqid", F.to_json("attributes").alias("attributes"))))).alias("regions"))
    return p.join(r, "file", "left")


def on_strand(features: DataFrame, strand: str) -> DataFrame:
    return features.filter(F.col("strand") == strand)


def contig_names(features: DataFrame) -> DataFrame:
    return features.select("seqid").distinct()


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def gene_of_protein(cds: DataFrame) -> DataFrame:
    """(protein, gene) of CDS features: id to Parent."""
    return cds.select(F.col("id").alias("protein"), attribute("Parent").alias("gene"))


def protein_of_gene(cds: DataFrame) -> DataFrame:
    """(gene, protein), the last CDS of a gene."""
    x = cds.select(attribute("Parent").alias("gene"), F.col("id").alias("protein"), "ord").filter("gene is not null")
    return last_wins(x, ["gene"]).select("gene", "protein")


def simple_annotation(cds: DataFrame, genes: DataFrame, coordinates: bool = False, contig: bool = False) -> DataFrame:
    """(gene_id, protein_id, common_name, product[, start, end, strand][, contig]) of CDS features; common_name is the gene's or ''."""
    names = genes.select(F.col("id").alias("_gene"), F.coalesce(attribute("gene"), attribute("Name")).alias("_name"))
    x = cds.withColumn("_gene", attribute("Parent")).join(names, "_gene", "left")
    cols = [F.col("_gene").alias("gene_id"), F.col("id").alias("protein_id"), F.coalesce("_name", F.lit("")).alias("common_name"), F.coalesce(attribute("product"), F.lit("")).alias("product")]
    cols += [F.col("start"), F.col("end"), F.col("strand")] if coordinates else []
    return x.select(*cols, *([F.col("seqid").alias("contig")] if contig else []))


def saf(features: DataFrame) -> DataFrame:
    """(GeneID, Chr, Start, End, Strand) with 'gene-' off the ids."""
    return features.select(F.regexp_replace("id", "^gene-", "").alias("GeneID"), F.col("seqid").alias("Chr"), F.col("start").alias("Start"), F.col("end").alias("End"), F.col("strand").alias("Strand"))


def change_attribute(features: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """features with one attribute replaced by values(id, value)."""
    x = features.join(values.select("id", F.col("value").alias("_v")), "id", "left")
    rest = F.map_filter("attributes", lambda k, v: k != name)
    return x.withColumn("attributes", F.when(F.col("_v").isNotNull(), F.map_concat(rest, F.create_map(F.lit(name), F.col("_v")))).otherwise(F.col("attributes"))).drop("_v")


def read_genbank(spark: SparkSession, path) -> DataFrame:
    """CDS features of GenBank files: 0-based half-open coordinates, strand 1 or -1; locus_tag is required."""
    from .genbank import cds_features

    return cds_features(spark.read.text(path, wholetext=True).select(F.col("value").alias("text")))


def genbank_annotation(cds: DataFrame, contig: str | None = None, coordinates: bool = False) -> DataFrame:
    x = cds.filter(F.col("contig") == contig) if contig else cds
    cols = [F.col("locus_tag").alias("gene_id"), F.coalesce("protein_id", "locus_tag").alias("protein_id"), F.coalesce("gene", F.lit("")).alias("common_name"), F.coalesce("product", F.lit("")).alias("product")]
    return x.select(*cols, *(["start", "end", "strand"] if coordinates else []))


# ---- hit tables -----------------------------------------------------------------------------------------


def _fixed_table(spark: SparkSession, path, names: list[str], doubles: list[str], ints: list[str], strict: bool = False) -> DataFrame:
    f = F.split(F.trim("line"), r"\s+", len(names))
    x = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", f.alias("f"))

    def typed(i: int, name: str) -> Column:
        v = F.get("f", i)
        kind = "double" if name in doubles else "int" if name in ints else None
        if kind is None:
            return F.trim(F.coalesce(v, F.lit(""))).alias(name)
        return (v.cast(kind) if strict else v.try_cast(kind)).alias(name)

    return x.select("file", *[typed(i, n) for i, n in enumerate(names)])


def read_hmmscan(spark: SparkSession, path) -> DataFrame:
    """19-column tables; what isn't a number is null."""
    return _fixed_table(spark, path, S.SCAN_COLUMNS, S.SCAN_DOUBLES, S.SCAN_INTS)


def read_hmmsearch(spark: SparkSession, path, cutoff: float | None = None) -> DataFrame:
    """19-column tables, junk in a number is an error; cutoff keeps full_score >= cutoff."""
    x = _fixed_table(spark, path, S.SCAN_COLUMNS, S.SCAN_DOUBLES, S.SCAN_INTS, strict=True)
    return x.filter(F.col("full_score") >= cutoff) if cutoff is not None else x


def read_domains(spark: SparkSession, path) -> DataFrame:
    """23-column per-domain tables."""
    return _fixed_table(spark, path, S.DOMAIN_COLUMNS, S.DOMAIN_DOUBLES, S.DOMAIN_INTS)


def read_minimal_hits(spark: SparkSession, path) -> DataFrame:
    """(file, target, accession, evalue, ord): columns 1, 4 and 5 of a search table."""
    x = _lines(spark, path, numbered=True).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("f", F.split(F.trim("line"), r"\s+"))
    return x.select("file", F.get("f", 0).alias("target"), F.get("f", 3).alias("accession"), F.get("f", 4).try_cast("double").alias("evalue"), "ord")


def read_blast12(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=S.BLAST12, comment="#")


def read_blast9(spark: SparkSession, path) -> DataFrame:
    x = spark.read.csv(path, sep="\t", comment="#", schema=", ".join(f"{c} string" for c in S.BLAST9_COLUMNS))
    return x.select(*[F.col(c).try_cast("double").alias(c) if c in S.BLAST9_DOUBLES else F.col(c) for c in S.BLAST9_COLUMNS])


def read_blast_best_hits(spark: SparkSession, path, accession_length: int = 15) -> DataFrame:
    """(accession, hit): the first word two lines below the line of significant alignments; the accession begins the file name."""
    x = _lines(spark, path, numbered=True)
    banner = x.filter(F.col("line").contains("significant alignments")).groupBy("path").agg((F.min("ord") + 2).alias("ord"))
    return x.join(banner, ["path", "ord"]).select(F.substring("file", 1, accession_length).alias("accession"), F.regexp_extract(F.trim("line"), r"^(\S+)", 1).alias("hit"))


def read_blast_subjects(spark: SparkSession, path, which: str = "first", accession_length: int = 13) -> DataFrame:
    """(accession, hit): the first or last '>' line's id of each report."""
    x = _lines(spark, path, numbered=True).filter(F.col("line").startswith(">"))
    hit = F.regexp_extract("line", r"^>\s*(\S+)", 1)
    s = F.struct("ord", hit.alias("hit"))
    return x.groupBy("path", "file").agg((F.min(s) if which == "first" else F.max(s)).alias("s")).select(F.substring("file", 1, accession_length).alias("accession"), "s.hit")


def profile_versions(spark: SparkSession, path) -> DataFrame:
    """(accession, versioned) of a profile database's ACC lines, the last wins."""
    x = _lines(spark, path, numbered=True).filter(F.col("line").startswith("ACC")).select(F.struct("path", "ord").alias("ord"), F.regexp_extract("line", r"^ACC\s+(\S+)", 1).alias("versioned"))
    return last_wins(x.withColumn("accession", F.split_part("versioned", F.lit("."), F.lit(1))), ["accession"]).select("accession", "versioned")


# ---- reports --------------------------------------------------------------------------------------------


def read_status_table(spark: SparkSession, path, assembly: str | None = None) -> DataFrame:
    """(assembly, busco_id, status, sequence, score, length, url, description), short rows filled up."""
    x = _lines(spark, path).filter(~F.col("line").startswith("#") & (F.trim("line") != "")).withColumn("f", F.split("line", "\t"))
    part = lambda i: F.nullif(F.get("f", i), F.lit(""))
    cols = [part(i).try_cast({"score": "double", "length": "int"}.get(n, "string")).alias(n) for i, n in enumerate(S.STATUS_COLUMNS)]
    return x.select((F.lit(assembly) if assembly else F.col("file")).alias("assembly"), *cols)


def read_feature_counts(spark: SparkSession, path, remove: str = ".bam") -> DataFrame:
    """(gene, sample, n): columns 1 and 7 after the comment line; the sample is the header's name without `remove`."""
    x = _lines(spark, path, numbered=True).filter("ord > 0 and trim(line) <> ''").withColumn("f", F.split("line", "\t"))
    head = x.filter("ord = 1").select("path", F.replace(F.get("f", 6), F.lit(remove), F.lit("")).alias("sample"))
    return x.filter("ord > 1").join(F.broadcast(head), "path").select(F.get("f", 0).alias("gene"), "sample", F.get("f", 6).try_cast("long").alias("n"))  # a row per file


def read_coverage(spark: SparkSession, path) -> DataFrame:
    """(genomic_position, plus, minus), missing counts as 0."""
    return spark.read.csv(path, header=True, schema="genomic_position int, plus double, minus double").na.fill(0.0, ["plus", "minus"])


def read_assembly_reports(spark: SparkSession, path) -> DataFrame:
    """The raw table of a report file: one row with a reports (or assemblies) array."""
    x = spark.read.json(path, multiLine=True)
    return x.withColumnRenamed("assemblies", "reports") if "reports" not in x.columns and "assemblies" in x.columns else x


def read_states(spark: SparkSession, path) -> DataFrame:
    """Ancestral site tables: Node, Site, State and p_ columns as doubles."""
    x = spark.read.csv(path, sep="\t", comment="#", header=True)
    return x.select(*[F.col(c).try_cast("int" if c == "Site" else "double").alias(c) if c == "Site" or c.startswith("p_") else F.col(c) for c in x.columns])


def read_distance_triangle(spark: SparkSession, path, name_length: int = 15) -> DataFrame:
    """(a, b, dist) of a lower triangle: a row's name and its distances to the rows before it."""
    x = _lines(spark, path, numbered=True).filter("ord > 0 and trim(line) <> ''").withColumn("f", F.split(F.rtrim("line"), "\t"))
    name = F.substring(F.regexp_extract(F.get("f", 0), r"([^/]*)$", 1), 1, name_length)
    r = x.select("path", "ord", name.alias("name"), F.expr("slice(f, 2, size(f))").alias("d"))
    cells = r.select("path", "ord", F.col("name").alias("a"), F.posexplode("d").alias("j", "v"))
    return cells.join(r.select("path", (F.col("ord") - 1).alias("j"), F.col("name").alias("b")), ["path", "j"]).select("a", "b", F.col("v").try_cast("double").alias("dist")).filter("dist is not null")


def read_clusters(spark: SparkSession, path) -> DataFrame:
    """(cluster_id, ord, name, is_rep) of cluster listings."""
    x = _lines(spark, path, numbered=True).filter("trim(line) <> ''")
    head = F.col("line").startswith(">Cluster")
    x = _running(x, head, "block")
    return x.filter(~head).select((F.col("block") - 1).cast("int").alias("cluster_id"), "ord", F.regexp_extract("line", r">(.+?)\.\.\.", 1).alias("name"), F.rtrim("line").endswith("*").alias("is_rep"))


def read_folds(spark: SparkSession, path) -> DataFrame:
    """(id, seq, structure, energy) of three-line records; the energy is the last bracketed number."""
    x = _lines(spark, path, numbered=True).withColumn("rec", F.floor(F.col("ord") / 3)).withColumn("k", F.col("ord") % 3)
    pick = lambda i: F.max(F.when(F.col("k") == i, F.col("line")))
    r = x.groupBy("path", "rec").agg(pick(0).alias("h"), pick(1).alias("seq"), pick(2).alias("s")).filter("h like '>%'")
    return r.select(F.regexp_extract("h", r"^>\s*(\S+)", 1).alias("id"), F.trim("seq").alias("seq"), F.regexp_extract("s", r"^(\S+)", 1).alias("structure"), F.regexp_extract("s", r"\(\s*([-+0-9.]+)\s*\)\s*$", 1).try_cast("double").alias("energy"))


def read_codeml(spark: SparkSession, path) -> DataFrame:
    """(file, np, lnl, kappa, omega, background_omega, foreground_omega) of codon-model reports."""
    x = spark.read.text(path, wholetext=True).select(_file().alias("file"), "value")
    num = r"([-+0-9.eE]+)"
    pick = lambda p, i=1: F.regexp_extract("value", p, i).try_cast("double")
    branch = F.transform(F.split(F.trim(F.regexp_extract("value", r"w \(dN/dS\) for branches:\s*([^\r\n]+)", 1)), r"\s+"), lambda v: v.try_cast("double"))
    two = F.size(F.array_compact(branch)) >= 2
    return x.select(
        "file", F.regexp_extract("value", r"lnL\([^)]*np:\s*(\d+)\)", 1).try_cast("int").alias("np"), pick(r"lnL\([^)]*\):\s*" + num).alias("lnl"),
        pick(r"kappa \(ts/tv\)\s*=\s*" + num).alias("kappa"), pick(r"omega \(dN/dS\)\s*=\s*" + num).alias("omega"),
        F.when(two, F.get(branch, 0)).alias("background_omega"), F.when(two, F.get(branch, 1)).alias("foreground_omega"),
    )


def read_stockholm(spark: SparkSession, path) -> DataFrame:
    """(aln_id, seq_id, seq): rows of Stockholm or Pfam text, '.' as '-', upper case; blocks of a sequence are joined."""
    x = _lines(spark, path, numbered=True).filter(~F.col("line").startswith("#") & ~F.col("line").startswith("/") & (F.length("line") > 5))
    w = F.split(F.trim("line"), r"\s+")
    r = x.select("path", "file", "ord", F.get(w, 0).alias("seq_id"), F.get(w, 1).alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "s")))
    return r.groupBy("path", F.col("file").alias("aln_id"), "seq_id").agg(F.replace(F.upper(F.array_join(F.transform(ordered, lambda p: p["s"]), "")), F.lit("."), F.lit("-")).alias("seq")).drop("path")


def read_a2m_matches(spark: SparkSession, path) -> DataFrame:
    """(aln_id, seq_id, seq) with insertions dropped; repeated ids, and lengths that differ or are 0, raise."""
    from ..operators.alignment import require_equal_lengths
    from ..plans.session import require_unique

    x = read_fasta(spark, path, upper=False, keep="all").select(F.col("source").alias("aln_id"), "seq_id", F.regexp_replace("seq", "[^A-Z-]", "").alias("seq"))
    require_unique(x, ["aln_id", "seq_id"], "alignment")
    require_equal_lengths(x)
    if not x.filter("length(seq) = 0").isEmpty():
        raise ValueError("an alignment has no match columns")
    return x


def read_newick(spark: SparkSession, path) -> DataFrame:
    """Tree rows; files of several trees number them after the file's name."""
    from ..operators.tree import parse_newick

    x = spark.read.text(path, wholetext=True).select(_file().alias("file"), F.posexplode(F.split("value", ";")).alias("k", "t")).filter(F.col("t").rlike(r"\S"))
    n = F.count("*").over(Window.partitionBy("file"))
    return parse_newick(x.select(F.when(n > 1, F.concat_ws("#", "file", F.col("k").cast("string"))).otherwise(F.col("file")).alias("tree_id"), F.concat(F.trim(F.regexp_replace("t", r"[\r\n]+", "")), F.lit(";")).alias("newick")))


# ---- directories ----------------------------------------------------------------------------------------


def list_files(spark: SparkSession, folder: str, ends: str | None = None, begins: str | None = None, not_begins: str | None = None, not_ends: str | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, length): one filter, of those given the first in this order: ends, begins, not_begins, not_ends."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", _file().alias("name"), "length")
    if ends is not None:
        return x.filter(F.col("name").endswith(ends))
    if begins is not None:
        return x.filter(F.col("name").startswith(begins))
    if not_begins is not None:
        return x.filter(~F.col("name").startswith(not_begins))
    return x.filter(~F.col("name").endswith(not_ends)) if not_ends is not None else x


def proteome_files(spark: SparkSession, folder: str, suffix: str = ".faa") -> DataFrame:
    """(assembly, path) of files with a suffix, sorted; none is an error."""
    x = list_files(spark, folder, ends=suffix)
    if x.isEmpty():
        raise ValueError(f"no *{suffix} in {folder}")
    return x.select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("assembly"), "path").orderBy("assembly")


def folders_without(files: DataFrame, prefix: str = "GC", suffix: str = ".faa") -> DataFrame:
    """(folder): folders whose name begins with prefix and that hold no file with suffix."""
    f = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "name")
    return f.filter(F.col("folder").startswith(prefix)).select("folder").distinct().join(f.filter(F.col("name").endswith(suffix)).select("folder").distinct(), "folder", "left_anti")


def folders_with_one(files: DataFrame, suffix: str = ".faa") -> DataFrame:
    """(folder, path) of folders with exactly one file with suffix."""
    f = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), "path", "name").filter(F.col("name").endswith(suffix))
    return f.groupBy("folder").agg(F.count("*").alias("n"), F.min("path").alias("path")).filter("n = 1").select("folder", "path")


def complete_runs(files: DataFrame, summary: str = "short_summary") -> DataFrame:
    """(assembly) of run folders that hold a summary JSON."""
    f = files.filter(F.col("name").contains(summary) & F.col("name").endswith(".json"))
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("assembly")).distinct()


def reads_alignment(reads: DataFrame, start: int = 0, end: int = 15) -> DataFrame:
    """Columns start to end (excluded) of reads as one alignment, for frequency and logo matrices."""
    return reads.select(F.lit("reads").alias("aln_id"), F.col("read_id").alias("seq_id"), F.expr(f"substring(seq, {start + 1}, {end - start})").alias("seq"))
