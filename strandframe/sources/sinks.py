"""Writers.  Row order in a file follows an ordinal; one file is written by one task after a global sort."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import wrap


def write_lines(lines: DataFrame, path: str, order: list | None = None, single: bool = True) -> None:
    """lines(value) as text; single: one part file, in order."""
    x = lines.orderBy(*order) if order else lines
    (x.coalesce(1) if single else x).select("value").write.mode("overwrite").text(path)


def write_if_changed(path: str, text: str) -> bool:
    """A small driver-side file, left alone where it already has the text.  Whether it was written."""
    p = Path(path)
    if p.exists() and p.read_text() == text:
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return True


def fasta_lines(sequences: DataFrame, width: int | None = None) -> DataFrame:
    seq = wrap("seq", width) if width else F.col("seq")
    return sequences.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), seq).alias("value"), *[c for c in ("ord",) if c in sequences.columns])


def write_fasta(sequences: DataFrame, path: str, width: int | None = None, single: bool = True) -> None:
    x = fasta_lines(sequences, width)
    write_lines(x, path, ["ord"] if "ord" in x.columns else ["value"], single)


def write_fasta_by(sequences: DataFrame, path: str, by: str) -> None:
    """A folder per value of a column: one pass over the data instead of one a file."""
    x = sequences.select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), "seq").alias("value"), by)
    x.repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def phylip_lines(alignment: DataFrame) -> DataFrame:
    """Relaxed PHYLIP: a header of count and length, then a row per sequence."""
    head = alignment.agg(F.concat_ws(" ", F.count("*").cast("string"), F.max(F.length("seq")).cast("string")).alias("value")).withColumn("ord", F.lit(-1).cast("long"))
    o = F.col("ord").cast("long") if "ord" in alignment.columns else F.lit(0).cast("long")
    return head.unionByName(alignment.select(F.concat_ws("  ", "seq_id", "seq").alias("value"), o.alias("ord")))


def write_phylip(alignment: DataFrame, path: str) -> None:
    write_lines(phylip_lines(alignment), path, ["ord", "value"])


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = True, order: list | None = None) -> None:
    x = df.orderBy(*order) if order else df
    x.coalesce(1).write.mode("overwrite").csv(path, sep=sep, header=header, emptyValue="")


def gff_lines(features: DataFrame) -> DataFrame:
    attrs = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return features.select(F.concat_ws("\t", *[dot(c) for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase")], attrs).alias("value"), "ord")


def write_gff(features: DataFrame, path: str) -> None:
    write_lines(gff_lines(features), path, ["ord"])


def write_fastq(reads: DataFrame, path: str) -> None:
    write_lines(reads.select(F.concat_ws("\n", "read_id", "seq", F.lit("+"), "quality").alias("value"), "ord"), path, ["ord"])


def write_newick(nodes: DataFrame, path: str) -> None:
    """One tree a line, each ended by ';'."""
    from ..operators.tree import to_newick

    write_lines(to_newick(nodes).select("tree_id", F.col("newick").alias("value")), path, ["tree_id"])


def partition_text(rows) -> str:
    """A NEXUS sets block of (aln_id, start, end) rows."""
    body = "".join(f"    charset {r['aln_id']} = {r['start']}-{r['end']};\n" for r in rows)
    return f"#nexus\nbegin sets;\n{body}end;\n"


def write_partitions(partitions: DataFrame, path: str) -> bool:
    return write_if_changed(path, partition_text(partitions.orderBy("start").collect()))  # a row per locus


def gene_species_lines(sequences: DataFrame, separator: str = "__") -> DataFrame:
    """'gene species' lines by the id's prefix."""
    return sequences.select(F.concat_ws(" ", "seq_id", F.substring_index("seq_id", separator, 1)).alias("value"))


# ---- tree-viewer datasets ---------------------------------------------------------------------------------

# The default palette.
PALETTE = ["#1F77B4", "#FF7F0E", "#2CA02C", "#D62728", "#9467BD", "#8C564B", "#E377C2", "#7F7F7F", "#BCBD22", "#17BECF"]


def field_lines(names: list[str], colours: list[str] | None = None, legend: bool = False) -> list[str]:
    """Label and colour header lines; more names than colours is an error."""
    colours = colours or PALETTE
    if len(names) > len(colours):
        raise ValueError(f"{len(names)} names but {len(colours)} colours")
    kind = "LEGEND" if legend else "FIELD"
    return [f"{kind}_LABELS," + ",".join(names), f"{kind}_COLORS," + ",".join(colours[: len(names)])]


def viewer_dataset(kind: str, label: str, rows: DataFrame, columns: list[str], header: list[str] = [], colour: str = "#848991") -> str:  # noqa: B006
    """The text of a dataset: header, then a line per row in the order of its first column.  Rows are a tree's leaves."""
    head = [kind, "SEPARATOR COMMA", f"DATASET_LABEL,{label}", f"COLOR,{colour}", *header, "DATA"]
    body = [",".join("" if v is None else str(v) for v in r) for r in rows.select(*columns).orderBy(columns[0]).collect()]
    return "\n".join(head + body) + "\n"


def pie_dataset(counts: DataFrame, names: list[str], label: str = "pies", position: float = 0.5, radius: int = 1) -> str:
    x = counts.withColumn("_p", F.lit(position)).withColumn("_r", F.lit(radius))
    return viewer_dataset("DATASET_PIECHART", label, x, ["node", "_p", "_r", *names], field_lines(names))


def bar_dataset(values: DataFrame, label: str = "bars") -> str:
    return viewer_dataset("DATASET_SIMPLEBAR", label, values, ["node", "value"])


def multi_bar_dataset(values: DataFrame, names: list[str], label: str = "bars") -> str:
    return viewer_dataset("DATASET_MULTIBAR", label, values, ["node", *names], field_lines(names))


def binary_dataset(values: DataFrame, names: list[str], label: str = "traits", shape: int = 1) -> str:
    return viewer_dataset("DATASET_BINARY", label, values, ["node", *names], [*field_lines(names), "FIELD_SHAPES," + ",".join([str(shape)] * len(names))])


def colour_strip(rows: DataFrame, label: str = "groups") -> str:
    """rows(node, colour, group, ord): strip lines, and a legend of the groups in the order of their first row."""
    legend = [(r["group"], r["colour"]) for r in rows.groupBy("group", "colour").agg(F.min("ord").alias("o")).orderBy("o").collect()]
    head = [f"LEGEND_TITLE,{label}", "LEGEND_SHAPES," + ",".join("1" for _ in legend), "LEGEND_COLORS," + ",".join(c for _, c in legend), "LEGEND_LABELS," + ",".join(g for g, _ in legend)]
    return viewer_dataset("DATASET_COLORSTRIP", label, rows, ["node", "colour", "group"], head)


def leaf_labels(names: DataFrame) -> str:
    body = [f"{r['name']},{r['new_name']}" for r in names.orderBy("name").collect()]
    return "\n".join(["LABELS", "SEPARATOR COMMA", "DATA", *body]) + "\n"


def lineage_styles(groups: dict[str, list[str]], colours: list[str] | None = None, line: str = "normal", width: int = 2) -> str:
    """Branch and label styles for the nodes of each group."""
    colours = colours or PALETTE
    rows = [f"{n},{t},node,{colours[i % len(colours)]},{width if t == 'branch' else 1},{line if t == 'branch' else 'bold'}" for i, (_, nodes) in enumerate(groups.items()) for n in nodes for t in ("branch", "label")]
    return "\n".join(["DATASET_STYLE", "SEPARATOR COMMA", "DATASET_LABEL,lineages", "COLOR,#000000", "DATA", *rows]) + "\n"


# ---- files on the driver ------------------------------------------------------------------------------------


def copy_per_accession(source: str, folder: str, suffix: str = ".faa", move: bool = False) -> list[str]:
    """Each accession folder's file with a suffix, named after the folder; two are an error.  Folders without one."""
    import shutil

    missing = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for d in sorted(p for p in Path(source).iterdir() if p.is_dir()):
        found = sorted(d.glob(f"*{suffix}"))
        if len(found) > 1:
            raise ValueError(f"{d.name} has {len(found)} *{suffix} files")
        if not found:
            missing.append(d.name)
        else:
            (shutil.move if move else shutil.copy)(str(found[0]), str(Path(folder, d.name + suffix)))
    return missing


def concatenate_files(folder: str, output: str, suffix: str) -> int:
    """All files with a suffix in the order of their names, into one.  How many."""
    files = sorted(Path(folder).glob(f"*{suffix}"))
    with open(output, "wb") as out:
        for f in files:
            data = f.read_bytes()
            out.write(data if data.endswith(b"\n") or not data else data + b"\n")
    return len(files)


def unpack(archive: str, folder: str) -> None:
    import shutil

    shutil.unpack_archive(archive, folder)
