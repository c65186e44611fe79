"""Multi-step runs of external programs as lists of commands; the tables between them are operators' work."""

from __future__ import annotations

from pathlib import Path

from .tools import TOOLS, is_current


def reciprocal_search(proteomes: dict[str, str], query: str, reference: str, folder: str) -> list[list[str]]:
    """Databases of all proteomes and the reference, the query against each, then best hits against the reference.

    The best-hit queries are written between the two searches (tables.reciprocal_best_hits reads both)."""
    f = Path(folder)
    out = [TOOLS["makeblastdb"].argv(input=p, dbtype="prot", output=f / "db" / a) for a, p in sorted(proteomes.items())]
    out.append(TOOLS["makeblastdb"].argv(input=reference, dbtype="prot", output=f / "db" / "reference"))
    out += [TOOLS["blastp_report"].argv(input=query, database=f / "db" / a, output=f / "forward" / f"{a}.txt") for a in sorted(proteomes)]
    return out + [TOOLS["blastp_report"].argv(input=f / "best" / f"{a}.faa", database=f / "db" / "reference", output=f / "reverse" / f"{a}.txt") for a in sorted(proteomes)]


def marker_gene_tree(proteomes: dict[str, str], profiles: list[str], folder: str, database: str) -> list[list[str]]:
    """Search every proteome, align every marker, build the tree; an existing output folder is an error."""
    f = Path(folder)
    if f.exists():
        raise FileExistsError(folder)
    out = [TOOLS["hmmpress"].argv(input=database)]
    out += [TOOLS["hmmsearch_strict"].argv(table=f / "search" / f"{a}.tbl", profile=database, input=p) for a, p in sorted(proteomes.items())]
    out += [TOOLS["hmmalign"].argv(format="Pfam", output=f / "aligned" / f"{m}.sto", profile=f / "profiles" / f"{m}.hmm", input=f / "markers" / f"{m}.faa") for m in sorted(profiles)]
    return out + [TOOLS["fasttree"].argv({"quiet": True}, input=f / "supermatrix.faa")]


def status_runs(proteomes: dict[str, str], folder: str, lineage: str, cpu: int = 8, force: bool = False) -> list[list[str]]:
    """One run for each proteome that has no finished run yet."""
    todo = {a: p for a, p in proteomes.items() if force or not list(Path(folder, a).glob("short_summary*.json"))}
    return [TOOLS["busco"].argv({"force": force}, input=p, name=a, output=folder, lineage=lineage, cpu=cpu) for a, p in sorted(todo.items())]


def gene_trees(alignments: dict[str, str], folder: str, threads: int = 1, replicates: int = 1000, force: bool = False) -> list[list[str]]:
    """One tree for each alignment without a current one."""
    out = []
    for locus, path in sorted(alignments.items()):
        prefix = Path(folder, locus)
        if force or not is_current(f"{prefix}.treefile", path):
            out.append(TOOLS["iqtree_gene"].argv({"-redo": force}, input=path, bootstraps=replicates, alrt=replicates, threads=threads, prefix=prefix))
    return out


def distance_run(sketches: list[str], folder: str, threads: int = 8) -> tuple[str, list[str]]:
    """A list file's text and the command that computes all pairs' distances."""
    return "".join(f"{s}\n" for s in sketches), TOOLS["mash_triangle"].argv(threads=threads, list=Path(folder, "sketches.txt"))


def genome_download(accessions: str, include: list[str], archive: str, folder: str) -> list[list[str]]:
    """A dehydrated archive of the accessions of a file, unpacked, then filled with its sequences."""
    if not include:
        raise ValueError("nothing to include")
    return [
        TOOLS["genomes_download"].argv(accessions=accessions, include=",".join(dict.fromkeys(include)), output=archive),
        ["unzip", "-o", archive, "-d", folder],
        TOOLS["genomes_rehydrate"].argv(folder=folder),
    ]
