"""External programs as declarative specifications: what to run, never how to schedule it.

argv() builds a command; run_per_row() fans commands out to the executors.  Programs are optional: a
missing one is an error only when it is run.
"""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from os import PathLike
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from .shipping import ship_package


@dataclass(frozen=True)
class ToolSpec:
    """fixed and template parts are literal or '{name}'; options not in `allowed` raise (None: all pass).

    dashes: 'single' or 'double' before every option, or 'auto' by the name's length; underscores in
    names become hyphens unless the name is in `verbatim`."""

    name: str
    executable: str
    template: tuple[str, ...] = ()
    allowed: frozenset[str] | None = None
    dashes: str = "auto"
    verbatim: frozenset[str] = frozenset()
    tail: tuple[str, ...] = ()
    outputs: tuple[str, ...] = field(default=())

    def argv(self, options: Mapping | None = None, executable: str | None = None, **values) -> list[str]:
        fill = {k: str(v) for k, v in values.items()}
        part = lambda t: t.format(**fill)
        return [executable or self.executable, *map(part, self.template), *self.flags(options or {}), *map(part, self.tail)]

    def flags(self, options: Mapping) -> list[str]:
        """True adds a flag, None and False nothing, a sequence all its values."""
        out: list[str] = []
        for name, value in options.items():
            if self.allowed is not None and name not in self.allowed:
                raise ValueError(f"{self.name} has no option {name!r}")
            if value is None or value is False:
                continue
            out.append(self.option(name))
            if value is True:
                continue
            out += [str(v) for v in value] if isinstance(value, Sequence) and not isinstance(value, (str, bytes, PathLike)) else [str(value)]
        return out

    def option(self, name: str) -> str:
        if name.startswith("-"):
            return name
        dash = {"single": "-", "double": "--"}.get(self.dashes) or ("-" if len(name) == 1 else "--")
        return dash + (name if name in self.verbatim or self.dashes == "single" else name.replace("_", "-"))


def _spec(name: str, executable: str, template: str = "", **more) -> ToolSpec:
    more = {k: (frozenset(v.split()) if k in ("allowed", "verbatim") else tuple(v.split()) if k == "tail" else v) for k, v in more.items()}
    return ToolSpec(name, executable, tuple(template.split()), **more)


_GA = "cut_ga cut_nc cut_tc"
#: One entry per program and use.
TOOLS = {
    s.name: s
    for s in (
        _spec("mafft", "mafft", allowed="auto retree maxiterate localpair globalpair genafpair thread op ep reorder adjustdirection quiet inputorder", dashes="double", tail="{input}"),
        _spec("mafft_linsi", "mafft", "--localpair --maxiterate 1000 --thread {threads} {input}"),
        _spec("muscle_align", "muscle", "-align {input} -output {output}", dashes="single"),
        _spec("muscle_super5", "muscle", "-super5 {input} -output {output}", dashes="single"),
        _spec("clipkit", "clipkit", "{input} -m {mode} -o {output}"),
        _spec("pal2nal", "pal2nal.pl", "{protein} {cds} -output {format}", dashes="single"),
        _spec("makeblastdb", "makeblastdb", "-in {input} -dbtype {dbtype} -out {output}", dashes="single"),
        ToolSpec("blastp_table", "blastp", ("-db", "{database}", "-query", "{input}", "-outfmt", "6 qseqid sseqid pident length mismatch gapopen qstart qend sstart send evalue bitscore", "-out", "{output}"), dashes="single"),
        _spec("blastp_report", "blastp", "-query {input} -db {database} -num_descriptions 5 -num_alignments 5 -out {output}", dashes="single"),
        _spec("bowtie2_paired", "bowtie2", "-x {index} -1 {first} -2 {second} -S {output}"),
        _spec("bowtie2_single", "bowtie2", "-x {index} -U {input} -S {output}"),
        _spec("samtools_bam", "samtools", "view -o {output} -b {input}"),
        _spec("mash_sketch", "mash", "sketch {input} -o {output}"),
        _spec("mash_triangle", "mash", "triangle -p {threads} -l {list}"),
        _spec("treecluster", "TreeCluster.py", "-i {input} -o {output} -t {threshold} -m {method}"),
        _spec("fasttree", "fasttree", dashes="single", tail="{input}"),
        _spec("prodigal", "prodigal", dashes="single", allowed="a c d f g i m n o p q s t"),
        _spec("hmmbuild", "hmmbuild", dashes="double", tail="{output} {input}"),
        _spec("hmmpress", "hmmpress", "{input}"),
        _spec("hmmscan", "hmmscan", "--tblout {table} --domtblout {domains} -o {raw}", verbatim=_GA, tail="{database} {input}"),
        _spec("hmmsearch", "hmmsearch", "--tblout {table} -o {raw}", verbatim=_GA, tail="{profile} {input}"),
        _spec("hmmsearch_domains", "hmmsearch", "--tblout {table} --domtblout {domains} -o {raw}", verbatim=_GA, tail="{profile} {input}"),
        _spec("hmmsearch_strict", "hmmsearch", "--tblout {table} -E 1e-5 {profile} {input}"),
        _spec("hmmfetch", "hmmfetch", "{database} {profile}"),
        _spec("hmmalign", "hmmalign", "--outformat {format}", tail="-o {output} {profile} {input}", allowed="trim"),
        _spec("busco", "busco", "--in {input} --out {name} --out_path {output} --mode proteins --lineage_dataset {lineage} --cpu {cpu}", allowed="force"),
        _spec("iqtree_gene", "iqtree3", "-s {input} -m MFP -bb {bootstraps} -alrt {alrt} -nt {threads} --prefix {prefix}", allowed="-redo"),
        _spec("iqtree_species", "iqtree3", "-s {input} -p {partitions} -m {model} -B {bootstraps} --alrt {alrt} -T {threads} --prefix {prefix}", allowed="-redo"),
        _spec("iqtree_ancestral", "iqtree3", "-s {input} -m {model} -T {threads} --prefix {prefix} --ancestral"),
        _spec("astral", "astral", "-i {input} -o {output} -t {annotation}"),
        _spec("codeml", "codeml", "{control}"),
        _spec("rnafold", "RNAfold", "-i {input} -T {temperature} --noPS"),
        _spec("fastqc", "fastqc", "-o {output} {input}"),
        _spec("genomes_download", "datasets", "download genome accession --inputfile {accessions} --include {include} --dehydrated --filename {output}"),
        _spec("genomes_rehydrate", "datasets", "rehydrate --directory {folder}"),
        _spec("genome_summaries", "datasets", "summary genome accession --inputfile {accessions}"),
        _spec("multiqc", "multiqc", "{input} --title {title} --outdir {output}"),
    )
}


def available(*names: str) -> dict[str, str | None]:
    """Where each program is, or None."""
    return {n: shutil.which(TOOLS[n].executable if n in TOOLS else n) for n in names}


def require_programs(*names: str) -> None:
    lost = [n for n, p in available(*names).items() if p is None]
    if lost:
        raise FileNotFoundError(f"programs not found: {', '.join(lost)}")


def outgroup_option(outgroups) -> str | None:
    """'a,b' from a list, a comma list, or a file of names; repeats go."""
    if outgroups is None:
        return None
    if isinstance(outgroups, (str, PathLike)):
        p = Path(outgroups)
        text = p.read_text() if p.is_file() else str(outgroups)
        outgroups = text.replace("\n", ",").split(",")
    names = list(dict.fromkeys(x.strip() for x in outgroups if x.strip()))
    if not names:
        raise ValueError("no outgroup names")
    return ",".join(names)


def is_current(output: str, *inputs: str) -> bool:
    """Whether an output exists and is as new as its inputs."""
    o = Path(output)
    return o.is_file() and o.stat().st_size > 0 and all(o.stat().st_mtime >= Path(i).stat().st_mtime for i in inputs)


def run_tool(spec: ToolSpec, options: Mapping | None = None, stdin: bytes | None = None, **values) -> subprocess.CompletedProcess:
    done = subprocess.run(spec.argv(options, **values), input=stdin, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"{spec.name} failed: {done.stderr.decode(errors='replace')[-500:]}")
    return done


def run_per_row(rows: DataFrame, tool: str, values: list[str], options: Mapping | None = None) -> DataFrame:
    """(columns of rows, exit_code, stdout, stderr): the tool once per row, on the executors."""
    ship_package(rows.sparkSession)
    spec = TOOLS[tool]
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", exit_code int, stdout binary, stderr string"

    def run(batches):
        for pdf in batches:
            codes, outs, errs = [], [], []
            for r in pdf.to_dict("records"):
                done = subprocess.run(spec.argv(options, **{v: r[v] for v in values}), capture_output=True)
                codes.append(done.returncode), outs.append(done.stdout), errs.append(done.stderr.decode(errors="replace"))
            yield pdf.assign(exit_code=pd.Series(codes, dtype="int32", index=pdf.index), stdout=pd.Series(outs, dtype=object, index=pdf.index), stderr=pd.Series(errs, dtype=object, index=pdf.index))

    return rows.mapInPandas(run, schema)


def codeml_control(seqfile: str, treefile: str, outfile: str, model: int = 0, codon_freq: int = 2, omega: float = 0.1, fix_omega: int = 0, clean: int = 0, sites: int = 0) -> str:
    """A codon-model control file."""
    fields = {
        "seqfile": seqfile, "treefile": treefile, "outfile": outfile, "noisy": 3, "verbose": 1, "runmode": 0, "seqtype": 1, "CodonFreq": codon_freq, "model": model,
        "NSsites": sites, "icode": 10, "fix_kappa": 0, "kappa": 2, "fix_omega": fix_omega, "omega": omega, "cleandata": clean,
    }
    return "".join(f"{k:>12} = {v}\n" for k, v in fields.items())


def reconciliation_families(names: Sequence[str], alignments: Sequence[str], mappings: Sequence[str], trees: Sequence[str] | None = None, models: Sequence[str] | str = "LG+G") -> str:
    """A families file: a block per family; all lists must be as long as the names."""
    models = [models] * len(names) if isinstance(models, str) else models
    if any(len(x) != len(names) for x in (alignments, mappings, models, *([trees] if trees else []))):
        raise ValueError("families' lists differ in length")
    out = ["[FAMILIES]"]
    for i, n in enumerate(names):
        out += [f"- {n}", *([f"starting_gene_tree = {trees[i]}"] if trees else []), f"alignment = {alignments[i]}", f"mapping = {mappings[i]}", f"subst_model = {models[i]}"]
    return "\n".join(out) + "\n"
