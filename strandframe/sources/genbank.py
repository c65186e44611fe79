"""GenBank flat files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from ..plans.schemas import GENBANK
from ..plans.shipping import ship_package

_NUMBER = re.compile(r"(\d+)")
_QUALIFIER = re.compile(r"^/([A-Za-z_0-9]+)(?:=(.*))?$", re.S)


def _place(location: str) -> tuple[int, int, int]:
    """(start from 0, end, strand) over all parts of a location."""
    numbers = [int(n) for n in _NUMBER.findall(re.sub(r"[A-Za-z_0-9.]+:", "", location))]
    return min(numbers) - 1, max(numbers), -1 if "complement" in location else 1


def _qualifiers(lines: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    text: list[str] = []
    for line in [*lines, "/"]:
        if line.startswith("/"):
            if text:
                m = _QUALIFIER.match(" ".join(text) if not text[0].startswith("/translation") else "".join(text))
                if m:
                    out.setdefault(m[1], []).append((m[2] or "").strip('"'))
            text = [line]
        else:
            text.append(line)
    return out


def records(text: str):
    """(contig, type, location, qualifiers) of every feature."""
    contig, feature, inside = None, None, False
    for line in text.splitlines():
        if line.startswith("LOCUS"):
            contig = line.split()[1]
        elif line.startswith("VERSION") and len(line.split()) > 1:
            contig = line.split()[1]
        elif line.startswith("FEATURES"):
            inside = True
        elif inside and line[:1] not in (" ", ""):
            if feature:
                yield contig, feature[0], feature[1], _qualifiers(feature[2])
            feature, inside = None, False
        elif inside and line[5:6].strip():
            if feature:
                yield contig, feature[0], feature[1], _qualifiers(feature[2])
            kind, _, location = line.strip().partition(" ")
            feature = [kind, location.strip(), []]
        elif inside and feature is not None:
            part = line.strip()
            if feature[2] or part.startswith("/"):
                feature[2].append(part)
            else:
                feature[1] += part
    if feature:
        yield contig, feature[0], feature[1], _qualifiers(feature[2])


def cds_features(texts: DataFrame) -> DataFrame:
    """CDS rows of texts(text); a CDS without locus_tag is an error."""
    ship_package(texts.sparkSession)
    names = [c.split()[0] for c in GENBANK.replace("map<string,array<string>>", "map").split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                for contig, kind, location, q in records(text):
                    if kind != "CDS":
                        continue
                    if "locus_tag" not in q:
                        raise ValueError(f"a CDS of {contig} has no locus_tag")
                    one = lambda k: q.get(k, [None])[0]  # noqa: B023, E731
                    out.append((contig, one("locus_tag"), one("gene"), one("protein_id"), one("product"), *_place(location), q))
            yield pd.DataFrame(out, columns=names)

    return texts.mapInPandas(run, GENBANK)
