"""RNA secondary structures in dot-bracket form, and local alignment of primers."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package


def hairpin_pattern(least_loop: int = 3) -> str:
    return rf"\({{3,8}}\.{{{least_loop},}}\){{3,8}}"


def hairpins(folds: DataFrame, least_loop: int = 3) -> DataFrame:
    """(id, start, end, hairpin_structure, hairpin_seq): non-overlapping hairpins, from 0, ends included."""
    ship_package(folds.sparkSession)
    return _spans(folds, hairpin_pattern(least_loop), 0, "hairpin")


def loops(folds: DataFrame, least_loop: int = 3) -> DataFrame:
    """(id, start, end, loop_structure, loop_seq): the unpaired stretch inside three or more closed pairs."""
    ship_package(folds.sparkSession)
    return _spans(folds, rf"\({{3}}(\.{{{least_loop},}})\){{3}}", 1, "loop")


def _spans(folds: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    kind = dict(folds.dtypes)["id"]

    def run(batches):
        p = re.compile(pattern)
        for pdf in batches:
            out = []
            for i, seq, s in zip(pdf["id"], pdf["seq"], pdf["structure"]):
                for m in p.finditer(s or ""):
                    a, b = m.span(group)
                    out.append((i, a, b - 1, s[a:b], (seq or "")[a:b].upper()))
            yield pd.DataFrame(out, columns=["id", "start", "end", f"{name}_structure", f"{name}_seq"])

    return folds.select("id", "seq", "structure").mapInPandas(run, f"id {kind}, start int, end int, {name}_structure string, {name}_seq string")


def hairpin_values(structure, least_loop: int = 3) -> Column:
    """The hairpins' text alone, without Python."""
    return F.regexp_extract_all(F.col(structure) if isinstance(structure, str) else structure, F.lit(f"({hairpin_pattern(least_loop)})"), F.lit(1))


def smith_waterman(a: str, b: str, match: float = 2, mismatch: float = -1, gap_open: float = -2, gap_extend: float = -1) -> tuple[float, int, int]:
    """(score, start, end) of the best local alignment's stretch in b, from 0, end excluded; affine gaps."""
    n, m = len(a), len(b)
    h, e = np.zeros(m + 1), np.full(m + 1, -np.inf)
    at = np.arange(m + 1)
    hs = at.copy()
    es = at.copy()
    best = (0.0, 0, 0)
    letters = np.array(list(b)) if m else np.zeros(0, "U1")
    for i in range(n):
        ph, phs = h.copy(), hs.copy()
        opened = ph + gap_open
        longer = e + gap_extend
        es = np.where(opened >= longer, phs, es)
        e = np.maximum(opened, longer)
        h, hs = np.zeros(m + 1), at.copy()
        score = np.where(letters == a[i], match, mismatch)
        f, fs = -np.inf, 0
        for j in range(1, m + 1):
            f, fs = (h[j - 1] + gap_open, hs[j - 1]) if h[j - 1] + gap_open >= f + gap_extend else (f + gap_extend, fs)
            v, s = ph[j - 1] + score[j - 1], phs[j - 1]
            if e[j] > v:
                v, s = e[j], es[j]
            if f > v:
                v, s = f, fs
            if v > 0:
                h[j], hs[j] = v, s
                if v > best[0]:
                    best = (float(v), int(s), j)
    return best


def local_alignments(pairs: DataFrame) -> DataFrame:
    """pairs(id, primer, sequence) with score, start, end."""
    ship_package(pairs.sparkSession)
    kind = dict(pairs.dtypes)["id"]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(i, *smith_waterman(p.upper(), s.upper())) for i, p, s in zip(pdf["id"], pdf["primer"], pdf["sequence"])], columns=["id", "score", "start", "end"])

    return pairs.select("id", "primer", "sequence").mapInPandas(run, f"id {kind}, score double, start int, end int")
