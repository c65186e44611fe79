"""Secret scan with multipart credential linking.

Strong spans (assignments, access ids, long hex) are reported wherever they stand.  Weak candidates
(user names, short or unusual secrets, endpoints) are reported only when complementary parts meet in
one scope: an interval join of the parts' scopes inside each document.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_rows, texts_of

# The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

# Weak parts, group 1 is the span.  Names may have a prefix that ends in an underscore.
WEAK_NAMES = r"(?:pass|pwd|passphrase|credentials?|auth|bearer|private_?key|signing_?key|password|passwd|secret|token|api_?key)"
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?(?:key_?)?id)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9][A-Za-z0-9@._+-]{2,})""", re.IGNORECASE | re.ASCII)
WEAK_SECRET = re.compile(rf"""(?<![A-Za-z0-9]){WEAK_NAMES}["']?[ \t]*[:=][ \t]*["']?([^\s"'<>,;]{{4,}})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""(\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{3,})|(?<![A-Za-z0-9])(?:host|hostname|server|endpoint|url)["']?[ \t]*[:=][ \t]*["']?([A-Za-z0-9][A-Za-z0-9._:/-]{2,})""", re.IGNORECASE | re.ASCII)

KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: A linear-time test for texts in which any strong pattern or a weak secret's cue can stand at all.
CUE = rf"""(?i:{WEAK_NAMES})["']?[ \t]*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}"""
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans; an assignment whose value is shorter than 8 is consumed but dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _scope(text: str, start: int, end: int, reach: int) -> tuple[int, int]:
    """The interval in which a part's complements may stand: reach code points, cut at blank lines."""
    low, high = max(0, start - reach), min(len(text), end + reach)
    cut = text.rfind("\n\n", low, start)
    stop = text.find("\n\n", end, high)
    return (low if cut < 0 else cut + 2), (high if stop < 0 else stop)


class _Parts:
    """Spans by start, each with the furthest end up to it, so a meeting is found in one search."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def meet(self, scope: tuple[int, int]) -> bool:
        """Whether a part overlaps the scope."""
        j = bisect_left(self.starts, scope[1])
        return j > 0 and self.ends[j - 1] > scope[0]


def linked_spans(text: str, strong: list[tuple[int, int, int]], reach: int = 200) -> list[tuple[int, int, int]]:
    """Weak candidates whose complementary part overlaps their scope.

    secret needs an identifier or an endpoint; identifier and endpoint need a secret, strong or weak.
    Strong access ids count as identifiers, strong assignments and hex as secrets.  A weak span that
    overlaps a strong one is part of it and is not reported.
    """
    taken = _Parts([(s, e) for s, _, e in strong])
    weak: dict[int, list[tuple[int, int]]] = {}
    for kind, pattern in ((3, IDENTIFIER), (4, WEAK_SECRET), (5, ENDPOINT)):
        found = []
        for m in pattern.finditer(text):
            s, e = m.span(1) if m.group(1) is not None else m.span(2)
            if not taken.meet((s, e)):
                found.append((s, e))
        weak[kind] = found
    index = {
        "secret": _Parts(weak[4] + [(s, e) for s, k, e in strong if k != 1]),
        "other": _Parts(weak[3] + weak[5] + [(s, e) for s, k, e in strong if k == 1]),
    }
    out = []
    for kind, need in ((3, "secret"), (4, "other"), (5, "secret")):
        if index[need].starts:
            out += [(s, kind, e) for s, e in weak[kind] if index[need].meet(_scope(text, s, e, reach))]
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """One row per document with its strong spans' counts and digest and all spans.

    Null and empty texts have no spans.  Repeated rows each get their row.  Other columns are ignored.
    One pass, no shuffle: a document's parts and their join stay in the row's task.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        n = batch.num_rows
        may = pc.fill_null(pc.match_substring_regex(batch.column(1), CUE), False).to_pylist()
        counts = [[0] * n for _ in range(4)]
        digest, spans = [EMPTY] * n, [""] * n
        for i, hit in enumerate(may):
            if not hit:
                continue
            text = batch.column(1)[i].as_py()
            strong = base_spans(text)
            more = linked_spans(text, strong, reach)
            for _, k, _ in strong:
                counts[k][i] += 1
            counts[3][i] = len(more)
            digest[i] = hashlib.sha256(_joined(strong).encode()).hexdigest()
            spans[i] = _joined(sorted(strong + more))
        return {"doc_id": batch.column(0), "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "n_linked": counts[3], "base_sha256": digest, "spans": spans}

    return map_rows(docs, ["doc_id", "text"], kernel, SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCHEMA of every document, as scan_secrets() has it."""
    return scan_secrets(documents(spark, sf_dir))
