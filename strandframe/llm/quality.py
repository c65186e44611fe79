"""Quality rules by weak supervision.

Rules vote good (1), bad (0) or abstain (null).  Expectation-maximisation over the histogram of vote
patterns estimates how often each rule that votes says bad on good texts and on each kind of bad ones; the
posterior that a text is good decides.  A kind of bad texts is a family of rules that fail together, so a bad vote
counts as far as the other votes bear it out, and one of a rule that also errs on good texts is outvoted.
The histogram has at most 3**len(rules()) rows whatever the corpus's size, so EM runs on the driver.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, documents, map_rows, written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_ends long, n_distinct long, n_upper long, n_letters long, n_stutter long, n_shouts long"
_SPACES = bytes([9, 10, 11, 12, 13, 32])
_KEEP_LEAD = bytes(b for b in range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _repeat_words(h: np.ndarray, owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document: words inside an 8-word window that stands twice or more in its document."""
    m = len(h) - WINDOW + 1
    out = np.zeros(n_docs, np.int64)
    if m <= 1:
        return out
    key = h[:m].copy()
    for k in range(1, WINDOW):
        key *= _MULT
        key ^= key >> np.uint64(29)
        key += h[k : k + m]
    key ^= owner[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = np.flatnonzero(owner[:m] == owner[WINDOW - 1 :])
    order = np.argsort(key[inside])
    at = inside[order]
    same = (key[at][1:] == key[at][:-1]) & (owner[at][1:] == owner[at][:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=n_docs).astype(np.int64)


def text_features(docs: DataFrame) -> DataFrame:
    """Counts per document, FEATURES.  An empty table gives no rows, repeated rows a row each.  A word is a run without ASCII white space; null and empty texts count nothing.

    Windows are compared by 64-bit hashes within one document.
    """

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = bytes_of(batch)
        n = len(texts)
        rows = np.zeros((n, 12), np.int64)
        words: list[bytes] = []
        sizes = np.zeros(n, np.int64)
        for i, b in enumerate(texts):
            w = b.split()
            sizes[i] = len(w)
            words += w
            solid = b.translate(None, _SPACES)
            chars = len(solid.translate(None, _KEEP_LEAD))
            symbols = len(solid) - len(solid.translate(None, SYMBOLS))
            lines = [x for x in b.split(b"\n") if x and not x.isspace()]
            ends = sum(x.rstrip()[-1:] in b".!?\"" for x in lines)
            upper = len(solid) - len(solid.translate(None, _UPPER))
            letters = len(solid) - len(solid.translate(None, _LETTERS))
            stutter = sum(map(eq, w, w[1:]))
            rows[i] = (len(w), chars, symbols, len(lines) - len(set(lines)), 0, len(lines), ends, len(set(w)), upper, letters, stutter, solid.count(b"!"))
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        rows[:, 4] = _repeat_words(h, np.repeat(np.arange(n), sizes), n)
        names = [f.split()[0] for f in FEATURES.split(", ")][1:]
        return {"doc_id": batch.column(0), **{name: rows[:, k] for k, name in enumerate(names)}}

    return map_rows(docs, ["doc_id", "text"], kernel, FEATURES)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules() -> dict[str, Column]:
    """Votes by name; null abstains.  Empty texts: every ratio is null, so only the length rule votes."""
    n = F.col("n_words")
    per_word = lambda c: F.try_divide(F.col(c), n)
    per_line = lambda c: F.try_divide(F.col(c), F.col("n_lines"))
    mean = per_word("word_chars")
    capitals = F.try_divide(F.col("n_upper"), F.col("n_letters"))
    return {
        "length": _vote(n >= 60, n < 40),
        "word_length": _vote((mean >= 3.5) & (mean <= 6.2), (mean < 3) | (mean > 7)),
        "symbols": _vote(per_word("n_symbols") <= 0.02, per_word("n_symbols") > 0.1),
        "dup_lines": _vote(per_line("n_dup_lines") == 0, per_line("n_dup_lines") > 0.25),
        "repeats": _vote(per_word("n_repeat_words") == 0, per_word("n_repeat_words") > 0.2),
        "stutter": _vote(per_word("n_stutter") <= 0.02, per_word("n_stutter") > 0.05),
        "capitals": _vote(capitals <= 0.05, capitals > 0.15),
        "shouts": _vote(per_word("n_shouts") <= 0.01, per_word("n_shouts") > 0.05),
        "line_ends": _vote(per_line("n_ends") >= 0.97, per_line("n_ends") < 0.93),
        "variety": F.when(n >= 20, _vote(per_word("n_distinct") >= 0.66, per_word("n_distinct") < 0.58)),
    }


#: Rules that look for one kind of bad text from different sides.
FAMILIES = (("symbols", "line_ends", "word_length"), ("dup_lines", "repeats", "stutter", "variety"), ("capitals", "shouts"))
#: How often a rule that votes says bad, at the start of EM: on texts of its family, on other bad texts and on
#: good ones.  Abstaining says nothing.
ON_FAULT, ON_OTHER, ON_GOOD = 0.6, 0.1, 0.05
#: The same, and the start's weight as a share of the texts, where every rule is a family of its own: votes then
#: don't bear each other out, and only the start tells a fault from a rule's error.
ALONE, ALONE_DRAW = (0.95, 0.05, 0.006), 0.02
PRIOR_GOOD = 0.85
#: The start's weight, as a number of texts: it decides where there are no texts and names the classes.
DRAW = 20.0


def start_rates(width: int, families: list[list[int]], fault: float = ON_FAULT, other: float = ON_OTHER, good: float = ON_GOOD) -> np.ndarray:
    """[rule, class, bad or good vote]; class 0 is good, class k + 1 holds texts of family k, of rule numbers."""
    bad = np.full((width, len(families) + 1), other)
    bad[:, 0] = good
    for k, own in enumerate(families):
        bad[own, k + 1] = fault
    return np.stack([bad, 1 - bad], axis=2)


def fit_accuracies(patterns: list[tuple[tuple, int]], width: int, families: list[list[int]] | None = None, rounds: int = 1000, prior_good: float = PRIOR_GOOD, draw: float = DRAW) -> dict:
    """MAP-EM over (votes, count) rows: P(class), and P(vote | class, the rule votes) of each rule.

    families: the rules of each kind of bad text; None: each rule has its own.  Rates and shares come from the
    counts but for `draw` pseudo-texts of the start; without patterns they are the start's.
    """
    if families is None:
        families = [[j] for j in range(width)]
        start, draw = start_rates(width, families, *ALONE), ALONE_DRAW * sum(k for _, k in patterns) + 1
    else:
        start = start_rates(width, families)
    share0 = np.array([prior_good] + [(1 - prior_good) / max(len(families), 1)] * len(families))
    rates, share = start, share0
    if patterns:
        v = np.array([[-1 if x is None else x for x in p] for p, _ in patterns])
        c = np.array([k for _, k in patterns], float)
        hot = np.stack([v == k for k in range(2)], axis=2).astype(float)
        for _ in range(rounds):
            log = np.einsum("pjk,jck->pc", hot, np.log(rates)) + np.log(share)
            post = np.exp(log - log.max(axis=1, keepdims=True))
            post = post / post.sum(axis=1, keepdims=True) * c[:, None]
            new = np.einsum("pc,pjk->jck", post, hot) + draw * start * share0[None, :, None]
            new /= new.sum(axis=2, keepdims=True)
            shares = (post.sum(axis=0) + draw * share0) / (c.sum() + draw)
            moved = max(np.abs(new - rates).max(), np.abs(shares - share).max())
            rates, share = new, shares
            if moved < 1e-9:
                break
    return {"share": share.tolist(), "rates": rates.tolist()}


def posterior(votes: list[Column], model: dict) -> Column:
    """P(good | votes) under the fitted model, as a column."""

    def weight(k: int) -> Column:
        z = F.lit(math.log(model["share"][k]))
        for vote, rate in zip(votes, model["rates"]):
            z = z + F.when(vote == 0, math.log(rate[k][0])).when(vote == 1, math.log(rate[k][1])).otherwise(0.0)
        return F.exp(z)

    good = weight(0)
    return good / sum((weight(k) for k in range(1, len(model["share"]))), good)


def weak_supervision(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Features, votes' posterior and verdict per document.

    An empty table gives no rows.  Repeated rows are scored alike.  Null text counts as no words.
    base_failed texts are never kept; the others are kept where the posterior reaches the threshold.
    """
    features = written(text_features(docs))
    named = rules()
    votes = features.select(*[v.alias(k) for k, v in named.items()])
    histogram = [(tuple(r)[:-1], r["count"]) for r in votes.groupBy(*named).count().collect()]
    number = {k: j for j, k in enumerate(named)}
    model = fit_accuracies(sorted(histogram, key=str), len(named), [[number[k] for k in f] for f in FAMILIES])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = features.select("*", *[v.alias(f"vote_{k}") for k, v in named.items()])
    p = posterior([F.col(f"vote_{k}") for k in named], model)
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p >= threshold)).alias("kept"), p.alias("quality"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, ..., base_failed, kept, quality) of every document, as weak_supervision() has them."""
    return weak_supervision(documents(spark, sf_dir))
