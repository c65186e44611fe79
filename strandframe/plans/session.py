"""Session settings and the contracts that operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; existing settings of a running one stay."""
    builder = SparkSession.builder.appName("strandframe")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def require_columns(df: DataFrame, names: Sequence[str], what: str = "input") -> None:
    """Raise if df lacks one of the columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "input") -> None:
    """Raise if two rows share their keys; one small aggregate runs."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"{what} has repeated keys: {[tuple(r)[:-1] for r in twice]}")


def require_matches(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str = "input") -> None:
    """Raise if a row of left has no partner in right."""
    lost = left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti").limit(5).collect()
    if lost:
        raise ValueError(f"{what} has no match for {[tuple(r) for r in lost]}")


def checked(value: Column, ok: Column, message: str) -> Column:
    """value, or an error for the row in which ok doesn't hold."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def compare(value: Column, op: str, threshold) -> Column:
    """A threshold test with its operator named, since callers differ in what they do at equality."""
    tests = {"<": value < threshold, "<=": value <= threshold, ">": value > threshold, ">=": value >= threshold}
    if op not in tests:
        raise ValueError(f"unknown comparison {op!r}")
    return tests[op]


def rounded(c: Column, digits: int = 6) -> Column:
    """c rounded, with minus zero as zero."""
    return F.round(c, digits) + F.lit(0.0)


#: Input of more splits than this is left as it is: it would be too much to move.
SMALL_SPLITS = 8


def spread(scan: DataFrame) -> DataFrame:
    """A table's scan on all cores, where its files make far fewer splits than there are cores.

    A small table in one file would keep one core busy; a larger one has splits enough."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if splits <= min(SMALL_SPLITS, cores // 2) else scan
