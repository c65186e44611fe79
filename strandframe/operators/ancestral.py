"""Ancestral states: site tables with posterior columns, joined with the gaps of a node's clade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alignment import cells


def best_probability(states: DataFrame) -> Column:
    return F.greatest(*[F.col(c) for c in states.columns if c.startswith("p_")])


def masked_states(states: DataFrame, threshold: float) -> DataFrame:
    """(Node, Site, State): X where the best posterior isn't above the threshold."""
    return states.select("Node", "Site", F.when(best_probability(states) > threshold, F.col("State")).otherwise("X").alias("State"))


def node_sequences(states: DataFrame, nodes: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """(Node, seq): states in the order of sites, masked if there is a threshold."""
    x = masked_states(states, threshold) if threshold is not None else states.select("Node", "Site", "State")
    x = x.filter(F.col("Node").isin(nodes)) if nodes else x
    ordered = F.array_sort(F.collect_list(F.struct("Site", "State")))
    return x.groupBy("Node").agg(F.array_join(F.transform(ordered, lambda s: s["State"]), "").alias("seq"))


def gapped_sequence(states: DataFrame, node: str, clade: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(Node, seq): a node's states with '-' at sites where its clade's alignments(aln_id, seq_id, seq) have as many gaps.

    Sites count from 1; a site the table lacks takes the state of the one before, or else after."""
    gaps = cells(clade).groupBy((F.col("pos") + 1).alias("Site")).agg(F.avg((F.col("ch") == "-").cast("double")).alias("gap"))
    own = states.filter(F.col("Node") == node).select("Site", "State")
    near = lambda d: own.select((F.col("Site") + d).alias("Site"), F.col("State").alias(f"near{d + 1}"))
    x = gaps.join(own, "Site", "left").join(near(1), "Site", "left").join(near(-1), "Site", "left")
    x = x.select(F.lit(node).alias("Node"), "Site", F.when(F.col("gap") >= threshold, F.lit("-")).otherwise(F.coalesce("State", "near2", "near0")).alias("State"))
    return node_sequences(x)


def clade_with_ancestor(states: DataFrame, node: str, alignment: DataFrame, leaves: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(seq_id, seq): rows of the leaves(name) below a node, and its own masked sequence."""
    own = alignment.join(leaves.select(F.col("name").alias("seq_id")), "seq_id", "left_semi").select("seq_id", "seq")
    return own.unionByName(node_sequences(states, [node], threshold).select(F.col("Node").alias("seq_id"), "seq"))


def relabelled(alignment: DataFrame, clades: DataFrame) -> DataFrame:
    """Sequences named <clade>_<running number> by clades(seq_id, clade); others keep their names."""
    from pyspark.sql import Window

    x = alignment.join(clades, "seq_id", "left")
    n = F.row_number().over(Window.partitionBy("clade").orderBy("seq_id"))
    return x.withColumn("seq_id", F.when(F.col("clade").isNotNull(), F.concat_ws("_", "clade", n.cast("string"))).otherwise(F.col("seq_id"))).drop("clade")


def logo_panels(states: DataFrame, node: str, threshold: float, panels: int = 1) -> DataFrame:
    """(panel, Site, symbol, p): a node's posteriors in long form, those not above the threshold as 0."""
    from pyspark.sql import Window

    ps = [c for c in states.columns if c.startswith("p_")]
    x = states.filter(F.col("Node") == node).withColumn("panel", F.ntile(panels).over(Window.orderBy("Site")))
    long = x.select("panel", "Site", F.explode(F.array(*[F.struct(F.lit(c[2:]).alias("symbol"), F.col(c).alias("p")) for c in ps])).alias("s"))
    return long.select("panel", "Site", "s.symbol", F.when(F.col("s.p") > threshold, F.col("s.p")).otherwise(0.0).alias("p"))
