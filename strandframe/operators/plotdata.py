"""The data behind drawings: bins, classes, coordinates.  Nothing here draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overflow_histogram(df: DataFrame, value: str, end: int = 100) -> DataFrame:
    """(bin, n): unit bins from 0, values above `end` in one bin named '>end'."""
    b = F.when(F.col(value) > end, F.lit(f">{end}")).otherwise(F.floor(value).cast("string"))
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def arrow_polygon(start: Column, end: Column, strand: Column, height: float = 1.0, shift: float = 0.0, head: float = 0.15) -> Column:
    """array<struct<x,y>> of a gene arrow that points along its strand."""
    low, high = F.least(start, end), F.greatest(start, end)
    tip, tail = F.when(strand == "-", low).otherwise(high), F.when(strand == "-", high).otherwise(low)
    neck = tip + (tail - tip) * head
    p = lambda x, y: F.struct(x.cast("double").alias("x"), F.lit(float(y)).alias("y"))
    h = height / 2
    return F.array(p(tail, shift - h), p(neck, shift - h), p(tip, shift), p(neck, shift + h), p(tail, shift + h), p(tail, shift - h))


def backbone_gaps(genes: DataFrame) -> DataFrame:
    """(contig, gap_start, gap_end) between genes that don't touch."""
    w = Window.partitionBy("contig").orderBy("start", "end", "gene_id")
    x = genes.select("contig", F.col("end").alias("gap_start"), F.lead("start").over(w).alias("gap_end"))
    return x.filter("gap_end > gap_start")


def tree_segments(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(tree_id, node_id, x0, y0, x1, y1): a horizontal line per branch, from its parent's x."""
    own = nodes.select("tree_id", "node_id", "parent_id").join(at, ["tree_id", "node_id"])
    up = at.select("tree_id", F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return own.join(up, ["tree_id", "parent_id"]).select("tree_id", "node_id", F.col("px").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))


def leaf_bars(nodes: DataFrame, at: DataFrame, values: DataFrame) -> DataFrame:
    """(tree_id, name, value, y) of leaves with values(name, value)."""
    return nodes.filter("is_leaf").join(at, ["tree_id", "node_id"]).join(values, "name").select("tree_id", "name", "value", "y")


def baseline(bars: DataFrame, thickness: float = 0.5) -> DataFrame:
    return bars.groupBy("tree_id").agg((F.min("y") - thickness).alias("y0"), (F.max("y") + thickness).alias("y1"))


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default) -> DataFrame:
    """df with a looked-up value, or the default: node colours and sizes."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def kernel_density(df: DataFrame, value: str, by: str, bins: int = 512) -> DataFrame:
    """df with density: a Gaussian kernel over each group, by Scott's bandwidth.

    Values fall into `bins` equal bins of their group first, so the kernel sums bins, not pairs of rows."""
    w = Window.partitionBy(by)
    x = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    low, high = F.min(value).over(w), F.max(value).over(w)
    x = x.withColumn("_h", F.stddev_samp(value).over(w) * F.pow(F.count("*").over(w).cast("double"), F.lit(-0.2))).withColumn("_step", (high - low) / bins)
    x = x.withColumn("_bin", F.coalesce(F.floor(F.try_divide(F.col(value) - low, F.col("_step"))), F.lit(0)))
    counts = x.groupBy(by, "_bin").agg(F.count("*").alias("_n"), F.avg(value).alias("_at"))
    grid = counts.groupBy(by).agg(F.collect_list(F.struct("_n", "_at")).alias("_grid"), F.sum("_n").alias("_all"))
    y = x.join(grid, by)
    kernel = F.aggregate("_grid", F.lit(0.0), lambda acc, g: acc + g["_n"] * F.exp(-0.5 * F.pow((F.col(value) - g["_at"]) / F.col("_h"), F.lit(2))))
    return y.withColumn("density", F.try_divide(kernel, F.col("_all") * F.col("_h") * 2.5066282746310002)).select(*df.columns, "density")


def density_jitter(df: DataFrame, value: str, by: str, centre: float = 0.0, spread: float = 0.03, seed: int = 1) -> DataFrame:
    """df with x: normal jitter whose width follows the density at the value."""
    k = kernel_density(df, value, by)
    top = F.max("density").over(Window.partitionBy(by))
    return k.withColumn("x", F.lit(centre) + F.randn(seed) * spread * F.coalesce(F.try_divide(F.col("density"), top), F.lit(1.0)))


def gaussian_mixture(df: DataFrame, value: str, components: int, seed: int = 1) -> list[tuple[float, float, float]]:
    """(weight, mean, variance) of a one-dimensional mixture, ordered by mean."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=[value], outputCol="_v").transform(df.filter(F.col(value).isNotNull()))
    m = GaussianMixture(k=components, seed=seed, featuresCol="_v").fit(v)
    out = [(float(w), float(r["mean"][0]), float(r["cov"].toArray()[0][0])) for w, r in zip(m.weights, m.gaussiansDF.collect())]
    return sorted(out, key=lambda x: x[1])


def volcano_points(stats: DataFrame, p_cutoff: float = 0.05, fold_cutoff: float = 2.0) -> DataFrame:
    from .expression import regulation_class

    return stats.select("contrast", "gene", F.col("log2_fc").alias("x"), F.col("neg_log10_p").alias("y"), regulation_class(p_cutoff, fold_cutoff).alias("regulation"))


def cutoff_lines(p_cutoff: float, fold_cutoff: float) -> dict[str, float]:
    import math

    return {"y": -math.log10(p_cutoff), "x_up": math.log2(fold_cutoff), "x_down": -math.log2(fold_cutoff)}
