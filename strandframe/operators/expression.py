"""Expression counts: normalisation, contrasts, fold changes and tests, all contrasts in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import student_t_two_sided


def merged_counts(counts: DataFrame, samples: list[str]) -> DataFrame:
    """Wide form: one row per gene, one column per sample."""
    return counts.groupBy("gene").pivot("sample", samples).agg(F.first("n"))


def reads_per_million(counts: DataFrame) -> DataFrame:
    """counts(gene, sample, n) with rpm: n over the sample's total in millions."""
    return counts.withColumn("rpm", F.try_divide(F.col("n") * 1e6, F.sum("n").over(Window.partitionBy("sample"))))


def contrast_values(counts: DataFrame, samples: DataFrame, contrasts: DataFrame) -> DataFrame:
    """(contrast, gene, side, rpm): up and reference samples of contrasts(id, variable, up, reference).

    samples is long: (sample, variable, value)."""
    sides = contrasts.select(F.col("id").alias("contrast"), "variable", F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("up").alias("value")), F.struct(F.lit("reference").alias("side"), F.col("reference").alias("value")))).alias("s")).select("contrast", "variable", "s.side", "s.value")
    chosen = sides.join(samples, ["variable", "value"]).select("contrast", "side", "sample")
    return reads_per_million(counts).join(F.broadcast(chosen), "sample").select("contrast", "gene", "side", "rpm")  # a row per sample and contrast


def log2_fold_change(up: Column, reference: Column, pseudo: Column) -> Column:
    return F.log2((up + pseudo) / (reference + pseudo))


def contrast_stats(values: DataFrame, fraction: float = 1e-4, with_p: bool = True) -> DataFrame:
    """(contrast, gene, up_mean, ref_mean, log2_fc, t, df, pval, neg_log10_p).

    The pseudocount is a fraction of the contrast's smallest mean above zero; t has equal variances."""
    side = lambda f, s: f(F.when(F.col("side") == s, F.col("rpm")))
    g = values.groupBy("contrast", "gene").agg(
        side(F.avg, "up").alias("up_mean"), side(F.avg, "reference").alias("ref_mean"), side(F.var_samp, "up").alias("_vu"), side(F.var_samp, "reference").alias("_vr"),
        side(F.count, "up").alias("_nu"), side(F.count, "reference").alias("_nr"),
    )
    w = Window.partitionBy("contrast")
    least = F.least(F.min(F.when(F.col("up_mean") > 0, F.col("up_mean"))).over(w), F.min(F.when(F.col("ref_mean") > 0, F.col("ref_mean"))).over(w))
    df = F.col("_nu") + F.col("_nr") - 2
    pooled = F.try_divide((F.col("_nu") - 1) * F.col("_vu") + (F.col("_nr") - 1) * F.col("_vr"), df)
    t = F.try_divide(F.col("up_mean") - F.col("ref_mean"), F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("_nu")) + F.try_divide(F.lit(1.0), F.col("_nr")))))
    g = g.withColumn("log2_fc", log2_fold_change(F.col("up_mean"), F.col("ref_mean"), least * fraction)).withColumn("t", t).withColumn("df", df)
    g = g.drop("_vu", "_vr", "_nu", "_nr")
    if not with_p:
        return g
    g = g.withColumn("pval", student_t_two_sided("t", F.col("df").cast("double")))
    return g.withColumn("neg_log10_p", F.when(F.col("pval") > 0, -F.log10("pval")).when(F.col("pval") == 0, F.lit(float("inf"))))


def regulation_class(p_cutoff: float = 0.05, fold_cutoff: float = 5.0) -> Column:
    """up, down or none; both cuts are strict."""
    sure = F.col("pval") < p_cutoff
    cut = F.log2(F.lit(float(fold_cutoff)))
    return F.when(sure & (F.col("log2_fc") > cut), "up").when(sure & (F.col("log2_fc") < -cut), "down").otherwise("none")


def significant_genes(stats: DataFrame, p_cutoff: float = 0.05, fold_cutoff: float = 5.0, annotation: DataFrame | None = None) -> DataFrame:
    x = stats.withColumn("regulation", regulation_class(p_cutoff, fold_cutoff)).filter("regulation <> 'none'")
    return x.join(annotation, "gene", "left") if annotation is not None else x


def hover_text(stats: DataFrame, annotation: DataFrame) -> DataFrame:
    x = stats.join(annotation, "gene", "left")
    return x.withColumn("text", F.concat_ws("<br>", "gene", F.coalesce("common_name", F.lit("")), F.coalesce("product", F.lit(""))))
