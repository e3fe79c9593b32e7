"""Comparison of a source with its export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compared fields in their order. Fixed values.
FIELDS = ("resolution", "frame_rate", "codec_name", "pix_fmt", "bits_per_raw_sample", "color_space", "color_transfer", "bitrate", "duration")
#: A change in these is a change of format. Fixed values.
FORMAT_FIELDS = ("resolution", "bits_per_raw_sample", "pix_fmt")
#: Below these an export counts as degraded. Fixed values.
SSIM_LEAST, PSNR_LEAST_DB = 0.92, 35.0
CONCLUSIONS = ("source_degradation_already_present", "additional_downstream_degradation", "inconclusive")


def unpivot(df: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key..., ord, field, value): a row for each field, values as text."""
    entries = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for i, f in enumerate(fields)])
    return df.select(*key, F.inline(entries))


def diff_fields(source: DataFrame, export: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key..., ord, field, source_value, export_value, changed) of two tables with a row for each key. Null and null are equal, null and a value are not."""
    a = unpivot(source, key, fields).withColumnRenamed("value", "source_value")
    b = unpivot(export, key, fields).select(*key, "field", F.col("value").alias("export_value"))
    d = a.join(b, [*key, "field"])
    return d.withColumn("changed", ~F.col("source_value").eqNullSafe(F.col("export_value")))


def changed_fields(diff: DataFrame, key: list[str]) -> DataFrame:
    """(key..., changed_fields in field order, format_changed)."""
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct("ord", "field")))), lambda x: x["field"])
    d = diff.groupBy(*key).agg(names.alias("changed_fields"))
    return d.withColumn("format_changed", F.arrays_overlap("changed_fields", F.array(*[F.lit(f) for f in FORMAT_FIELDS])))


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """10 log10(peak² / mse); infinity where there is no error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


def frame_quality(pairs: DataFrame, key: list[str], peak: float = 255.0) -> DataFrame:
    """(key..., psnr_avg_db, psnr_min_db, ssim_avg) of pixel pairs (key..., frame, a, b).

    The average PSNR is that of the mean error over all frames, the least one that of the
    worst frame; SSIM is taken over each frame as one window and averaged (`pictures` has it by local windows).
    """
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    f = pairs.groupBy(*key, "frame").agg(F.avg((a - b) * (a - b)).alias("mse"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cov"), F.count(F.lit(1)).alias("n"))
    ssim = ((2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cov") + c2)) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + c1) * (F.col("va") + F.col("vb") + c2))
    return over_frames(f.withColumn("ssim", ssim), key, peak)


def over_frames(frames: DataFrame, key: list[str], peak: float = 255.0) -> DataFrame:
    """(key..., psnr_avg_db, psnr_min_db, ssim_avg) of (key..., mse, ssim, n) of each frame."""
    g = frames.groupBy(*key).agg((F.sum(F.col("mse") * F.col("n")) / F.sum("n")).alias("mse"), F.max("mse").alias("worst"), F.avg("ssim").alias("ssim_avg"))
    return g.select(*key, psnr(F.col("mse"), peak).alias("psnr_avg_db"), psnr(F.col("worst"), peak).alias("psnr_min_db"), "ssim_avg")


def conclusion(has_metrics: Column, ssim: Column, psnr_db: Column, ssim_least: float = SSIM_LEAST, psnr_least: float = PSNR_LEAST_DB, strict: bool = False) -> Column:
    """Which of CONCLUSIONS holds. Metrics that are all null count as not degraded, unless strict, which finds them inconclusive."""
    degraded = F.coalesce(ssim < ssim_least, F.lit(False)) | F.coalesce(psnr_db < psnr_least, F.lit(False))
    unknown = ~has_metrics | (F.lit(strict) & ssim.isNull() & psnr_db.isNull())
    return F.when(unknown, CONCLUSIONS[2]).when(degraded, CONCLUSIONS[1]).otherwise(CONCLUSIONS[0])
