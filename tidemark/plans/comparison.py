"""Comparison of a source recording with its export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q

#: What a comparison says. Fixed values.
REASONS = {
    "spec": "A format change was observed (resolution/bit-depth/chroma), and a delivery specification was supplied -- checking whether it matches.",
    "no_spec": "A format change was observed (resolution/bit-depth/chroma), but no delivery specification was supplied, so it is not possible to say whether this conversion was expected.",
    "no_metrics": "Insufficient evidence to classify: no objective quality comparison was available.",
    "same": "Objective metrics do not show a material quality difference between source and export at the compared resolution.",
    "worse": "Objective metrics show a material quality difference between source and export beyond what the resolution/format change alone would explain.",
}
LIMITS = {
    "no_spec": "No delivery specification was provided; format changes are reported as observations only, not as errors.",
    "no_metrics": "Objective quality metrics (SSIM/PSNR) were not computed (missing video stream or metrics disabled).",
    "aligned": "SSIM/PSNR were computed on the first {}s of each file with no explicit content alignment beyond matching start times; if source and export do not start at the same point in the event, this comparison is not meaningful.",
    "unaligned": "No explicit content alignment was performed beyond matching start times.",
    "who": "This does not identify which specific tool, operator, or export step introduced any observed degradation.",
}


@dataclass
class Comparison:
    max_seconds: float | None = 60.0
    spec: dict | None = None
    strict: bool = False


def pixel_pairs(source: DataFrame, export: DataFrame, key: list[str], settings: Comparison) -> DataFrame:
    """(key..., frame, a, b): pixels of the export and the source at equal frame and place, of the first seconds.

    Both have key..., frame, time, pixel, value at one resolution, the smaller of the two.
    """
    cut = (lambda d: d) if not settings.max_seconds else (lambda d: d.where(F.col("time") < settings.max_seconds))
    a = cut(export).select(*key, "frame", "pixel", F.col("value").alias("a"))
    b = cut(source).select(*key, "frame", "pixel", F.col("value").alias("b"))
    return a.join(b, [*key, "frame", "pixel"])


def compare(pairs: DataFrame, metrics: DataFrame | None, settings: Comparison = Comparison()) -> DataFrame:
    """A row for each pair: pair_id, source_path, export_path, changed_fields, format_changed, ssim_avg, psnr_avg_db, psnr_min_db, conclusion, reasoning, limitations.

    pairs: (pair_id, source, export) with structs of what sources.probe gives. metrics:
    (pair_id, ssim_avg, psnr_avg_db, psnr_min_db, resolution), a row for each pair that was measured.
    """
    fields = list(q.FIELDS)
    side = lambda s: pairs.select("pair_id", *[(F.bround(F.col(s)["duration"], 3) if f == "duration" else F.col(s)[f]).alias(f) for f in fields])
    diff = q.changed_fields(q.diff_fields(side("source"), side("export"), ["pair_id"], fields), ["pair_id"])
    d = pairs.select("pair_id", F.col("source")["path"].alias("source_path"), F.col("export")["path"].alias("export_path")).join(diff, "pair_id")
    if metrics is None:
        d = d.withColumns({"ssim_avg": F.lit(None).cast("double"), "psnr_avg_db": F.lit(None).cast("double"), "psnr_min_db": F.lit(None).cast("double"), "resolution": F.lit(None).cast("string"), "measured": F.lit(False)})
    else:
        d = d.join(metrics.withColumn("measured", F.lit(True)), "pair_id", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    d = d.withColumn("conclusion", q.conclusion(F.col("measured"), F.col("ssim_avg"), F.col("psnr_avg_db"), strict=settings.strict))
    has, changed, spec = F.col("measured"), F.col("format_changed"), bool(settings.spec)

    def said(*entries: tuple[Column, Column]) -> Column:
        return F.filter(F.array(*[F.when(when, text) for when, text in entries]), lambda x: x.isNotNull())

    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    worse = F.col("conclusion") == q.CONCLUSIONS[1]
    reasoning = said(
        (changed, F.lit(REASONS["spec" if spec else "no_spec"])),
        (~has, F.lit(REASONS["no_metrics"])),
        (has, F.concat(F.lit("SSIM (export vs. source, compared at "), F.coalesce("resolution", F.lit("0x0")), F.lit("): "), number("ssim_avg"), F.lit("."))),
        (has, F.concat(F.lit("PSNR average: "), number("psnr_avg_db"), F.lit(" dB, minimum: "), number("psnr_min_db"), F.lit(" dB."))),
        (has, F.when(worse, REASONS["worse"]).otherwise(REASONS["same"])),
    )
    aligned = LIMITS["aligned"].format(settings.max_seconds) if settings.max_seconds else LIMITS["unaligned"]
    limitations = said((changed & F.lit(not spec), F.lit(LIMITS["no_spec"])), (~has, F.lit(LIMITS["no_metrics"])), (has, F.lit(aligned)), (has, F.lit(LIMITS["who"])))
    return d.withColumns({"reasoning": reasoning, "limitations": limitations}).drop("measured", "resolution")


def as_json(compared: DataFrame) -> DataFrame:
    """(pair_id, json): each comparison as a document."""
    quality = F.when(F.col("ssim_avg").isNotNull() | F.col("psnr_avg_db").isNotNull(), F.struct("ssim_avg", "psnr_avg_db", "psnr_min_db"))
    return compared.select("pair_id", F.to_json(F.struct("source_path", "export_path", F.struct("changed_fields").alias("metadata_diff"), quality.alias("quality"), "conclusion", "reasoning", "limitations")).alias("json"))
