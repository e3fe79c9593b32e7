"""Runs of consecutive rows, and the rows around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_runs(df: DataFrame, part: list[str], order: list[str], breaks: Column, out: str = "run") -> DataFrame:
    """df with the number of breaks up to each row: rows between two breaks share it.

    breaks may use lag(...) over (part, order) through `previous`. One sort serves both steps.
    """
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("__break", breaks).withColumn(out, F.sum(F.when(F.col("__break"), 1).otherwise(0)).over(w)).drop("__break")


def label_runs(df: DataFrame, part: list[str], order: list[str], label: Column, out: str = "run") -> DataFrame:
    """Rows with a label, which is kept as `label`, and the number of their maximal run of that label. Rows of a null label end runs and are dropped."""
    w = Window.partitionBy(*part).orderBy(*order)
    d = df.withColumn("label", label)
    d = number_runs(d, part, order, ~F.col("label").eqNullSafe(F.lag("label").over(w)), out)
    return d.where(F.col("label").isNotNull())


def gap_runs(df: DataFrame, part: list[str], time: str, value: str, max_gap: float, max_jump: float, out: str = "run") -> DataFrame:
    """Runs that break where time is more than max_gap after the row before, or value more than max_jump away from it."""
    w = Window.partitionBy(*part).orderBy(time)
    gap, jump = F.col(time) - F.lag(time).over(w), F.abs(F.col(value) - F.lag(value).over(w))
    return number_runs(df, part, [time], (gap > max_gap) | (jump > max_jump), out)


def quiet_runs(levels: DataFrame, quiet: float, active: float, context_ms: int, part: list[str] | None = None) -> DataFrame:
    """Maximal runs of rows at `quiet` or less, with what surrounds them.

    part..., start, end, first_level, n, before, after. before: there are rows that start within
    context_ms before the run, and all of them are above `active`; after: the same for the rows
    from the one after the run on, up to context_ms after its start. Levels that are NaN are
    neither quiet nor active.
    """
    part = part or ["recording_id"]
    number = ~F.isnan("rms_db")
    w = Window.partitionBy(*part).orderBy("start_ms")
    d = levels.withColumns({"__quiet": number & (F.col("rms_db") <= quiet), "__active": number & (F.col("rms_db") > active)})
    d = d.withColumns({
        "__before": F.bool_and("__active").over(w.rangeBetween(-context_ms, -1)),
        "__ahead": F.bool_and("__active").over(w.rangeBetween(0, context_ms - 1)),
    })
    d = d.withColumn("__after", F.lead("__ahead").over(w))
    d = label_runs(d, part, ["start_ms"], F.when(F.col("__quiet"), "quiet"))
    first, last = (lambda c: F.min_by(c, "start_ms")), (lambda c: F.max_by(c, "start_ms"))
    return d.groupBy(*part, "run").agg(
        F.min("start").alias("start"), last("end").alias("end"), first("rms_db").alias("first_level"), F.count(F.lit(1)).alias("n"),
        F.coalesce(first("__before"), F.lit(False)).alias("before"), F.coalesce(last("__after"), F.lit(False)).alias("after"),
    ).drop("run")


def dropouts(levels: DataFrame, quiet: float = -45.0, active: float = -35.0, least: float = 0.4, most: float = 6.0, context_ms: int = 2000, part: list[str] | None = None) -> DataFrame:
    """Quiet runs of `least` to `most` seconds between active rows on both sides."""
    runs = quiet_runs(levels, quiet, active, context_ms, part).withColumn("duration", F.col("end") - F.col("start"))
    return runs.where((F.col("duration") >= least) & (F.col("duration") <= most) & F.col("before") & F.col("after")).drop("before", "after")


def clipping_runs(levels: DataFrame, peak: float = -1.0, flat: float = 0.5, least: float = 0.2, part: list[str] | None = None) -> DataFrame:
    """Maximal runs of rows with peak_db and flat_factor at their thresholds or above, of `least` seconds or more."""
    part = part or ["recording_id"]
    hit = (F.col("peak_db") >= peak) & (F.col("flat_factor") >= flat) & ~F.isnan("peak_db") & ~F.isnan("flat_factor")
    runs = label_runs(levels, part, ["start_ms"], F.when(hit, "clip")).groupBy(*part, "run").agg(
        F.min("start").alias("start"), F.max_by("end", "start_ms").alias("end"), F.max("peak_db").alias("max_peak_db"), F.max("flat_factor").alias("max_flat_factor"), F.count(F.lit(1)).alias("n"),
    )
    runs = runs.withColumn("duration", F.col("end") - F.col("start"))
    return runs.where(F.col("duration") >= least).drop("run")


def channel_label(levels: Column, active: float = -40.0, missing: float = -55.0, gap: float = 12.0) -> Column:
    """`missing` where some channel is above active and another at missing or below, `imbalance` where the
    levels are at least gap apart and one is active, else null. Fewer than two channels: null."""
    values = F.map_values(levels)
    some = F.exists(values, lambda v: v > active)
    none = F.exists(values, lambda v: v <= missing)
    return F.when(F.size(values) < 2, None).when(some & none, "missing").when(some & (F.array_max(values) - F.array_min(values) >= gap), "imbalance")


def channel_runs(windows: DataFrame, active: float = -40.0, missing: float = -55.0, gap: float = 12.0, least: float = 1.0, part: list[str] | None = None) -> DataFrame:
    """Runs of one channel label of `least` seconds or more, with the levels of their last row."""
    part = part or ["recording_id"]
    runs = label_runs(windows, part, ["start_ms"], channel_label(F.col("channel_rms_db"), active, missing, gap)).groupBy(*part, "run", "label").agg(
        F.min("start").alias("start"), F.max_by("end", "start_ms").alias("end"), F.max_by("channel_rms_db", "start_ms").alias("channel_rms_db"), F.count(F.lit(1)).alias("n"),
    )
    runs = runs.withColumn("duration", F.col("end") - F.col("start"))
    return runs.where(F.col("duration") >= least).drop("run")


def peak_runs(windows: DataFrame, hop: float = 0.25, concentration: float = 0.45, rms: float = 0.02, jump: float = 80.0, least: float = 1.0, part: list[str] | None = None) -> DataFrame:
    """Runs of spectral windows with a concentrated peak whose frequency moves by `jump` at most from one to the next, without gaps over 1.5 hops."""
    part = part or ["recording_id"]
    d = windows.where((F.col("concentration") >= concentration) & (F.col("rms") >= rms) & ~F.isnan("concentration") & ~F.isnan("rms"))
    runs = gap_runs(d, part, "time", "dominant_freq", 1.5 * hop, jump).groupBy(*part, "run").agg(
        F.min("time").alias("start"), (F.max("time") + hop).alias("end"), F.avg("dominant_freq").alias("dominant_frequency_hz"), F.max("concentration").alias("max_concentration"), F.count(F.lit(1)).alias("n"),
    )
    runs = runs.withColumn("duration", F.col("end") - F.col("start"))
    return runs.where(F.col("duration") >= least).drop("run")
