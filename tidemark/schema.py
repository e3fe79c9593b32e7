"""Fixed values of the event model: grades, categories, event types and column types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high")
CATEGORIES = ("video", "audio", "presentation", "switching", "progress", "continuity", "post_production")

#: type -> category. Fixed values.
EVENT_CATEGORY = {
    "blackout": "video",
    "freeze": "video",
    "clipping": "audio",
    "channel_missing": "audio",
    "channel_imbalance": "audio",
    "possible_audio_dropout": "audio",
    "slide_rollback_pattern": "presentation",
    "brief_unexpected_slide": "presentation",
    "progression_interruption": "progress",
    "possible_feedback_howling": "audio",
}

#: What a finding may have measured; a finding leaves out (null) what its type doesn't have.
MEASUREMENTS = {
    "duration": "double",
    "audio_active_during": "boolean",
    "max_peak_db": "double",
    "max_flat_factor": "double",
    "channel_rms_db": "map<int,double>",
    "sequence": "array<int>",
    "sequence_durations": "array<double>",
    "first_intervening_duration": "double",
    "confirmed_repeat": "boolean",
    "previous_state": "int",
    "next_state": "int",
    "dominant_frequency_hz": "double",
    "max_concentration": "double",
}
MEASUREMENTS_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in MEASUREMENTS.items()) + ">"

#: Findings as detectors give them; `variant` and `facts` choose and fill the texts.
FINDING = f"recording_id string, start double, end double, type string, severity string, confidence string, variant string, measurements {MEASUREMENTS_TYPE}, facts map<string,double>"


def severity_rank(severity: Column) -> Column:
    """low 0, medium 1, high 2; null for anything else."""
    return F.when(severity == "low", 0).when(severity == "medium", 1).when(severity == "high", 2)


def banded(duration: Column, high: float, medium: float | None = None) -> Column:
    """high from `high` seconds; medium from `medium` seconds, or always; low below that."""
    if medium is None:
        return F.when(duration >= high, "high").otherwise("medium")
    return F.when(duration >= high, "high").when(duration >= medium, "medium").otherwise("low")


def measurements(**known: Column) -> Column:
    """The measurements struct with the given fields; the rest is null."""
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in MEASUREMENTS.items()])


def facts(**known: Column) -> Column:
    if not known:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*[x for k, c in known.items() for x in (F.lit(k), c.cast("double"))])


def millis(seconds: Column) -> Column:
    """Seconds as whole milliseconds, for frames over time."""
    return F.round(seconds * 1000).cast("long")
