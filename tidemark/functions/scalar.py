"""Scalar expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a level of minus infinity, or one that can't be read.
SILENT_DB = -120.0


def timestamp_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm of seconds, to the nearest millisecond, halves to even; hours are not capped."""
    ms = F.bround(seconds * 1000).cast("long")
    part = lambda n, m: F.pmod(F.floor(ms / n), F.lit(m))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), part(60_000, 60), part(1000, 60), F.pmod(ms, F.lit(1000)))


def slug(text: Column) -> Column:
    """Runs of anything but A-Z, a-z, 0-9, dot, underscore and dash become one underscore; none at the ends; empty: `recording`."""
    s = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.when(s == "", "recording").otherwise(s)


def unique_slugs(names: list[str]) -> list[str]:
    """Slugs of the names in order; one that is taken gets -2, -3 and so on until it is free."""
    import re

    out: list[str] = []
    taken: set[str] = set()
    for name in names:
        base = re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_") or "recording"
        free, n = base, 1
        while free in taken:
            n += 1
            free = f"{base}-{n}"
        taken.add(free)
        out.append(free)
    return out


def decibels(text: Column) -> Column:
    """A level as text: minus infinity, and what is no number, count as SILENT_DB."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("-inf", "-infinity"), SILENT_DB).otherwise(F.coalesce(t.try_cast("double"), F.lit(SILENT_DB)))


def frame_rate(average: Column, real: Column) -> Column:
    """The average rate, or the real one where that is missing or empty, as a fraction n/d; null where d is 0."""
    rate = F.when(F.coalesce(average, F.lit("")) != "", average).otherwise(real)
    n, d = F.split(rate, "/")[0].try_cast("double"), F.coalesce(F.try_element_at(F.split(rate, "/"), F.lit(2)), F.lit("1")).try_cast("double")
    return F.try_divide(n, F.nullif(d, F.lit(0.0)))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.try_divide(width.cast("double"), F.nullif(height.cast("double"), F.lit(0.0)))


def level_db(mean_square: Column, silent: float = SILENT_DB) -> Column:
    """RMS level in dB of a mean square; `silent` for 0."""
    return F.coalesce(10 * F.log10(F.nullif(mean_square, F.lit(0.0))), F.lit(silent))


def event_id(*parts: Column) -> Column:
    """12 hex digits that depend on the parts alone."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)
