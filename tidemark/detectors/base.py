"""What a detector is, and the signals that it reads."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spectral, states
from ..storage import written


class Detector(Protocol):
    name: str
    tier: int
    requires: str

    def find(self, signals: Signals) -> DataFrame: ...


#: Tables that may be given, with their types; those that aren't are empty.
TABLES = {
    "recordings": "recording_id string, path string, duration double, has_video boolean, has_audio boolean, width int, height int, channels int, frame_rate double, error string",
    "level_windows": "recording_id string, idx int, start_ms bigint, start double, end double, rms_db double, peak_db double, flat_factor double",
    "channel_windows": "recording_id string, idx int, start_ms bigint, start double, end double, channel_rms_db map<int,double>",
    "frame_samples": "recording_id string, idx int, time_ms bigint, time double, hash array<bigint>, bucket int",
    "measured_segments": "recording_id string, kind string, start double, end double, duration double",
    "pcm_blocks": "recording_id string, block int, sample_rate int, samples array<smallint>",
    "spectral_windows": "recording_id string, time double, dominant_freq double, concentration double, rms double",
}


@dataclass
class Signals:
    """The tables of any number of recordings, and what follows from them, made once and only when asked for."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    _states: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        got = self.tables.get(name)
        if got is None and name == "spectral_windows" and "pcm_blocks" in self.tables:
            return spectral.spectral_windows(self.tables["pcm_blocks"])
        return self.spark.createDataFrame([], TABLES[name]) if got is None else got

    def of(self, table: str, *needs: str) -> DataFrame:
        """Rows of the table of recordings for which all `needs` (flags of recordings) hold."""
        return self.only(getattr(self, table), *needs)

    def only(self, rows: DataFrame, *needs: str) -> DataFrame:
        """Those of the rows whose recordings have all `needs`. Asked of what a detector found rather than of what it reads, it sorts few rows."""
        keep = self.recordings
        for n in needs:
            keep = keep.where(F.col(n))
        return rows.join(keep.select("recording_id"), "recording_id", "left_semi")

    @cached_property
    def visual_activity(self) -> DataFrame:
        return states.visual_activity(self.of("frame_samples", "has_video"))

    def slide_states(self, stable: int = states.STABLE, match: int = states.MATCH) -> DataFrame:
        """States of every recording; written once for all detectors that ask for these thresholds."""
        if (stable, match) not in self._states:
            made = states.online_states(states.anchor_segments(self.of("frame_samples", "has_video"), stable), match)
            self._states[stable, match] = written(made)
        return self._states[stable, match]

    def release(self) -> None:
        """Forgets what was made; written tables go with the session's checkpoints."""
        self._states.clear()
