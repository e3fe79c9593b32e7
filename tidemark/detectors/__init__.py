"""Detectors: each turns a recording's signals into findings.

A detector is any object with `name`, `tier`, `requires` and find(signals) -> DataFrame of
tidemark.schema.FINDING; skipped(signals), where it has one, gives (recording_id, reason) rows.
"""

from .audio import ChannelImbalance, Clipping, Dropout, Feedback
from .base import Detector
from .progress import ProgressionInterruption
from .slides import BriefSlide, SlideRollback
from .video import Blackout, Freeze

__all__ = ["Blackout", "BriefSlide", "ChannelImbalance", "Clipping", "Detector", "Dropout", "Feedback", "Freeze", "ProgressionInterruption", "SlideRollback"]
