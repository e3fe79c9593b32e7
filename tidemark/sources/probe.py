"""Recordings from probe documents (JSON with `format` and `streams`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import aspect_ratio, frame_rate

_DOCUMENT = "format map<string,string>, streams array<map<string,string>>"


def recordings(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """A row for each (recording_id, path, json): what the rest of the engine asks of a recording.

    A document that can't be read has error set and neither video nor audio. A duration that
    is missing or no number is 0.0, such a bit rate null. Video details are those of the first
    video stream, channels those of the first audio stream (0 without).
    """
    d = documents.withColumn("__p", F.from_json(json_col, _DOCUMENT))
    bad = F.col("__p").isNull() | (F.col("__p.format").isNull() & F.col("__p.streams").isNull())
    kind = lambda k: F.filter(F.coalesce("__p.streams", F.expr("cast(array() AS array<map<string,string>>)")), lambda s: s["codec_type"] == k)
    d = d.withColumns({"video_streams": kind("video"), "audio_streams": kind("audio")})
    v, a = F.try_element_at("video_streams", F.lit(1)), F.try_element_at("audio_streams", F.lit(1))
    d = d.withColumns({"__v": v, "__a": a})
    d = d.withColumns({
        "error": F.when(bad, F.lit("probe output can't be read")),
        "duration": F.coalesce(F.col("__p.format")["duration"].try_cast("double"), F.lit(0.0)),
        "format_name": F.coalesce(F.col("__p.format")["format_name"], F.lit("")),
        "bitrate": F.col("__p.format")["bit_rate"].try_cast("bigint"),
        "has_video": F.size("video_streams") > 0,
        "has_audio": F.size("audio_streams") > 0,
        "width": F.col("__v")["width"].try_cast("int"),
        "height": F.col("__v")["height"].try_cast("int"),
        "channels": F.coalesce(F.col("__a")["channels"].try_cast("int"), F.lit(0)),
        "frame_rate": frame_rate(F.col("__v")["avg_frame_rate"], F.col("__v")["r_frame_rate"]),
        **{f: F.col("__v")[f] for f in ("codec_name", "pix_fmt", "bits_per_raw_sample", "color_space", "color_transfer")},
    })
    d = d.withColumns({"resolution": F.when(F.col("width").isNotNull() & F.col("height").isNotNull(), F.concat_ws("x", "width", "height")), "aspect": aspect_ratio(F.col("width"), F.col("height"))})
    return d.drop("__p", "__v", "__a", json_col)
