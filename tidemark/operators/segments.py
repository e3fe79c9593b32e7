"""Anchor segments of long recordings, found by stretches of time at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .states import _SEGMENT, STABLE, _distances

#: Seconds of a chunk: what a task holds of a recording (two frames a second: 65,536 frames, 9 MB).
SECONDS = 32768.0

_PACKED = "recording_id string, chunk long, n int, t0 double, t1 double, last double, times binary, words binary, buckets binary, starts binary"
_ANCHOR = "anchor_chunk long, anchor_at int, anchor_words array<bigint>, anchor_bucket long"
_RESULT = "recording_id string, chunk long, in_chunk long, in_at int, " + _ANCHOR
_PIECE = "recording_id string, anchor_chunk long, anchor_at int, start double, n long, most int, end double, hash array<bigint>, bucket int"


@dataclass
class _Frames:
    """The frames of a chunk in order of time, and where segments start if its first frame is an anchor."""

    times: np.ndarray
    words: np.ndarray
    buckets: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, row) -> _Frames:
        n = int(row["n"])
        return cls(np.frombuffer(row["times"], np.float64), np.frombuffer(row["words"], np.int64).reshape(n, -1), np.frombuffer(row["buckets"], np.int64), np.frombuffer(row["starts"], np.int64))

    def until(self, at: int, words: np.ndarray, bucket: int, threshold: int) -> tuple[int, int]:
        """(first frame from `at` on that is far from the anchor, largest distance of those before it)."""
        most, block = 0, 64
        while at < len(self.times):
            d = _distances(self.words[at : at + block], self.buckets[at : at + block], words, bucket)
            far = np.flatnonzero(d > threshold)
            n = int(far[0]) if len(far) else len(d)
            most, at = max(most, int(d[:n].max(initial=0))), at + n
            if len(far):
                break
            block = min(4096, block * 2)
        return at, most

    def follow(self, at: int, threshold: int) -> list[int]:
        """Where segments start from an anchor at `at` on: those of its own until one is a known start, whose followers are known."""
        out = []
        while at < len(self.times):
            known = int(np.searchsorted(self.starts, at))
            if known < len(self.starts) and self.starts[known] == at:
                return out + self.starts[known:].tolist()
            out.append(at)
            at, _ = self.until(at + 1, self.words[at], self.buckets[at], threshold)
        return out


def _packed(frames: DataFrame, threshold: int, seconds: float) -> DataFrame:
    """A row for each chunk of frames, with the segments that it has if its first frame is an anchor."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time", kind="stable")
        f = _Frames(part["time"].to_numpy(float), np.stack(part["hash"].to_numpy()).astype(np.int64), part["bucket"].to_numpy(np.int64), np.empty(0, np.int64))
        starts = np.array(f.follow(0, threshold), np.int64)
        second = f.times[1] if len(f.times) > 1 else None
        row = [part["recording_id"].iloc[0], part["chunk"].iloc[0], len(f.times), f.times[0], second, f.times[-1], f.times.tobytes(), f.words.tobytes(), f.buckets.tobytes(), starts.tobytes()]
        return pd.DataFrame([row], columns=[c.split()[0] for c in _PACKED.split(", ")])

    d = frames.select(F.col("recording_id").cast("string"), F.col("time").cast("double"), "hash", F.col("bucket").cast("int").alias("bucket")).where("hash IS NOT NULL")
    return written(d.withColumn("chunk", F.floor(F.col("time") / seconds)).groupBy("recording_id", "chunk").applyInPandas(pack, _PACKED))


def _left_over(packed: DataFrame, asked: DataFrame, threshold: int) -> DataFrame:
    """For chunks and the anchors that reach into them, the anchor that each chunk leaves to the next one."""

    def run(parts):
        for part in parts:
            out = []
            for _, row in part.iterrows():
                f = _Frames.of(row)
                if pd.isna(row["in_chunk"]):
                    at, key = 0, (None, None)
                else:
                    key = (int(row["in_chunk"]), int(row["in_at"]))
                    at, _ = f.until(0, np.array(row["in_words"], np.int64), int(row["in_bucket"]), threshold)
                left = (*key, row["in_words"], row["in_bucket"])
                if at < len(f.times):
                    last = f.follow(at, threshold)[-1]
                    left = (int(row["chunk"]), last, f.words[last], int(f.buckets[last]))
                out.append((row["recording_id"], int(row["chunk"]), *key, *left))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])
            yield frame.astype({"in_chunk": "Int64", "in_at": "Int32", "anchor_chunk": "Int64", "anchor_at": "Int32"})

    return packed.join(asked, ["recording_id", "chunk"]).mapInPandas(run, _RESULT)


def _walk(results: DataFrame) -> DataFrame:
    """(recording_id, chunk, in_chunk, in_at, known): which anchor reaches into each chunk, as far as results tell.

    The last row of a recording is not known if its anchor has not been followed through that chunk.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        none = (-1, -1)
        key = lambda a, b: none if pd.isna(a) else (int(a), int(b))
        seen = {(int(c), *key(a, b)): key(x, y) for c, a, b, x, y in zip(part["chunk"], part["in_chunk"], part["in_at"], part["anchor_chunk"], part["anchor_at"], strict=True)}
        out, at = [], none
        for c in sorted({int(c) for c in part["chunk"]}):
            known = (c, *at) in seen
            out.append((part["recording_id"].iloc[0], c, *at, known))
            if not known:
                break
            at = seen[(c, *at)]
        return pd.DataFrame(out, columns=["recording_id", "chunk", "in_chunk", "in_at", "known"])

    narrow = results.select("recording_id", "chunk", "in_chunk", "in_at", "anchor_chunk", "anchor_at")
    return narrow.groupBy("recording_id").applyInPandas(run, "recording_id string, chunk long, in_chunk long, in_at int, known boolean")


def _with_anchor(asked: DataFrame, results: DataFrame) -> DataFrame:
    """asked (recording_id, chunk, in_chunk, in_at) with what the anchor shows."""
    anchors = results.where("anchor_chunk IS NOT NULL").select("recording_id", F.col("anchor_chunk").alias("in_chunk"), F.col("anchor_at").alias("in_at"), F.col("anchor_words").alias("in_words"), F.col("anchor_bucket").alias("in_bucket"))
    return asked.join(anchors.dropDuplicates(["recording_id", "in_chunk", "in_at"]), ["recording_id", "in_chunk", "in_at"], "left")


def chunked_segments(frames: DataFrame, threshold: int = STABLE, step: float | None = None, seconds: float = SECONDS) -> DataFrame:
    """The rows of `states.anchor_segments`, for recordings of any length: no task holds more than `seconds` of one.

    Chunks of time are segmented at once, each as if its first frame were an anchor. The anchor that
    really reaches into a chunk is then followed through it until a segment starts where the chunk's own
    segmentation has a start; from there on both are the same. Most chunks need one such step, all of
    them in one job. Where one segment covers several chunks, its anchor is tried on twice as many
    following chunks in each further round, so rounds grow with the logarithm of the longest
    segment. What is put in order by recording is one row a chunk, and pieces of segments.

    Frames without a hash are left out; of equal times, in one chunk, the order is that of the input. Times must not be null.
    """
    packed = _packed(frames, threshold, seconds)
    narrow = packed.select("recording_id", "chunk")
    order = Window.partitionBy("recording_id").orderBy("chunk")
    nothing = narrow.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("in_chunk", "long"), ("in_at", "int"), ("in_words", "array<bigint>"), ("in_bucket", "long"))])
    alone = written(_left_over(packed, nothing, threshold))
    # each chunk once more with what the chunk before leaves if it began anew
    before = lambda c: F.lag(f"anchor_{c}").over(order).alias(f"in_{c}")
    guessed = alone.select("recording_id", "chunk", *[before(c) for c in ("chunk", "at", "words", "bucket")]).where("in_chunk IS NOT NULL")
    results, reach = alone.unionByName(written(_left_over(packed, guessed, threshold))), 1
    while True:
        walked = written(_walk(results))
        open_ends = walked.where("NOT known")
        if not open_ends.limit(1).count():
            break
        reach *= 2
        numbered = narrow.withColumn("place", F.row_number().over(order))
        begin = open_ends.join(numbered, ["recording_id", "chunk"]).select("recording_id", "in_chunk", "in_at", F.col("place").alias("from_place"))
        wanted = numbered.join(begin, "recording_id").where((F.col("place") >= F.col("from_place")) & (F.col("place") < F.col("from_place") + reach))
        wanted = wanted.select("recording_id", "chunk", "in_chunk", "in_at").join(results.select("recording_id", "chunk", "in_chunk", "in_at"), ["recording_id", "chunk", "in_chunk", "in_at"], "left_anti")
        results = results.unionByName(written(_left_over(packed, _with_anchor(wanted, results), threshold)))
    true = walked.select("recording_id", "chunk", F.expr("nullif(in_chunk, -1)").alias("in_chunk"), F.expr("nullif(in_at, -1)").alias("in_at"))

    def pieces(parts):
        for part in parts:
            out = []
            for _, row in part.iterrows():
                f, rec, c = _Frames.of(row), row["recording_id"], int(row["chunk"])
                at = 0
                if not pd.isna(row["in_chunk"]):
                    at, most = f.until(0, np.array(row["in_words"], np.int64), int(row["in_bucket"]), threshold)
                    out.append((rec, int(row["in_chunk"]), int(row["in_at"]), None, at, most, f.times[at] if at < len(f.times) else None, None, None))
                starts = f.follow(at, threshold)
                for a, b in zip(starts, [*starts, len(f.times)][1:], strict=True):
                    _, most = f.until(a, f.words[a], f.buckets[a], threshold)
                    out.append((rec, c, a, f.times[a], b - a, most, f.times[b] if b < len(f.times) else None, f.words[a], int(f.buckets[a])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")]).astype({"bucket": "Int32"})

    d = packed.join(_with_anchor(true, results), ["recording_id", "chunk"]).mapInPandas(pieces, _PIECE)
    found = d.groupBy("recording_id", "anchor_chunk", "anchor_at").agg(F.max("start").alias("start"), F.sum("n").alias("n"), F.max("most").alias("most"), F.max("end").alias("end"), F.max("hash").alias("hash"), F.max("bucket").alias("bucket"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("t0", "t1"))))), 1, 2)
    ends = packed.groupBy("recording_id").agg(F.max("last").alias("last"), first.alias("first"))
    gap = F.lit(step) if step is not None else F.coalesce(F.rint((F.try_element_at("first", F.lit(2)) - F.col("first")[0]) * 1e6) / 1e6, F.lit(0.5))
    d = found.join(ends, "recording_id").withColumn("pos", F.row_number().over(Window.partitionBy("recording_id").orderBy("anchor_chunk", "anchor_at")) - 1)
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    d = d.withColumns({"end": F.coalesce("end", F.col("last") + gap), "sample_count": F.col("n").cast("int"), "max_internal_distance": F.col("most").cast("int")})
    return d.select(*names)
