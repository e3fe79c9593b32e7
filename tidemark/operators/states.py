"""Segments of a frame sequence and the states that they show."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import frame_distance
from .groups import by_key

#: Bits in which a frame may differ from the first of its segment, and a segment from the state it shows.
STABLE, MATCH = 24, 48

_SEGMENT = "recording_id string, pos int, start double, end double, sample_count int, max_internal_distance int, hash array<bigint>, bucket int"
_STATE = "recording_id string, pos int, start double, end double, state_id int, sample_count int"


def _distances(words: np.ndarray, buckets: np.ndarray, one: np.ndarray, bucket: int) -> np.ndarray:
    return np.bitwise_count((words ^ one).view(np.uint64)).sum(axis=1, dtype=np.int64) + np.bitwise_count(buckets ^ bucket)


def _words(part: pa.Table) -> np.ndarray:
    """The hashes of rows, one a row; all must be of one length."""
    hashes = part.column("hash")
    sizes = pc.unique(pc.list_value_length(hashes))
    if len(sizes) != 1:
        raise ValueError("hashes of a recording differ in length")
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in hashes.chunks]).reshape(len(hashes), sizes[0].as_py())


def _segments(time: np.ndarray, words: np.ndarray, buckets: np.ndarray, threshold: int, step: float | None) -> list[tuple[int, int, float, int]]:
    """(first, beyond, end, largest distance): a segment lasts while frames are near its first one."""
    # a difference of two times is off by their last bits, which the end of a long recording shows
    step = (np.rint((time[1] - time[0]) * 1e6) / 1e6 if len(time) > 1 else 0.5) if step is None else step
    out, a, block = [], 0, 64
    while a < len(time):
        b, most = a + 1, 0
        while b < len(time):
            # blocks that grow, so that neither short nor long segments waste work
            d = _distances(words[b : b + block], buckets[b : b + block], words[a], buckets[a])
            far = np.flatnonzero(d > threshold)
            n = int(far[0]) if len(far) else len(d)
            most = max(most, int(d[:n].max(initial=0)))
            b += n
            if len(far):
                break
            block = min(4096, block * 2)
        block = 64
        out.append((a, b, float(time[b]) if b < len(time) else float(time[-1] + step), most))
        a = b
    return out


def anchor_segments(frames: DataFrame, threshold: int = STABLE, step: float | None = None) -> DataFrame:
    """Segments of frame_samples (recording_id, time, hash, bucket): each lasts while frames differ from its
    first one in `threshold` bits at most. It ends where the next begins; the last one a step after
    its last frame (by default the time between the first two frames, to the microsecond; 0.5 for a
    single one). Of frames at one time that of least idx comes first, where frames have one.

    Each frame is compared with an anchor that depends on all before, so a recording is one
    sequential task; its frames (136 bytes each, two a second) are all that it holds.
    """

    def run(key: tuple, part: pa.Table) -> pa.RecordBatch:
        time, words, buckets = part.column("time").to_numpy(), _words(part), part.column("bucket").to_numpy().astype(np.int64)
        found = _segments(time, words, buckets, threshold, step)
        begin = np.array([a for a, _, _, _ in found])
        columns = [(pa.string(), [key[0]] * len(found)), (pa.int32(), np.arange(len(found))), (pa.float64(), time[begin]), (pa.float64(), [end for _, _, end, _ in found]), (pa.int32(), [b - a for a, b, _, _ in found]), (pa.int32(), [most for _, _, _, most in found])]
        hashes = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * words.shape[1], pa.int32()), pa.array(words[begin].ravel(), pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for t, c in columns), hashes, pa.array(buckets[begin], pa.int32())], ["recording_id", "pos", "start", "end", "sample_count", "max_internal_distance", "hash", "bucket"])

    idx = [c for c in ("idx",) if c in frames.columns]
    d = frames.select(F.col("recording_id").cast("string"), F.col("time").cast("double"), "hash", F.col("bucket").cast("int").alias("bucket"), *idx)
    return by_key(d.where("hash IS NOT NULL"), ["recording_id"], [F.asc_nulls_last("time"), *idx], run, _SEGMENT)


def online_states(segments: DataFrame, threshold: int = MATCH, least: float = 0.0) -> DataFrame:
    """Segments with the state they show: the nearest known one within `threshold` bits (the lowest of equals), else a new one.

    A state is known by the hash of its latest segment of `least` seconds or more.
    """

    def run(key: tuple, part: pa.Table) -> pa.RecordBatch:
        words, buckets = _words(part), part.column("bucket").to_numpy().astype(np.int64)
        long = part.column("end").to_numpy() - part.column("start").to_numpy() >= least
        known, known_bucket, n, ids = np.empty_like(words), np.empty_like(buckets), 0, []
        for i in range(len(words)):
            d = _distances(known[:n], known_bucket[:n], words[i], buckets[i])
            best = int(d.argmin()) if n else -1
            if n and d[best] <= threshold:
                if long[i]:
                    known[best], known_bucket[best] = words[i], buckets[i]
            else:
                best = n
                known[n], known_bucket[n] = words[i], buckets[i]
                n += 1
            ids.append(best)
        own = part.append_column("state_id", pa.array(ids, pa.int32())).select(["recording_id", "pos", "start", "end", "state_id", "sample_count"])
        return own.combine_chunks().to_batches()[0]

    return by_key(segments, ["recording_id"], ["pos"], run, _STATE)


def visual_activity(frames: DataFrame) -> DataFrame:
    """(recording_id, time, distance): how far each frame is from the one before, by time and idx, where there is one; the first has no row."""
    w = Window.partitionBy("recording_id").orderBy("time", *[c for c in ("idx",) if c in frames.columns])
    d = frames.withColumns({"__h": F.lag("hash").over(w), "__b": F.lag("bucket").over(w)})
    return d.where("__h IS NOT NULL").select("recording_id", "time", frame_distance(F.col("__h"), F.col("__b"), F.col("hash"), F.col("bucket")).alias("distance"))


def stability(states: DataFrame, least: float = 2.0) -> DataFrame:
    """(recording_id, stability): the share of time in states of `least` seconds or more; null where there is no time."""
    d = F.col("end") - F.col("start")
    return states.groupBy("recording_id").agg(F.try_divide(F.sum(F.when(d >= least, d).otherwise(0.0)), F.nullif(F.greatest(F.sum(d), F.lit(0.0)), F.lit(0.0))).alias("stability"), F.count(F.lit(1)).alias("n_states"))


def rollbacks(states: DataFrame, part: list[str] | None = None, order: str = "pos") -> DataFrame:
    """Returns A B A among consecutive states (B not A): the columns of A, and b, a2 and, where B follows again, b2 as structs.

    A match takes the next state with it: of consecutive matches every other one counts, from the first on.
    """
    part = part or ["recording_id"]
    w = Window.partitionBy(*part).orderBy(order)
    state = F.struct("state_id", "start", "end")
    d = states.withColumns({"b": F.lead(state, 1).over(w), "a2": F.lead(state, 2).over(w), "b2": F.lead(state, 3).over(w)})
    d = d.withColumn("__hit", F.coalesce((F.col("a2.state_id") == F.col("state_id")) & (F.col("b.state_id") != F.col("state_id")), F.lit(False)))
    d = d.withColumn("__run", F.sum(F.when(F.col("__hit"), 0).otherwise(1)).over(w))
    d = d.where("__hit").withColumn("__i", F.row_number().over(Window.partitionBy(*part, "__run").orderBy(order))).where("__i % 2 = 1")
    again = F.coalesce(F.col("b2.state_id") == F.col("b.state_id"), F.lit(False))
    return d.withColumn("repeat", again).drop("__hit", "__run", "__i")


def brief_states(states: DataFrame, most: float = 1.2, part: list[str] | None = None, order: str = "pos") -> DataFrame:
    """States of less than `most` seconds, neither first nor last, with the ids of their neighbours."""
    w = Window.partitionBy(*(part or ["recording_id"])).orderBy(order)
    d = states.withColumns({"previous_state": F.lag("state_id").over(w), "next_state": F.lead("state_id").over(w), "duration": F.col("end") - F.col("start")})
    return d.where(F.col("previous_state").isNotNull() & F.col("next_state").isNotNull() & (F.col("duration") < most))
