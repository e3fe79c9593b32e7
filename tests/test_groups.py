"""Passes over sorted batches, and frames' hashes from bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.hashing import average_hash, brightness
from tidemark.operators import groups, silence
from tidemark.sources import media


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_groups_go_on_across_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.choice([None, "a", "b", "c"]) or "", rng.randrange(4)) for _ in range(90))
    table = pa.Table.from_pylist([{"k": k or None, "n": n, "i": i} for i, (k, n) in enumerate(rows)])
    got = [(key, part.column("i").to_pylist()) for key, part in groups.groups(iter(table.to_batches(max_chunksize=size)), ["k", "n"])]
    want = {}
    for i, (k, n) in enumerate(rows):
        want.setdefault((k or None, n), []).append(i)
    assert got == list(want.items())


def test_quiet_runs_of_many_blocks_are_handed_on_in_parts():
    """A batch of many blocks, each with as many runs as it can have, is not one batch of runs."""
    x = np.tile(np.array([0, 30000], np.int16), 100)
    n = 1000
    batch = pa.RecordBatch.from_arrays([pa.array(["r"] * n), pa.array([100] * n, pa.int32()), pa.array(np.arange(n) * 200), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 200, pa.int32()), pa.array(np.tile(x, n)))], ["recording_id", "sample_rate", "first", "samples"])
    made = list(silence._found(iter([batch]), 20000))
    assert max(b.num_rows for b in made) <= 100 * silence.BLOCKS
    first = np.concatenate([b.column("first").to_numpy() for b in made])
    assert first.tolist() == list(range(0, 200 * n, 2)) and sum(b.column("open").to_numpy(zero_copy_only=False).sum() for b in made) == n
    assert all(np.array_equal(b.column("end").to_numpy(), b.column("first").to_numpy() + 1) for b in made)


def test_hashes_from_bytes_equal_those_of_numbers(spark):
    rng = random.Random(3)
    rows = [("r", i, i / 2, bytes(rng.randrange(256) for _ in range(rng.choice([64, 1024]))) if i % 5 else bytes([i]) * 1024) for i in range(40)]
    d = spark.createDataFrame(rows, "recording_id string, idx int, time double, pixels binary")
    v = F.array(*[F.conv(F.substring(F.hex("pixels"), 2 * k + 1, 2), 16, 10).cast("int") for k in range(64)])
    got = {r.idx: r for r in media.frame_samples(d).collect()}
    short = d.where("length(pixels) = 64").select("idx", average_hash(v).alias("hash"), brightness(v).alias("bucket")).collect()
    assert short and all((got[r.idx].hash, got[r.idx].bucket) == (r.hash, r.bucket) for r in short)
    for _, i, _, p in rows:
        mean = sum(p) / len(p)
        bits = [x >= mean for x in p]
        words = [int("".join("01"[b] for b in bits[k : k + 64]), 2) for k in range(0, len(p), 64)]
        assert [w % 2**64 for w in got[i].hash] == words and got[i].bucket == min(int(mean / 8), 31)
    explained = media.frame_samples(d)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in explained and "transform" not in explained
