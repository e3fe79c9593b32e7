"""Slugs of a table of names against the loop over a list."""

import random

import pytest

from tidemark.functions.scalar import unique_slugs
from tidemark.operators import slugs


def compared(spark, names, step=1):
    d = spark.createDataFrame([(i * step, n) for i, n in enumerate(names)], "ord long, name string").repartition(3)
    got = [r.slug for r in slugs.unique_slug_rows(d).orderBy("ord").collect()]
    assert got == unique_slugs([n or "" for n in names]) and len(set(got)) == len(got)


@pytest.mark.parametrize("names", [["a"] * 5, ["a", "a-2", "a", "a"], ["a-2", "a", "a"], ["a", "a", "a-2", "a-2", "a"], ["a-2", "a-2", "a", "a", "a-2-2"], ["a-3", "a", "a-2", "a", "a"], ["", None, "??", "recording", "recording-2"], ["a-01", "a-1", "a", "a"], ["x"]])
def test_cases(spark, names):
    compared(spark, names)


@pytest.mark.parametrize("seed", range(3))
def test_random_names(spark, monkeypatch, seed):
    monkeypatch.setattr(slugs, "RANGE", 7)
    rng = random.Random(seed)
    pool = ["a", "a-2", "a-3", "a-2-2", "a b", "a_b-2", "c", "a-12", "a-4"]
    compared(spark, [rng.choice(pool) for _ in range(70)], step=3)


def test_no_names(spark):
    assert slugs.unique_slug_rows(spark.createDataFrame([], "ord long, name string")).count() == 0
