"""Average hashes of pictures and vectors, and their distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits that tell the mean brightness, beside those that tell the texture.
BUCKETS = 32


def average_hash(values: Column) -> Column:
    """Words of 64 bits, first value in the highest: a bit is set where the value is its mean or more.

    The number of values must be a multiple of 64. Null or empty arrays have no hash.
    """
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    # arrays of one, so that mean and bits are worked out once and not for each value
    bits = F.transform(F.array(mean), lambda m: F.transform(values, lambda x: (x.cast("double") >= m).cast("long")))
    count = F.floor(F.size(values) / 64).cast("int")
    words = F.transform(bits, lambda own: F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.aggregate(F.slice(own, w * 64 + 1, 64), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))))[0]
    return F.when(F.size(values) > 0, words)


def brightness(pixels: Column) -> Column:
    """Which of 32 equal ranges of 0 to 256 the mean lies in."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(pixels)
    return F.least(F.floor(mean / 256 * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Number of bits in which two hashes (arrays of words) differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, n: s + n)


def frame_distance(hash_a: Column, bucket_a: Column, hash_b: Column, bucket_b: Column) -> Column:
    """Distance of two frames: texture bits and the five bits of the brightness, as plain binary."""
    return hamming(hash_a, hash_b) + F.bit_count(bucket_a.bitwiseXOR(bucket_b)).cast("int")
