"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as the word rules of this package see it: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, but only on one machine (tests)."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return named or sc.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    """(file system, path) of any store that Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def stable(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that rereads agree and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key of so many rows is a hot one, or, in a larger table, one of a share of 10**-5 of its rows.
HOT_ROWS, HOT_SHARE = 1000, 1e-5


def by_size(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined to facts, which have one row a key; facts' `count` is how many of the rows have it (and is left out), total their sum.

    Facts of hot keys are handed to every task, so that no task gets all rows of one: there are
    1 / HOT_SHARE of them at most. The rest is joined by a shuffle. Rows without a fact are left out.
    facts are read several times, so they should be written.
    """
    hot = max(HOT_ROWS, int(total * HOT_SHARE))
    if not facts.where(F.col(count) >= hot).limit(1).count():
        return rows.join(facts.drop(count), key)
    others = [c for c in facts.columns if c not in (key, count)]
    few = rows.join(F.broadcast(facts.where(F.col(count) >= hot).drop(count).withColumn("__hot", F.lit(True))), key, "left")
    rest = few.where("__hot IS NULL").drop("__hot", *others).join(facts.where(F.col(count) < hot).drop(count), key)
    return few.where("__hot").drop("__hot").unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of words in text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(*columns: Column) -> Column:
    """A uniform key of 60 bits, 0 or more, from the given columns (nulls: empty)."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


SPREAD_BITS = 60


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 256) -> int:
    """A power of two, so that a bucket is a range of the leading bits of `spread`."""
    n = least
    while n * per_bucket < rows:
        n *= 2
    return n


def running_total(df: DataFrame, group: list[str], key: str, ties: list[str], value: Column, buckets: int, out: str, per_group: DataFrame | None = None) -> DataFrame:
    """df with `out`: the sum of `value` over the rows before it in its group, in the order of key, then ties.

    Two levels, so that no group meets in one task: the key's leading bits deal the rows of a
    group into `buckets` ranges; sums of whole ranges (partial sums first) give each range its
    start; rows are sorted only within their range. Rows alike in all columns named may take
    their places in any order. Null groups count as one group. Further columns of per_group, a
    row for each group, are added by way of the ranges' starts.
    """
    shift = SPREAD_BITS - (buckets.bit_length() - 1)
    g = [f"__g{i}" for i in range(len(group))]

    def named(x: DataFrame) -> DataFrame:
        return x.withColumns({a: F.coalesce(F.concat(F.lit("="), F.col(b).cast("string")), F.lit("")) for a, b in zip(g, group, strict=True)})

    df = named(df).withColumns({"__b": F.shiftright(F.col(key), shift).cast("int"), "__v": value.cast("long")})
    before = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*g, "__b").agg(F.sum("__v").alias("__s")).withColumn("__start", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    if per_group is not None:
        starts = starts.join(named(per_group).drop(*group), g)
    within = Window.partitionBy(*g, "__b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts.hint("shuffle_merge"), [*g, "__b"])
    return joined.withColumn(out, F.col("__start") + F.coalesce(F.sum("__v").over(within), F.lit(0))).drop(*g, "__b", "__v", "__start")
