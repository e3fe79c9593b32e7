"""Mixing sources to target weights, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucket_count, running_total, spread, stable, word_count

#: Weights of the sources in the order of their names; the list repeats.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is used more often than this, and so no document.
EPOCHS = 3
#: Cuts of up to this many sources are handed to every task; more are joined by a shuffle of the documents.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) for (source, source_size): a row for each source in and out.

    The sum of all sizes is shared by weight, but no source gets more than `epochs` times its
    size; what is over is shared again by weight among the others, until none is above. That
    ends at the one level at which min(cap, weight * level) sums to the whole: with
    sources in the order of cap / weight, those before some place are at their caps, and the
    rest share what is left. One row a source meets in the windows here, no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumns({"__cap": F.col("source_size").cast("double") * epochs, "__level": F.col("source_size").cast("double") * epochs / F.col("__w")})
    order = Window.orderBy("__level", F.col("source").asc_nulls_last())
    before, rest, whole = (order.rowsBetween(*b) for b in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    s = s.withColumn("__here", (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest))
    # the first place whose level is within its cap sets the level of all that follow
    s = s.withColumn("__final", F.min(F.when(F.col("__here") <= F.col("__level"), F.struct("__level", "source_size", "__here"))).over(whole)["__here"])
    return s.select("source", "source_size", F.least(F.col("__cap"), F.coalesce(F.col("__w") * F.col("__final"), F.col("__cap"))).alias("target"))


def plan_mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, size, source_size, target, taken, *keep): a row for each document.

    A source whose budget, floor(target), is e whole epochs and a rest takes every document e
    times; the rest goes to its documents in the order of a random key, up to the document in
    which the running total of sizes reaches it, which is cut there. taken counts words, repeats
    included, and adds up to the budget exactly. The key is a hash of seed, id and size, so reruns agree.
    Null sources form one source, after all others; null texts have size 0.
    """
    size = word_count(F.col(text_col)) if size is None else size
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), spread(F.lit(seed), F.col(id_col), size).alias("key"), *keep)
    d = stable(d)  # a few numbers a document; else each of the three passes below would count words again
    target = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    run = running_total(d, ["source"], "key", ["doc_id", "size", *keep], F.col("size"), bucket_count(d.count()), "before", target)
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """The documents of the mix (see plan_mix), with the columns of docs: a row for each time a document is used.

    The order of a source's documents is fixed by key, id and a hash of the text, so one cut a source tells which
    of them get an epoch more, and each row is decided where it lies: texts are not shuffled. The
    document at the cut keeps the words up to it, parted by single blanks. Rows alike in id and text
    stand at one place; if a cut falls there, those rows alone meet in a task for each source, to be
    numbered. n_chars, where there is one, follows the text.
    """
    size, columns = word_count(F.col("text")), docs.columns
    docs = docs.withColumn("__text", F.xxhash64("text"))
    plan = stable(plan_mix(docs, None, weights, epochs, seed, keep=("__text",)).withColumn("key", spread(F.lit(seed), F.col("doc_id"), F.col("size"))))
    budget = F.floor("target")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("more", F.col("taken") - F.col("whole") * F.col("size"))
    nobody = F.lit(-(2**63))
    place = F.struct("key", F.coalesce("doc_id", nobody).alias("id"), "__text")
    used = F.when((F.col("more") > 0) & (F.col("size") > 0), place)
    cuts = stable(plan.groupBy("source").agg(F.max("whole").alias("__whole"), F.max(used).alias("__cut")).withColumnRenamed("source", "__source"))
    few = cuts.count() <= BROADCAST_SOURCES
    # what the rows at a cut get together, and how many they are
    at = plan.join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col("__source")) & (place == F.col("__cut")))
    at = at.groupBy("source").agg(F.sum("more").alias("__more"), F.count(F.lit(1)).alias("__alike")).withColumnRenamed("source", "__at")
    cuts = stable(cuts.join(at, F.col("__source").eqNullSafe(F.col("__at")), "left").drop("__at"))
    several = cuts.where("__alike > 1").limit(1).count() > 0
    d = docs.withColumn("__size", size).join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col("__source")))
    here = F.struct(spread(F.lit(seed), F.col("doc_id"), F.col("__size")).alias("key"), F.coalesce("doc_id", nobody).alias("id"), "__text")
    last = F.col("__cut")
    number = F.lit(0)
    if several:
        alike = F.coalesce((here == last) & (F.col("__alike") > 1), F.lit(False))
        counted = d.where(alike).withColumn("__number", F.row_number().over(Window.partitionBy("source").orderBy("__text")) - 1)
        d, number = d.where(~alike).withColumn("__number", F.lit(0)).union(counted), F.col("__number")
    more = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__more") - number * F.col("__size")))
    part = F.when(here < last, F.col("__size")).when(here == last, more).otherwise(0)
    part = F.when(F.col("__cut").isNull(), 0).otherwise(part)
    d = d.withColumn("__part", part)
    times = F.col("__whole") + (F.col("__part") > 0).cast("long")
    d = d.where((times > 0) & (F.col("__size") > 0)).withColumn("__n", F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col("__n") > F.col("__whole")) & (F.col("__part") < F.col("__size"))
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit("(" + WORD + ")")), 1, F.greatest(F.lit(1), F.col("__part")).cast("int")), " ")).otherwise(F.col("text"))
    d = d.withColumn("text", text)
    if "n_chars" in columns:
        d = d.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*columns)
