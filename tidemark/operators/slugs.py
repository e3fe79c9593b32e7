"""Unique slugs of any number of names, in the order of the names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import slug
from ..storage import written

#: Places of a range: names of one slug are numbered by ranges of their order, so that a frequent slug is many tasks.
RANGE = 1 << 16

_NUMBERED = r"^(.+)-([2-9]|[1-9][0-9]{1,17})$"


def count_before(asked: DataFrame, told: DataFrame, out: str, same: bool) -> DataFrame:
    """asked (base, at, ...) with how many rows of told (base, at) have its base and a smaller at, or with `same` an equal one too.

    Ranges of `at` are swept apart; what a range needs of those before it is their number of rows.
    """
    range_ = F.expr(f"at div {RANGE}")
    t = told.groupBy("base", "at").agg(F.count(F.lit(1)).alias("__n")).withColumn("__range", range_)
    first = (0, 1) if same else (1, 0)
    rows = asked.withColumns({"__range": range_, "__side": F.lit(first[1]), "__n": F.lit(None).cast("long")}).unionByName(t.withColumn("__side", F.lit(first[0])), allowMissingColumns=True).withColumn("__told", F.col("__side") == first[0])
    within = Window.partitionBy("base", "__range").orderBy("at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("base").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = t.groupBy("base", "__range").agg(F.sum("__n").alias("__n")).select("base", "__range", "__n")
    places = asked.select("base", range_.alias("__range"), F.lit(0).cast("long").alias("__n")).distinct()
    carried = carried.unionByName(places).groupBy("base", "__range").agg(F.sum("__n").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    own = rows.withColumn("__own", F.coalesce(F.sum("__n").over(within), F.lit(0))).where("NOT __told")
    return own.join(carried, ["base", "__range"]).withColumn(out, F.col("__own") + F.col("__before")).select(*asked.columns, out)


def _named(base: Column, number: Column) -> Column:
    return F.when(number == 1, base).otherwise(F.concat(base, F.lit("-"), number.cast("string")))


def _foreign(claims: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, number, at): names that a base would give, and from when on a row of another base has them."""
    s = F.col("slug")
    parts = F.array(F.struct(s.alias("base"), F.lit(1).cast("long").alias("number")), F.struct(F.regexp_extract(s, _NUMBERED, 1).alias("base"), F.coalesce(F.expr(f"try_cast(regexp_extract(slug, r'{_NUMBERED}', 2) AS bigint)"), F.lit(0)).alias("number")))
    d = claims.select(F.col("base").alias("own"), F.col("at"), F.explode(parts).alias("p")).select("own", "at", "p.*").where("number > 0 AND base <> own")
    return d.join(bases, "base", "left_semi").groupBy("base", "number").agg(F.min("at").alias("at"))


def _skipped(foreign: DataFrame, rows: DataFrame) -> DataFrame:
    """(base, at): from which of its rows on a base's numbers are one higher, because a number was taken before its turn.

    A number is skipped if, of the base's rows before the other one, fewer are there than the number's turn needs.
    Put in order by base are only the numbers that others have.
    """

    def fold(part):
        part = part.sort_values("number")
        out, skipped = [], 0
        for number, there in zip(part["number"].tolist(), part["there"].tolist(), strict=True):
            if skipped < number - there:
                out.append(number - skipped)
                skipped += 1
        base = part["base"].iloc[0]
        return part.head(0)[["base"]].assign(at=0) if not out else part.iloc[[0] * len(out)][["base"]].assign(base=base, at=out)

    counted = count_before(foreign, rows, "there", same=False)
    return counted.groupBy("base").applyInPandas(fold, "base string, at long")


def unique_slug_rows(names: DataFrame, order: str = "ord", name: str = "name") -> DataFrame:
    """names with `slug`: that of the name, or with -2, -3 and so on, the first that no name before it in the order has.

    The same slugs as `scalar.unique_slugs` gives to the ordered names. Names of one base are numbered; where a name's own slug is
    what another base would number (`a-2` among many `a`), the numbers after it move on. This is repeated until no such case
    changes: most tables need one round, and a further one for each such case that rests on another. The order must
    be a whole number, 0 or more, and different for each row; null names count as empty.
    """
    rows = written(names.select(F.col(order).cast("long").alias("at"), slug(F.coalesce(F.col(name), F.lit(""))).alias("base")))
    numbered = written(count_before(rows, rows.select("base", "at"), "turn", same=True))
    bases, was, skipped = rows.select("base").distinct(), None, None
    while True:
        claims = numbered.withColumn("number", F.col("turn"))
        if skipped is not None:
            turns = numbered.select("base", F.col("turn").alias("at"), F.col("at").alias("place"))
            moved = count_before(turns, skipped, "more", same=True)
            claims = moved.select(F.col("place").alias("at"), "base", (F.col("at") + F.col("more")).alias("number"))
        claims = claims.select("at", "base", _named(F.col("base"), F.col("number")).alias("slug"))
        foreign = written(_foreign(claims, bases))
        state = foreign.agg(F.count(F.lit(1)), F.sum(F.xxhash64("base", "number", "at").cast("decimal(38,0)"))).first()
        if state == was or not state[0]:
            break
        was, skipped = state, written(_skipped(foreign, rows.select("base", "at")))
    return names.join(claims.select(F.col("at").alias("__at"), "slug"), F.col(order).cast("long") == F.col("__at")).drop("__at")
