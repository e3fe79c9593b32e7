"""K-d tree partitioning of documents into shards of near equal bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPREAD_BITS, bucket_count, by_size, running_total, spread, stable

#: A cut may miss its weight by this share of a leaf's target.
TOLERANCE = 0.002
#: Equal texts that together weigh more than this share of a leaf may be parted, into parts of about PIECE of a leaf.
WHOLE, PIECE = 0.5, 1 / 64
#: Rounds in which leaves even out at most, the share of a leaf that they may differ by, and the part of what is to move that a unit may be.
ROUNDS, EVEN, FINE = 8, 0.01, 4
#: Ranges that a node's span is cut into in each pass of the search for its median, for each of its leaves:
#: so many that a range of even weight is within the tolerance.
BINS = 1000


@dataclass
class _Node:
    leaves: int
    first: int  # its first leaf
    dim: int = 0
    cut: int = 0  # values below it go left, and of the rows that equal it those whose hash is below tie
    tie: int | None = None
    left: _Node | None = None
    right: _Node | None = None


def _path(node: _Node, dims: list[str]) -> Column:
    """The number of the first leaf of the deepest known node that a row falls into."""
    if node.left is None:
        return F.lit(node.first)
    v = F.col(dims[node.dim])
    goes = v < node.cut if node.tie is None else (v < node.cut) | ((v == node.cut) & (F.col("__tie") < node.tie))
    return F.when(goes, _path(node.left, dims)).otherwise(_path(node.right, dims))


@dataclass
class _Search:
    """The hunt for a weighted median: `column` in [low, high), of the rows whose `held` column has `value`."""

    column: str
    low: int
    high: int
    wanted: int
    below: int = 0  # weight of what lies under low
    held: str | None = None
    value: int = 0
    bins: int = BINS
    size: int = 0  # weight of the last range looked at


def _medians(rows: DataFrame, node: Column, hunts: dict[int, _Search], slack: float) -> None:
    """Narrows every node's hunt until low is the cut (low == high), or [low, high) is one value that holds it.

    Each pass cuts the ranges into BINS for each leaf and sums the weights by node and bin, on the
    map side first; at most shards times BINS rows reach the driver.
    """
    columns = list(dict.fromkeys(h.column for h in hunts.values()))
    held = list(dict.fromkeys(h.held for h in hunts.values() if h.held))
    while going := {k: h for k, h in hunts.items() if h.high - h.low > 1}:
        last = max(going)

        def of(f: Callable[[_Search], int], going: dict[int, _Search] = going, last: int = last) -> Column:
            """f of the row's hunt, from a table by node; 0 for nodes that hunt nothing."""
            values = [int(f(going[k])) if k in going else 0 for k in range(last + 1)]
            return F.coalesce(F.try_element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("node") + 1), F.lit(0))

        v = rows.withColumn("node", node)
        v = v.withColumns({"v": F.element_at(F.array(*columns), F.greatest(F.lit(1), of(lambda h: columns.index(h.column) + 1)).cast("int")), "low": of(lambda h: h.low), "high": of(lambda h: h.high), "w": F.greatest(F.lit(1), of(_width))})
        inside = (F.col("v") >= F.col("low")) & (F.col("v") < F.col("high"))
        if held:
            inside &= F.element_at(F.array(*held), F.greatest(F.lit(1), of(lambda h: held.index(h.held) + 1)).cast("int")) == of(lambda h: h.value)
        sums = v.where(inside).groupBy("node", F.expr("(v - low) div w").alias("bin")).agg(F.sum("size").alias("size"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        by_node: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r["bin"]):
            by_node.setdefault(r["node"], []).append(r)
        for k, h in going.items():
            for r in by_node.get(k, ()):
                if h.below + r["size"] > h.wanted:
                    h.low, h.high, h.size = r["least"], r["most"] + 1, r["size"]
                    if h.wanted - h.below <= slack:
                        h.high = h.low
                    elif h.below + r["size"] - h.wanted <= slack:
                        h.low = h.high
                    break
                h.below += r["size"]
            else:
                h.low = h.high


def _width(h: _Search) -> int:
    return -(-(h.high - h.low) // h.bins)


def kd_shards(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """rows (with `size`, `__tie` and long columns dims) with `shard`, 0 to shards - 1.

    The tree is split level by level, all nodes of a level in the same passes: a node of m
    leaves is cut along its widest dimension (extent against that of the whole) at the weighted
    quantile floor(m / 2) / m. Where many rows share the value at the cut, they are cut by a
    hash of the row, so a hot value can't make a large leaf. What the driver holds is bounded
    by shards times BINS.
    """
    root = _Node(shards, 0)
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total or shards == 1:
        return rows.withColumn("shard", F.lit(0))
    slack, extent, level = TOLERANCE * total / shards, None, [root]
    while level := [n for n in level if n.leaves > 1]:
        node = _path(root, dims)
        stats = {r["node"]: r for r in rows.groupBy(node.alias("node")).agg(F.sum("size").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()}
        extent = extent or [max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) for d in dims]
        nodes, hunts, ties = {n.first: n for n in level}, {}, {}
        for k in nodes.keys() & stats.keys():
            r, n = stats[k], nodes[k]
            n.dim = max(range(len(dims)), key=lambda i: ((r[f"max_{dims[i]}"] - r[f"min_{dims[i]}"]) / extent[i], -i))
            d = dims[n.dim]
            hunts[k] = _Search(d, r[f"min_{d}"], r[f"max_{d}"] + 1, r["w"] * (n.leaves // 2) // n.leaves, bins=BINS * n.leaves)
        _medians(rows, node, hunts, slack)
        for k, h in hunts.items():
            nodes[k].cut = h.low
            if h.high > h.low:
                ties[k] = _Search("__tie", 0, 2**SPREAD_BITS, h.wanted, h.below, h.column, h.low, h.bins)
        _medians(rows, node, ties, slack)
        for k, h in ties.items():
            # the row at the cut goes to the side that it brings nearer
            nodes[k].tie = h.high if h.below + h.size - h.wanted <= h.wanted - h.below else h.low
        for n in level:
            m = n.leaves // 2
            n.left, n.right = _Node(m, n.first), _Node(n.leaves - m, n.first + m)
        level = [x for n in level for x in (n.left, n.right)]
    return rows.withColumn("shard", _path(root, dims))


def evened(units: DataFrame, shards: int) -> DataFrame:
    """units (__unit, size, __tie, shard) with shards of nearer equal weight: units go over from heavy shards to light ones.

    A cut between large units leaves its sides uneven. In each round a heavy shard puts in what it has too
    much, in units of a quarter of that at most; one without such units gives its least that is half as large
    or more to a shard that has many small ones to hand on in the next round. Light shards take from all of this, in the order of
    shards, in proportion to what they lack. The driver holds a few numbers for each shard.
    """
    by_shard = lambda values: F.element_at(F.array(*[F.lit(int(values.get(k, 0))).cast("long") for k in range(shards)]), F.col("shard") + 1)
    rows, total = units.agg(F.count(F.lit(1)), F.sum("size")).first()
    leaf = (total or 0) // shards
    grain = leaf * EVEN * FINE
    for _ in range(ROUNDS if rows else 0):
        fine = F.sum(F.when(F.col("size") <= grain, F.col("size"))).alias("fine")
        state = {r["shard"]: r for r in units.groupBy("shard").agg(F.sum("size").alias("size"), fine).collect()}
        load = {k: r["size"] for k, r in state.items()}
        over = {k: load.get(k, 0) - leaf for k in range(shards)}
        if max(map(abs, over.values())) <= EVEN * leaf:
            break
        much = by_shard({k: v for k, v in over.items() if v > 0})
        small = (F.col("size") * FINE <= much)
        left = units.where(much > 0).groupBy("shard").agg(F.sum(F.when(small, F.col("size"))).alias("small"), F.min(F.when(F.col("size") * 2 >= much, F.struct("size", "__unit"))).alias("least")).collect()
        large = [r["least"]["__unit"] for r in left if r["least"] and (r["small"] or 0) * 2 < over[r["shard"]]]
        sums = running_total(units.where(small), ["shard"], "__tie", ["__unit"], F.col("size"), bucket_count(rows), "__before")
        put = sums.where(F.col("__before") + F.col("size") <= much)
        # a large one goes to a shard with many small ones to hand on
        takers = sorted(range(shards), key=lambda k: over[k] - (state[k]["fine"] or 0 if k in state else 0))
        swapped = {u: takers[i % shards] for i, u in enumerate(sorted(large))}
        put = stable(put.where(~F.col("__unit").isin(large)))
        weight = {r["shard"]: r["size"] for r in put.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
        if not weight and not large:
            break
        first = {k: sum(v for j, v in weight.items() if j < k) for k in range(shards)}
        lack = {k: -v for k, v in over.items() if v < 0}
        share = sum(weight.values()) / max(1, sum(lack.values()))
        light = sorted(lack)
        ends = [int(sum(lack[j] for j in light[: i + 1]) * share) for i in range(len(light))]
        place = F.col("__before") + by_shard(first) + F.expr("size div 2")
        index = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends[:-1]]), lambda e: e <= place)) if len(ends) > 1 else F.lit(0)
        moved = put.withColumn("shard", F.element_at(F.array(*[F.lit(k) for k in light]), index + 1)).drop("__before")
        units = units.join(put.select("__unit"), "__unit", "left_anti").unionByName(moved)
        if swapped:
            to = F.create_map(*[F.lit(v) for pair in swapped.items() for v in pair])
            units = units.withColumn("shard", F.coalesce(F.try_element_at(to, F.col("__unit")), F.col("shard")))
        units = stable(units)
    return units


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each document.

    size: UTF-8 bytes of the text (null: none) plus 16. Equal texts go to one shard together (null texts are equal); only those
    that together weigh more than WHOLE of a shard are parted, as more than that can't be placed evenly. Dimensions of the tree: the
    logarithm of the size, and the least hash of the languages and of the sources that a text has (null: -1). Where a cut leaves its
    sides uneven, small texts go over to lighter shards. slot numbers the documents of a shard from
    0 without gaps, in a hashed order. Repeated rows count each; an empty table gives no rows.
    """
    text = F.col(text_col).cast("binary")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 16
    code = lambda c: F.when(F.col(c).isNull(), -1).otherwise(F.crc32(F.col(c).cast("binary")))
    d = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.md5(text), F.lit("")).alias("__text"), code(lang_col).cast("long").alias("__lang"), code(source_col).cast("long").alias("__source"))
    d = d.withColumns({"__bytes": F.floor(F.log2(F.col("size").cast("double")) * 65536).cast("long"), "__order": spread(F.col("doc_id"), F.col("text_crc32"), F.col("size"))})
    d = stable(d)  # numbers and names of texts only; every pass reads these, not the texts
    total = d.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    leaf = (total["size"] or 0) / shards
    groups = d.groupBy("__text").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    # no more than shards / WHOLE texts are as heavy
    heavy = groups.where((F.col("size") > WHOLE * leaf) & (F.col("n") > 1)).select("__text", F.least("n", F.ceil(F.col("size") / (PIECE * leaf))).alias("__parts"))
    d = d.join(F.broadcast(heavy), "__text", "left")
    d = d.withColumn("__unit", F.concat_ws(":", "__text", F.coalesce(F.pmod(spread(F.lit("part"), F.col("__order"), F.col("doc_id")), F.col("__parts")), F.lit(0)))).drop("__text", "__parts")
    units = d.groupBy("__unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in ("__bytes", "__lang", "__source")])
    units = stable(units.withColumn("__tie", spread(F.col("__unit"))))
    placed = evened(stable(kd_shards(units, ["__bytes", "__lang", "__source"], shards)), shards)
    placed = by_size(d.select("doc_id", "size", "text_crc32", "__order", "__unit"), placed.select("__unit", "shard", "__n"), "__unit", "__n", total["n"])
    out = running_total(placed, ["shard"], "__order", ["doc_id", "text_crc32", "size"], F.lit(1), bucket_count(total["n"]), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
