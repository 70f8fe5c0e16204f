"""Offline orthogonal range counting: how many points lie in each of many boxes.

All boxes are known beforehand, so every dimension is ranked by the bounds
that occur (``bound_ranks``: a sorted, range-partitioned prefix table), and a
value between two bounds is as good as any other there. Points and boxes meet
in *nodes*, runs of RADIX^level ranks: a point lies in one node of each level,
and a box is covered by a few nodes of each. The last dimension of a count is
not cut into nodes: points and box ends are sorted by it within the nodes of
the other dimensions, again range-partitioned, and a running sum answers every
end (``prefix_counts``). No point is ever paired with a box.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.prefix import weighted_before

#: Ranks of a node's child, and the bits that a node's number has beside its level.
RADIX, _BITS = 8, 48
#: The node of points without a value, and the node of all points.
NULL_NODE, ROOT = -1, -2


@dataclass
class Dimension:
    """A column of the points, and its optional lower and upper bound (inclusive) among those of the boxes."""

    name: str
    low: str | None
    high: str | None


def bound_ranks(points: DataFrame, boxes: DataFrame, dims: list[Dimension]) -> tuple[DataFrame, dict[str, int]]:
    """((dim, value, rank), levels of each dimension) for every value of the points and every bound.

    The rank is twice the number of bounds below the value, and one more if the value is a bound.
    """
    def long(df: DataFrame, columns: list[tuple[str, str]], weight: int) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).cast("double").alias("value")) for d, c in columns]))
        return df.select(each.alias("x")).select("x.*", F.lit(weight).alias("w")).where("value is not null")
    bounds = [(d.name, c) for d in dims for c in (d.low, d.high) if c]
    every = long(points, [(d.name, d.name) for d in dims], 0)
    if bounds:
        every = every.unionByName(long(boxes, bounds, 1))
    distinct = every.groupBy("dim", "value").agg(F.max("w").alias("w"))
    ranks = weighted_before(distinct, ["dim"], "value", "w").select("dim", "value", (2 * F.col("_before") + F.col("w")).alias("rank"))
    most = {r.dim: r.rank for r in ranks.groupBy("dim").agg(F.max("rank").alias("rank")).collect()}  # a row for each dimension
    levels = {}
    for d in dims:
        n = 0
        while (d.low or d.high) and RADIX ** n <= most.get(d.name, 0):
            n += 1
        levels[d.name] = n
    return ranks, levels


def _ranked(df: DataFrame, ranks: DataFrame, dim: str, column: str, out: str) -> DataFrame:
    own = ranks.where(F.col("dim") == dim).select(F.col("value").alias("_v"), F.col("rank").alias(out))
    return df.join(own, F.col(column).cast("double") == F.col("_v"), "left").drop("_v")


def _node(level: int, number: Column) -> Column:
    return F.lit(level << _BITS) + number


def point_nodes(rank: Column, levels: int) -> Column:
    """The nodes that a point lies in."""
    own = F.array(*[_node(k, F.floor(rank / RADIX ** k)) for k in range(levels)], F.lit(ROOT).cast("bigint")) if levels else F.array(F.lit(ROOT).cast("bigint"))
    return F.when(rank.isNull(), F.array(F.lit(NULL_NODE).cast("bigint"), F.lit(ROOT).cast("bigint"))).otherwise(own)


def box_nodes(low: Column, high: Column, levels: int) -> Column:
    """Nodes that together hold the points with a rank from ``low`` to ``high`` (null: unbounded) and those without a value, once each."""
    last = RADIX ** max(levels, 1) - 1
    lo, hi = F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(last))
    up = [F.ceil(lo / RADIX ** k) for k in range(levels + 1)]
    down = [F.floor((hi + 1) / RADIX ** k) - 1 for k in range(levels + 1)]
    none = F.array().cast("array<bigint>")

    def run(level: int, a: Column, b: Column) -> Column:
        return F.when(a <= b, F.transform(F.sequence(a, b), lambda x: _node(level, x))).otherwise(none)
    parts = [F.array(F.lit(NULL_NODE).cast("bigint"))]
    for k in range(levels):
        a, b = up[k], down[k]
        if k == levels - 1:
            parts.append(run(k, a, b))
        else:  # what the nodes one level up leave over on either side
            inside = up[k + 1] <= down[k + 1]
            parts.append(F.when(inside, run(k, a, F.least(b, up[k + 1] * RADIX - 1))).otherwise(run(k, a, b)))
            parts.append(F.when(inside, run(k, F.greatest(a, (down[k + 1] + 1) * RADIX), b)).otherwise(none))
    return F.when(low.isNull() & high.isNull(), F.array(F.lit(ROOT).cast("bigint"))).otherwise(F.concat(*parts))


def prefix_counts(points: DataFrame, asks: DataFrame, nodes: list[str]) -> DataFrame:
    """``asks`` (nodes, at, ...) with ``below``, the number of points of those nodes whose ``at`` is smaller, and ``total``.

    ``points`` holds nodes, at and n. Points without a value have ``at`` -1.
    """
    key = F.concat_ws(" ", *nodes) if nodes else F.lit("")
    weights = (points.select(key.alias("_key"), "at", "n").unionByName(asks.select(key.alias("_key"), "at", F.lit(0).cast("bigint").alias("n")))
               .groupBy("_key", "at").agg(F.sum("n").alias("n")))
    found = weighted_before(weights, ["_key"], "at", "n").select("_key", "at", F.col("_before").alias("below"), F.col("_group_total").alias("total"))
    return asks.withColumn("_key", key).join(found, ["_key", "at"]).drop("_key")


def _dealt(boxes: DataFrame) -> DataFrame:
    """``boxes`` dealt over as many partitions as a shuffle has. There are few of them, in one partition at
    most times, until they are exploded into their nodes, dimension after dimension, in the tasks that hold them."""
    return boxes.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def chain_counts(points: DataFrame, boxes: DataFrame, box_id: str, dims: list[Dimension], among: tuple[str, str] | None = None) -> DataFrame:
    """(box_id, step, bound, n): how many points satisfy a box's bounds up to each one.

    Step 0 counts all points, step 2i + 1 those within the first i dimensions
    and above the lower bound of the next, step 2i + 2 those within that
    dimension's upper bound as well. A null in a point or a bound satisfies. ``among`` names a text
    column of the points and a column of the boxes with the texts allowed (null or
    empty: all; points whose text is null or empty satisfy), compared trimmed and in lower case; it is
    the last step. Empty ranges hold only the points without a value.
    """
    columns = [d.name for d in dims]
    text = [F.lower(F.trim(F.coalesce(F.col(among[0]), F.lit("")))).alias("_text")] if among else []
    ranks, levels = bound_ranks(points, boxes, dims)
    cells = points.groupBy(*columns, *text).agg(F.count(F.lit(1)).alias("n"))
    asked = boxes.select(F.col(box_id).alias("_box"), *[F.col(c) for c in dict.fromkeys(c for d in dims for c in (d.low, d.high) if c)], *([F.col(among[1]).alias("_allowed")] if among else []))
    null = F.lit(None).cast("bigint")
    for d in dims:
        cells = _ranked(cells, ranks, d.name, d.name, f"_r_{d.name}")
        for side, c in (("lo", d.low), ("hi", d.high)):
            asked = _ranked(asked, ranks, d.name, c, f"_{side}_{d.name}") if c else asked.withColumn(f"_{side}_{d.name}", null)
    cells = cells.select(*[f"_r_{c}" for c in columns], *(["_text"] if among else []), "n").groupBy(*[f"_r_{c}" for c in columns], *(["_text"] if among else [])).agg(F.sum("n").alias("n"))
    asked = asked.select("_box", *[f"_{s}_{c}" for c in columns for s in ("lo", "hi")], *(["_allowed"] if among else []))
    asked = _dealt(asked).checkpoint(eager=True)
    cells = cells.checkpoint(eager=True)
    total = points.select(F.count(F.lit(1))).scalar()
    out = [asked.select("_box", F.lit(0).alias("step"), total.alias("n"))]
    held: list[str] = []  # the dimensions that are nodes so far
    for i, d in enumerate(dims):
        lo, hi, own = F.col(f"_lo_{d.name}"), F.col(f"_hi_{d.name}"), F.col(f"_r_{d.name}")
        at = F.coalesce(own, F.lit(-1).cast("bigint"))
        here = cells.select(*held, at.alias("at"), "n").groupBy(*held, "at").agg(F.sum("n").alias("n"))
        # the points below 0 are those without a value; an empty range asks for no others
        ends = F.array(F.struct(F.lit("none").alias("end"), F.lit(0).cast("bigint").alias("at")),
                       F.struct(F.lit("low").alias("end"), F.coalesce(lo, F.lit(0)).alias("at")),
                       F.struct(F.lit("high").alias("end"), F.greatest(F.coalesce(hi + 1, F.lit(1 << 40)), F.coalesce(lo, F.lit(0))).alias("at")))
        found = prefix_counts(here, asked.select("_box", *held, F.inline(ends)), held)
        per = found.groupBy("_box").agg(*[F.sum(F.when(F.col("end") == e, F.col("below"))).alias(e) for e in ("none", "low", "high")], F.sum(F.when(F.col("end") == "none", F.col("total"))).alias("total"))
        both = F.array(F.struct(F.lit(2 * i + 1).alias("step"), (F.col("total") - F.col("low") + F.col("none")).alias("n")),
                       F.struct(F.lit(2 * i + 2).alias("step"), (F.col("high") - F.col("low") + F.col("none")).alias("n")))
        out.append(per.select("_box", F.inline(both)))
        if i + 1 < len(dims) or among:
            node = f"_n_{d.name}"
            # points lie in the same nodes again and again: their counts are added up before the next step
            spread = cells.withColumn(node, F.explode(point_nodes(own, levels[d.name]))).drop(own)
            cells = spread.groupBy([c for c in spread.columns if c != "n"]).agg(F.sum("n").alias("n")).checkpoint(eager=True)
            asked = asked.withColumn(node, F.explode(box_nodes(lo, hi, levels[d.name])))
            held.append(node)
    if among:
        allowed = F.transform("_allowed", lambda t: F.lower(F.trim(t)))
        texts = F.when(F.size(F.coalesce("_allowed", F.array())) > 0, F.array_distinct(F.concat(allowed, F.array(F.lit("")))))
        # boxes that allow all texts ask for the sum over them
        sums = cells.groupBy(*held).agg(F.sum("n").alias("n")).withColumn("_t", F.lit(None).cast("string"))
        each = cells.select(*held, "n", F.concat(F.lit("="), "_text").alias("_t")).unionByName(sums)
        asks = asked.select("_box", *held, F.explode(F.coalesce(F.transform(texts, lambda t: F.concat(F.lit("="), t)), F.array(F.lit(None).cast("string")))).alias("_t"))
        same = [F.coalesce("_t", F.lit("")).alias("_t")]
        met = asks.select("_box", *held, *same).join(each.select(*held, "n", *same), [*held, "_t"])
        per = met.groupBy("_box").agg(F.sum("n").alias("n"))
        last = asked.select("_box").distinct().join(per, "_box", "left").select("_box", F.lit(2 * len(dims) + 1).alias("step"), F.coalesce("n", F.lit(0)).alias("n"))
        out.append(last)
    steps = out[0]
    for more in out[1:]:
        steps = steps.unionByName(more)
    return steps.select(F.col("_box").alias(box_id), "step", F.col("n").cast("bigint").alias("n"))
