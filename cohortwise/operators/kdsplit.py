"""A k-d split of points into leaves that serve as join keys of bounded size.

The tree is made on the driver from a sample of bounded size, cut at medians,
so that dense regions get small leaves; it is data of a bounded size that goes
to the tasks. Points look up their leaf, boxes all leaves that they touch. A
leaf that still holds more points than wanted (equal points cannot be cut
apart) is dealt into parts by a hash, and a box meets every part.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship the functions that run in Python workers by value: executors need no copy of this package for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points of a join key, about; a key has twice as many at most, but for chance.
LEAF_ROWS = 512
#: Rows of the sample and leaves of the tree, at most.
SAMPLE, MOST_LEAVES = 200_000, 16_384
#: Rows of boxes that go down the tree together.
BOXES_AT_ONCE = 256


@dataclass
class Tree:
    """Nodes in arrays: the cut dimension (-1: a leaf), the cut, and the node of smaller values; the other follows it. Leaves are numbered by ``leaf``."""

    dim: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    axes: int = 0

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``; values up to the cut lie in the first child."""
        node = np.zeros(len(x), np.int64)
        while (inner := self.dim[node] >= 0).any():
            at, rows = node[inner], np.flatnonzero(inner)
            node[rows] = self.child[at] + (x[rows, self.dim[at]] > self.cut[at])
        return self.leaf[node]

    def touched(self, low: np.ndarray, high: np.ndarray) -> list[int]:
        """The leaves that a box, its ends included, touches."""
        return self.all_touched(np.asarray(low, float)[None], np.asarray(high, float)[None])[1].tolist()

    def all_touched(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) of the leaves that each of many boxes touches, going down the tree with all boxes at once."""
        box, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        found = [(box[:0], node[:0])]
        while len(box):
            d = self.dim[node]
            ends = d < 0
            found.append((box[ends], self.leaf[node[ends]]))
            box, node, d = box[~ends], node[~ends], d[~ends]
            cut, child = self.cut[node], self.child[node]
            left, right = low[box, d] <= cut, high[box, d] > cut
            box, node = np.r_[box[left], box[right]], np.r_[child[left], child[right] + 1]
        return tuple(np.concatenate(x) for x in zip(*found))


def grown(sample: np.ndarray, leaves: int) -> Tree:
    """A tree with up to so many leaves, cut at medians of the dimension that spreads most, as a share of its whole range."""
    spread = np.maximum(np.ptp(sample, axis=0), 1e-12) if len(sample) else np.ones(sample.shape[1])
    dim, cut, child, rows = [-1], [0.0], [0], [np.arange(len(sample))]
    todo, count = [0], 1
    while todo and count < leaves:
        k = todo.pop(0)  # breadth first: leaves of about one size
        x = sample[rows[k]]
        if len(x) < 2:
            continue
        d = int(np.argmax(np.ptp(x, axis=0) / spread))
        values = np.sort(x[:, d])
        at = values[(len(values) - 1) // 2]
        if at == values[-1]:  # half and more are the greatest value: cut below it
            lower = values[values < at]
            if not len(lower):
                continue
            at = lower[-1]
        dim[k], cut[k], child[k] = d, float(at), len(dim)
        for side in (x[:, d] <= at, x[:, d] > at):
            todo.append(len(dim))
            dim.append(-1)
            cut.append(0.0)
            child.append(0)
            rows.append(rows[k][side])
        rows[k] = np.empty(0, np.int64)
        count += 1
    dims = np.array(dim)
    leaf = np.full(len(dims), -1)
    leaf[dims < 0] = np.arange((dims < 0).sum())
    return Tree(dims, np.array(cut), np.array(child), leaf, sample.shape[1])


def split(points: DataFrame, axes: list[Column], id_col: str) -> Tree:
    """The tree for ``points`` by ``axes`` (doubles without nulls), from every m-th point by a hash of its id."""
    n = points.count()
    every = -(-n // SAMPLE) or 1
    taken = points.where(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).select(*[a.cast("double").alias(f"x{k}") for k, a in enumerate(axes)]).limit(2 * SAMPLE)
    return grown(taken.toPandas().to_numpy(float).reshape(-1, len(axes)), min(-(-n // LEAF_ROWS), MOST_LEAVES))


def leaf_col(tree: Tree, axes: list[Column]) -> Column:
    """The leaf of a point."""
    @F.pandas_udf("int")
    def leaf(x: pd.DataFrame) -> pd.Series:
        return pd.Series(tree.leaf_of(x.to_numpy(float)).astype(np.int32))
    return leaf(F.struct(*[a.cast("double").alias(f"x{k}") for k, a in enumerate(axes)]))


def leaves_col(tree: Tree, boxes: Column) -> Column:
    """The distinct leaves that any box of a row touches; ``boxes`` is an array of arrays: all lower ends, then all upper ends."""
    @F.pandas_udf("array<int>")
    def leaves(rows: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(rows), BOXES_AT_ONCE):
            some = rows.iloc[at:at + BOXES_AT_ONCE]
            counts = [len(row) for row in some]
            own = np.repeat(np.arange(len(some)), counts)
            ends = np.array([np.asarray(box, float) for row in some for box in row]).reshape(len(own), 2 * tree.axes)
            box, leaf = tree.all_touched(ends[:, :tree.axes], ends[:, tree.axes:])
            met = np.unique(own[box] * len(tree.leaf) + leaf)
            out += np.split((met % len(tree.leaf)).astype(np.int32), np.searchsorted(met, np.arange(1, len(some)) * len(tree.leaf)))
        return pd.Series(out, dtype=object)
    return leaves(boxes)


def meet(points: DataFrame, boxes: DataFrame, tree: Tree, axes: list[Column], box_array: Column, id_col: str) -> DataFrame:
    """Every point joined with every box that touches its leaf's points, each pair once.

    Leaves divide all of space, also where no point lies; the ends of what a
    leaf holds tell which of its boxes can reach any point of it.
    """
    p = points.withColumn("_leaf", leaf_col(tree, axes))
    ends = [end(a.cast("double")).alias(f"_{tag}{k}") for k, a in enumerate(axes) for tag, end in (("least", F.min), ("most", F.max))]
    # a row for each leaf: MOST_LEAVES at most
    parts = F.broadcast(p.groupBy("_leaf").agg(F.ceil(F.count(F.lit(1)) / LEAF_ROWS).cast("int").alias("_parts"), *ends))
    p = p.join(parts.select("_leaf", "_parts"), "_leaf").withColumn("_part", F.pmod(F.xxhash64(id_col, F.lit("part")), F.col("_parts")).cast("int")).drop("_parts")

    def reaches(box: Column) -> Column:
        met = F.lit(True)
        for k in range(len(axes)):
            met = met & (box[k] <= F.col(f"_most{k}")) & (box[len(axes) + k] >= F.col(f"_least{k}"))
        return met
    b = (boxes.withColumn("_boxes", box_array).withColumn("_leaf", F.explode(leaves_col(tree, F.col("_boxes")))).join(parts, "_leaf").where(F.exists("_boxes", reaches))
         .select(*boxes.columns, "_leaf", F.explode(F.expr("sequence(0, _parts - 1)")).alias("_part")))
    # dealt by key on both sides: a plan by the size of the boxes' table, before it is exploded, would broadcast them and keep the points' few files as tasks
    return p.hint("merge").join(b, ["_leaf", "_part"]).drop("_leaf", "_part")
