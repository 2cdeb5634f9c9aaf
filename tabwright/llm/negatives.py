"""Hard negatives of anchors, by inner products over STR-packed R-trees.

Rows are dealt out by their first coordinates and packed into trees: sort by one
coordinate, cut into slabs, go on with the next coordinate inside each slab
(sort-tile-recursive), until a leaf is full; adjoining nodes make the next level.
A node is the smallest box around its rows, so the inner product of an anchor
with any of them lies between two sums over coordinates: that of the lesser, and
that of the greater, of what the box's two ends give. A queue for a block of
anchors opens the box with the highest upper sum first, for those of its anchors
alone to which the box is not outside all score windows, and its upper sum not
strictly below the k-th score found.

A cell is some blocks of anchors, held, and some trees, read one after the other;
cells are dealt to tasks, every anchor meets every tree once, and each cell gives
back at most k rows for an anchor and window. One pass finds the positives; they
set the score windows of the second. Scores are exact: integers in floats while
all sums are below 2**24, in doubles below 2**53, else Python's own integers.
Where boxes prune nothing, anchors times rows remain, as matrix products of a
block and a leaf.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import parts_for, publish, table

POSITIVES = 5
NEGATIVES = 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
SCALE = 256
#: Rows of a tree and of a leaf, children of a node, anchors of a block, blocks that a cell holds.
TREE = 4096
LEAF = 128
FANOUT = 8
ANCHORS = 1024
HELD = 16


# -- trees ----------------------------------------------------------------------


def tiled(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf, by sort-tile-recursive over all coordinates.

    Coordinates of the widest spread come first. With P leaves and k coordinates
    left, a coordinate is cut into the k-th root of P slabs.
    """
    spread = np.array([float(p.max() - p.min()) for p in points.T]) if len(points) else np.zeros(points.shape[1])
    order = np.argsort(-spread, kind="stable")

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or depth == len(order):
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        slabs = math.ceil(leaves ** (1 / (len(order) - depth)) - 1e-9)
        size = -(-leaves // slabs) * leaf
        rows = rows[np.argsort(points[rows, order[depth]], kind="stable")]
        return [part for i in range(0, len(rows), size) for part in cut(rows[i : i + size], depth + 1)]

    return cut(np.arange(len(points)), 0)


@dataclass
class Tree:
    """Boxes of all levels, leaves first; ``children`` are ranges of nodes, or of rows for a leaf."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    low_label: np.ndarray
    high_label: np.ndarray
    children: np.ndarray
    leaves: int

    @staticmethod
    def build(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
        packed = tiled(points, leaf)
        order = np.concatenate(packed)
        rows, ids, labels, points = rows[order], ids[order], labels[order], points[order]
        edges = np.append(0, np.cumsum([len(p) for p in packed]))
        children = [np.stack([edges[:-1], edges[1:]], 1)]
        boxes = [[f.reduceat(x, edges[:-1]) for f, x in ((np.minimum, points), (np.maximum, points), (np.minimum, labels), (np.maximum, labels))]]
        base = 0
        while (n := len(boxes[-1][0])) > 1:
            at = np.arange(0, n, fanout)
            children.append(base + np.stack([at, np.append(at[1:], n)], 1))
            boxes.append([f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum) * 2, boxes[-1])])
            base += n
        low, high, low_label, high_label = (np.concatenate(x) for x in zip(*boxes))
        return Tree(rows, ids, labels, points, low, high, low_label, high_label, np.concatenate(children), len(packed))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with anything in each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T


class Best:
    """For each of n anchors, the first k rows by higher score, then smaller id."""

    def __init__(self, k: int, n: int = 1) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.zeros((n, k), np.int64)
        self.row = np.zeros((n, k), np.int64)

    def floor(self) -> np.ndarray:
        """Each anchor's k-th score, below which nothing can enter; -inf while places are free."""
        return self.scores[:, -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, scores, ids and rows of all places taken."""
        anchors, at = np.nonzero(self.scores > -np.inf)
        return anchors, self.scores[anchors, at], self.ids[anchors, at], self.row[anchors, at]

    @property
    def rows(self) -> list[tuple]:
        """(score, id, row) of the first anchor."""
        anchors, scores, ids, rows = (x.tolist() for x in self.found())
        return [(int(s), i, r) for a, s, i, r in zip(anchors, scores, ids, rows) if a == 0]

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, anchors: np.ndarray | None = None) -> None:
        """Rows for the first anchor, or each for the anchor named."""
        if anchors is None:
            anchors = np.zeros(len(scores), np.int64)
        floor, edge = self.scores[anchors, -1], self.ids[anchors, -1]
        keep = (scores > floor) | (scores == floor) & (ids <= edge)
        if not keep.any():
            return
        scores, ids, rows, anchors = scores[keep], ids[keep], rows[keep], anchors[keep]
        if scores.dtype == object:
            self.scores = self.scores.astype(object)
        met = np.unique(anchors)
        whose = np.append(np.repeat(met, self.k), anchors)
        scores = np.append(self.scores[met], scores)
        ids, rows = np.append(self.ids[met], ids), np.append(self.row[met], rows)
        order = np.lexsort((rows, ids, -scores, whose))
        # An anchor's old places are among its rows, so it has k or more.
        first = order[np.searchsorted(whose[order], met)[:, None] + np.arange(self.k)]
        self.scores[met], self.ids[met], self.row[met] = scores[first], ids[first], rows[first]


def search(
    tree: Tree, anchors: np.ndarray, least: np.ndarray, most: np.ndarray, fits, may_fit: np.ndarray, windows: list[tuple], best: list[Best]
) -> None:
    """Put a tree's rows into the best of each window (low, high), None for no end.

    For one anchor or a block: then ``least``, ``most`` and ``may_fit`` have a row and
    windows an end for each anchor. ``fits`` tells which rows of a leaf count,
    ``may_fit`` which nodes hold any. One queue serves the block: the box with the
    highest upper sum of any anchor comes first, and is opened for those anchors
    alone that still need it. A leaf's scores are taken once for all windows.
    """
    anchors, least, most, may_fit = map(np.atleast_2d, (anchors, least, most, may_fit))
    low, high = (
        np.stack([np.broadcast_to(none if w[side] is None else w[side], len(anchors)) for w in windows])
        for side, none in ((0, -np.inf), (1, np.inf))
    )
    enter = np.stack([np.maximum(x, found.floor()) for x, found in zip(low, best)])

    def needed(node: int) -> np.ndarray:
        # A score that can enter is in the window, and not below the k-th found.
        return may_fit[:, node] & (most[:, node] >= enter) & (least[:, node] <= high) & (enter <= high)

    waiting: list[tuple] = []

    def settle() -> None:
        # Rows of several leaves enter together, once they are as many as the anchors.
        if not waiting:
            return
        scores, i, j = map(np.concatenate, zip(*waiting))
        waiting.clear()
        if scores.dtype != object:
            scores = scores.astype(np.float64)
        for w, found in enumerate(best):
            keep = (scores >= enter[w, i]) & (scores <= high[w, i])
            if keep.any():
                found.add(scores[keep], tree.ids[j[keep]], tree.rows[j[keep]], i[keep])
                enter[w] = np.maximum(low[w], found.floor())

    queue = [(0, len(tree.children) - 1)]
    while queue:
        _, node = heapq.heappop(queue)
        need = needed(node)
        who = np.flatnonzero(need.any(axis=0))
        if not len(who):
            continue
        begin, end = tree.children[node].tolist()
        if node >= tree.leaves:
            # A box that reaches over the window's end can hold its end at most.
            ends = np.where(need, high, -np.inf).max(axis=0)[who, None]
            reach = np.minimum(most[who, begin:end], ends).max(axis=0)
            for child, bound in zip(range(begin, end), reach.tolist()):
                heapq.heappush(queue, (-bound, child))
            continue
        scores = (anchors if len(who) == len(anchors) else anchors[who]) @ tree.points[begin:end].T
        # Ends are whole numbers: those that a narrower type rounds are beyond all its scores.
        edge = np.where(need, enter, np.inf).min(axis=0)[who, None].astype(scores.dtype)
        here = (scores >= edge) & np.broadcast_to(fits(begin, end), (len(anchors), end - begin))[who]
        at = np.flatnonzero(here)
        if not len(at):
            continue
        i, j = np.divmod(at, end - begin)
        waiting.append((scores.reshape(-1)[at], who[i], begin + j))
        if sum(len(x[0]) for x in waiting) >= len(anchors):
            settle()
    settle()


# -- blocks, cells --------------------------------------------------------------

_ROWS = "row long, vec_id long, label long, anchor boolean, d int, x double, y double, v binary"
_BLOCK = "block long, d int, n int, reach double, rows binary, ids binary, labels binary, points binary, low binary, high binary, windows binary"


def _numbered(scale: float):
    """Rows with numbers of their own and vectors as whole numbers in doubles."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 36
        for part in batches:
            whole = [np.floor(np.asarray(v, np.float64) * scale) for v in part.embedding]
            yield pd.DataFrame(
                {
                    "row": np.arange(at, at + len(part)),
                    "vec_id": part.vec_id,
                    "label": part.label,
                    "anchor": part.anchor,
                    "d": [len(v) for v in whole],
                    "x": [v[0] if len(v) else 0.0 for v in whole],
                    "y": [v[1] if len(v) > 1 else 0.0 for v in whole],
                    "v": [v.astype("<f8").tobytes() for v in whole],
                }
            )
            at += len(part)

    return number


def _packed(size: int):
    """Rows (row, vec_id, label, d, v, windows) in blocks of equal dimension, one row each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 36
        held: dict[int, list[pd.DataFrame]] = {}

        def block(d: int) -> pd.DataFrame:
            nonlocal at
            part = pd.concat(held.pop(d))
            points = np.frombuffer(b"".join(part.v), "<f8").reshape(len(part), d)
            at += 1
            binary = lambda x: np.asarray(x, "<i8").tobytes()
            return pd.DataFrame(
                [
                    {
                        "block": at - 1, "d": d, "n": len(part), "reach": float(np.abs(points).max(initial=0)),
                        "rows": binary(part.row), "ids": binary(part.vec_id), "labels": binary(part.label), "points": points.tobytes(),
                        "low": b"".join(part.low), "high": b"".join(part.high), "windows": binary([len(x) // 8 for x in part.low]),
                    }
                ]
            )

        for batch in batches:
            for d, part in batch.groupby("d"):
                while len(part):
                    room = size - sum(map(len, held.get(d, [])))
                    held.setdefault(d, []).append(part[:room])
                    part = part[room:]
                    if sum(map(len, held[d])) == size:
                        yield block(d)
        for d in list(held):
            yield block(d)

    return pack


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _kind(most: float):
    """The narrowest type in which whole numbers up to ``most`` are exact."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def _exact(points: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return points.astype(kind)
    whole = np.empty(points.shape, object)
    whole[...] = [[int(x) for x in p] for p in points]
    return whole


class _Block:
    """A block of anchors with the best rows in each of their windows."""

    def __init__(self, r, k: int, same: bool) -> None:
        self.d, self.reach = r.d, r.reach
        self.rows, self.labels = _numbers(r.rows), _numbers(r.labels)
        self.points = np.frombuffer(r.points, "<f8").reshape(r.n, r.d)
        if same:
            self.windows = None
            self.best = [Best(k, r.n)]
            return
        counts = _numbers(r.windows)
        at = np.repeat(np.arange(r.n), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        # Places without a window have one that nothing fits.
        self.windows = [np.full((r.n, counts.max(initial=1)), end, object) for end in (np.inf, -np.inf)]
        for ends, given in zip(self.windows, (r.low, r.high)):
            ends[at] = _numbers(given)
        self.best = [Best(k, r.n) for _ in range(counts.max(initial=1))]

    def meet(self, tree: Tree, kind) -> None:
        anchors, mine = _exact(self.points, kind), self.labels[:, None]
        least, most = tree.bounds(anchors)
        if self.windows is None:
            windows = [(None, None)]
            may_fit = (tree.low_label <= mine) & (mine <= tree.high_label)
            fits = lambda a, b: (tree.labels[a:b] == mine) & (tree.rows[a:b] != self.rows[:, None])
        else:
            windows = list(zip(*(ends.T if kind is object else ends.T.astype(np.float64) for ends in self.windows)))
            may_fit = (tree.low_label != mine) | (tree.high_label != mine)
            fits = lambda a, b: tree.labels[a:b] != mine
        search(tree, anchors, least, most, fits, may_fit, windows, self.best)

    def found(self) -> Iterator[pd.DataFrame]:
        for w, best in enumerate(self.best):
            anchors, scores, ids, rows = best.found()
            if len(anchors):
                columns = {"anchor": self.rows[anchors], "window": w, "score": scores.astype(np.int64), "vec_id": ids, "row": rows}
                yield pd.DataFrame(columns)


def _found(k: int, same: bool, leaf: int, fanout: int):
    """For the anchors of a cell, the first k rows in each window among its trees.

    Blocks of anchors come first in a cell. ``same`` asks for other rows of the
    anchor's label, else for rows of other labels.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (r.g, r.h) != cell:
                    for block in held:
                        yield from block.found()
                    cell, held = (r.g, r.h), []
                if r.side == 0:
                    held.append(_Block(r, k, same))
                    continue
                points = np.frombuffer(r.points, "<f8").reshape(r.n, r.d)
                trees: dict = {}
                for block in held:
                    if block.d != r.d:
                        continue
                    kind = _kind(r.d * r.reach * block.reach)
                    if kind not in trees:
                        trees[kind] = Tree.build(_numbers(r.rows), _numbers(r.ids), _numbers(r.labels), _exact(points, kind), leaf, fanout)
                    block.meet(trees[kind], kind)
        for block in held:
            yield from block.found()

    return find


def _search_all(anchors: DataFrame, trees: DataFrame, k: int, same: bool, cells: tuple[int, int], leaf: int, fanout: int) -> DataFrame:
    """(anchor, window, score, vec_id, row): the first k of each anchor and window."""
    g, h = cells
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = (
        anchors.withColumns({"side": F.lit(0), "h": part(h)}).withColumn("g", every(g))
        .unionByName(trees.withColumns({"side": F.lit(1), "g": part(g)}).withColumn("h", every(h)))
    )
    dealt = both.repartitionByRange(g * h, "g", "h").sortWithinPartitions("g", "h", "side", "block")
    found = dealt.mapInPandas(_found(k, same, leaf, fanout), "anchor long, window int, score long, vec_id long, row long")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    tree: int = TREE,
    leaf: int = LEAF,
    fanout: int = FANOUT,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` is a condition on the rows of vectors. Each component becomes
    floor(scale * x); scores are inner products of these. An anchor's positives are
    its first other rows of the same label, its negatives for a positive the first
    rows of other labels with low * positive <= 100 * negative <= high * positive;
    higher scores come first, ties by smaller id.

    Rows without id, label or vector, or with a component that is null or not
    finite, take no part. Vectors of different lengths do not meet. Rows that
    repeat an id, or repeat altogether, are rows of their own. Anchors without
    positives, and positives without negatives, give no row. An empty table gives
    an empty result. Scores beyond 64 bits raise.
    """
    spark = vectors.sparkSession
    kind = label if isinstance(label, Column) else F.col(f"`{label}`")
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        kind.cast("long").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        F.col(f"`{vector_column}`").cast("array<double>").alias("embedding"),
    )
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", fine))
    rows = publish(rows.mapInPandas(_numbered(scale), _ROWS), "vectors")
    none = F.lit(b"")
    columns = ["row", "vec_id", "label", "d", "v"]
    # Trees and blocks have few labels: most trees hold no positive of a block.
    order = ["d", "label", "x", "y", "row"]
    near = rows.repartitionByRange(parts_for(spark), *order).sortWithinPartitions(*order)
    trees = publish(near.select(*columns, none.alias("low"), none.alias("high")).mapInPandas(_packed(tree), _BLOCK), "trees")
    chosen = rows.where("anchor")
    asked = publish(chosen.sortWithinPartitions(*order).select(*columns, none.alias("low"), none.alias("high")).mapInPandas(_packed(ANCHORS), _BLOCK), "anchors")
    # The anchors that a cell holds are bounded; trees are read one by one. As each cell gives
    # rows for all its anchors, there are no more cells than full trees.
    total = lambda blocks: blocks.agg(F.sum("n")).first()[0] or 0
    h = max(1, -(-total(asked) // (HELD * ANCHORS)))
    cells = (max(1, min(-(-parts_for(spark) // h), -(-total(trees) // tree))), h)
    first = _search_all(asked, trees, positives, True, cells, leaf, fanout)
    first = publish(first.select("anchor", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    lists = first.groupBy(F.col("anchor").alias("row")).agg(  # at most so many as there are positives
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("found")
    )

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Least and greatest whole scores of each positive's window.
        for part in batches:
            ends = [[(-(-low * int(s) // 100), high * int(s) // 100) for s in scores] for scores in part.scores]
            binary = lambda side: [np.array([e[side] for e in one], "<i8").tobytes() for one in ends]
            yield part.drop(columns="scores").assign(low=binary(0), high=binary(1))

    framed = chosen.join(lists.select("row", F.col("found.positive_score").alias("scores")), "row")
    framed = framed.sortWithinPartitions(*order).select(*columns, "scores")
    framed = framed.mapInPandas(windows, "row long, vec_id long, label long, d int, v binary, low binary, high binary")
    framed = publish(framed.mapInPandas(_packed(ANCHORS), _BLOCK), "windows")
    second = _search_all(framed, trees, negatives, False, cells, leaf, fanout)
    names = chosen.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = first.join(names, "anchor").withColumn("window", (F.col("rank") - 1).cast("int")).drop("rank")
    out = second.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["anchor", "window"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are rows whose vec_id 50 divides; where 7 divides it the label is one further."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0, label=label)


OP11_SQL = """
with e as (
    select row_number() over () as r, vec_id,
           case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
    select a.r as anchor, a.vec_id as anchor_id, e.r, e.vec_id, e.label = a.label as same,
           cast(list_inner_product(a.v, e.v) as bigint) as score
    from e as a join e on a.vec_id % 50 = 0 and a.r <> e.r and len(a.v) = len(e.v)),
p as (
    select anchor, anchor_id, vec_id as positive_id, score as positive_score,
           row_number() over (partition by anchor order by score desc, vec_id, r) as place
    from s where same
    qualify place <= 5),
n as (
    select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
           row_number() over (partition by p.anchor, p.place order by s.score desc, s.vec_id, s.r) as rank
    from p join s on s.anchor = p.anchor and not s.same
     and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from n where rank <= 3"""
