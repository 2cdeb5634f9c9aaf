"""Near-duplicate vectors by a pigeonhole join on rotated subspaces.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. A
fixed random rotation spreads a vector's energy evenly over blocks of ``BLOCK``
dimensions; of two near vectors at least one block lies within the block's
share of that distance, in proportion to its dimensions. So each block is
joined by range alone:

* Vectors are packed into units of bounded size, each vector into one. Every pair
  of units meets in one task, which reads both from the shared folder: no vector
  is copied for a block or for another unit, so disk grows with the input alone.
* Of each unit, a block's first and third coordinates fall in bands no narrower
  than the block's radius: near blocks lie in one band or in two adjoining ones.
* Inside a cell of two bands rows are sorted by the second coordinate, a window of
  it is compared with rows of the adjoining cells by one matrix product, and what
  lies within the block's budget is verified in double precision on all dimensions.
* A pair that several blocks find belongs to the first of them, so links are
  counted once without gathering pairs. A task gives back how many links each
  vector has, and one vector of its component there, never the pairs.

Equal vectors form a class and one of them takes part, weighted by their number.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from tabwright.llm.common import parts_for, publish, table
from tabwright.llm.components import connected

COSINE = 0.95
#: Dimensions of a block.
BLOCK = 8
#: Components of a unit, and rows at most; a task holds two.
UNIT, ROWS = 1 << 22, 16384
#: Bytes of vectors that a task meets with as many others.
HELD = 64 << 20
#: Bands on either side of zero; the outer ones are open.
BANDS = 2
#: Rows of a step through a cell, candidates that are verified together.
STEP, WAITING = 128, 100_000
#: Room for rounding in budgets, and for that of single precision; what passes is verified.
SLACK, ROUNDING = 1e-9, 1e-5


@functools.lru_cache(8)
def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    """Adjoining blocks of about BLOCK dimensions."""
    edges = np.linspace(0, d, max(1, round(d / BLOCK)) + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def budgets(d: int, cosine: float) -> np.ndarray:
    """Each block's share of the squared distance, in proportion to its dimensions."""
    whole = max(2.0 - 2.0 * cosine, 0.0) * (1 + SLACK) + SLACK
    return np.array([whole * (b.stop - b.start) / d for b in blocks_of(d)])


def _raw(kind: str):
    """Vectors as the bytes of their components; null stays null."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("embedding")
            d = np.array([x or 0 for x in pc.list_value_length(lists).to_pylist()], np.int32)
            # Adding zero makes -0.0 and 0.0 one value.
            data = (lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0).tobytes()
            ends = np.cumsum(d, dtype=np.int64) * np.dtype(kind).itemsize
            v = [data[a:b] if b > a else None for a, b in zip([0, *ends.tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(d), pa.array(v, pa.binary())], ["vec_id", "d", "v"])

    return raw


def _packed(unit: int):
    """Rows (id, n, d, v) in units of equal dimension, one row each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 36
        held: dict[int, list[pd.DataFrame]] = {}

        def one(d: int) -> pd.DataFrame:
            nonlocal at
            part = pd.concat(held.pop(d))
            at += 1
            ids, n = (part[c].to_numpy("<i8").tobytes() for c in ("id", "n"))
            return pd.DataFrame([{"unit": at - 1, "d": np.int32(d), "ids": ids, "n": n, "v": b"".join(part.v)}])

        for batch in batches:
            for d, part in batch.groupby("d"):
                size = max(1, min(ROWS, unit // d))
                while len(part):
                    room = size - sum(map(len, held.get(d, [])))
                    held.setdefault(d, []).append(part[:room])
                    part = part[room:]
                    if sum(map(len, held[d])) == size:
                        yield one(d)
        for d in list(held):
            yield one(d)

    return pack


class _Block:
    """One block of a unit's vectors: cells of bands, in each rows by the second coordinate."""

    def __init__(self, part: np.ndarray, width: float) -> None:
        k = part.shape[1]
        bands = np.floor(part[:, [0, 2 if k > 2 else 0]] / width).clip(-BANDS, BANDS - 1)
        bands = np.nan_to_num(bands).astype(np.int8)  # of vectors too short for their norm
        order = np.argsort(part[:, min(1, k - 1)])
        cell = bands[:, 0] * np.int8(2 * BANDS) + bands[:, 1]
        self.order = order = order[np.argsort(cell[order], kind="stable")]
        x, cell = part[order], cell[order]
        self.second = x[:, min(1, k - 1)]
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(x)]
        self.cells = {tuple(bands[order[a]].tolist()): (a, b) for a, b in zip(edges, edges[1:])}
        # A row of left times one of right is the squared distance.
        square, ones = (x**2).sum(1)[:, None], np.ones((len(x), 1))
        self.left = np.concatenate([-2 * x, square, ones], 1, dtype=np.float32, casting="same_kind")
        self.right = np.concatenate([x, ones, square], 1, dtype=np.float32, casting="same_kind")


class _Unit:
    def __init__(self, unit: int, d: int, ids: bytes, n: bytes, v: bytes, kind: str, cosine: float) -> None:
        self.unit, self.d = unit, d
        self.ids, self.n = np.frombuffer(ids, "<i8"), np.frombuffer(n, "<i8")
        x = np.frombuffer(v, kind).reshape(len(self.ids), d).astype(float)
        self.u = (x / np.linalg.norm(x, axis=1)[:, None]) @ rotation(d)
        # Coordinates are about 1 / sqrt(d); narrower bands would hold few rows.
        widths = np.maximum(np.sqrt(budgets(d, cosine)), 0.8 / np.sqrt(d)) * (1 + 1e-6)
        self.blocks = [_Block(self.u[:, block], width) for block, width in zip(blocks_of(d), widths)]


def _close(a: _Block, b: _Block, limit: float, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b whose blocks lie within the limit, and some a little beyond."""
    reach, most = np.sqrt(limit) * (1 + 1e-6) + SLACK, np.float32(limit + ROUNDING)
    gaps, marks = np.empty(STEP * len(b.order), np.float32), np.zeros(STEP * len(b.order) + 7, bool)
    for (x, y), (start, end) in a.cells.items():
        steps = np.arange(start, end, STEP)
        least, greatest = a.second[steps] - reach, a.second[np.minimum(steps + STEP, end) - 1] + reach
        for cell in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            first, last = b.cells.get(cell, (0, 0))
            # Inside one unit each pair of cells meets once, and in one cell the later of two rows counts.
            if first == last or alone and first < start:
                continue
            low = first + np.searchsorted(b.second[first:last], least)
            high = first + np.searchsorted(b.second[first:last], greatest, "right")
            for at, lo, hi in zip(steps.tolist(), low.tolist(), high.tolist()):
                if lo >= hi:
                    continue
                x1 = a.left[at : min(at + STEP, end)]
                size = len(x1) * (hi - lo)
                np.matmul(x1, b.right[lo:hi].T, out=gaps[:size].reshape(len(x1), -1))
                np.less_equal(gaps[:size], most, out=marks[:size])
                marks[size : size + 7] = False
                # Few are marked: eight at a time are looked through.
                found = np.flatnonzero(marks[: -(-size // 8) * 8].view(np.uint64) != 0)
                if not len(found):
                    continue
                found = (found[:, None] * 8 + np.arange(8)).ravel()
                found = found[marks[found]]
                i, j = np.divmod(found, hi - lo)
                i, j = i + at, j + lo
                if alone and first == start:
                    later = j > i
                    i, j = i[later], j[later]
                yield a.order[i], b.order[j]


def _near(left: _Unit, right: _Unit, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and of right that are near, each pair once."""
    limit, starts = budgets(left.d, cosine), [block.start for block in blocks_of(left.d)]
    chunk = max(1, min(ROWS, UNIT // left.d))

    def verified(b: int, waiting: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        for s in range(0, len(i), chunk):
            p, q = i[s : s + chunk], j[s : s + chunk]
            x, y = left.u[p], right.u[q]
            ok = (x * y).sum(1) >= cosine
            if ok.any():
                p, q, square = p[ok], q[ok], (x[ok] - y[ok]) ** 2
                within = np.add.reduceat(square, starts, axis=1) <= limit
                mine = within[:, b] & ~within[:, :b].any(1)
                yield p[mine], q[mine]

    for b in range(len(starts)):
        waiting, n = [], 0
        for i, j in _close(left.blocks[b], right.blocks[b], limit[b], left is right):
            waiting.append((i, j))
            n += len(i)
            if n >= WAITING:
                yield from verified(b, waiting)
                n = 0
        if waiting:
            yield from verified(b, waiting)


class _Forest:
    """Links of a task: their number for each vector, and the components they make."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.parent, self.ids, self.n, self.count = (np.zeros(0, np.int64) for _ in range(4))

    def place(self, unit: _Unit) -> int:
        """Where the unit's vectors begin among the task's."""
        if unit.unit not in self.at:
            self.at[unit.unit] = n = len(self.ids)
            self.parent = np.append(self.parent, np.arange(n, n + len(unit.ids)))
            self.ids, self.n = np.append(self.ids, unit.ids), np.append(self.n, unit.n)
            self.count = np.append(self.count, np.zeros(len(unit.ids), np.int64))
        return self.at[unit.unit]

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = i = p[p[i]]
        return int(i)

    def roots(self, i: np.ndarray) -> np.ndarray:
        while ((up := self.parent[i]) != i).any():
            i = up
        return i

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.count, p, self.n[q])
        np.add.at(self.count, q, self.n[p])
        # Few links join two components; only these are taken one by one.
        apart = self.roots(p) != self.roots(q)
        for i, j in zip(p[apart].tolist(), q[apart].tolist()):
            a, b = self.root(i), self.root(j)
            self.parent[max(a, b)] = min(a, b)

    def rows(self) -> Iterator[pd.DataFrame]:
        """Each linked vector with its links and one vector of its component."""
        linked = np.flatnonzero(self.count)
        for s in range(0, len(linked), ROWS):
            some = linked[s : s + ROWS]
            yield pd.DataFrame({"a": self.ids[some], "b": self.ids[self.roots(some)], "links": self.count[some]})


def _links(cosine: float, kind: str):
    """Links of pairs of units: how many vector a has, and a vector b of its component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, forest = None, _Forest()
        for pairs in batches:
            for r in pairs.itertuples(index=False):
                if held is None or held.unit != r.unit:
                    held = _Unit(r.unit, r.d, r.ids, r.n, r.v, kind, cosine)
                same = r.unit == r.unit2
                other = held if same else _Unit(r.unit2, r.d2, r.ids2, r.n2, r.v2, kind, cosine)
                x, y = forest.place(held), forest.place(other)
                for p, q in _near(held, other, cosine):
                    forest.add(p + x, q + y)
        yield from forest.rows()

    return run


def _pairs(units: DataFrame, size: int) -> DataFrame:
    """Every two units of one dimension, and each unit with itself, in one row each.

    A product of partitions reads both sides where they lie; nothing is shuffled.
    A vector has a row of links for each task that finds some, so tasks are about
    twice the shuffle partitions, unless their sides grow beyond HELD bytes of the
    vectors' size.
    """
    sides = max(math.ceil((2 * parts_for(units.sparkSession)) ** 0.5), -(-size // HELD))
    units = units.coalesce(sides).withColumn("odd", F.xxhash64("unit").bitwiseAND(F.lit(1)))
    other = units.select([F.col(c).alias(f"{c}2") for c in units.columns])
    # Of the orders of two units one is taken, by turns, so partitions share the work.
    once = (F.col("unit") == F.col("unit2")) | ((F.col("odd") == F.col("odd2")) == (F.col("unit") < F.col("unit2")))
    # Written as a difference: an equality would be shuffled by.
    return units.hint("shuffle_replicate_nl").join(other, (F.col("d") - F.col("d2") == 0) & once).drop("odd", "odd2")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", unit: int = UNIT
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing, and so do vectors of different lengths and
    rows without an id. Equal vectors link with each other. An empty table gives
    an empty result.
    """
    given = F.col(f"`{vector_column}`")
    single = vectors.select(given).schema[0].dataType
    single = isinstance(single, ArrayType) and isinstance(single.elementType, FloatType)
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"), given.cast(f"array<{'float' if single else 'double'}>").alias("embedding")
    )
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(usable, F.col("embedding")))
    kind = "<f4" if single else "<f8"
    rows = publish(rows.mapInArrow(_raw(kind), "vec_id long, d int, v binary"), "vectors")
    # Vectors stay out of the joins; half a SHA-256 stands for each.
    same = rows.where("v is not null")
    keys = same.select("vec_id", "d", F.substring(F.unhex(F.sha2("v", 256)), 1, 16).alias("key"))
    classes = publish(keys.groupBy("d", "key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "classes")
    # So many tasks pack that most units are full.
    total, full = (x or 0 for x in classes.agg(F.sum("d"), F.sum(F.greatest(F.lit(1 / ROWS), F.col("d") / unit))).first())
    packed = same.groupBy("d", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).coalesce(max(1, math.ceil(full)))
    units = publish(packed.mapInPandas(_packed(unit), "unit long, d int, ids binary, n binary, v binary"), "units")
    found = publish(_pairs(units, total * np.dtype(kind).itemsize).mapInPandas(_links(cosine, kind), "a long, b long, links long"), "links")
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = connected(found.select("a", "b"))
    known = publish(
        classes.join(counts, "id", "left")
        .join(roots, "id", "left")
        .select(
            "d", "key",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("component_id"),
        ),
        "known",
    )
    members = keys.join(known, ["d", "key"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = members.unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
