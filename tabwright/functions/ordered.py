"""Running values over an explicit order when one key can hold most rows.

A window keyed by user (or by nothing) runs each key in one task. Here rows are
cut into ranges of (key, order) first, by edges taken from a sample, so a hot key
spreads over many ranges. Each range is an ordinary window; what a range needs
from its neighbours comes from a summary with one row per key and range, kept
only for keys that cross an edge: at most two rows for every edge.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import col, type_of

RANGE = "__range"
ROWS_PER_RANGE = 1_000_000
MIN_RANGES = 8
MIN_SAMPLES = 1_000
SAMPLES_PER_RANGE = 8
# Characters of a text that edges are made of.
PREFIX = 64


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, last, first, lag or lead.

    last / first are the nearest present value at or before / at or after the
    row; lag / lead are the previous / next row's value, present or not.
    """

    name: str
    kind: str
    column: str


def ranges_for(rows: int) -> int:
    return max(MIN_RANGES, -(-rows // ROWS_PER_RANGE))


def _cut_columns(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> list[Column]:
    """What edges are made of: keys and order, texts by a prefix.

    A key's prefix keeps the order within each key; in the order itself nothing
    that follows a prefix can refine it.
    """
    out = []
    for names, refines in ((keys, True), (order_by, False)):
        for name in names:
            text = isinstance(type_of(df, name), T.StringType)
            out.append(F.substring(col(name), 1, PREFIX) if text else col(name))
            if text and not refines:
                return out
    return out


def fit_edges(df: DataFrame, cut: Sequence[Column], ranges: int, rows: int) -> list[tuple]:
    """Cut points as texts, from a sample bounded by the range count.

    Of the sample in order, every step-th row is an edge; only edges reach the driver.
    """
    wanted = max(MIN_SAMPLES, ranges * SAMPLES_PER_RANGE)
    share = min(1.0, wanted / max(rows, 1))
    part = df.select(*[c.alias(f"k{i}") for i, c in enumerate(cut)])
    if share < 1.0:
        part = part.sample(False, share, seed=29)
    names = part.columns
    points = part.orderBy(*[F.col(k).asc_nulls_first() for k in names])
    found = points.select(*[F.col(k).cast("string") for k in names]).collect()
    step = max(1, len(found) // ranges)
    edges: list[tuple] = []
    for row in found[step::step]:
        if not edges or tuple(row) != edges[-1]:
            edges.append(tuple(row))
    return edges


def _edge_list(df: DataFrame, cut: Sequence[Column], edges: Sequence[tuple]) -> Column:
    """Sorted edges as one literal array of key tuples."""
    shape = df.select(*[c.alias(f"k{i}") for i, c in enumerate(cut)]).schema
    text = json.dumps([{f"k{i}": v for i, v in enumerate(e)} for e in edges])
    texts = ", ".join(f"k{i}: string" for i in range(len(cut)))
    types = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in shape.fields)
    return F.sort_array(F.from_json(F.lit(text), f"array<struct<{texts}>>").cast(f"array<struct<{types}>>"))


def assign_range(df: DataFrame, cut: Sequence[Column], edges: Sequence[tuple]) -> DataFrame:
    """Add the number of edges at or below each row, found by halving steps."""
    if not edges:
        return df.withColumn(RANGE, F.lit(0))
    here = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cut)])
    every = _edge_list(df, cut, edges)
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(edges).bit_length()))])
    number = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(every, at + step - 1) <= here, at + step).otherwise(at)
    )
    return df.withColumn(RANGE, number)


def into_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Tag rows with a range of (keys, order_by).

    ``ranges`` forces a number of ranges. ``source`` is a cheaper frame to take
    the edges from: one that ``df`` was derived from and that holds at least as
    many rows in every range.
    """
    base = df if source is None else source
    rows = base.count()
    cut = _cut_columns(df, keys, order_by)
    return assign_range(df, cut, fit_edges(base, cut, ranges or ranges_for(rows), rows))


def running(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], specs: Sequence[Running]) -> DataFrame:
    """Add running values to a frame tagged by :func:`into_ranges`; the tag stays.

    The frame is read twice, for the windows and for the summary.
    """
    here = F.struct(*[col(o) for o in order_by])
    cell = Window.partitionBy(RANGE, *[col(k) for k in keys])
    part = cell.orderBy(*[col(o).asc_nulls_first() for o in order_by])
    so_far = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Looking ahead is looking back in the opposite order: a frame that grows
    # from its far end would be read again for every row.
    ahead = cell.orderBy(*[col(o).desc_nulls_last() for o in order_by]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )

    group = Window.partitionBy(*[F.col(f"__k{i}") for i in range(len(keys))])
    earlier = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    later = group.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)

    local, tails, carries, parts = {}, [], {}, {}
    for i, s in enumerate(specs):
        x, here_name, tail, carry = col(s.column), f"__l{i}", f"__t{i}", f"__c{i}"
        if s.kind == "sum":
            local[here_name] = F.sum(x).over(so_far)
            tails.append(F.sum(x).alias(tail))
            carries[carry] = F.sum(tail).over(earlier)
            parts[s.name] = lambda own, far: F.coalesce(own, F.lit(0)) + F.coalesce(far, F.lit(0))
        elif s.kind == "last":
            local[here_name] = F.last(x, ignorenulls=True).over(so_far)
            tails.append(F.max_by(x, F.when(x.isNotNull(), here)).alias(tail))
            carries[carry] = F.last(tail, ignorenulls=True).over(earlier)
            parts[s.name] = F.coalesce
        elif s.kind == "first":
            local[here_name] = F.last(x, ignorenulls=True).over(ahead)
            tails.append(F.min_by(x, F.when(x.isNotNull(), here)).alias(tail))
            carries[carry] = F.last(tail, ignorenulls=True).over(later)
            parts[s.name] = F.coalesce
        elif s.kind in ("lag", "lead"):
            held = F.struct(x.alias("v"))
            step = F.lag if s.kind == "lag" else F.lead
            local[here_name] = step(held).over(part)
            pick = F.max_by if s.kind == "lag" else F.min_by
            tails.append(pick(held, here).alias(tail))
            carries[carry] = step(tail).over(group.orderBy(RANGE))
            parts[s.name] = lambda own, far: F.coalesce(own, far)["v"]
        else:
            raise ValueError(f"unknown running value: {s.kind}")

    kept = [col(c) for c in rows.columns]
    summary = (
        rows.groupBy(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(RANGE))
        .agg(*tails)
        .withColumn("__spans", F.count(F.lit(1)).over(group))
        .filter("__spans > 1")
        .withColumns(carries)
        .select(
            *[f"__k{i}" for i in range(len(keys))], F.col(RANGE).alias("__r"), *carries
        )
    )
    match = F.col(RANGE) == F.col("__r")
    for i, k in enumerate(keys):
        match = match & col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = rows.withColumns(local).join(F.broadcast(summary), match, "left")
    out = [join(F.col(f"__l{i}"), F.col(f"__c{i}")).alias(n) for i, (n, join) in enumerate(parts.items())]
    return joined.select(*kept, *out)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    specs: Sequence[Running],
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Running values per key in the given order, safe for hot keys.

    ``order_by`` has to order the rows of a key completely; ties have no
    defined order, as in any window.
    """
    if not order_by:
        raise ValueError("an explicit order_by is needed: rows have no order of their own")
    return running(into_ranges(df, keys, order_by, ranges, source), keys, order_by, specs).drop(RANGE)
