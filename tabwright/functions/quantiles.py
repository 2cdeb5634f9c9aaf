"""Exact quantiles (linear between ranks) without sorting or holding a column.

A bounded sketch gives pivots around each wanted rank; one aggregate counts the
rows on and between them. The rows between two pivots are a small share of the
column, so two or three passes reach a slice small enough to sort, whatever the
size of the table. Heavy repeated values fall on a pivot and end the search.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabwright.functions.columns import col, number
from tabwright.functions.joins import join_lookup
from tabwright.functions.ordered import RANGE, Running, into_ranges, running
from tabwright.session import written

ACCURACY = 10_000
MARGIN = 3.0 / ACCURACY
SLICE = 50_000
PLACES = 100_000


def finite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) < F.lit(math.inf))


@dataclass
class _Search:
    """Ranks of one column whose values lie strictly between low and high."""

    column: str
    ranks: list[int]
    rows: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    pivots: list[float] | None = None

    def values(self, x: Column) -> Column:
        """The column inside the interval, NULL elsewhere."""
        cond = finite(x)
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return F.when(cond, x)

    def splits(self) -> list[float]:
        """Bucket edges: odd buckets hold one pivot, even ones lie between."""
        edges = [-math.inf]
        for p in self.pivots:
            edges += [p, math.nextafter(p, math.inf)]
        return [*edges, math.inf]

    def split(self, counts: Mapping[int, int], found: dict[tuple[str, int], float]) -> list["_Search"]:
        """Ranks on a pivot are found; the others stay open in their gap."""
        ends = [self.low, *self.pivots, self.high]
        parts, start = [], self.below
        for place in range(2 * len(self.pivots) + 1):
            n = counts.get(place, 0)
            here = [r for r in self.ranks if start <= r < start + n]
            if here and place % 2:
                found.update({(self.column, r): self.pivots[place // 2] for r in here})
            elif here:
                parts.append(_Search(self.column, here, n, start, ends[place // 2], ends[place // 2 + 1]))
            start += n
        return parts


def _beside(shares: Sequence[float]) -> list[float]:
    """Shares just below and above each share, wider than the sketch's error."""
    around = {max(0.0, s - MARGIN) for s in shares} | {min(1.0, s + MARGIN) for s in shares}
    return sorted(around)


def _distinct(pivots: Sequence[float]) -> list[float]:
    return sorted({p + 0.0 for p in pivots if math.isfinite(p)})


def _tall(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(t, v): one row per row and expression, present values only."""
    wide = df.select(*[c.alias(f"t{i}") for i, c in enumerate(columns)])
    return wide.unpivot([], [f"t{i}" for i in range(len(columns))], "t", "v").filter("v is not null")


def _narrow(df: DataFrame, searches: list[_Search], found: dict[tuple[str, int], float]) -> list[_Search]:
    """Count the rows on and between the pivots of every search, in one job."""
    values = df.select(*[s.values(number(df, s.column)).alias(f"x{i}") for i, s in enumerate(searches)])
    buckets = Bucketizer(
        splitsArray=[s.splits() for s in searches],
        inputCols=values.columns,
        outputCols=[f"b{i}" for i in range(len(searches))],
        handleInvalid="keep",
    ).transform(values)
    places = [F.col(f"b{i}").cast("int") + F.lit(i * PLACES) for i in range(len(searches))]
    counts: dict[int, dict[int, int]] = {i: {} for i in range(len(searches))}
    for r in _tall(buckets, places).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["v"] // PLACES][r["v"] % PLACES] = r["n"]
    return [part for i, s in enumerate(searches) for part in s.split(counts[i], found)]


def _pick(df: DataFrame, searches: list[_Search], found: dict[tuple[str, int], float]) -> None:
    """Sort the few values left to each search and take its ranks."""
    kept = F.array_sort(F.collect_list("v"))
    slices = _tall(df, [s.values(number(df, s.column)) for s in searches]).groupBy("t").agg(kept.alias("kept"))
    spots = None
    for i, s in enumerate(searches):
        these = F.array(*[F.lit(r - s.below) for r in s.ranks])
        cond = F.col("t") == f"t{i}"
        spots = F.when(cond, these) if spots is None else spots.when(cond, these)
    rows = slices.select("t", F.transform(spots, lambda at: F.get(F.col("kept"), at)).alias("values")).collect()
    for r in rows:
        s = searches[int(r["t"][1:])]
        found.update({(s.column, rank): v for rank, v in zip(s.ranks, r["values"])})


def _solve(df: DataFrame, searches: list[_Search]) -> dict[tuple[str, int], float]:
    found: dict[tuple[str, int], float] = {}
    small: list[_Search] = []
    while searches:
        small += [s for s in searches if s.rows <= SLICE]
        searches = [s for s in searches if s.rows > SLICE]
        bare = [s for s in searches if s.pivots is None]
        if bare:
            row = df.agg(
                *[
                    F.percentile_approx(
                        s.values(number(df, s.column)), _beside([(r - s.below) / s.rows for r in s.ranks]), ACCURACY
                    ).alias(f"p{i}")
                    for i, s in enumerate(bare)
                ]
            ).first()
            for i, s in enumerate(bare):
                s.pivots = _distinct(row[f"p{i}"])
        if searches:
            searches = _narrow(df, searches, found)
    if small:
        _pick(df, small, found)
    return found


def blend(low: float, high: float, share: float) -> float:
    """Linear between two ranks; on the way to or from an infinity, that infinity."""
    if share == 0 or low == high or math.isinf(low):
        return low
    return low + (high - low) * share


def fit_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int | None = None
) -> dict[str, list[float | None]]:
    """Quantiles of the present values of several columns at once.

    ``accuracy=None`` is exact; an integer asks for the sketch alone, with
    relative rank error ``1/accuracy``.
    """
    return quantiles_beside(df, wanted, accuracy, [])[0] if wanted else {}


def quantiles_beside(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    accuracy: int | None,
    others: Sequence[Column],
    needed: Callable[[Row], Iterable[str]] | None = None,
) -> tuple[dict[str, list[float | None]], Row]:
    """The same, with other aggregates taken in the first pass over the table.

    ``needed`` picks from their row the columns whose quantiles are searched for.
    """
    wanted = {c: list(p) for c, p in wanted.items()}
    names = list(wanted)
    first = list(others)
    for i, c in enumerate(names):
        x = number(df, c)
        if accuracy is None:
            first.append(F.count_if(x == -math.inf).alias(f"__b{i}"))
            first.append(F.count_if(x == math.inf).alias(f"__a{i}"))
            x = F.when(finite(x), x)
        first.append(F.count(x).alias(f"__n{i}"))
        probs = wanted[c] if accuracy is not None else _beside(wanted[c])
        first.append(F.percentile_approx(x, probs, accuracy or ACCURACY).alias(f"__p{i}"))
    row = df.agg(*first).first()
    place = {c: i for i, c in enumerate(names)}
    if needed is not None:
        keep = set(needed(row))
        names = [c for c in names if c in keep]
    if accuracy is not None:
        return {c: list(row[f"__p{place[c]}"] or [None] * len(wanted[c])) for c in names}, row
    searches, out = [], {}
    ends: dict[str, tuple[int, int, int]] = {}
    for c in names:
        i = place[c]
        below, rows, above = ends[c] = row[f"__b{i}"], row[f"__n{i}"], row[f"__a{i}"]
        total = below + rows + above
        spots = {f(p * (total - 1)) - below for p in wanted[c] for f in (math.floor, math.ceil)} if total else set()
        ranks = sorted(r for r in spots if 0 <= r < rows)
        if ranks:
            searches.append(_Search(c, ranks, rows, pivots=_distinct(row[f"__p{i}"])))
    found = _solve(df, searches)

    def at_rank(c: str, rank: int) -> float:
        below, rows, _ = ends[c]
        if rank < below:
            return -math.inf
        return found[c, rank - below] if rank - below < rows else math.inf

    for c in names:
        total = sum(ends[c])
        spots = [p * (total - 1) for p in wanted[c]]
        out[c] = [
            blend(at_rank(c, math.floor(at)), at_rank(c, math.ceil(at)), at - math.floor(at)) if total else None
            for at in spots
        ]
    return out, row


@dataclass(frozen=True)
class GroupQuantiles:
    """``table``: keys, n and the quantiles; ``values``: keys, __v, __n (equal
    values may come in several rows)."""

    table: DataFrame
    values: DataFrame


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probs: Sequence[float],
    names: Sequence[str],
    ranges: int | None = None,
) -> GroupQuantiles:
    """Exact quantiles per group.

    Equal values collapse before the shuffle, a hot group is cut into ranges of
    its values, and running counts give the ranks. The counted values are
    written once: ranks, totals and what the caller does with them read that.
    """
    rows = df.select(*[col(k) for k in keys], number(df, column).alias("__v")).filter("__v is not null")
    by = [col(k) for k in keys]
    counted = written(rows.groupBy(*by, F.col("__v")).agg(F.count(F.lit(1)).alias("__n")), "counted")
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("__total")).withColumn("__weight", F.col("__total"))
    ranged = into_ranges(counted, keys, ["__v"], ranges)
    ranked = running(ranged, keys, ["__v"], [Running("__upto", "sum", "__n")])
    ranked = join_lookup(ranked.drop(RANGE), totals, keys, weight="__weight")
    return GroupQuantiles(_from_ranks(ranked, keys, probs, names), counted)


#: Smallest and largest size of a sketch, as Spark has it.
SKETCH = (8, 65535)


def sketched_quantiles(
    df: DataFrame, keys: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str], accuracy: int
) -> GroupQuantiles:
    """Quantiles per group from mergeable sketches of ``accuracy`` items (KLL).

    One aggregate: a task sends one sketch for each of its groups, whatever the rows
    behind it, and no value is shuffled or written. A quantile is a value of the
    group whose rank is off by about 1.7 / accuracy ** 0.9 of the rows (99 in 100
    times), 1.4 % at 200. Sketches draw by chance: two runs may differ by as much.
    ``values`` are the rows themselves, once each.
    """
    if not SKETCH[0] <= accuracy <= SKETCH[1]:
        raise ValueError(f"accuracy has to be from {SKETCH[0]} to {SKETCH[1]}")
    rows = df.select(*[col(k) for k in keys], number(df, column).alias("__v")).filter("__v is not null")
    sketch = F.kll_sketch_agg_double("__v", F.lit(accuracy)).alias("__sketch")
    found = rows.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"), sketch)
    cells = [F.kll_sketch_get_quantile_double("__sketch", F.lit(float(p))).alias(name) for p, name in zip(probs, names)]
    table = found.filter("n > 0").select(*[col(k) for k in keys], "n", *cells)
    return GroupQuantiles(table, rows.withColumn("__n", F.lit(1).cast("bigint")))


def _from_ranks(ranked: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    start = F.col("__upto") - F.col("__n")
    aggs, outs = [], []
    for i, (p, name) in enumerate(zip(probs, names)):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((start <= rank) & (rank < F.col("__upto")), F.col("__v"))).alias(f"__{side}{i}"))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outs.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return (
        ranked.groupBy(*[col(k) for k in keys])
        .agg(F.max("__total").alias("__total"), *aggs)
        .select(*[col(k) for k in keys], F.col("__total").alias("n"), *outs)
    )
