"""Records of large text files when a record may hold what parts records.

A line end inside quotes does not end a CSV record, nor does every ``}`` end one of
a JSON array. Spark's text reader still cuts such files into splits at these
marks. What a split begins with depends on all before it, so it is read in two
passes:

1. Each split gives its *effect*: for each state it could begin in, the state that
   it ends in (quoted or not; for JSON also how much deeper). Effects are put
   together in order of the splits, one short row for each.
2. Knowing its state, each split joins its units to records. What is left at its
   two ends are fragments, at most two a split, and are stitched by a window over
   these alone.

The records are written once to shared storage and read from there, because both
passes must see the same splits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.session import fresh_folder

#: Kinds of assembled rows.
WHOLE, HEAD, THROUGH, TAIL = 0, 1, 2, 3
_OUT = "file string, begin long, kind int, first boolean, text string"


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Splits do not depend on how many executors there are at the moment."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def units(spark: SparkSession, path: str | list[str], mark: str) -> DataFrame:
    """(file, begin, value): what stands between marks, in order within a split."""
    text = spark.read.option("lineSep", mark).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")


def _runs(part: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Rows of one split, as far as the batch holds them."""
    begin, file = part["begin"].to_numpy(), part["file"].to_numpy()
    cuts = np.flatnonzero((begin[1:] != begin[:-1]) | (file[1:] != file[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        if b > a:
            yield (file[a], int(begin[a])), part.iloc[a:b]


def _stitched(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """(file, text, first, closed): whole records, and those put together from fragments."""
    rows = spark.read.schema(_OUT).parquet(path)
    order = Window.partitionBy("file").orderBy("begin", "kind")
    numbered = rows.where(F.col("kind") != WHOLE).withColumn(
        "record", F.sum((F.col("kind") == TAIL).cast("long")).over(order)
    )
    joined = numbered.groupBy("file", "record").agg(  # the pieces of one record
        F.concat_ws(mark, F.transform(F.sort_array(F.collect_list(F.struct("begin", "kind", "text"))), lambda x: x["text"])).alias("text"),
        F.max("first").alias("first"),
        F.max(F.col("kind") == HEAD).alias("closed"),
    )
    whole = rows.where(F.col("kind") == WHOLE).select("file", "text", "first", F.lit(True).alias("closed"))
    return whole.unionByName(joined.select("file", "text", "first", "closed"))


def _assembled(
    spark: SparkSession,
    rows: DataFrame,
    mark: str,
    states: dict[str, int],
    ends: Callable[[pd.DataFrame, dict], np.ndarray],
    within: Callable[[dict], bool],
) -> DataFrame:
    """Write the records of units that carry the state their split begins in.

    ``ends`` tells after which units a record ends and carries the running state on
    in a dictionary that starts with ``states`` of the split. ``bare`` tells that a
    split's first unit begins a record if its state is all zero.
    """

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, held, run, whole, inside = None, [], {}, 0, False

        def rest() -> list[tuple]:
            if split is None or not held:
                return []
            kind = THROUGH if inside else TAIL
            return [(*split, kind, split[1] == 0 and whole == 0 and not inside, mark.join(held))]

        for batch in batches:
            out: list[tuple] = []
            for here, part in _runs(batch):
                if here != split:
                    out += rest()
                    split, held, whole = here, [], 0
                    run = {k: int(part[k].iloc[0]) for k in states}
                    inside = within(run)
                done = ends(part, run)
                values = part["value"].tolist()
                at = 0
                for stop in (np.flatnonzero(done) + 1).tolist():
                    text = mark.join([*held, *values[at:stop]]) if held or stop - at > 1 else values[at]
                    if not inside and not text.strip():
                        held, at = [], stop
                        continue
                    out.append((*here, HEAD if inside else WHOLE, here[1] == 0 and whole == 0 and not inside, text))
                    held, at, inside = [], stop, False
                    whole += 1
                held += values[at:]
            if out:
                yield pd.DataFrame(out, columns=["file", "begin", "kind", "first", "text"])
        out = rest()
        if out:
            yield pd.DataFrame(out, columns=["file", "begin", "kind", "first", "text"])

    path = fresh_folder(spark, "records")
    rows.mapInPandas(assemble, _OUT).write.parquet(path)
    return _stitched(spark, path, mark)


def _with_states(rows: DataFrame, entry: DataFrame, states: dict[str, int]) -> DataFrame:
    """Rows with what their split begins in; splits without an entry have the first state.

    ``entry`` has one short row a split, fewer than a millionth of the bytes.
    """
    joined = rows.join(F.broadcast(entry), ["file", "begin"], "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(v)).cast("int") for k, v in states.items()})


# -- delimited text ---------------------------------------------------------------


def _patterns(sep: str, end: str) -> tuple[str, str]:
    """Lines that end inside quotes, begun outside of them and inside of them."""
    s = re.escape(sep)
    quoted = r'[^"]*+(?:""[^"]*+)*+'
    fields = rf'(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+'
    return rf'^{fields}"{quoted}{end}', rf'^{quoted}(?:{end}|"[^{s}]*+{s}{fields}"{quoted}{end})'


def _open(value: Column, sep: str) -> tuple[Column, Column]:
    outside, inside = _patterns(sep, r"\z")
    return value.rlike(outside), value.rlike(inside)


def has_open_lines(spark: SparkSession, path: str | list[str], sep: str) -> bool:
    """Whether any record goes on over a line end: the first such line of a file begins outside quotes."""
    lines = units(spark, path, "\n").where(F.col("value").contains('"'))
    return not lines.where(_open(F.col("value"), sep)[0]).isEmpty()


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each split, the state it ends in if it begins outside and inside quotes."""
    split, ends = None, [0, 1]
    for batch in batches:
        out = []
        for here, part in _runs(batch):
            if here != split:
                if split is not None:
                    out.append((*split, *ends))
                split, ends = here, [0, 1]
            for code in part["code"].tolist():
                ends = [code >> s & 1 for s in ends]
        if out:
            yield pd.DataFrame(out, columns=["file", "begin", "outside", "inside"])
    if split is not None:
        yield pd.DataFrame([(*split, *ends)], columns=["file", "begin", "outside", "inside"])


def _entry_states(effects: DataFrame) -> DataFrame:
    """(file, begin, quoted) of splits that begin inside quotes.

    A split either fixes its end state or keeps or turns its first one; so a split
    begins in what the last fixing split before it gave, turned as often as splits
    in between turn it.
    """
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside"))
    turned = (F.col("outside") > F.col("inside")).cast("int")
    order = Window.partitionBy("file").orderBy("begin")
    turns = effects.withColumn("turns", F.sum(turned).over(order))
    known = F.when(fixed.isNotNull(), F.struct(fixed.alias("state"), "turns"))
    before = turns.select(
        "file", "begin", F.col("turns") - turned, F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ).toDF("file", "begin", "turns", "known")
    state = F.pmod(F.coalesce(F.col("known.state"), F.lit(0)) + F.col("turns") - F.coalesce(F.col("known.turns"), F.lit(0)), F.lit(2))
    return before.select("file", "begin", state.cast("int").alias("quoted")).where("quoted = 1")


def csv_records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """(file, text, first): each record with its line ends, ``first`` for a file's header.

    Records end with a line feed, or one after a carriage return. Blank lines
    between records are left out, before the header too. A quote that is never
    closed raises.
    """
    with same_splits(spark):
        lines = units(spark, path, "\n")
        outside, inside = _open(F.col("value"), sep)
        code = outside.cast("int") + inside.cast("int") * 2
        # Every split has a row here, those that leave states as they are too.
        marked = lines.select("file", "begin", code.alias("code"))
        effects = marked.mapInPandas(_effects, "file string, begin long, outside int, inside int")
        effects_path = fresh_folder(spark, "effects")
        effects.write.parquet(effects_path)
        effects = spark.read.parquet(effects_path)
        compiled = [re.compile(p) for p in _patterns(sep, r"\Z")]

        def ends(part: pd.DataFrame, run: dict) -> np.ndarray:
            values, quoted = part["value"].tolist(), run["quoted"]
            done = np.ones(len(values), bool)
            for i, text in enumerate(values):
                if '"' in text:
                    quoted = int(compiled[quoted].match(text) is not None)
                done[i] = not quoted
            run["quoted"] = quoted
            return done

        states = {"quoted": 0}
        found = _assembled(spark, _with_states(lines, _entry_states(effects), states), "\n", states, ends, lambda run: run["quoted"] == 1)
    if not found.where("not closed").isEmpty():
        raise ValueError("a quote is never closed")
    return found.select("file", F.regexp_replace("text", r"\r\z", "").alias("text"), "first")


# -- arrays of objects ------------------------------------------------------------


def _net(text: Column) -> Column:
    """Opening less closing brackets, strings left out."""
    bare = F.regexp_replace(text, r'"[^"]*+(?:"|\z)', "")
    opened, closed = (F.length(bare) - F.length(F.translate(bare, both, "")) for both in ("{[", "]}"))
    return opened - closed


def _depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each split: whether it turns the string state, and its depth from either state."""
    split, turn, depth = None, 0, [0, 0]
    columns = ["file", "begin", "turn", "outside", "inside"]
    for batch in batches:
        out = []
        for here, part in _runs(batch):
            if here != split:
                if split is not None:
                    out.append((*split, turn, *depth))
                split, turn, depth = here, 0, [0, 0]
            state, after = _string_states(part, turn)
            nets = np.stack([part["outside"], part["inside"]])
            for s in (0, 1):
                depth[s] += int(nets[state ^ s, np.arange(len(state))].sum())
            turn = after
        if out:
            yield pd.DataFrame(out, columns=columns)
    if split is not None:
        yield pd.DataFrame([(*split, turn, *depth)], columns=columns)


def _string_states(part: pd.DataFrame, state: int) -> tuple[np.ndarray, int]:
    """Whether each unit begins inside a string, and whether the next one would."""
    turns = part["turn"].to_numpy()
    after = np.bitwise_xor.accumulate(np.append(state, turns))
    return after[:-1], int(after[-1])


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(text, first): the objects of each file's one array.

    Raises if a file holds anything but one array of objects.
    """
    with same_splits(spark):
        chunks = units(spark, path, "}")
        plain = F.regexp_replace("value", r"\\.", "")
        turn = F.pmod(F.length(plain) - F.length(F.translate(plain, '"', "")), F.lit(2)).cast("int")
        # The mark that ended a unit closes a bracket unless it is in a string.
        outside = _net(plain) - F.when(turn == 0, 1).otherwise(0)
        inside = _net(F.concat(F.lit('"'), plain)) - F.when(turn == 1, 1).otherwise(0)
        marked = chunks.select("file", "begin", "value", turn.alias("turn"), outside.cast("int").alias("outside"), inside.cast("int").alias("inside"))
        effects_path = fresh_folder(spark, "effects")
        marked.drop("value").mapInPandas(_depths, "file string, begin long, turn int, outside int, inside int").write.parquet(effects_path)
        order = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        effects = spark.read.parquet(effects_path).withColumn("string", F.pmod(F.coalesce(F.sum("turn").over(order), F.lit(0)), F.lit(2)))
        change = F.when(F.col("string") == 0, F.col("outside")).otherwise(F.col("inside"))
        entry = effects.withColumn("depth", F.coalesce(F.sum(change).over(order), F.lit(0))).select("file", "begin", "string", "depth")

        def ends(part: pd.DataFrame, run: dict) -> np.ndarray:
            state, after = _string_states(part, run["string"])
            nets = np.stack([part["outside"], part["inside"]])[state, np.arange(len(part))]
            depth = run["depth"] + np.cumsum(nets)
            run["string"], run["depth"] = after, int(depth[-1])
            # Depth one is the array's; inside a string the mark ends nothing.
            return (depth == 1) & ((state ^ part["turn"].to_numpy()) == 0)

        states = {"string": 0, "depth": 0}
        found = _assembled(spark, _with_states(marked, entry, states), "}", states, ends, lambda run: run["depth"] > 1)
    files = effects.select(F.count_distinct("file")).first()[0]
    if found.where("not closed").count() != files:
        raise ValueError("an array does not end")
    # A record's text begins with what parts it from the one before.
    text = F.col("text")
    lead = F.regexp_extract(text, r"^\s*+([\[,]?)\s*+(?=\{)", 1)
    object_ = F.regexp_replace(text, r"^[^{]*+", "")
    closed = F.col("closed")
    fits = F.when(closed, (lead == F.when(F.col("first"), "[").otherwise(",")) & (F.length(object_) > 0)).otherwise(
        text.rlike(r"^\s*+\]\s*\z") & ~F.col("first") | text.rlike(r"^\s*+\[\s*+\]\s*\z") & F.col("first")
    )
    wrong = found.where(~F.coalesce(fits, F.lit(False))).select(F.substring("text", 1, 80)).head(1)
    if wrong:
        raise ValueError(f"more than one JSON document, or not an array of objects: {wrong[0][0]!r}")
    return found.where(closed).select(F.concat(object_, F.lit("}")).alias("text"), "first")
