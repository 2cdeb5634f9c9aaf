"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (lines, taken sentence by sentence) become 64-bit digests,
the second of equal ones told from the first. A sketch has a fixed number of
cells; a digest goes to one cell of each of three parts, adding to its count and
to the exclusive or of its digests and of their checks. Two sketches of one size
subtract cell by cell, and what is left holds only the paragraphs in which the
texts differ: cells with a single digest give it away, and taking it out of its
other cells frees more. Where peeling ends early the sketches were too small,
and larger ones are made.

The fingerprint is the sketch of the smallest size, as text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.ordered import RANGE, assign_range
from tabwright.llm.common import only, parts_for, publish, table
from tabwright.llm.rolling import mix

#: Cells of the fingerprint, in three parts.
CELLS = 15
#: How much larger the next sketches are when peeling fails.
GROWTH = 3
PARTS = 3

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)[:, None]
_CHECK = np.uint64(0x082EFA98EC4E6C89)
_TRUE = np.ones(1, bool)
_PART_NUMBERS = np.arange(PARTS)[:, None]


def paragraph_digests(text: str, known: dict[str, int] | None = None) -> np.ndarray:
    """A 64-bit number for each paragraph; equal ones are told apart by their turn."""
    known = {} if known is None else known
    seen: dict[int, int] = {}
    out = []
    for part in _SENTENCE.split(text):
        part = part.strip()
        if not part:
            continue
        d = known.get(part)
        if d is None:
            raw = part.encode("utf-8", "surrogatepass")
            d = known[part] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        turn = seen.get(d, 0)
        seen[d] = turn + 1
        out.append((d + turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


@dataclass
class Sketch:
    """Cells in three parts: counts, and xors of digests and of their checks."""

    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    @classmethod
    def of(cls, digests: np.ndarray, cells: int, hashes: np.ndarray | None = None, times: np.ndarray | None = None) -> "Sketch":
        """The sketch of digests, each counted once or so many times; their hashes if they are there already."""
        size = cells // PARTS
        out = cls(np.zeros(size * PARTS, np.int64), np.zeros(size * PARTS, np.uint64), np.zeros(size * PARTS, np.uint64))
        out._add(digests, _hashes(digests) if hashes is None else hashes, np.ones(len(digests), np.int64) if times is None else times)
        return out

    def _add(self, digests: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> None:
        if not len(digests):
            return
        size = len(self.count) // PARTS
        at = ((hashes[:PARTS] % np.uint64(size)).astype(np.int64) + _PART_NUMBERS * size).ravel()
        np.add.at(self.count, at, np.concatenate([times] * PARTS))
        np.bitwise_xor.at(self.key, at, np.concatenate([digests] * PARTS))
        np.bitwise_xor.at(self.check, at, np.concatenate([hashes[PARTS]] * PARTS))

    def __sub__(self, other: "Sketch") -> "Sketch":
        return Sketch(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only the first has, only the second has; None if some stay hidden."""
        sides: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        while True:
            single = (np.abs(self.count) == 1).nonzero()[0]
            keys = self.key[single]
            hashes = _hashes(keys)
            pure = (self.check[single] == hashes[PARTS]).nonzero()[0]
            if not len(pure):
                break
            # Cells of one digest stand together; one of them is taken.
            pure = pure[keys[pure].argsort(kind="stable")]
            digests = keys[pure]
            first = pure[np.concatenate([_TRUE, digests[1:] != digests[:-1]])]
            digests, times = keys[first], self.count[single[first]]
            sides[0].append(digests[times > 0])
            sides[1].append(digests[times < 0])
            self._add(digests, hashes[:, first], -times)
        if self.count.any() or self.key.any() or self.check.any():
            return None
        return tuple(np.concatenate(s) if s else np.zeros(0, np.uint64) for s in sides)

    def text(self) -> str:
        """The cells as base64: a text's fingerprint."""
        cells = np.zeros(len(self.count), np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        cells["count"], cells["key"], cells["check"] = self.count, self.key, self.check & np.uint64(0xFFFFFFFF)
        return base64.b64encode(cells.tobytes()).decode()


def _hashes(digests: np.ndarray) -> np.ndarray:
    """A row of numbers for each part, and one of checks."""
    return mix(np.concatenate([digests ^ _SALTS, (digests + _CHECK)[None]]))


def difference(
    a: np.ndarray,
    b: np.ndarray,
    cells: int = CELLS,
    first: tuple[Sketch, Sketch] | None = None,
    hashes: tuple[np.ndarray, np.ndarray] | None = None,
):
    """The digests that only a, only b has, by sketches that grow until they peel."""
    hashes = hashes or (_hashes(a), _hashes(b))
    x, y = first or (Sketch.of(a, cells, hashes[0]), Sketch.of(b, cells, hashes[1]))
    left = x - y
    while (found := left.peel()) is None:
        # After a failure there is room for all digests of both, and more each time.
        cells = max(cells * GROWTH, PARTS * ((len(a) + len(b)) // 2 + 1))
        # The sketch of a less that of b, in one.
        times = np.repeat(np.array([1, -1]), [len(a), len(b)])
        left = Sketch.of(np.concatenate([a, b]), cells, np.concatenate(hashes, axis=1), times)
    return found


def likeness(
    a: np.ndarray,
    b: np.ndarray,
    first: tuple[Sketch, Sketch] | None = None,
    cells: int = CELLS,
    hashes: tuple[np.ndarray, np.ndarray] | None = None,
) -> float:
    """Share of the paragraphs of both that are common; two texts without any are alike."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    gone, come = difference(a, b, cells, first, hashes)
    return 1.0 - (len(gone) + len(come)) / total


def edited(text: str, following: str) -> str:
    """The last half replaced by the start of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of the id, so that each row's next one is in its task.

    (part, guest, at, doc_id, text): a part's rows in descending order of the
    id, then the first row of the part below, as a guest; after the last part
    comes the first.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    parts = parts_for(spark)
    # As many cut points as there are partitions.
    points = rows.approxQuantile("at", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = [(str(int(p)),) for p in sorted(set(points))]
    placed = assign_range(rows, [F.col("at")], edges).withColumnRenamed(RANGE, "part")
    tops = {r["part"]: r["top"] for r in placed.groupBy("part").agg(F.max("at").alias("top")).collect()}
    order = sorted(tops, reverse=True)
    # The first row of each part is a guest of the part above; the first of all, of the last.
    guests = [(tops[p], order[i - 1]) for i, p in enumerate(order)]
    guests_of = spark.createDataFrame(guests, "at long, part int") if guests else spark.createDataFrame([], "at long, part int")
    visiting = rows.join(F.broadcast(guests_of), "at").withColumn("guest", F.lit(1))
    every = placed.withColumn("guest", F.lit(0)).select("part", "guest", "at", "doc_id", "text").unionByName(
        visiting.select("part", "guest", "at", "doc_id", "text")
    )
    return every.repartition(parts, "part").sortWithinPartitions("part", "guest", F.desc("at"), F.xxhash64("text"))


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(cells: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None  # (part, guest, doc_id, text, digests, hashes, sketch, known) that waits for its next
        for rows in batches:
            out = []
            for part, guest, doc_id, text in zip(rows.part, rows.guest, rows.doc_id, rows.text):
                known: dict[str, int] = {}
                digests = paragraph_digests(text, known)
                hashes = _hashes(digests)
                sketch = Sketch.of(digests, cells, hashes)
                if before is not None and before[0] == part and not before[1]:
                    out.append(_row(before, text, digests, hashes, sketch, cells))
                before = (part, guest, doc_id, text, digests, hashes, sketch, known)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")]).astype({"doc_id": "Int64"})

    return compare


def _row(one: tuple, text: str, digests: np.ndarray, hashes: np.ndarray, sketch: Sketch, cells: int) -> tuple:
    _, _, doc_id, own, own_digests, own_hashes, own_sketch, known = one
    changed = edited(own, text)
    changed_digests = paragraph_digests(changed, known)
    changed_hashes = _hashes(changed_digests)
    changed_sketch = Sketch.of(changed_digests, cells, changed_hashes)
    return (
        None if pd.isna(doc_id) else int(doc_id),
        len(own),
        hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
        own_sketch.text(),
        changed_sketch.text(),
        likeness(own_digests, changed_digests, (own_sketch, changed_sketch), cells, (own_hashes, changed_hashes)),
        likeness(own_digests, digests, (own_sketch, sketch), cells, (own_hashes, hashes)),
    )


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cells: int = CELLS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row for every row of docs. The next document is the one of the next
    smaller id, after the smallest the largest. Null texts count as empty. Rows
    that repeat an id follow one another in the order of a hash of their texts;
    rows without an id come last. Of a single row, the next is itself. An empty
    table gives an empty result.
    """
    return _with_next(only(docs, id_column, text_column)).mapInPandas(_compare(cells), _RESULT)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written here, where batches for Python workers are small.
    return publish(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
