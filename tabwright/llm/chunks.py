"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes and cuts where its value is small, so cuts
depend on the last sixteen bytes alone: text inserted before a passage moves the
passage's cuts along with it. Chunks are compared by digest. A chunk that occurs
in a document of a smaller id is a repeat; adjoining repeats of at least
``MIN_RUN`` bytes together are taken out, shorter ones (a shared phrase) stay.

Digests are counted with partial aggregation, and only those that two documents
share are joined back, so a passage that a third of all documents holds costs
one row for each task before the shuffle and a split join after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, only, publish, table, unused
from tabwright.llm.rolling import raw_bytes

#: Bytes from cut to cut, on average and at most.
AVERAGE = 16
LONGEST = 512
MIN_RUN = 64
#: A chunk travels as start * SIZES + size.
SIZES = 4096

_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the sixteen bytes up to each place: h = 2 * h + gear[byte].

    The sum of sixteen shifted table values is put together by doubling; the low
    sixteen bits, which the cuts look at, depend on no earlier byte.
    """
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(data: np.ndarray, average: int = AVERAGE, longest: int = LONGEST) -> np.ndarray:
    """Places at which a text is cut, its start and end among them.

    Cuts are moved on to the next start of a UTF-8 character.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    h = gear(data) & np.uint32(0xFFFF)
    at = np.flatnonzero(h < (1 << 16) // average) + 1
    at = np.concatenate([[0], at[at < n], [n]])
    if len(wide := np.flatnonzero(np.diff(at) > longest)):
        more = [np.arange(at[i] + longest, at[i + 1], longest) for i in wide]
        at = np.sort(np.concatenate([at, *more]))
    inside = np.append((data & 0xC0) == 0x80, False)
    while inside[at].any():
        at = at + inside[at]
    return np.unique(at)


def digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2 digest of each chunk.

    A false match takes out nothing by itself: the chunks beside it must repeat too.
    """
    raw = data.tobytes()
    found = b"".join(
        hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())
    )
    return np.frombuffer(found, "<i8")


def chunk_table(docs: DataFrame, average: int = AVERAGE, longest: int = LONGEST) -> DataFrame:
    """(doc_id, version, start, size, digest): one row for each chunk of each text.

    ``version`` is the crc32 of the text: it tells rows of one id apart.
    """

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            held: list[tuple] = []
            count = 0
            for doc_id, version, text in zip(part.doc_id, part.version, part.text):
                data = raw_bytes(text)
                if not len(data):
                    continue
                at = cuts(data, average, longest)
                held.append((np.full(len(at) - 1, doc_id), np.full(len(at) - 1, version), at[:-1], np.diff(at), digests(data, at)))
                count += len(at)
                if count > 200_000:
                    yield _frame(held)
                    held, count = [], 0
            if held:
                yield _frame(held)

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.crc32("text").alias("version"), "text")
    return rows.mapInPandas(chunks, "doc_id long, version long, start int, size int, digest long")


def _frame(held: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate(v) for k, v in zip(("doc_id", "version", "start", "size", "digest"), zip(*held))})


def repeats(docs: DataFrame, min_run: int = MIN_RUN, average: int = AVERAGE, longest: int = LONGEST) -> DataFrame:
    """(doc_id, version, spans): the runs to take out of each text, as [start, end]."""
    # Texts are cut twice: a written copy of the chunks would take more room than the texts.
    chunks = chunk_table(docs, average, longest)
    owners = chunks.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    shared = publish(owners.where("owner < last").select("digest", "owner"), "shared")
    found = chunks.join(shared, "digest").where("doc_id > owner").select(
        "doc_id", "version", (F.col("start").cast("long") * SIZES + F.col("size")).alias("c")
    )

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            part["spans"] = pd.Series([_runs(np.unique(one), min_run) for one in part.c], index=part.index, dtype=object)
            yield part.loc[part.spans.str.len() > 0, ["doc_id", "version", "spans"]]

    # Spark would run a condition on a function's value a second time, in workers of its own.
    lists = found.groupBy("doc_id", "version").agg(F.collect_list("c").alias("c"))
    return lists.mapInPandas(runs, "doc_id long, version long, spans array<array<int>>")


def _runs(chunks: np.ndarray, min_run: int) -> list[list[int]]:
    """Adjoining chunks, sorted, as spans; those of fewer bytes are left out."""
    starts, ends = chunks // SIZES, chunks // SIZES + chunks % SIZES
    first = np.flatnonzero(np.concatenate([[True], starts[1:] != ends[:-1]]))
    last = np.append(first[1:], len(chunks)) - 1
    spans = np.stack([starts[first], ends[last]], 1)
    return spans[spans[:, 1] - spans[:, 0] >= min_run].tolist()


def _kept(text: Column, spans: Column) -> Column:
    """The text without its spans. Cuts are at starts of characters, so each piece is text."""
    raw = text.cast("binary")
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s[1]))
    ends = F.concat(F.transform(spans, lambda s: s[0]), F.array(F.length(raw)))
    parts = F.zip_with(begins, ends, lambda x, y: F.substring(raw, x + 1, y - x).cast("string"))
    return F.when(spans.isNull(), text).otherwise(F.array_join(parts, ""))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how: int) -> DataFrame:
    """docs with repeats taken out of the text, and their spans in a last column.

    Null and empty texts, and rows without an id, stay as they are. Rows that
    repeat an id are one document: what only they share stays in each. A text that is
    all repeats becomes empty; no row is dropped. The name of the last column is
    ``spans`` unless docs has one of that name: then it gets underscores before.
    """
    spans = unused(docs, "spans")
    gone = repeats(only(docs, id_column, text_column), **how)
    # Written before the texts are shuffled: what the chunks took on disk is free by then.
    gone = publish(gone.select(F.struct("doc_id", "version").alias("k"), F.col("spans").alias(spans)), "spans")
    text = docs[f"`{text_column}`"]
    here = (docs[f"`{id_column}`"] == gone["k.doc_id"]) & (F.crc32(text) == gone["k.version"])
    joined = docs.join(gone, here, "left").select(*[docs[f"`{c}`"] for c in docs.columns], gone[spans])
    return joined.withColumn(text_column, _kept(F.col(f"`{text_column}`"), F.col(spans)))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that repeat taken out of their texts."""
    out = without_repeats(docs)
    kept = out.select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = without_repeats(docs.withColumn("n_bytes", F.octet_length("text").cast("long")))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("text")).alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        "text",
    )
