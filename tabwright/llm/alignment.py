"""Links between the tokens that two tokenizers make of the same text.

The tokens of a run of texts are rows of two incidence matrices over the run's
bytes, held in compressed sparse rows built by hand (``Rows``):

* The product of the first with the transposed second, row by row (Gustavson),
  links tokens that share bytes; its values say how many. Tokens that hang
  together by such links are a group: both tokenizers cut before and after it.
* Groups over ids, with the number of occurrences as values, are two more
  matrices. Their product gives each document's pairs of ids that share a group
  and how often, without listing all pairs of occurrences: equal ids of a group
  are one entry. Products are taken over blocks of rows with a bounded number
  of terms, so a text that is one long group needs no more memory.

Counts over the corpus: a chunk of documents is one row, with a dictionary of its
pairs and, for every document, numbers into it. Only dictionaries are exploded,
summed and joined, so rows shuffled grow with distinct pairs of a chunk, not with
tokens. What each pair counts goes back to the chunks, which sum it up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import only, publish, settings, table
from tabwright.llm.packing import WordTokenizer, tokenizer_path

#: Characters whose tokens are multiplied at a time, and of the documents of a chunk.
RUN = 500_000
CHUNK = 4_000_000
#: Terms of a product, and entries of a chunk, at a time.
TERMS = 2_000_000
#: Words after which a worker starts a new table of ids; it keeps the last one.
CACHED_WORDS = 300_000

_UNITS = re.compile("(?<=[^ ])(?= )")


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# -- matrices -------------------------------------------------------------------


@dataclass(frozen=True)
class Rows:
    """A sparse matrix: row i has columns[starts[i]:starts[i + 1]] and such values."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def numbers(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), self.sizes())

    def block(self, begin: int, end: int) -> Rows:
        a, b = self.starts[begin], self.starts[end]
        return Rows(self.starts[begin : end + 1] - a, self.columns[a:b], self.values[a:b], self.width)


def from_entries(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int, width: int) -> Rows:
    """Entries in any order; those of one place are summed."""
    key = rows.astype(np.int64) * width + columns
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key, values = key[first], np.add.reduceat(values, first) if len(first) else values
    rows = key // width if width else key
    return Rows(np.searchsorted(rows, np.arange(height + 1)), key - rows * width, values, width)


def product(a: Rows, b: Rows) -> Rows:
    """a·b by row products: row i sums a[i, k] times row k of b over its columns k."""
    many = b.sizes()[a.columns]
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.starts[a.columns] - (ends - many), many)
    rows, values = np.repeat(a.numbers(), many), np.repeat(a.values, many) * b.values[at]
    return from_entries(rows, b.columns[at], values, len(a.starts) - 1, b.width)


def products(a: Rows, b: Rows, terms: int = TERMS) -> Iterator[tuple[int, Rows]]:
    """a·b in blocks of rows with about so many terms: (first row, block)."""
    sums = np.append(0, np.cumsum(b.sizes()[a.columns]))[a.starts]
    begin, height = 0, len(a.starts) - 1
    while begin < height:
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + terms, "right")) - 1)
        yield begin, product(a.block(begin, end), b)
        begin = end


def token_bytes(lengths: np.ndarray) -> Rows:
    """Tokens over bytes: each token's bytes are adjoining columns."""
    ends = np.append(0, np.cumsum(lengths))
    return Rows(ends, np.arange(ends[-1]), np.ones(ends[-1], np.int64), int(ends[-1]))


def byte_tokens(lengths: np.ndarray) -> Rows:
    """The transposed matrix: each byte is in one token."""
    n = int(lengths.sum())
    return Rows(np.arange(n + 1), np.repeat(np.arange(len(lengths)), lengths), np.ones(n, np.int64), len(lengths))


def groups_of(links: Rows, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of either side, from the links of shared bytes.

    Neighbours of the first side hang together if the last token that one shares
    bytes with is the first of the next.
    """
    if not n_b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = links.columns[links.starts[:-1]], links.columns[links.starts[1:] - 1]
    of_a = np.append(0, np.cumsum(first[1:] != last[:-1]))
    of_b = np.zeros(n_b, np.int64)
    of_b[links.columns] = np.repeat(of_a, links.sizes())
    return of_a, of_b


# -- tokens ---------------------------------------------------------------------


class PieceTokenizer:
    """Ids of a blank and a text, by the sentencepiece library, word by word.

    No piece has a blank after another character, so merges never reach over one:
    the ids of the parts before such blanks, put together, are those of the whole.
    Texts with the library's own mark for blanks are encoded whole, as are all
    texts if the model's pieces, or its rules for blanks, are others.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = self.model.encode("a  b ", out_type=str)
        self.cuts = all("▁" not in p.lstrip("▁") for p in pieces) and "".join(probe) == "▁a▁▁b▁"
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # A blank at the end is a part without characters, which the library by itself gives no piece.
        self.blank = {"": np.array([self.model.piece_to_id("▁")], "<u4").tobytes()}
        self.known: dict[str, bytes] = dict(self.blank)
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def parts(self, text: str) -> list[str]:
        """Parts that begin with a blank, without it."""
        if not self.cuts or "▁" in text:
            return [text]
        return [p[1:] for p in _UNITS.split(" " + text)] if "  " in text or text[:1] == " " else text.split(" ")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = dict(self.blank), self.known
        needed = set().union(*cut).difference(self.known)
        again = needed.intersection(self.older)
        self.known.update((part, self.older[part]) for part in again)
        fresh = list(needed.difference(again))
        self.known.update(zip(fresh, self._whole(fresh)))
        return [b"".join(map(self.known.__getitem__, parts)) for parts in cut]


def _byte_of() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


BYTE_OF = _byte_of()


def _shown_bytes(token: str) -> bytes:
    """Bytes of a byte-level token; an added token is spelled as it is."""
    return bytes(BYTE_OF[c] for c in token) if all(c in BYTE_OF for c in token) else token.encode()


class Aligner:
    """Tokens, groups and links of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = WordTokenizer(path_a), PieceTokenizer(path_b)
        size = self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_a = [_shown_bytes(self.a.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.bytes_b = self.b.bytes
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        digits = len(str(max(size, len(self.bytes_b))))
        numbers = [str(i).encode() for i in range(max(size, len(self.bytes_b)))]
        self.digits = np.frombuffer(b"".join(n.ljust(digits + 1, b"\0") for n in numbers), np.uint8).reshape(-1, digits + 1)
        self.n_digits = np.array([len(n) for n in numbers])

    def tokens(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none for texts that either side does not spell as they are."""
        full = [i for i, t in enumerate(texts) if t]
        out = [(np.zeros(0, np.uint32),) * 2] * len(texts)
        spaced = [" " + texts[i] for i in full]
        for i, text, a, b in zip(full, spaced, self.a.encode(spaced), self.b.encode([texts[i] for i in full])):
            a, b, data = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), text.encode("utf-8", "surrogatepass")
            if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data:
                continue
            if b"".join(map(self.bytes_b.__getitem__, b.tolist())) == data:
                out[i] = (a, b)
        return out

    def overlaps(self, a: np.ndarray, b: np.ndarray) -> Rows:
        """Tokens of the first side over those of the second: bytes they share."""
        return product(token_bytes(self.length_a[a]), byte_tokens(self.length_b[b]))

    def spelled(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and where each group ends."""
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        places = np.concatenate([np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + before_a[of_b]])
        ids = np.empty(len(places), np.int64)
        ids[places] = np.concatenate([a, b])
        mark = np.full(len(places), ord(","), np.uint8)
        ends = before_a + np.cumsum(in_b)
        mark[ends - in_b - 1], mark[ends - 1] = ord("|"), ord(";")
        cells, width = self.digits[ids], self.n_digits[ids]
        cells[np.arange(len(ids)), width] = mark
        return cells[cells != 0], np.cumsum(width + 1)[ends - 1]

    def align(self, texts: Sequence[str | None]) -> tuple[pd.DataFrame, np.ndarray]:
        """A row for each text, and (text, id of a, id of b, links) for pairs that share groups."""
        found = self.tokens(texts)
        n_a, n_b = (np.array([len(t[side]) for t in found], np.int64) for side in (0, 1))
        a, b = (np.concatenate([t[side] for t in found] or [np.zeros(0, np.uint32)]).astype(np.int64) for side in (0, 1))
        of_a, of_b = groups_of(self.overlaps(a, b), len(b))
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        text_of_group = np.zeros(n, np.int64)
        text_of_group[of_a] = text_of_a
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        links = np.zeros(len(texts), np.int64)
        np.add.at(links, text_of_group, in_a * in_b)
        n_groups = np.bincount(text_of_group, minlength=len(texts))
        spelled, ends = self.spelled(a, b, of_a, of_b)
        stops = np.append(0, ends)[np.append(0, np.cumsum(n_groups))]
        digests = [
            hashlib.sha256(spelled[x : y - 1].tobytes()).hexdigest() if y > x else "" for x, y in zip(stops, stops[1:])
        ]
        rows = pd.DataFrame(
            {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": links, "groups_sha256": pd.Series(digests, dtype=object)}
        )
        return rows, self.pairs(a, b, of_a, of_b, text_of_a)

    def pairs(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, text_of_a: np.ndarray) -> np.ndarray:
        wide_a, wide_b = len(self.bytes_a), len(self.bytes_b)
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        # (text, id of a) over groups, and groups over ids of b
        rows, row_of = np.unique(text_of_a * wide_a + a, return_inverse=True)
        left = from_entries(row_of, of_a, np.ones(len(a), np.int64), len(rows), n)
        right = from_entries(of_b, b, np.ones(len(b), np.int64), n, wide_b)
        out = [np.zeros((0, 4), np.int64)]
        for begin, part in products(left, right):
            row = rows[begin + part.numbers()]
            out.append(np.stack([row // wide_a, row % wide_a, part.columns, part.values], 1))
        return np.concatenate(out)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}

_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_CHUNK = (
    f"chunk long, batch long, documents array<struct<place: int, {_DOCUMENT.replace(' long', ': long').replace(' string', ': string')}>>,"
    " pairs array<long>, counts array<long>, places binary, codes binary, links binary"
)


def _runs(texts: list, most: int) -> Iterator[slice]:
    """Runs of texts of about so many characters."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if isinstance(t, str) else 0
        if held >= most:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _chunks(ids: list, found: list[pd.DataFrame], pairs: list[np.ndarray], batch: int, number: Iterator[int]) -> Iterator[dict]:
    """Rows of the chunk table; a batch with very many entries gives several."""
    known = pd.concat(found, ignore_index=True)
    documents = [
        {"place": i, "doc_id": d, **r} for i, (d, r) in enumerate(zip(ids, known.to_dict("records")))
    ]
    entries = np.concatenate(pairs)
    for begin in range(0, max(len(entries), 1), 2 * TERMS):
        text, a, b, links = entries[begin : begin + 2 * TERMS].T
        keys, code, counts = np.unique(a << 32 | b, return_inverse=True, return_counts=True)
        # Frequent pairs first: small numbers pack better.
        order = np.argsort(-counts, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
        yield {
            "chunk": next(number),
            "batch": batch,
            "documents": documents if not begin else [],
            "pairs": keys[order],
            "counts": counts[order],
            "places": np.stack([text[starts], starts]).astype("<u4").tobytes(),
            "codes": back[code].astype("<u4").tobytes(),
            "links": links.astype("<u8").tobytes() if links.max(initial=0) >> 32 else links.astype("<u4").tobytes(),
        }


def chunked(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """Documents in chunks, one row each: their columns, their pairs, links by number of pair."""

    def map_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _ALIGNERS[path_a, path_b]
        base = TaskContext.get().partitionId() << 36
        numbers, many = iter(range(base, base + (1 << 36))), 0
        ids: list = []
        found: list[pd.DataFrame] = []
        pairs: list[np.ndarray] = []
        held = entries = 0

        def done() -> Iterator[pd.DataFrame]:
            nonlocal ids, found, pairs, held, entries, many
            for row in _chunks(ids, found, pairs, base + many, numbers):
                yield pd.DataFrame([row])
            ids, found, pairs, held, entries, many = [], [], [], 0, 0, many + 1

        for part in batches:
            keys, texts = part.doc_id.astype(object).where(part.doc_id.notna(), None).tolist(), part.text.tolist()
            for here in _runs(texts, run):
                some = [t if isinstance(t, str) else None for t in texts[here]]
                rows, new = aligner.align(some)
                new[:, 0] += len(ids)
                ids += keys[here]
                found.append(rows)
                pairs.append(new)
                held, entries = held + sum(len(t or "") for t in some), entries + len(new)
                if held >= chunk or entries >= 2 * TERMS:
                    yield from done()
        if ids:
            yield from done()

    return docs.mapInPandas(map_chunks, _CHUNK)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold a pair of ids linked, and whether
    no other pair of the same first id is in more. A pair is (a << 32) + b."""
    each = chunks.select(F.inline(F.arrays_zip("pairs", "counts"))).toDF("pair", "n")
    counts = publish(each.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    counts = counts.withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each document of a chunk: links whose pair is a best one, and counts summed over links."""
    for part in batches:
        for r in part.itertuples(index=False):
            count, best = np.zeros(len(r.number), np.int64), np.zeros(len(r.number), np.int64)
            count[r.number], best[r.number] = r.count_, r.best
            codes = np.frombuffer(r.codes, "<u4")
            links = np.frombuffer(r.links, "<u8" if len(r.links) > len(r.codes) else "<u4").astype(np.int64)
            places, starts = np.frombuffer(r.places, "<u4").reshape(2, -1).astype(np.int64)
            if len(starts):
                sums = [np.add.reduceat(links * of[codes], starts) for of in (best, count)]
                yield pd.DataFrame({"batch": r.batch, "place": places, "n_best": sums[0], "count_sum": sums[1]})


def align_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    chunk: int = CHUNK,
    run: int = RUN,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of docs.

    The first tokenizer reads a blank and the text, the second adds the blank
    itself; names of special tokens inside a text are plain text. Null and empty
    texts, and texts that either side does not spell byte by byte, have zeros and
    an empty digest. Rows that repeat an id, or have none, are documents of their
    own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or tokenizer_path(), path_b or piece_path()
    with settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        chunks = publish(chunked(only(docs, id_column, text_column), path_a, path_b, chunk, run), "chunks")
    counts = pair_counts(chunks)
    asked = chunks.select("chunk", F.posexplode("pairs").alias("number", "pair"))
    told = (
        asked.join(counts, "pair")
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("number", "count", "best")).alias("told"))  # a chunk's dictionary, bounded
        .select("chunk", F.col("told.number").alias("number"), F.col("told.count").alias("count_"), F.col("told.best").alias("best"))
    )
    held = chunks.select("chunk", "batch", "places", "codes", "links").join(told, "chunk")
    sums = held.mapInPandas(_sums, "batch long, place int, n_best long, count_sum long")
    rows = chunks.select("batch", F.inline("documents"))
    columns = [c for c in rows.columns if c not in ("batch", "place")]
    none = [F.lit(None).cast("long").alias(c) for c in ("n_best", "count_sum")]
    both = rows.select("batch", "place", F.struct(*columns).alias("row"), *none).unionByName(
        sums.withColumn("row", F.lit(None).cast(rows.select(F.struct(*columns).alias("row")).schema["row"].dataType))
    )
    whole = both.groupBy("batch", "place").agg(
        F.max("row").alias("row"),
        F.coalesce(F.sum("n_best"), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum("count_sum"), F.lit(0)).alias("count_sum"),
    )
    return whole.select("row.*", "n_best", "count_sum")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
