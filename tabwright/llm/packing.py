"""Best-fit packing of tokenized documents into sequences of a fixed length.

Every document becomes one or more pieces of at most ``capacity`` tokens. What
a piece asks of a sequence depends on its length alone: tokens, one place among
the documents, and an attention cost of its length squared. So the packing is
decided on the table of lengths and their counts, at most ``capacity`` rows
whatever the corpus: vector best fit, longest first, over groups of sequences in
equal state. The decision is a list of intervals "pieces of this length with
ranks from..to go to sequences base.. at this offset", and each piece looks up
its own by its rank among the pieces of its length. Ranks are counted in salted
parts, so a length that a third of all pieces share is no hot task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, kept, only, parts_for, publish, table

CAPACITY = 2048
#: End of every document.
END = 0
#: Words after which a Python worker starts a new table of ids; it keeps the last one.
CACHED_WORDS = 500_000

#: A token never reaches over a blank that follows something other than white space.
_UNITS = re.compile(r"(?<=\S)(?= )")
#: White space that may not be cut at blanks alone, and other kinds of it.
_DOUBLE = ("  ", " \n", "\n ")
_RARE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _by_ranks(path: str, tokenizer) -> Callable[[str], list[int]] | None:
    """The same ids some three times faster, where the file allows it.

    If a vocabulary of bytes numbers its merges in their order, merging by rank
    gives the ids of merging by list. None for any other file.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    split, merges = model.get("pre_tokenizer") or {}, model["model"].get("merges", [])
    vocabulary = model["model"].get("vocab", {})
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("normalizer"):
        return None
    joined = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    if None in joined or any(a >= b for a, b in zip(joined, joined[1:])):
        return None
    # Printable bytes stand for themselves, the others for characters from 256 on.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary


class WordTokenizer:
    """Ids of whole texts, as little-endian 32-bit numbers, word by word.

    The tokenizer cuts a text before every blank that follows a character other
    than white space, so the ids of the parts, put together, are those of the
    whole; parts that occurred before are looked up. New parts are tokenized many
    at a time, with a zero character between them: it is a token that merges with
    no other, so that it parts the ids too. Parts in which it could change how
    their ends are cut go alone.

    With ``added``, the file's added tokens get their own ids, as the tokenizer by
    itself gives them: a text is cut at them first. Without, they are spelled out.
    """

    def __init__(self, path: str, added: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in tokens.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        # Tokens that take blanks beside them, or stand only between words, are the whole tokenizer's to find.
        self.untouched = Tokenizer.from_file(path) if any(t.lstrip or t.rstrip or t.single_word for t in tokens.values()) else None
        self.tokenizer.encode_special_tokens = True
        self.ids = _by_ranks(path, self.tokenizer) or self._whole
        mark = self._whole("\0")
        shown = self.tokenizer.id_to_token(mark[0])
        parts = len(mark) == 1 and sum(shown in token for token in self.tokenizer.get_vocab()) == 1
        self.mark = mark[0] if parts else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def parts(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first cut, and the parts after it without their blank."""
        if any(c in text for c in _DOUBLE) or (not text.isascii() or not text.isprintable()) and any(c in text for c in _RARE):
            first, *rest = _UNITS.split(text)
            return first, [part[1:] for part in rest]
        first, *rest = text.split(" ")
        return first, rest

    def _learn(self, fresh: list[str]) -> None:
        """Tokenize parts, a blank before each, that are not known yet."""
        together, alone = [], []
        for part in fresh:
            fits = self.mark is not None and part and not part[-1].isspace() and "\0" not in part
            (together if fits else alone).append(part)
        for at in range(0, len(together), 512):
            some = together[at : at + 512]
            ids = np.array(self.ids(" " + "\0 ".join(some)), "<u4")
            ends = np.flatnonzero(ids == self.mark)
            data, edges = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            self.known.update((u, data[4 * a + 4 : 4 * b]) for u, a, b in zip(some, edges, edges[1:]))
        for part in alone:
            self.known[part] = np.array(self._whole(" " + part), "<u4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.cut or not any(content in t for t in texts for content in self.added):
            return self._encode(texts)
        out: list[list[bytes]] = [[] for _ in texts]
        plain: list[str] = []
        places: list[tuple[int, int]] = []
        for i, t in enumerate(texts):
            if self.untouched is not None and any(content in t for content in self.added):
                out[i].append(np.array(self.untouched.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            for k, part in enumerate(self.cut.split(t)):
                out[i].append(self.added[part] if k % 2 else b"")
                if not k % 2 and part:
                    plain.append(part)
                    places.append((i, len(out[i]) - 1))
        for (i, k), data in zip(places, self._encode(plain)):
            out[i][k] = data
        return [b"".join(parts) for parts in out]

    def _encode(self, texts: Sequence[str]) -> list[bytes]:
        cut = [self.parts(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        needed = set().union(*[rest for _, rest in cut]).difference(self.known)
        again = needed.intersection(self.older)
        self.known.update((part, self.older[part]) for part in again)
        self._learn(list(needed.difference(again)))
        look = self.known.__getitem__
        firsts = [np.array(self._whole(first) if first else [], "<u4").tobytes() for first, _ in cut]
        return [b"".join((first, *map(look, rest))) for first, (_, rest) in zip(firsts, cut)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document cut into pieces.

    Only documents longer than ``capacity`` are cut; the first piece takes what
    the full ones after it leave. Null texts count as empty.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = kept(("packing", path), lambda: WordTokenizer(path, added=True))
        end = np.array([END], "<u4").tobytes()
        for part in batches:
            ids, texts = part.doc_id.tolist(), part.text.tolist()
            for block in _blocks(texts):
                rows = []
                encoded = tokenizer.encode([t if isinstance(t, str) else "" for t in texts[block]])
                for doc_id, data in zip(ids[block], encoded):
                    data += end
                    n = len(data) // 4
                    first = n - (-(-n // capacity) - 1) * capacity
                    edges = [0, *range(first, n + 1, capacity)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _blocks(texts: list, most: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters, so that words in work stay few."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t) if isinstance(t, str) else 0
        if held > most:
            yield slice(begin, i + 1)
            begin, held = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` ranked first.. go to sequences base.. at ``offset``."""

    length: int
    first: int
    count: int
    base: int
    offset: int


def place(
    counts: dict[int, int],
    capacity: int = CAPACITY,
    most_documents: int | None = None,
    most_attention: int | None = None,
    rule: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1),
) -> list[Placement]:
    """Vector best fit, longest first, over (length, count).

    A sequence holds ``capacity`` tokens, ``most_documents`` pieces and an
    attention cost (sum of squared lengths) of ``most_attention``. Among the
    sequences that a piece fits by every capacity, ``norm`` takes the one whose
    weighted residual vector is shortest afterwards, ``dot`` the one whose
    residual has the largest weighted product with what the piece asks for.
    Sequences in equal state are one group, an interval of numbers.
    """
    most_documents = most_documents or capacity
    most_attention = most_attention or capacity * capacity
    limits = np.array([capacity, most_documents, most_attention], float)
    w = np.array(weights)
    out: list[Placement] = []
    base = np.zeros(0, np.int64)  # the groups' first sequences, sizes, residuals
    size = np.zeros(0, np.int64)
    left = np.zeros((0, 3))
    total = 0
    for length in sorted(counts, reverse=True):
        need = np.array([length, 1, length * length], float)
        if (need > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        todo, rank = counts[length], 0
        while todo:
            fits = np.flatnonzero((left >= need).all(1))
            if not len(fits):
                break
            if rule == "dot":
                best = fits[(w * (left[fits] / limits) * (need / limits)).sum(1).argmax()]
            else:
                best = fits[(w * ((left[fits] - need) / limits) ** 2).sum(1).argmin()]
            n = min(todo, int(size[best]))
            out.append(Placement(length, rank, n, int(base[best]), int(capacity - left[best, 0])))
            if n < size[best]:
                base = np.append(base, base[best] + n)
                size = np.append(size, size[best] - n)
                left = np.vstack([left, left[best]])
                size[best] = n
            left[best] = left[best] - need
            rank, todo = rank + n, todo - n
        if todo:
            each = int(min(limits // need))
            for slots, bins in ((each, todo // each), (todo % each, 1)):
                if not slots or not bins:
                    continue
                for k in range(slots):
                    out.append(Placement(length, rank, bins, total, k * length))
                    rank += bins
                base, size = np.append(base, total), np.append(size, bins)
                left = np.vstack([left, limits - slots * need])
                total += bins
        open_ = left[:, 0] >= 1
        base, size, left = base[open_], size[open_], left[open_]
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """The pieces with a rank, 0 on, among those of their length."""
    salts = parts_for(rows.sparkSession)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    begins = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    placed = salted.withColumn("at", F.row_number().over(within)).join(begins, ["length", "salt"])
    return placed.withColumn("rank", F.col("begin") + F.col("at") - 1).drop("salt", "at", "begin")


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    most_documents: int | None = None,
    most_attention: int | None = None,
    rule: str = "norm",
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    Every row of docs is packed, null and empty texts as the end token alone;
    rows that repeat an id, or have none, are packed each. An empty table gives
    an empty result.
    """
    rows = publish(pieces(only(docs, id_column, text_column), capacity, path), "pieces")
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = sorted(place(counts, capacity, most_documents, most_attention, rule), key=lambda p: (p.length, p.first))
    steps = rows.sparkSession.sparkContext.broadcast(  # a few for each length, at most
        np.array([(p.length, p.first, p.base, p.offset) for p in plan], np.int64).reshape(-1, 4)
    )

    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        dropped()
        lengths, firsts, bases, offsets = steps.value.T
        edges = np.searchsorted(lengths, np.arange(lengths.max(initial=0) + 2))
        for length, rank in batches:
            length, rank = length.to_numpy(), rank.to_numpy()
            at = np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                here = length == one
                at[here] = edges[one] + np.searchsorted(firsts[edges[one] : edges[one + 1]], rank[here], "right") - 1
            yield pd.DataFrame({"sequence_id": bases[at] + rank - firsts[at], "offset": offsets[at]})

    found = F.pandas_udf(look, "sequence_id long, offset long")("length", "rank")
    out = ranked(rows).withColumn("found", found)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "found.sequence_id", "found.offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all documents that are left."""
    return pack(docs)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
