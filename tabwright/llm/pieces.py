"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a public piece model: the normaliser (a blank
becomes the mark, a mark goes before the text), the pieces (an arc from each
place for each piece that starts there, weighted by its score) and byte fallback
(a character that no piece begins spells its bytes). A model trained by merging
pairs does not take the lightest of all paths, so a fourth machine accepts two
pieces in a row only if merging leaves the pair as it is; any other pair weighs
infinitely much. The composition with a text is searched for its shortest path
in the tropical semiring, (min, +).

Why that gives the merged pieces: merges in a part of a text happen in the order
they would in that part alone until one crosses its edge, so a cut is the merged
one exactly if every two neighbours are. Hence each place is reached by one path
of finite weight at most, and the search keeps one state for each place.

No piece has the mark after another character, so a text's parts between a
character and a mark are composed one by one, and those met before are looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import kept, only, publish, settings, table

MARK = "▁"
#: Parts after which a Python worker starts a new table; it keeps the last one.
CACHED_PARTS = 200_000
CACHED_PAIRS = 400_000
#: Longer parts are not kept.
LONGEST_KEPT = 64

_PARTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """The compiled machines of one piece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [
            i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.number = {model.id_to_piece(i): i for i in plain}
        self.score = {p: model.get_score(i) for p, i in self.number.items()}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.spelled: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for p, i in self.number.items()}
        self.spelled.update({i: bytes([b]) for b, i in self.bytes.items()})
        self.parted = not any(MARK in p.lstrip(MARK) for p in self.number)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @cached_property
    def arcs(self) -> dict:
        """From character to character; the piece that ends at a node is under "". Decoding needs none."""
        arcs: dict = {}
        for piece in self.number:
            node = arcs
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = piece
        return arcs

    def normalise(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def accepts(self, left: str, right: str) -> bool:
        """Whether merging leaves this pair of pieces as it is."""
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def merged(self, text: str) -> list[str]:
        """Merge neighbours whose union is a piece, best score first, leftmost of equals."""
        parts = list(text)
        scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best = None
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > scores[best]):
                    best = i
            if best is None:
                return parts
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            del scores[best]
            if best < len(scores):
                scores[best] = self.score.get(parts[best] + parts[best + 1])
            if best:
                scores[best - 1] = self.score.get(parts[best - 1] + parts[best])

    def shortest_path(self, part: str) -> list[int]:
        """Ids along the shortest path of the machines composed with one part.

        Only one path of finite weight leads to a place, so the first accepted
        arc into it is on the shortest, and longer pieces come first.
        """
        n = len(part)
        last: list[str | None] = [None] * (n + 1)  # the piece that leads to a place; empty after spelled bytes
        last[0] = ""
        come = [0] * (n + 1)
        pairs, arcs = self.pairs, self.arcs
        for i in range(n):
            before = last[i]
            if before is None:
                continue
            node, j = arcs, i
            while j < n:
                node = node.get(part[j])
                if node is None:
                    break
                j += 1
                if last[j] is None:
                    piece = node.get("")
                    if piece is not None:
                        accepted = pairs.get((before, piece))
                        if accepted or accepted is None and self.accepts(before, piece):
                            last[j], come[j] = piece, i
            if last[i + 1] is None and part[i] not in self.number:
                last[i + 1], come[i + 1] = "", i
        out: list[int] = []
        at = n
        while at:
            i, piece = come[at], last[at]
            if piece:
                out.append(self.number[piece])
            else:
                out += [self.bytes[b] for b in reversed(part[i:at].encode("utf-8", "replace"))]
            at = i
        return out[::-1]

    def _ids(self, part: str) -> bytes:
        data = self.known.get(part)
        if data is None:
            data = self.older.get(part)
            if data is None:
                data = np.array(self.shortest_path(part), "<u4").tobytes()
            if len(part) <= LONGEST_KEPT:
                if len(self.known) > CACHED_PARTS:
                    self.known, self.older = {}, self.known
                self.known[part] = data
        return data

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; null counts as empty."""
        whole = self.normalise(text or "")
        parts = _PARTS.findall(whole) if self.parted else [whole] * bool(whole)
        return b"".join(map(self._ids, parts))

    def decode(self, ids: bytes | Sequence[int]) -> str:
        """The text that ids spell, without the mark put before it."""
        numbers = np.frombuffer(ids, "<u4").tolist() if isinstance(ids, bytes) else ids
        text = b"".join(map(self.spelled.__getitem__, numbers)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _machine(path: str) -> Transducer:
    return kept(("pieces", path), lambda: Transducer(path))


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, as little-endian 32-bit numbers.

    Null and empty texts have no ids; rows that repeat an id, or have none, give
    a row each. An empty table gives an empty result.
    """
    path = path or model_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([_machine(path).encode(t if isinstance(t, str) else None) for t in part], dtype=object)

    return only(docs, id_column, text_column).select("doc_id", F.pandas_udf(run, "binary")("text").alias("ids"))


def decode(rows: DataFrame, ids_column: str = "ids", name: str = "text", path: str | None = None) -> DataFrame:
    """rows with the text that the ids spell in a further column; null ids give null."""
    path = path or model_path()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([None if x is None else _machine(path).decode(bytes(x)) for x in part], dtype=object)

    return rows.withColumn(name, F.pandas_udf(run, "string")(F.col(f"`{ids_column}`")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text: ids by their crc32, texts by their digest."""
    # Ids are written first: encoding and decoding side by side take two Python workers a task, each with its tables.
    with settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        ids = publish(encode(table(spark, sf_dir, "documents")), "piece-ids")
    out = decode(ids)
    digests = out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
    # Written here, where batches for Python workers are small; a few numbers for each document.
    return publish(digests, "pieces")
