"""Token ids in binary files, with keyed access through minimal perfect hashes.

A store is a folder on shared storage. Each shard is two files: ``.ids`` holds the
raw ids of its documents one after the other (16 bits each where the vocabulary
allows, else 32, little-endian), ``.idx`` a JSON header and arrays: the documents'
keys and ends in the payload, the levels of the hash, and one slot for each key.

The hash sends n keys to n places without gaps: keys alone in their bit of a
level's bit array stay there, the others go on to the next level; a key's place is
the number of bits set before its own. A slot holds the key's fingerprint (its
bits mixed one to one, so that no other 64-bit key has it), the first of its
documents, how many it has, and where their ids begin. So access takes the
hash, one slot and one range of the payload, whatever the size of the shard.

Documents are encoded once and written, then cut into ranges of ascending keys;
tasks write shards under names nobody has used and report them in rows. What the
table of shards names is the store: files of lost attempts are never read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.ordered import Running, with_running
from tabwright.llm.common import only, parts_for, publish, settings, table
from tabwright.session import fresh_folder

#: End of every document.
END = 1
#: Ids after which a task begins another shard.
SHARD_IDS = 1 << 25
#: Words after which a worker starts a new table of ids; it keeps the last one.
CACHED_WORDS = 700_000
#: Ids read, and characters encoded, at a time.
READ_IDS = 1 << 21
BLOCK = 2_000_000

MAGIC = b"TOKENIDX"
SLOT = np.dtype([("fingerprint", "<u8"), ("first", "<u8"), ("documents", "<u8"), ("offset", "<u8")])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# -- encoding -------------------------------------------------------------------


def parts_at_blanks(model: dict) -> bool:
    """Whether a tokenizer's file says that blanks part words and are dropped.

    Then the ids of the parts between blanks and line ends are those of the whole.
    """
    import regex

    many = lambda x, key: x[key] if x and x.get("type") == "Sequence" else [x] if x else []
    normalizers, splits = many(model.get("normalizer"), "normalizers"), many(model.get("pre_tokenizer"), "pretokenizers")
    for n in normalizers:
        blanks = n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " "
        if n["type"] not in ("NFC", "Lowercase") and not blanks:
            return False
    if not splits or splits[0]["type"] != "Split" or splits[0]["behavior"] != "Removed" or not splits[0]["invert"]:
        return False
    if any(s["type"] != "ByteLevel" or s["use_regex"] or s["add_prefix_space"] for s in splits[1:]):
        return False
    pattern = regex.compile(splits[0]["pattern"].get("Regex", r"(?s:.)"))
    probe = "a b\nc 'd 1 2 !? \n é  ' s"
    if any(set(m) & {" ", "\n"} for m in pattern.findall(probe)) or model.get("post_processor"):
        return False
    return not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & {" ", "\n"}
        for t in model.get("added_tokens", [])
    )


#: Places between a letter and a mark that ends a word: the two are never one part.
_MARKS = re.compile(r"(?<=[a-z])(?=[,.;:!?][ \n])")


class WordIds:
    """Ids of whole texts by the tokenizers library; words seen before are looked up.

    New words are encoded many at a time with a zero character between them, where
    that is a token of its own that merges with no other, so that it parts the ids
    too; words of letters need none where the file's tokens say which end a word. Texts of ASCII alone are lower-cased first if the file does so itself, and
    words lose the mark after them.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.cuts = parts_at_blanks(json.loads(text))
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = self.cuts and '"Lowercase"' in text and r"[\\p{L}]+|" in text and all(t == t.lower() for t in self.added)
        mark = np.frombuffer(self._whole(["\0"])[0], self.dtype)
        shown = (self.tokenizer.id_to_token(int(mark[0])) or "").removesuffix("</w>") if len(mark) == 1 else ""
        alone = shown and not any(shown in t and t not in (shown, f"{shown}</w>") for t in self.tokenizer.get_vocab())
        self.mark = int(mark[0]) if alone and self.cuts else None
        self.ends = self._word_ends(json.loads(text)["model"]) if self.lowers else None
        # Lower-case ASCII is what the file's normaliser leaves as it is.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _word_ends(self, model: dict) -> np.ndarray | None:
        """Which ids end a part, if the file marks them so: every byte can, then, and a part of letters has one such id."""
        from tokenizers import pre_tokenizers

        suffix = model.get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        if not suffix or any(c + suffix not in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()):
            return None
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _whole(self, texts: list[str], plain: bool = False) -> list[bytes]:
        encoded = (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in encoded]

    def _learn(self, fresh: list[str]) -> None:
        alone, kinds = [], {k: [] for k in ((True, True), (True, False), (False, True), (False, False))}
        parted, lowers, mark = self.ends is not None, self.lowers, self.mark is not None
        for w in fresh:
            if not mark or "\0" in w:
                alone.append(w)
            else:
                kinds[lowers and w.isascii() and w == w.lower(), parted and w.isalpha()].append(w)
        self.known.update(zip(alone, self._whole(alone)))
        for plain in (True, False):
            self._together(kinds[plain, False] + self._of_letters(kinds[plain, True], plain), plain)

    def _of_letters(self, words: list[str], plain: bool) -> list[str]:
        """Learn words of letters, parted by the ids that end them; returns those of which a part ends inside."""
        width, left = np.dtype(self.dtype).itemsize, []
        for at in range(0, len(words), 128):
            some = words[at : at + 128]
            data = self._whole([" ".join(some)], plain)[0]
            edges = (np.flatnonzero(self.ends[np.frombuffer(data, self.dtype)]) + 1) * width
            # A letter has an end of its own at least, so as many ends as words are one for each.
            if len(edges) != len(some):
                left += some
                continue
            edges = [0, *edges.tolist()]
            self.known.update((w, data[a:b]) for w, a, b in zip(some, edges, edges[1:]))
        return left

    def _together(self, words: list[str], plain: bool) -> None:
        width = np.dtype(self.dtype).itemsize
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            data = self._whole([" \0 ".join(some)], plain)[0]
            ends = np.flatnonzero(np.frombuffer(data, self.dtype) == self.mark) * width
            edges = [-width, *ends.tolist(), len(data)]
            self.known.update((w, data[a + width : b]) for w, a, b in zip(some, edges, edges[1:]))

    def words(self, text: str) -> list[str]:
        if self.lowers and text.isascii():
            low = text.lower()
            text = text if any(t in low for t in self.added) else _MARKS.sub(" ", low)
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(list(texts))
        cut = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {"": b""}, self.known
        needed = set().union(*cut).difference(self.known)
        # Asked word by word: the set's own intersection would go through the whole table of older words.
        found = [(word, self.older.get(word)) for word in needed]
        self.known.update(x for x in found if x[1] is not None)
        self._learn([word for word, data in found if data is None])
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


_WORDS: dict[str, WordIds] = {}


def words(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


_ENCODED = "doc_id long, crc long, salt long, ids binary"


def encoded(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """(doc_id, crc, salt, ids) for each document; salt sets equal rows apart."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = words(path)
        last, salt = np.array([end], tokenizer.dtype).tobytes(), TaskContext.get().partitionId() << 36
        for part in batches:
            keys, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):
                stop, held = begin, 0
                while stop < len(texts) and held < BLOCK:
                    held, stop = held + len(texts[stop]), stop + 1
                ids = [data + last for data in tokenizer.encode(texts[begin:stop])]
                salts = pa.array(np.arange(salt, salt + len(ids)))
                crcs = pa.array([zlib.crc32(data) for data in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(begin, len(ids)), crcs, salts, pa.array(ids, pa.binary())], ["doc_id", "crc", "salt", "ids"]
                )
                begin, salt = stop, salt + len(ids)

    return docs.mapInArrow(encode, _ENCODED)


# -- minimal perfect hash ---------------------------------------------------------


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one map of 64-bit numbers."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Seed of fingerprints; levels have those from 0 on.
FINGERPRINT = 1 << 20


class PerfectHash:
    """n distinct 64-bit keys to 0 .. n - 1, in some three and a half bits a key."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.begins = np.append(0, np.cumsum(sizes))
        self.before = np.append(0, np.cumsum(np.bitwise_count(bits).astype(np.int64)))

    @staticmethod
    def build(keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left):
            size = max(64, -(-int(room * len(left)) // 64) * 64)
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        return PerfectHash(np.array(sizes, np.int64), bits)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; some place, or -1, for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        todo, keys = np.arange(len(keys)), keys.astype(np.uint64)
        for level, (size, begin) in enumerate(zip(self.sizes.tolist(), self.begins.tolist())):
            bit = begin + (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, inside = self.bits[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> inside) & np.uint64(1) == 1
            lower = word[hit] & ((np.uint64(1) << inside[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[bit[hit] >> 6] + np.bitwise_count(lower)
            todo = todo[~hit]
            if not len(todo):
                break
        return out


# -- files ------------------------------------------------------------------------


def file_system(path: str):
    """The file system of a path or address, and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{'/' + rest.lstrip('/') if scheme == 'file' else rest[2:]}")


class Shard:
    """A shard being written: ids go to the payload as they come, the index at the end."""

    def __init__(self, folder: str, dtype: str) -> None:
        self.files, self.folder = file_system(folder)
        self.name, self.dtype = uuid.uuid4().hex, dtype
        self.files.create_dir(self.folder, recursive=True)
        self.payload = self.files.open_output_stream(f"{self.folder}/{self.name}.ids")
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.ids = 0

    def add(self, key: int | None, data: bytes) -> None:
        self.payload.write(data)
        n = len(data) // np.dtype(self.dtype).itemsize
        self.keys.append(key)
        self.lengths.append(n)
        self.ids += n

    def close(self) -> tuple:
        self.payload.close()
        nulls = sum(k is None for k in self.keys)
        keys = np.array(self.keys[nulls:], np.int64)
        ends = np.cumsum(np.array(self.lengths, np.int64))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        distinct = keys[first].view(np.uint64)
        found = PerfectHash.build(distinct)
        slots = np.zeros(len(first), SLOT)
        at = found.places(distinct)
        slots["fingerprint"][at] = mixed(distinct, FINGERPRINT)
        slots["first"][at] = first + nulls
        slots["documents"][at] = np.diff(np.append(first, len(keys)))
        slots["offset"][at] = np.append(0, ends)[first + nulls]
        arrays = {"keys": keys, "ends": ends, "sizes": found.sizes, "bits": found.bits, "slots": slots}
        header = json.dumps({"dtype": self.dtype, "nulls": nulls, "arrays": {k: len(v) for k, v in arrays.items()}}).encode()
        header += b" " * (-len(header) % 8)
        with self.files.open_output_stream(f"{self.folder}/{self.name}.idx") as out:
            out.write(MAGIC + np.array([len(header)], "<u8").tobytes() + header)
            for v in arrays.values():
                out.write(np.ascontiguousarray(v).tobytes())
        low, high = (int(keys[0]), int(keys[-1])) if len(keys) else (None, None)
        return self.name, low, high, len(self.keys), nulls, self.ids


class ShardReader:
    """Keyed access to a shard's ids."""

    def __init__(self, folder: str, name: str) -> None:
        self.files, folder = file_system(folder)
        with self.files.open_input_file(f"{folder}/{name}.idx") as file:
            data = file.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{name} is no index of token ids")
        at = 16 + int(np.frombuffer(data, "<u8", 1, 8)[0])
        header = json.loads(data[16:at])
        arrays = {}
        types = {"keys": "<i8", "ends": "<i8", "sizes": "<i8", "bits": "<u8", "slots": SLOT}
        for key, n in header["arrays"].items():
            arrays[key] = np.frombuffer(data, types[key], n, at)
            at += n * np.dtype(types[key]).itemsize
        self.keys, self.ends, self.slots = arrays["keys"], arrays["ends"], arrays["slots"]
        self.hash = PerfectHash(arrays["sizes"], arrays["bits"])
        self.dtype, self.nulls = np.dtype(header["dtype"]), header["nulls"]
        self.payload = self.files.open_input_file(f"{folder}/{name}.ids")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot number of each key, -1 for a key that the shard does not hold."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        at = self.hash.places(keys)
        known = at >= 0
        known[known] = self.slots["fingerprint"][at[known]] == mixed(keys[known], FINGERPRINT)
        return np.where(known, at, -1)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids begin .. end of the payload, as 32-bit numbers."""
        data = self.payload.read_at((end - begin) * self.dtype.itemsize, begin * self.dtype.itemsize)
        return np.frombuffer(data, self.dtype).astype("<u4")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document of a key; an empty list if there is none."""
        slot = int(self.find(np.array([key]))[0])
        if slot < 0:
            return []
        s = self.slots[slot]
        edges = [int(s["offset"]), *self.ends[int(s["first"]) : int(s["first"] + s["documents"])].tolist()]
        ids = self.read(edges[0], edges[-1])
        return [ids[a - edges[0] : b - edges[0]] for a, b in zip(edges, edges[1:])]

    def close(self) -> None:
        self.payload.close()


# -- a store ----------------------------------------------------------------------

_SHARDS = "name string, low long, high long, documents long, nulls long, ids long, part int, number int"


def _ordered(c: Column) -> Column:
    return c.asc_nulls_first()


def write_store(docs: DataFrame, folder: str, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write documents (doc_id, text) to ``folder`` in ascending order of ids.

    Returns the table of shards: (shard, name, low, high, documents, nulls, ids,
    begin), where begin counts the ids of all shards before.
    """
    spark = docs.sparkSession
    dtype = words(path).dtype
    with settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        rows = publish(encoded(docs, path, end), "ids")
    order = [_ordered(F.col(c)) for c in ("doc_id", "crc", "salt")]
    ranges = rows.repartitionByRange(parts_for(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, shard = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if shard is None:
                    shard = Shard(folder, dtype)
                shard.add(key, data.as_py())
                if shard.ids >= shard_ids:
                    done.append((*shard.close(), part, len(done)))
                    shard = None
        if shard is not None:
            done.append((*shard.close(), part, len(done)))
        columns = list(zip(*done)) or [()] * 8
        kinds = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
        names = [c.split()[0] for c in _SHARDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    shards = publish(ranges.select("doc_id", "ids").mapInArrow(write, _SHARDS), "shards")
    # One row a shard, and one a range of keys, of which the session sets the number.
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = shards.groupBy("part").agg(F.sum("ids").alias("i"), F.count("*").alias("s"))
    begins = begins.select("part", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("i", "s")])
    inside = Window.partitionBy("part").orderBy("number")
    earlier = F.coalesce(F.sum("ids").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = shards.join(begins, "part").select(
        (F.col("s") + F.col("number")).alias("shard"), "name", "low", "high", "documents", "nulls", "ids",
        (F.col("i") + earlier).alias("begin"),
    )
    return publish(numbered, "shards")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()}
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))


def read_store(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document, from the files alone.

    Each key that a shard holds is looked up in its index, and its ids are read
    from where its slot says, in blocks.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(folder, name)
                first = np.flatnonzero(np.append(True, shard.keys[1:] != shard.keys[:-1])) if len(shard.keys) else np.zeros(0, int)
                slots = shard.slots[shard.find(shard.keys[first])]
                # Documents without a key come first.
                keys: list[int | None] = [None] * shard.nulls
                ends = shard.ends[: shard.nulls].tolist()
                starts = [0, *ends[:-1]] if ends else []
                many = slots["documents"].astype(np.int64)
                at = np.repeat(slots["first"].astype(np.int64), many)
                at += np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                keys += np.repeat(shard.keys[first], many).tolist()
                begun = at == np.repeat(slots["first"].astype(np.int64), many)
                starts += np.where(begun, np.repeat(slots["offset"].astype(np.int64), many), np.append(0, shard.ends)[at]).tolist()
                ends += shard.ends[at].tolist()
                i = 0
                while i < len(keys):
                    j = i + 1
                    while j < len(keys) and ends[j] - starts[i] <= READ_IDS:
                        j += 1
                    data = memoryview(shard.read(starts[i], ends[j - 1]).tobytes())
                    base = starts[i]
                    yield _batch(
                        [
                            (keys[k], begin + starts[k], ends[k] - starts[k], zlib.crc32(data[4 * (starts[k] - base) : 4 * (ends[k] - base)]))
                            for k in range(i, j)
                        ]
                    )
                    i = j
                shard.close()

    dealt = shards.select("name", "begin", "shard").repartitionByRange(parts_for(shards.sparkSession), "shard")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(shards: DataFrame, folder: str, keys: DataFrame, key_column: str = "doc_id") -> DataFrame:
    """(key, start, ids) for each document of each distinct key asked for.

    A key goes to the last shard that begins at or below it, and to those before
    that end with it; there the index is asked. Unknown and null keys give no row.
    """
    asked = keys.select(F.col(f"`{key_column}`").cast("long").alias("key")).where("key is not null").distinct()
    held = shards.where("low is not null")
    back = held.groupBy(F.col("high").alias("low")).agg(F.min("shard").alias("back"))
    places = held.join(back, "low", "left").select(
        F.col("low").alias("key"), F.lit(0).alias("kind"), "shard", F.struct("shard", F.coalesce("back", "shard").alias("back")).alias("place")
    )
    none = F.lit(None).cast("long")
    both = places.unionByName(
        asked.select("key", F.lit(1).alias("kind"), none.alias("shard"), F.struct(none.alias("shard"), none.alias("back")).alias("place"))
        .withColumn("place", F.when(F.lit(False), F.col("place")))
    )
    seen = with_running(both, [], ["key", "kind", "shard"], [Running("seen", "last", "place")])
    lows = held.select(F.col("shard").alias("s"), "low")
    found = seen.where("kind = 1 and seen is not null").join(lows, F.col("seen.shard") == F.col("s"))
    at = F.when(F.col("key") == F.col("low"), F.least("seen.back", "seen.shard")).otherwise(F.col("seen.shard"))
    wanted = found.select("key", F.explode(F.sequence(at, F.col("seen.shard"))).alias("shard")).join(
        held.select("shard", "name", "begin"), "shard"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, ShardReader] | None = None
        for batch in batches:
            for key, name, begin in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if opened is None or opened[0] != name:
                    if opened:
                        opened[1].close()
                    opened = (name, ShardReader(folder, name))
                slot, start = int(opened[1].find(np.array([key]))[0]), begin
                if slot < 0:
                    continue
                start += int(opened[1].slots[slot]["offset"])
                for ids in opened[1].get(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.int64()), pa.array([start], pa.int64()), pa.array([ids.astype(np.int64).tolist()], pa.list_(pa.int64()))],
                        ["key", "start", "ids"],
                    )
                    start += len(ids)

    dealt = wanted.repartitionByRange(parts_for(shards.sparkSession), "shard", "key").sortWithinPartitions("shard", "key")
    return dealt.select("key", "name", "begin").mapInArrow(read, "key long, start long, ids array<long>")


def to_files(
    docs: DataFrame,
    folder: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str | None = None,
    shard_ids: int = SHARD_IDS,
) -> tuple[DataFrame, str]:
    """Write documents to a store; returns the table of its shards and its folder.

    Null and empty texts are the end token alone. Rows that repeat an id are
    documents of one key, in the order of their ids' checksum; rows without an id
    come first and have no key. An empty table gives a store without shards.
    """
    folder = folder or fresh_folder(docs.sparkSession, "token-files")
    return write_store(only(docs, id_column, text_column), folder, path or tokenizer_path(), shard_ids=shard_ids), folder


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, folder = to_files(table(spark, sf_dir, "documents"))
    return read_store(shards, folder)
