"""Token files: exact round trip, keyed access, the hash."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabwright.llm import tokenfiles
from tests.conftest import SMALL

RANDOM = random.Random(11)
WORDS = ["don't", "I'LL", "Größe", "naïve", "éte", "日本語", "x1y22", "!!!", "<|endoftext|>", "a<|startoftext|>b", "\U0001f600", "ΣΑΣ", "İ", "'s", "...", "<|ENDOFTEXT|>", "IT'S", "A\0B"]
TEXTS = [" ".join(RANDOM.choices(WORDS, k=RANDOM.randrange(1, 30))) for _ in range(60)]
TEXTS += ["", None, " ", "\n\t ", "a\tb c　d\x1ce\x85f", "x " * 5, " ́a", "long " * 200_000, "y" * 20_000, "\0 \0a", "a ́b"]
TEXTS += [" ".join(RANDOM.choices([w for w in WORDS if w.isascii() and "|" not in w] + ["Plain", "WORDS,"], k=50)) for _ in range(9)]
ROWS = [(i * 7 - 100, t, i, "k") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[3], ROWS[3], (ROWS[4][0], "another text", 1, None), (None, "no id", 2, "k"), (None, None, 3, "k"), (2**62 + 1, "far", 4, "k"), (2**62, "near", 4, "k")]
SCHEMA = "doc_id long, text string, salt long, crc string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenfiles.tokenizer_path())


def ids_of(plain, text):
    return np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def wanted(plain, rows):
    """Rows in order of id; of one id in the order of the stored ids' checksum."""
    coded = sorted(
        ((k is not None, k or 0, zlib.crc32(ids.astype("<u2").tobytes()), ids) for k, ids in ((r[0], ids_of(plain, r[1])) for r in rows)),
        key=lambda r: r[:3],
    )
    out, at = [], 0
    for known, k, _, ids in coded:
        out.append((k if known else None, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [200, 1 << 25])
def test_round_trip(spark, plain, shard_ids):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(6)
    shards, folder = tokenfiles.to_files(df, shard_ids=shard_ids)
    got = sorted((tuple(r) for r in tokenfiles.read_store(shards, folder).collect()), key=lambda r: r[1])
    assert got == wanted(plain, ROWS)
    listed = sorted(shards.collect(), key=lambda r: r["shard"])
    assert [r["shard"] for r in listed] == list(range(len(listed)))
    assert sum(r["documents"] for r in listed) == len(ROWS)
    assert [r["begin"] for r in listed] == [sum(x["ids"] for x in listed[:i]) for i in range(len(listed))]


def test_keyed_access(spark, plain):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(6)
    shards, folder = tokenfiles.to_files(df, shard_ids=200)
    starts = {}
    for k, at, n, _ in wanted(plain, ROWS):
        starts.setdefault(k, []).append((at, n))
    keys = sorted({r[0] for r in ROWS if r[0] is not None})
    asked = spark.createDataFrame([(k,) for k in [*keys, *keys[:5], 1, -99, 10**12, -(10**12), None]], "doc_id long")
    found = tokenfiles.fetch(shards, folder, asked).collect()
    by_key = {}
    for r in sorted(found, key=lambda r: r["start"]):
        by_key.setdefault(r["key"], []).append((r["start"], len(r["ids"])))
    assert by_key == {k: starts[k] for k in keys}
    texts = {r[0]: r[1] for r in ROWS[: len(TEXTS)]}
    for r in found:
        if len(starts[r["key"]]) == 1 and r["key"] in texts:
            assert r["ids"] == ids_of(plain, texts[r["key"]]).tolist()


def test_one_key_over_many_shards(spark):
    rows = [(5, f"w{i} " * 30, 0, "") for i in range(300)] + [(4, "a", 0, ""), (6, "b", 0, "")]
    shards, folder = tokenfiles.to_files(spark.createDataFrame(rows, SCHEMA).repartition(4), shard_ids=500)
    found = tokenfiles.fetch(shards, folder, spark.createDataFrame([(5,), (6,)], "doc_id long"))
    assert {r["key"]: r["n"] for r in found.groupBy("key").agg(F.count("*").alias("n")).collect()} == {5: 300, 6: 1}
    assert shards.where("low = 5 and high = 5").count() > 2


def test_no_rows(spark):
    shards, folder = tokenfiles.to_files(spark.createDataFrame([], SCHEMA))
    assert shards.count() == 0 and tokenfiles.read_store(shards, folder).collect() == []
    assert tokenfiles.fetch(shards, folder, spark.range(3).toDF("doc_id")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    found = tokenfiles.PerfectHash.build(keys)
    assert sorted(found.places(keys).tolist()) == list(range(len(keys)))
    assert not n or len(found.bits) * 64 < 6 * n + 640


def test_fingerprints_part_keys():
    keys = np.arange(10_000).astype(np.uint64)
    assert len(np.unique(tokenfiles.mixed(keys, tokenfiles.FINGERPRINT))) == len(keys)


def test_parts_are_only_taken_where_the_file_allows_it():
    import json

    import public_tokenizers

    load = lambda name: json.load(open(public_tokenizers.path(name), encoding="utf-8"))
    assert tokenfiles.parts_at_blanks(load("word_bpe_49k.json"))
    assert not tokenfiles.parts_at_blanks(load("byte_bpe_50k.json"))


def test_another_vocabulary(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r for r in ROWS if r[0] is not None][:40]
    shards, folder = tokenfiles.to_files(spark.createDataFrame(rows, SCHEMA), path=path)
    got = sorted((tuple(r) for r in tokenfiles.read_store(shards, folder).collect()), key=lambda r: r[1])
    assert got == wanted(Tokenizer.from_file(path), rows)


def test_query(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = tokenfiles.op12_token_files(spark, SMALL).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == wanted(plain, rows)


def test_older_words_are_asked_one_by_one(plain):
    class Older(dict):
        def __iter__(self):
            raise AssertionError("the whole table was gone through")

    words = tokenfiles.WordIds(tokenfiles.tokenizer_path())
    data = words.encode(["older words"])
    words.known, words.older = {"": b""}, Older(words.known)
    assert words.encode(["older words"]) == data


def test_words_of_letters_have_one_end_each(plain):
    texts = ["plain words ΣΑΣ İ naïve 日本語 ﬁ Ǆ ͅ", "ªº x ʰ ᾳ Å 각 don't a1 ſ", "ab" * 300 + " c"]
    words = tokenfiles.WordIds(tokenfiles.tokenizer_path())
    assert words.ends is not None
    assert words.encode(texts) == [ids_of(plain, t)[:-1].astype(words.dtype).tobytes() for t in texts]
