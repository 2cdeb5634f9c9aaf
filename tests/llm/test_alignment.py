"""Token alignment against brute force on bytes."""

import collections
import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabwright.llm import alignment
from tests.conftest import SMALL

RANDOM = random.Random(21)
WORDS = ["straightforward", "naïve", "日本語", "don't", "1234567", "\U0001f600", "a<s>b", "<|endoftext|>", "xyzzy", "!!??", "ﬁ", "é", "Großvater"]
TEXTS = [" ".join(RANDOM.choices(WORDS, k=RANDOM.randrange(1, 25))) for _ in range(40)]
TEXTS += ["", None, " ", "  a   b ", "\n\n x\ty \n", "a" * 3000, "ab" * 2500, "▁ a", "x▁y", "\0 a", "a b", "<0x41>", "\r\n", "word " * 60_000, "é" * 500]
ROWS = [(i * 3, t, i, "c") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[2], ROWS[2], (ROWS[5][0], "another text", 1, None), (None, "no id", 2, "c"), (None, None, 3, "c")]
SCHEMA = "doc_id long, text string, chunk long, codes string"


class Plain:
    """The definition, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(alignment.tokenizer_path())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_path())
        table, n = {}, 0
        for x in range(256):
            if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
                table[chr(x)] = x
            else:
                table[chr(256 + n)] = x
                n += 1
        self.byte_of = table

    def ends(self, parts):
        out, at = [], 0
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    def groups(self, text):
        """[(ids of a, ids of b)], or nothing."""
        if not text:
            return []
        data = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        in_a = [bytes(self.byte_of[c] for c in self.a.id_to_token(i)) for i in a]
        in_b = []
        for i in b:
            p = self.b.id_to_piece(i)
            in_b.append(bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode())
        if b"".join(in_a) != data or b"".join(in_b) != data:
            return []
        ends_a, ends_b = self.ends(in_a), self.ends(in_b)
        out, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            x, y = i, j
            while i < len(a) and ends_a[i] <= cut:
                i += 1
            while j < len(b) and ends_b[j] <= cut:
                j += 1
            out.append((a[x:i], b[y:j]))
        return out


@pytest.fixture(scope="module")
def plain():
    return Plain()


def brute(plain, rows):
    grouped = [(r[0], plain.groups(r[1])) for r in rows]
    links = []
    for _, groups in grouped:
        one = collections.Counter()
        for a, b in groups:
            of_b = collections.Counter(b)
            for x, n in collections.Counter(a).items():
                for y, m in of_b.items():
                    one[x, y] += n * m
        links.append(one)
    count = collections.Counter(p for one in links for p in one)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (key, groups), one in zip(grouped, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append(
            (
                key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(one.values()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
                sum(n for p, n in one.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in one.items()),
            )
        )
    return sorted(out, key=repr)


def collected(df):
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("chunk, run", [(alignment.CHUNK, alignment.RUN), (400, 90)])
def test_against_brute_force(spark, plain, chunk, run):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert collected(alignment.align_documents(df, chunk=chunk, run=run)) == brute(plain, ROWS)


def test_many_entries_of_a_chunk(spark, plain, monkeypatch):
    rows = [(i, " ".join(RANDOM.choices(WORDS, k=40)), 0, "") for i in range(30)]
    texts = [r[1] for r in rows]
    aligner = alignment.Aligner(alignment.tokenizer_path(), alignment.piece_path())
    whole, pairs = aligner.align(texts)
    monkeypatch.setattr(alignment, "TERMS", 60)
    found = list(alignment._chunks([r[0] for r in rows], [whole], [pairs], 0, iter(range(100))))
    assert len(found) > 3 and sum(len(c["documents"]) for c in found) == len(rows)
    counted = collections.Counter()
    for c in found:
        counted.update(dict(zip(c["pairs"].tolist(), c["counts"].tolist())))
    seen = collections.Counter(int(a << 32 | b) for _, a, b, _ in pairs)
    assert counted == seen


def test_no_rows(spark):
    assert alignment.align_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_equal_dense_ones():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        a, b = rng.integers(0, 3, (n, k)) * (rng.random((n, k)) < 0.4), rng.integers(0, 3, (k, m)) * (rng.random((k, m)) < 0.4)
        rows = [alignment.from_entries(*np.nonzero(x), x[np.nonzero(x)], *x.shape) for x in (a, b)]
        for parts in ([(0, alignment.product(*rows))], list(alignment.products(*rows, terms=3))):
            dense = np.zeros((n, m), int)
            for begin, part in parts:
                dense[begin + part.numbers(), part.columns] = part.values
            assert (dense == a @ b).all()


def test_overlaps_count_shared_bytes():
    aligner = alignment.Aligner(alignment.tokenizer_path(), alignment.piece_path())
    a, b = aligner.tokens(["straightforward naïve xyzzy"])[0]
    links = aligner.overlaps(a, b)
    ends_a, ends_b = np.cumsum(aligner.length_a[a]), np.cumsum(aligner.length_b[b])
    for i, j, n in zip(links.numbers(), links.columns, links.values):
        low = max(ends_a[i] - aligner.length_a[a[i]], ends_b[j] - aligner.length_b[b[j]])
        assert n == min(ends_a[i], ends_b[j]) - low > 0
    assert links.values.sum() == ends_a[-1]


def test_query(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(alignment.op13_token_alignment(spark, SMALL)) == brute(plain, rows)
