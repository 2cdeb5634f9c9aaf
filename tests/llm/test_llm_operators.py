"""Document operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import chunks, components, embeddings, fingerprints, language, minhash, packing, pieces, quality, suffixes
from tabwright.llm import html as pages
from tabwright.llm.rolling import raw_bytes

RANDOM = random.Random(5)
WORDS = ["".join(RANDOM.choice("abcdeé ßo"[:8]) for _ in range(RANDOM.randrange(2, 9))).replace(" ", "i") for _ in range(300)]


def prose(n, rng=RANDOM):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = prose(90)
LONG = prose(6000)


def _documents():
    texts = [prose(RANDOM.randrange(3, 120)) for _ in range(60)]
    texts += [texts[0]] * 4 + [texts[1] + " end"] + [texts[2].replace(" ", "  ", 3)]
    texts += [prose(30) + "\n" + PASSAGE + "\n" + prose(40) for _ in range(6)]
    near = prose(120).split()
    for _ in range(12):
        copy = list(near)
        for _ in range(3):
            copy[RANDOM.randrange(len(copy))] = RANDOM.choice(WORDS)
        texts.append(" ".join(copy))
    texts += ["", None, "x", "  ", "\n\n", "123 !!", "Ünï 日本 ﬁ \U0001f600", LONG, LONG + " more", "<s> <0x0A> ▁ a", "a" * 400, "a" * 400]
    rows = [(i * 3 + 1, t, "en" if i % 2 else "de") for i, t in enumerate(texts)]
    # a repeated row, and one id with another text
    return rows + [rows[5], (rows[6][0], prose(20), None)]


DOCS = _documents()
CLASHES = ["spans", "score", "x", "found", "id", "key", "v", "part", "root", "held_out"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    df = df.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(CLASHES)})
    return df.withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# -- components ---------------------------------------------------------------


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(50, 50), (None, 3), (39, 5)]
    got = {r["id"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(7, 40)]}}


# -- substring dedup ----------------------------------------------------------


def test_gear_is_the_rolled_hash():
    data = raw_bytes(LONG[:500])
    h = 0
    for i, b in enumerate(data):
        h = (2 * h + int(chunks._GEAR[b])) & 0xFFFFFFFF
        assert h & 0xFFFF == int(chunks.gear(data)[i]) & 0xFFFF


def test_cuts_follow_the_content():
    a, b = raw_bytes(PASSAGE), raw_bytes("é" * 7 + PASSAGE)
    assert {x + 14 for x in chunks.cuts(a).tolist() if 16 < x < len(a)} <= set(chunks.cuts(b).tolist())
    assert max(np.diff(chunks.cuts(raw_bytes("a" * 5000)))) <= chunks.LONGEST + 3


def _is_missed(passage, rng, average=chunks.AVERAGE):
    """Whether a passage between other words keeps all its bytes next to a copy between others."""
    found = []
    for _ in range(2):
        before = prose(12, rng) + " "
        data = raw_bytes(before + passage + " " + prose(12, rng))
        first = len(before.encode())
        at = chunks.cuts(data, average)
        found.append({(x - first, y - first) for x, y in itertools.pairwise(at.tolist()) if first <= x and y <= first + len(passage.encode())})
    both = sorted(found[0] & found[1])
    return not len(both) or not chunks._runs(np.array([(x + 1) * chunks.SIZES + y - x for x, y in both]), chunks.MIN_RUN)


def test_no_long_passage_is_missed():
    rng = random.Random(21)
    assert not any(_is_missed(prose(50, rng), rng) for _ in range(2000))


def test_chunks_against_brute_force(docs, nothing):
    assert chunks.without_repeats(nothing).count() == 0
    out = chunks.without_repeats(docs)
    assert out.columns == [*docs.columns, "_spans"]
    owner = {}
    cut = lambda t: [(x, y, raw_bytes(t)[x:y].tobytes()) for x, y in itertools.pairwise(chunks.cuts(raw_bytes(t)).tolist())]
    for i, t, _ in DOCS:
        for *_, d in cut(t) if t else ():
            owner[d] = min(i, owner.get(d, i))
    want = []
    for i, t, _ in DOCS:
        if not t:
            want.append((i, t))
            continue
        runs = []
        for x, y, d in cut(t):
            if owner[d] < i:
                runs = [*runs[:-1], (runs[-1][0], y)] if runs and runs[-1][1] == x else [*runs, (x, y)]
        raw, gone = t.encode(), [r for r in runs if r[1] - r[0] >= chunks.MIN_RUN]
        for x, y in reversed(gone):
            raw = raw[:x] + raw[y:]
        want.append((i, raw.decode()))
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    with_passage = [i for i, t, _ in DOCS if t and PASSAGE in t]
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert PASSAGE in kept[with_passage[0]] and all(PASSAGE not in kept[i] for i in with_passage[1:])


# -- embeddings ---------------------------------------------------------------


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 24))
    x[50:90] = x[:40] + 0.12 * rng.standard_normal((40, 24))
    x[90:110] = x[3] + 0.2 * rng.standard_normal((20, 24))
    x[110:115] = x[7]
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [None] * 24, [float("inf")] * 24, [1.0, 2.0], [2.0, 4.0], [-1.0, 2.0]]
    rows += [(200 + i, v) for i, v in enumerate(odd)] + [rows[0], (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("u", F.lit(1)).withColumn("id", F.lit(2))
    u = {}
    use = [(i, v) for i, v in rows if i and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95
    links = [sum(near(v, w) for _, w in use) - 1 for _, v in use]
    for i, v in use:
        u.setdefault(i, set()).update(j for j, w in use if near(v, w))
    least = {i: i for i in u}
    for _ in range(len(u)):
        least = {i: min(least[j] for j in u[i]) for i in u}
    want = sorted([(i, n, least[i], i == least[i]) for (i, _), n in zip(use, links)])
    got = [tuple(r) for r in embeddings.near_vectors(df).collect()]
    assert sorted(r for r in got if r[0] in u) == want
    assert all(r[1:] == (0, r[0], True) for r in got if r[0] not in u) and len(got) == len(rows)
    assert max(links) > 15
    assert embeddings.near_vectors(df.filter("false")).count() == 0


def _folder_bytes():
    top = "/tmp/tabwright-tests-shared"
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names if f.endswith(".parquet"))


def test_vectors_lie_on_disk_a_few_times(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x[3000:3300] = x[:300] + 0.02 * rng.standard_normal((300, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = _folder_bytes()
    got = {r[0]: r[1] for r in embeddings.near_vectors(df).collect()}
    assert _folder_bytes() - before < 4 * x.nbytes
    assert got == {i: int(i < 300 or 3000 <= i < 3300) for i in range(6000)}


def test_vectors_of_many_units(spark):
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((60, 24)), 5, axis=0) + 0.08 * rng.standard_normal((300, 24))
    x[:, 0] += 1
    # No double holds these ids.
    ids = [2**60 + i for i in range(300)]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "vec_id long, embedding array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    reached = near
    for _ in range(9):
        reached = reached @ reached
    want = [(ids[i], int(near[i].sum()) - 1, ids[np.flatnonzero(reached[i])[0]], not reached[i, :i].any()) for i in range(300)]
    # Units of 20 rows, so that most links are between two.
    assert sorted(tuple(r) for r in embeddings.near_vectors(df, unit=20 * 24).collect()) == want
    assert sum(n for _, n, _, _ in want) > 500


def test_budgets_cover_the_distance():
    for d in (1, 2, 7, 24, 64, 100):
        assert embeddings.budgets(d, 0.95).sum() >= 0.1 and embeddings.blocks_of(d)[-1].stop == d
        q = embeddings.rotation(d)
        assert np.allclose(q @ q.T, np.eye(d))


# -- packing ------------------------------------------------------------------


def test_tokens_word_by_word():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.encode_special_tokens = True
    words = packing.WordTokenizer(packing.tokenizer_path())
    rng = random.Random(1)
    odd = ["".join(rng.choice(" \n\t ab'1.\x0b\r\x1d\0é　日") for _ in range(rng.randrange(14))) for _ in range(3000)]
    odd += ["<|endoftext|> a", "it's  x", LONG, "", *[t for _, t, _ in DOCS if t]]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(odd, add_special_tokens=False)]
    assert words.encode(odd) == want


def test_added_tokens_keep_their_ids(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(6)
    odd = ["".join(rng.choice(["<|endoftext|>", " ", "\n", "a", "it's", "é", "  ", "<|", "|>"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    odd += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> c", "<|endoftext|", "", *[t for _, t, _ in DOCS[:9] if t]]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(odd, add_special_tokens=False)]
    assert packing.WordTokenizer(packing.tokenizer_path(), added=True).encode(odd) == want
    row = packing.pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")).collect()[0]
    ids = [*whole.encode("a <|endoftext|> b", add_special_tokens=False).ids, 0]
    assert (row["length"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


@pytest.mark.parametrize("rule,documents,attention", [("norm", None, None), ("dot", None, None), ("norm", 3, None), ("dot", 5, 300_000), ("norm", 4, 1024 * 1024)])
def test_packing_keeps_every_capacity(rule, documents, attention):
    rng = random.Random(2)
    counts = collections.Counter(min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(5000))
    if attention:
        counts = {k: v for k, v in counts.items() if k * k <= attention}
    bins = collections.defaultdict(list)
    ranks = collections.defaultdict(list)
    for p in packing.place(counts, 1024, documents, attention, rule):
        for k in range(p.count):
            bins[p.base + k].append((p.offset, p.length))
            ranks[p.length].append(p.first + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024 and len(rows) <= (documents or 1024) and sum(n * n for _, n in rows) <= (attention or 1024 * 1024)
    if not documents and not attention:
        assert len(bins) <= -(-sum(k * n for k, n in counts.items()) // 1024) + 1


def test_pieces_and_places(docs, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    rows = [r.asDict() for r in packing.pack(docs, capacity=512).collect()]
    bins = collections.defaultdict(list)
    found = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        found[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in bins.values():
        ends = list(itertools.accumulate(n for _, n in sorted(places)))
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 512
    want = collections.defaultdict(list)
    for i, t, _ in DOCS:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) - (-(-len(ids) // 512) - 1) * 512
        edges = [0, *range(first, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(itertools.pairwise(edges)):
            want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(bins) <= 1.03 * sum(r["length"] for r in rows) / 512
    assert packing.pack(nothing).count() == 0


# -- quality and language -----------------------------------------------------


def test_discriminant_against_densities(spark):
    rng = np.random.default_rng(4)
    d = len(quality.FEATURES)
    mix = rng.standard_normal((2, d, d)) / 3 + np.eye(d)
    x = np.concatenate([rng.standard_normal((200, d)) @ mix[0], rng.standard_normal((300, d)) @ mix[1] + 1.0])
    y = [0] * 200 + [1] * 300
    df = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y)], "x array<double>, quality int")
    model = quality.fit(df, pooled=0.1, identity=0.02)
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = 0.4 * covs[0] + 0.6 * covs[1]
    logs = []
    for k in (0, 1):
        cov = 0.9 * covs[k] + 0.1 * pooled
        cov = 0.98 * cov + 0.02 * np.trace(cov) / d * np.eye(d)
        gap = z - z[np.array(y) == k].mean(0)
        logs.append(np.log([0.4, 0.6][k]) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-8)


def test_quality_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(bool(t) and len(t) > 60), 0) for i, t, _ in DOCS], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert quality.quality_scores(nothing, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.filter("false")).collect()} == {0.5}


def test_distinct_words_are_of_the_whole_text():
    at = quality.FEATURES.index("distinct_share")
    for n, edges in ((30, [0, 30]), (149, [0, 149]), (150, [0, 150]), (151, [0, 100, 151]), (249, [0, 100, 249]), (300, [0, 100, 200, 300])):
        words = [f"w{i}" if i < n - 20 else "same" for i in range(n)]
        distinct = sum(len(set(words[a:b])) for a, b in itertools.pairwise(edges)) / n
        assert quality.statistics(" ".join(words))[at] == quality._logit(distinct, n)


def test_long_words_are_summed_whole():
    """Words of any length: the same recurrence in exact logarithms, and languages that differ."""
    vocabulary = language.Vocabulary(("▁a", "a", "aa", "b"))
    lattice = language.Lattice(vocabulary)
    p = np.array([[0.1, 0.2], [0.1, 0.2], [0.01, 0.02], [0.3, 0.3], [1e-7, 1e-7]])
    assert language.words_of("a" * 100) == ["a" * 100]
    for word in ("a" * 60, "a" * 2000, "ab" * 100, "ü" * 45, "a" * 40):
        got = language.log_likelihoods([word], lattice, p)[0]
        text = "▁" + word
        for k in range(2):
            sums = [Fraction(1)]
            for e in range(1, len(text) + 1):
                ways = [(text[b:e], sums[b]) for b in range(max(0, e - 2), e)]
                at = [lattice.number.get(x, lattice.unknown if len(x) == 1 else None) for x, _ in ways]
                sums.append(sum((s * Fraction(float(p[i, k])) for i, (_, s) in zip(at, ways) if i is not None), Fraction(0)))
            exact = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert np.isclose(got[k], exact, rtol=1e-9)
        assert ("a" in word) == bool(got[0] != got[1])
        edges, logs = lattice.edges([word]), np.log(p)
        assert np.allclose(language._back_log_sums(word, edges, logs)[0], language._log_sums(word, edges, logs)[-1])


def test_forward_sums_all_segmentations():
    vocabulary = language.Vocabulary(("▁a", "▁", "a", "ab", "b", "ba", "▁ab", "bab"))
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((8, 2)), [[language.UNKNOWN] * 2]])
    lattice = language.Lattice(vocabulary)
    for word in ("a", "ab", "abab", "bbab", "axb"):
        whole, total = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(whole)]
            weight = np.ones(2)
            for part in (whole[a:b] for a, b in itertools.pairwise(edges)):
                known = lattice.number.get(part)
                weight = weight * (p[known] if known is not None else p[-1] if len(part) == 1 else 0)
            total += weight
        assert np.allclose(np.exp(language.log_likelihoods([word], lattice, p))[0], total, rtol=1e-5)


def test_languages_of_odd_rows(spark, nothing):
    rng = random.Random(9)
    words = {"de": ["der", "und", "ist", "nicht", "schule"], "fr": ["le", "être", "mais", "école", "jour"], "en": ["the", "and", "was", "school", "day"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(2, 30))), k) for i in range(240) for k in [list(words)[i % 3]]]
    rows += [(900, None, "de"), (901, "", "de"), (902, "123 *** 4", "fr"), (903, "THE DAY " * 20000, None), (None, "und der", "de"), (5, "mais", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("found", F.lit(1)).withColumn("score", F.lit("s"))
    got = language.languages(df).collect()
    assert len(got) == len(rows)
    right = {(i, t): k for i, t, k in rows}
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    found = {r["doc_id"]: r for r in got}
    assert [found[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]
    assert found[900]["score"] == 0
    assert all(found[i]["lang_pred"] == k for (i, _), k in right.items() if i is not None and i < 240 and i != 5)
    assert language.languages(df.filter("false")).count() == 0
    assert {r["lang_pred"] for r in language.languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# -- MinHash forest -----------------------------------------------------------


def shingles(text, size):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(docs, nothing, size):
    best = {}
    for i, t, _ in DOCS:
        s = shingles(t, size)
        if i not in best or len(s) > len(best[i]):
            best[i] = s
    least = {i: i for i in best}
    near = {i: [j for j in best if 100 * len(best[i] & best[j]) >= 80 * len(best[i] | best[j]) and best[i] and best[j]] for i in best}
    for _ in range(len(best)):
        least = {i: min([least[j] for j in near[i]] or [i]) for i in best}
    got = minhash.near_duplicates(docs, words=size).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r["component_id"], r["kept"]) == (least[r["doc_id"]], r["doc_id"] == least[r["doc_id"]])
    sizes = collections.Counter((i, len(shingles(t, size))) for i, t, _ in DOCS)
    assert collections.Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    if size == 2:
        assert sum(not r["kept"] for r in got) > 12
        assert minhash.near_duplicates(nothing, words=2).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sig = [np.frombuffer(minhash.signature(np.unique(x)), np.uint8) for x in (a[:3000], a[:2700], a[1500:])]
    assert abs((sig[0] == sig[1]).mean() - 0.9) < 0.1 and abs((sig[0] == sig[2]).mean() - 0.375) < 0.15


def test_floors_share_no_minimum():
    floors = minhash._ORDERS[:, : minhash.FLOOR].ravel()
    assert len(set(floors.tolist())) == len(floors) == minhash.TREES * minhash.FLOOR
    assert all(len(set(order)) == minhash.DEPTH for order in minhash._ORDERS.tolist())
    n, least = minhash.HASHES, int(np.ceil(minhash.LIKELY * minhash.HASHES))
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(least)) < 1e-8


# -- suffix sort --------------------------------------------------------------


def test_suffix_sort_against_sorting():
    rng = random.Random(3)
    raw = "".join(rng.choice("ab") for _ in range(400)) + "abab" * 60 + LONG[:300]
    data = raw_bytes(raw * 2)
    at = np.array(rng.sample(range(len(data) - 50), 700))
    order, shared = suffixes.suffix_sort(data, at, 50)
    text = data.tobytes()
    got = [text[at[i] : at[i] + 50] for i in order]
    assert got == sorted(got)
    for a, b, n in zip(got, got[1:], shared.tolist()):
        assert n == next((k for k in range(50) if a[k] != b[k]), 50)


def test_windows_have_one_owner():
    data = raw_bytes(LONG[:3000] + "a" * 200)
    h, first, last, _ = suffixes.stretches(data, 50, 16)
    assert [x for a, b in zip(first, last) for x in range(a, b + 1)] == list(range(len(data) - 49))


def test_places_of_long_windows(spark):
    rng = random.Random(8)
    passage = prose(400, rng)
    rows = [(i, prose(60, rng) + passage[40 * i : 1200 + 17 * i] + prose(40, rng)) for i in range(12)]
    seen = {}
    for i, t in rows:
        raw = t.encode()
        for k in range(len(raw) - 99):
            seen.setdefault(raw[k : k + 100], i)
    want = {}
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if seen[raw[k : k + 100]] < i:
                gone[k : k + 100] = b"\1" * 100
        want[i] = bytes(b for b, g in zip(raw, gone) if not g)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.without_repeats(df, length=100).collect()} == want


@pytest.mark.parametrize("parts", [3, 40])
def test_suffixes_against_brute_force(spark, docs, nothing, parts):
    seen = {}
    for i, t, _ in DOCS:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            seen[raw[k : k + 50]] = min(i, seen.get(raw[k : k + 50], i))
    want = collections.Counter()
    for i, t, _ in DOCS:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept] += 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.without_repeats(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
    assert suffixes.without_repeats(nothing).count() == 0


# -- pages --------------------------------------------------------------------

PAGES = [
    (None, ""),
    ("", ""),
    ("<nav><a href=x>one two three</a></nav>", ""),
    ('<body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy &amp; go</div><article><h1>T&eacute;st</h1><p><b>One\n two.<br><p>Three &lt;four&gt;</p></article><footer>&copy; x</footer></body>', "Tést\n\nOne two.\n\nThree <four>"),
    ('<article><p>Kept.</p><div id="comments"><p>Reader says.</p></div><aside>No</aside><form><p>Mail</p></form><script>var t="</p><p>no";</script><p>Also kept.</p></article>', "Kept.\n\nAlso kept."),
    ("<main><p>It goes <a href=y>on and on</a> here</p></main><p>outside</p>", "It goes on and on here"),
    ("<p>" + "long line of words " * 30 + "</p>" + "<p>more of it here</p>" * 3 + "<nav>" + "<p>x</p>" * 9 + "</nav><p>bye</p>", None),
    ("<article><p>never closed", "never closed"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string").withColumn("text", F.lit(3))
    got = {r["page_id"]: r for r in pages.extract(df).collect()}
    for i, (_, text) in enumerate(PAGES):
        if text is not None:
            assert got[i]["text"] == text and got[i]["n_chars"] == len(text) and got[i]["url"] == f"u{i}"
    assert got[6]["text"].count("more of it here") == 3 and "bye" not in got[6]["text"]
    assert pages.extract(df.filter("false")).count() == 0


def test_names_and_attributes_of_pages():
    text = "<h1>T</h1><p>One two.</p>"
    for page in (
        f'<div class="content-sidebar-wrap"><main>{text}</main></div>',
        f'<div class="sidebar"><main>{text}</main></div>',
        f'<main><div class="widget"><article>{text}</article></div></main>',
        f'<body class="no-sidebar nav"><div>{text}</div></body>',
        f'<html class="cookie"><body class="no-sidebar"><article class="post category-social comment">{text}</article>',
        f'<article title="the hidden cost of rent" data-x="display:none; hidden = 1">{text}</article>',
        f'<div title=" hidden "><article>{text}</article></div><div class="sidebar"><article>Teaser of more.</article></div>',
        '<div class="ad"><article>Teaser.</article></div>' + f"<article>{text}</article>",
        f'<main>{text}<p hidden>no</p><p HIDDEN="">no</p><p style="color:red; display : none">no</p><p aria-hidden=true>no</p><div ID=Comments><article>He says.</article></div></main>',
    ):
        assert pages.main_text(page) == "T\n\nOne two.", page
    assert pages.main_text('<article><p class="section-header">Head of it</p><p>So.</p></article>') == "Head of it\n\nSo."
    sum_ = "<math><mi>x</mi><mo>=</mo><msup><mn>2</mn><mi>k</mi></msup></math>"
    assert pages.main_text(f"<article><p>As {sum_} is.</p><figure><img src=a><figcaption>A view.</figcaption></figure></article>") == "As x=2k is.\n\nA view."


def test_regions_of_any_size():
    long = "<p>" + "A long line of words. " * 200 + "</p>"
    want = ("A long line of words. " * 200).strip()
    menu = "<ul>" + "<li><a href=x>Some other page</a></li>" * 5 + "</ul>"
    advert = '<div class="ad">' + "<p>Buy this now.</p>" * 5 + "</div>"
    for between in (menu, advert):
        assert pages.main_text(long + between + "<p>So it ends.</p>") == want + "\n\nSo it ends."
        assert pages.main_text("<h1>Title</h1>" + between + long) == "Title\n\n" + want
        assert pages.main_text(long + between + "<div>42</div>" + between) == want + "\n\n42"
    linked = "<p><a href=x>A paragraph that is one link.</a></p>"
    assert pages.main_text(long + linked) == want + "\n\nA paragraph that is one link."
    assert pages.main_text(long + linked * 2 + long).count("one link.") == 2
    assert pages.main_text("<p><a href=x>R&eacute;sum&eacute;</a> ok</p>") == "Résumé ok"
    assert pages.main_text("<p><a href=x>\n   wide\n    link \n</a>ok</p>") == "wide link ok"
    assert pages.main_text("<p><a name=top>An anchor is no link.</p><p>Or is it?</p>") == "An anchor is no link.\n\nOr is it?"
    assert pages.main_text(menu + "<p><a href=x>One</a> | <a href=y>Two</a></p>") == ""


def test_regions_inside_the_mark():
    links = lambda n: "<ul>" + "<li><a href=x>Other page</a></li>" * n + "</ul>"
    text = "<h1>Title</h1><p>A line of words.</p><p>Yes.</p><p><a href=x>One link.</a></p>"
    want = "Title\n\nA line of words.\n\nYes.\n\nOne link."
    for n in (2, 5, 9):
        assert pages.main_text(f"<main>{links(n)}<article>{text}</article>{links(n)}</main>") == want
    both = f"<main>{text}{links(6)}{text}</main>"
    assert pages.main_text(both) == want + "\n\n" + want and pages.main_text(both, window=20).count("Other") == 6
    assert pages.main_text(f"<article>{text}{links(6)}{text}</article>") == want + "\n\n" + want
    assert pages.main_text(f"<article>{text}{links(3)}</article>") == want + "\n\nOther page" * 3
    assert pages.main_text(f"<main>{links(8)}</main>").count("Other page") == 8


def test_regions_surge_and_dive():
    weights = np.array([0, 0, 5, 0, 9, 0, 0, 0, 0, 0, 7, 7, 0])
    assert pages.regions(weights, 3) == [(2, 4), (10, 11)]


# -- fingerprints -------------------------------------------------------------


def test_sketches_give_back_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((0, 0), (3, 0), (40, 35), (400, 390), (2000, 10)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**63, m, dtype=np.uint64)])
        gone, come = fingerprints.difference(a, b)
        assert (set(gone.tolist()), set(come.tolist())) == (set(a.tolist()) - set(b.tolist()), set(b.tolist()) - set(a.tolist()))


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_against_brute_force(spark, docs, nothing, parts):
    one = docs.dropDuplicates(["doc_id"]).orderBy("doc_id")
    rows = sorted(((r["doc_id"], r["text"] or "") for r in one.collect()), reverse=True)
    cut = lambda t: collections.Counter(x.strip() for x in re.split(r"(?<=[.!?])\s+|\n", t) if x.strip())

    def like(a, b):
        a, b = cut(a), cut(b)
        n = sum(a.values()) + sum(b.values())
        return 2 * sum((a & b).values()) / n if n else 1.0

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("p"))
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        changed = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(t, changed)) and r["near_next"] == pytest.approx(like(t, u))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (cut(t) == cut(changed))
    assert fingerprints.fingerprints(docs).count() == len(DOCS)
    assert fingerprints.fingerprints(nothing).count() == 0


# -- pieces -------------------------------------------------------------------


def test_pieces_are_those_of_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    machine = pieces.Transducer(pieces.model_path())
    rng = random.Random(4)
    parts = ["a", "b", " ", "  ", "the", "\n", "é", "日", "ﬁ", "Ａ", "\0", "<s>", "<0x0A>", "ing", "1", "23", " " * 17, "\t", "😀", "er", "th", "re"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + [t for _, t, _ in DOCS if t]
    for t in texts:
        ids = machine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t), t
        assert machine.decode(ids) == t.replace("▁", " ")


def test_pieces_of_odd_rows(docs, nothing):
    out = pieces.decode(pieces.encode(docs)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted(((i, (t or "").replace("▁", " ")) for i, t, _ in DOCS), key=repr)
    assert pieces.encode(nothing).count() == 0


def test_region_of_one_large_group_and_others(spark):
    """Many near copies and many unlike documents under the same prefixes: links as by all pairs."""
    rng = random.Random(31)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 9, 14])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    sets = [set(map(int, minhash.shingle_set(t, 2))) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    before = minhash.BLOCK
    try:
        minhash.BLOCK = 16
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2)
        found = {r["doc_id"]: r["component_id"] for r in got.collect()}
    finally:
        minhash.BLOCK = before
    assert found == {i: root(i) for i in range(len(rows))}
    assert len(set(found.values())) > 20


def test_one_signed_sketch_is_the_difference_of_two():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (40, 25))
    one = fingerprints.Sketch.of(np.concatenate([a, b]), 60, times=np.repeat([1, -1], [40, 25]))
    two = fingerprints.Sketch.of(a, 60) - fingerprints.Sketch.of(b, 60)
    assert all((getattr(one, k) == getattr(two, k)).all() for k in ("count", "key", "check"))


def test_decoding_builds_no_arcs():
    machine = pieces.Transducer(pieces.model_path())
    ids = pieces.Transducer(pieces.model_path()).encode("one line, ßé")
    assert machine.decode(ids) and "arcs" not in vars(machine)


def test_a_worker_keeps_one_thing_at_a_time():
    from tabwright.llm import common

    made = []
    make = lambda name: lambda: made.append(name) or name
    assert [common.kept(k, make(k)) for k in ("labeller", "labeller", "tokenizer")] == ["labeller", "labeller", "tokenizer"]
    assert made == ["labeller", "tokenizer"] and list(common._KEPT) == ["tokenizer"]


def test_steps_that_keep_nothing_drop_what_is_kept():
    from tabwright.llm import common

    common.kept("labeller", lambda: object())
    list(quality._vectors(iter([])))
    assert not common._KEPT
    common.kept("tokenizer", lambda: object())
    list(minhash._flagged(iter([])))
    assert not common._KEPT


def test_runs_of_chunks_are_made_once(spark, docs, capfd):
    chunks.repeats(docs.select("doc_id", "text")).explain()
    plan = capfd.readouterr().out
    assert "ArrowEvalPython" not in plan and plan.count("MapInPandas") == 2


@pytest.mark.parametrize("parts", [1, 24])
def test_windows_of_a_large_group_stay_in_their_task(spark, monkeypatch, parts):
    rng = random.Random(12)
    passage = prose(30, rng)[:160]
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(i, letters(70) + passage + letters(4 if i % 9 else 0) + "z" * (i % 3) + letters(60)) for i in range(400)]
    rows += [(900 + i, rows[i][1][20:260]) for i in range(0, 400, 7)]
    seen, want = {}, {}
    for i, t in rows:
        for k in range(len(t) - 49):
            seen.setdefault(t[k : k + 50], i)
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        want[i] = "".join(c for c, g in zip(t, gone) if not g).encode()
    made = {}
    monkeypatch.setattr(suffixes, "publish", lambda df, label, old=suffixes.publish: made.setdefault(label, old(df, label)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.without_repeats(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made["windows"].where("h is not null").count() <= 2 * made["stretches"].count()
