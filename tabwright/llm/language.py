"""Language identification by segmentation-marginalised unigrams.

The pieces are the fixed vocabulary of a public tokenizer. A language is a
probability for each piece; a word's likelihood is the sum, over every way to
cut it into pieces, of the product of their probabilities (forward algorithm),
and a text's is the product over its words. Pieces never cross words, so each
distinct word is summed once. The probabilities are fitted by expectation
maximisation: expected piece counts under all segmentations of the training
words, a Spark aggregation whose result is one number per (language, piece).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, held_out, kept, only, publish, table, unused

#: Training rows for each language, at most about so many (chosen by a hash of the id).
TRAINING_ROWS = 4000
ROUNDS = 2
SMOOTHING = 0.05
#: A character that is no piece counts as a piece of this probability.
UNKNOWN = 1e-7
#: Words in a table of their sums; a Python worker keeps two tables.
CACHED_WORDS = 200_000
#: Letters of the words that a table of sums may hold.
CACHED_LETTERS = 2**25
#: Longer words, and those with smaller sums, are summed one by one in logarithms.
TOGETHER = 48
TINY = 1e-280
UNDETERMINED = "und"
#: A document stays in the pipeline with a known language of at least this posterior.
CONFIDENT = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters of the whole text."""
    return _WORD.findall(text.lower()) if text else []


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of letters, each with or without the mark of a word's start."""

    pieces: tuple[str, ...]

    @classmethod
    def public(cls, path: str | None = None) -> "Vocabulary":
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        raw = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_byte(i))
        keep = (p for p in raw if re.fullmatch(r"▁?[^\W\d_]+", p))
        return cls(tuple(dict.fromkeys(keep)))


#: Multiplier of the hashes by which runs of characters are looked up.
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Lattice:
    """The pieces that occur in words, as edges between character places.

    Characters are looked up for all places at once, one more at a time: a place
    stays as long as a piece begins with what stands there.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.number = {p: i for i, p in enumerate(vocabulary.pieces)}
        self.unknown = len(self.number)
        known: dict[int, int] = {}
        for piece, number in self.number.items():
            h = 0
            for k, code in enumerate(map(ord, piece)):
                h = (h * int(_STEP) + code) & 0xFFFFFFFFFFFFFFFF
                known[h] = number if k == len(piece) - 1 else known.get(h, -1)
        order = sorted(known)
        self.hashes = np.array(order, np.uint64)
        self.numbers = np.array([known[h] for h in order], np.int64)

    def edges(self, words: Sequence[str]) -> tuple[np.ndarray, ...]:
        """(word, from, to, piece) of all words, ordered by end place and word."""
        codes = _codes("".join(f"▁{w}" for w in words))
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        at = np.arange(len(codes))
        h = np.zeros(len(codes), np.uint64)
        parts = []
        length = 0
        while len(at):
            h = h * _STEP + codes[at + length]
            length += 1
            spot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1) if len(self.hashes) else None
            there = self.hashes[spot] == h if spot is not None else np.zeros(len(at), bool)
            number = np.where(there, self.numbers[spot] if spot is not None else -1, -1)
            if length == 1:
                number = np.where(number < 0, self.unknown, number)
            ends = number >= 0
            parts.append((word[at[ends]], place[at[ends]], place[at[ends]] + length, number[ends]))
            goes_on = there & (left[at] > length)
            at, h = at[goes_on], h[goes_on]
        arrays = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((arrays[0], arrays[2]))
        return tuple(x[order] for x in arrays)


def _add_runs(target: np.ndarray, which: np.ndarray, values: np.ndarray) -> None:
    """Add to rows of target; equal rows stand together."""
    begins = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    target[which[begins]] += np.add.reduceat(values, begins, axis=0)


def _sums(words: Sequence[str], edges: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
    """Forward sums [place, word, language] over all segmentations."""
    which, begin, end, piece = edges
    places = max((len(w) for w in words), default=0) + 2
    alpha = np.zeros((places, len(words), p.shape[1]))
    alpha[0] = 1.0
    cuts = np.searchsorted(end, np.arange(places + 1))
    for e in range(1, places):
        at = slice(cuts[e], cuts[e + 1])
        if at.start < at.stop:
            _add_runs(alpha[e], which[at], alpha[begin[at], which[at]] * p[piece[at]])
    return alpha


def _back_sums(words: Sequence[str], edges: tuple[np.ndarray, ...], p: np.ndarray) -> np.ndarray:
    """Backward sums [place, word, language] over all segmentations."""
    order = np.lexsort((edges[0], edges[1]))
    which, begin, end, piece = (x[order] for x in edges)
    places = max((len(w) for w in words), default=0) + 2
    beta = np.zeros((places, len(words), p.shape[1]))
    beta[[len(w) + 1 for w in words], np.arange(len(words))] = 1.0
    cuts = np.searchsorted(begin, np.arange(places + 1))
    for b in range(places - 1, -1, -1):
        at = slice(cuts[b], cuts[b + 1])
        if at.start < at.stop:
            _add_runs(beta[b], which[at], beta[end[at], which[at]] * p[piece[at]])
    return beta


def _log_sums(word: str, edges: tuple[np.ndarray, ...], logs: np.ndarray) -> np.ndarray:
    """Logarithms of the forward sums [place, language] of one word, of any length."""
    _, begin, end, piece = edges
    alpha = np.full((len(word) + 2, logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    cuts = np.searchsorted(end, np.arange(len(word) + 3))
    for e in range(1, len(word) + 2):
        at = slice(cuts[e], cuts[e + 1])
        alpha[e] = np.logaddexp.reduce(alpha[begin[at]] + logs[piece[at]], axis=0)
    return alpha


def _back_log_sums(word: str, edges: tuple[np.ndarray, ...], logs: np.ndarray) -> np.ndarray:
    """Logarithms of the backward sums [place, language] of one word, of any length."""
    order = np.argsort(edges[1], kind="stable")
    _, begin, end, piece = (x[order] for x in edges)
    beta = np.full((len(word) + 2, logs.shape[1]), -np.inf)
    beta[-1] = 0.0
    cuts = np.searchsorted(begin, np.arange(len(word) + 3))
    for b in range(len(word), -1, -1):
        at = slice(cuts[b], cuts[b + 1])
        beta[b] = np.logaddexp.reduce(beta[end[at]] + logs[piece[at]], axis=0)
    return beta


def log_likelihoods(words: Sequence[str], lattice: Lattice, p: np.ndarray, block: int = 4096) -> np.ndarray:
    """log of the marginal of each word under each language."""
    out = np.zeros((len(words), p.shape[1]))
    alone = np.array([len(w) > TOGETHER for w in words], bool)
    short = np.flatnonzero(~alone)
    for at in range(0, len(short), block):
        index = short[at : at + block]
        part = [words[i] for i in index]
        alpha = _sums(part, lattice.edges(part), p)
        last = alpha[[len(w) + 1 for w in part], np.arange(len(part))]
        out[index] = np.log(np.maximum(last, TINY))
        alone[index] = last.min(axis=1, initial=1.0) < TINY
    with np.errstate(divide="ignore"):
        logs = np.log(p)
    for i in np.flatnonzero(alone):
        out[i] = _log_sums(words[i], lattice.edges([words[i]]), logs)[-1]
    return out


@dataclass(frozen=True)
class LanguageModel:
    vocabulary: Vocabulary
    languages: tuple[str, ...]
    probabilities: np.ndarray  # [piece and the unknown one, language]
    priors: np.ndarray

    def labeller(self) -> "Labeller":
        return Labeller(self)


class Labeller:
    """Labels texts; keeps the sums of the words it has met lately.

    Two tables of words: when the newer one is full it becomes the older one, and
    words that come again move from there to a new one.
    """

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.lattice = Lattice(model.vocabulary)
        self.known: dict[str, int] = {}
        self.rows = self._table(CACHED_WORDS)
        self.older, self.older_rows = {}, self.rows[:0]

    def _table(self, rows: int) -> np.ndarray:
        self.letters = 0
        return np.zeros((rows, len(self.model.languages)))

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > len(self.rows) or self.letters > CACHED_LETTERS:
            self.older, self.older_rows = self.known, self.rows
            self.known, self.rows, fresh = {}, self._table(max(CACHED_WORDS, len(words))), list(words)
        old = [w for w in fresh if w in self.older]
        new = [w for w in fresh if w not in self.older]
        for part, values in (
            (old, lambda: self.older_rows[[self.older[w] for w in old]]),
            (new, lambda: log_likelihoods(new, self.lattice, self.model.probabilities)),
        ):
            if part:
                at = len(self.known)
                self.rows[at : at + len(part)] = values()
                self.known.update(zip(part, range(at, at + len(part))))
                self.letters += sum(map(len, part))

    def label(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        block, held = [], 0
        for text in texts:
            found = words_of(text)
            block.append(found)
            held += max(len(found), len(text or "") // 32)
            if held > CACHED_WORDS // 4:
                out += self._block(block)
                block, held = [], 0
        return out + self._block(block)

    def _block(self, block: list[list[str]]) -> list[tuple[str, float]]:
        self._learn({w for words in block for w in words})
        out = []
        for words in block:
            if not words or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            total = self.rows[at].sum(0) + self.model.priors
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out


def _word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): one row for each distinct word of a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            for lang, texts in part.groupby("lang").text:
                found = Counter(w for t in texts for w in words_of(t))
                yield pd.DataFrame({"lang": lang, "word": list(found), "n": list(found.values())})

    counted = docs.select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def bounded_sample(docs: DataFrame, rows: int) -> DataFrame:
    """About so many rows of each language at most, by a hash of the id."""
    shares = docs.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    wanted = {r["lang"]: r["share"] for r in shares.collect()}  # one number for each language
    chosen = F.lit(False)
    for lang, share in wanted.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < share))
    return docs.where(chosen)


def fit(
    docs: DataFrame,
    vocabulary: Vocabulary | None = None,
    rows: int = TRAINING_ROWS,
    rounds: int = ROUNDS,
    smoothing: float = SMOOTHING,
) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows whose lang is not null.

    Word counts of the sample are gathered once by Spark; every round is one
    distributed pass of expected counts over them.
    """
    vocabulary = vocabulary or Vocabulary.public()
    known = docs.where("lang is not null and doc_id is not null")
    counts = publish(_word_counts(bounded_sample(known, rows)), "words")
    tokens = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = tuple(sorted(tokens))
    size = len(vocabulary.pieces) + 1
    # A start that knows no language: a piece is worth as much as its letters under a flat code.
    length = np.array([len(p) for p in vocabulary.pieces] + [1.0])
    start = np.exp(-1.5 * length)
    p = np.tile((start / start.sum())[:, None], (1, max(len(languages), 1)))
    p[-1] = UNKNOWN
    for _ in range(rounds if languages else 0):
        expected = np.zeros((size, len(languages)))
        for r in _expected(counts, vocabulary, languages, p).collect():  # bounded: pieces times languages
            expected[r["piece"], r["language"]] = r["n"]
        expected[:-1] += smoothing
        p = expected / expected[:-1].sum(0)
        p[-1] = UNKNOWN
    return LanguageModel(vocabulary, languages, p, np.zeros(len(languages)))


def _expected(counts: DataFrame, vocabulary: Vocabulary, languages: tuple[str, ...], p: np.ndarray) -> DataFrame:
    index = {lang: i for i, lang in enumerate(languages)}

    def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        lattice = Lattice(vocabulary)
        total = np.zeros((len(vocabulary.pieces) + 1, len(languages)))
        for part in batches:
            for lang, rows in part.groupby("lang"):
                k = index[lang]
                one = p[:, k : k + 1]
                short = rows.word.str.len() <= TOGETHER
                alone = list(zip(rows.word[~short], rows.n[~short]))
                rows = rows[short]
                for at in range(0, len(rows), 4096):
                    words, n = rows.word.iloc[at : at + 4096].tolist(), rows.n.iloc[at : at + 4096].to_numpy(float)
                    edges = lattice.edges(words)
                    alpha, beta = _sums(words, edges, one)[..., 0], _back_sums(words, edges, one)[..., 0]
                    which, begin, end, piece = edges
                    whole = alpha[[len(w) + 1 for w in words], np.arange(len(words))]
                    alone += [(words[i], n[i]) for i in np.flatnonzero(whole < TINY)]
                    n[whole < TINY] = 0.0
                    post = alpha[begin, which] * one[piece, 0] * beta[end, which] / np.maximum(whole[which], TINY)
                    np.add.at(total[:, k], piece, post * n[which])
                for word, times in alone:
                    edges = lattice.edges([word])
                    _, begin, end, piece = edges
                    alpha, beta = (f(word, edges, np.log(one))[:, 0] for f in (_log_sums, _back_log_sums))
                    post = np.exp(alpha[begin] + np.log(one[piece, 0]) + beta[end] - alpha[-1])
                    np.add.at(total[:, k], piece, post * float(times))
        piece, language = np.nonzero(total)
        yield pd.DataFrame({"piece": piece, "language": language, "n": total[piece, language]})

    return (
        counts.mapInPandas(expect, "piece long, language long, n double")
        .groupBy("piece", "language")
        .agg(F.sum("n").alias("n"))
    )


def with_language(docs: DataFrame, model: LanguageModel, text_column: str, name: str) -> DataFrame:
    """The frame with a struct (lang_pred, score) of the whole text."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # vocabulary times languages
    key = f"{id(model)}-{spark.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # One labeller for each Python worker and model, so that its words outlive a task.
        labeller = kept(key, lambda: shipped.value.labeller())
        for texts in batches:
            found = labeller.label([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.withColumn(name, F.pandas_udf(label, "lang_pred string, score double")(F.col(f"`{text_column}`")))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2))


def languages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Learns from rows with a language and an id whose crc32 mod 4 is not 2.
    Null texts and texts without letters get ``und`` and 0; so does every text
    when there is nothing to learn from. Repeated ids give a row each.
    """
    learn = docs.select(
        F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang")
    )
    out = with_language(only(docs, id_column, text_column), fit(training_rows(learn)), "text", "found")
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "found.lang_pred", "found.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with confidence, with their own columns."""
    found = unused(docs, "found")
    model = fit(training_rows(docs.select("doc_id", "text", "lang")))
    kept = (F.col(found)["lang_pred"] != UNDETERMINED) & (F.col(found)["score"] >= CONFIDENT)
    return with_language(docs, model, "text", found).where(kept).drop(found)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
