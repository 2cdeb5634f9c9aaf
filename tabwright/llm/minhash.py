"""Near-duplicate documents by a MinHash LSH forest.

A document is its set of word shingles. Documents of equal sets form a class,
and one of them, the representative, goes on.

* Every representative gets a signature of ``HASHES`` one-byte minima. A tree
  reads ``DEPTH`` of them in an order of its own; sorting a tree's keys puts
  similar documents side by side, and the longer the common prefix of two
  neighbours, the likelier they are alike. The sort is a range partitioning on
  (tree, key), so no prefix, however common, lands in one task.
* First pass: neighbours in every tree, from the deepest common prefix down.
  Each component's best neighbour is verified on the full sets and the links
  found join components, in steps, as long as many of them are found.
* Second pass: the walk towards the root goes on, region by region, only where
  a region (documents with a common prefix in a tree) still holds several
  components, and ends at the floor of ``FLOOR`` minima. There pairs of
  different components are compared by signature inside the task, block by
  block; those that may be alike are verified on their full sets and only the
  links that join components leave the task.
* A region with more than ``BLOCK`` documents outside its largest component is
  crowded, and is parted by further minima until its parts are not. When the
  links found there have joined components, what is still crowded at the floor
  meets by what is rare instead: two sets that are alike share one of the rarest
  n - ceil(0.8 n) + 1 shingles of each, in any order that is the same for all
  (prefix filter). This loses no pair, and what a region shares is seldom rare.

Two documents of similarity 0.8 miss a region in all trees with a probability
of (1 - 0.8**FLOOR)**TREES, 5e-9, as no two trees' floors share a minimum; nothing
is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm.common import dropped, only, parts_for, publish, table
from tabwright.llm.components import connected
from tabwright.llm.rolling import mix, shingle_set

TREES = 48
FLOOR = 5
DEPTH = 8
HASHES = TREES * FLOOR
#: Signatures that agree in a smaller share are not verified: at a similarity of
#: 0.8 that has a probability of about 4e-13 (144 of 240 draws, 7.7 deviations).
LIKELY = 0.6
#: The first pass goes on while a step finds a link for such a share of the pairs that it tests.
FRUITFUL = 0.2
#: Documents compared with each other at once.
BLOCK = 512
#: Counters of shingles, by hash; they set only the order in which shingles count as rare.
COUNTERS = 2**18
#: Stands for the tree of a region that shares a rare shingle.
RARE = -1
WORDS = 5
SIMILARITY = 80

_RANDOM = np.random.default_rng(7)
_FACTORS = (_RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_FLIPS = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
#: The minima that each tree reads, in its order: the floors of no two trees share one.
_FLOORS = _RANDOM.permutation(HASHES).reshape(TREES, FLOOR)
_ORDERS = np.array([[*floor, *_RANDOM.permutation(np.setdiff1d(np.arange(HASHES), floor))[: DEPTH - FLOOR]] for floor in _FLOORS])


def signature(shingles: np.ndarray) -> bytes:
    """One byte of the minimum under each hash function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, ((x[at : at + 2048] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * size of the intersection >= percent * size of the union, exactly."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, d1, d2, sig): set size, digest of the set and signature."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            rows = []
            for doc_id, text in zip(part.doc_id, part.text):
                s = shingle_set(text, words)
                d1, d2 = (int(mix(s + np.uint64(k)).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2))
                rows.append((doc_id, len(s), d1, d2, signature(s) if len(s) else b""))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "sig"])

    return docs.mapInPandas(sketch, "doc_id long, n long, d1 long, d2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    """(tree, key, id): the minima in each tree's order as one number."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            if not len(part):
                continue
            sig = np.frombuffer(b"".join(part.sig), np.uint8).reshape(len(part), HASHES)
            key = np.ascontiguousarray(sig[:, _ORDERS]).view(">u8")[..., 0].astype(np.uint64).view(np.int64)
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(part))
            yield pd.DataFrame({"tree": tree, "key": key.ravel(), "id": np.repeat(part.id.to_numpy(), TREES)})

    return reps.select("id", "sig").mapInPandas(keys, "tree int, key long, id long")


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bytes that two arrays of keys share."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    return sum((x >> np.uint64(8 * (DEPTH - k)) == 0).astype(np.int32) for k in range(1, DEPTH)) + (x == 0)


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Neighbours in the sorted order; the partition's ends as rows without b."""
    dropped()
    part_number = TaskContext.get().partitionId()
    last = first = None
    for part in batches:
        if not len(part):
            continue
        if last is not None:
            part = pd.concat([last, part], ignore_index=True)
        else:
            first = part.iloc[:1]
        last = part.iloc[-1:]
        tree, key, ids = part.tree.to_numpy(), part.key.to_numpy(), part.id.to_numpy()
        lcp = _common(key[:-1], key[1:])
        near = (tree[:-1] == tree[1:]) & (lcp >= FLOOR) & (ids[:-1] != ids[1:])
        a, b = ids[:-1][near], ids[1:][near]
        yield pd.DataFrame(
            {"a": np.minimum(a, b), "b": pd.array(np.maximum(a, b), "Int64"), "lcp": lcp[near], "tree": tree[:-1][near], "key": key[:-1][near], "part": part_number}
        )
    for place, row in ((0, first), (1, last)):
        if row is not None:
            yield pd.DataFrame(
                {"a": row.id, "b": pd.array([None], "Int64"), "lcp": place, "tree": row.tree, "key": row.key, "part": part_number}
            )


def _neighbour_pairs(keys: DataFrame) -> DataFrame:
    """(a, b, lcp) of neighbours in all trees, also across partition edges."""
    spark = keys.sparkSession
    dealt = keys.repartitionByRange(parts_for(spark), "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = publish(
        dealt.mapInPandas(_neighbours, "a long, b long, lcp int, tree int, key long, part int"), "neighbours"
    )
    # Two rows for each partition: the neighbours that a partition's edge parts.
    ends = sorted(found.where("b is null").select("part", "lcp", "tree", "key", "a").collect())
    across = []
    for x, y in zip(ends, ends[1:]):
        if x["part"] != y["part"] and x["tree"] == y["tree"] and x["a"] != y["a"]:
            lcp = int(_common(np.array([x["key"]]), np.array([y["key"]]))[0])
            if lcp >= FLOOR:
                across.append((min(x["a"], y["a"]), max(x["a"], y["a"]), lcp))
    pairs = found.where("b is not null").select("a", "b", "lcp")
    return pairs.unionByName(spark.createDataFrame(across, "a long, b long, lcp int")) if across else pairs


def _best(pairs: DataFrame) -> DataFrame:
    """The likeliest pair of each component: most common prefix over all trees.

    pairs has (a, b, lcp) and the components (x, y) of its ends, which differ.
    """
    ways = pairs.select("x", "lcp", "a", "b").unionByName(pairs.select(F.col("y").alias("x"), "lcp", "a", "b"))
    best = ways.groupBy("x").agg(F.max(F.struct("lcp", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _grown(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that join neighbours to components, in steps.

    Each step verifies the likeliest untested pair of every component. What the
    steps leave when they end is the second pass's to find.
    """
    links = tested = roots = None
    while True:
        left = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        if roots is None:
            left = left.withColumns({"x": F.col("a"), "y": F.col("b")})
        else:
            for end, name in (("a", "x"), ("b", "y")):
                of = roots.select(F.col("id").alias(end), F.col("root").alias(name))
                left = left.join(of, end, "left").withColumn(name, F.coalesce(name, end))
            left = left.where("x <> y")
        best = publish(_best(left), "best")
        tested = best if tested is None else publish(tested.unionByName(best), "tested")
        found = publish(_verified(best, texts, words, percent).distinct(), "found")
        links = found if links is None else publish(links.unionByName(found), "links")
        if found.count() <= FRUITFUL * best.count():
            return links
        roots = connected(links)


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets are alike."""

    def test(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        dropped()
        for left, right in batches:
            yield pd.Series([alike(shingle_set(x, words), shingle_set(y, words), percent) for x, y in zip(left, right)], dtype=bool)

    # Texts that are in no pair stay out of the shuffle.
    used = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    docs = docs.join(used, "doc_id", "left_semi")
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(F.pandas_udf(test, "boolean")("ta", "tb")).select("a", "b")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted batches, put together where one crosses batches."""
    held: list[pd.DataFrame] = []
    for part in batches:
        if not len(part):
            continue
        values = [part[k].to_numpy() for k in keys]
        if held and any(held[-1][k].iloc[-1] != v[0] for k, v in zip(keys, values)):
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        edges = [0, *cuts.tolist(), len(part)]
        for x, y in zip(edges, edges[1:]):
            if y < len(part):
                held.append(part.iloc[x:y])
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            else:
                held.append(part.iloc[x:y])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def _signatures(group: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(group.sig), np.uint8).reshape(len(group), HASHES)


def _tree(group: pd.DataFrame) -> int:
    """The tree of a region of any depth; RARE for one that shares a rare shingle."""
    tree = int(group.tree.iloc[0])
    return tree if tree == RARE else tree % TREES


def _likely(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, tree: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that may be alike and first meet in this tree."""
    rows, columns = [], []
    for i in range(len(sig) - 1):
        if across and side[i]:
            continue
        later = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((side[i + 1 :] == 1) if across else True)) + i + 1
        same = sig[later] == sig[i]
        later, same = later[ok := same.mean(1) >= LIKELY], same[ok]
        if len(later) and tree > 0:
            # A pair that shares the floor in an earlier tree is that tree's to test, or,
            # if the region there is crowded, one of those that meet by rare shingles.
            later = later[~same[:, _ORDERS[:tree, :FLOOR]].all(2).any(1)]
        rows.append(np.full(len(later), i)), columns.append(later)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


_REGION = ["tree", "prefix", "x", "y"]


def _flagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    dropped()
    for group in grouped(batches, _REGION):
        across = group.x.iloc[0] != group.y.iloc[0]
        i, j = _likely(_signatures(group), group.comp.to_numpy(), group.side.to_numpy(), _tree(group), across)
        if len(i):
            yield group.iloc[np.unique(np.concatenate([i, j]))]


def _linked(words: int, percent: int):
    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for group in grouped(batches, _REGION):
            across = group.x.iloc[0] != group.y.iloc[0]
            comp = group.comp.to_numpy()
            i, j = _likely(_signatures(group), comp, group.side.to_numpy(), _tree(group), across)
            parent = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while parent[c] != c:
                    parent[c] = c = parent[parent[c]]
                return c

            sets: dict[int, np.ndarray] = {}
            texts, out = group.text.tolist(), []
            for a, b in zip(i.tolist(), j.tolist()):
                ra, rb = root(int(comp[a])), root(int(comp[b]))
                if ra == rb:
                    continue
                for k in (a, b):
                    if k not in sets:
                        sets[k] = shingle_set(texts[k], words)
                if alike(sets[a], sets[b], percent):
                    parent[max(ra, rb)] = min(ra, rb)
                    # A component goes by its smallest id: the same link in many trees is one row.
                    out.append((int(comp[a]), int(comp[b])))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return link


def _several(placed: DataFrame) -> DataFrame:
    """(tree, prefix, main, others, mains) of the regions that hold several components.

    A region's largest component, if it fills a block, is not compared with itself: its
    blocks meet those of the other documents alone, so copies cost rows in proportion.
    """
    sizes = placed.groupBy("tree", "prefix", "comp").agg(F.count("*").alias("n"))
    fills = F.col("most.n") >= BLOCK
    return (
        sizes.groupBy("tree", "prefix")
        .agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("components"))
        .where("components > 1")
        .withColumns({"main": F.when(fills, F.col("most.comp")), "held": F.when(fills, F.col("most.n")).otherwise(0)})
        .select(
            "tree", "prefix", "main",
            F.ceil((F.col("n") - F.col("held")) / BLOCK).cast("int").alias("others"),
            F.ceil(F.col("held") / BLOCK).cast("int").alias("mains"),
        )
    )


def _blocks(placed: DataFrame, several: DataFrame) -> DataFrame:
    """Each document of a region once for every pair of blocks that it takes part in."""
    in_main = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    number = F.xxhash64("id")
    own = F.when(in_main, F.col("others") + F.pmod(number, F.col("mains"))).otherwise(F.pmod(number, F.col("others")))
    meets = F.col("others") + F.when(in_main, 0).otherwise(F.col("mains"))
    return (
        placed.join(several, ["tree", "prefix"])
        .withColumn("own", own.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), (meets - 1).cast("int"))))
        .select(
            "tree", "prefix", "id", "comp",
            F.least("own", "other").alias("x"),
            F.greatest("own", "other").alias("y"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
        )
    )


def _shingle_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur, added up in COUNTERS counters by their hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        total = np.zeros(COUNTERS, np.int64)
        for part in batches:
            for text in part.text:
                np.add.at(total, (shingle_set(text, words) % np.uint64(COUNTERS)).astype(np.int64), 1)
        slot = np.flatnonzero(total)
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    counted = texts.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(COUNTERS, np.int64), counted.toPandas()  # bounded: COUNTERS rows
    out[rows.slot.to_numpy()] = rows.n.to_numpy()
    return out


def _by_rare(crowd: DataFrame, words: int, percent: int) -> DataFrame:
    """(tree, prefix, id, comp): the rarest shingles of (id, comp, text), as many as pairs that are alike must share one of."""
    shipped = crowd.sparkSession.sparkContext.broadcast(_shingle_counts(crowd, words))  # COUNTERS numbers

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped()
        for part in batches:
            found, sizes = [], []
            for text in part.text:
                s = shingle_set(text, words)
                order = np.lexsort((s, shipped.value[(s % np.uint64(COUNTERS)).astype(np.int64)]))
                found.append(s[order[: len(s) + percent * len(s) // -100 + 1]])
                sizes.append(len(found[-1]))
            if found:
                prefix = np.concatenate(found).view(np.int64)
                yield pd.DataFrame(
                    {"tree": RARE, "prefix": prefix, "id": np.repeat(part.id.to_numpy(), sizes), "comp": np.repeat(part.comp.to_numpy(), sizes)}
                )

    return crowd.select("id", "comp", "text").mapInPandas(rarest, "tree int, prefix long, id long, comp long")


def _walked(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of all regions that are not crowded, and the regions crowded at the floor.

    A region crowded at the floor is parted by all DEPTH minima of its tree; (tree, depth)
    goes as one number, whose remainder by TREES is the tree.
    """
    left, blocks, floor = placed, None, None
    for depth in (FLOOR, DEPTH):
        code = (F.col("tree") % TREES + TREES * (depth - FLOOR)).cast("int")
        left = left.withColumns({"tree": code, "prefix": F.shiftright("key", 8 * (DEPTH - depth))})
        regions = publish(_several(left), "regions")
        here = _blocks(left, regions.where("others = 1"))
        blocks = here if blocks is None else blocks.unionByName(here)
        crowded = regions.where("others > 1").select("tree", "prefix")
        floor = crowded if floor is None else floor
        if crowded.isEmpty():
            break
        left = left.join(crowded, ["tree", "prefix"], "left_semi")
    return blocks, floor


def _compared(blocks: DataFrame, members: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components, by their smallest ids, that meet in blocks."""
    parts = parts_for(blocks.sparkSession)
    kinds = "tree int, prefix long, id long, comp long, x int, y int, side int, sig binary"
    dealt = blocks.join(members.select("id", "sig"), "id").select(*[c.split()[0] for c in kinds.split(", ")])
    dealt = dealt.repartition(parts, *_REGION).sortWithinPartitions(*_REGION, "side", "id")
    flagged = publish(dealt.mapInPandas(_flagged, kinds), "flagged")
    full = flagged.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    full = full.repartition(parts, *_REGION).sortWithinPartitions(*_REGION, "side", "id")
    return publish(full.mapInPandas(_linked(words, percent), "a long, b long").distinct(), "more")


def _in_components(frame: DataFrame, links: DataFrame) -> DataFrame:
    return frame.join(connected(links), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _regions(reps: DataFrame, links: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links and those between components that still meet in a region of some tree.

    reps are the representatives that have a neighbour.
    """
    members = publish(_in_components(reps, links), "members")
    keys = _keys(members).withColumn("prefix", F.shiftright("key", 8 * (DEPTH - FLOOR)))
    placed = publish(keys.join(members.select("id", "comp"), "id"), "placed")
    blocks, crowded = _walked(placed)
    links = links.unionByName(_compared(blocks, members, docs, words, percent))
    if crowded.isEmpty():
        return links
    # What the walk has joined may leave room in these regions; in the others rare shingles decide.
    left = placed.join(crowded, ["tree", "prefix"], "left_semi").select("tree", "prefix", "id")
    left = publish(_in_components(left, links), "placed")
    regions = publish(_several(left), "regions")
    blocks = _blocks(left, regions.where("others = 1"))
    crowded = regions.where("others > 1")
    if not crowded.isEmpty():
        ids = left.join(crowded, ["tree", "prefix"], "left_semi").select("id", "comp").distinct()
        crowd = publish(ids.join(docs.select(F.col("doc_id").alias("id"), "text"), "id"), "crowd")
        rare = publish(_by_rare(crowd, words, percent), "rare")
        blocks = blocks.unionByName(_blocks(rare, _several(rare)))
    return links.unionByName(_compared(blocks, members, docs, words, percent))


def near_duplicates(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = SIMILARITY,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    A-Z are lower-cased and words are runs without ASCII white space. Texts
    without words, null ones too, have no shingles and link with nothing. Rows
    without an id link with nothing and have no component. Rows that repeat an
    id are one document, judged by the row with the most shingles; n_shingles is
    each row's own. An empty table gives an empty result.
    """
    rows = only(docs, id_column, text_column)
    sketches = publish(_sketches(rows, words), "sketches")
    filled = (
        sketches.where("n > 0 and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.struct("n", "d1", "d2")).alias("set"))
        .select("doc_id", "set.*")
    )
    classes = publish(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("id")), "classes")
    reps = publish(
        sketches.select(F.col("doc_id").alias("id"), "n", "d1", "d2", "sig")
        .join(classes, ["id", "n", "d1", "d2"])
        .select("id", "sig")
        .dropDuplicates(["id"]),
        "reps",
    )
    pairs = publish(_neighbour_pairs(_keys(reps)).groupBy("a", "b").agg(F.sum("lcp").alias("lcp")), "pairs")
    # From here on only documents with a neighbour take part.
    met = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    met = publish(met, "met")
    texts = publish(rows.join(met, "doc_id", "left_semi"), "texts")
    links = _grown(pairs, texts, words, percent)
    reps = reps.join(met.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    roots = connected(_regions(reps, links, texts, words, percent))
    members = (
        filled.join(classes, ["n", "d1", "d2"])
        .join(roots, "id", "left")
        .select("doc_id", F.coalesce("root", "id").alias("root"))
    )
    out = sketches.select("doc_id", "n").join(members, "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id."""
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
