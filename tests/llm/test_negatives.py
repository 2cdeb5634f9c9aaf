"""Hard negatives against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import negatives
from tests.conftest import MIDDLE

SCHEMA = "vec_id long, embedding array<double>, label int, score long, anchor string, row long, d int"


def brute(rows, anchor, k=5, m=3, scale=256):
    """(anchor, positive, rank, negative, scores) over plain lists of whole numbers."""
    fine = []
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        fine.append((i, label, [int(np.floor(x * scale)) for x in v]))
    out = []
    for at, (i, label, v) in enumerate(fine):
        if not anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(v, w)), j, kind) for n, (j, kind, w) in enumerate(fine) if n != at and len(w) == len(v)]
        for neg, j, _ in sorted(o for o in others if o[2] == label)[:k]:
            score = -neg
            window = sorted((s, x) for s, x, kind in others if kind != label and 50 * score <= -100 * s <= 95 * score)
            out += [(i, j, r, x, score, -s) for r, (s, x) in enumerate(window[:m], 1)]
    return sorted(out)


def vectors(n=260, d=5, seed=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.uniform(-0.3, 0.3) for x in c], rng.randrange(4)))
    rows += [(1000 + i, [0.5] * d, i % 3) for i in range(90)]  # ties
    rows += [rows[0], rows[10], (10, [0.25] * d, 2)]  # repeated rows, an id with another vector
    rows += [(None, [0.1] * d, 1), (5000, None, 1), (5010, [0.1] * d, None), (5020, [0.1, None, 0.2, 0.3, 0.1], 1)]
    rows += [(5030, [float("nan")] * d, 1), (5040, [float("inf")] * d, 2), (5050, [0.9, 0.8], 1), (5060, [0.7, 0.8], 1), (5070, [0.6, 0.5], 2)]
    rows += [(5080, [], 1), (5090, [], 1), (5100, [], 2), (5110, [0.0] * d, 0), (-20, [0.4] * d, 3)]
    return [(*r, 7, "x", 1, 2) for r in rows]


def test_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, tree=64, leaf=8, fanout=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randrange(2**25, 2**26)) for _ in range(4)], i % 2, 0, "", 0, 0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(df, F.col("vec_id") % 8 == 0, scale=16, tree=32, leaf=4)
    wanted = brute(rows, lambda i: i % 8 == 0, scale=16)
    assert sorted(map(tuple, got.collect())) == wanted and max(r[4] for r in wanted) > 2**53


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(none, F.lit(True)).collect() == []
    df = spark.createDataFrame(vectors(), SCHEMA)
    assert negatives.hard_negatives(df, F.lit(None).cast("boolean")).collect() == []


def test_tree_boxes_and_pruning():
    rng = np.random.default_rng(4)
    points = np.floor(rng.standard_normal((900, 3)) * 100)
    n = np.arange(900)
    tree = negatives.Tree.build(n, n, n % 5, points, leaf=16, fanout=4)
    assert sorted(tree.rows) == list(n) and tree.leaves >= 900 / 16
    for node, (a, b) in enumerate(tree.children.tolist()):
        below = tree.points[a:b] if node < tree.leaves else np.concatenate([tree.low[a:b], tree.high[a:b]])
        assert (below >= tree.low[node]).all() and (below <= tree.high[node]).all()
    anchors = points[:7]
    least, most = tree.bounds(anchors)
    for i, q in enumerate(anchors):
        for leaf in range(tree.leaves):
            a, b = tree.children[leaf]
            scores = tree.points[a:b] @ q
            assert least[i, leaf] <= scores.min() and scores.max() <= most[i, leaf]
    opened = collections.Counter()

    best = [negatives.Best(5)]
    fits = lambda a, b: opened.update([a]) or np.ones(b - a, bool)
    negatives.search(tree, anchors[0], least[0], most[0], fits, np.ones(len(tree.low), bool), [(None, None)], best)
    wanted = sorted(((-s, i) for s, i in zip((tree.points @ anchors[0]).tolist(), tree.ids.tolist())))[:5]
    assert [(-r[0], r[1]) for r in best[0].rows] == wanted
    assert len(opened) < tree.leaves / 3  # most boxes are left out


def test_best_takes_smallest_ids_of_ties():
    best = negatives.Best(3)
    best.add(np.array([5.0] * 40 + [6.0]), np.arange(41)[::-1].copy(), np.arange(41))
    best.add(np.array([5.0, 4.0]), np.array([-1, -5]), np.array([99, 98]))
    assert [(r[0], r[1]) for r in best.rows] == [(6, 0), (5, -1), (5, 1)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MIDDLE}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    shifted = [(i, v, (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows]
    got = negatives.op11_hard_negatives(spark, MIDDLE)
    assert sorted(map(tuple, got.collect())) == brute(shifted, lambda i: i % 50 == 0)


@pytest.mark.parametrize("kind", [np.float32, np.float64, object])
def test_block_of_anchors_opens_a_leaf_once(kind):
    # A queue of its own for every anchor and window made CPU seconds grow as the input to the power 1.51.
    rng = np.random.default_rng(5)
    points = np.floor(rng.standard_normal((700, 6)) * 40)
    points[::9] = points[0]  # ties
    n = np.arange(700)
    labels, ids = rng.integers(0, 4, 700), rng.permutation(700) // 2
    mine = labels[:50, None]
    tree = negatives.Tree.build(n, ids, labels, negatives._exact(points, kind), leaf=16, fanout=4)
    anchors = negatives._exact(points[:50], kind)
    least, most = tree.bounds(anchors)
    assert least.dtype == kind
    ends = [(rng.integers(-4000, 1000, 50).astype(float), rng.integers(0, 9000, 50).astype(float)) for _ in range(3)]
    ends[2][0][::2], ends[2][1][::2] = np.inf, -np.inf  # no window there
    best = [negatives.Best(4, 50) for _ in range(4)]
    opened = collections.Counter()
    fits = lambda a, b: opened.update([a]) or tree.labels[a:b] != mine
    may_fit = (tree.low_label != mine) | (tree.high_label != mine)
    negatives.search(tree, anchors, least, most, fits, may_fit, [(None, None), *ends], best)
    assert 0 < len(opened) <= tree.leaves and max(opened.values()) == 1
    scores = (points[:50] @ points.T).astype(int)
    for w, (low, high) in enumerate([(np.full(50, -np.inf), np.full(50, np.inf)), *ends]):
        found = [[] for _ in range(50)]
        for a, s, i, r in zip(*(x.tolist() for x in best[w].found())):
            found[a].append((-int(s), i, r))
        for a in range(50):
            wanted = sorted((-s, i, r) for r, (s, i) in enumerate(zip(scores[a].tolist(), ids.tolist())) if labels[r] != labels[a] and low[a] <= s <= high[a])
            assert found[a] == wanted[:4]


def test_block_leaves_out_boxes_that_none_of_it_needs():
    rng = np.random.default_rng(6)
    points = np.floor(rng.standard_normal((1600, 3)) * 100)
    points = points[np.argsort(-points.sum(axis=1))]
    n = np.arange(1600)
    tree = negatives.Tree.build(n, n, n % 3, points.astype(np.float32), leaf=16, fanout=4)
    opened = collections.Counter()
    fits = lambda a, b: opened.update([a]) or np.ones((40, b - a), bool)
    best = [negatives.Best(5, 40)]
    anchors = points[:40].astype(np.float32)  # all of one corner
    negatives.search(tree, anchors, *tree.bounds(anchors), fits, np.ones((40, len(tree.low)), bool), [(None, None)], best)
    assert len(opened) < tree.leaves / 4
    wanted = [sorted(zip((-(points @ a)).tolist(), n.tolist()))[:5] for a in points[:40]]
    assert [(-s, i) for s, i in zip(best[0].scores.ravel(), best[0].ids.ravel())] == [x for one in wanted for x in one]


def test_best_of_many_anchors():
    best = negatives.Best(2, 3)
    best.add(np.array([4.0, 7.0, 4.0, 4.0]), np.array([9, 1, 5, 2]), np.arange(4), np.array([2, 0, 2, 2]))
    best.add(np.array([4.0, 4.0, -3.0]), np.array([1, 7, 8]), np.array([10, 11, 12]), np.array([2, 2, 0]))
    assert [x.tolist() for x in best.found()] == [[0, 0, 2, 2], [7, -3, 4, 4], [1, 8, 1, 2], [1, 12, 10, 3]]
    assert best.floor().tolist() == [-3, -np.inf, 4]


def test_most_trees_hold_no_positive_of_an_anchor(spark, monkeypatch):
    kept = {}
    publish = negatives.publish
    monkeypatch.setattr(negatives, "publish", lambda df, name: kept.setdefault(name, publish(df, name)))
    rows = [(i, [float(i * j % 11) for j in range(1, 5)], i % 8, 0, "", 0, 0) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 40 == 0, scale=1, tree=20, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 40 == 0, scale=1)
    trees = [set(np.frombuffer(r.labels, "<i8").tolist()) for r in kept["trees"].select("labels").collect()]
    assert max(sum(label in t for t in trees) for label in range(8)) < len(trees) / 3


def test_cells_are_no_more_than_full_trees(spark, monkeypatch):
    # Each cell gives back rows for all its anchors, so that many shuffle partitions made many rows.
    cells = []
    search_all = negatives._search_all
    monkeypatch.setattr(negatives, "_search_all", lambda *a: cells.append(a[4]) or search_all(*a))
    monkeypatch.setattr(negatives, "parts_for", lambda spark: 13)
    rows = vectors()
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0, tree=128, leaf=8)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)
    assert cells == [(3, 1)] * 2
