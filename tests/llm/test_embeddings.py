"""Near-duplicate embeddings against every pair, with cells of any size, and on odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import embeddings as em


def plain(rows):
    """(id, links, component, kept) of rows (id, vector, label) by every pair."""
    rows = [(i, None if v is None or not len(v) or any(x is None for x in v) else np.array(v, float), label) for i, v, label in rows]
    fine = [v is not None and label is not None and np.isfinite(v).all() and v.any() for _, v, label in rows]

    def near(a, b):
        (_, v, s), (_, w, t) = rows[a], rows[b]
        if a == b or not (fine[a] and fine[b]) or s != t or len(v) != len(w):
            return False
        v, w = v / abs(v).max(), w / abs(w).max()
        return v @ w / np.sqrt((v @ v) * (w @ w)) >= em.THRESHOLD

    links = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def clusters(seed, n, dim=16):
    """Tight and loose groups, chains of links, single points and repeated vectors."""
    r = np.random.default_rng(seed)
    out = []
    for k in range(n):
        centre = r.normal(size=dim)
        spread = r.choice([0.0, 0.02, 0.1, 0.2, 0.35])
        out += [centre + spread * r.normal(size=dim) for _ in range(int(r.integers(1, 40)))]
        if k % 5 == 0:
            side = r.normal(size=dim)
            out += [centre + 0.12 * i * side for i in range(12)]
    return np.array(out, np.float32)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_walk(seed):
    """Counts and components of two trees and of one, with bounds that drop, take whole and open node pairs."""
    x = em.unit(clusters(seed, 25))
    n = np.random.default_rng(seed).integers(1, 4, len(x))
    near = x @ x.T >= em.THRESHOLD
    np.fill_diagonal(near, False)
    home = np.random.default_rng(seed).random(len(x)) < 0.6
    found = em.Links(x, n, em.THRESHOLD)
    one, two = em.CoverTree(x, np.flatnonzero(home)), em.CoverTree(x, np.flatnonzero(~home))
    for tree in (one, two):  # covering, and each point in one child
        for node, kids in enumerate(tree.children):
            if kids is not None:
                assert sorted(np.concatenate([tree.points[c] for c in kids])) == sorted(tree.points[node])
            assert np.linalg.norm(x[tree.points[node]] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + em.SLACK
    found.walk(one)
    found.walk(one, two)
    found.walk(two)
    assert (found.count == near @ n).all()
    root = found._roots(np.arange(len(x)))
    label = np.arange(len(x))
    while True:
        new = np.array([label[np.flatnonzero(row)].min(initial=label[i]) for i, row in enumerate(near)])
        if (new == label).all():
            break
        label = new
    assert (root == label).all()


@pytest.mark.parametrize("cell", [8192, 25])
def test_cells(spark, monkeypatch, cell):
    """The same with one cell a label and with cells split several times over, and visitors in portions."""
    monkeypatch.setattr(em, "CELL", cell)
    x = np.concatenate([clusters(7, 12), np.random.default_rng(1).normal(size=(90, 16)).astype(np.float32)])
    rows = [(i, v.tolist(), i % 7 // 5) for i, v in enumerate(x)] + [(i + 5000, x[3].tolist(), 0) for i in range(30)]
    got = em.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_odd_vectors(spark):
    """Nulls, zeros, infinities, tiny and huge ones, lengths, scaled and repeated rows, odd labels, clashing columns, no rows."""
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, a, "x"), (2, a, "x"), (2, a, "x"), (3, [2.0, 4.0, 6.0], "x"), (4, [-1.0, -2.0, -3.0], "x"), (5, a, None), (6, a, None), (7, None, "x"), (8, [], "x"), (8, [], "x"),
        (9, [0.0, 0.0, 0.0], "x"), (10, [1.0, None, 3.0], "x"), (11, [1.0, nan, 3.0], "x"), (12, [inf, 2.0, 3.0], "x"), (13, [1e-300, 2e-300, 3e-300], "x"), (14, [1e300, 2e300, 3e300], "x"),
        (15, [1.0, 2.0], "x"), (16, [1.0, 2.0], "x"), (17, a, "x//"), (18, a, ""), (19, a, ""), (None, [5.0, 0.0, 0.0], "x"), (None, a, "y"), (20, a, "y"), (21, [-0.0, 1.0, 0.0], "z"), (22, [0.0, 1.0, 0.0], "z"),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").select("*", *[F.lit(1).alias(c) for c in ("Cell", "vec", "digest", "n", "a.b", "kept")])
    assert sorted(map(tuple, em.near_embeddings(vectors).collect()), key=repr) == plain(rows)
    assert em.near_embeddings(vectors.limit(0)).count() == 0
