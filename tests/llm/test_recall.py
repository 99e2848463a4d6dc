"""Near-duplicates: every pair at the threshold, of a query set against all rows, by brute force."""

import random

import duckdb
import pyarrow as pa

from assaykit.llm import minhash

SF = "/root/testdata/sf0.01"


def test_recall(spark):
    """Documents whose id is divisible by 20 against all: links in the classes, and classes without a reason."""
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    r = {i: minhash.shingles_of(t) for i, t in rows}
    by_shingle = {}
    for i, bag in r.items():
        for x in bag:
            by_shingle.setdefault(x, []).append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    of = {x.doc_id: x.class_id for x in minhash.near_classes(docs).collect()}
    pairs = found = 0
    for i in r:
        if i % 20 == 0:
            near = {j for x in r[i] for j in by_shingle[x] if j != i}
            linked = [j for j in near if minhash.similarity(r[i], r[j]) >= minhash.THRESHOLD]
            pairs += len(linked)
            found += sum(of[i] == of[j] for j in linked)
            if not linked and r[i]:
                assert sum(c == of[i] for c in of.values()) == 1
    print(f"pairs {pairs}, in one class {found}")
    assert pairs > 0 and found >= 0.99 * pairs


def test_components(spark):
    """Chains, stars, cycles, repeated and turned links, and links of one id with itself, against a plain union."""
    r, links = random.Random(8), [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 301), (301, 302), (302, 300), (5, 5), (7, 6), (6, 7)]
    links += [(r.randrange(400, 700), r.randrange(400, 700)) for _ in range(200)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    for some in (links, [e for e in links if e[0] == 200]):
        got = minhash.components(spark.createDataFrame(some, "a long, b long")).collect()
        seen = {x for e in some for x in e}
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in seen if find(x) != x)
    assert minhash.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_in_a_task(spark, monkeypatch):
    """What one task's links bring together needs no rounds: each writes three tables and shuffles them."""
    names, write = [], minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name, keep=False: names.append(name) or write(df, name, keep))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").coalesce(1)
    assert {(r.id, r.root) for r in minhash.components(chain).collect()} == {(i, 0) for i in range(1, 301)}
    assert names == ["stars"]


def test_forests_of_few_nodes(monkeypatch):
    monkeypatch.setattr(minhash, "FOREST", 3)
    batches = [pa.RecordBatch.from_pydict({"a": [x], "b": [y]}) for x, y in ((9, 8), (8, 7), (7, 5), (5, 9), (3, 3), (6, 9))]
    assert [sorted(zip(*b.to_pydict().values())) for b in minhash._forests(iter(batches))] == [[(7, 5), (8, 5), (9, 5)], [(6, 5), (9, 5)], []]
