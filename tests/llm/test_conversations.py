"""The prefix trie against plain sets of prefixes, with the order cut into stretches of any size, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assaykit.llm import conversations as cv

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The nodes of rows (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *turns[h:])  # % as in SQL: of the sign of c
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha(p)) for p in members), key=repr)


def nodes(spark, rows, **more):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted((tuple(r) for r in cv.prefix_trie(table).select(*NAMES).collect()), key=repr)


def some_rows(seed, n, letters="ab", most=7):
    """Conversations with few different turns: many share prefixes, end inside others, or are equal."""
    r = random.Random(seed)
    ids = r.sample(range(0, 100 * n // 5), n)
    return [(c, t, r.choice("ua"), r.choice(letters) * r.randint(0, 2)) for c in ids for t in range(r.randint(1, most))]


@pytest.mark.parametrize("stretch", [1, 3, 10, 100_000])
def test_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(cv, "STRETCH", stretch)
    rows = some_rows(stretch, 60)
    assert nodes(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(20))
def test_forest(seed):
    """Cut anywhere, in several rounds, the nodes are those of the whole."""
    r = random.Random(seed)
    keys = sorted({"", *("".join(r.choice("ab") for _ in range(r.randint(1, 6))) for _ in range(50))})
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    items = []
    for i, key in enumerate(keys):
        d = common(keys[i - 1], key) if i else -1
        items.append({"pos": i, "lcp": d, "lcp_chars": max(d, 0), "id": 2 * i, "depth": len(key), "chars": len(key), "n": 1, "first": i, "kids": 0, "leaves": 0, "saved": 0})
    found, names = [], {}
    while True:
        size = r.choice([2, 5, 9]) if len(items) > 1 and r.random() < 0.7 else len(items)
        left = []
        for at in range(0, len(items), size):
            forest = cv.Forest(items[at : at + size], items[at + size]["lcp"] if at + size < len(items) else -1)
            left += forest.merge()
            found += forest.nodes
            names.update(forest.aliases)
        items = left
        if size >= len(items) and len(items) == 1:
            break
    found.append(cv.closed(items[0], None, -1))
    last = lambda x: x if x not in names else last(names[x])
    assert len({last(x["id"]) for x in found}) == len(found)
    prefix = {last(x["id"]): keys[x["first"]][: x["depth"]] for x in found}
    got = sorted((prefix[last(x["id"])], "-" if x["parent"] is None else prefix[last(x["parent"])], x["n"], x["kids"], x["leaves"] if x["kids"] else 1) for x in found)
    branching = {p for k in keys for p in [k[:d] for d in range(len(k) + 1)] if p in keys or len({k[len(p)] for k in keys if k.startswith(p) and len(k) > len(p)}) > 1}
    want = []
    for p in branching:
        inside = [k for k in branching if k.startswith(p) and k != p]
        above = [q for q in branching if p.startswith(q) and q != p]
        kids = [k for k in inside if not any(k.startswith(q) and q != k for q in inside)]
        want.append((p, max(above, key=len) if above else "-", sum(k.startswith(p) for k in keys), len(kids), sum(not any(q.startswith(k) and q != k for q in inside) for k in inside) or 1))
    assert got == sorted(want)


def test_odd_conversations(spark, monkeypatch):
    """Nulls, ties, repeated rows and conversations, long ones, turnless ones, negative ids, clashing columns, no rows."""
    monkeypatch.setattr(cv, "STEP", 7)
    rows = [(c, t, "user", "x" * 50_000) for c in (0, 1, 2) for t in range(3)] + [(500, t, "a", str(t % 3)) for t in range(400)] + [(c, t, "a", str(t % 3)) for c in (501, 502) for t in range(300)]
    rows += [(7, None, None, "é"), (7, 0, "user", None), (7, 1, "", ""), (7, 1, "", ""), (7, 1, "user", "b"), (7, 1, "user", "a"), (None, 1, "user", "x"), (-7, 1, "user", "x"), (-150, 2, "u", "y")]
    rows += [(c, 0, "user", "only") for c in range(1000, 1050)] + [(c, 0, "user", "alone") for c in range(2001, 2040)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.select("*", *[F.lit(1).alias(c) for c in ("Depth", "digest", "part", "n", "first", "a.b", "key", "name")])
    got = sorted((tuple(r) for r in cv.prefix_trie(table).select(*NAMES).collect()), key=repr)
    assert got == plain(rows)
    assert cv.prefix_trie(table.limit(0)).count() == 0
