"""Spelling variants against every pair of words, in tiles of any size, and on odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(b) > len(a) else a[k + 1 :] == b[k + 1 :]


def some_words(n, seed=3, letters="abé", most=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(5, most))) for _ in range(n)})


@pytest.mark.parametrize("hot", [50_000, 12])
def test_near_words(spark, monkeypatch, hot):
    """All pairs, whether a task or Spark halves the tiles; runs of one letter have several places for one edit."""
    monkeypatch.setattr(spelling, "HOT", hot)
    words = [*some_words(300), "aaaaa", "aaaaaa", "aaaaaaa", "b" * 3000, "b" * 3001, "b" * 1500 + "a" + "b" * 1500]
    words = list(dict.fromkeys(words))
    got = spelling.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")).collect()
    want = sorted((a, b, words.index(b)) for a in words for b in words if one_edit(a, b))
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("tile", [2, 7, 1000])
def test_tiles(monkeypatch, tile):
    """A tile halved down to any size gives each pair once."""
    monkeypatch.setattr(spelling, "TILE", tile)
    words = some_words(200, most=6)
    words = [w for w in words if len(w) == 5] + [w for w in words if len(w) == 6]
    longer = [len(w) > 5 for w in words]
    found = Counter()
    for at, parts, open_end in spelling._small(list(range(len(words))), words, longer, True):
        order = sorted(range(len(at)), key=lambda i: longer[at[i]])
        at, parts = [at[i] for i in order], [parts[i] for i in order]
        flags = np.array([longer[i] for i in at])
        for a, b in spelling.near_pairs(parts, flags, np.zeros(len(at), int), np.full(len(at), open_end)):
            found.update(tuple(sorted((words[at[x]], words[at[y]]))) for x, y in zip(a, b, strict=True))
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b) and min(len(a), len(b)) == 5}
    assert set(found) == want and set(found.values()) == {1}


def test_forms_and_roots(spark):
    """Forms in a chain, ties in code-point order, and an n that is not twice as large."""
    words = [("abcde", 1), ("abcdf", 2), ("abcgf", 4), ("abhgf", 9), ("xxxxx", 5), ("xxxxy", 9), ("zzzzz", 2), ("zzzzé", 4), ("zzzza", 4), ("alone", 7)]
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.with_forms(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcde"] == ("abcdf", "abhgf", 1, 2) and got["abcgf"] == ("abhgf", "abhgf", 2, 9) and got["abhgf"] == (None, "abhgf", 1, None)
    assert got["xxxxx"] == (None, "xxxxx", 1, None) and got["zzzzz"] == ("zzzza", "zzzza", 2, 4) and got["alone"] == (None, "alone", 0, None)


def test_odd_documents(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns, no rows."""
    long = "Wörter WÖRTER × x " * 20_000
    rows = [(1, None), (2, ""), (None, "Colour colour colour"), (3, long), (4, "Colour ÀÉÎÕÜ"), (4, "Colour ÀÉÎÕÜ"), (4, "Colour ÀÉÎÕÜ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(7).alias(c) for c in ("word", "N", "run", "a.b", "members", "form")])
    want = Counter()
    for doc_id, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.spelling_variants(docs).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
