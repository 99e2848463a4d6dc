"""Operators against plain versions of themselves on a small table."""

import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaykit.llm import decontamination, licenses, minhash, quality, substrings, tokens
from assaykit.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()


@pytest.mark.parametrize("name", Q.SQL)
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF), c.sql(Q.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(map(repr, ([r[x] for x in order] for r in got.collect()))) == sorted(map(repr, ([r[want.columns.index(x)] for x in order] for r in want.fetchall())))


def test_tokens(spark, texts):
    library, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, {}
    for doc_id, text in texts:
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        want[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.queries()["op7_token_orc"](spark, SF).collect()}
    assert got == want


def test_odd_words():
    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["", " ", "ǰ J̌ Ω ΑΣ, İI.", "a\x1cb c", "x<|endoftext|>Y <|ENDOFTEXT|>", "it's don'T. WE'LL,go..", "日本語, テキスト. ½ ١٢3 4.5,", "é É. a\u2003b c\u200bd\x85e", "é́,", " ́x ,. .,", "한국 한."]
    ids, n = tokens.WordEncoder(path).encode(odd, 1)
    got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [[*Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids, 1] for x in odd]


def test_other_tokenizers(texts, tmp_path):
    """A tokenizer of another form encodes whole texts; only the one form goes word by word."""
    word = public_tokenizers.path("word_bpe_49k.json")
    assert tokens.is_word_bpe(word) and isinstance(tokens.encoder_of(word), tokens.WordEncoder)
    form, paths = json.loads(Path(word).read_text()), [public_tokenizers.path("byte_bpe_50k.json")]
    changes = {"case": {"normalizer": {"type": "NFC"}}, "cut": {"truncation": {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}}, "space": {"pre_tokenizer": form["pre_tokenizer"]["pretokenizers"][1]}}
    for name, change in changes.items():
        (tmp_path / name).write_text(json.dumps(form | change))
        paths.append(str(tmp_path / name))
    some = ["", " Two  Words\n", "It's A Case, KEPT.", *[t for _, t in texts[:20]]]
    for path in paths:
        assert not tokens.is_word_bpe(path)
        library = Tokenizer.from_file(path)
        library.no_truncation()
        ids, n = tokens.encoder_of(path).encode(some, 7)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, 7] for t in some]
        ids, n = tokens.encoder_of(path).encode([], 7)
        assert len(ids) == len(n) == 0


def test_licenses(spark, texts):
    phrases = [(t.label, t.text.split()) for t in licenses.BASE]
    got = {r.doc_id: r for r in Q.queries()["op4_licenses"](spark, SF).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(lower))
        places = [(i, label) for label, p in phrases for i in range(len(w)) if w[i : i + len(p)] == p]
        starts, r = [i for i, _ in places], got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def near(texts):
    bags, root = [(d, minhash.shingles_of(t)) for d, t in texts], {d: d for d, _ in texts}
    seen = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (d, b), (_, t) in zip(bags, texts, strict=True):
        for e, other in bags:
            if e < d and (len(b) + len(other)) and minhash.similarity(b, other) >= 0.8:
                x, y = find(d), find(e)
                root[max(x, y)] = min(x, y)
        if t in seen:
            x, y = find(d), find(seen[t])
            root[max(x, y)] = min(x, y)
        seen.setdefault(t, d)
    return {d: find(d) for d in root}


def test_minhash(spark, texts, monkeypatch):
    random.seed(5)
    words = "a b c d e f g h i j k l m n o p".split()
    base = [random.choice(words) + str(random.randrange(50)) for _ in range(80)]
    rows = list(texts)
    for i in range(60):
        copy = list(base)
        for _ in range(random.randrange(6)):
            copy[random.randrange(80)] = f"new{random.randrange(1000)}"
        rows.append((10_000 + i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = near(rows)
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == want
    monkeypatch.setattr(minhash, "CHUNK", 4)  # hot representatives and large buckets
    monkeypatch.setattr(minhash, "PART", 3)
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == want
    assert {r.doc_id for r in minhash.keep_first(docs).collect()} == set(want.values())


def test_signatures_estimate_weighted_jaccard():
    random.seed(2)
    letters, off = "abcdefghijklmnopqrstuvwxyz", []
    for _ in range(60):
        x = [random.choice(letters) for _ in range(60)]
        y = [c if random.random() > 0.04 else "zz" for c in x]
        x, y = " ".join(x * random.choice((1, 3))), " ".join(y * random.choice((1, 2, 5)))
        a, b = minhash.signatures([x.encode(), y.encode()])
        off.append((a == b).mean() - minhash.similarity(minhash.shingles_of(x), minhash.shingles_of(y)))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_substrings_in_shards(spark, texts, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 4)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2000)
    first, rows = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts]
    for d, w in rows:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for d, w in rows:
        gone = {i + j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(13)}
        assert got[d].n_removed == len(gone) and got[d].kept == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_fm_index_statistics():
    random.seed(3)
    text = [[random.choice([b"a", b"b", b"c"]) for _ in range(60)] for _ in range(20)]
    index = substrings.FmIndex(text, np.arange(20))
    windows = np.diff(index.starts) - substrings.WINDOW
    got = index.stream(index.starts[:-1], windows, index.text)
    for i, seq in enumerate(text):
        for k in range(windows[i]):
            want = min(j for j, other in enumerate(text) if any(other[x : x + 13] == seq[k : k + 13] for x in range(48)))
            assert got[i, k] == want


def test_retrieval_is_exhaustive(texts):
    items = [(i, *decontamination.question_answer(t)) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    index = decontamination.Bm25Index(items)
    for _, text in texts[:60]:
        w = decontamination.words_of(text)
        for theta in (0.1, 0.35):
            want = {}
            for k in range(0, len(w), index.half):
                scores = Counter()
                for t in {index.term[x] for x in w[k : k + 2 * index.half] if x in index.term}:
                    for found in index.postings[t].values():
                        for i, x in found:
                            scores[i] += x
                if hits := sorted((i, round(x, 6)) for i, x in scores.items() if x >= theta - 1e-6):
                    want[k] = hits
            assert {k: sorted((i, round(x, 6)) for i, x in h) for k, h in index.retrieve(w, theta)} == want


def test_quality_held_out(spark):
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    rows = [r for r in Q.queries()["op1_quality"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_trees_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, trees=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def one(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([one(r) for r in x[:50]], model.score(x[:50]))


def test_covered_words_of_a_batch():
    """Runs of a batch are found by keys of their words: in texts without anchors, hot and not, first here and not."""
    w = [f"w{i}" for i in range(40)]
    texts = [" ".join(x).encode() for x in (w, w[:5], w[3:30], [], ["x"] + w)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([t.decode() for t in texts])], names=["doc_id", "text"])
    found = [r for b in substrings._anchors(iter([batch])) for r in zip(*b.to_pydict().values(), strict=True)]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("hot", pa.bool_())]))
    runs = pa.list_(pa.struct([("run", pa.int64()), ("earlier", pa.int64())]))
    for hot in (False, True):
        anchors = pa.array([[{"anchor": a, "hot": hot} for a, d in found if d == i] or None for i in range(5)], kind)
        keys, (doc, words) = [], substrings.word_hashes(texts)
        text, first, windows, *_ = substrings._repeated(doc, words, anchors)
        for d, key in zip(text.tolist(), substrings._run_keys(words, first, windows).tolist(), strict=True):
            keys.append((d, key))
        assert len(set(keys)) == len(keys)
        assert not hot or {k for d, k in keys if d == 0} < {k for d, k in keys if d == 4}
        firsts = pa.array([[{"run": k, "earlier": 0} for d, k in keys if d == i] if i == 0 else None for i in range(5)], runs)
        gone = substrings._covered(texts, anchors, firsts)
        assert [g is None for g in gone] == [False, True, False, True, False]
        assert not gone[0].any() and gone[2].all() and gone[4][1:].all()
