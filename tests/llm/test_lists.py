"""URL lists of thousands of entries and license texts against plain versions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from assaykit.llm import decontamination, licenses, url_filter
from assaykit.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def listed():
    r = random.Random(3)
    host = lambda: ".".join(r.choice(["a", "b", "shop", "news", "x1"]) + str(r.randrange(40)) for _ in range(r.randrange(1, 4))) + r.choice([".com", ".org", ""])
    path = lambda: r.choice(["", "/", "/é", "/p", "/p/q", f"/{r.randrange(30)}"])
    entries = [(host(), path()) for _ in range(5000)]
    own = [(r.choice(["", "www."]) + (r.choice(entries)[0] if r.random() < 0.5 else host()), path() + r.choice(["", "/x", "z"])) for _ in range(1500)]
    return entries, [*own, *[(None, None)] * 500, *[own[0]] * 500]


@pytest.mark.parametrize("bounds", [(64 << 20, 8 << 20), (-1, 8 << 20), (-1, 9000)])
def test_longest_match(spark, listed, monkeypatch, bounds):
    """One array; one in many places; many arrays. The sum of all: a third of the rows have one URL, or none."""
    entries, urls = listed
    monkeypatch.setattr(url_filter, "MAX_ARRAY_BYTES", bounds[0])
    monkeypatch.setattr(url_filter, "SHARD_BYTES", bounds[1])
    rows = spark.createDataFrame([(i, h, p, "n") for i, (h, p) in enumerate(urls)], "id long, Host string, path string, `a.b` string").repartition(5, "id")
    given = spark.createDataFrame([*entries, (None, "/"), ("x", None)], "host string, path string")
    got = url_filter.longest_match(rows.withColumn("Found", F.lit(1)), given, "found")
    assert got.columns == ["id", "Host", "path", "a.b", "found"]
    stored, want = {h + p for h, p in entries}, {}
    for i, (h, p) in enumerate(urls):
        parts, p = (h or "").split("."), p or ""
        fits = [".".join(parts[k:]) + p[:m] for k in range(len(parts)) for m in range(len(p) + 1)]
        want[i] = min((x for x in fits if x in stored), key=lambda x: (-len(x), x), default=None)
    assert {r.id: r.found for r in got.collect()} == want
    assert sum(x is not None for x in want.values()) > 300


@pytest.mark.parametrize("most", [64 << 20, -1])
def test_host_and_path_stay_apart(spark, monkeypatch, most):
    """An entry's path is not the end of another host, nor a host with a slash an entry."""
    monkeypatch.setattr(url_filter, "MAX_ARRAY_BYTES", most)
    entries = spark.createDataFrame([("example.co", "m"), ("b.org/x", ""), ("c.org", "/p"), ("d.org", "")], "host string, path string")
    urls = [("example.com", ""), ("example.com", "m"), ("example.co", "m/x"), ("b.org", "/x"), ("b.org", "x/"), ("b.org/x", ""), ("c.org", "/p/q"), ("c.org", "p"), ("x.d.org", "/"), (None, "/"), ("", "m")]
    got = url_filter.longest_match(spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "id int, host string, path string"), entries, "found")
    assert {r.id: r.found for r in got.collect() if r.found} == {2: "example.com", 6: "c.org/p", 8: "d.org"}
    assert url_filter.longest_match(got.limit(0), entries, "found").count() == 0


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_license_labels(spark):
    """labels and score of whole texts: phrases by a plain scan; license texts planted with words replaced."""
    r, texts = random.Random(5), [t for _, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()]
    long = [t for t in licenses.OWN if not t.exact]
    docs, planted = [], []
    for i, text in enumerate(texts):
        t = long[i % len(long)]
        body, fixed = t.text.split(), {x for k in t.keys for x in k.split()}
        change = i % 4 * 5 / 100  # 0, 5, 10, 15 % of the words, none of the key phrases
        body = ["zzz" if x not in fixed and r.random() < change else x for x in body]
        if i % 3 == 0:
            text, share = f"{text} {' '.join(body).upper()} {text}", sum(x != "zzz" for x in body) / len(body)
        elif i % 3 == 1:
            key = t.keys[0].split()
            text, share = f"{text} {t.text.replace(t.keys[0], ' '.join(reversed(key)))}", 0
        else:
            share = 0
        docs.append((i, text))
        planted.append((t.label, share) if share >= t.share else None)
    got = {x.doc_id: x for x in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    phrases = [(t.label, plain_words(t.text)) for t in [*licenses.BASE, *licenses.OWN] if t.exact]
    for (i, text), there in zip(docs, planted, strict=True):
        w = plain_words(text)
        want = sorted((a, label) for label, p in phrases for a in range(len(w)) if w[a : a + len(p)] == p)
        near = [p for p in got[i].places if p.label.endswith("-text")]
        assert sorted((p.start, p.label) for p in got[i].places if not p.label.endswith("-text")) == want
        assert [p.label for p in near] == ([there[0]] if there else [])
        assert not there or abs(near[0].share - there[1]) < 0.2


def test_license_digest(spark):
    """op4's labels and score are those of the operator's places."""
    places = {r.doc_id: r.places for r in licenses.scan_licenses(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for r in Q.queries()["op4_licenses"](spark, SF).collect():
        assert r.labels == ",".join(sorted({p.label for p in places[r.doc_id]}))
        assert r.score == max((p.share for p in places[r.doc_id]), default=0.0)


def test_rare_words_of_the_file():
    """Where a template's rarest words are gone from a file, the next rarest that it has find the place."""
    t = next(x for x in licenses.OWN if x.label == "isc-text")
    idf = {x.encode(): float(i) for i, x in enumerate(dict.fromkeys(reversed(t.text.split())))}
    gone = [x.decode() for x in sorted(idf, key=lambda x: -idf[x]) if x.decode() not in t.keys[0].split()][:4]
    index = licenses.LicenseIndex([t], idf)
    text = " ".join("zzz" if x in gone else x for x in t.text.split())
    assert [i for i, _, _ in index.scan(licenses.words_of(f"one two {text}"))] == [0]


def test_scores_are_exact():
    """Among words of no template the share is that of the words that stand there, to the last digit."""
    r, filler = random.Random(7), ["zzz"] * 40
    index = licenses.LicenseIndex(licenses.OWN, {})
    for i, t in [(i, t) for i, t in enumerate(licenses.OWN) if not t.exact]:
        body, fixed = t.text.split(), {x for k in t.keys for x in k.split()}
        for change in (0.0, 0.05, 0.1):
            there = ["zzz" if x not in fixed and r.random() < change else x for x in body]
            found = [(s, share) for j, s, share in index.scan(licenses.words_of(" ".join(filler + there + filler))) if j == i]
            want = sum(x != "zzz" for x in there) / len(body)
            assert found == ([(40, want)] if want >= t.share else [])


@pytest.mark.parametrize("n", [25, 500])
def test_rare_words_lose_no_template(n):
    """Templates met by rare words are all that can be in a file: the same places as by walking every template."""
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    pick = lambda: vocabulary[min(int(r.expovariate(0.02)), 399)]
    share = lambda: r.choice([0.0, 0.3, 0.7, 1.0])
    made = [licenses.Template(f"t{i}", " ".join(pick() for _ in range(r.randrange(1, 30))), r.random() < 0.3, share=share()) for i in range(n)]
    idf = {x.encode(): i % 97 / 7 for i, x in enumerate(vocabulary)}
    index, every = licenses.LicenseIndex(made, idf), licenses.LicenseIndex(made, idf)
    every.rare = {x: list(range(n)) for x in every.postings}
    hits = 0
    for _ in range(60):
        t = r.choice(made).text.split()
        text = [pick() for _ in range(r.randrange(40))] + [pick() if r.random() < 0.2 else x for x in t] + [pick() for _ in range(r.randrange(10))]
        w = [x.encode() for x in text]
        assert index.scan(w) == every.scan(w)
        hits += len(index.scan(w)) > 0
    assert hits > 20
    assert index._lookups({b"none"}) == {} and index.scan([b"none"] * 300) == []


def test_few_templates_are_met():
    """What a file meets grows with the rare words that it has, not with the templates."""
    made = [licenses.Template(f"t{i}", " ".join([*(f"own{i}x{j}" for j in range(12)), *(f"common{j}" for j in range(20))]), False) for i in range(2000)]
    idf = {f"common{j}".encode(): 0.1 for j in range(20)} | {x: 5.0 for t in made for x in licenses.words_of(t.text) if x.startswith(b"own")}
    index = licenses.LicenseIndex(made, idf)
    assert all(len(x) == 1 for x in index.rare.values()) and not any(x.startswith(b"common") for x in index.rare)
    w = licenses.words_of(" ".join([*(f"common{j % 20}" for j in range(300)), made[77].text]))
    assert [made[i].label for i, _, _ in index.scan(w)] == ["t77"]


def test_fullest_text():
    """A notice hides the shorter texts within it; two copies in a row are two places; other texts stay."""
    of = {t.label: t for t in licenses.OWN}
    index = licenses.LicenseIndex(licenses.OWN, {})

    def found(text):
        return sorted((s, licenses.OWN[i].label) for i, s, _ in index.scan(licenses.words_of(text)) if not licenses.OWN[i].exact)

    for label, inner in [("bsd-3-full-text", "bsd-2-full-text"), ("mit-full-text", "mit-text"), ("agpl-3-notice-text", "gpl-text"), ("isc-full-text", "isc-text")]:
        text, n = of[label].text, len(of[label].text.split())
        assert found(text) == [(0, label)]
        assert found(f"{text} {text}") == [(0, label), (n, label)]
        assert found(f"{text} or else {of[inner].text}") == [(0, label), (n + 2, inner)]
    assert found("") == found("the license") == []


@pytest.mark.parametrize("name", ["answer", "Answer"])
def test_answer_in_any_case(spark, name):
    """A passage with half of the question and the answer is found by the answer, however its column is written."""
    question = "which river flows through the old town of the northern valley before it reaches the sea"
    benchmark = spark.createDataFrame([(1, question, "the long river")], f"item_id long, text string, {name} string")
    half = " ".join(question.split()[:11])
    docs = spark.createDataFrame([(1, f"{half} is the long river indeed"), (2, f"{half} is not said"), (3, "nothing")], "doc_id long, text string")
    got = {r.doc_id: [m.answer_overlap for m in r.matches] for r in decontamination.benchmark_matches(docs, benchmark).collect()}
    assert got[3] == [] and got[1] == [1.0]


def test_entries_are_told_apart():
    """Host and path come back from a stored string; a path of its own slash is stored as it is."""
    pairs = [("a.co", "m"), ("a.com", ""), ("a.com", "/"), ("a.com", "//"), ("a.com", "/?x"), ("a.com", "?x"), ("a.com", "??x/"), ("", ""), ("", "/x"), ("", "x"), ("a", "\nx")]
    entries = [url_filter.entry_of(*p) for p in pairs]
    assert [url_filter.host_and_path(e) for e in entries] == pairs and len(set(entries)) == len(pairs)
    assert entries[:3] == ["a.co?m", "a.com", "a.com/"]
