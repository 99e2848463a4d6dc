"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns: every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaykit.llm import decontamination, licenses, media, minhash, mixing, quality, substrings, tokens, url_filter, warc
from assaykit.llm.common import new_path

LONG = "lorem ipsum dolor " * 30_000
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, LONG, "en", "a", 9),
    (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 5), (6, "released under the MIT License", "en", "b", 1), (6, "released under the MIT License", "en", "b", 1), (7, " \t\n", "xx", "c", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["Score", "Matches", "all_found", "size", "target", "copies", "u", "kept_id", "places", "sniffed_type", "id", "digest", "part", "host", "rule", "label", "row", "whole"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASH], F.lit("x").alias("a.b"))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, 0), (1, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, ""), (4, ROWS[0][1])], "item_id long, text string")


def test_quality(spark, docs, clashing):
    model = quality.train(clashing, labels(spark))
    got = quality.score_documents(clashing, model).select("doc_id", "score").collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert quality.keep_good(clashing, labels(spark)).columns == clashing.columns
    assert quality.train(docs.limit(0), labels(spark)).score(quality.np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert quality.score_documents(docs.limit(0), model).count() == 0


def test_warc(spark):
    page = "x" * 120
    rows = [(1, "http://a", page), (2, None, page), (2, None, page), (3, "u\r\nX: y", None), (4, "a", ""), (5, "b", "short"), (6, "c", "short"), (None, "d", page), (7, "e", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    files = warc.write_warc(pages, new_path(spark, "warc"))
    for split in (700, 1 << 20):
        got = warc.read_warc(spark, files, split_bytes=split).collect()
        assert len(got) == len(rows) and all(r.intact for r in got)
        assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got if r.record_type == "revisit"), key=str) == [("2", "revisit", "1"), ("2", "revisit", "1"), (None, "revisit", "1")]
        assert {r.page_id: r.payload_digest for r in got}["7"] == hashlib.sha256(LONG.encode()).hexdigest()
        assert {r.page_id: r.payload_bytes for r in got}["2"] == 120
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), new_path(spark, "warc"))).count() == 0


def test_urls(spark):
    urls = ["http://Example.ORG/es/x", "https://a.example.org/en/1?q", "x://org", "http://notorg/", None, "no scheme", "http://www.casino-win.example.com", "http://casino-win.example.com/fr/", "http://b.com/de/#x", "http://[/?", "http://" + "a." * 5000 + "org/"]
    want = ["block", "block", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow", "allow"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string").withColumn("host", F.lit("x"))
    blocked = spark.createDataFrame([*url_filter.BLOCKED, (None, "")], "host string, path string")
    for bound in (1 << 20, -1):
        old, url_filter.MAX_ARRAY_BYTES = url_filter.MAX_ARRAY_BYTES, bound
        try:
            got = url_filter.judge(pages, url_filter.RULES, blocked).orderBy("page_id").collect()
        finally:
            url_filter.MAX_ARRAY_BYTES = old
        assert [r.verdict for r in got] == want
        assert got[0].rule == "example.org/es/" and got[2].rule is None and got[10].rule == "org/"
    assert url_filter.judge(pages, url_filter.RULES, blocked.limit(0)).where("listed is not null").count() == 0


def test_digest_collisions(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    array = url_filter.DigestArray.mapped(url_filter.DigestArray.pack([("a", ""), ("b", "/")]))
    assert array.find(["a", "b/", "c", "b"]).tolist() == [True, True, False, False]


def test_licenses(spark, clashing):
    got = {r.doc_id: r for r in licenses.scan_licenses(clashing).collect()}
    assert [(p.label, p.start) for p in got[6].places] == [("mit", 1)] and got[2].n_words == 0 and got[4].n_words == 90_000
    text = licenses.OWN[8].text.replace("obtaining", "getting") + " and under the MIT license, all rights reserved"
    index = licenses.LicenseIndex([*licenses.BASE, *licenses.OWN], {})
    assert {index.templates[i].label for i, _, _ in index.scan(licenses.words_of(text))} == {"mit", "mit-text", "proprietary"}
    assert index.scan(licenses.words_of(licenses.OWN[8].text.replace("without restriction", "freely"))) == []
    assert licenses.scan_licenses(clashing.limit(0)).count() == 0


def test_media(spark, clashing):
    got = {r.doc_id: r for r in media.media_digest(clashing).collect()}
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        raw += bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert got[doc_id].payload_sha256 == hashlib.sha256(raw).hexdigest()
    assert got[1].media_sha256 == got[5].media_sha256 and got[1].feature == got[5].feature
    assert media.media_digest(clashing.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None), (b"", "a"), (media.wav_of(b"abc"), "image/png")], "media binary, declared_type string").withColumn("Corrected", F.lit(1)).withColumn("a.b", F.lit(2))
    assert media.sniff_media(odd).columns == ["media", "declared_type", "a.b", "sniffed_type", "corrected", "embedded"]
    assert [(r.sniffed_type, r.corrected) for r in media.sniff_media(odd).collect()] == [(None, False), (None, False), ("audio/wav", True)]


def test_media_in_a_row():
    import io
    import zipfile

    def packed(text):
        with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
            z.writestr("x", text)
        return out.getvalue()

    pdf = b"%PDF-1.4\nx\nstartxref\n9\n%%EOF"
    parts = [b"....", pdf + b"\nnew\nstartxref\n20\n%%EOF", b"..", packed("a"), b"..", media.wav_of(b"abc"), pdf, b"..", packed("bc" * 20)]
    starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    kinds = {1: "application/pdf", 3: "application/zip", 5: "audio/wav", 6: "application/pdf", 8: "application/zip"}
    assert media.sniff(b"".join(parts)) == [(k, starts[i], len(parts[i])) for i, k in kinds.items()]


def test_substrings(spark, clashing):
    got = {r.doc_id: r for r in substrings.remove_repeats(clashing).collect()}
    assert (got[5].n_removed, got[5].kept) == (14, "") and got[1].n_removed == 0 and got[4].n_removed == 0 and got[2].kept == "" and got[7].n_words == 0
    null = spark.createDataFrame([(None, ROWS[0][1]), (1, ROWS[0][1])], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(null).collect()] == [0, 0]
    assert substrings.remove_repeats(clashing.limit(0)).count() == 0


def test_tokens(spark, clashing):
    got = sorted(tokens.token_digest(clashing).collect())
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 7)} == {1} and len(got) == len(ROWS)
    assert tokens.token_digest(clashing.limit(0)).count() == 0
    path = new_path(spark, "tokens")
    tokens.write_tokens(clashing, path, __import__("public_tokenizers").path("word_bpe_49k.json"))
    one = tokens.read_tokens(spark, path, F.col("doc_id") == 6)
    assert one.count() == 2 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)" in one._jdf.queryExecution().toString()


def test_decontamination(spark, clashing):
    found = {r.doc_id: [m.item_id for m in r["matches"]] for r in decontamination.benchmark_matches(clashing, benchmark(spark)).collect()}
    assert found[1] == found[5] == [1, 4] and not any(found[d] for d in (2, 3, 4, 6, 7))
    assert decontamination.drop_contaminated(clashing, benchmark(spark)).columns == clashing.columns
    assert decontamination.drop_contaminated(clashing, benchmark(spark).limit(0)).count() == len(ROWS)
    old, decontamination.MAX_INDEX_BYTES = decontamination.MAX_INDEX_BYTES, 100
    try:
        split = {r.doc_id: [m.item_id for m in r["matches"]] for r in decontamination.benchmark_matches(clashing, benchmark(spark)).collect()}
    finally:
        decontamination.MAX_INDEX_BYTES = old
    assert split == found
    answers = spark.createDataFrame([(1, "one two three four five six seven eight", "never said in any text")], "item_id long, text string, answer string")
    alone = {r.doc_id: r["matches"] for r in decontamination.benchmark_matches(clashing, answers).collect()}
    assert alone[1][0].question_overlap == 1.0 and alone[1][0].answer_overlap == 0.0


def test_short_answers_and_questions_alone():
    of = lambda text, *items: {i: m[1:] for i, m in decontamination.Bm25Index([(0, *decontamination.question_answer(*x)) for x in items]).matches(decontamination.words_of(text)).items()}
    others = [("what is the tallest mountain on earth", "Everest"), ("unrelated words stand here for others", "nothing much")]
    asked = ("what is the capital city of the country named France", "Paris")
    assert of("so the capital city of the country is Paris of course", asked, *others)[0][1] == 1.0
    assert 0 not in of("so the capital city of the country is Rome of course", asked, *others)
    assert of("it is blue whale said he", ("blue whale", ""), *others)[0][0] == 1.0 and not of("a whale is blue", ("blue whale", ""))
    heavy = ("who wrote the book", " ".join(f"answer{k}" for k in range(20)))
    assert of("and who wrote the book he asked", heavy, *others) == {0: (1.0, 0.0)}


def test_split_index_keeps_scores(spark, monkeypatch):
    items = [(i, " ".join(f"w{i * i * k * k % (41 + i)}" for k in range(2, 14 + 3 * i))) for i in range(1, 13)]
    docs = spark.createDataFrame([(i, t.rsplit(" ", 4)[0] + f" w1 w2 w{i}") for i, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {r.doc_id: [(m.item_id, round(m.score, 9), m.question_overlap) for m in r["matches"]] for r in decontamination.benchmark_matches(docs, bench).collect()}
    whole = found()
    monkeypatch.setattr(decontamination, "MAX_INDEX_BYTES", 500)
    assert found() == whole and sum(map(len, whole.values())) > 5


def test_minhash(spark, clashing):
    got = {r.doc_id: r.class_id for r in minhash.near_classes(clashing).collect()}
    assert got[1] == got[5] == 1 and got[2] == got[3] == got[7] == 2 and got[6] == 6 and got[4] == 4
    kept = minhash.keep_first(clashing)
    assert kept.columns == clashing.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 6]
    assert minhash.near_classes(clashing.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (9, "a b")], "doc_id long, text string")
    assert sorted(r.class_id for r in minhash.near_classes(nulls).collect()) == [9, 9, 9]
    assert [tuple(r) for r in minhash.keep_first(nulls).collect()] == [(9, "a b")]


def test_repeated_ids_lose_no_text(spark):
    x, y, z = ("a b c d e f g", "p q r s t u v", "k l m n o")
    rows = [(1, x, "r"), (1, y, "s"), (2, y, "t"), (3, z, "u"), (3, z, "q"), (3, x, "v"), (None, "n u l l s", "w"), (None, "o t h e r", "x"), (None, "o t h e r", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    for _ in range(2):
        kept = sorted(map(tuple, minhash.keep_first(docs.repartition(3)).collect()), key=str)
        assert kept == sorted([(1, x, "r"), (1, y, "s"), (3, z, "q"), (None, "n u l l s", "w"), (None, "o t h e r", "x")], key=str)
    classes = minhash.near_classes(docs).collect()
    assert len(classes) == len(rows) and len({r.class_key for r in classes}) == 5
    assert {(r.doc_id, r.class_id) for r in classes} == {(1, 1), (2, 1), (3, 3), (3, 1), (None, None)}


def test_mixing(spark, clashing, docs):
    got = mixing.mix(clashing).collect()
    assert len(got) == len(ROWS) and all(0 <= r.copies <= 2 for r in got)
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mixing.mix(clashing, keep_rows=False).collect())
    assert mixing.mix(docs.limit(0)).count() == 0
    weighted = {r.doc_id: r.copies for r in mixing.mix(docs.withColumn("w", F.when(F.col("doc_id") == 4, 0.0)), weight_col="w").collect()}
    assert weighted[4] == 0


def test_mixing_of_ties(spark):
    rows = [(i if s != "b" else None if i % 3 else 7, f"x y z {s}" + " w" * (i % 2), s, i) for s in "abc" for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    for got in (mixing.mix(docs).collect(), mixing.mix(docs, keep_rows=False).collect()):
        assert len(got) == len(rows)
        for s in "abc":
            assert abs(sum(r.copies * r.size for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 2.5
    whole = mixing.mix(docs).collect()
    assert sorted((r.source, r.n) for r in whole) == sorted((r[2], r[3]) for r in rows)


def test_pipeline_columns(spark, clashing, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns, name
        assert out.where("size is not null and size <> 'x'").count() == 0


def test_word_encoder_splits_as_the_library(monkeypatch):
    """Texts of a batch with every white space, at the ends too, marked texts among them, each distinct word looked up once."""
    import public_tokenizers

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    spaces = [c for c in map(chr, range(0x110000)) if c.isspace()]
    texts = ["", " ", "A  b\u0085", "<|x|> it's", "\x1ca b", "I\u0307 E\u0301a", "end <|", "K\u212a. x.,"] + [r.choice(spaces).join(["", "Ab", "cd.", "e\u0301F", "1,2", ""]) for _ in range(80)] + [f"a{c}b" for c in spaces]
    encoder, plain = tokens.WordEncoder(path), tokens.TextEncoder(path)
    for some in (texts, texts[::-1], texts[:1], [], ["<|x|> it's"]):
        for got, want in zip(encoder.encode(some, 1), plain.encode(some, 1), strict=True):
            assert got.tolist() == want.tolist()
    looked = []

    class Counting(dict):
        def get(self, key, *other):
            looked.append(key)
            return super().get(key, *other)

    encoder.at = Counting(encoder.at)
    encoder.encode(["again and again " * 50] * 20, 1)
    assert sorted(looked) == [" ", "again", "and"]
