"""The pipeline against plain versions of its stages in turn, and op8 against a scan of all items."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from assaykit.llm import decontamination, minhash, mixing, quality
from assaykit.llm import queries as Q
from assaykit.llm.common import WORD_RE, table

SF, SF8 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def contaminated(texts, items):
    """(text's place, item) where half of question's and answer's 3-grams, or four fifths of the question's, stand in one stretch of words."""
    found = set()
    index = decontamination.Bm25Index([(i, *decontamination.question_answer(t)) for i, t in items])
    for at, text in enumerate(texts):
        w = decontamination.words_of(text)
        for first in range(0, max(1, len(w)), index.half):
            near = decontamination.grams(w[max(0, first - index.half) : first + 3 * index.half])
            for (i, _), q, a in zip(items, index.question, index.answer, strict=True):
                of_q, of_a = len(q & near) / max(1, len(q)), len(a & near) / max(1, len(a))
                if of_q >= decontamination.ALONE or of_q >= decontamination.BOTH and (of_a >= decontamination.BOTH or not a):
                    found.add((at, i))
    return found


def test_op8_against_a_scan_of_all_items(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF8}/documents.parquet' order by 1").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SF8}/benchmark.parquet' order by 1").fetchall()
    want = {(rows[at][0], i) for at, i in contaminated([t for _, t in rows], items)}
    got = {(r.doc_id, i) for r in Q.queries()["op8_decontamination"](spark, SF8).collect() for i in r.item_ids}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 3


def test_run(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    ids = sorted(docs)
    scores = model.score(np.array([quality.features(docs[i].text) for i in ids]))
    left = [i for i, s in zip(ids, scores, strict=True) if s >= quality.CUTOFF]
    bags, root = {i: minhash.shingles_of(docs[i].text) for i in left}, {i: i for i in left}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in left:
        for b in left:
            if a < b and minhash.similarity(bags[a], bags[b]) >= minhash.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    left = [i for i in left if find(i) == i]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    gone = {left[at] for at, _ in contaminated([docs[i].text for i in left], items)}
    left = [i for i in left if i not in gone]
    mixed = mixing.mix(spark.createDataFrame([docs[i] for i in left])).collect()  # held against SQL elsewhere
    times = {r.doc_id: r.copies for r in mixed}
    assert abs(sum(r.copies * r.size for r in mixed) - 1.5 * sum(len(WORD_RE.findall(docs[i].text)) for i in left)) < 0.2 * sum(r.size for r in mixed)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = Counter(), 0
    for i in left:
        row = [*library.encode(docs[i].text, add_special_tokens=False).ids, 1]
        for _ in range(times[i]):
            want[(i, start, len(row), zlib.crc32(np.array(row, "<u4").tobytes()))] += 1
            start += len(row)
    got = Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want and len(want) > 20


def tables_of(tmp_path, **wheres):
    """A folder of the tables' rows where the conditions say so (documents: a query)."""
    for name in ("documents", "labels", "benchmark"):
        rows = wheres.get(name, f"select * from '{SF}/{name}.parquet' where false")
        duckdb.sql(f"copy ({rows}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path)


def test_run_on_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, tables_of(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.collect() == []


def test_run_on_nulls(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, a column more, and no benchmark: what is kept lies end to end, once for each copy taken."""
    every = f"select * from '{SF}/documents.parquet'"
    nulls = {c: f"select * replace (null as {c}) from '{SF}/documents.parquet' where doc_id % 9 = {i}" for i, c in enumerate(("doc_id", "text", "source", "lang"))}
    empty = f"select * replace ('' as text, -doc_id as doc_id) from '{SF}/documents.parquet' where doc_id % 30 = 7"
    rows = " union all ".join([every, *nulls.values(), empty, f"{every} where doc_id % 5 = 1"])
    sf_dir = tables_of(tmp_path, documents=f"select *, 'x' as \"a.b\" from ({rows})", labels=f"select * from '{SF}/labels.parquet'")
    got = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: (r.start, r.n_tokens))
    assert len(got) > 20 and all(r.n_tokens >= 1 for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    most = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert max(n for (i, _, _), n in most.items() if i is not None and i > 0) <= 2  # of copies one stays, and is taken twice at most
