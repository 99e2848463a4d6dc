"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Trees are complete, of a fixed depth, and kept as flat arrays (feature, threshold, leaf), which a
task walks for all its documents at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, position, table, unused, with_arrow, without

#: Labelled rows that a model is fitted on, at most; of more, those with the smallest hash of the id.
MAX_TRAIN = 20_000
HELD_OUT_FOLDS, CUTOFF = 5, 0.3

#: Frequent short words of four languages.
STOP_WORDS = frozenset("the of and to in is that it for was on with as by an be this at are from der die das und ist nicht ein eine zu mit von den sich auf für la de que el en los las un una por es se del le les des et est dans du qui pour au".split())
SYMBOLS = b"#$%&*!|<>{}[]=+_~^\\/@"
FEATURES = (
    ["log_bytes", "log_words", "log_lines", "mean_word", "long_words", "stop_words", "distinct_words", "top_word", "word_run", "mean_line", "distinct_lines", "lines_ended", "caps_words", "symbol_words", "digit_words", "one_letter_words"]
    + ["lower", "upper", "digit", "space", "non_ascii", "period", "comma", "quote", "byte_entropy", "bigram_repeats"]
    + [f"symbol_{chr(b)}" for b in SYMBOLS]
)


def features(text: str | None) -> list[float]:
    """Statistics of the whole text, in the order of FEATURES; those of a null text are those of an empty one."""
    raw = (text or "").encode()
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, k = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = count[count > 0] / n
    often = Counter(words)
    run = best = 0
    before = None
    for w in words:
        run = run + 1 if w == before else 1
        before = w
        if run > best:
            best = run
    stripped = [w.rstrip(b".,;:!?").lower() for w in often]
    stops = sum(c for w, c in zip(stripped, often.values(), strict=True) if w.decode("utf-8", "ignore") in STOP_WORDS)
    of_words = lambda test: sum(c for w, c in often.items() if test(w)) / m
    bigrams = Counter(zip(words, words[1:]))
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), len(raw) / m, of_words(lambda w: len(w) > 15), stops / m,
        len(often) / m, max(often.values(), default=0) / m, best / m, len(raw) / k, len(set(lines)) / k,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, of_words(lambda w: len(w) > 1 and w.isupper()), of_words(lambda w: w[-1] in SYMBOLS),
        of_words(lambda w: w.isdigit()), of_words(lambda w: len(w) == 1),
        count[97:123].sum() / n, count[65:91].sum() / n, count[48:58].sum() / n, (count[32] + count[9:14].sum()) / n, count[128:].sum() / n,
        count[46] / n, count[44] / n, (count[34] + count[39]) / n, float(-(p * np.log2(p)).sum()), 1 - len(bigrams) / max(1, len(words) - 1),
        *(count[b] / n for b in SYMBOLS),
    ]


@dataclass
class Trees:
    """feature and threshold have 2**depth - 1 inner nodes a tree in breadth-first order, leaf 2**depth values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and (at[:1] < inner).all() and len(at):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Gradient boosting on the logistic loss, with splits at histogram bins. Without rows of both labels the trees are none."""
    inner = 2**depth - 1
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 0.0)
    if len(y) == 0:
        return none
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    none.base = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return none
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])  # bin b: edges[b-1] < value <= edges[b]
    total, out = np.full(len(y), none.base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            node = at - first
            gain = np.zeros(width)
            cut = np.zeros(width, np.int64)
            chosen = np.zeros(width, np.int64)
            for f, b in enumerate(binned):
                cell = node * bins + b
                gl = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(1)
                hl = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gr, hr = gt - gl, ht - hl
                better = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - gt**2 / (ht + l2), 0.0)
                best = better.argmax(1)
                value = better[np.arange(width), best]
                new = value > gain + 1e-9
                gain[new], cut[new], chosen[new] = value[new], best[new], f
            split = gain > 0
            feature[first : first + width] = chosen
            threshold[first : first + width] = [edges[f][c] if s else np.inf for f, c, s in zip(chosen, cut, split, strict=True)]
            limit = np.where(split, cut, bins)
            at = 2 * at + 1 + (binned[chosen[node], np.arange(len(y))] > limit[node])
        leaf_of = at - inner
        leaf = -rate * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + l2)
        total += leaf[leaf_of]
        out.append((feature, threshold, leaf))
    return Trees(*map(np.stack, zip(*out, strict=True)), none.base)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 0 modulo HELD_OUT_FOLDS; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0, F.lit(False))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN) -> Trees:
    """A model of labels.quality, from rows that are not held out; max_rows bounds what is gathered.

    Rows with a null id or label are left out; of several labels of one document the smallest
    counts. Documents that are there twice count twice.
    """
    bounded_batches(docs.sparkSession)
    wanted = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", "label")
    # documents may repeat: of more than twice the bound those with the least hash of all they are
    some = known.mapInArrow(_features_of, "label int, x array<double>").orderBy(F.xxhash64("x", "label"), "x", "label").limit(2 * max_rows)
    got = some.toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    y = got["label"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the order of arrival doesn't count
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """docs with the model's score of each whole text; a column of that name is replaced. Null texts score as empty ones."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, name)
    text = position(docs, "text")

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        x = np.array([features(t) for t in batch.column(text).to_pylist()]).reshape(-1, len(FEATURES))
        return [pa.array(model.score(x), pa.float64())]

    return with_arrow(docs, score, {name: "double"})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model, fitted on the labels, does not reject; their columns are as before.

    A null text is judged as an empty one; rows with a null id and repeated rows are judged each.
    Without labels of both kinds all have one score and stay or go together. An empty table gives none.
    """
    name = unused(docs, "score")
    return without(score_documents(docs, train(docs, labels), name).where(F.col(name) >= CUTOFF), name)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The score of every document: null texts as empty ones, repeated rows each, null ids never held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
