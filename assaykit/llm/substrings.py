"""Substring deduplication: FM-indexes over repeated passages, queried by backward search.

A window is WINDOW consecutive words. Its anchor is the 4-gram of words of least hash in it, so
equal windows have equal anchors; neighbouring windows with one anchor make a run. Runs whose
anchor is in one document only cannot repeat. The others, equal ones collapsed to the first
document that has them, are dealt out by their anchors into shards, each small enough for one
FM-index. Every window thus meets all its equals in one shard, and no document is sent to more
shards than it has repeated anchors. Anchors that very many documents share are dealt out by
whole windows instead.

In a shard the index is a Burrows-Wheeler transform over words, sorted by WINDOW words, in a
wavelet matrix of packed bits. The runs are streamed through it from right to left by backward
search: after a window is found, its interval is widened to all suffixes that share its first
WINDOW - 1 words (the parent), and one more step finds the window to its left: matching
statistics, cut off at WINDOW. The least document over a window's interval decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, table, written
from .minhash import _BASE, _FACTORS, _INVERSE, _mix, _powers, word_hashes

WINDOW, GRAM = 13, 4
#: Documents with one anchor, from which on its windows are dealt out one by one.
HOT = 4096
#: Words of an index, about.
SHARD_WORDS = 1_500_000


def _bytes(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def _runs(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor) of all runs, in order. Of the words' texts and hashes; windows
    are counted through all texts, as words are."""
    n = len(words) - GRAM + 1
    if len(words) < WINDOW:
        return (np.zeros(0, np.int64),) * 4
    gram = np.zeros(n, np.uint64)
    for k in range(GRAM):
        gram += words[k : k + n] * _FACTORS[k]
    gram = _mix(gram)
    least, width = np.arange(n), 1  # place of the first least gram among `width` ones
    goal = WINDOW - GRAM + 1
    while width < goal:
        step = min(width, goal - width)
        a, b = least[:-step], least[step:]
        least, width = np.where(gram[a] <= gram[b], a, b), width + step
    real = doc[: len(least)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(real)
    place = least[at]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(at) != 1)])) if len(at) else at
    first = at[new]
    return doc[first], first, np.diff(np.append(new, len(at))), gram[place[new]].view(np.int64)


def _run_keys(words: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Hashes of the runs' words, whose hashes are given."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)]) if len(words) else np.zeros(1, np.uint64)
    size = windows + WINDOW - 1
    return _mix((sums[first + size] - sums[first]) * _powers(_INVERSE, len(words) + 1)[first] + size.astype(np.uint64)).view(np.int64)


def _lists(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """(row, field, ...) of all structs in a column of lists; null lists count as empty."""
    flat = column.flatten()
    rows = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    return rows, *(flat.field(n).to_numpy(zero_copy_only=False) for n in names)


def _look_up(rows: np.ndarray, keys: np.ndarray, in_rows: np.ndarray, in_keys: np.ndarray) -> np.ndarray:
    """The place of each (row, key) among the others, which are distinct, or -1."""
    if not len(in_keys):
        return np.full(len(keys), -1)
    known = np.unique(in_keys)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    pairs = in_rows * len(known) + np.searchsorted(known, in_keys)
    order = np.argsort(pairs)
    sought = rows * len(known) + at
    found = order[np.minimum(np.searchsorted(pairs, sought, sorter=order), len(order) - 1)]
    return np.where((known[at] == keys) & (pairs[found] == sought), found, -1)


def _repeated(doc: np.ndarray, words: np.ndarray, anchors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, anchor, hot) of the runs whose anchor is among the text's repeated
    ones (those and whether they are hot). Hot ones come window by window."""
    text, first, windows, anchor = _runs(doc, words)
    in_text, known, hot = _lists(anchors, "anchor", "hot")
    at = _look_up(text, anchor, in_text, known)
    text, first, windows, anchor, at = (x[at >= 0] for x in (text, first, windows, anchor, at))
    hot = hot[at].astype(bool)
    copies = np.where(hot, windows, 1)
    first = np.repeat(first, copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
    return np.repeat(text, copies), first, np.repeat(np.where(hot, 1, windows), copies), np.repeat(anchor, copies), np.repeat(hot, copies)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (anchor, doc_id)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            piece = batch.slice(at, 128)
            doc, _, _, anchor = _runs(*word_hashes(_bytes(piece.column(1))))
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])]) if len(doc) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), piece.column(0).take(pa.array(doc[new]))], names=["anchor", "doc_id"])


def _key(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, content, doc_id) of each repeated run; route is its anchor, or of a hot one its window's key."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            piece = batch.slice(at, 128)
            texts = _bytes(piece.column(1))
            doc, words = word_hashes(texts)
            text, first, windows, anchor, hot = _repeated(doc, words, piece.column(2))
            plain, place = [w for t in texts for w in t.split()], first.tolist()
            contents = [b" ".join(plain[a:b]) for a, b in zip(place, (first + windows + WINDOW - 1).tolist(), strict=True)]
            anchor = anchor.copy()
            for i in np.flatnonzero(hot).tolist():
                anchor[i] = _key(contents[i])
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(contents, pa.binary()), piece.column(0).take(pa.array(text, pa.int64()))], names=["route", "content", "doc_id"])


#: The bits below each place of a word.
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in a sequence: a packed bit vector a level, with counts of ones before each word."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        x = symbols
        for level in reversed(range(self.levels)):
            bit = (x >> level & 1).astype(bool)
            padded = np.zeros((len(x) // 64 + 1) * 64, np.uint8)
            padded[: len(x)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, ones, zeros in zip(reversed(range(self.levels)), self.bits, self.ones, self.zeros, strict=True):
            block = at >> 6
            below = words[block] & _BELOW[at & 63]
            one = ones[block] + np.bitwise_count(below)
            at = np.where(symbol >> level & 1, zeros + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first `at` ones."""
        return self._walk(symbol, at) - self.first[symbol]


def _pairs(a: np.ndarray, shift: int) -> np.ndarray:
    """Ranks of (a[i], a[i + shift]); beyond the end stands -1."""
    b = np.concatenate([a[shift:], np.full(min(shift, len(a)), -1)])
    return np.unique(a * (int(a.max()) + 2) + b + 1, return_inverse=True)[1]


class FmIndex:
    """Over word sequences, each of one document: finds the least document that has a window."""

    def __init__(self, sequences: list[list[bytes]], docs: np.ndarray):
        self.starts = np.cumsum([0, *(len(s) + 1 for s in sequences)])
        codes = pd.factorize(np.array([w for s in sequences for w in s], object))[0].astype(np.int64) + 1
        self.size = int(codes.max(initial=0)) + 1
        self.text = np.zeros(self.starts[-1], np.int64)  # 0 ends a sequence
        inside = np.ones(len(self.text), bool)
        inside[self.starts[1:] - 1] = False
        self.text[inside] = codes
        r, have = self.text, 1
        while 2 * have < WINDOW:
            r, have = _pairs(r, have), 2 * have
        parent, whole = _pairs(r, WINDOW - 1 - have), _pairs(r, WINDOW - have)
        order = np.argsort(whole, kind="stable")
        self.bwt = WaveletMatrix(self.text[order - 1], self.size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=self.size))])
        self.parent_start, self.parent_end = self._blocks(parent[order])
        start, _ = self._blocks(whole[order])
        owner = np.repeat(docs, np.diff(self.starts))[order]
        heads = np.flatnonzero(start == np.arange(len(start)))
        self.least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(owner))))

    @staticmethod
    def _blocks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the run of equal ranks at each place."""
        heads = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        ends = np.append(heads[1:], len(ranks))
        return np.repeat(heads, ends - heads), np.repeat(ends, ends - heads)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more word in front."""
        return self.smaller[symbol] + self.bwt.rank(symbol, low), self.smaller[symbol] + self.bwt.rank(symbol, high)

    def stream(self, first: np.ndarray, windows: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For each run (its place in text, its number of windows) and window: the least document that
        has it, or -1; as rows of max(windows) columns. text is in the index's symbols."""
        out = np.full((len(first), int(windows.max(initial=0))), -1, np.int64)
        low, high = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for back in range(out.shape[1]):
            lane = np.flatnonzero(windows > back)
            at = first[lane] + windows[lane] - 1 - back
            known = high[lane] > low[lane]
            old, fresh = lane[known], lane[~known]
            if len(old):
                low[old], high[old] = self.step(text[at[known]], self.parent_start[low[old]], self.parent_end[low[old]])
            if len(fresh):
                end = at[~known] + WINDOW - 1
                a, b = self.smaller[text[end]], self.smaller[text[end] + 1]
                for k in range(1, WINDOW):
                    a, b = self.step(text[end - k], a, b)
                low[fresh], high[fresh] = a, b
            hit = lane[high[lane] > low[lane]]
            out[hit, windows[hit] - 1 - back] = self.least[low[hit]]
        return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, run, earlier) of each distinct run: the first document that has it, and bits of its
    windows that stand in earlier documents too. Rows come sorted by shard."""

    def one(rows: list[tuple]) -> pa.RecordBatch:
        docs = np.array([r[2] for r in rows], np.int64)
        index = FmIndex([r[1].split(b" ") for r in rows], docs)
        windows = np.diff(index.starts) - WINDOW
        least = index.stream(index.starts[:-1], windows, index.text)
        bits = ((least >= 0) & (least < docs[:, None])) @ (1 << np.arange(least.shape[1]))
        words = word_hashes([r[1] for r in rows])[1]
        keys = _run_keys(words, np.cumsum(windows + WINDOW - 1) - (windows + WINDOW - 1), windows)
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys), pa.array(bits.astype(np.int64))], names=["doc_id", "run", "earlier"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][0] != row[0]:
                yield one(rows)
                rows = []
            rows.append(row)
    if rows:
        yield one(rows)


def _covered(texts: list[bytes], anchors: pa.ListArray, firsts: pa.ListArray) -> list[np.ndarray | None]:
    """For each text, which of its words a repeated window covers; None if no window can be."""
    some = pc.fill_null(pc.list_value_length(anchors), 0).to_pylist()
    doc, words = word_hashes([t if n else b"" for t, n in zip(texts, some, strict=True)])
    text, first, windows, _, _ = _repeated(doc, words, anchors)
    in_text, run, earlier = _lists(firsts, "run", "earlier")
    at = _look_up(text, _run_keys(words, first, windows), in_text, run)
    # a run that is not known to be first here has been in an earlier document
    bits = np.where(at >= 0, earlier[at], -1) if len(earlier) else np.full(len(at), -1)
    change = np.zeros(len(words) + 1, np.int64)
    for i in range(int(windows.max(initial=0))):
        gone = first[(windows > i) & (bits >> i & 1 == 1)] + i
        change += np.bincount(gone, minlength=len(change)) - np.bincount(gone + WINDOW, minlength=len(change))
    cover = np.cumsum(change)[:-1] > 0
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
    return [cover[a:b] if n else None for a, b, n in zip(bounds, bounds[1:], some, strict=False)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text): words [^\\x20\\x09-\\x0D]+ of whole texts without those in
    a window of WINDOW words that also starts in a document with a smaller doc_id.

    Windows are judged on the input. doc_id is an integer. A null text has no words and an empty
    kept text. Rows with a null doc_id lose nothing and take nothing away; rows of one doc_id are
    one document's and take nothing from each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    known = rows.where(F.col("doc_id").isNotNull())
    anchors = written(known.mapInArrow(_anchors, f"anchor long, doc_id {kind}"), "repeats-anchors")
    counted = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    shared = written(counted.select(F.col("anchor").alias("shared"), (F.col("n") >= HOT).alias("hot")), "repeats-shared")
    of_doc = (
        anchors.join(shared, F.col("anchor") == F.col("shared")).groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "hot")).alias("anchors"))
        .withColumnRenamed("doc_id", "id")
    )
    of_doc = written(of_doc, "repeats-of-doc")
    runs = known.join(of_doc, F.col("doc_id") == F.col("id")).select("doc_id", "text", "anchors").mapInArrow(_segments, f"route long, content binary, doc_id {kind}")
    distinct = written(runs.groupBy("route", "content").agg(F.min("doc_id").cast("long").alias("first")), "repeats-runs")
    words = distinct.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    shards = max(1, -(-words // (6 * SHARD_WORDS)))
    dealt = distinct.select(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"), "content", "first")
    found = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_search, "doc_id long, run long, earlier long")
    firsts = written(found.groupBy(F.col("doc_id").alias("first_id")).agg(F.collect_list(F.struct("run", "earlier")).alias("firsts")), "repeats-firsts")
    all_of = rows.join(of_doc, F.col("doc_id") == F.col("id"), "left").join(firsts, F.col("doc_id") == F.col("first_id"), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                texts = _bytes(piece.column(1))
                gone = _covered(texts, piece.column(2), piece.column(3))
                words = [t.split() for t in texts]
                removed = [0 if g is None else int(g.sum()) for g in gone]
                kept = [b" ".join(compress(w, (~g).tolist()) if n else w) for w, g, n in zip(words, gone, removed, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return all_of.select("doc_id", "text", "anchors", "firsts").mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    """Words kept of every document, as a digest; nulls, empty and repeated rows, ties and other columns as in remove_repeats."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS k FROM w, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
g AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM s JOIN f USING (k), unnest(range(0, 13)) AS t(j) WHERE first < doc_id GROUP BY doc_id),
r AS (SELECT w.doc_id, w, coalesce(gone, []) AS gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS keep FROM w LEFT JOIN g ON w.doc_id = g.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(array_to_string(list_transform(keep, lambda i: w[i]), ' ')) AS kept_sha256 FROM r
"""
