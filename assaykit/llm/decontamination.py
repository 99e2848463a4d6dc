"""Benchmark decontamination: a BM25 index of test items, queried with every training passage.

A passage's score for an item is its BM25 over the item's BM25 with itself: the share of the
item's weight whose words the passage has. All items at or above THETA are retrieved by
block-max WAND, a block of items at a time: a term's postings have its highest share in each
block; blocks where the sum of these over the passage's terms stays below THETA are skipped, for
all passages of a document at once, and in the others a pivot tells which items to score. Passages are half-overlapping windows at least as long as the longest
item, so one of them holds half of the weight of any item that stands in a text. Retrieved
items are verified by their word n-grams around the passage, for question and answer. An item
whose question has so little of its weight that a text with the question alone could stay below
THETA is also retrieved by the question's own weight.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from math import log
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, position, quoted, table, unused, with_arrow, without, written

THETA, GRAM, LEAST_PASSAGE = 0.35, 3, 64
#: Items in a block, and cells (terms x blocks) of the table of block maxima; beyond, blocks are larger.
BLOCK, MAX_CELLS = 4, 1 << 23
#: Shares of n-grams that verify an item: of question and answer both, or of the question alone.
BOTH, ALONE = 0.5, 0.8
#: Passages of a text that are looked up at once: their table of terms by blocks is what memory holds.
PASSAGES = 64
#: Bytes of items that one index may hold; more are split over several indexes, applied in turn.
MAX_INDEX_BYTES = 32 << 20
K1, B = 1.2, 0.75


#: All ASCII but letters and digits to space.
_WORDS = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of other characters, in UTF-8."""
    return (text or "").lower().encode().translate(_WORDS).split()


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct word n-grams; a shorter text is one gram, an empty one none."""
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def share(sought: set[tuple[bytes, ...]], near: set[tuple[bytes, ...]], around: list[bytes]) -> float:
    """Share of the grams sought that are near; a text shorter than a gram must stand in the words around."""
    if len(sought) == 1 and len(short := next(iter(sought))) < GRAM:
        return float(any(tuple(around[i : i + len(short)]) == short for i in range(len(around) - len(short) + 1)))
    return len(sought & near) / max(1, len(sought))


def question_answer(text: str | None, answer: str | None = None) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer; without an answer of its own, the last quarter of the text is it."""
    words = words_of(text)
    if answer is not None:
        return words, words_of(answer)
    n = len(words) - max(GRAM, len(words) // 4)
    return (words[:n], words[n:]) if n >= GRAM else (words, [])


_entry = itemgetter(0)


class Bm25Index:
    """items: (id, question words, answer words). Items without words are left out.

    overall, if these are a part of all items, has for all of them: how many, their mean length, the
    longest, and in how many items each word of the part is.
    """

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], overall: tuple[int, float, int, dict[bytes, int]] | None = None):
        items = [x for x in items if x[1] or x[2]]
        self.ids = [x[0] for x in items]
        self.question, self.answer = [grams(x[1]) for x in items], [grams(x[2]) for x in items]
        counts = [Counter(x[1] + x[2]) for x in items]
        lengths = [sum(c.values()) for c in counts]
        if overall is None:
            overall = len(items), sum(lengths) / max(1, len(lengths)), max(lengths, default=0), Counter(w for c in counts for w in c)
        n_items, mean, self.longest, df = overall
        idf = {w: log(1 + (n_items - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        self.item = list(range(len(items)))  # of each entry of the postings; questions alone come after the items
        for i, (c, n) in enumerate(zip(counts, lengths, strict=True)):
            weigh = lambda c: {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean)) for w, tf in c.items()}  # noqa: B023, E731
            own, alone = weigh(c), weigh(Counter(items[i][1]))
            total, of_question = sum(own.values()), sum(alone.values())
            for w, x in own.items():
                lists[w].append((i, x / total))
            if items[i][2] and 0 < of_question < 2 * THETA * total:  # a passage may hold only half of it
                for w, x in alone.items():
                    lists[w].append((len(self.item), x / of_question))
                self.item.append(i)
        self.term = {w: t for t, w in enumerate(lists)}
        self.block = max(BLOCK, -(-len(self.item) * len(lists) // MAX_CELLS))
        self.tops = np.zeros((len(lists), -(-len(self.item) // self.block)), np.float32)
        self.postings: list[dict[int, list[tuple[int, float]]]] = []
        for t, found in enumerate(lists.values()):
            by_block: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for i, x in found:
                by_block[i // self.block].append((i, x))
                self.tops[t, i // self.block] = max(self.tops[t, i // self.block], x)
            self.postings.append(dict(by_block))

    def search(self, terms: list[int], blocks: list[int], theta: float) -> list[tuple[int, float]]:
        """(entry, score) of the entries of these blocks with a score of theta or more.

        WAND in a block: cursors stand in order of their entries; the pivot is the first entry at which
        the highest shares of the cursors up to it reach theta. Entries before it are skipped, and
        it is scored if all of these cursors can stand on it.
        """
        out, eps = [], theta - 1e-6
        for b in blocks:
            cursors = [[p[0][0], float(self.tops[t, b]), 0, p] for t in terms if (p := self.postings[t].get(b))]
            while cursors:
                cursors.sort(key=_entry)
                total, pivot = 0.0, -1
                for c in cursors:
                    total += c[1]
                    if total >= eps - 1e-6:
                        pivot = c[0]
                        break
                if pivot < 0:
                    break
                score, on = 0.0, cursors[0][0] == pivot
                for c in cursors:
                    if c[0] > pivot:
                        break
                    if on:
                        score += c[3][c[2]][1]
                    k, p = c[2] + on, c[3]
                    while k < len(p) and p[k][0] < pivot:
                        k += 1
                    c[0], c[2] = (p[k][0] if k < len(p) else -1), k
                if on and score >= eps:
                    out.append((pivot, score))
                cursors = [c for c in cursors if c[0] >= 0]
        return out

    def retrieve(self, words: list[bytes], theta: float | None = None) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """(first word of a passage, its items): every passage that has some."""
        theta, half = THETA if theta is None else theta, self.half
        for start in range(0, max(1, len(words)), PASSAGES * half):
            # a piece has the part after its last passage's own too, which that passage needs
            yield from self._in_piece(words[start : start + (PASSAGES + 1) * half], start, theta)

    def _in_piece(self, words: list[bytes], start: int, theta: float) -> Iterator[tuple[int, list[tuple[int, float]]]]:
        """retrieve for the passages that begin in the first PASSAGES parts of words, which stand from start on in the text."""
        get, half = self.term.get, self.half
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        place = np.flatnonzero(ids >= 0)
        if not len(place):
            return
        n, part = len(self.tops), place // half
        both = np.concatenate([part, part[part > 0] - 1])  # passage k has parts k and k + 1
        cells = np.unique((both * n + np.concatenate([ids[place], ids[place][part > 0]]))[both < PASSAGES])
        if not len(cells):
            return
        passage, term = cells // n, cells % n
        starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
        bound = np.add.reduceat(self.tops[term], starts)
        ends = np.append(starts[1:], len(term))
        for k in np.flatnonzero(bound.max(1) >= theta - 1e-4):
            hits = self.search(term[starts[k] : ends[k]].tolist(), np.flatnonzero(bound[k] >= theta - 1e-4).tolist(), theta)
            if hits:
                yield start + int(passage[starts[k]]) * half, hits

    @property
    def half(self) -> int:
        return max(LEAST_PASSAGE, self.longest) // 2

    def matches(self, words: list[bytes]) -> dict[int, tuple[float, float, float]]:
        """item -> (score, question overlap, answer overlap) of verified items; the best passage of each counts."""
        found: dict[int, tuple[float, float, float]] = {}
        for first, hits in self.retrieve(words):
            around = words[max(0, first - self.half) : first + 3 * self.half]
            near = grams(around)
            for entry, score in hits:
                i = self.item[entry]
                q, x = self.question[i], self.answer[i]
                of_q, of_a = share(q, near, around), share(x, near, around)
                sure = of_q >= ALONE or (of_q >= BOTH or not q) and (of_a >= BOTH or not x)
                if sure and (i not in found or (of_q + of_a, score) > (sum(found[i][1:]), found[i][0])):
                    found[i] = (score, of_q, of_a)
        return found


_latest: dict[int, Bm25Index] = {}


def _index_of(number: int, items) -> Bm25Index:
    """The index of a broadcast list of items, which a worker process keeps from task to task until it gets another one."""
    if number not in _latest:
        _latest.clear()
        _latest[number] = Bm25Index(*items.value)
    return _latest[number]


MATCH = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """docs with the column name: the benchmark items (item_id, text, and answer, in any case, if there is one)
    that stand in each whole text, by item id. A column of that name is replaced.

    Null or empty texts match nothing, nor do items without words; an empty benchmark matches
    nothing. Items with the same id are looked for each. Items are gathered in indexes of at most
    MAX_INDEX_BYTES, which share the statistics of all items and are applied one after the other, each
    in a job of its own: one is in memory at a time.
    """
    bounded_batches(docs.sparkSession)
    answer = "answer" in {c.lower() for c in benchmark.columns}
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", *([F.col("answer").alias("answer")] if answer else [])).where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.sum(F.octet_length("text") + (F.coalesce(F.octet_length("answer"), F.lit(0)) if answer else F.lit(0)) + 32)).first()[0] or 0
    parts = max(1, -(-size // MAX_INDEX_BYTES))
    docs = without(docs, name)
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int"))
    overall = _statistics(items, answer) if parts > 1 else lambda k: None
    spark = docs.sparkSession

    def index(k: int):
        rows = items.where(F.col("part") == k).orderBy("item_id", "text").collect()
        return spark.sparkContext.broadcast(([(r.item_id, *question_answer(r.text, r.answer if answer else None)) for r in rows], overall(k)))

    if parts == 1:
        return _probe(docs, index(0), name)
    # an index at a time, in a job of its own: what it finds, by the text, is written, and its broadcast goes
    found = None
    for k in range(parts):
        part = index(k)
        of_part = _probe(docs.select("text").where(F.octet_length("text") > 0), part, "found").where(F.size("found") > 0)
        of_part = written(of_part.select(F.unhex(F.md5("text")).alias("digest"), "found").dropDuplicates(["digest"]), "items-found", keep=True)
        part.destroy()
        found = of_part if found is None else found.union(of_part)
    by_text = found.groupBy("digest").agg(F.flatten(F.collect_list("found")).alias("found"))
    digest, of, all_found = unused(docs, "digest"), unused(docs, "of_digest"), unused(docs, "all_found")
    by_text = written(by_text.toDF(of, all_found), "items-by-text", keep=True)
    joined = docs.withColumn(digest, F.unhex(F.md5("text"))).join(by_text, F.col(digest) == F.col(of), "left")
    by_item = lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    matches = F.coalesce(F.array_sort(all_found, by_item), F.array().cast(MATCH)).alias(name)
    return joined.select(*[F.col(quoted(c)) for c in docs.columns], matches)


def _statistics(items: DataFrame, answer: bool) -> Callable[[int], tuple[int, float, int, dict[bytes, int]]]:
    """part -> the statistics of all items that its index needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            words = [sum(question_answer(t, a), []) for t, a in zip(texts, answers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array([list(set(w)) for w in words], pa.list_(pa.binary()))], names=["part", "length", "words"])

    rows = items.select("part", "text", F.col("answer") if answer else F.lit(None).cast("string").alias("answer"))
    counted = written(rows.mapInArrow(run, "part int, length long, words array<binary>").where("length > 0"), "items-words")
    n, mean, longest = counted.agg(F.count("*"), F.avg("length"), F.max("length")).first()
    df = counted.select("part", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts"))
    df = written(df, "items-frequencies")
    return lambda k: (n, mean or 0.0, longest or 0, {bytes(r.word): r.n for r in df.where(F.array_contains("parts", k)).collect()})


def _probe(docs: DataFrame, items, name: str) -> DataFrame:
    """docs with the matches of one index."""
    number, text = items._jbroadcast.id(), position(docs, "text")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def probe(batch: pa.RecordBatch) -> list[pa.Array]:
        index, out = _index_of(number, items), []
        for t in batch.column(text).to_pylist():
            rows = [{"item_id": index.ids[j], "score": s, "question_overlap": q, "answer_overlap": a} for j, (s, q, a) in index.matches(words_of(t)).items()]
            out.append(sorted(rows, key=lambda r: (r["item_id"], -r["score"])))
        return [pa.array(out, kind)]

    return with_arrow(docs, probe, {name: MATCH})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item stands; their columns are as before. Rows with a null text
    or id stay, repeated rows are judged each, and an empty benchmark drops none."""
    name = unused(docs, "matches")
    return without(benchmark_matches(docs, benchmark, name).where(F.size(name) == 0), name)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document with the items that stand in it; null and empty texts have none (see benchmark_matches)."""
    found = benchmark_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    best = lambda k: F.array_max(F.transform("matches", lambda m: m[k]))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"),
        best("score").alias("score"), best("question_overlap").alias("question_overlap"), best("answer_overlap").alias("answer_overlap"),
    )
