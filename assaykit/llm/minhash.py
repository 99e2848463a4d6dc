"""Near-duplicates by BagMinHash: signatures whose agreement is the weighted Jaccard similarity.

A document is a multiset of word 5-grams. Every shingle has Poisson processes over the dyadic
intervals (0,1], (1,2], (2,4], ... of its weight, with a rate of one a unit; a point has a time, a
component of the signature and a discrete weight level, and counts if the level is below the
shingle's weight. A component is the least time among its points, so two documents agree in it
with the probability sum(min) / sum(max). Points are made in order of time only until no
component can fall any more.

Classes: exact copies are one representative, which gets a number of its own. Representatives that
agree in a band share a bucket; each is compared with the first one of all its buckets, then with
one of another class, and links that are verified on the multisets give classes. What is left are
pairs of different classes in one bucket: all of these are compared, block by block, on short sketches.
The texts of members with a near pair in a block are then fetched and the pairs verified there.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, bounded_batches, intermediates, quoted, table, unused, written

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of the signature and components in each: at a similarity of 0.8, 99.994 % of pairs share a bucket.
BANDS, ROWS = 32, 6
M = BANDS * ROWS
#: Share of the sketch's bytes (of M) at which a pair is verified: five standard deviations below THRESHOLD.
NEAR = 0.65
#: Members of a bucket in one block of comparisons.
CHUNK = 256
#: Nodes of the components that a task joins at once.
FOREST = 100_000
#: Pairs that one copy of a representative's sketch or text is joined with; of more it is dealt out in copies.
PART = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word of the texts, in order."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(first, starts, "right") - 1, words


def shingle_weights(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles. A text of fewer words has one, of all its words."""
    doc, words = word_hashes(texts)
    if not len(words):
        return doc, words, np.zeros(0, np.int64)
    n, total = len(words), np.zeros(len(words), np.uint64)
    last = np.searchsorted(doc, doc, "right")  # end of each word's text
    for k in range(SHINGLE):
        at = np.arange(n) + k
        ok = at < last
        total[ok] += words[at[ok]] * _FACTORS[k] + np.uint64(k + 1)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    real = (np.arange(n) + SHINGLE <= last) | (first & (last - np.arange(n) < SHINGLE))
    doc, total = doc[real], _mix(total[real])
    _, at, weight = np.unique(_mix(total + doc.astype(np.uint64) * np.uint64(_BASE)), return_index=True, return_counts=True)
    return doc[at], total[at], weight


def signatures(texts: list[bytes]) -> np.ndarray:
    """BagMinHash signatures (texts x M) as times; those of a text without words are infinite."""
    doc, shingle, weight = shingle_weights(texts)
    h = np.full(len(texts) * M, np.inf)
    low, lanes = 0, []
    while len(doc):  # a lane for every dyadic interval that begins below the weight
        width = max(1, low)
        lanes.append((doc, _mix(shingle + np.uint64((low * 2 + 1) * _BASE % (1 << 64))), weight, np.full(len(doc), low), np.full(len(doc), width)))
        low = low + width
        more = weight > low
        doc, shingle, weight = doc[more], shingle[more], weight[more]
    if not lanes:
        return h.reshape(-1, M)
    doc, seed, weight, low, width = map(np.concatenate, zip(*lanes, strict=True))
    time, made = np.zeros(len(doc)), 0
    while len(doc):
        k = max(1, 8192 // len(doc))
        x = _mix(seed[:, None] + np.arange(made + 1, made + k + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        y = _mix(x ^ np.uint64(0xA0761D6478BD642F))
        t = time[:, None] + np.cumsum(-np.log1p(-(x >> np.uint64(11)).astype(float) * 2.0**-53) / width[:, None], axis=1)
        component = ((y >> np.uint64(32)) * np.uint64(M)) >> np.uint64(32)
        level = low[:, None] + (((y & np.uint64(0xFFFFFFFF)) * width[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = level < weight[:, None]
        np.minimum.at(h, (doc[:, None] * M + component.astype(np.int64))[counts], t[counts])
        made += k
        time = t[:, -1]
        alive = time < h.reshape(-1, M).max(1)[doc]
        doc, seed, weight, low, width, time = doc[alive], seed[alive], weight[alive], low[alive], width[alive], time[alive]
    return h.reshape(-1, M)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    band = np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            piece = batch.slice(at, 128)
            texts = [(t or "").encode() for t in piece.column(1).to_pylist()]
            bits = _mix(signatures(texts).view(np.uint64))
            keys = np.broadcast_to(band, (len(texts), BANDS)).copy()
            for k in range(ROWS):
                keys = _mix(keys * np.uint64(_INVERSE) + bits[:, k::ROWS])
            sketch = (bits >> np.uint64(56)).astype(np.uint8)
            rows = keys.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([md5(t).digest() for t in texts], pa.binary()), lists, pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["doc_id", "digest", "keys", "sketch"],
            )


def shingles_of(text: str | None) -> Counter:
    words = WORD_RE.findall(text or "")
    return Counter(tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets; of two empty ones 1."""
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - common
    return common / total if total else 1.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: OrderedDict[int, Counter] = OrderedDict()

    def bag(i: int, text: str) -> Counter:
        if i not in kept:
            kept[i] = shingles_of(text)
            if len(kept) > 16:
                kept.popitem(last=False)
        kept.move_to_end(i)
        return kept[i]

    for batch in batches:
        rows = [(a, b) for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if similarity(bag(a, s), bag(b, t)) >= THRESHOLD]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], batch.schema.field(0).type) for k in (0, 1)], names=["a", "b"])


def _hot(pairs: DataFrame, side: str) -> DataFrame:
    """Representatives of more than PART of the pairs on this side, and the copies of each: one for every PART pairs."""
    hot = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > PART)
    return written(hot.select(F.col(side).alias("hot"), F.ceil(F.col("n") / PART).cast("int").alias("parts")), "near-hot")


def _with(pairs: DataFrame, side: str, values: DataFrame, name: str, hot: DataFrame) -> DataFrame:
    """pairs with the column name of values (rep, name) for the representative on this side.

    Representatives of very many pairs are dealt out: their values are copied, as often as hot (of _hot, of
    these pairs or of more) says.
    """
    parts = F.coalesce("parts", F.lit(1))
    salt = F.pmod(F.xxhash64("a", "b"), parts.cast("long")).cast("int")
    dealt = pairs.join(hot, F.col(side) == F.col("hot"), "left").withColumn("part", salt).drop("hot", "parts")
    copies = values.join(hot, F.col("rep") == F.col("hot"), "left").select("rep", name, F.explode(F.sequence(F.lit(0), parts - 1)).alias("copy"))
    return dealt.join(copies, (F.col(side) == F.col("rep")) & (F.col("part") == F.col("copy"))).drop("part", "rep", "copy")


def _digest(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _texts(ids: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and text of the representatives in ids (rep), as a written table."""
    sought = written(ids.distinct().join(reps.select("rep", "digest", "first_id", "n_rows"), "rep"), "near-sought")
    # ids alone are few bytes, so more of them can be broadcast; texts that are not sought stay where they are
    rows = docs.select("doc_id", "text").join(sought.select("first_id"), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").withColumn("of", _digest())
    found = rows.join(sought, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = found.where("n_rows = 1").select("rep", "text")
    if not sought.where("n_rows > 1").isEmpty():  # rows of one id and text
        texts = texts.union(found.where("n_rows > 1").groupBy("rep").agg(F.first("text").alias("text")))
    return written(texts, "near-texts")


def _verified(pairs: DataFrame, hot: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of representatives, a written table with one pair for each b, whose texts are
    similar enough, as another. hot has the a of very many pairs (see _hot)."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("rep")), docs, reps)
    both = pairs.join(texts, F.col("b") == F.col("rep")).select("a", "b", F.col("text").alias("text_b"))
    both = _with(both, "a", texts, "text", hot).select("a", "b", "text", "text_b")
    return written(both.mapInArrow(_verify, "a long, b long"), "near-links")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) to the least b from all others that the edges of one task bring together, FOREST nodes at a time."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def out() -> pa.RecordBatch:
        rows = [(x, r) for x in list(up) if (r := root(x)) != x]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        if len(up) > FOREST:
            yield out()
    yield out()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each a of the edges (a, b) has one b, and no b is an a: then the components are known."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    per_node = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return per_node.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, root): every linked id and the least id of its component. Each task joins what its own links
    bring together; rounds of large and small stars join the rest, until all is stars."""
    # a > b in all edges
    edges = written(links.select("a", "b").mapInArrow(_forests, "a long, b long").distinct(), "stars")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = written(edges.join(written(least, "stars"), F.col("b") == F.col("u")).select("a", F.col("m").alias("b")), "stars")
        low = written(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "stars")
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        edges = written(small.where("a <> b").distinct(), "stars")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


class _Bags:
    """Shingle multisets of texts by position, the latest ones kept up to a number of shingles."""

    def __init__(self, texts: list[str], most: int = 300_000):
        self.texts, self.most, self.size = texts, most, 0
        self.kept: OrderedDict[int, Counter] = OrderedDict()

    def __getitem__(self, i: int) -> Counter:
        if i not in self.kept:
            self.kept[i] = shingles_of(self.texts[i])
            self.size += len(self.kept[i])
            while self.size > self.most and len(self.kept) > 2:
                self.size -= len(self.kept.popitem(last=False)[1])
        self.kept.move_to_end(i)
        return self.kept[i]


def _near(group: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
    """(member, later members near it): pairs of members (key, i, j, part, rep, class, sketch, keys) of
    different classes in one block of a bucket, each in the first bucket that the two share alone."""
    key, i, j = group[0][:3]
    sketch = np.frombuffer(b"".join(r[6] for r in group), np.uint8).reshape(len(group), M)
    keys = np.array([r[7] for r in group], np.int64)
    label, part = (np.array([r[k] for r in group]) for k in (5, 3))
    for k in range(len(group) - 1):
        ok = label[k + 1 :] != label[k]
        if i != j:
            ok &= part[k + 1 :] != part[k]
        near = np.flatnonzero(ok) + k + 1
        near = near[(sketch[near] == sketch[k]).mean(1) >= NEAR] if len(near) else near
        near = near[keys[k][(keys[near] == keys[k]).argmax(1)] == key] if len(near) else near
        if len(near):
            yield k, near


def _members(group: list[tuple]) -> list[tuple]:
    """key, i, j, part, rep, class of the members that are near another one."""
    found = {x for k, near in _near(group) for x in (k, *near.tolist())}
    return [group[x][:6] for x in sorted(found)]


def _links(group: list[tuple]) -> list[tuple]:
    """Verified links (a, b) of the members' classes within the block; group has their texts too.
    Classes that a link has joined are one from then on: more links between them would say nothing new."""
    bags, joined, out = _Bags([r[8] for r in group]), {}, []

    def root(label: int) -> int:
        while label in joined:
            label = joined[label]
        return label

    for k, near in _near(group):
        for x in near.tolist():
            s, t = root(group[k][5]), root(group[x][5])
            if s != t and similarity(bags[k], bags[x]) >= THRESHOLD:
                joined[max(s, t)] = min(s, t)
                out.append((min(s, t), max(s, t)))
    return out


def _by_block(work: Callable[[list[tuple]], list[tuple]], names: list[str]) -> Callable:
    """Applies work to the rows of each (key, i, j), which come sorted by these."""
    kinds = [pa.int32() if n in ("i", "j", "part") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def out() -> pa.RecordBatch:
            rows = work(group)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield out()
                    group = []
                group.append(row)
        if group:
            yield out()

    return run


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = batch.columns
        x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, M) for s in (sa, sb))
        ok = pa.array((x == y).mean(1) >= NEAR)
        yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], names=["a", "b"])


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id and digest of every row; digest, first_id (the least doc_id of the text),
    class_id and class_key of every distinct text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {kind}, digest binary, keys array<long>, sketch binary"), "near-signed", keep=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("first_id"), F.col("n").alias("n_rows"))
    firsts = signed.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).groupBy(F.col("digest").alias("of")).agg(F.min(order).alias("first"))
    # numbers go up with the ids, so the first of a bucket, which others are compared with, is often their original;
    # they are fixed once they are written
    numbered = written(firsts.orderBy("first.none", "first.first_id", "of").withColumn("rep", F.monotonically_increasing_id()), "near-numbered")
    reps = signed.groupBy("digest").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch")).join(numbered, F.col("digest") == F.col("of"))
    reps = written(reps.select("rep", "digest", "first.first_id", "first.n_rows", "keys", "sketch"), "near-reps")
    bands = reps.select("rep", F.explode("keys").alias("key"))
    shared = written(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("center")).where("n > 1").withColumnRenamed("key", "shared_key"), "near-buckets")
    members = written(bands.join(shared, F.col("key") == F.col("shared_key")).select("key", "rep", "center"), "near-members")
    sketches = reps.select("rep", "sketch")

    def linked(stars: DataFrame) -> DataFrame:
        """Verified links among one pair (a, b) for each b."""
        stars = written(stars.select("a", "b"), "near-stars")
        hot = _hot(stars, "a")
        half = stars.join(sketches, F.col("b") == F.col("rep")).select("a", "b", F.col("sketch").alias("sb"))
        near = _with(half, "a", sketches, "sketch", hot).select("a", "b", "sketch", "sb").mapInArrow(_near_pairs, "a long, b long")
        near = written(near, "near-pairs")
        return near if near.isEmpty() else _verified(near, hot, docs, reps)

    def name_classes(roots: DataFrame) -> DataFrame:
        named = members.join(roots, members["rep"] == roots["id"], "left").select("key", "rep", F.coalesce("root", "rep").alias("class"))
        return written(named, "near-named")

    # one link for each representative: to the first of all its buckets, then to one of another class
    roots = components(linked(members.where("rep <> center").groupBy(F.col("rep").alias("b")).agg(F.min("center").alias("a"))))
    named = name_classes(roots)

    def joined(more: DataFrame) -> bool:
        """Whether there are more links, which are then in roots and named."""
        nonlocal roots, named
        if more.isEmpty():
            return False
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more))
        return True

    leads = named.groupBy("key").agg(F.min(F.struct("class", "rep")).alias("lead"), F.max("class").alias("last")).where("lead.class <> last")
    leads = written(leads.select(F.col("key").alias("lead_key"), "lead"), "near-leads")
    if not leads.isEmpty():
        other = named.join(leads, F.col("key") == F.col("lead_key")).where("class <> lead.class")
        if joined(linked(other.groupBy(F.col("rep").alias("b")).agg(F.min("lead.rep").alias("a")))):
            named = name_classes(roots)
        mixed = named.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y")
        mixed = written(mixed.select(F.col("key").alias("mixed_key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("parts")), "near-mixed")
        met = named.join(mixed, named["key"] == mixed["mixed_key"]).select("key", F.col("rep").alias("met"), "class", "parts")
        sketched = reps.select("rep", "sketch", "keys")
        blocks = (
            met.join(sketched, F.col("met") == F.col("rep"))
            .withColumn("part", F.pmod(F.hash("rep"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "class", "sketch", "keys")
        )
        dealt = lambda blocks: blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        near = dealt(blocks).mapInArrow(_by_block(_members, ["key", "i", "j", "part", "rep", "class"]), "key long, i int, j int, part int, rep long, class long")
        near = written(near, "near-blocks")
        whole = _texts(near.select("rep"), docs, reps).join(sketched, "rep").withColumnRenamed("rep", "text_of")
        texts = near.join(whole, F.col("rep") == F.col("text_of")).select("key", "i", "j", "part", "rep", "class", "sketch", "keys", "text")
        of_classes = components(written(dealt(texts).mapInArrow(_by_block(_links, ["a", "b"]), "a long, b long"), "near-links"))
        above = of_classes.select(F.col("id").alias("below"), F.col("root").alias("above"))
        roots = roots.join(above, F.col("root") == F.col("below"), "left").select("id", F.coalesce("above", "root").alias("root")).union(of_classes)
        roots = written(roots, "near-roots")
    grown = roots.select("id", "root").union(roots.select("root", "root")).distinct()
    inside = grown.join(reps.select("rep", "digest", "first_id"), F.col("id") == F.col("rep"))
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("class_id"), F.col("digest").alias("class_key"))
    names = written(inside.groupBy("root").agg(F.min(order).alias("name")).withColumnRenamed("root", "name_of"), "near-names")
    of_rep = written(inside.join(names, F.col("root") == F.col("name_of")).select(F.col("id").alias("grown"), "name"), "near-grown")
    own = F.coalesce("name", order)
    classes = reps.select("rep", "digest", "first_id").join(of_rep, F.col("rep") == F.col("grown"), "left").select("digest", "first_id", own["class_id"].alias("class_id"), own["class_key"].alias("class_key"))
    return signed.select("doc_id", "digest"), written(classes, "near-classes", keep=True)


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the document's class of copies and near copies), class_key.

    Equal texts are one class (null counts as empty), as are all texts without words. Different texts are linked at a weighted
    Jaccard similarity of THRESHOLD or more of their word 5-grams, split at ASCII white space
    and otherwise unchanged; classes are closed under links. Repeated rows come back as often;
    a null doc_id names its class only if the class has no other id. class_key, the MD5 of the class's
    first text (by id, then by MD5), tells classes apart where ids repeat with different texts and
    two classes have the same least id. Other columns are not read; an empty table gives no rows.
    """
    with intermediates(docs.sparkSession):
        signed, classes = _classes(docs)
    classes = classes.select(F.col("digest").alias("of"), "class_id", F.lower(F.hex("class_key")).alias("class_key"))
    return signed.join(classes, F.col("digest") == F.col("of")).select("doc_id", "class_id", "class_key")


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each class the document with the least doc_id (nulls last; of several texts of one id that of the
    least MD5), with its columns. Of rows with this id and text the one whose content comes first as JSON."""
    with intermediates(docs.sparkSession):
        signed, classes = _classes(docs)
        firsts = classes.where("digest = class_key").select(F.col("digest").alias("of"), "first_id")
        same = (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
        kept = written(signed.join(firsts, same).groupBy("of", "first_id").agg(F.count("*").alias("n_rows")), "near-kept", keep=True)
        repeated = not kept.where("n_rows > 1").isEmpty()
    digest, of, first_id, n = (unused(docs, c) for c in ("digest", "of", "first_id", "n_rows"))
    kept = kept.toDF(of, first_id, n)
    rows = docs.withColumn(digest, _digest()).join(kept, (F.col(digest) == F.col(of)) & docs["doc_id"].eqNullSafe(kept[first_id]))
    own = [F.col(quoted(c)) for c in docs.columns]
    once = rows.where(F.col(n) == 1).select(*own)
    if not repeated:
        return once
    row = F.struct(*own)
    return once.union(rows.where(F.col(n) > 1).groupBy(of, first_id).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*"))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its class; null texts count as empty, null ids keep their rows (see near_classes)."""
    return near_classes(table(spark, sf_dir, "documents"))
