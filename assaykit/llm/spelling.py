"""Spelling variants: words one edit apart, found by dense comparison of prefixes and suffixes in tiles.

Two words are near if one inserted, deleted or replaced code point makes one the other: exactly if
their common prefix and their common suffix together reach the longer length minus one. Words meet
in tiles, and in a tile code points stand in padded matrices, one aligned left and one right, of
which block pairs are compared at once.

Tiles are made by halving. Of two near words, let m be the shorter length; the edit stands in the first
half of these m places or behind it, so the words share either all that follows or all that precedes.
A word thus goes, as the shorter one and as the longer one (m one less), to the tile of its first half
and to that of its second half, and what is left to compare is the other half alone. A tile of more
than ``TILE`` words is halved again in the same way, within its task; one of more than ``HOT`` words
is halved by Spark, before any task holds it. When one place is left, a tile has at most as many
words as the alphabet has letters (and its square for the longer ones), so no tile is cut off.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, intermediates, table, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points and occurrences that a word has at least.
LENGTH, TIMES = 5, 3
#: Every run whose hash this divides loses a code point.
DAMAGE = 97
#: Members of a tile that are compared as one block pair; of a tile that one task holds.
TILE, HOT = 96, 50_000
#: Code points in one comparison of pairs.
CELLS = 1 << 21

_PLACES = ("m", "lo", "hi", "head", "tail")


def damaged_words(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters with A-Z lower-cased and every DAMAGE-th (by a hash) short of one letter, counted."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc_id.alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(h % DAMAGE != 0, F.col("run")).otherwise(short)
    return low.select(word.alias("word")).where(F.char_length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TIMES)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row (m, lo, hi, longer, word, n), of a word that shares all but lo <= place < hi (a longer one has a
    place more there) with its tile, in the tiles of both halves of these places."""
    k = F.expr("cast(lo + (hi - lo) div 2 as int)")
    both = F.explode(F.array(F.struct(k.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), k.alias("hi")))).alias("of")
    end = F.col("hi") + F.col("longer").cast("int")
    return rows.select("m", both, "longer", "word", "n").select("m", "of.*", "longer", "word", "n").select(
        "m", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")).alias("head"), F.substring("word", end + 1, F.char_length("word")).alias("tail"), "longer", "word", "n"
    )


def _tiles(words: DataFrame) -> DataFrame:
    """open, members (part, longer, word, n): tiles of at most HOT words (more if one place is left), in which
    part is what is left to compare. open: an added letter may stand at the very end of part."""
    both = words.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("m", F.char_length("word") - F.col("longer").cast("int"))
    rows, done = _halves(both.where(F.col("m") >= LENGTH).withColumn("lo", F.lit(0)).withColumn("hi", F.col("m"))), None
    while True:
        rows = written(rows, "spelling-tiles")
        sizes = rows.groupBy(*_PLACES).agg(F.count("*").alias("members"))
        hot = written(sizes.where((F.col("members") > HOT) & (F.col("hi") - F.col("lo") > 1)).select(*[F.col(c).alias(f"hot_{c}") for c in _PLACES]), "spelling-hot")
        if hot.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            break
        match = [F.col(c) == F.col(f"hot_{c}") for c in _PLACES]
        cool = rows.join(hot, match, "left_anti")
        done = cool if done is None else done.unionByName(cool)
        rows = _halves(rows.join(hot, match, "left_semi"))
    part = F.substring("word", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("longer").cast("int"))
    member = F.struct(part.alias("part"), "longer", "word", "n")
    tiles = done.groupBy(*_PLACES).agg(F.collect_list(member).alias("members"))
    # a pair needs two words, one of them of the shorter length
    return tiles.where((F.size("members") > 1) & F.exists("members", lambda x: ~x["longer"])).select((F.col("hi") == F.col("m")).alias("open"), "members")


def _small(tile: list[int], parts: list[str], longer: list[bool], open_end: bool) -> Iterator[tuple[list[int], list[str], bool]]:
    """The tile (places of its members) and their parts, halved until TILE members are left, or one place."""
    size = min(len(p) - x for p, x in zip(parts, longer, strict=True))
    if len(tile) <= TILE or size < 2:
        yield tile, parts, open_end
        return
    k = size // 2
    heads, tails = defaultdict(list), defaultdict(list)
    for i, (p, x) in enumerate(zip(parts, longer, strict=True)):
        heads[p[:k]].append(i)
        tails[p[k + x :]].append(i)
    for groups, first in ((heads, False), (tails, True)):
        for own in groups.values():
            some = [longer[i] for i in own]
            if len(own) > 1 and not all(some):
                left = [parts[i][: k + longer[i]] if first else parts[i][k:] for i in own]
                yield from _small([tile[i] for i in own], left, some, open_end and not first)


def near_pairs(parts: list[str], longer: np.ndarray, tile: np.ndarray, open_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): pairs of members of one tile that are one edit apart; a is never the longer one. All parts have the
    same number of places (longer ones one more), members of a tile stand together, longer ones last."""
    size = min(len(p) - x for p, x in zip(parts, longer.tolist(), strict=True))
    lengths = size + longer.astype(np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    left, right = np.zeros((len(parts), size + 1), np.uint32), np.zeros((len(parts), size + 1), np.uint32)
    place = np.arange(size + 1)
    left[place < lengths[:, None]] = points
    right[place > size - lengths[:, None]] = points
    left, right = left[:, :size], right[:, :0:-1]  # both from the end that they are compared from
    after = np.searchsorted(tile, tile, "right") - np.arange(len(tile)) - 1  # members to compare with
    after[longer] = 0
    step = max(1, CELLS // max(1, size))
    ends = np.cumsum(after)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, step):
        pair = np.arange(begin, min(begin + step, int(ends[-1])))
        a = np.searchsorted(ends, pair, "right")
        b = a + 1 + pair - (ends[a] - after[a])
        prefix, suffix = (np.where(same.all(1), size, same.argmin(1)) for same in (left[a] == left[b], right[a] == right[b]))
        near = prefix + suffix >= size - 1 + longer[b]
        near &= (prefix < size) | (longer[b] & open_end[a])  # else the pair stands in the tile of the other half too
        yield a[near], b[near]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n: both ways of every pair."""
    names = ["word", "near", "near_n"]
    for batch in batches:
        members = batch.column(1).flatten()
        part, word, n = (members.field(k) for k in ("part", "word", "n"))
        parts, longer = part.to_pylist(), members.field("longer").to_pylist()
        by_size = defaultdict(lambda: ([], [], [], []))  # places, parts, tiles, whether open
        begin = tiles = 0
        for count, open_end in zip(pc.list_value_length(batch.column(1)).to_pylist(), batch.column(0).to_pylist(), strict=True):
            own = list(range(begin, begin + count))
            begin += count
            for at, left, opened in _small(own, [parts[i] for i in own], [longer[i] for i in own], open_end):
                order = sorted(range(len(at)), key=lambda i: longer[at[i]])
                size = len(left[order[0]]) - longer[at[order[0]]]
                held = by_size[size]
                held[0].extend(at[i] for i in order)
                held[1].extend(left[i] for i in order)
                held[2].extend([tiles] * len(at))
                held[3].extend([opened] * len(at))
                tiles += 1
        for at, left, tile, opened in by_size.values():
            at = np.array(at)
            for a, b in near_pairs(left, np.array(longer)[at], np.array(tile), np.array(opened)):
                x, y = pa.array(np.concatenate([at[a], at[b]])), pa.array(np.concatenate([at[b], at[a]]))
                yield pa.RecordBatch.from_arrays([word.take(x), word.take(y), n.take(y)], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: for every word (word, n) of at least LENGTH code points each of the other words that one
    inserted, deleted or replaced code point makes of it, with its n. words are distinct; nulls pair with nothing."""
    bounded_batches(words.sparkSession)
    return _tiles(words.where(F.col("word").isNotNull())).mapInArrow(_near, "word string, near string, near_n long")


def with_forms(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words (word, n); see spelling_variants."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    per_word = near_words(words).groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    ok = -F.col("best.less") >= 2 * F.col("n")
    form, form_n = F.when(ok, F.col("best.form")), F.when(ok, -F.col("best.less"))
    named = words.join(per_word, F.col("word") == F.col("of"), "left")
    named = written(named.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n")), "spelling-forms", keep=True)
    ways = written(named.where("form is not null").select("word", F.col("form").alias("up")), "spelling-roots")
    while True:  # n at least doubles at every form, so ways are short, and each round halves them
        after = ways.select(F.col("word").alias("mid"), F.col("up").alias("top"))
        longer = written(ways.join(after, F.col("up") == F.col("mid"), "left").select("word", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "spelling-roots", keep=True)
        ways = longer.select("word", "up")
        if longer.where("moved").isEmpty():
            break
    ways = ways.select(F.col("word").alias("of"), "up")
    return named.join(ways, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("up", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of all texts (damaged_words).

    form is the near word of largest n (of equal ones the first in code-point order) if its n is at least twice
    the word's, else null; root is where forms lead to, the word itself if it has none; n_near counts the
    near words. Null and empty texts have no words, a null doc_id counts as empty in the hash that damages words, rows of one id
    are all counted, other columns are not read; an empty table gives no rows.
    """
    with intermediates(docs.sparkSession):
        return with_forms(written(damaged_words(docs), "spelling-words", keep=True))


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    """Every word of the whole documents with its form and root (see spelling_variants)."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: The same in DuckDB; near words are found by the places that can be deleted from both.
OP11_SQL = """
WITH RECURSIVE bits AS (
    SELECT t.i, list_reduce(list_prepend(t.i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(i)
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, length(h) // 2 + 1), lambda k: ('0x' || h[2 * k - 1:2 * k])::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
    FROM (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs), crc
), words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), holes AS (  -- a word with each of its places deleted: near words share one
    SELECT word, n, word AS hole, 0 AS place FROM words
    UNION ALL SELECT word, n, word[:k - 1] || word[k + 1:], k FROM words, unnest(range(1, length(word) + 1)) u(k)
), near AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b USING (hole)
    WHERE a.word <> b.word AND (length(a.word) <> length(b.word) AND (a.place = 0 OR b.place = 0) OR a.place > 0 AND a.place = b.place)
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS top_n, arg_min(other, (-other_n, other)) AS top FROM near GROUP BY word
), formed AS (
    SELECT w.word, CASE WHEN top_n >= 2 * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * n THEN top_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
), ways AS (
    SELECT word, word AS up FROM formed UNION ALL SELECT ways.word, form FROM ways JOIN formed f ON f.word = up WHERE form IS NOT NULL
)
SELECT f.word, f.form, up AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN ways ON ways.word = f.word JOIN formed g ON g.word = up WHERE g.form IS NULL
"""
