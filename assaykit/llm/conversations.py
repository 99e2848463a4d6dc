"""The trie of conversation prefixes, by union-find over the edges between sorted neighbours.

Conversations are sorted by the digests of their turns, equal ones collapsed. Of two neighbours in this
order the length of the common prefix (LCP) is an edge. Edges are taken in descending depth: the
components that the edges of one depth bring together become children of one branching node. Only
these nodes and conversations' ends are made in this way; turns between them are written out in the end.

Every task does this for a stretch of the order. At a stretch's ends, what lies beyond is unknown but
for the LCP across the boundary, and a component that touches it cannot grow at lower depths than this; nor can
one beside such a component at lower depths than the edge between them. What is left of a
stretch, at most one contracted component for each depth along its two rims, is merged with what is
left of others in the next round, until one stretch holds all.

A conversation's order is fixed by its turns up to the first that no other conversation has at
its depth, so a long conversation of its own is never gathered; turns are numbered in dealt ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, intermediates, table, written

#: Conversations of one hundred share a beginning of fewer turns than this.
HUNDRED, SHARED = 100, 6
#: Contracted components in a stretch of the first round; it is four times as many in every later one.
STRETCH = 100_000
#: Turns that one row is written out to in one step.
STEP = 4096
DIGEST = 32

_ITEM = ("pos", "lcp", "lcp_chars", "id", "depth", "chars", "n", "first", "kids", "leaves", "saved")
_NODE = ("id", "parent", "above", "depth", "chars", "n", "first", "kids", "leaves", "saved")


def _own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), digest, size, sum (of sizes so far), as a written table.

    Dealt out in ranges of conversation and turn; numbers and sums of the ranges before are added,
    so a conversation of any length is many tasks."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    dealt = written(narrow.repartitionByRange("conv_id", "turn", "digest").withColumn("part", F.spark_partition_id()), "trie-dealt")
    per_part = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("rows"), F.sum("size").alias("total"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = per_part.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.sum("rows").over(earlier).alias("rows"), F.sum("total").over(earlier).alias("total"))
    before = written(before.where("rows is not null"), "trie-before")  # fewer than there are ranges
    order = W.partitionBy("conv_id", "part").orderBy("turn", "digest")
    here = dealt.withColumn("rank", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = here.join(before, (F.col("conv_id") == F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    rank, so_far = (F.col(c) + F.coalesce(b, F.lit(0)) for c, b in (("rank", "rows"), ("sum", "total")))
    return written(found.select("conv_id", rank.cast("long").alias("rank"), "digest", "size", so_far.alias("sum")), "trie-own")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: conv_id, depth, digest, size, sum of the rebuilt conversations' turns; conv_id, length, total of each."""
    own = _own_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    at_h = F.sum(F.when(F.col("rank") <= h, F.col("size")).otherwise(0))
    each = own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("size").alias("sizes"), at_h.alias("own_head")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    starts = written(own.where((F.col("rank") < SHARED) & (F.col("conv_id") % HUNDRED == 0)).select(F.col("conv_id").alias("of"), F.col("rank").alias("depth"), "digest", "size", "sum"), "trie-starts")
    per_base = starts.groupBy("of").agg(F.array_sort(F.collect_list("sum")).alias("sums"))
    each = each.join(per_base, F.col("base") == F.col("of"), "left").withColumn("head", F.least("h", F.greatest(F.size("sums"), F.lit(0))).cast("int"))
    shift = F.when(F.col("head") > 0, F.element_at("sums", F.greatest("head", F.lit(1)))).otherwise(0) - F.col("own_head")
    rest = F.greatest(F.col("turns") - F.col("h"), F.lit(0))
    each = written(each.select("conv_id", "base", "h", "head", shift.alias("shift"), (F.col("head") + rest).cast("long").alias("length"), (F.col("sizes") + shift).cast("long").alias("total")), "trie-each")
    heads = each.join(starts, (F.col("base") == F.col("of")) & (F.col("depth") <= F.col("h"))).select("conv_id", "depth", "digest", "size", "sum")
    tails = own.where(F.col("rank") > h).join(each.select(F.col("conv_id").alias("of"), "h", "head", "shift"), F.col("conv_id") == F.col("of"))
    tails = tails.select("conv_id", (F.col("rank") - F.col("h") + F.col("head")).alias("depth"), "digest", "size", (F.col("sum") + F.col("shift")).alias("sum"))
    return written(heads.unionByName(tails), "trie-turns", keep=True), each.select("conv_id", "length", "total")


def _sequences(turns: DataFrame, each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: conv_id and name of its sequence; key (digests that fix the order), sums at these, and length,
    total, n, first, name of each distinct sequence, the empty one always among them."""
    alone = turns.groupBy("depth", "digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("of")).where("n = 1").groupBy("of").agg(F.min("depth").alias("own_from"))
    shared = turns.join(alone, F.col("conv_id") == F.col("of"), "left").where(F.col("own_from").isNull() | (F.col("depth") <= F.col("own_from")))
    gathered = shared.groupBy(F.col("conv_id").alias("of")).agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "sum"))).alias("turns"))
    key, sums = F.array_join(F.col("turns.digest"), ""), F.col("turns.sum")
    keyed = each.join(gathered, F.col("conv_id") == F.col("of"), "left").select("conv_id", "length", "total", F.coalesce(key, F.lit("")).alias("key"), F.coalesce(sums, F.array().cast("array<long>")).alias("sums"))
    keyed = written(keyed.withColumn("name", F.md5("key")), "trie-keyed", keep=True)
    none = turns.sparkSession.range(1).select(F.lit("").alias("key"), F.array().cast("array<long>").alias("sums"), *[F.lit(0).cast("long").alias(c) for c in ("length", "total", "n")], F.lit(None).cast("long").alias("conv_id"))
    rows = keyed.withColumn("n", F.lit(1).cast("long")).drop("name").unionByName(none)
    distinct = rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("conv_id").alias("first"), F.first("sums").alias("sums"), F.first("length").alias("length"), F.first("total").alias("total"))
    return keyed.select("conv_id", "name"), distinct


def lcp(a: bytes, b: bytes) -> int:
    """Digests that two keys have in common at their beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax()) // DIGEST


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted sequences (key, n, first, sums, length, total) -> items with the LCP to the one before in the task, and the task's first
    key (with its sums) and last key."""
    part, at, last = TaskContext.get().partitionId(), 0, None
    names = ["part", "pos", "lcp", "lcp_chars", "depth", "chars", "n", "first", "name", "key", "sums", "is_last"]
    kinds = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    for batch in batches:
        rows = []
        for k, (key, n, first, length, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
            now = key.encode()
            depth = None if last is None else lcp(last, now)
            chars = None if depth is None else batch.column(3)[k][depth - 1].as_py() if depth else 0
            sums = batch.column(3)[k].as_py() if last is None else None
            rows.append((part, (part << 40) + at, depth, chars, length, total, n, first, hashlib.md5(now).hexdigest(), key if last is None else None, sums, False))
            last, at = now, at + 1
        yield out(rows)
    if last is not None:
        yield out([(part, None, None, None, None, None, None, None, None, last.decode(), None, True)])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(p, d := lcp(a.encode(), b.encode()), s[d - 1] if d else 0) for p, a, b, s in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), *[pa.array([r[k] for r in found], pa.int64()) for k in (1, 2)]], names=["of_part", "over", "over_chars"])


def _items(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of the first round, and name, id of each sequence (written)."""
    ordered = sequences.select("key", "n", "first", "sums", "length", "total").repartitionByRange("key").sortWithinPartitions("key")
    schema = "part int, pos long, lcp long, lcp_chars long, depth long, chars long, n long, first long, name string, key string, sums array<long>, is_last boolean"
    rows = written(ordered.mapInArrow(_neighbours, schema), "trie-items", keep=True)
    lasts = rows.where("is_last").select(F.col("part").alias("last_part"), F.col("key").alias("before"))
    firsts = rows.where("key is not null and not is_last").select("part", "key", "sums")
    ways = rows.where("is_last").select("part", F.lag("part").over(W.partitionBy().orderBy("part")).alias("last_part"))  # a row a task
    met = firsts.join(ways, "part").join(lasts, "last_part").select("part", "before", "key", "sums")
    over = written(met.mapInArrow(_across, "of_part int, over long, over_chars long"), "trie-over", keep=True)
    items = rows.where("not is_last").join(over, (F.col("part") == F.col("of_part")) & F.col("lcp").isNull(), "left")
    zero = F.lit(0).cast("long")
    items = items.select(
        "pos", F.coalesce("lcp", "over", F.lit(-1)).alias("lcp"), F.coalesce("lcp_chars", "over_chars", zero).alias("lcp_chars"), (F.col("pos") * 2).alias("id"), "depth", "chars", "n", "first",
        zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"),
    )
    return items, rows.where("not is_last").select("name", (F.col("pos") * 2).alias("id"))


class Forest:
    """Components of a stretch of items (dicts of _ITEM); after `end` comes what lies beyond, at LCP `end`."""

    def __init__(self, items: list[dict], end: int):
        self.items, self.end = items, end
        self.up, self.frozen = list(range(len(items))), [False] * len(items)
        self.nodes: list[dict] = []
        self.aliases: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def merge(self) -> list[dict]:
        """What is left, contracted; closed nodes are in nodes, ids that became another one in aliases."""
        edges = sorted(range(1, len(self.items)), key=lambda i: (-self.items[i]["lcp"], i))
        begin = 0
        while begin < len(edges):
            depth, stop = self.items[edges[begin]]["lcp"], begin
            if depth < self.items[0]["lcp"]:
                self.frozen[self.find(0)] = True
            if depth < self.end:
                self.frozen[self.find(len(self.items) - 1)] = True
            run: list[int] = []
            runs = []
            while stop < len(edges) and self.items[edges[stop]]["lcp"] == depth:
                left, right = self.find(edges[stop] - 1), self.find(edges[stop])
                if not run or run[-1] != left:
                    runs.append((edges[stop], run := [left]))
                run.append(right)
                stop += 1
            for edge, run in runs:
                self._join(run, edge, depth)
            begin = stop
        return [self.items[i] for i in range(len(self.items)) if self.up[i] == i]

    def _join(self, run: list[int], edge: int, depth: int) -> None:
        """Joins neighbouring components at one depth, but for frozen ones and across them."""
        free: list[int] = []
        touches = any(self.frozen[c] for c in run)
        pieces = [free]
        for c in run:
            if self.frozen[c]:
                pieces.append(free := [])
            else:
                free.append(c)
        for piece in pieces:
            if len(piece) > 1:
                self._node(piece, depth)
            if piece and touches:
                self.frozen[self.find(piece[0])] = True

    def _node(self, piece: list[int], depth: int) -> None:
        """One component of these; those of this very depth are parts of the node, the others its children."""
        own, kids = [], []
        for c in piece:
            (own if self.items[c]["depth"] == depth else kids).append(self.items[c])
        second = self.items[piece[1]]  # its edge is one of the node's
        chars, name = second["lcp_chars"], own[0]["id"] if own else 2 * second["pos"] + 1
        self.aliases += [(x["id"], name) for x in own[1:]]
        self.nodes += [closed(x, name, depth) for x in kids]
        first = self.items[piece[0]]
        ids = [x["first"] for x in own + kids if x["first"] is not None]
        self.items[piece[0]] = {
            "pos": first["pos"], "lcp": first["lcp"], "lcp_chars": first["lcp_chars"], "id": name, "depth": depth, "chars": chars, "n": sum(x["n"] for x in own + kids),
            "first": min(ids, default=None), "kids": len(kids) + sum(x["kids"] for x in own),
            "leaves": sum(x["leaves"] for x in own) + sum(x["leaves"] if x["kids"] else 1 for x in kids),
            "saved": sum(x["saved"] for x in own) + sum(x["saved"] + (x["n"] - 1) * (x["chars"] - chars) for x in kids),
        }
        for c in piece[1:]:
            self.up[c] = piece[0]


def closed(item: dict, parent: int | None, above: int) -> dict:
    return {"parent": parent, "above": above, **{k: item[k] for k in _NODE if k not in ("parent", "above")}}


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, items' columns; at a block's end one with an LCP alone) -> kind, and what it needs: item, node or alias."""
    names = ["kind", *_ITEM, "parent", "above"]
    block, held = None, []

    def out(end: int) -> pa.RecordBatch:
        forest = Forest(held, end)
        left = forest.merge()
        rows = [{"kind": "item", **x} for x in left] + [{"kind": "node", **x} for x in forest.nodes] + [{"kind": "alias", "id": a, "parent": b} for a, b in forest.aliases]
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string() if c == "kind" else pa.int64()) for c in names], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != block:
                block, held = row[0], []
            item = dict(zip(_ITEM, row[1:], strict=True))
            if item["id"] is None:
                yield out(item["lcp"])
            else:
                held.append(item)


def _forest(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: the nodes (_NODE; the root without a parent), and ids that became another one."""
    nodes = aliases = None
    most, spark = STRETCH, items.sparkSession
    while True:
        parts = max(1, -(-items.count() // most))
        dealt = written(items.repartitionByRange(parts, "pos").withColumn("block", F.spark_partition_id()), "trie-dealt")
        begins = dealt.groupBy("block").agg(F.min_by("lcp", "pos").alias("lcp"))  # a row a stretch
        ends = begins.select("block", F.coalesce(F.lead("lcp").over(W.partitionBy().orderBy("block")), F.lit(-1)).alias("lcp"), F.lit((1 << 62)).alias("pos"))
        rows = dealt.select("block", *_ITEM).unionByName(ends, allowMissingColumns=True)
        rows = rows.repartition("block").sortWithinPartitions("block", "pos")
        kinds = ", ".join(f"{c} long" for c in (*_ITEM, "parent", "above"))
        out = written(rows.mapInArrow(_stretches, f"kind string, {kinds}"), "trie-round", keep=True)
        more, same = out.where("kind = 'node'").select(*_NODE), out.where("kind = 'alias'").select("id", F.col("parent").alias("name"))
        nodes, aliases = (more, same) if nodes is None else (nodes.unionByName(more), aliases.unionByName(same))
        items = out.where("kind = 'item'").select(*_ITEM)
        if parts == 1:
            root = items.withColumn("parent", F.lit(None).cast("long")).withColumn("above", F.lit(-1).cast("long"))
            return nodes.unionByName(root.select(*_NODE)), _last_names(written(aliases, "trie-names", keep=True))
        most *= 4


def _last_names(aliases: DataFrame) -> DataFrame:
    """id, name with every chain of names followed to its end; a chain has a link a round at most."""
    while True:
        further = aliases.select(F.col("id").alias("mid"), F.col("name").alias("last"))
        longer = aliases.join(further, F.col("name") == F.col("mid"), "left").select("id", F.coalesce("last", "name").alias("name"), F.col("last").isNotNull().alias("moved"))
        longer = written(longer, "trie-names", keep=True)
        aliases = longer.select("id", "name")
        if longer.where("moved").isEmpty():
            return aliases


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    of = names.select(F.col("id").alias("old"), F.col("name").alias("new"))
    return rows.join(of, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and SHA-256 of its ids, of rows (node, conv_id) sorted by these. The hash is fed as ids come; none are gathered."""
    node, hashed = None, None
    for batch in batches:
        done = []
        for of, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != node:
                if hashed is not None:
                    done.append((node, hashed.hexdigest()))
                node, hashed = of, hashlib.sha256(str(conv_id).encode())
            else:
                hashed.update(f",{conv_id}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["ended", "sha"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([hashed.hexdigest()], pa.string())], names=["ended", "sha"])


def _depths(low: Column, high: Column) -> tuple[Column, Column]:
    """Two steps of exploding low..high, so that no row holds an array of all: begins, and what is in a step of STEP."""
    return F.explode(F.sequence(low, high, F.lit(STEP).cast("long"))), F.explode(F.sequence(F.col("step"), F.least(F.col("step") + (STEP - 1), F.col("depth"))))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, as the contract of op12_conversations has it.

    Turns are ordered by turn, null first, ties by the MD5 of role and text; null role or text count as empty.
    Rows without a conv_id are left out; repeated rows are turns of their own. conv_id is read as a whole number (% takes its sign, as in SQL), other
    columns are not read; without any conversation there is no row, not even a root.
    """
    bounded_batches(conversations.sparkSession)
    with intermediates(conversations.sparkSession):
        turns, each = rebuilt(conversations)
        convs, sequences = _sequences(turns, each)
        items, ids = _items(sequences)
        nodes, names = _forest(items)
        nodes = written(_renamed(_renamed(nodes, "id", names), "parent", names).where("n > 0"), "trie-nodes", keep=True)
        of = convs.join(ids.withColumnRenamed("name", "of"), F.col("name") == F.col("of")).select(F.col("id").alias("node"), "conv_id")
        ended = _renamed(of, "node", names).repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_id_hashes, "ended long, sha string")
        ended = written(ended, "trie-ends", keep=True)
    parents = nodes.select(F.col("id").alias("of_id"), F.col("first").alias("parent_conv"))
    found = nodes.join(parents, F.col("parent") == F.col("of_id"), "left").join(ended, F.col("id") == F.col("ended"), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    step, inside = _depths(F.col("above") + 1, F.col("depth"))
    spread = found.where("depth > 0").withColumn("step", step).withColumn("at", inside)
    own = turns.select(F.col("conv_id").alias("of_conv"), F.col("depth").alias("of_depth"), (F.col("sum") - F.col("size")).alias("before"))
    spread = spread.join(own, (F.col("first") == F.col("of_conv")) & (F.col("at") == F.col("of_depth")))
    last = F.col("at") == F.col("depth")
    leaves = F.when(F.col("kids") > 0, F.col("leaves")).otherwise(1).cast("long")
    rows = spread.select(
        F.col("first").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("above") + 1, F.col("parent_conv")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), leaves.alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * (F.col("chars") - F.col("before"))).cast("long").alias("saved_tokens"), F.coalesce(F.when(last, F.col("sha")), nothing).alias("ends_sha256"),
    )
    root = found.where("depth = 0").select(
        F.col("first").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        leaves.alias("n_leaves"), F.col("saved").cast("long").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Per node of the prefix trie of all rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 (see prefix_trie)."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The same in DuckDB; nodes are the distinct prefixes, by running digests.
OP12_SQL = """
WITH bits AS (
    SELECT t.i, list_reduce(list_prepend(t.i, [1, 2, 3, 4, 5, 6, 7, 8]), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) t(i)
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS rank
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii((conv_id::VARCHAR)[k])::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own), crc
), turns AS (
    SELECT c.conv_id, rank AS d, digest, length(text) AS size FROM convs c JOIN own ON own.conv_id = c.base AND rank <= h
    UNION ALL
    SELECT c.conv_id, rank - h + (SELECT count(*) FROM own b WHERE b.conv_id = c.base AND b.rank <= c.h), digest, length(text) FROM convs c JOIN own USING (conv_id) WHERE rank > h
), prefixes AS (
    SELECT conv_id, d, size, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM turns
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
), lengths AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT node, p.d, min(conv_id) AS first, count(*) AS n, any_value(size) AS size,
        sha256(coalesce(string_agg(CASE WHEN l.d = p.d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends
    FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY node, p.d
), parents AS (
    SELECT n.node, q.node AS parent FROM nodes n JOIN prefixes q ON q.conv_id = n.first AND q.d = n.d - 1
), kids AS (SELECT parent AS node, count(*) AS kids FROM parents GROUP BY parent),
below AS (  -- every node and each of those above it
    SELECT q.node, n.node AS under, n.n, n.size, k.kids IS NULL AS leaf
    FROM nodes n JOIN prefixes q ON q.conv_id = n.first AND q.d <= n.d LEFT JOIN kids k ON k.node = n.node
), sums AS (
    SELECT node, count(*) FILTER (leaf) AS leaves, sum((n - 1) * size)::BIGINT AS saved FROM below GROUP BY node
)
SELECT n.first AS conv_id, n.d AS depth, q.first AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children,
    leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.node = n.node LEFT JOIN nodes q ON q.node = p.parent LEFT JOIN kids k ON k.node = n.node JOIN sums s ON s.node = n.node
"""
