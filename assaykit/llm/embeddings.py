"""Near-duplicate embeddings: exact cosine threshold pairs by dual traversal of cover trees.

Vectors of one label are compared as points on the unit sphere, where a cosine is a distance. A cover
tree has nested levels with halving radii: a node has a centre, points within its covering radius, and
children whose centres are a net of half the radius. Two trees (or one with itself) are walked at once:
a pair of nodes is dropped if the distance of the centres less both radii is above the threshold's
distance, taken whole if that distance plus both radii is below it, and opened otherwise.

The upper part of a label's tree is made by Spark. A cell with more than ``CELL`` points is split by a
few of its points (a net of a small sample); a point goes to the cell of the nearest one, and as a
visitor to each earlier cell that may hold a point near it: by the cell's covering radius, and by the
plane halfway between it and the nearest one. Cells are split until none is too large, so a label of
any size is many cells; visitors are dealt out in portions. In a task stand the points of one cell and a
portion of its visitors, as two trees. Links are counted there, and only a spanning star of each
local component goes on, so a group of n near copies makes n rows, not n squared.

Where vectors of a label are spread out evenly, as random ones in many dimensions are, no bound drops a
pair of cells: the visits then grow with the square of the label over CELL, as an exact search must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, intermediates, table, written
from .minhash import components

THRESHOLD = 0.93
#: Points of a cell, and visitors in a portion, at most.
CELL = 8192
#: Cells that one is split into, at most, and the sample in which their centres are chosen.
FAN, SAMPLE = 32, 128
#: Points of a leaf that are compared at once; rows and columns of one block of distances.
LEAF, BLOCK = 32, 1024
#: By which computed distances may be wrong.
SLACK = 1e-7


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. Rows are scaled first, so squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def net(x: np.ndarray, points: np.ndarray, radius: float, most: int | None = None) -> list[np.ndarray]:
    """The points in groups, the first of each being its centre: centres are more than radius apart and
    each point is within radius of its group's (with `most` groups, later points go to the nearest)."""
    centres, owner, bound = [], np.full(len(points), -1), 1 - radius * radius / 2
    for begin in range(0, len(points), 256):
        block = points[begin : begin + 256]
        at = np.arange(begin, begin + len(block))
        if centres:
            dots = x[block] @ x[points[centres]].T
            best = dots.argmax(1)
            ok = (dots[np.arange(len(block)), best] >= bound) | (most is not None and len(centres) >= most)
            owner[at[ok]] = best[ok]
        rest = at[owner[at] < 0]
        dots = x[points[rest]] @ x[points[rest]].T
        for k, i in enumerate(rest):
            if owner[i] < 0:
                if most is not None and len(centres) >= most:
                    owner[i] = (x[points[centres]] @ x[points[i]]).argmax()
                    continue
                free = rest[k:][(dots[k, k:] >= bound) & (owner[rest[k:]] < 0)]
                owner[free] = owner[i] = len(centres)
                centres.append(i)
    order = np.argsort(owner, kind="stable")
    return [points[g] for g in np.split(order, np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])]


class CoverTree:
    """Nodes over some rows of x: points (the centre first), covering radius, and children, none of a leaf."""

    def __init__(self, x: np.ndarray, points: np.ndarray):
        self.points, self.radius, self.children = [points], [self._reach(x, points)], [None]
        todo = [(0, 2.0)]
        while todo:
            node, radius = todo.pop()
            points = self.points[node]
            if len(points) <= LEAF:
                continue
            groups = [points]
            while len(groups) == 1 and radius > SLACK:  # levels at which the node has itself as its only child
                radius /= 2
                groups = net(x, points, radius) if self.radius[node] > radius else [points]
            if len(groups) == 1:
                continue
            self.children[node] = np.arange(len(self.points), len(self.points) + len(groups))
            for g in groups:
                todo.append((len(self.points), radius))
                self.points.append(g)
                self.radius.append(self._reach(x, g))
                self.children.append(None)
        self.radius, self.sizes = np.array(self.radius), np.array([len(p) for p in self.points])
        self.centre = np.array([p[0] if len(p) else -1 for p in self.points])

    @staticmethod
    def _reach(x: np.ndarray, points: np.ndarray) -> float:
        return float(_distance((x[points] @ x[points[0]]).min())) if len(points) > 1 else 0.0


class Links:
    """Links found among the rows of x (each standing for n vectors): how many each has, and components."""

    def __init__(self, x: np.ndarray, n: np.ndarray, threshold: float):
        self.x, self.n, self.threshold, self.near = x, n, threshold, float(np.sqrt(2 - 2 * threshold))
        self.count, self.root = np.zeros(len(x), np.int64), np.arange(len(x))

    def _roots(self, at: np.ndarray) -> np.ndarray:
        found = self.root[at]
        while (self.root[found] != found).any():
            found = self.root[found]
        self.root[at] = found
        return found

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.stack([self._roots(a), self._roots(b)], 1)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for s, t in np.unique(pairs, axis=0):
            s, t = self._roots(np.array([s, t]))
            self.root[max(s, t)] = min(s, t)

    def some(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each of a with the one of b in its place."""
        np.add.at(self.count, a, self.n[b])
        np.add.at(self.count, b, self.n[a])
        self._join(a, b)

    def whole(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """All of a with all of b, or of a with each other."""
        if b is None:
            self.count[a] += self.n[a].sum() - self.n[a]
            b = a
        else:
            self.count[a] += self.n[b].sum()
            self.count[b] += self.n[a].sum()
        self._join(np.concatenate([a, np.full(len(b), a[0])]), np.concatenate([np.full(len(a), b[0]), b]))

    def compare(self, a: np.ndarray, b: np.ndarray | None = None) -> None:
        """Every pair of a and b, or of a with itself, by its cosine."""
        dots = self.x[a] @ self.x[a if b is None else b].T >= self.threshold
        i, j = np.nonzero(np.triu(dots, 1) if b is None else dots)
        if len(i):
            self.some(a[i], (a if b is None else b)[j])

    def walk(self, one: CoverTree, two: CoverTree | None = None) -> None:
        """Links between the points of two trees, or among those of one."""
        other = one if two is None else two
        if not len(one.points[0]) or not len(other.points[0]):
            return
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            same = two is None and a == b
            if same and 2 * one.radius[a] <= self.near - SLACK:
                self.whole(one.points[a])
                continue
            left, right = one.children[a], other.children[b]
            if left is None and right is None:
                self.compare(one.points[a], None if same else other.points[b])
                continue
            left, right = np.array([a]) if left is None else left, np.array([b]) if right is None else right
            for i in range(0, len(left), BLOCK):
                for j in range(i if same else 0, len(right), BLOCK):
                    todo += self._pairs(one, other, left[i : i + BLOCK], right[j : j + BLOCK], same and i == j)
            if same:
                todo += [(c, c) for c in left[one.sizes[left] > 1]]

    def _pairs(self, one: CoverTree, other: CoverTree, a: np.ndarray, b: np.ndarray, same: bool) -> list[tuple[int, int]]:
        """Pairs of these nodes that have to be opened; what is decided by bounds is done."""
        dots = self.x[one.centre[a]] @ self.x[other.centre[b]].T
        reach = one.radius[a][:, None] + other.radius[b]
        if same:  # each pair once
            dots[np.tril_indices(len(a))] = -np.inf
        points = reach == 0
        points &= (one.sizes[a] == 1)[:, None] & (other.sizes[b] == 1)
        i, j = np.nonzero(points & (dots >= self.threshold))
        if len(i):
            self.some(one.centre[a[i]], other.centre[b[j]])
        i, j = np.nonzero(~points & (dots > -np.inf))
        if not len(i):
            return []
        distance, reach = _distance(dots[i, j]), reach[i, j]
        within = distance + reach <= self.near - SLACK
        for s, t in zip(a[i[within]], b[j[within]], strict=True):
            self.whole(one.points[s], other.points[t])
        open_ = ~within & (distance - reach <= self.near + SLACK)
        return list(zip(a[i[open_]], b[j[open_]], strict=True))


def _vectors(column: pa.ListArray) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns vec_id, cell, vec with the digest of the unit vector (null without a cell)."""
    for batch in batches:
        digests: list[bytes | None] = [None] * batch.num_rows
        cells, lengths = batch.column(1).is_valid().to_pylist(), batch.column(2).value_lengths().to_pylist()
        places: dict[int, list[int]] = {}
        for i, (ok, size) in enumerate(zip(cells, lengths, strict=True)):
            if ok:
                places.setdefault(size, []).append(i)
        for at in places.values():
            for i, row in zip(at, _vectors(batch.column(2).take(pa.array(at))) + 0.0, strict=True):
                digests[i] = hashlib.md5(row.tobytes()).digest()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=["vec_id", "cell", "vec", "digest"])


def _by_group(work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], keys: int) -> Callable:
    """Applies work to the rows of each group by the first columns, by which the rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
            begin = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i] != rows[begin]:
                    if held and last != rows[begin]:
                        yield from work(last, pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(begin, i - begin))
                    last, begin = rows[begin], i
        if held:
            yield from work(last, pa.Table.from_batches(held))

    return run


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, fan, sample -> cell, the flat coordinates of at most fan centres: a net of halving radius."""
    for batch in batches:
        out = []
        for fan, sample in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            x, radius = unit(np.array(sample)), 2.0
            groups = [np.arange(len(x))]
            while len(groups) < min(fan, len(x)) and radius > SLACK:
                radius /= 2
                groups = net(x, np.arange(len(x)), radius, fan)
            out.append(x[[g[0] for g in groups]].ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["cell", "centres"])


def _with_centres(rows: DataFrame, centres: DataFrame, work: Callable, schema: str) -> DataFrame:
    """Applies work to the rows (cell, ...) of each cell with its centres: a large cell is dealt out over `parts`."""
    parts = F.col("parts")
    salted = rows.join(centres.select(F.col("cell").alias("of"), "parts"), F.col("cell") == F.col("of")).withColumn("part", F.pmod(F.xxhash64("rep"), parts.cast("long")).cast("int"))
    kind = rows.schema["vec"].dataType.simpleString()
    first = centres.select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "centres", "reaches", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(kind).alias("vec"), F.lit(True).alias("home"))
    none = F.lit(None).cast("array<double>")
    both = first.unionByName(salted.select("cell", "part", none.alias("centres"), none.alias("reaches"), "rep", "n", "vec", "home"))
    return both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("centres").isNull()).mapInArrow(work, schema)


def _placed(batches: Iterator[pa.RecordBatch], place: Callable) -> Iterator[pa.RecordBatch]:
    """Hands each stretch of rows after a row of centres to place(cell, centres, reaches, rows)."""
    centres = reaches = None
    for batch in batches:
        heads = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False)).tolist()
        for begin, end in zip([0, *(h + 1 for h in heads)], [*heads, batch.num_rows], strict=True):
            if begin:
                centres = np.array(batch.column(2)[begin - 1].as_py())
                reaches = batch.column(3)[begin - 1].as_py()
            if end > begin:
                rows = batch.slice(begin, end - begin)
                x = _vectors(rows.column(6))
                yield from place(rows, x @ centres.reshape(-1, x.shape[1]).T, centres.reshape(-1, x.shape[1]), reaches)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, child, reach: the largest distance of some of the cell's points from the centre nearest to them."""

    def place(rows, dots, centres, reaches):
        child = dots.argmax(1)
        far = _distance(dots[np.arange(len(child)), child])
        found = np.unique(child)
        yield pa.RecordBatch.from_arrays([rows.column(0).slice(0, 1).take(pa.array([0] * len(found))), pa.array(found.astype(np.int32)), pa.array([float(far[child == c].max()) for c in found])], names=["cell", "child", "reach"])

    return _placed(batches, place)


def _visits(threshold: float) -> Callable:
    """cell of the next level, rep, n, vec, home of each row: at home with the nearest centre, and as a visitor
    with every earlier one (all others, if it is a visitor) that may have points near it."""
    near = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def place(rows, dots, centres, reaches):
        all_rows = np.arange(len(dots))
        child = dots.argmax(1)
        home = rows.column(7).to_numpy(zero_copy_only=False)
        reach = np.array([-np.inf if r is None else r for r in reaches[: len(centres)]])  # nothing is near a centre without points
        apart = _distance(centres @ centres.T)[child]
        ok = (_distance(dots) - reach <= near) & (dots[all_rows, child][:, None] - dots <= near * apart + SLACK)
        ok &= ~home[:, None] | (np.arange(len(centres)) < child[:, None])
        ok[all_rows, child] |= home
        i, j = np.nonzero(ok)
        at = pa.array(i)
        cells = rows.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{cells[a]}{c}." for a, c in zip(i, j, strict=True)]), rows.column(4).take(at), rows.column(5).take(at), rows.column(6).take(at), pa.array(home[i] & (child[i] == j))],
            names=["cell", "rep", "n", "vec", "home"],
        )

    return lambda batches: _placed(batches, place)


def _cells(points: DataFrame, threshold: float) -> DataFrame:
    """cell, rep, n, vec, home: the points (cell, rep, n, vec) in cells of at most CELL of them, with visitors."""
    rows, done, seed = points.withColumn("home", F.lit(True)), None, 0
    kind = points.schema["vec"].dataType.simpleString()
    while True:
        sizes = rows.where("home").groupBy("cell").agg(F.count("*").alias("size"))
        # a point in a few is drawn for each centre, so all cells' samples are of about the same size
        large = written(sizes.where(F.col("size") > CELL).select(F.col("cell").alias("of"), "size"), "near-large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        seed += 1
        drawn = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("size")
        fan = F.least(F.lit(FAN), F.ceil(F.col("size") * 2 / CELL)).cast("int")
        sample = rows.where("home").join(large, F.col("cell") == F.col("of")).where(drawn).groupBy("cell").agg(F.first(fan).alias("fan"), F.collect_list("vec").alias("sample"), F.first("size").alias("size"))
        parts = F.ceil(F.col("size") / CELL).cast("int").alias("parts")
        sample = written(sample.where(F.size("sample") > 1).select("cell", "fan", "sample", parts), "near-sample")
        chosen = sample.select("cell", "fan", "sample").mapInArrow(_choose, "cell string, centres array<double>").withColumnRenamed("cell", "of")
        bare = written(sample.join(chosen, F.col("cell") == F.col("of")).select("cell", "parts", "centres", F.lit(None).cast("array<double>").alias("reaches")), "near-centres")
        reach = _with_centres(rows.where("home"), bare, _nearest, "cell string, child int, reach double").groupBy("cell", "child").agg(F.max("reach").alias("reach"))
        per_cell = reach.groupBy(F.col("cell").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("child", "reach"))).alias("far"))
        # centres' number is not a column: far has no entry of a centre beyond them, nor of one without points
        some = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.try_element_at("far", k))
        centres = written(bare.join(per_cell, F.col("cell") == F.col("of")).select("cell", "parts", "centres", some.alias("reaches")), "near-centres")
        of = centres.select(F.col("cell").alias("of"))
        kept = rows.join(of, F.col("cell") == F.col("of"), "left_anti")
        done = kept if done is None else done.unionByName(kept)
        done = written(done, "near-cells")
        rows = written(_with_centres(rows, centres, _visits(threshold), f"cell string, rep long, n long, vec {kind}, home boolean"), "near-split")


def _link(threshold: float) -> Callable:
    """(a, b, links) of a cell and a portion of its visitors: for each point with links their number (b null),
    and each point of a local component with the component's first (links null)."""

    def work(key: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x = _vectors(rows.column("vec").combine_chunks())
        rep, n = (rows.column(c).to_numpy() for c in ("rep", "n"))
        home = rows.column("home").to_numpy()
        found = Links(x, n, threshold)
        tree = CoverTree(x, np.flatnonzero(home))
        if key[1] == 0:
            found.walk(tree)
        found.walk(tree, CoverTree(x, np.flatnonzero(~home)))
        some = np.flatnonzero(found.count)
        root = found._roots(np.arange(len(x)))
        inner = np.flatnonzero(root != np.arange(len(x)))
        none = pa.nulls(len(some), pa.int64()), pa.nulls(len(inner), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rep[some]), none[0], pa.array(found.count[some])], names=["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(rep[root[inner]]), pa.array(rep[inner]), none[1]], names=["a", "b", "links"])

    return _by_group(work, 2)


def _finite(vec: str) -> F.Column:
    fine = F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null, their vectors have equally many
    components, and the cosine in double precision is at least threshold (above -1). Vectors that are null, empty, zero
    or hold a null, NaN or infinite component link with nothing. n_links counts other rows, equal
    vectors, repeated rows and rows of one id included; component_id is the smallest vec_id that links reach (nulls
    are passed over, and name a component only if it has no other id); kept is whether it is the row's
    own (of repeated ids all are). Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    with intermediates(spark):
        # the part behind // has no slash, so cells of different labels never have one name
        whole = F.when(_finite("embedding"), F.concat(F.size("embedding").cast("string"), F.lit("/"), F.col("label").cast("string"), F.lit("//")))
        kind = {f.name.lower(): f.dataType for f in vectors.schema.fields}
        vec_id, vec = kind["vec_id"].simpleString(), kind["embedding"]
        if not isinstance(vec.elementType, T.FloatType | T.DoubleType):
            vec = T.ArrayType(T.DoubleType())
        plain = vectors.select("vec_id", whole.alias("cell"), F.col("embedding").cast(vec).alias("vec"))
        signed = plain.mapInArrow(_signed, f"vec_id {vec_id}, cell string, vec {vec.simpleString()}, digest binary")
        signed = written(signed, "near-vectors", keep=True)
        firsts = signed.where("cell is not null").groupBy("cell", "digest").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
        points = written(firsts.withColumn("rep", F.monotonically_increasing_id()), "near-points", keep=True)
        rows = _cells(points.select("cell", "rep", "n", "vec"), threshold)
        guests = written(rows.where("not home").groupBy(F.col("cell").alias("of")).agg(F.count("*").alias("guests")).where(F.col("guests") > CELL), "near-guests")
        portions = F.coalesce(F.ceil(F.col("guests") / CELL), F.lit(1)).cast("int")
        dealt = rows.join(guests, F.col("cell") == F.col("of"), "left").withColumn("portions", portions)
        part = F.when(F.col("home"), F.sequence(F.lit(0), F.col("portions") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("portions").cast("long")).cast("int")))
        dealt = dealt.select("cell", F.explode(part).alias("part"), "rep", "n", "vec", "home").repartition("cell", "part").sortWithinPartitions("cell", "part")
        found = written(dealt.mapInArrow(_link(threshold), "a long, b long, links long"), "near-found", keep=True)
        roots = components(found.where("b is not null").select("a", "b"))
        ids = points.select("rep", "first_id")
        grown = roots.select("id", "root").union(roots.select("root", "root")).distinct()
        inside = written(grown.join(ids, F.col("id") == F.col("rep")).select("rep", "root", "first_id"), "near-inside", keep=True)
        names = written(inside.groupBy(F.col("root").alias("of")).agg(F.min("first_id").alias("component_id")), "near-names", keep=True)
        of_rep = inside.join(names, F.col("root") == F.col("of")).select(F.col("rep").alias("in_rep"), "component_id", F.lit(True).alias("grown"))
        counts = found.where("links is not null").groupBy(F.col("a").alias("of_rep")).agg(F.sum("links").alias("links"))
        per_point = points.join(counts, F.col("rep") == F.col("of_rep"), "left").join(of_rep, F.col("rep") == F.col("in_rep"), "left")
        # a component of one vector, or of equal ones, is named by the first of these
        name = F.when(F.col("grown"), F.col("component_id")).otherwise(F.col("first_id"))
        per_point = written(per_point.select(F.col("cell").alias("of_cell"), F.col("digest").alias("of"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), name.alias("component_id"), F.lit(True).alias("valid")), "near-result", keep=True)
    out = signed.join(per_point, (F.col("digest") == F.col("of")) & (F.col("cell") == F.col("of_cell")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_embeddings(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links and component (see near_embeddings)."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


#: The same in DuckDB.
OP13_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
JOIN (SELECT a AS of, min(b) AS least FROM reach GROUP BY a) ON of = vec_id
"""
