"""Exact nearest neighbours under ``alpha * euclid + edit`` without forming all pairs.

The distance is a metric, so the triangle inequality can rule out most points unseen:

1. One training point in ``block_rows`` (at most 32,768) is the pivot of a leaf; some of
   these are the pivots of cells, which hold the leaves next to them.  Every point goes to
   the nearest leaf of its nearest cell, so leaves are as many as the table asks for.
2. The number of points of the cells and how far they lie from their pivots give each
   query a radius that surely holds its k nearest.
3. A look into the leaves next to the query tightens the radius.
4. A query visits only the leaves that its radius can reach; a row names all those of a cell.

Edit and Euclidean distances to the pivots are kept apart, so that the one index bounds the
distance for every alpha: a search for many alphas places, looks and visits once, with a
radius for each.  The queries that visit a cell stream past its points, and distances are
computed many at a time.  What a cell finds is one row for each query, its points once for
all alphas; votes are taken where the rows of a query meet.

Identical training points are one point with the k smallest ids, as no others can ever be
chosen; identical queries are answered once.  So copies, however many, load neither a leaf
nor a task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.fixed_values import NEIGHBOUR_ALPHAS, NEIGHBOUR_COUNTS
from colprism.functions.cells import quoted
from colprism.functions.edits import edit_distances
from colprism.functions.numeric import text_or_nan
from colprism.operators.evaluate import best_of_grid

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Stands for a missing group, which is one of its own.
_NO_GROUP = -(1 << 31)
#: Leaves at most; the driver and every task hold their pivots and ranges.
_LEAVES = 1 << 15
#: Queries that one copy of a cell gets, even if all visit it; there are fewer copies where they would be the most of the work.
_VISITORS = 1 << 16
_ROWS = 2048
_PAIRS = 1 << 20


@dataclass(frozen=True)
class PointColumns:
    """Which columns of a table hold id, name, statistics, label and (optional) group.

    With a group, rows of the query's own group are not neighbours; cross-validation
    passes the fold here.
    """

    row_id: str
    name: str
    stats: Sequence[str] = ()
    label: str | None = None
    group: str | None = None

    def points(self, df: DataFrame, with_stats: bool, more: Sequence[Column] = ()) -> DataFrame:
        # Without weight the statistics do not tell points apart.
        used = self.stats if with_stats else []
        # A missing statistic counts as 0; every row has a distance to every other.
        filled = [F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in used]
        x = F.array(*filled).cast("array<double>")
        label = F.lit(None).cast("int") if self.label is None else quoted(self.label)
        group = F.lit(0) if self.group is None else F.coalesce(quoted(self.group).cast("int"), F.lit(_NO_GROUP))
        return df.select(
            quoted(self.row_id).alias("id"),
            text_or_nan(quoted(self.name)).alias("name"),
            x.alias("x"),
            label.alias("label"),
            group.alias("grp"),
            *more,
        )


# ---------------------------------------------------------------- points in Arrow tasks


def _names(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """(the different names, the number of each row's)."""
    coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = coded.dictionary_encode()
    texts = [b.decode("utf-8", "surrogateescape") for b in coded.dictionary.to_pylist()]
    return texts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Rows of a column of lists of one length."""
    flat = pc.list_flatten(column)
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lists(values: np.ndarray) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _upward(values: np.ndarray) -> np.ndarray:
    """In half the bytes, and no less."""
    with np.errstate(over="ignore"):
        half = values.astype(np.float32)
    return np.where(half < values, np.nextafter(half, np.float32(np.inf)), half)


def _euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(x.shape[-1]):
            gap = x[..., d] - y[..., d]
            total += gap * gap
    return np.where(np.isnan(total), np.inf, np.sqrt(total))


def _weighed(alpha: float, euclid: np.ndarray, edit: np.ndarray) -> np.ndarray:
    return edit.astype(float) if alpha == 0 else alpha * euclid + edit


# ---------------------------------------------------------------- leaves and cells


@dataclass
class _Tree:
    """Pivots of leaves, cells of leaves, and where their points lie: bounded by ``_LEAVES``."""

    alphas: list[float]
    names: list[str]
    x: np.ndarray
    tops: np.ndarray  # of each cell: the leaf whose pivot is its own
    cells: list[np.ndarray]  # of each cell: its leaves
    rows: int  # different points
    ranges: np.ndarray | None = None  # leaves x (least and most edit, least and most euclid, most for each alpha)
    counts: np.ndarray | None = None  # of each leaf: rows outside the largest group
    wide: np.ndarray | None = None  # cells x (most edit, most euclid, most for each alpha)

    @cached_property
    def homes(self) -> tuple[np.ndarray, np.ndarray]:
        """(cell, place in it) of each leaf."""
        cell, place = np.zeros(len(self.names), np.int32), np.zeros(len(self.names), np.int64)
        for c, leaves in enumerate(self.cells):
            cell[leaves], place[leaves] = c, np.arange(len(leaves))
        return cell, place

    @property
    def base(self) -> float:
        return sorted(self.alphas)[len(self.alphas) // 2]

    def to_tops(self, names: list[str], number: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows x cells: edit and Euclidean distances to their pivots."""
        i, j = np.indices((len(names), len(self.tops))).reshape(2, -1)
        edit = edit_distances(names, [self.names[t] for t in self.tops], i, j).reshape(len(names), -1)
        return edit[number], _euclid(x[:, None], self.x[self.tops][None])

    def to_leaves(self, names: list[str], number: np.ndarray, x: np.ndarray, rows: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """rows x leaves of a cell: edit and Euclidean distances to their pivots."""
        leaves = self.cells[cell]
        some, place = np.unique(number[rows], return_inverse=True)
        i, j = np.indices((len(some), len(leaves))).reshape(2, -1)
        edit = edit_distances([names[s] for s in some], [self.names[l] for l in leaves], i, j).reshape(len(some), -1)
        return edit[place], _euclid(x[rows][:, None], self.x[leaves][None])

    def nearest_leaves(
        self, names: list[str], number: np.ndarray, x: np.ndarray, tops: tuple[np.ndarray, np.ndarray], alpha: float
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, edit, euclid) of the nearest leaf in the nearest cell."""
        cell = _weighed(alpha, tops[1], tops[0]).argmin(1)
        leaf, edit, euclid = np.zeros(len(x), np.int32), np.zeros(len(x)), np.zeros(len(x))
        for c in np.unique(cell):
            rows = np.flatnonzero(cell == c)
            e, u = self.to_leaves(names, number, x, rows, c)
            at = _weighed(alpha, u, e).argmin(1)
            leaf[rows], edit[rows], euclid[rows] = self.cells[c][at], e[np.arange(len(rows)), at], u[np.arange(len(rows)), at]
        return leaf, edit, euclid

    def surveyed(self, told: list) -> None:
        """Takes the ranges of the leaves, and bounds those of the cells by them."""
        self.counts = np.zeros(len(self.names), np.int64)
        self.ranges = np.tile(np.array([np.inf, -np.inf] * 2 + [-np.inf] * len(self.alphas)), (len(self.names), 1))
        for r in told:
            self.counts[r["leaf"]] = r["n"]
            self.ranges[r["leaf"]] = [r["e0"], r["e1"], r["u0"], r["u1"], *r["most"]]
        wide = []
        for c, leaves in enumerate(self.cells):
            top = self.tops[c]
            i = np.zeros(len(leaves), np.int64)
            e = edit_distances([self.names[top]], [self.names[l] for l in leaves], i, np.arange(len(leaves)))
            u = _euclid(self.x[leaves], self.x[top])
            far = self.ranges[leaves]
            most = [(_weighed(a, u, e) + far[:, 4 + k]).max() for k, a in enumerate(self.alphas)]
            wide.append([(e + far[:, 1]).max(), (u + far[:, 3]).max(), *most])
        self.wide = np.array(wide)

    def sure_radii(self, tops: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """rows x alphas: a distance within which there are k rows of another group, by the cells alone."""
        held = np.array([self.counts[leaves].sum() for leaves in self.cells])
        out = []
        for a, alpha in enumerate(self.alphas):
            far = np.where(held > 0, _weighed(alpha, tops[1], tops[0]) + self.wide[:, 2 + a], np.inf)
            order = far.argsort(1)
            enough = held[order].cumsum(1) >= k
            at = enough.argmax(1)
            rows = np.arange(len(far))
            out.append(np.where(enough[rows, at], far[rows, order[rows, at]], np.inf))
        return np.stack(out, 1)

    def reached(self, edit: np.ndarray, euclid: np.ndarray, radii: np.ndarray, least_most: tuple, most: np.ndarray) -> np.ndarray:
        """Whether a query, by its distances to a pivot, can have points within its radius; true where that cannot be told."""
        e0, e1, u0, u1 = least_most
        with np.errstate(invalid="ignore"):
            e = np.maximum(np.maximum(edit - e1, e0 - edit), 0)
            u = np.maximum(np.maximum(euclid - u1, u0 - euclid), 0)
            out = np.zeros(edit.shape, bool)
            for a, alpha in enumerate(self.alphas):
                near = np.maximum(_weighed(alpha, u, e), _weighed(alpha, euclid, edit) - most[:, a])
                out |= ~(near > radii[:, a][:, None])
        return out


def _tree(points: DataFrame, alphas: list[float], block_rows: int, pivots: int | None) -> _Tree:
    n = points.count()
    if not n:
        raise ValueError("there are no training rows")
    leaves = min(max(1, n // block_rows), _LEAVES)
    hashed = F.pmod(F.xxhash64("name", "x", "grp"), F.lit(n))
    rows = points.where(hashed < leaves).select("name", "x").distinct().collect() or points.select("name", "x").limit(1).collect()
    pairs = sorted((r["name"].encode("utf-8", "surrogateescape"), tuple(r["x"])) for r in rows)
    draw = np.random.Generator(np.random.PCG64(1))
    pairs = [pairs[i] for i in draw.permutation(len(pairs))]
    x = np.array([p[1] for p in pairs], float).reshape(len(pairs), -1)
    names = [p[0].decode("utf-8", "surrogateescape") for p in pairs]
    tops = np.arange(min(pivots or math.isqrt(len(pairs) - 1) + 1, len(pairs)))
    tree = _Tree(alphas, names, x, tops, [], n)
    near = np.concatenate(
        [
            _weighed(tree.base, *tree.to_tops(names[lo : lo + _ROWS], np.arange(len(x[lo : lo + _ROWS])), x[lo : lo + _ROWS])[::-1]).argmin(1)
            for lo in range(0, len(x), _ROWS)
        ]
    )
    near[tops] = tops  # of two like pivots each keeps its own
    tree.cells = [np.flatnonzero(near == c) for c in range(len(tops))]
    return tree


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(some rows, different names, the number of each row's, statistics)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            names, number = _names(part.column("name"))
            yield part, names, number, _matrix(part.column("x"), part.num_rows)


def _added(part: pa.RecordBatch, rows: np.ndarray | None, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    part = part if rows is None else part.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*part.columns, *columns.values()], [*part.schema.names, *columns])


def _placed(points: DataFrame, tree: _Tree) -> DataFrame:
    """Adds cell and leaf of each point and both distances to the pivot of its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, number, x in _batches(batches):
            found = tree.nearest_leaves(names, number, x, tree.to_tops(names, number, x), tree.base)
            found = tree.homes[0][found[0]], *found
            yield _added(part, None, dict(zip(("cell", "leaf", "edit", "euclid"), map(pa.array, found))))

    return points.mapInArrow(run, f"{_schema(points)}, cell int, leaf int, edit double, euclid double")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{quoted_name} {kind}" for quoted_name, kind in df.dtypes)


def _survey(placed: DataFrame, tree: _Tree) -> DataFrame:
    """One row per leaf."""
    weighed = [F.col("edit") if a == 0 else F.lit(a) * F.col("euclid") + F.col("edit") for a in tree.alphas]
    by_group = placed.groupBy("leaf", "grp").agg(
        F.sum(F.size("copies")).alias("n"),
        F.min("edit").alias("e0"), F.max("edit").alias("e1"), F.min("euclid").alias("u0"), F.max("euclid").alias("u1"),
        *[F.max(w).alias(f"m{i}") for i, w in enumerate(weighed)],
    )
    most = [F.max(f"m{i}") for i in range(len(weighed))]
    return by_group.groupBy("leaf").agg(
        (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("all"),
        F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("u0").alias("u0"), F.max("u1").alias("u1"),
        F.array(*most).alias("most"),
    )


def _located(askers: DataFrame, tree: _Tree, k: int) -> DataFrame:
    """A row for each leaf to look into first: the nearest ones by the smallest, middle and largest alpha."""
    looks = list(dict.fromkeys([min(tree.alphas), tree.base, max(tree.alphas)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, number, x in _batches(batches):
            tops = tree.to_tops(names, number, x)
            radii = tree.sure_radii(tops, k)
            # The slack covers rounding in the triangle inequality.
            far = [_weighed(a, np.where(np.isinf(tops[1]), 0, tops[1]), tops[0]).max(1) for a in tree.alphas]
            slack = 1e-9 * (1 + np.stack(far, 1))
            homes = np.stack([tree.nearest_leaves(names, number, x, tops, a)[0] for a in looks], 1)
            cell, place = tree.homes
            radii, slack = _upward(radii + slack), _upward(slack)
            for c in np.unique(cell[homes]):
                here = cell[homes] == c
                rows = np.flatnonzero(here.any(1))
                marks = np.zeros((len(rows), len(tree.cells[c])), bool)
                for look in range(len(looks)):
                    at = np.flatnonzero(here[rows, look])
                    marks[at, place[homes[rows[at], look]]] = True
                yield _added(part, rows, {"radii": _lists(radii[rows]), "slack": _lists(slack[rows]), **_marked(c, marks)})

    return askers.mapInArrow(run, f"{_schema(askers)}, radii array<float>, slack array<float>, cell int, leaves binary")


def _marked(cell: int, marks: np.ndarray) -> dict[str, pa.Array]:
    """A cell and, for each row, a bit for each of its leaves."""
    bits = np.packbits(marks, axis=1)
    return {"cell": pa.array(np.full(len(bits), cell, np.int32)), "leaves": pa.array([b.tobytes() for b in bits], pa.binary())}


def _visits(askers: DataFrame, tree: _Tree) -> DataFrame:
    """A row for each query and cell with leaves that it must look into."""
    narrow = (0.0, math.inf, 0.0, math.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, names, number, x in _batches(batches):
            radii = _matrix(part.column("radii"), part.num_rows)
            edit, euclid = tree.to_tops(names, number, x)
            cells = tree.reached(edit, euclid, radii, (narrow[0], tree.wide[:, 0], narrow[2], tree.wide[:, 1]), tree.wide[:, 2:])
            for c, leaves in enumerate(tree.cells):
                rows = np.flatnonzero(cells[:, c])
                if not len(rows):
                    continue
                far = tree.ranges[leaves]
                e, u = tree.to_leaves(names, number, x, rows, c)
                reached = tree.reached(e, u, radii[rows], (far[:, 0], far[:, 1], far[:, 2], far[:, 3]), far[:, 4:])
                reached &= tree.ranges[leaves, 1] >= 0  # others are empty
                some = np.flatnonzero(reached.any(1))
                if len(some):
                    yield _added(part, rows[some], _marked(c, reached[some]))

    return askers.mapInArrow(run, f"{_schema(askers)}, cell int, leaves binary")


# ---------------------------------------------------------------- queries in a leaf


def _pairs(queries: pa.Table, points: pa.Table, alphas: list[float], grouped: bool) -> Iterator[tuple]:
    """(first query, query, point, edit, euclid) of all pairs that may be within a radius, some queries at a time, in order of the queries."""
    qn, qi = _names(queries.column("name"))
    pn, pi = _names(points.column("name"))
    qx, px = _matrix(queries.column("x").combine_chunks(), queries.num_rows), _matrix(points.column("x").combine_chunks(), points.num_rows)
    radii = _matrix(queries.column("radii").combine_chunks(), queries.num_rows)
    qg, pg = queries.column("grp").to_numpy(), points.column("grp").to_numpy()
    ql, pl = np.array([len(n) for n in qn])[qi], np.array([len(n) for n in pn])[pi]
    step = max(1, _PAIRS // points.num_rows)
    for lo in range(0, queries.num_rows, step):
        some = slice(lo, lo + step)
        u = _euclid(qx[some][:, None], px[None])
        # Names differ by what their lengths differ by, at least.
        least = np.abs(ql[some][:, None] - pl[None])
        near = np.zeros(u.shape, bool)
        for a, alpha in enumerate(alphas):
            near |= _weighed(alpha, u, least) <= radii[some, a][:, None]
        if grouped:
            near &= qg[some][:, None] != pg[None]
        q, p = np.nonzero(near)
        u = u[q, p]
        q += lo
        yield lo, q, p, edit_distances(qn, pn, qi[q], pi[p]), u


def _copies(points: pa.Table) -> np.ndarray:
    """How many rows each point stands for, k at most."""
    return pc.list_value_length(points.column("copies")).to_numpy().astype(np.int64)


def _kth(queries: pa.Table, points: pa.Table, alphas: list[float], k: int, grouped: bool) -> Iterator[tuple]:
    """(alpha, query, distance of its k-th row) of the queries that have k rows in the leaf."""
    sizes = _copies(points)
    few = min(k, points.num_rows)
    for lo, q, p, e, u in _pairs(queries, points, alphas, grouped):
        if not len(q):
            continue
        d = np.full((int(q[-1]) - lo + 1, points.num_rows), np.inf)
        there = np.zeros(d.shape, bool)
        there[q - lo, p] = True
        for a, alpha in enumerate(alphas):
            d[q - lo, p] = _weighed(alpha, u, e)
            # Each point is one row at least, so those after the k nearest tell nothing.
            first = np.argpartition(d, few - 1, axis=1)[:, :few]
            first = np.take_along_axis(first, np.take_along_axis(d, first, 1).argsort(1), 1)
            held = np.where(np.take_along_axis(there, first, 1), sizes[first], 0).cumsum(1)
            rows = np.flatnonzero(held[:, -1] >= k)
            yield a, rows + lo, d[rows, first[rows, (held[rows] >= k).argmax(1)]]


def _met(queries: pa.Table, points: pa.Table, alphas: list[float], k: int, grouped: bool) -> Iterator[tuple]:
    """(alpha, query, copy, edit, euclid) of up to k copies of points within the radius, nearest first, some queries at a time."""
    radii = _matrix(queries.column("radii").combine_chunks(), queries.num_rows)
    sizes = _copies(points)
    starts = np.cumsum(sizes) - sizes
    ids = pc.list_flatten(points.column("copies").combine_chunks()).field("id")
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    for _, q, p, e, u in _pairs(queries, points, alphas, grouped):
        for a, alpha in enumerate(alphas):
            d = _weighed(alpha, u, e)
            within = np.flatnonzero(d <= radii[q, a])
            times = sizes[p[within]]
            of = np.repeat(within, times)
            copy = starts[p[of]] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
            order = np.lexsort((rank[copy], d[of], q[of]))
            of, copy = of[order], copy[order]
            first = np.searchsorted(q[of], q[of], side="left")
            kept = np.arange(len(of)) - first < k
            of = of[kept]
            yield a, q[of], copy[kept], e[of], u[of]


def _meeting(askers: DataFrame, blocks: DataFrame, parts: int, run: Callable[[pa.Table, pa.Table | None], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``run`` makes of some askers of a cell at a time, and all points of that cell.

    The points of a cell come before its askers, which stream past them: a task holds one cell, however many ask.
    """
    both = blocks.withColumn("asks", F.lit(False)).unionByName(askers.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    keys = ["cell", "salt", "asks"]
    asked, told = askers.columns, blocks.columns

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, home = [], None
        for batch in batches:
            key = np.stack([batch.column(c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in keys], 1)
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else []
            for lo, hi in zip(starts, [*starts[1:], len(key)]):
                part = batch.slice(lo, hi - lo)
                if tuple(key[lo, :2]) != home:
                    points, home = [], tuple(key[lo, :2])
                if key[lo, 2]:
                    out = run(pa.Table.from_batches([part.select(asked)]), pa.Table.from_batches(points) if points else None)
                    if out is not None:
                        yield out
                else:
                    points.append(part.select(told))

    return both.repartition(parts, "cell", "salt").sortWithinPartitions(*keys).mapInArrow(stream, schema)


def _by_leaf(queries: pa.Table, points: pa.Table | None, tree: _Tree) -> Iterator[tuple]:
    """(askers, points) of each leaf of a cell, and which they are."""
    if points is None:
        return
    leaf = points.column("leaf").to_numpy()
    marks = np.frombuffer(b"".join(queries.column("leaves").to_pylist()), np.uint8).reshape(queries.num_rows, -1)
    for n in np.unique(leaf):
        place = int(tree.homes[1][n])
        rows = np.flatnonzero(marks[:, place >> 3] & (128 >> (place & 7)))
        if len(rows):
            own = np.flatnonzero(leaf == n)
            yield queries.take(pa.array(rows)), points.take(pa.array(own)), rows, own


def _looked(located: DataFrame, blocks: DataFrame, tree: _Tree, k: int, grouped: bool, parts: int) -> DataFrame:
    """The askers with each radius tightened to the k-th distance found in the leaves next to them."""
    alphas = tree.alphas

    def run(queries: pa.Table, points: pa.Table | None) -> pa.RecordBatch:
        radii = _matrix(queries.column("radii").combine_chunks(), queries.num_rows).copy()
        slack = _matrix(queries.column("slack").combine_chunks(), queries.num_rows)
        for some, near, rows, _ in _by_leaf(queries, points, tree):
            for a, q, d in _kth(some, near, alphas, k, grouped):
                q = rows[q]
                radii[q, a] = np.minimum(radii[q, a], _upward(d + slack[q, a]))
        columns = [queries.column(c).combine_chunks() for c in ("id", "name", "x", "grp")]
        return pa.RecordBatch.from_arrays([*columns, _lists(radii)], ["id", "name", "x", "grp", "radii"])

    told = located.select("id", "name", "x", "grp")
    looked = _meeting(located, blocks, parts, run, f"{_schema(told)}, radii array<float>")
    radii = [F.min(F.get("radii", F.lit(i))) for i in range(len(alphas))]
    # Dealt out once: by the id, as the visits take them.
    return looked.repartition(parts, "id").groupBy("id", "name", "x", "grp").agg(F.array(*radii).alias("radii"))


def _answers(visits: DataFrame, blocks: DataFrame, tree: _Tree, k: int, grouped: bool, parts: int) -> DataFrame:
    """(query, edit, euclid, neighbour_id, label): some points of a cell visited, as lists of one length.

    They hold the k nearest of the cell for every alpha, each point once."""
    copy = blocks.schema["copies"].dataType.elementType
    id_, label = (copy[c].dataType.simpleString() for c in ("id", "label"))
    names = ["query", "edit", "euclid", "neighbour_id", "label"]

    def run(queries: pa.Table, points: pa.Table | None) -> pa.RecordBatch | None:
        found = []
        sizes = np.zeros(0, np.int64) if points is None else _copies(points)
        ends = sizes.cumsum()
        for some, near, rows, own in _by_leaf(queries, points, tree):
            copy = np.concatenate([np.arange(ends[o] - sizes[o], ends[o]) for o in own])
            found += [(a, rows[q], copy[c], e, u) for a, q, c, e, u in _met(some, near, tree.alphas, k, grouped)]
        if not sum(len(f[1]) for f in found):
            return None
        copies = pc.list_flatten(points.column("copies").combine_chunks())
        rank = np.empty(len(copies), np.int64)
        rank[pc.sort_indices(copies.field("id")).to_numpy()] = np.arange(len(copies))
        best = []
        for a, alpha in enumerate(tree.alphas):
            q, c, e, u = (np.concatenate([f[i] for f in found if f[0] == a]) for i in range(1, 5))
            order = np.lexsort((rank[c], _weighed(alpha, u, e), q))
            first = np.arange(len(q)) - np.searchsorted(q[order], q[order], side="left") < k
            best.append([x[order[first]] for x in (q, c, e, u)])
        q, c, e, u = (np.concatenate(x) for x in zip(*best))
        pair, first = np.unique(q * len(copies) + c, return_index=True)
        q, c = np.divmod(pair, len(copies))
        asked, starts = np.unique(q, return_index=True)
        ends = pa.array(np.append(starts, len(q)).astype(np.int32))
        lists = [pa.array(e[first].astype(np.int32)), pa.array(u[first]), *(copies.field(x).take(pa.array(c)) for x in ("id", "label"))]
        ids = queries.column("id").combine_chunks().take(pa.array(asked))
        return pa.RecordBatch.from_arrays([ids, *[pa.ListArray.from_arrays(ends, x) for x in lists]], names)

    query = f"query {visits.schema['id'].dataType.simpleString()}"
    kinds = f"edit array<int>, euclid array<double>, neighbour_id array<{id_}>, label array<{label}>"
    return _meeting(visits, blocks, parts, run, f"{query}, {kinds}")


# ---------------------------------------------------------------- answers of all leaves


def _by_query(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "query").sortWithinPartitions("query")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of some queries at a time, never a part of those of one; they come sorted by query."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("query")
        new = np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1
        if held and held[-1].column("query")[-1] != ids[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, new[-1])])
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(the different queries, the number of each row's)."""
    ids = table.column("query").combine_chunks()
    new = np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))
    return ids.take(pa.array(np.flatnonzero(new))), new.cumsum() - 1


def _ranked(table: pa.Table, number: np.ndarray, alphas: list[float], k: int) -> Iterator[tuple]:
    """(alpha, query, place, neighbour, distance) of the k nearest of whole queries, ties by id; a neighbour is a number in the lists laid end to end."""
    edit, euclid, ids = (pc.list_flatten(table.column(c).combine_chunks()) for c in ("edit", "euclid", "neighbour_id"))
    sizes = pc.fill_null(pc.list_value_length(table.column("edit").combine_chunks()), 0).to_numpy(zero_copy_only=False)
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    q = np.repeat(number, sizes)
    by_id = np.lexsort((rank, q))
    q, e, u = q[by_id], edit.to_numpy()[by_id], euclid.to_numpy()[by_id]
    starts = np.searchsorted(q, q, side="left")
    for a, alpha in enumerate(alphas):
        d = _weighed(alpha, u, e)
        order = np.lexsort((d, q))  # q is in order, and so stays where it is
        place = np.arange(len(q)) - starts
        kept = np.flatnonzero(place < k)
        order = order[kept]
        yield a, q[kept], place[kept], by_id[order], d[order]


def _places(answers: DataFrame, alphas: list[float], k: int, parts: int) -> DataFrame:
    """(query, alpha, place, neighbour_id, distance, label)."""
    names = ["query", "alpha", "place", "neighbour_id", "distance", "label"]
    query, id_, label = (answers.schema[c].dataType for c in ("query", "neighbour_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            asked, number = _numbered(table)
            ids, labels = (pc.list_flatten(table.column(c).combine_chunks()) for c in ("neighbour_id", "label"))
            for a, q, place, at, d in _ranked(table, number, alphas, k):
                at = pa.array(at)
                columns = [asked.take(pa.array(q)), pa.array(np.full(len(q), alphas[a])), pa.array((place + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, ids.take(at), pa.array(d), labels.take(at)], names)

    kinds = f"neighbour_id {id_.elementType.simpleString()}, distance double, label {label.elementType.simpleString()}"
    return _by_query(answers, parts).mapInArrow(run, f"query {query.simpleString()}, alpha double, place int, {kinds}")


def _elected(codes: np.ndarray, counts: Sequence[int]) -> np.ndarray:
    """queries x counts: the most frequent of the first codes of each row, the smallest on ties; -1 stands for none."""
    n, k = codes.shape
    out = np.full((n, len(counts)), -1)
    step = max(1, _PAIRS // (k * k))
    for lo in range(0, n, step):
        some = codes[lo : lo + step]
        # Of the first i + 1 places: how many have the code of place j.
        votes = (some[:, :, None] == some[:, None]).cumsum(1, dtype=np.int32)
        for c, count in enumerate(counts):
            last = min(count, k)
            rank = np.where(some[:, :last] < 0, -1, votes[:, last - 1, :last])
            best = rank.max(1, keepdims=True)
            least = np.where(rank == best, some[:, :last], np.iinfo(codes.dtype).max).min(1)
            out[lo : lo + step, c] = np.where(best[:, 0] > 0, least, -1)
    return out


def _voted(answers: DataFrame, truth: DataFrame, alphas: list[float], counts: Sequence[int], parts: int) -> DataFrame:
    """(truth, times, predicted): what the neighbours of the queries vote, for every alpha and count, beside what is true.

    Votes are taken where the answers meet, so no row for each query, alpha, count and label is ever made."""
    label, kind, k = answers.schema["label"].dataType, truth.schema["truth"].dataType, max(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            asked, number = _numbered(table)
            told = pc.is_valid(table.column("times")).combine_chunks().to_numpy(zero_copy_only=False)
            labels = pc.list_flatten(table.column("label").combine_chunks()).dictionary_encode(null_encoding="encode")
            order = pc.sort_indices(labels.dictionary, null_placement="at_start").to_numpy()
            code = np.empty(len(order), np.int64)
            code[order] = np.arange(len(order))
            code = code[labels.indices.to_numpy(zero_copy_only=False)]
            won = []
            for _, q, place, at, _ in _ranked(table, number, alphas, k):
                codes = np.full((len(asked), k), -1)
                codes[q, place] = code[at]
                won.append(_elected(codes, counts))
            won = np.concatenate(won, 1)
            rows = np.flatnonzero(told)
            rows = rows[(won[number[rows]] >= 0).any(1)]  # others have no neighbours
            won = won[number[rows]]
            names = labels.dictionary.take(pa.array(order)) if len(order) else labels.dictionary
            flat = names.take(pa.array(won.ravel(), mask=won.ravel() < 0))
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * won.shape[1])
            part = table.take(pa.array(rows))
            columns = [part.column(c).combine_chunks() for c in ("truth", "times")]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], ["truth", "times", "predicted"])

    both = answers.unionByName(truth, allowMissingColumns=True)
    return _by_query(both, parts).mapInArrow(run, f"truth {kind.simpleString()}, times bigint, predicted {label.simpleString()}")


# ---------------------------------------------------------------- the search


@dataclass
class _Search:
    """Queries and the leaves that they visit."""

    tree: _Tree
    asked: DataFrame  # every query
    askers: DataFrame  # the different ones, by their smallest id
    visits: DataFrame
    blocks: DataFrame
    grouped: bool
    parts: int


def _search(
    queries: DataFrame,
    train: DataFrame,
    columns: PointColumns,
    k: int,
    alphas: list[float],
    query_columns: PointColumns | None = None,
    pivots: int | None = None,
    block_rows: int = 256,
    more: Sequence[Column] = (),
) -> _Search:
    if not alphas:
        raise ValueError("there are no alphas")
    grouped = columns.group is not None
    asked = (query_columns or columns).points(queries, any(alphas), more)
    same = Window.partitionBy("name", "x", "grp").orderBy("id")
    points = (
        columns.points(train, any(alphas))
        .withColumn("copy", F.row_number().over(same))
        .where(F.col("copy") <= k)
        .groupBy("name", "x", "grp")
        # At most k of them.
        .agg(F.collect_list(F.struct("id", "label")).alias("copies"))
    )
    askers = asked.groupBy("name", "x", "grp").agg(F.min("id").alias("id"))
    many = askers.count()
    # The work of a row is far more than its bytes, by which Spark would join the tasks.
    parts = max(1, min(-(-many // 256), 4 * train.sparkSession.sparkContext.defaultParallelism), -(-many // 20_000))

    tree = _tree(points, alphas, block_rows, pivots)
    as_bytes = F.col("name").cast("binary")
    placed = _placed(points.withColumn("name", as_bytes).repartition(parts), tree)
    counted = _survey(placed, tree)
    tree.surveyed(counted.withColumn("n", F.col("others" if grouped else "all")).collect())
    # Copies of a cell share its askers out: some to keep all tasks busy, more where points are few beside askers.
    salts = max(1, min(4, -(-2 * parts // len(tree.cells))), min(-(-many // _VISITORS), 1 + many // tree.rows))
    salt = F.pmod(F.xxhash64("name", "x", "grp"), F.lit(salts)).cast("int")
    blocks = placed.select("cell", "leaf", "name", "x", "grp", "copies", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    located = _located(askers.withColumn("name", as_bytes).repartition(parts), tree, k).withColumn("salt", salt)
    looked = _looked(located, blocks, tree, k, grouped, parts)
    return _Search(tree, asked, askers, _visits(looked, tree).withColumn("salt", salt), blocks, grouped, parts)


def nearest_by_alpha(
    queries: DataFrame,
    train: DataFrame,
    columns: PointColumns,
    *,
    k: int,
    alphas: Sequence[float],
    query_columns: PointColumns | None = None,
    pivots: int | None = None,
    block_rows: int = 256,
) -> DataFrame:
    """(query_id, alpha, place, neighbour_id, distance, label): the k nearest training rows of
    every query for every alpha, ties by neighbour id.  One index and one visit join serve all.

    ``pivots``: how many cells; by itself the root of the number of leaves."""
    alphas = list(dict.fromkeys(map(float, alphas)))
    found = _search(queries, train, columns, k, alphas, query_columns, pivots, block_rows)
    answers = _answers(found.visits, found.blocks, found.tree, k, found.grouped, found.parts)
    answers = _places(answers, alphas, k, found.parts)
    return (
        found.asked.select(F.col("id").alias("query_id"), "name", "x", "grp")
        .join(found.askers.withColumnRenamed("id", "query"), ["name", "x", "grp"])
        .join(answers, "query")
        .select("query_id", "alpha", "place", "neighbour_id", "distance", "label")
    )


def nearest(
    queries: DataFrame,
    train: DataFrame,
    columns: PointColumns,
    *,
    k: int,
    alpha: float = 1.0,
    query_columns: PointColumns | None = None,
    pivots: int | None = None,
    block_rows: int = 256,
) -> DataFrame:
    """(query_id, place, neighbour_id, distance, label): the k nearest training rows of
    every query, ties by neighbour id."""
    return nearest_by_alpha(
        queries, train, columns, k=k, alphas=[alpha], query_columns=query_columns, pivots=pivots, block_rows=block_rows
    ).drop("alpha")


def vote(neighbours: DataFrame, counts: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(query_id, <by>, k, predicted): most frequent label among the first k, the smallest on ties."""
    ks = F.filter(
        F.array(*[F.lit(k) for k in counts]), lambda k: k >= F.col("place")
    )
    return (
        neighbours.select("query_id", *by, "label", F.explode(ks).alias("k"))
        .groupBy("query_id", *by, "k", "label")
        .agg(F.count(F.lit(1)).alias("votes"))
        .groupBy("query_id", *by, "k")
        .agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("predicted"))
    )


def predict_label(
    queries: DataFrame, train: DataFrame, columns: PointColumns, *, k: int, alpha: float = 1.0,
    query_columns: PointColumns | None = None,
) -> DataFrame:
    """(query_id, predicted)."""
    found = nearest(queries, train, columns, k=k, alpha=alpha, query_columns=query_columns)
    return vote(found, [k]).drop("k")


def _scores(
    queries: DataFrame, train: DataFrame, columns: PointColumns, alphas: Sequence[float], counts: Sequence[int],
    by: Sequence[Column] = (),
) -> DataFrame:
    """(<by>, alpha, k, accuracy); ``by`` are columns of ``queries``."""
    alphas, counts = list(dict.fromkeys(map(float, alphas))), list(dict.fromkeys(counts))
    actual = F.struct(quoted(columns.label).alias("actual"), F.struct(F.lit(0), *by).alias("by")).alias("truth")
    found = _search(queries, train, columns, max(counts), alphas, more=[actual])
    # Equal queries with one truth are one row.
    same = Window.partitionBy("name", "x", "grp")
    truth = (
        found.asked.where("id IS NOT NULL")
        .groupBy("name", "x", "grp", "truth")
        .agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("query"))
        .select(F.min("query").over(same).alias("query"), "truth", "times")
    )
    answers = _answers(found.visits, found.blocks, found.tree, max(counts), found.grouped, found.parts)
    voted = _voted(answers, truth, alphas, counts, found.parts)
    hit = F.col("actual") == F.col("predicted")
    scored = (
        voted.select(F.col("truth.actual").alias("actual"), F.col("truth.by").alias("by"), "times", F.posexplode("predicted").alias("at", "predicted"))
        .groupBy("by", "at")
        .agg(F.sum(F.when(hit, F.col("times")).when(~hit, 0)).alias("hits"), F.sum(F.when(hit.isNotNull(), F.col("times"))).alias("known"))
    )
    number = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    names = [f.name for f in scored.schema["by"].dataType.fields[1:]]
    return scored.select(
        *[F.col("by")[name].alias(name) for name in names],
        number(alphas, F.floor(F.col("at") / len(counts))).alias("alpha"),
        number(counts, F.col("at") % len(counts)).alias("k"),
        (F.col("hits") / F.col("known")).alias("accuracy"),
    )


def neighbour_grid(
    train: DataFrame,
    columns: PointColumns,
    *,
    alphas: Sequence[float] = NEIGHBOUR_ALPHAS,
    counts: Sequence[int] = NEIGHBOUR_COUNTS,
) -> DataFrame:
    """(fold, alpha, k, accuracy): every fold predicted from the other folds.

    ``columns.group`` is the fold.  One neighbour search serves all alphas, folds and k.
    """
    if columns.group is None or columns.label is None:
        raise ValueError("the grid needs a label and a fold column")
    fold = quoted(columns.group).cast("int").alias("fold")
    return _scores(train, train, columns, alphas, counts, [fold]).select("fold", "alpha", "k", "accuracy")


def best_neighbour_settings(scores: DataFrame) -> DataFrame:
    """(fold, alpha, k, accuracy): the best setting of every fold."""
    return best_of_grid(scores, ["fold"], "accuracy", ["alpha", "k"])


def cross_validated_neighbours(
    train: DataFrame,
    test: DataFrame,
    columns: PointColumns,
    *,
    alphas: Sequence[float] = NEIGHBOUR_ALPHAS,
    counts: Sequence[int] = NEIGHBOUR_COUNTS,
) -> DataFrame:
    """(fold, alpha, k, validation, test): tune on each fold, then score on the test rows
    with all training rows as neighbours."""
    best = best_neighbour_settings(neighbour_grid(train, columns, alphas=alphas, counts=counts))
    plain = PointColumns(columns.row_id, columns.name, columns.stats, columns.label)
    tested = _scores(test, train, plain, alphas, counts).withColumnRenamed("accuracy", "test")
    return best.withColumnRenamed("accuracy", "validation").join(tested, ["alpha", "k"], "left").select(
        "fold", "alpha", "k", "validation", "test"
    )
