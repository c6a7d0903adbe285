"""All forests of a grid from the trees of its largest one.

A tree hangs on the seed, its fold and its number only, and every level draws its features
anew.  So the forest of n trees is the first n of those of a larger one, and a tree of depth
d is a deeper one cut off at d: one fit of the most trees to the largest depth holds every
grid point of a fold.

Rows are held in bins of one byte in every task, which grows whole trees and sends all rows
down with them; what it returns are sums of votes.  Trees themselves are grown again for a
model that is asked for.
"""

from __future__ import annotations

import base64
import io
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import SEED
from colprism.functions.cells import quoted
from colprism.plans.gridfit import _unwrapped

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

_BINS = 32
#: Rows that the borders of the bins are told from, about.
_SAMPLE = 1 << 16
#: Bytes of rows and votes that a task may hold.
HELD = 256 << 20
_BLOCK = 1 << 17
_ROWS = 8192


@dataclass(frozen=True)
class Forest:
    """One grid point."""

    trees: int
    depth: int


# ---------------------------------------------------------------- bins


def borders(rows: int, indices: np.ndarray, values: np.ndarray, size: int) -> list[np.ndarray]:
    """Of each feature: what divides its bins, at most ``_BINS`` of about as many rows; cells not given are 0."""
    order = np.lexsort((values, indices))
    indices, values = indices[order], values[order]
    ends = np.searchsorted(indices, np.arange(size + 1))
    out = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        own = values[lo:hi][~np.isnan(values[lo:hi])]
        some, many = np.unique(np.append(own, 0.0) if hi - lo < rows else own, return_counts=True)
        if hi - lo < rows:
            many[np.searchsorted(some, 0.0)] += rows - (hi - lo) - 1
        between = (some[:-1] + some[1:]) / 2
        if len(some) > _BINS:
            held = many.cumsum()
            at = np.searchsorted(held, held[-1] * np.arange(1, _BINS) / _BINS)
            between = between[np.unique(np.minimum(at, len(between) - 1))]
        out.append(between)
    return out


def _in_bins(edges: list[np.ndarray], used: np.ndarray, indices: pa.Array, values: pa.Array) -> np.ndarray:
    """rows x used features."""
    sizes = np.diff(indices.offsets.to_numpy())
    zero = np.array([np.searchsorted(edges[f], 0.0) for f in used], np.uint8)
    out = np.tile(zero, (len(indices), 1))
    place = np.full(len(edges) + 1, -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(indices)), sizes)
    which, value = np.minimum(indices.flatten().to_numpy(), len(edges)), values.flatten().to_numpy()
    for f in np.unique(which):
        if place[f] >= 0:
            cells = np.flatnonzero(which == f)
            out[row[cells], place[f]] = np.searchsorted(edges[f], value[cells])
    return out


# ---------------------------------------------------------------- a tree


@dataclass
class Tree:
    """Nodes by number; a leaf has no feature (-1).  The second child follows the first."""

    feature: np.ndarray
    bin: np.ndarray  # rows up to this one go to the first child
    child: np.ndarray
    share: np.ndarray  # nodes x classes


def grown(
    x: np.ndarray, bins: np.ndarray, target: np.ndarray, weight: np.ndarray, classes: int, cuts: Sequence[int], votes: np.ndarray | None,
    draw: np.random.Generator, keep: bool = False,
) -> Tree | None:
    """Grows a tree to the last of the depths ``cuts`` by Gini's index; adds to ``votes`` (cuts x rows x classes - 1) what it says at each."""
    n, width = x.shape
    flat, few = np.ascontiguousarray(x).ravel(), math.isqrt(max(width - 1, 0)) + 1
    bag = np.flatnonzero(weight)
    rest = np.flatnonzero(weight == 0) if votes is not None else bag[:0]
    w, t = weight[bag].astype(float), target[bag].astype(np.int64)
    total = np.bincount(t, w, classes)[None]
    told = np.tile((total / total.sum())[0, 1:], (n if votes is not None else 0, 1))
    bag_node, rest_node = np.zeros(len(bag), np.int64), np.zeros(len(rest), np.int64)
    nodes = [(np.array([-1]), np.array([0]), np.array([0]), total)]
    numbers = np.array([0])  # of the nodes at work
    open_ = total.max(1) < total.sum(1)
    if not open_[0]:
        numbers, total, bag, rest = numbers[:0], total[:0], bag[:0], rest[:0]
    made = 1
    for level in range(cuts[-1] + 1):
        if level in cuts and votes is not None:
            votes[cuts.index(level)] += told
        if level == cuts[-1] or not len(numbers) or not width:
            if votes is not None:
                for later in range(level + 1, cuts[-1] + 1):
                    if later in cuts:
                        votes[cuts.index(later)] += told
            break
        # Each node has features of its own.
        many = len(numbers)
        feature = np.argpartition(draw.random((many, width), np.float32), min(few, width) - 1, axis=1)[:, : min(few, width)]
        base = bag * width
        best, parent = np.full(many, -1.0), (total * total).sum(1) / total.sum(1)
        split, at, left_of = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros_like(total)
        for slot in range(feature.shape[1]):
            mine = feature[:, slot]
            wide = bins[mine]
            starts = wide.cumsum() - wide
            key = starts.take(bag_node)
            key += flat.take(base + mine.take(bag_node))
            key *= classes
            key += t
            left = np.bincount(key, w, int(wide.sum()) * classes).reshape(-1, classes)
            here = left[starts]
            left = left.cumsum(0)
            node = np.repeat(np.arange(many), wide)
            left -= (left[starts] - here).take(node, 0)
            right = total.take(node, 0) - left
            a, b = left.sum(1), right.sum(1)
            apart = (a > 0) & (b > 0)
            a[~apart] = b[~apart] = 1
            score = np.where(apart, (left * left).sum(1) / a + (right * right).sum(1) / b, -1.0)
            top = np.maximum.reduceat(score, starts)
            better = top > best
            first = np.flatnonzero(score == top.take(node))
            _, one = np.unique(node[first], return_index=True)
            cell = first[one][better]
            best[better], split[better], at[better], left_of[better] = top[better], mine[better], cell - starts[better], left[cell]
        parted = best > parent * (1 + 1e-12)
        old = np.flatnonzero(parted)
        child = np.empty((2 * len(old), classes))
        child[0::2], child[1::2] = left_of[old], total[old] - left_of[old]
        if keep:
            f, b, c, _ = nodes[-1]
            f[numbers[old] - (made - len(f))], b[numbers[old] - (made - len(f))] = split[old], at[old]
            c[numbers[old] - (made - len(f))] = made + 2 * np.arange(len(old))
            nodes.append((np.full(len(child), -1), np.zeros(len(child), np.int64), np.zeros(len(child), np.int64), child))
        first_child = np.full(many, -1)
        first_child[old] = 2 * np.arange(len(old))
        share = child[:, 1:] / child.sum(1, keepdims=True)
        open_ = child.max(1) < child.sum(1)
        new = np.where(open_, open_.cumsum() - 1, -1)
        for which in range(2):
            rows, node = (bag, bag_node) if not which else (rest, rest_node)
            to = first_child.take(node)
            on = np.flatnonzero(to >= 0)
            if len(on) < len(rows):
                rows, node, to = rows[on], node[on], to[on]
                if not which:
                    w, t = w[on], t[on]
            to = to + (flat.take(rows * width + split.take(node)) > at.take(node))
            if votes is not None:
                told[rows] = share.take(to, 0)
            node = new.take(to)
            on = np.flatnonzero(node >= 0)
            if len(on) < len(rows):
                rows, node = rows[on], node[on]
                if not which:
                    w, t = w[on], t[on]
            if which:
                rest, rest_node = rows, node
            else:
                bag, bag_node = rows, node
        numbers = made + np.flatnonzero(open_)
        made += len(child)
        total = child[open_]
    if not keep:
        return None
    feature, bin_, child, total = (np.concatenate(x) for x in zip(*nodes))
    return Tree(feature, bin_, child, total / total.sum(1, keepdims=True))


# ---------------------------------------------------------------- all forests


@dataclass
class _Held:
    """What every task holds: rows in order of a hash of their ids."""

    x: np.ndarray  # rows x used features
    bins: np.ndarray
    target: np.ndarray  # class number, -1: of no class that is learnt, -2: without label
    fold: np.ndarray  # -1: hold-out, -2: none
    choosing: np.ndarray  # 1: yes, 0: no, 2: neither
    classes: int

    def tree(self, fold: int, number: int, cuts: Sequence[int], votes: np.ndarray | None, keep: bool = False) -> Tree | None:
        """Each row outside the fold that does not choose is taken as often as Poisson says."""
        draw = np.random.Generator(np.random.PCG64([SEED, fold, number]))
        learns = (self.fold >= 0) & (self.fold != fold) & (self.choosing == 0) & (self.target >= 0)
        weight = np.zeros(len(self.x), np.int64)
        weight[learns] = draw.poisson(1.0, int(learns.sum()))
        if not weight.any():
            weight[learns] = 1
        if not weight.any():
            raise ValueError("there are no rows to learn from")
        return grown(self.x, self.bins, self.target, weight, self.classes, cuts, votes, draw, keep)


@dataclass
class ForestFit:
    """``hits``: points x folds x (choosing, other than the fold, the fold, hold-out) x (hits, rows)."""

    spark: SparkSession
    held: Broadcast
    forests: list[Forest]
    labels: list[float]
    edges: list[np.ndarray]
    used: np.ndarray
    folds: int
    hits: np.ndarray

    def model(self, point: int, fold: int, features: str = "features") -> ForestModel:
        """Grows the trees of one grid point again, in tasks."""
        forest, held, used = self.forests[point], self.held, self.used
        parts = min(forest.trees, 4 * self.spark.sparkContext.defaultParallelism)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    tree = _Held(*held.value).tree(fold, number, [forest.depth], None, keep=True)
                    told = io.BytesIO()
                    feature = np.where(tree.feature >= 0, used[tree.feature], -1) if len(used) else tree.feature
                    np.savez(told, feature=feature.astype(np.int32), bin=tree.bin.astype(np.uint8), child=tree.child.astype(np.int32), share=tree.share[:, 1:])
                    yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([told.getvalue()], pa.binary())], ["id", "tree"])

        rows = self.spark.range(0, forest.trees, 1, parts).mapInArrow(run, "id bigint, tree binary").collect()
        trees = [base64.b64encode(r["tree"]).decode() for r in sorted(rows, key=lambda r: r["id"])]
        return ForestModel(trees=trees, borders=[e.tolist() for e in self.edges], classes=list(self.labels), featuresCol=features)


class Models(Sequence):
    """The chosen forest of every fold, grown when it is asked for."""

    def __init__(self, fit: ForestFit, points: list[int]):
        self._fit, self._points, self._made = fit, points, {}

    def __len__(self) -> int:
        return len(self._points)

    def __getitem__(self, fold):
        if isinstance(fold, slice):
            return [self[f] for f in range(len(self))[fold]]
        fold = range(len(self))[fold]
        if fold not in self._made:
            self._made[fold] = self._fit.model(self._points[fold], fold)
        return self._made[fold]


def _table(data: DataFrame, row_id: str, label: str, fold: Column, choosing: Column) -> DataFrame:
    return data.select(
        F.xxhash64(quoted(row_id)).alias("hash"), quoted(label).cast("double").alias("label"), F.coalesce(fold.cast("int"), F.lit(-2)).alias("fold"),
        F.coalesce(choosing.cast("int"), F.lit(2)).alias("choosing"), *_unwrapped(quoted("features")),
    )


def fit_forests(
    data: DataFrame, forests: Sequence[Forest], row_id: str, label: str, fold: str, folds: int, choosing: Column, holdout: DataFrame | None
) -> ForestFit | None:
    """Every forest in every fold; None where rows and votes are more than ``HELD`` bytes a task.

    Borders of bins are told from some of the rows, as Spark's forests tell theirs."""
    spark = data.sparkSession
    table = _table(data, row_id, label, quoted(fold), choosing)
    if holdout is not None:
        table = table.unionByName(_table(holdout, row_id, label, F.lit(-1), F.lit(False)))
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        told = table.agg(
            F.sort_array(F.collect_set(F.when(F.col("fold") >= 0, F.col("label")))).alias("classes"),
            F.coalesce(F.max("width"), F.lit(0)).alias("width"), F.count(F.lit(1)).alias("n"),
        ).first()
        labels, size, n = list(told["classes"]), told["width"], told["n"]
        cuts = sorted({f.depth for f in forests})
        if n * (size + 8 * len(cuts) * max(1, len(labels) - 1) + 16) > HELD:
            return None
        one_in = max(1, n // _SAMPLE)
        sample = table.where((F.col("fold") >= 0) & (F.pmod(F.xxhash64("hash"), F.lit(one_in)) == 0)).select("indices", "values").toArrow()
        lists = [sample.column(c).combine_chunks() for c in ("indices", "values")]
        edges = borders(sample.num_rows, *(x.flatten().to_numpy() for x in lists), size)
        held, used = _collected(table, labels, edges)
    finally:
        table.unpersist()
    sent = spark.sparkContext.broadcast(held)  # plain arrays: executors need not have this package
    fit = ForestFit(spark, sent, list(forests), labels, edges, used, folds, np.zeros((len(forests), folds, 4, 2)))
    for at, hits in _scored(spark, sent, fit.forests, folds, cuts):
        fit.hits[:, at] += hits
    return fit


def _collected(table: DataFrame, labels: list[float], edges: list[np.ndarray]) -> tuple[tuple, np.ndarray]:
    """The parts of ``_Held`` for all rows, and which features have more than one bin."""
    used = np.flatnonzero([len(e) > 0 for e in edges])
    classes = np.array(labels, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                label = part.column("label").to_numpy(zero_copy_only=False)
                target = np.searchsorted(classes, label)
                found = classes[np.minimum(target, len(classes) - 1)] == label if len(classes) else np.zeros(len(label), bool)
                target = np.where(np.isnan(label), -2, np.where(found, target, -1)).astype(np.int32)
                x = _in_bins(edges, used, part.column("indices"), part.column("values"))
                cells = [part.column("hash").to_numpy(), target, part.column("fold").to_numpy(), part.column("choosing").to_numpy().astype(np.int8), x]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells], list("abcde"))

    blobs = table.mapInArrow(run, "a binary, b binary, c binary, d binary, e binary").toArrow()
    joined = lambda c, kind: np.frombuffer(b"".join(blobs.column(c).to_pylist()), kind)
    hashes, x = joined("a", np.int64), joined("e", np.uint8)
    x = x.reshape(len(hashes), len(used))
    order = np.lexsort((joined("b", np.int32), hashes))
    bins = np.array([len(edges[f]) + 1 for f in used], np.int64)
    return (x[order], bins, joined("b", np.int32)[order], joined("c", np.int32)[order], joined("d", np.int8)[order], len(labels)), used


def _batches_of(forests: list[Forest], folds: int, parallel: int) -> list[tuple[int, int, int]]:
    """(fold, first tree, end): some trees at a time, with an end at each number of trees of the grid."""
    most = max(f.trees for f in forests)
    step = max(1, -(-most * folds // (4 * parallel)))
    ends = sorted({f.trees for f in forests})
    out = [(f, lo, min(lo + step, hi)) for first, hi in zip([0, *ends], ends) for lo in range(first, hi, step) for f in range(folds)]
    return sorted(out, key=lambda b: b[1] - b[2])  # the longest first


def _scored(spark: SparkSession, sent: Broadcast, forests: list[Forest], folds: int, cuts: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(fold, points x sets x (hits, rows)) of some rows at a time."""
    work = _batches_of(forests, folds, spark.sparkContext.defaultParallelism)
    trees = sorted({f.trees for f in forests})
    known = _Held(*sent.value)
    n, block = len(known.x), max(1, _BLOCK // (len(cuts) * max(1, known.classes - 1)))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(*sent.value)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                fold, first, end = work[i]
                votes = np.zeros((len(cuts), n, held.classes - 1))
                for number in range(first, end):
                    held.tree(fold, number, cuts, votes)
                for lo in range(0, n, block):
                    cells = pa.array([votes[:, lo : lo + block].tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (fold, lo // block, first)), cells], ["fold", "block", "first", "votes"])

    def count(group: pa.Table) -> pa.Table:
        held = _Held(*sent.value)
        fold, at = group.column("fold")[0].as_py(), group.column("block")[0].as_py()
        some = slice(at * block, (at + 1) * block)
        target, of = held.target[some], held.fold[some]
        sets = np.stack([(of >= 0) & (of != fold) & (held.choosing[some] == 1), (of >= 0) & (of != fold), of == fold, of == -1]) & (target != -2)
        out = np.zeros((len(forests), 4, 2))
        out[..., 1] = sets.sum(1)
        parts = sorted(zip(group.column("first").to_pylist(), group.column("votes")), key=lambda p: p[0])
        votes = np.zeros((len(cuts), len(target), held.classes - 1))
        for many in trees:
            while parts and parts[0][0] < many:
                votes += np.frombuffer(parts.pop(0)[1].as_buffer()).reshape(votes.shape)
            every = np.concatenate([many - votes.sum(2, keepdims=True), votes], 2)
            hit = every.argmax(2) == target
            for p, f in enumerate(forests):
                if f.trees == many:
                    out[p, :, 0] = (sets & hit[cuts.index(f.depth)]).sum(1)
        return pa.table([pa.array([fold], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["fold", "hits"])

    grew = spark.range(0, len(work), 1, len(work)).mapInArrow(grow, "fold int, block int, first int, votes binary")
    for row in grew.groupBy("fold", "block").applyInArrow(count, "fold int, hits binary").collect():
        yield row["fold"], np.frombuffer(row["hits"]).reshape(len(forests), 4, 2)


# ---------------------------------------------------------------- one forest


class ForestModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A grown forest as a pipeline stage that can be saved; adds the predicted label."""

    trees = Param(Params._dummy(), "trees", "nodes of each tree as npz in base 64", typeConverter=TypeConverters.toListString)
    borders = Param(Params._dummy(), "borders", "what divides the bins of each feature", typeConverter=TypeConverters.identity)
    classes = Param(Params._dummy(), "classes", "labels in order", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, trees=None, borders=None, classes=None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(trees=[], borders=[], classes=[], featuresCol="features", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        labels = np.array(self.getOrDefault(self.classes), float)
        edges = [np.array(e, float) for e in self.getOrDefault(self.borders)]
        sent = dataset.sparkSession.sparkContext.broadcast([base64.b64decode(t) for t in self.getOrDefault(self.trees)])

        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            x = _in_bins(edges, np.arange(len(edges)), indices, values)
            votes = np.zeros((len(x), len(labels) - 1))
            for told in sent.value:
                tree = np.load(io.BytesIO(told))
                feature, border, child, share = (tree[c] for c in ("feature", "bin", "child", "share"))
                node = np.zeros(len(x), np.int64)
                rows = np.flatnonzero(feature[node] >= 0)
                while len(rows):
                    at = node[rows]
                    node[rows] = child[at] + (x[rows, feature[at]] > border[at])
                    rows = rows[feature[node[rows]] >= 0]
                votes += share[node]
            every = np.concatenate([len(sent.value) - votes.sum(1, keepdims=True), votes], 1)
            return pa.array(labels[every.argmax(1)])

        indices, values, _ = _unwrapped(quoted(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), F.arrow_udf(score, T.DoubleType())(indices, values))
