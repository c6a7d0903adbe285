"""All points of a model grid, in all folds, fitted in the passes of one fit.

Linear machines (multinomial logistic regression, hinge loss) and the radial machine
in random Fourier features.  A pass over the rows sums the losses and gradients of
every grid point and fold; each of them then takes its own step of L-BFGS.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.functions.cells import quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Random Fourier features of the radial machine.
FOURIER = 256
_ROWS = 512
_BYTES = 8 << 20
_FAN = 8
_MEMORY = 10
#: The hinge is rounded off over these, one after the other.
_WIDTHS = (0.5, 0.05, 0.005)


@dataclass(frozen=True)
class Machine:
    """One grid point: "logistic" or "svm", its C, and gamma for the radial kernel."""

    kind: str
    c: float
    gamma: float | None = None
    iterations: int = 100


# ---------------------------------------------------------------- rows


@dataclass
class Rows:
    """Prepared rows: target (class number), fold, choosing, indices, values."""

    table: DataFrame
    classes: list[float]
    size: int
    folds: int
    parts: int


def _unwrapped(features: Column) -> list[Column]:
    """indices and values of a vector; those of a dense one are numbered here."""
    v = F.unwrap_udt(features)
    every = F.sequence(F.lit(0), F.size(v["values"]) - 1)
    numbers = F.when(v["indices"].isNotNull(), v["indices"]).when(F.size(v["values"]) > 0, every).otherwise(F.array().cast("array<int>"))
    return [numbers.alias("indices"), v["values"].alias("values"), F.coalesce(v["size"], F.size(v["values"])).alias("width")]


def prepared(data: DataFrame, label: str, fold: str, choosing: Column, features: str, classes: Sequence[float] | None = None) -> Rows:
    """Rows in as many cached partitions as their bytes ask for, however many those of ``data`` are."""
    rows = data.select(
        quoted(label).cast("double").alias("label"), quoted(fold).cast("int").alias("fold"), choosing.alias("choosing"), *_unwrapped(quoted(features))
    )
    told = rows.agg(
        F.sort_array(F.collect_set("label")).alias("classes"),
        F.max("width").alias("width"),
        F.max("fold").alias("fold"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.size("values")).alias("cells"),
    ).first()
    names = list(told["classes"] if classes is None else classes)
    target = F.array_position(F.array(*[F.lit(float(c)) for c in names] or [F.lit(0.0)]), F.col("label")) - 1
    parts = _parts(told["cells"], told["n"])
    table = rows.select(target.cast("int").alias("target"), "fold", "choosing", "indices", "values").repartition(parts)
    return Rows(table.persist(StorageLevel.MEMORY_AND_DISK), names, told["width"] or 0, (told["fold"] or 0) + 1, parts)


def compact(rows: DataFrame, row_id: str, features: str = "features") -> DataFrame:
    """The rows, cached, in as many partitions as their bytes ask for and in the order of their ids.

    What a tree grows on is summed by partition, so each of them costs its sums for every node.
    """
    wide = rows.persist(StorageLevel.MEMORY_AND_DISK)
    _, values, _ = _unwrapped(quoted(features))
    told = wide.select(values).agg(F.sum(F.size("values")).alias("cells"), F.count(F.lit(1)).alias("n")).first()
    parts = _parts(told["cells"], told["n"])
    near = wide.repartition(parts, quoted(row_id)).sortWithinPartitions(quoted(row_id)).persist(StorageLevel.MEMORY_AND_DISK)
    near.count()
    wide.unpersist()
    return near


def _parts(cells: int | None, rows: int) -> int:
    return max(1, math.ceil(((cells or 0) * 12 + rows * 32) / _BYTES))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(target, fold, choosing, the features that occur, their dense matrix) of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            target, fold, choosing = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = np.diff(np.asarray(part.column(3).offsets))
            which, place = np.unique(part.column(3).flatten().to_numpy(), return_inverse=True)
            x = np.zeros((part.num_rows, len(which)))
            x[np.repeat(np.arange(part.num_rows), sizes), place] = part.column(4).flatten().to_numpy()
            yield target, fold, choosing.astype(bool), which, x


def tree_sum(parts: DataFrame, n: int) -> np.ndarray:
    """The sum of the vectors in ``parts`` (one row per partition: part int, v binary).

    ``_FAN`` vectors are added in a task, level by level, so the driver gets ``_FAN`` at most.
    """
    while n > _FAN:
        n = math.ceil(n / _FAN)
        parts = parts.select((F.col("part") % n).alias("part"), "v").repartition(n, "part").mapInArrow(_added, parts.schema)
    vectors = [np.frombuffer(r["v"]) for r in parts.collect()]
    return np.sum(vectors, axis=0) if vectors else np.zeros(0)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            one = np.frombuffer(v.as_buffer())
            sums[part] = sums[part] + one if part in sums else one
    for part, v in sums.items():
        yield _vector(part, v)


def _vector(part: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["part", "v"])


def summed(rows: Rows, step: Callable[[Iterator[tuple]], np.ndarray | None]) -> np.ndarray:
    """The sum over all partitions of what ``step`` makes of the blocks of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = step(_blocks(batches))
        if v is not None:
            yield _vector(TaskContext.get().partitionId(), v)

    return tree_sum(rows.table.mapInArrow(run, "part int, v binary"), rows.parts)


# ---------------------------------------------------------------- features of a gamma


@dataclass(frozen=True)
class Fourier:
    """cos(sqrt(2 gamma) x.w + b) for normal w and even b: their products approach exp(-gamma |x - y|^2)."""

    weights: np.ndarray
    shifts: np.ndarray

    @classmethod
    def drawn(cls, size: int, n: int = FOURIER, seed: int = 1) -> Fourier:
        draw = np.random.Generator(np.random.PCG64(seed))
        return cls(draw.standard_normal((size, n)), draw.random(n) * 2 * np.pi)

    def turned(self, which: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[which]

    def of(self, turned: np.ndarray, gamma: float) -> np.ndarray:
        return np.cos(math.sqrt(2 * gamma) * turned + self.shifts) * math.sqrt(2 / len(self.shifts))


@dataclass
class Family:
    """The models that share one feature map: grid points of one kind and gamma, times folds."""

    kind: str
    gamma: float | None
    points: list[int]  # places in the grid
    c: np.ndarray
    inputs: int
    outputs: int

    def matrix(
        self, which: np.ndarray, x: np.ndarray, scale: np.ndarray, fourier: Fourier | None, turned: np.ndarray | None = None
    ) -> tuple[np.ndarray | slice, np.ndarray]:
        """(places of the inputs, rows x inputs); ``turned`` is the same for every gamma."""
        if self.gamma is None:
            return which, x / scale[which]
        return slice(None), fourier.of(fourier.turned(which, x) if turned is None else turned, self.gamma)


def _losses(kind: str, z: np.ndarray, target: np.ndarray, classes: int, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Losses and slopes of scores (rows x models x outputs); a logistic model has one loss for its outputs together.

    The hinge is rounded off over ``width`` (models x outputs), which changes it by half of that at most.
    """
    n = len(target)
    if kind == "logistic":
        top = z.max(2, keepdims=True)
        e = np.exp(z - top)
        total = e.sum(2, keepdims=True)
        loss = np.log(total) + top - z[np.arange(n), :, target][..., None]
        slope = e / total
        slope[np.arange(n), :, target] -= 1
        return loss, slope
    # One machine per class; a single one tells two classes apart.
    sign = np.full((n, 1, z.shape[2]), -1.0)
    if z.shape[2] == 1:
        sign[target == classes - 1] = 1
    else:
        sign[np.arange(n), 0, target] = 1
    short = np.maximum(0.0, 1 - sign * z)
    round_ = np.minimum(short, width)
    return short - round_ + round_ * round_ / (2 * width), -sign * round_ / width


def _scores(a: np.ndarray, w: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """rows x models x outputs for weights (models x inputs + 1 x outputs); the last input is the constant."""
    models, _, outputs = w.shape
    flat = w[:, :-1][:, at].transpose(1, 0, 2).reshape(a.shape[1], models * outputs)
    return (a @ flat).reshape(len(a), models, outputs) + w[:, -1]


Sent = tuple[np.ndarray, np.ndarray, np.ndarray]


def _step(families: list[Family], sent: list[Sent], folds: int, classes: int, scale: np.ndarray, fourier: Fourier | None):
    """Sums of losses and slopes of some models of a partition, family after family, for their (numbers, weights, widths)."""
    asked = [(f, *s) for f, s in zip(families, sent) if len(s[0])]

    def run(blocks: Iterator[tuple]) -> np.ndarray | None:
        sums = None
        for target, fold, choosing, which, x in blocks:
            if sums is None:
                sums = [(np.zeros((w.shape[0], 1 if f.kind == "logistic" else w.shape[2])), np.zeros_like(w)) for f, _, w, _ in asked]
            learning = ~choosing & (target >= 0)
            target, fold, x = target[learning], fold[learning], x[learning]
            learns = fold[:, None] != np.arange(folds)
            turned = fourier.turned(which, x) if any(f.gamma is not None for f, *_ in asked) else None
            for (family, number, w, width), (loss_sum, slope_sum) in zip(asked, sums):
                at, a = family.matrix(which, x, scale, fourier, turned)
                mask = learns[:, number % folds][:, :, None]  # models are ordered point by point, fold by fold
                loss, slope = _losses(family.kind, _scores(a, w, at), target, classes, width)
                loss_sum += (loss * mask).sum(0)
                slope *= mask
                part = (a.T @ slope.reshape(len(a), -1)).reshape(a.shape[1], *slope.shape[1:])
                slope_sum[:, :-1][:, at] += part.transpose(1, 0, 2)
                slope_sum[:, -1] += slope.sum(0)
        return None if sums is None else np.concatenate([v.ravel() for pair in sums for v in pair])

    return run


# ---------------------------------------------------------------- L-BFGS, one per model


class Descent:
    """L-BFGS with halving steps of one function, told a value and gradient at a time.

    ``widths``: how far the function is rounded off, coarse to fine; each begins where the
    one before ended, and they share the steps.
    """

    def __init__(self, start: np.ndarray, tolerance: float, steps: int, widths: Sequence[float]):
        self.tolerance, self.most, self.widths = tolerance, -(-steps // len(widths)), list(widths)
        self._begin(start)

    def _begin(self, start: np.ndarray) -> None:
        self.x, self.at, self.width = start, start, self.widths.pop(0)
        self.f, self.g, self.direction = None, None, None
        self.steps = self.most
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.taken, self.halvings, self.length, self.done = 0, 0, 1.0, False

    def tell(self, f: float, g: np.ndarray) -> None:
        """What the function is at ``at``; chooses the next ``at``, or is ``done``."""
        if not self.done:
            self._move(f, g)
            if self.done and self.widths:
                self._begin(self.x)

    def _move(self, f: float, g: np.ndarray) -> None:
        if self.f is not None:
            slope = float(self.g @ self.direction)
            if f > self.f + 1e-4 * self.length * slope:
                self.halvings += 1
                self.length /= 2
                if self.halvings > 30:
                    self.done = True
                self.at = self.x + self.length * self.direction
                return
            s, y = self.at - self.x, g - self.g
            if s @ y > 1e-12 * (y @ y):
                self.pairs = [*self.pairs, (s, y)][-_MEMORY:]
            better = (self.f - f) / max(abs(f), abs(self.f), 1e-12)
            self.taken += 1
            if better < self.tolerance or self.taken >= self.steps:
                self.x, self.f, self.g, self.done = self.at, f, g, True
                return
        self.x, self.f, self.g = self.at, f, g
        self.direction, self.length, self.halvings = -self._bent(g), 1.0, 0
        if float(g @ self.direction) >= 0:
            self.pairs, self.direction = [], -g
        if not self.pairs:
            self.length = 1 / max(1.0, float(np.abs(g).sum()))
        if not np.any(g):
            self.done = True
        self.at = self.x + self.length * self.direction

    def _bent(self, g: np.ndarray) -> np.ndarray:
        q, used = g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        return q


@dataclass
class GridFit:
    """Weights of every grid point and fold, and how they were got."""

    machines: list[Machine]
    classes: list[float]
    folds: int
    families: list[Family]
    weights: list[np.ndarray]  # of each family: models x (inputs + 1) x outputs, on features as given
    fourier: Fourier | None
    passes: int

    def place(self, point: int, fold: int) -> tuple[int, int]:
        """(family, model) of a grid point in a fold."""
        for i, family in enumerate(self.families):
            if point in family.points:
                return i, family.points.index(point) * self.folds + fold
        raise KeyError(point)


def fit_grid(
    rows: Rows, machines: Sequence[Machine], tolerance: float = 1e-7, fourier: int = FOURIER
) -> GridFit:
    """Every machine fitted on the rows outside each fold that do not choose.

    The loss is the mean over those rows plus |w|^2 / (2 C n), the constant left out; it
    is brought down in features divided by their deviation, which changes the way and not
    the end.  The weights of all models travel with each pass: grid points x folds x
    inputs x outputs doubles; with a gamma also size x ``fourier`` doubles, once.
    """
    classes, folds = len(rows.classes), rows.folds
    groups: dict[tuple[str, float | None], list[int]] = {}
    for i, m in enumerate(machines):
        groups.setdefault((m.kind, m.gamma), []).append(i)
    families = []
    for (kind, gamma), points in groups.items():
        outputs = classes if kind == "logistic" or classes > 2 else 1
        inputs = rows.size if gamma is None else fourier
        families.append(Family(kind, gamma, points, np.array([machines[p].c for p in points]), inputs, outputs))
    map_ = Fourier.drawn(rows.size, fourier) if any(f.gamma is not None for f in families) else None
    size = rows.size

    def moments(blocks: Iterator[tuple]) -> np.ndarray | None:
        total = np.zeros((3, size))
        counts = np.zeros(folds)
        for target, fold, choosing, which, x in blocks:
            total[0, which] += x.sum(0)
            total[1, which] += (x * x).sum(0)
            total[2] += len(x)
            counts += ((fold[:, None] != np.arange(folds)) & ~choosing[:, None] & (target >= 0)[:, None]).sum(0)
        return np.concatenate([total.ravel(), counts])

    told = summed(rows, moments)
    if not len(told) or classes < 1:
        raise ValueError("there are no rows to learn from")
    n = np.maximum(told[3 * size :], 1)
    one, two, every = told[: 3 * size].reshape(3, size)
    deviation = np.sqrt(np.maximum(two / np.maximum(every, 1) - (one / np.maximum(every, 1)) ** 2, 0))
    scale = np.where(deviation > 0, deviation, 1.0)

    descents: list[list[list[Descent]]] = []  # of each family, of each model, of each output or of all together
    for family in families:
        together = family.kind == "logistic"
        width = (family.inputs + 1) * (family.outputs if together else 1)
        widths = [0.0] if together else _WIDTHS
        each = 1 if together else family.outputs
        steps = [machines[p].iterations for p in family.points for _ in range(folds)]
        descents.append([[Descent(np.zeros(width), tolerance, n, widths) for _ in range(each)] for n in steps])
    # The constant is not held back.
    backs = [np.append(1 / scale**2 if f.gamma is None else np.ones(f.inputs), 0.0)[:, None] for f in families]

    def stacked(of: Callable[[Descent], np.ndarray], family: int, models: Sequence[int]) -> np.ndarray:
        """models x inputs + 1 x outputs of a family."""
        f, ms = families[family], descents[family]
        return np.array([np.concatenate([of(d).reshape(f.inputs + 1, -1) for d in ms[i]], 1) for i in models])

    context = rows.table.sparkSession.sparkContext
    fixed = context.broadcast((scale, None if map_ is None else (map_.weights, map_.shifts)))
    passes = 0
    while True:
        # A model that has come to its end takes no part in further passes.
        open_ = [[i for i, m in enumerate(ms) if not all(d.done for d in m)] for ms in descents]
        if not any(open_):
            break
        passes += 1
        widths = [np.array([[d.width for d in ms[i]] for i in some]) for ms, some in zip(descents, open_)]
        weights = [stacked(lambda d: d.at, f, some) for f, some in enumerate(open_)]
        sent = context.broadcast(list(zip(map(np.array, open_), weights, widths)))

        def step(blocks: Iterator[tuple], sent=sent) -> np.ndarray | None:
            scale, drawn = fixed.value
            return _step(families, sent.value, folds, classes, scale, drawn and Fourier(*drawn))(blocks)

        told = summed(rows, step)
        sent.destroy()
        place = 0
        for family, ms, back, some in zip(families, descents, backs, open_):
            models, each = len(some), len(ms[0])
            if not models:
                continue
            loss = told[place : place + models * each].reshape(models, each)
            place += models * each
            slope = told[place : place + models * len(back) * family.outputs].reshape(models, len(back), family.outputs)
            place += slope.size
            for row, i in enumerate(some):
                penalty, many = back / (family.c[i // folds] * n[i % folds]), n[i % folds]
                for k, d in enumerate(ms[i]):
                    at = d.at.reshape(len(back), -1)
                    part = slope[row] if each == 1 else slope[row][:, k : k + 1]
                    d.tell(loss[row, k] / many + 0.5 * float((penalty * at * at).sum()), (part / many + penalty * at).ravel())
    fixed.destroy()
    weights = [stacked(lambda d: d.x, f, range(len(ms))) for f, ms in enumerate(descents)]
    for family, w in zip(families, weights):
        if family.gamma is None:
            w[:, :-1] /= scale[:, None]
    return GridFit(list(machines), rows.classes, folds, families, weights, map_, passes)


def grid_hits(rows: Rows, fit: GridFit) -> np.ndarray:
    """points x folds x (choosing, other than the fold, the fold, all) x (hits, rows), in one pass."""
    folds, points, classes = fit.folds, len(fit.machines), len(fit.classes)
    context = rows.table.sparkSession.sparkContext
    sent = context.broadcast((fit.weights, None if fit.fourier is None else (fit.fourier.weights, fit.fourier.shifts)))
    families = fit.families

    def count(blocks: Iterator[tuple]) -> np.ndarray:
        weights, drawn = sent.value
        fourier = drawn and Fourier(*drawn)
        out = np.zeros((points, folds, 4, 2))
        for target, fold, choosing, which, x in blocks:
            own = fold[:, None] == np.arange(folds)
            sets = np.stack([~own & choosing[:, None], ~own, own, np.ones_like(own)], 2)
            out[..., 1] += sets.sum(0)
            turned = fourier and fourier.turned(which, x)
            for family, w in zip(families, weights):
                at, a = family.matrix(which, x, np.ones(x.shape[1] if not len(which) else which.max() + 1), fourier, turned)
                hit = predicted(_scores(a, w, at), classes) == target[:, None]
                for i, point in enumerate(family.points):
                    out[point, :, :, 0] += (hit[:, i * folds : (i + 1) * folds, None] & sets).sum(0)
        return out.ravel()

    found = summed(rows, count)
    sent.destroy()
    return found.reshape(points, folds, 4, 2) if len(found) else np.zeros((points, folds, 4, 2))


def predicted(z: np.ndarray, classes: int) -> np.ndarray:
    """Class numbers of scores whose last axis is the outputs."""
    return np.where(z[..., 0] > 0, classes - 1, 0) if z.shape[-1] == 1 else z.argmax(-1)


# ---------------------------------------------------------------- one model of the grid


class MachineModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted machine as a pipeline stage that can be saved; adds the predicted label."""

    fitted = Param(Params._dummy(), "fitted", "weights, classes and feature map as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted: str = "{}", featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(fitted="{}", featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, fit: GridFit, point: int, fold: int, features: str = "features") -> MachineModel:
        family, model = fit.place(point, fold)
        told = {"weights": fit.weights[family][model].tolist(), "classes": list(fit.classes), "gamma": fit.families[family].gamma}
        if told["gamma"] is not None:
            told["fourier"] = [fit.fourier.weights.tolist(), fit.fourier.shifts.tolist()]
        return cls(fitted=json.dumps(told), featuresCol=features)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = json.loads(self.getOrDefault(self.fitted))
        weights = np.array(told["weights"])[None]
        gamma, labels = told["gamma"], np.array(told["classes"])
        fourier = Fourier(*map(np.array, told["fourier"])) if gamma is not None else None
        inputs = weights.shape[1] - 1
        size = inputs if fourier is None else len(fourier.weights)

        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            out = np.zeros(len(indices))
            none = np.zeros(len(indices), np.int32)
            table = pa.RecordBatch.from_arrays([pa.array(none), pa.array(none), pa.array(none), indices, values], list("abcde"))
            at = 0
            for *_, which, x in _blocks([table]):
                known = which < size
                which, x = which[known], x[:, known]
                places, a = Family("", gamma, [], labels, inputs, 1).matrix(which, x, np.ones(size), fourier)
                out[at : at + len(x)] = labels[predicted(_scores(a, weights, places), len(labels))[:, 0]]
                at += len(x)
            return pa.array(out)

        indices, values, _ = _unwrapped(quoted(self.getFeaturesCol()))
        return dataset.withColumn(self.getPredictionCol(), F.arrow_udf(score, T.DoubleType())(indices, values))
