"""Nearest neighbours by cosine: learned rotated binary codes, multi-index hashing, reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprism.llm.shared import narrowed, stored

NEIGHBOURS = 5
#: Numbers in the sample that rotations and radius are learnt from: rows times dimensions.  The bound of the sample.
SAMPLE = 1 << 20
#: Bits of a code, and of each substring that has a table.
BITS = 256
PIECE = 16
TURNS = 15
#: Of the sample's own neighbours, the share that the radius has to reach.
REACH = 0.99
ASKED = 256
#: Queries that one pass over the codes answers, and rows of one table of codes.
PASS = 4096
TABLE = 4096
_ONES = np.bitwise_count(np.arange(1 << PIECE, dtype=np.uint16))


@dataclass
class Coder:
    """``planes``: dimension x bits.  Codes at most ``radius`` bits apart are retrieved."""

    planes: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.planes > 0, axis=1).view(f">u{PIECE // 8}").astype(np.uint16)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """In double precision, each row by itself: equal vectors get equal scores."""
    norm = np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum())
    return (vectors * query).sum(1) / norm


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between codes, one row for each of ``a``."""
    wide = a.shape[1] // 4
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.zeros((len(a), len(b)), np.uint16)
    for j in range(wide):
        out += np.bitwise_count(x[:, j, None] ^ y[None, :, j])
    return out


def rotations(sample: np.ndarray, bits: int) -> np.ndarray:
    """Rotations that bring the unit vectors near the corners of the cube, next to each other.

    Each is found by turns: the corners nearest to the rotated vectors, then the rotation
    that fits the corners best.  They begin at different random rotations.
    """
    d = sample.shape[1]
    draw = np.random.Generator(np.random.PCG64(d))
    planes = []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(draw.standard_normal((d, d)))[0]
        for _ in range(TURNS):
            u, _, v = np.linalg.svd(np.where(sample @ turn > 0, 1.0, -1.0).T @ sample)
            turn = (u @ v).T
        planes.append(turn)
    return np.concatenate(planes, axis=1)[:, :bits]


def learn(sample: np.ndarray, k: int) -> Coder:
    """Rotations, and the radius that holds ``REACH`` of the sample's own k neighbours.

    Neighbours among all rows are nearer than those among the sample.
    """
    vectors = unit(sample)
    coder = Coder(rotations(vectors, BITS), BITS)
    asked = vectors[:: max(1, len(vectors) // ASKED)][:ASKED]
    at = np.arange(len(vectors))[:: max(1, len(vectors) // ASKED)][:ASKED]
    near = asked @ vectors.T
    near[np.arange(len(asked)), at] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(vectors) - 1)]
    if best.size:
        apart = distances(coder.codes(asked), coder.codes(vectors))
        coder.radius = int(np.quantile(np.take_along_axis(apart, best, 1), REACH))
    return coder


class Table:
    """Some codes, by the value of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self._pieces: list[tuple[np.ndarray, np.ndarray]] = []

    @property
    def pieces(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each substring: the rows in the order of its value, and where each value starts among them."""
        if not self._pieces:
            for j in range(self.codes.shape[1]):
                starts = np.cumsum(np.bincount(self.codes[:, j], minlength=1 << PIECE))
                self._pieces.append((np.argsort(self.codes[:, j], kind="stable"), np.concatenate([[0], starts])))
        return self._pieces

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes are at most ``radius`` bits from ``code``, by probing.

        If all m substrings differed in more than radius / m bits, the codes would differ
        in more than ``radius``.  So the ball of that many bits around each substring is
        looked up, and what is found is verified on the whole code.
        """
        seen = np.zeros(len(self.codes), bool)
        ball = np.flatnonzero(_ONES <= radius // self.codes.shape[1])
        for j, (order, starts) in enumerate(self.pieces):
            probes = ball ^ int(code[j])
            full = probes[starts[probes + 1] > starts[probes]]
            for v in full.tolist():
                seen[order[starts[v] : starts[v + 1]]] = True
            if seen.all():
                break
        rows = np.flatnonzero(seen)
        return rows[distances(code[None], self.codes[rows])[0] <= radius] if len(rows) else rows

    def within_all(self, codes: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """The rows of ``within`` for each of ``codes``.

        Where the balls of all substrings hold more values than the table has rows, probing
        would find nearly all rows: then all are verified at once, which finds the same.
        """
        m = self.codes.shape[1]
        if m * sum(math.comb(PIECE, i) for i in range(min(PIECE, radius // m) + 1)) < len(self.codes):
            for code in codes:
                yield self.within(code, radius)
            return
        for lo in range(0, len(codes), ASKED):
            for near in distances(codes[lo : lo + ASKED], self.codes) <= radius:
                yield np.flatnonzero(near)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _code(batches: Iterator[pa.RecordBatch], coder: Coder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            codes = coder.codes(unit(_vectors(batch.column(1)))).astype("<u2")
            cells = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], ["id", "vector", "code"])


def _probe(batches: Iterator[pa.RecordBatch], queries, coder: Coder, k: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """The best k rows of a partition for every query."""
    ids, vectors = queries
    asked = coder.codes(unit(vectors))
    best: list[list[tuple[float, int]]] = [[] for _ in ids]
    for batch in batches:
        for lo in range(0, batch.num_rows, TABLE):
            part = batch.slice(lo, TABLE)
            own, rows = part.column(0).to_numpy(), _vectors(part.column(1))
            table = Table(np.frombuffer(b"".join(part.column(2).to_pylist()), "<u2").astype(np.uint16).reshape(len(own), -1))
            every = np.arange(len(own))
            found = (every for _ in ids) if exact else table.within_all(asked, coder.radius)
            for q, (query, at) in enumerate(zip(vectors, found)):
                at = at[own[at] != ids[q]]
                if len(at):
                    score = cosines(query, rows[at])
                    first = np.lexsort((own[at], -score))[:k]
                    best[q] = sorted(best[q] + list(zip((-score[first]).tolist(), own[at][first].tolist())))[:k]
    found = [(ids[q], i, -s) for q, rows in enumerate(best) for s, i in rows]
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))],
        ["query_id", "vec_id", "score"],
    )


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """id, vector (doubles) of the rows that take part: a whole vector of the commonest length, finite and not zero."""
    rows = narrowed(vectors, id=id, vector=vector).select(F.col("id").try_cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & fine & F.exists("vector", lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (common.d if common else 0))


def _passes(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in lists of bounded size; the driver holds one at a time."""
    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == PASS:
            yield np.array([r.id for r in block]), np.array([r.vector for r in block])
            block = []
    if block:
        yield np.array([r.id for r in block]), np.array([r.vector for r in block])


def _searched(index: DataFrame, queries: DataFrame, coder: Coder, k: int, exact: bool) -> DataFrame | None:
    context = index.sparkSession.sparkContext

    def one(told) -> DataFrame:
        return index.mapInArrow(lambda b: _probe(b, told.value, coder, k, exact), "query_id bigint, vec_id bigint, score double")

    out = None
    for block in _passes(queries):
        part = one(context.broadcast(block))
        out = part if out is None else out.union(part)
    return out


def nearest(
    vectors: DataFrame, every: int = 50, k: int = NEIGHBOURS, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query.

    Queries are the ids divisible by ``every``; candidates all rows but those of the
    query's own id.  Ranked by cosine of the vectors as they are, in double precision,
    ties by smaller id.  Rows with a null id or vector, another length than most, a null
    or non-finite component, or zero, take no part; a query id that occurs again asks
    once, with its least vector; candidates that occur again are candidates of their own.

    Every row's code is indexed and stored.  Queries look up, task by task, every code
    within the learnt radius.  A query that gets fewer than k is compared with all rows.
    Ids that are no whole numbers take no part.
    """
    rows = usable(vectors, id, vector)
    first = rows.first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if first is None:
        return rows.sparkSession.createDataFrame([], result)
    bound = max(2, SAMPLE // len(first.vector))
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(bound).select("vector").collect()
    coder = learn(np.array([r.vector for r in sample]), k)
    index = stored(rows.mapInArrow(lambda b: _code(b, coder), "id bigint, vector array<double>, code binary"))
    queries = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    found = _searched(index, queries, coder, k, False)
    if found is None:
        return rows.sparkSession.createDataFrame([], result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = stored(ranked(found))
    whole = found.groupBy("query_id").count().where(F.col("count") == k).select(F.col("query_id").alias("id"))
    short = _searched(index, queries.join(whole, "id", "left_anti"), coder, k, True)
    if short is not None:
        found = found.join(whole.withColumnRenamed("id", "query_id"), "query_id", "left_semi").unionByName(ranked(short))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
