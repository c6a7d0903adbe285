"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.llm.shared import column, modulo_crc, stored, text_bytes

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIMENSIONS = 16
#: Different texts of each language that the model is fitted on, and that it is calibrated on.  The bound of the sample.
FIT_ROWS = 400
CALIBRATION_ROWS = 400
#: Parts of each of these rows that are learnt beside the whole, so that short texts are known too.
PARTS = 4
EPOCHS = 6
RATE = 0.5
#: Share of rightly labelled rows that calibration lets be rejected.
ALPHA = 0.005
UNKNOWN = "und"
_BLOCK = 1 << 19
_RANGE_BITS = 12

# A to Z are in lower case already; other ASCII than letters parts words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def subwords(data: np.ndarray, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places below ``stop``, buckets) for each subword size.

    A subword is some bytes without a blank inside; a blank at an end marks the end of a word.
    """
    plain = _FOLD[data]
    blank = plain == 32
    wide = plain.astype(np.uint32)
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        gram = np.zeros(m, np.uint32)
        good = np.ones(m, bool)
        for j in range(n):
            gram = (gram << np.uint32(8)) | wide[j : j + m]
            if 0 < j < n - 1:
                good &= ~blank[j : j + m]
        if n == 2:
            good &= ~(blank[:m] & blank[1 : 1 + m])
        at = np.flatnonzero(good[:stop])
        mixed = (gram[at] + np.uint32(n)) * np.uint32(2654435761)
        yield at, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16)


def bucket_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text (blanks around it) and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data), _BLOCK):
        for _, bucket in subwords(data[start : start + _BLOCK + max(SIZES) - 1], _BLOCK):
            total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x label: embedding times weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Of each row of a batch; mean over all its subwords."""
        sums, counts = np.zeros((len(cuts) - 1, len(self.labels))), np.zeros(len(cuts) - 1)
        for start in range(0, len(data), _BLOCK):
            block = data[start : start + _BLOCK + max(SIZES) - 1]
            lo = int(np.searchsorted(cuts, start, "right")) - 1
            hi = int(np.searchsorted(cuts, start + _BLOCK, "left"))
            edges = np.clip(cuts[lo : hi + 1] - start, 0, _BLOCK)
            for at, bucket in subwords(block, _BLOCK):
                places = np.searchsorted(at, edges)
                run = np.zeros((len(at) + 1, len(self.labels)))
                np.cumsum(self.table[bucket], axis=0, out=run[1:])
                sums[lo:hi] += run[places[1:]] - run[places[:-1]]
                counts[lo:hi] += places[1:] - places[:-1]
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, cuts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """Stochastic gradient descent on (label, buckets, counts), one sample a step."""
    draw = np.random.Generator(np.random.PCG64(11))
    of = {l: i for i, l in enumerate(labels)}
    emb = (draw.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS
    weights, bias = (draw.random((DIMENSIONS, len(labels))) - 0.5) / DIMENSIONS, np.zeros(len(labels))
    steps, turn = EPOCHS * len(samples), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(samples)):
            label, at, counts = samples[i]
            rate = RATE * (1 - turn / steps)
            turn += 1
            share = counts / counts.sum()
            mean = share @ emb[at]
            error = softmax(mean @ weights + bias)
            error[of[label]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            emb[at] -= (rate * len(at) / 10) * share[:, None] * back
    return Model(labels, (emb @ weights), bias)


def calibrated(model: Model, samples: list[tuple[str, bytes, bool]]) -> Model:
    """Temperature of least loss on texts not fitted on, rows and parts; threshold that few of the whole rows miss."""
    if not samples:
        return model
    raw = b"".join(t for _, t, _ in samples)
    cuts = np.cumsum([0] + [len(t) for _, t, _ in samples])
    logits = model.logits(np.frombuffer(raw, np.uint8), cuts)
    want = np.array([model.labels.index(l) for l, _, _ in samples])

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean())

    temperature = min(np.exp(np.linspace(np.log(0.05), np.log(20), 200)), key=loss)
    p = softmax(logits / temperature)
    # Parts are shorter than what is judged: only whole rows tell the threshold.
    whole = np.array([w for _, _, w in samples])
    threshold = least_score(p.max(1)[whole & (p.argmax(1) == want)])
    return Model(model.labels, model.table, model.bias, float(temperature), threshold)


def least_score(right: np.ndarray) -> float:
    """Below it comes a further right row with probability ``ALPHA`` at most; 0 where the scores are too few to tell."""
    at = int(ALPHA * (len(right) + 1))
    return float(np.sort(right)[at - 1]) if at else 0.0


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, rank, text, whether it is a whole row, buckets and counts of whole rows and of parts of them."""
    for batch in batches:
        data, cuts = text_bytes(batch)
        raw = data.tobytes()
        for i, (lang, rank) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            text = raw[int(cuts[i]) : int(cuts[i + 1])]
            words = text.split()
            draw = np.random.Generator(np.random.PCG64(len(text)))
            parts = [text]
            for _ in range(PARTS):
                a = int(draw.integers(0, max(1, len(words))))
                parts.append(b" " + b" ".join(words[a : a + int(draw.integers(2, 16))]) + b" ")
            kept = [(p, i == 0, *bucket_counts(p)) for i, p in enumerate(parts)]
            kept = [k for k in kept if len(k[2])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept)),
                    pa.array([rank] * len(kept), pa.int32()),
                    pa.array([p if rank > FIT_ROWS else b"" for p, *_ in kept], pa.binary()),
                    pa.array([w for _, w, *_ in kept], pa.bool_()),
                    pa.array([at.astype("<i4").tobytes() if rank <= FIT_ROWS else b"" for *_, at, _ in kept], pa.binary()),
                    pa.array([n.astype("<i8").tobytes() if rank <= FIT_ROWS else b"" for *_, n in kept], pa.binary()),
                ],
                ["lang", "rank", "text", "whole", "at", "n"],
            )


def sample(rows: DataFrame) -> DataFrame:
    """text, lang, rank of the first different texts of each language, each once, of rows text, lang in the order of a hash."""
    rows = rows.withColumn("draw", F.xxhash64("text"))
    # Hashes alone are made distinct: copies are one small row per task.
    hashes = stored(rows.select("lang", "draw").distinct())
    # Only the ranges of hashes that hold the first ones are ranked; hashes fill the ranges evenly.
    span = F.shiftright("draw", 64 - _RANGE_BITS)
    sizes = hashes.groupBy("lang", span.alias("span")).count()
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    spans = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < FIT_ROWS + CALIBRATION_ROWS)
    near = hashes.withColumn("span", span).join(spans.select("lang", "span"), ["lang", "span"], "left_semi")
    order = Window.partitionBy("lang").orderBy("draw")
    first = near.drop("span").withColumn("rank", F.row_number().over(order))
    first = F.broadcast(first.where(F.col("rank") <= FIT_ROWS + CALIBRATION_ROWS))
    return rows.join(first, ["lang", "draw"]).groupBy("lang", "rank").agg(F.min("text").alias("text")).select("text", "lang", "rank")


def train(rows: DataFrame) -> Model | None:
    """A model from rows text, lang."""
    features = sample(rows).mapInArrow(_features, "lang string, rank int, text binary, whole boolean, at binary, n binary")
    # The sample is bounded: one task learns from it, and the driver sees the model alone.
    learnt = features.repartition(1).mapInArrow(
        _learnt, "labels array<string>, shape array<int>, table binary, bias binary, temperature double, threshold double"
    )
    for r in learnt.collect():
        table = np.frombuffer(r["table"]).reshape(r["shape"])
        return Model(list(r.labels), table, np.frombuffer(r.bias), r.temperature, r.threshold)
    return None


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the rows of ``_features``; none if there are none."""
    got = [r for b in batches for r in b.to_pylist()]
    got.sort(key=lambda r: (r["lang"], r["rank"], r["text"], r["whole"], r["at"], r["n"]))
    labels = sorted({r["lang"] for r in got})
    if not labels:
        return
    fitted = [
        (r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i8").astype(float)) for r in got if r["rank"] <= FIT_ROWS
    ]
    rest = [(r["lang"], r["text"], r["whole"]) for r in got if r["rank"] > FIT_ROWS]
    model = calibrated(fit(fitted, labels), rest)
    row = {
        "labels": labels,
        "shape": list(model.table.shape),
        "table": model.table.tobytes(),
        "bias": model.bias.tobytes(),
        "temperature": model.temperature,
        "threshold": model.threshold,
    }
    kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, cuts = text_bytes(batch)
        p = model.probabilities(data, cuts)
        best = p.argmax(1)
        known = np.array(batch.column(batch.schema.get_field_index("known")).to_pylist(), bool)
        score = np.where(known, np.minimum(p[np.arange(len(best)), best], 1.0) if len(best) else 0.0, 0.0)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(1, batch.num_columns - 1)],
                pa.array([model.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string()),
                pa.array(score),
                pa.array(~known | (score < model.threshold)),
            ],
            [*batch.schema.names[1:-1], "lang_pred", "score", "rejected"],
        )


def _padded(text: str) -> Column:
    return F.concat(F.lit(" "), F.lower(column(text)), F.lit(" "))


def _known(text: str) -> Column:
    return F.coalesce(column(text).rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, id: str, text: str, lang: str, fold: int, held: int) -> Model | None:
    """The model of ``identify``; None if no row that may teach has a language."""
    teaches = _known(text) & column(lang).isNotNull() & (modulo_crc(column(id), fold) != held)
    rows = docs.where(teaches)
    return train(rows.select(_padded(text).alias("text"), column(lang).cast("string").alias("lang")))


def predicted(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` (text with blanks around it, more columns, known) without text and known, with the prediction."""
    rest = rows.columns[1:-1]
    if model is None:
        return rows.select(*rest, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    schema = T.StructType(rows.select(*rest).schema.fields + T.StructType.fromDDL("lang_pred string, score double, rejected boolean").fields)
    # Plain values: a broadcast names classes by their module, which executors need not have.
    told = rows.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature, model.threshold))
    return rows.mapInArrow(lambda b: _predict(b, Model(*told.value)), schema)


def identify(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 5, held: int = 0
) -> DataFrame:
    """id, held_out, lang_pred, score, rejected for every row of ``docs``.

    ``held_out``: crc32 of the id, modulo ``fold``, is ``held``; such rows teach nothing.
    Of the others, up to ``FIT_ROWS`` + ``CALIBRATION_ROWS`` different texts (in lower
    case) of each language are drawn by a hash.  ``lang_pred`` comes from the text alone: the
    likeliest of the languages learnt, or ``und`` with score 0 for a text that is null or
    has no letter, and for all if nothing is labelled.  ``score`` is its calibrated
    probability; below the calibrated threshold, or without a letter, a row is
    ``rejected``.  Equal texts get equal predictions; an empty table gives no rows.
    """
    out = (modulo_crc(column(id), fold) == held).alias("held_out")
    rows = docs.select(_padded(text).alias("text"), column(id).alias("id"), out, _known(text).alias("known"))
    return predicted(rows, learn(docs, id, text, lang, fold, held)).withColumnRenamed("id", id)


def accepted(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 5, held: int = 0
) -> DataFrame:
    """The rows of ``docs``, with its columns, that ``identify`` does not reject."""
    own = [column(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(_padded(text).alias("text"), *own, _known(text).alias("known"))
    kept = predicted(rows, learn(docs, id, text, lang, fold, held)).where("NOT rejected")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
