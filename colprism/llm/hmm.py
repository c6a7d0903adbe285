"""A hidden Markov language model over word classes, trained by Baum-Welch."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprism.llm.shared import modulo_crc, narrowed, stored, texts

STATES = 8
OWN = 1024
SUFFIXES = 1024
CLASSES = OWN + SUFFIXES
#: Most words whose counts every task holds; the counts of all others are joined.
HEADS = 1 << 16
ROUNDS = 3
SEEDS = 64
END = b""
_FLUSH = 400_000
_CELLS = 400_000
#: Expected counts are summed as whole numbers and as so many parts of one, so the order of summing is of no effect.
_UNIT = 1 << 40


def suffix_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SUFFIXES


# ---------------------------------------------------------------- corpus counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counted: Counter, learnt: bool) -> pa.RecordBatch:
        n = pa.array(list(counted.values()), pa.int64())
        c = n if learnt else pa.array(np.zeros(len(n), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(list(counted), pa.binary()), c, n], ["word", "c", "every"])

    counted = Counter(), Counter()  # in training rows, in the others
    for batch in batches:
        held = batch.column(batch.schema.get_field_index("held_out")).to_pylist()
        for text, h in zip(texts(batch), held):
            into = counted[h]
            into.update(text.lower().split())
            into[END] += 1
            if len(into) > _FLUSH:
                yield out(into, not h)
                into.clear()
    yield out(counted[0], True)
    yield out(counted[1], False)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c (in training rows), every (in all rows).  ``END`` is a word."""
    counted = rows.mapInArrow(_count, "word binary, c bigint, every bigint")
    return stored(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")))


@dataclass
class Vocabulary:
    """Bounded by ``HEADS`` and ``CLASSES``, whatever the corpus."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    mass: np.ndarray  # of each class: training tokens
    kinds: np.ndarray  # of each class: different training words
    tokens: int
    different: int

    @property
    def log_room(self) -> np.ndarray:
        """log10 of what counts plus one are divided by, within each class; own classes hold one word."""
        room = np.log10(self.mass + self.kinds + 1)
        room[:OWN] = 0
        return room


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        c = batch.column(1).to_numpy()
        cls = np.array([suffix_class(w) for w in batch.column(0).to_pylist()], np.int64)
        n += np.bincount(cls, c, CLASSES).astype(np.int64)
        v += np.bincount(cls, c > 0, CLASSES).astype(np.int64)
    cls = np.flatnonzero(v)
    yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n[cls]), pa.array(v[cls])], ["cls", "n", "v"])


def vocabulary(counts: DataFrame) -> Vocabulary:
    # Words by size class, of which there are few; the largest classes that fit are the heads.
    size = F.floor(F.log2("every") * 16)
    classes_of = {r.size: r["count"] for r in counts.groupBy(size.alias("size")).count().collect()}
    least, room = None, HEADS - 1
    for s in sorted(classes_of, reverse=True):
        room -= classes_of[s]
        if room < 0:
            break
        least = s
    common = F.lit(False) if least is None else size >= least
    heads = sorted(counts.where(common | (F.col("word") == F.lit(END))).collect(), key=lambda r: (-r.every, bytes(r.word)))
    words = [bytes(r.word) for r in heads]
    c = np.array([r.c for r in heads], np.int64)
    classes = np.array([suffix_class(w) for w in words], np.int64)
    mass, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counts.where("c > 0").select("word", "c").mapInArrow(_class_sums, "cls bigint, n bigint, v bigint").groupBy("cls").agg(
        F.sum("n").alias("n"), F.sum("v").alias("v")
    ).collect():
        mass[r.cls], kinds[r.cls] = r.n, r.v
    own = 1
    for i in sorted(range(len(words)), key=lambda i: (-c[i], words[i])):
        place = 0 if words[i] == END else own
        if c[i] == 0 or place == OWN:
            continue
        mass[classes[i]] -= c[i]
        kinds[classes[i]] -= 1
        classes[i] = place
        mass[place], kinds[place] = c[i], 1
        own += place > 0
    return Vocabulary(words, c, classes, mass, kinds, int(mass.sum()), int(kinds.sum()))


# ---------------------------------------------------------------- rows as class sequences


def _encode(batches: Iterator[pa.RecordBatch], vocab: Vocabulary) -> Iterator[pa.RecordBatch]:
    """The columns of a batch but its text, then what the words of each row come to.

    The different words of some rows at a time are looked up once each; what a row needs
    of them are sums over its stretch of their numbers.
    """
    place = {w: i for i, w in enumerate(vocab.words)}
    logs, room = np.log10(vocab.counts + 1), vocab.log_room
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            listed = [[*text.lower().split(), END] for text in texts(part)]
            # A word not seen yet gets the next number as it is looked up.
            different: defaultdict[bytes, int] = defaultdict()
            different.default_factory = different.__len__
            different[END]
            number = np.fromiter(map(different.__getitem__, itertools.chain.from_iterable(listed)), np.int64)
            size = np.array([len(words) for words in listed], np.int64)
            starts = np.cumsum(size) - size
            head = np.fromiter([place.get(w, -1) for w in different], np.int64, len(different))
            known = head >= 0
            cls = np.zeros(len(head), np.int64)
            cls[known] = vocab.classes[head[known]]
            # Only words outside the heads go by their last bytes.
            cls[~known] = [suffix_class(w) for w, k in zip(different, known.tolist()) if not k]
            cls[0] = 0
            log, c = np.zeros(len(head)), np.zeros(len(head), np.int64)
            log[known], c[known] = logs[head[known]], vocab.counts[head[known]]
            inner = np.where(cls >= OWN, log, 0.0)
            total = lambda of: np.add.reduceat(of[number], starts) if len(starts) else of[:0]  # noqa: E731, B023
            classes = cls[number].astype(np.uint16)
            # Words outside the heads, counted by row.
            row = np.repeat(np.arange(len(size)), size)
            other = np.flatnonzero(~known[number])
            pairs, times = np.unique(row[other] * len(head) + number[other], return_counts=True)
            names = pa.array(list(different), pa.binary()).take(pa.array(pairs % len(head)))
            cuts = np.searchsorted(pairs, np.arange(len(size) + 1) * len(head)).astype(np.int32)
            rest = pa.StructArray.from_arrays([names, pa.array(times.astype(np.int64))], ["word", "n"])
            ends = np.concatenate([[0], np.cumsum(size) * 2]).astype(np.int32)
            seq = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(classes)])
            sums = [pa.array(size), *[pa.array(total(x)) for x in (log, inner, room[cls])], pa.array(total((c > 0).astype(np.int64)))]
            others = [part.column(i) for i in range(part.num_columns) if i != at]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*others, *sums, seq, pa.ListArray.from_arrays(pa.array(cuts), rest)],
                [*names, "n_tokens", "heads", "inner", "room", "known", "seq", "rest"],
            )


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # state x class


def padded(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(which, lengths, classes by time x sequence), longest first, of bounded size unless one is longer."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        which = order[at : at + max(1, _CELLS // max(1, longest))]
        at += len(which)
        block = np.zeros((longest, len(which)), np.int64)
        for j, i in enumerate(which):
            block[: len(sequences[i]), j] = sequences[i]
        yield np.array(which), np.array([len(sequences[i]) for i in which]), block


def forward(model: Model, lengths: np.ndarray, block: np.ndarray, keep: bool = False):
    """log10 likelihood of each sequence, by the scaled forward recursion; with ``keep`` its values and scales."""
    likes = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(lengths))
    values, scales = [], []
    now = None
    for t in range(len(block)):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # longer than t
        now = (np.broadcast_to(model.start, (n, len(model.start))) if t == 0 else now[:n] @ model.step) * likes[block[t, :n]]
        scale = now.sum(1)
        now = now / scale[:, None]
        total[:n] += np.log10(scale)
        if keep:
            values.append(now)
            scales.append(scale)
    return (total, values, scales) if keep else total


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions of the sequences (Baum-Welch)."""
    states, classes = model.emit.shape
    likes = np.ascontiguousarray(model.emit.T)
    starts, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    for _, lengths, block in padded(sequences):
        _, values, scales = forward(model, lengths, block, keep=True)
        after = None
        for t in range(len(block) - 1, -1, -1):
            n = len(scales[t])
            back = np.ones((n, states))
            if after is not None:
                m = len(after)
                # What comes next, seen from each state at t.
                ahead = likes[block[t + 1, :m]] * after / scales[t + 1][:, None]
                back[:m] = ahead @ model.step.T
                steps += (values[t][:m].T @ ahead) * model.step
            values[t] = values[t] * back  # now the posterior
            after = back
        starts += values[0].sum(0)
        cells = np.concatenate([block[t, : len(values[t])] for t in range(len(block))])
        weight = np.concatenate(values)
        for s in range(states):
            emits[s] += np.bincount(cells, weight[:, s], classes)
    return starts, steps, emits


def _sequences(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), np.uint16).astype(np.int64) for s in column]


def _expect(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 4000):
            parts = expected(model, _sequences(batch.column(0).slice(lo, 4000)))
            flat = np.concatenate([p.ravel() for p in parts])
            total = flat if total is None else total + flat
    if total is not None:
        at = np.flatnonzero(total)
        whole = np.floor(total[at])
        units = np.rint((total[at] - whole) * _UNIT).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole.astype(np.int64)), pa.array(units)], ["i", "v", "u"])


def updated(counts: np.ndarray, states: int, base: np.ndarray) -> Model:
    """The model of expected counts, with a little of the whole corpus's classes in every state."""
    starts, counts = counts[:states], counts[states:]
    steps, emits = counts[: states * states].reshape(states, states), counts[states * states :].reshape(states, -1)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    return Model(norm(starts + 1), norm(steps + 1), norm(emits + base * 10))


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for mark, s in zip(batch.column(0).to_pylist(), _sequences(batch.column(1))):
            counts = np.bincount(s, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array([mark], pa.int64()), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["mark", "h"])


def first_model(rows: DataFrame, base: np.ndarray, states: int) -> Model:
    """States that lean to the classes of training texts that are unlike each other.

    ``SEEDS`` different texts are drawn by hash, a text by its number of tokens; of
    these, each next one is the least like those taken.  What the states become is up to
    the counts of the whole corpus.  Copies count once, and how the rows are split is of
    no effect.
    """
    # The least of -log(u) / n for even u: a draw without replacement by the weights n.
    even = (F.pmod("mark", F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    of = rows.where("NOT held_out").select("mark", "seq", (-F.log(even) / F.col("n_tokens")).alias("draw"))
    least = of.groupBy("mark").agg(F.min("draw").alias("draw")).orderBy("draw", "mark").limit(SEEDS)
    marks = [r.mark for r in least.collect()]
    drawn = of.where(F.col("mark").isin(marks)).select("mark", "seq").dropDuplicates(["mark"])
    seen = [np.array(r.h, float) for r in drawn.mapInArrow(_histograms, "mark bigint, h array<bigint>").collect()]
    seen = sorted(seen, key=lambda h: (-h.sum(), h.tolist())) or [base]
    unit = [h / np.linalg.norm(h) for h in seen]
    taken = [0]
    while len(taken) < states:
        taken.append(min(range(len(unit)), key=lambda i: max(float(unit[i] @ unit[j]) for j in taken)))
    lean = np.array([seen[i] / seen[i].sum() for i in taken])
    # Were two taken alike, a tilt by state tells them apart.
    tilt = 1 + 0.05 * np.random.Generator(np.random.PCG64(1)).random((states, len(base)))
    emit = (0.5 * base + 0.5 * lean) * tilt
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True))


def train(rows: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training rows; each round sums the expected counts of all partitions."""
    base = (vocab.mass + 0.5) / (vocab.mass + 0.5).sum()
    model = first_model(rows, base, states)
    learnt = rows.where("NOT held_out").select("seq")
    for _ in range(rounds):
        sums = learnt.mapInArrow(lambda b, m=model: _expect(b, m), "i bigint, v bigint, u bigint").groupBy("i")
        counts = np.zeros(states + states * states + states * CLASSES)
        for r in sums.agg(F.sum("v").alias("v"), F.sum("u").alias("u")).collect():
            counts[r.i] = r.v + r.u / _UNIT
        model = updated(counts, states, base)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """All columns of a batch but the sequences in the first, and ``path``."""
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for lo in range(0, batch.num_rows, 4000):
            for which, lengths, block in padded(_sequences(batch.column(0).slice(lo, 4000))):
                out[lo + which] = forward(model, lengths, block)
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], [*batch.schema.names[1:], "path"])


def score(docs: DataFrame, id: str = "doc_id", text: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Words are lower-cased (A-Z) runs of anything but ASCII blanks, then comes one end.
    ``score`` is log10 of the model's probability: the hidden Markov chain gives the
    classes of the words (the commonest words are classes of their own, all others go by
    their last three bytes), the counts give the word within its class.  Learnt from the
    rows whose crc32 of the id, modulo ``fold``, is not ``held``.

    One row per row of ``docs``; a null text is empty and has its end alone; rows that
    repeat others count and are scored as often as they occur.  Without training rows all
    words are unknown.
    """
    rows = narrowed(docs, id=id, text=text).withColumn("held_out", modulo_crc(F.col("id"), fold) == held)
    counts = word_counts(rows.select("text", "held_out"))
    vocab = vocabulary(counts)
    # Plain values: a broadcast names classes by their module, which executors need not have.
    told = rows.sparkSession.sparkContext.broadcast(tuple(vars(vocab).values()))
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    sums = "n_tokens bigint, heads double, inner double, room double, known bigint"
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean"
    coded = rows.mapInArrow(
        lambda b: _encode(b, Vocabulary(*told.value)), f"{kinds}, mark bigint, {sums}, seq binary, rest array<struct<word:binary,n:bigint>>"
    )
    # The row numbers are stored, so they stay what they are.
    coded = stored(coded.withColumn("row", F.monotonically_increasing_id()))
    model = train(coded, vocab)
    scored = coded.select("seq", "row", "id", "held_out", "n_tokens", "heads", "inner", "room", "known")
    scored = scored.mapInArrow(lambda b: _score(b, model), f"row bigint, {kinds}, {sums}, path double")
    rest = coded.select("row", F.inline("rest")).join(counts.where("c > 0").select("word", "c"), "word")
    rest = rest.groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("more_known")
    )
    more = F.coalesce("more", F.lit(0.0))
    whole = scored.join(rest, "row", "left")
    # float() of the whole divisor, as the formula has it.
    divisor = float(np.log10(vocab.tokens + vocab.different + 1))
    return whole.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("bigint").alias("train_tokens"),
        (F.col("heads") + more - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        (F.col("path") + F.col("inner") + more - F.col("room")).alias("score"),
    )
