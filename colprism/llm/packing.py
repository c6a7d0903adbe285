"""Packing tokenised documents into sequences by vector best fit."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colprism.llm.shared import kept_by_worker, narrowed, stored, texts

TOKENS = 2048
END = 0
#: Weights of the residual tokens, documents and attention cost, each as a share of its capacity.
WEIGHTS = ((1.0, 0.0, 0.0), (1.0, 0.25, 0.25), (1.0, 1.0, 1.0))
RULES = tuple((kind, weights) for kind in ("norm", "dot") for weights in WEIGHTS)
#: Words whose ids a task remembers, and the longest of them in bytes.
_WORDS = 1 << 20
_WORD_BYTES = 64
_MARKS = tuple(bytes([c]) for c in b".,;:!?")
#: Words of a-z and the small letters from U+00DF to U+00FF, whose normal form they are.
_PLAIN = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+")

Vector = tuple[int, int, int]


class Run(NamedTuple):
    """``count`` pieces of one length, from ``rank`` on: ``each`` to a sequence, from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    each: int
    sequence: int
    offset: int


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def capacities(tokens: int = TOKENS, documents: int | None = None, cost: int | None = None) -> Vector:
    """The three capacities of a sequence; those left out are at their least value that cannot bind.

    The attention cost of a sequence is the sum of the squares of its pieces' lengths:
    each piece attends to itself alone.
    """
    return tokens, tokens if documents is None else documents, tokens * tokens if cost is None else cost


def longest_piece(capacity: Vector) -> int:
    """A piece of this length fits an empty sequence, a longer one does not."""
    return min(capacity[0], math.isqrt(capacity[2])) if capacity[1] else 0


def _signs() -> dict[int, str]:
    """The sign that byte-level models have for each byte: its own in Latin-1 where that is printed, else the next from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_SIGNS = _signs()


class KnownWords(dict):
    """The ids of words as bytes, worked out as they are met.

    A word of small letters is what the model merges but for the signs that stand for
    its bytes; the whole tokenizer sees only others.  A mark at its end stands alone.
    """

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.merged = tokenizer, tokenizer.model.tokenize
        self.marks = {m: self.whole(m) for m in _MARKS}
        for probe in ("a", "zq", "straße", "école,", "internationalisation", "Xyzzyqw!"):
            if self.whole(probe.encode()) != self.made(probe.encode()):
                raise ValueError("the ids of a text do not follow from those of its words with this tokenizer")

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def made(self, word: bytes) -> bytes:
        small = word.lower()
        mark = self.marks.get(small[-1:], b"") if small[-2:-1].isalnum() else b""
        core = small[:-1] if mark else small
        if not _PLAIN.fullmatch(core):  # special tokens are among these, whose case counts
            return self.whole(word)
        ids = [t.id for t in self.merged(core.decode("latin-1").translate(_SIGNS))]
        return struct.pack(f"<{len(ids)}I", *ids) + mark

    def __missing__(self, word: bytes) -> bytes:
        ids = self.made(word)
        if len(word) <= _WORD_BYTES:
            self[word] = ids
        return ids


def word_ids(path: str) -> Callable[[Sequence[list[bytes]]], Iterator[bytes]]:
    """A function from the words of texts to the ids of each text, as unsigned little-endian 32-bit numbers.

    For tokenizers that lower-case, drop white space, cut at it before all else and take
    the marks after a letter or digit for themselves, so that the ids of a text are those
    of its words in turn.  Words met before are looked up, by later tasks of the same
    worker too, up to ``_WORDS`` of them.
    """
    known = kept_by_worker(f"words {path}", lambda: KnownWords(Tokenizer.from_file(path)))

    def ids(listed: Sequence[list[bytes]]) -> Iterator[bytes]:
        for words in listed:
            if len(known) > _WORDS:
                known.clear()
            yield b"".join(map(known.__getitem__, words))

    return ids


def pieces(
    docs: DataFrame, capacity: Vector = capacities(), id: str = "doc_id", text: str = "text", tokenizer: str | None = None
) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece, with part and rank: its number among those of its length in its task.

    A document is the ids of its whole text (null: none), then ``END``.  One that is
    longer than fits an empty sequence is cut into pieces as long as fit, in order; all
    others are one piece.  ``tokenizer`` is a file that every executor has.  A text of
    any length is tokenised in one go, in the memory of its task.
    """
    most, path = longest_piece(capacity), tokenizer or default_tokenizer()
    end = END.to_bytes(4, "little")
    if most < 1:
        raise ValueError("an empty sequence must have room for a token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, seen = TaskContext.get().partitionId(), None, [0] * (most + 1)
        for batch in batches:
            ids = ids or word_ids(path)
            rows: list[list[int]] = [[] for _ in range(6)]
            for at in range(0, len(batch), 256):  # few texts at a time are held as words
                listed = [t.split() for t in texts(batch.slice(at, 256))]
                for row, data in enumerate(ids(listed), at):
                    data += end
                    for piece, start in enumerate(range(0, len(data) // 4, most)):
                        cut = data[4 * start : 4 * (start + most)]
                        length = len(cut) // 4
                        for values, v in zip(rows, (row, piece, start, length, zlib.crc32(cut), seen[length])):
                            values.append(v)
                        seen[length] += 1
            taken = batch.column(0).take(pa.array(rows[0], pa.int64()))
            numbers = [pa.array(rows[1], pa.int32()), *[pa.array(v, pa.int64()) for v in rows[2:]]]
            parts = pa.array([part] * len(rows[0]), pa.int32())
            yield pa.RecordBatch.from_arrays([taken, *numbers, parts], ["id", "piece", "start", "length", "ids_crc32", "rank", "part"])

    rows = narrowed(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint, part int")


def best_fit(counts: Mapping[int, int], capacity: Vector, kind: str, weights: Sequence[float]) -> tuple[int, list[Run]]:
    """(sequences, runs) of a vector best fit of ``counts`` (length to pieces), longest first.

    A piece takes a token for each id, one document and the square of its length in
    cost; a sequence must have all three left.  Of those that have, a piece goes to the
    one with the least score: with "norm" the weighted norm of what would be left, with
    "dot" the weighted dot product of what the piece takes and what is left, each as a
    share of the capacity.  Only where none has room a sequence is opened.

    Sequences with equal capacities left are alike, so they are kept as ranges of
    numbers, and pieces of one length are placed a range at a time.  Placing a piece
    lowers its sequence's score below that of all others of the best range, so the next
    piece of that length goes to the same one while it fits: a range takes as many to a
    sequence as fit, which is what one piece after the other would do.  The work hangs
    on the number of different lengths, not on the number of pieces.  A step makes at
    most four new ranges, and no sequence has more than sqrt(2 * tokens) different
    lengths, so there are at most 4 * lengths * sqrt(2 * tokens) runs.
    """
    shares = [w / c for w, c in zip(weights, capacity)]
    left: dict[Vector, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    sequences = 0
    for length in sorted((n for n, many in counts.items() if many), reverse=True):
        takes = (length, 1, length * length)
        if any(t > c for t, c in zip(takes, capacity)):
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def score(state: Vector) -> float:
            if kind == "norm":
                return sum((s * (r - t)) ** 2 for s, r, t in zip(shares, state, takes))
            return sum(w * r / c * t / c for w, r, t, c in zip(weights, state, takes, capacity))

        rank, waiting = 0, counts[length]
        open_ = [s for s in left if s[0] >= length and s[1] and s[2] >= takes[2]]
        made: list[tuple[Vector, tuple[int, int]]] = []
        for state in [*sorted(open_, key=lambda s: (score(s), s)), capacity]:
            fits = min(r // t for r, t in zip(state, takes))
            offset = capacity[0] - state[0]
            if state is capacity:  # nothing else has room
                n = -(-waiting // fits)
                ranges = [(sequences, n)] if n else []
                sequences += n
            else:
                ranges = left.pop(state)
            rest = []
            for first, n in ranges:
                full = min(n, waiting // fits)
                if full:
                    runs.append(Run(length, rank, full * fits, fits, first, offset))
                    made.append((_less(state, takes, fits), (first, full)))
                    rank, waiting = rank + full * fits, waiting - full * fits
                if full < n and waiting:  # fewer than fit in one
                    runs.append(Run(length, rank, waiting, waiting, first + full, offset))
                    made.append((_less(state, takes, waiting), (first + full, 1)))
                    rank, waiting, full = rank + waiting, 0, full + 1
                if full < n:
                    rest.append((first + full, n - full))
            if rest:
                left[state] = rest
            if not waiting:
                break
        for state, one in made:
            left.setdefault(state, []).append(one)
    return sequences, runs


def _less(state: Vector, takes: Vector, times: int) -> Vector:
    return tuple(r - times * t for r, t in zip(state, takes))


def plan(counts: Mapping[int, int], capacity: Vector, rules: Sequence[tuple[str, Sequence[float]]] = RULES) -> list[Run]:
    """The runs of the rule that needs the fewest sequences, the first of them if several do."""
    return min((best_fit(counts, capacity, *rule) for rule in rules), key=lambda found: found[0])[1]


def pack(
    docs: DataFrame,
    tokens: int = TOKENS,
    documents: int | None = None,
    cost: int | None = None,
    id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    rules: Sequence[tuple[str, Sequence[float]]] = RULES,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    One row per piece; a null or empty text is one piece of one token, rows that repeat
    an id or a text are documents of their own, a null id is kept.  No sequence exceeds a
    capacity, and its pieces lie one behind the other from 0.  Which of two pieces of
    equal length goes where hangs on the order of the input; the number of sequences
    does not.  An empty table gives no rows.

    A piece's demands follow from its length, so what is packed is the number of pieces
    of each length: at most ``tokens`` numbers come to the driver, and at most
    4 * tokens * sqrt(2 * tokens) runs (as a rule some thousands) go back out.  Pieces
    find their run by length and rank; the rank is counted in the task that cuts them
    and raised by the counts of earlier tasks.
    """
    capacity = capacities(tokens, documents, cost)
    cut = stored(pieces(docs, capacity, id, text, tokenizer))
    sizes = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(counts, capacity, rules))
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("part", "length", F.coalesce(earlier, F.lit(0)).cast("bigint").alias("before"))
    names = ["id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, each, sequence, offset = table.T
        starts = np.searchsorted(length, np.arange(capacity[0] + 2))
        for batch in batches:
            n, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.empty(len(n), np.int64)
            for one in np.unique(n):
                mine = n == one
                a, b = starts[one], starts[one + 1]
                at[mine] = a + np.searchsorted(rank[a:b], r[mine], "right") - 1
            inside = r - rank[at]
            where = [pa.array(sequence[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], [*names, "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select(*names, (F.col("rank") + F.col("before")).alias("rank"))
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in names)
    placed = ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id)
