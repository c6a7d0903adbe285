"""Benchmark texts in documents, with edits: pigeonhole pieces, verified by Myers' bit-parallel distance."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from colprism.llm.shared import narrowed

#: Edits that are allowed, for each character of the item.
RATE = 0.08
#: Items of fewer characters are not looked for, unless ``least`` says otherwise.
LEAST = 20
#: Characters of the items that one pass over the documents looks for.
PASS = 4_000_000


def plain(text: str) -> str:
    """Lower case, blanks as one space: what is compared."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item in ``budget`` + 1 pieces, with their places: that many edits leave one untouched."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' algorithm: least edits of the item against any part of a text, a character a step."""

    def __init__(self, item: str, rate: float):
        self.item = item
        self.budget = int(len(item) * rate)
        self.at: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.at[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(edits, end of the part); of equal ones the first."""
        m = len(self.item)
        full, high = (1 << m) - 1, 1 << (m - 1)
        up, down, edits = full, 0, m
        least, end = m, 0
        at = self.at
        for i, c in enumerate(text):
            eq = at.get(c, 0)
            x = eq | down
            across = (((eq & up) + up) ^ up) | eq
            more = down | (full & ~(across | up))
            less = up & across
            if more & high:
                edits += 1
            elif less & high:
                edits -= 1
            more = more << 1 & full
            less = less << 1 & full
            up = less | (full & ~(x | more))
            down = more & x
            if edits < least:
                least, end = edits, i + 1
                if not edits:
                    break
        return least, end


def whole_words(item: str, text: str) -> int:
    """Where the item is first in the text with no letter or digit of a word cut off at its ends, or -1."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        cut = at and text[at - 1].isalnum() and item[0].isalnum()
        if not cut and not (end < len(text) and text[end].isalnum() and item[-1].isalnum()):
            return at
        at = text.find(item, at + 1)
    return -1


class Searcher:
    """Items to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.patterns = [(i, Pattern(t, rate)) for i, t in items]
        starts: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, p) in enumerate(self.patterns):
            for at, piece in pieces(p.item, p.budget):
                starts[piece].append((k, at))
        self.machine = ahocorasick.Automaton()
        for piece, places in starts.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(index of the item, edits, end) of every item that is in the text."""
        if not self.patterns:
            return
        begins: dict[int, list[int]] = defaultdict(list)
        for last, (size, places) in self.machine.iter(text):
            for k, at in places:
                if self.patterns[k][1].budget or k not in begins:
                    begins[k].append(last - size + 1 - at)
        for k, found in begins.items():
            p = self.patterns[k][1]
            exact = text.find(p.item) if p.budget else whole_words(p.item, text)
            if exact >= 0:
                yield k, 0, exact + len(p.item)
                continue
            if not p.budget:
                continue
            best = (p.budget + 1, 0)
            lo = hi = None
            # A part with a piece in place begins and ends within the budget of where it would without edits.
            for begin in [*sorted(found), None]:
                if lo is not None and (begin is None or begin - p.budget > hi):
                    a = max(0, lo)
                    edits, end = p.best(text[a:hi])
                    best = min(best, (edits, a + end))
                    lo = None
                if begin is not None:
                    lo = begin - p.budget if lo is None else lo
                    hi = begin + len(p.item) + p.budget
            if best[0] <= p.budget:
                yield k, *best


def _search(batches: Iterator[pa.RecordBatch], items: list, rate: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(items, rate)
    for batch in batches:
        rows, which, edits, ends = [], [], [], []
        for row, text in enumerate(batch.column(1)):
            if text.is_valid:
                for k, n, end in searcher.find(plain(text.as_py())):
                    rows.append(row)
                    which.append(k)
                    edits.append(n)
                    ends.append(end)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array([searcher.patterns[k][0] for k in which], kind),
                pa.array(edits, pa.int32()),
                pa.array(ends, pa.int32()),
                pa.array([len(searcher.patterns[k][1].item) for k in which], pa.int32()),
            ],
            ["id", "item", "edits", "ends_at", "item_chars"],
        )


def _without(batches: Iterator[pa.RecordBatch], at: int, items: list, rate: float) -> Iterator[pa.RecordBatch]:
    searcher = Searcher(items, rate)
    for batch in batches:
        clean = [not t.is_valid or next(searcher.find(plain(t.as_py())), None) is None for t in batch.column(at)]
        yield batch.filter(pa.array(clean, pa.bool_()))


def passes(items: DataFrame, item_id: str, item_text: str, least: int = LEAST) -> Iterator[list[tuple[Any, str]]]:
    """The items to look for, in lists of about ``PASS`` characters; the driver holds one list at a time."""
    asked = narrowed(items, id=item_id, text=item_text).where("text IS NOT NULL")
    block, size = [], 0
    for r in asked.orderBy("id", "text").toLocalIterator():
        item = plain(r.text)
        if len(item) < max(least, 1):
            continue
        block.append((r.id, item))
        size += len(item)
        if size >= PASS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    least: int = LEAST,
) -> DataFrame:
    """id, item_id, edits, ends_at, item_chars: each item that a row of ``docs`` holds, at its best place.

    Texts are compared in lower case, with single spaces.  An item is held if some part
    of the text is at most ``rate`` times its length edits (insert, delete, replace)
    away; all such pairs are found.  ``ends_at`` counts characters of the text so
    written.  Null and empty texts hold nothing; items that are null, empty or shorter
    than ``least`` are not looked for; equal items and rows are found one by one.  An
    item too short for an edit is held as whole words only.

    The items are read in passes of bounded size; each pass looks through all documents
    with the pieces of its items.
    """
    rows = narrowed(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    own = items.schema[item_id].dataType
    schema = f"id {kind}, item {own.simpleString()}, edits int, ends_at int, item_chars int"
    context = rows.sparkSession.sparkContext

    def look(told) -> DataFrame:
        return rows.mapInArrow(lambda b: _search(b, told.value, rate, to_arrow_type(own)), schema)

    found = None
    for block in passes(items, item_id, item_text, least):
        part = look(context.broadcast(block))
        found = part if found is None else found.union(part)
    found = found if found is not None else look(context.broadcast([]))
    return found.withColumnsRenamed({"id": id, "item": item_id})


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rate: float = RATE,
    least: int = LEAST,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item of ``least`` characters.  Nothing is shuffled."""
    at, left = docs.columns.index(text), docs

    def without(df: DataFrame, told) -> DataFrame:
        return df.mapInArrow(lambda b: _without(b, at, told.value, rate), docs.schema)

    for block in passes(items, item_id, item_text, least):
        left = without(left, docs.sparkSession.sparkContext.broadcast(block))
    return left
