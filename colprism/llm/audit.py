"""How filters over documents interact: what each removes in every order in which they can run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprism.llm.shared import narrowed, text_bytes

#: The five filters, in the order of their bits in a mask.
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3
MARKS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUED = bytes(range(0x80, 0xC0))
#: What is counted of every mask: documents, those labelled good, those labelled toxic.
COUNTS = ("n", "good", "toxic")
Counts = tuple[int, ...]


def text_mask(text: bytes) -> int:
    """The bits of A to D that a text in UTF-8 fails."""
    words = text.split()
    n = len(words)
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    few = n < MIN_WORDS
    repeated = 100 * len(set(words)) < MIN_DISTINCT_PERCENT * n
    shouted = 100 * capitals > MAX_CAPITALS_PERCENT * points
    marked = len(text.translate(None, MARKS)) < len(text)
    return few | repeated << 1 | shouted << 2 | marked << 3


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, cuts = text_bytes(batch)
        masks, digests = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            text = whole[a:b].tobytes()
            masks.append(text_mask(text))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            ["id", "part", "mask", "digest"],
        )


def failure_masks(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    quality: str = "quality",
    toxic: str = "toxic",
) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail just the filters of a mask.

    Bit i of the mask is filter i of ``FILTERS``.  A to D hang on the text alone (a null
    text is empty); a document fails E if a smaller id has the same text anywhere in the
    table.  A null part is the empty text.  Rows of one id and text are as many documents,
    none of them smaller than another; a null id is larger than any other.  An id with
    several rows of labels is good (toxic) if one of them says so; labels of a null id
    are nobody's.  A whole text is judged in one piece, its different words in memory.

    Copies of a text meet as counts: rows are summed by text, part and id, then by text
    and part, before the smallest id of the text is looked for among its parts.
    """
    rows = narrowed(docs, id=id, part=part, text=text).withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    kind = rows.schema["id"].dataType.simpleString()
    facts = rows.mapInArrow(_facts, f"id {kind}, part string, mask int, digest binary")
    given = narrowed(labels, id=id, good=quality, toxic=toxic).where("id IS NOT NULL").groupBy("id")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("bigint")), F.lit(0).cast("bigint"))
    # Rows without an id go to the join by their texts, not all to one place.
    given = given.agg(one("good").alias("good"), one("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    spread = F.when(F.col("id").isNull(), F.hash("digest")).otherwise(0)
    facts = facts.withColumn("spread", spread).join(given, ["id", "spread"], "left").fillna(0, ["good", "toxic"])
    sums = [F.sum(c).alias(c) for c in COUNTS]
    facts = facts.withColumn("n", F.lit(1).cast("bigint")).groupBy("digest", "part", "mask", "id").agg(*sums)
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *COUNTS)).alias("first")
    texts = facts.groupBy("digest", "part", "mask").agg(*sums, smallest)
    # A text has one row for each part now.
    least = F.min(F.struct("first.none", "first.id")).over(Window.partitionBy("digest"))
    texts = texts.withColumn("least", least)
    own = F.col("first.id").eqNullSafe(F.col("least.id"))
    passing = [F.when(own, F.col(f"first.{c}")).otherwise(0).cast("bigint").alias(c) for c in COUNTS]
    texts = texts.withColumn("passing", F.struct(*passing))
    copy = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[F.col(f"passing.{c}").alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - F.col(f"passing.{c}")).alias(c) for c in COUNTS]),
    )
    return texts.select("part", F.inline(both)).groupBy("part", "mask").agg(*sums).where("n > 0")


class Diagram:
    """A decision diagram from failure masks to counts, one level for each filter.

    Every node stands for a function of the filters from its level on; equal ones are
    one node.  A node has a child for documents that pass the filter of its level and
    one for those that fail, and knows the counts of all documents below it.  No level
    is skipped, so that two neighbouring levels can change places in their own nodes
    alone: nodes above keep their functions, nodes below are shared as they are.
    """

    def __init__(self, counts: Mapping[int, Counts], filters: int, width: int = len(COUNTS)):
        self.order = list(range(filters))
        self.total: dict[int, Counts] = {}
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in self.order]
        empty = (0,) * width
        leaves: dict[Counts, int] = {}
        # Bit 0 of the mask is decided first, so masks are taken with their bits reversed.
        below = []
        for place in range(1 << filters):
            mask = int(f"{place:0{filters}b}"[::-1], 2) if filters else 0
            leaf = tuple(counts.get(mask, empty))
            if leaf not in leaves:
                leaves[leaf] = self._node(leaf)
            below.append(leaves[leaf])
        for level in reversed(range(filters)):
            shared: dict[tuple[int, int], int] = {}
            below = [self._share(shared, lo, hi) for lo, hi in zip(below[::2], below[1::2])]
            self.levels[level] = {node: pair for pair, node in shared.items()}
        self.root = below[0]

    def _node(self, total: Counts) -> int:
        self.last = getattr(self, "last", -1) + 1
        self.total[self.last] = total
        return self.last

    def _share(self, shared: dict[tuple[int, int], int], lo: int, hi: int) -> int:
        if (lo, hi) not in shared:
            shared[lo, hi] = self._node(tuple(x + y for x, y in zip(self.total[lo], self.total[hi])))
        return shared[lo, hi]

    def swap(self, level: int) -> None:
        """The filters of this level and the next change places."""
        upper, lower = self.levels[level], self.levels[level + 1]
        shared: dict[tuple[int, int], int] = {}
        for node, (lo, hi) in upper.items():
            (a, b), (c, d) = lower[lo], lower[hi]
            upper[node] = (self._share(shared, a, c), self._share(shared, b, d))
        for node in lower:
            del self.total[node]
        self.levels[level + 1] = {node: pair for pair, node in shared.items()}
        self.order[level : level + 2] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, Counts, Counts]]:
        """(filter, counts it keeps, counts it removes) along the path of what passes all before."""
        node, found = self.root, []
        for level, which in enumerate(self.order):
            lo, hi = self.levels[level][node]
            found.append((which, self.total[lo], self.total[hi]))
            node = lo
        return found

    def failing_only(self, which: int) -> Counts:
        """Counts of what fails this filter and passes all others."""
        node = self.root
        for level, here in enumerate(self.order):
            node = self.levels[level][node][here == which]
        return self.total[node]


def adjacent_swaps(n: int) -> list[int]:
    """Places of n! - 1 swaps of neighbours that lead through all orders of n things.

    The last thing sweeps through the others from end to end; between two sweeps the
    others take their own next swap.
    """
    if n < 2:
        return []
    sweep = list(range(n - 1))
    out = []
    for turn, inner in enumerate([*adjacent_swaps(n - 1), None]):
        leftwards = turn % 2 == 0
        out += sweep[::-1] if leftwards else sweep
        if inner is not None:
            out.append(inner + leftwards)
    return out


def audit_part(counts: Mapping[int, Counts], filters: Sequence[str] = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, fails only this, good lost, toxic lost, shapley) of all orders.

    ``counts``: mask to (documents, good, toxic).  The diagram is built once, and each
    next order is one swap of neighbouring levels away.  With k filters there are k!
    orders and 2^k masks, so k is meant to be small.
    """
    diagram = Diagram(counts, len(filters))
    walks = [(tuple(diagram.order), diagram.steps())]
    only = [diagram.failing_only(f)[0] for f in range(len(filters))]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        walks.append((tuple(diagram.order), diagram.steps()))
    fails, shapley = [0] * len(filters), [0] * len(filters)
    for _, steps in walks:
        for at, (f, _, removed) in enumerate(steps):
            shapley[f] += removed[0]
            if at == 0:
                fails[f] = removed[0]
    return [
        ("".join(filters[f] for f in order), at + 1, kept[0], gone[0], fails[f] - gone[0], only[f], gone[1], gone[2], shapley[f])
        for order, steps in walks
        for at, (f, kept, gone) in enumerate(steps)
    ]


RESULT = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def audit(masks: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """The steps of all orders for each part of ``masks`` (part, mask, n, good, toxic).

    A part has at most one row for each mask, whatever the number of its documents; its
    diagram is built and reordered in one task, other parts in others.  A table without
    rows has no parts and gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = audit_part({r["mask"]: tuple(r[c] for c in COUNTS) for r in rows}, filters)
                columns = [[part] * len(found), *map(list, zip(*found))]
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                names = [field.split()[0] for field in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))
    return parts.mapInArrow(run, RESULT)
