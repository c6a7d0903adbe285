"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.llm.components import components
from colprism.llm.shared import column, narrowed, stored, texts

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 64
#: Most fingerprints of one bucket that are compared with each other in one row.
CHUNK = 1024
_HASHES_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: a bit is set if it is set in over half of the XXH64 of the word shingles.

    A-Z are lower-cased; shingles count as often as they occur; fewer words make one
    shingle of them all; no words give 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()][: len(words) - shingle + 1]
    ends = [*gaps.tolist(), len(joined)][shingle - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        part = zip(starts[at : at + _HASHES_AT_ONCE], ends[at : at + _HASHES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["id", "fp"])

    rows = narrowed(docs, id=id, text=text)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def segments(max_bits: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment.

    Two fingerprints at most ``max_bits`` apart are within its radius in some segment,
    as the radii plus one add up to ``max_bits`` + 1: if each segment differed by more
    than its radius, at least ``max_bits`` + 1 bits would differ.  Radii are 1 and 0, so
    that the balls stay small.
    """
    n = max(1, (max_bits + 2) // 2)
    radii = [1] * (max_bits + 1 - n) + [0] * (2 * n - max_bits - 1)
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i], radii[i]) for i in range(n)]


def _forest(rows: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Of each pair of fingerprint lists, a forest that connects what links connect.

    Work is spared, links are not: a fingerprint that follows in the tree of a nearer
    one is compared again only across trees.
    """
    for batch in rows:
        out_a, out_b = [], []
        for one, two in zip(batch.column(0), batch.column(1)):
            # Without nulls in the list this is a view on the batch.
            x = one.values.to_numpy(zero_copy_only=False).astype(np.int64)
            y = two.values.to_numpy(zero_copy_only=False).astype(np.int64) if two.is_valid else x[:0]
            near = np.bitwise_count((x[:, None] ^ np.concatenate([x, y])[None, :]).view(np.uint64)) <= max_bits
            every = np.concatenate([x, y])
            tree = np.arange(len(every))
            for i in range(len(x)):
                found = np.flatnonzero(near[i])
                # One link to each tree that is not this one's yet.
                others, at = np.unique(tree[found], return_index=True)
                keep = others != tree[i]
                if keep.any():
                    mine = tree[i]
                    out_a += [int(x[i])] * int(keep.sum())
                    out_b += every[found[at[keep]]].tolist()
                    tree[np.isin(tree, others[keep])] = mine
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def near_fingerprints(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links a, b between the different fingerprints ``fp`` of ``nodes``.

    Not every pair at most ``max_bits`` apart comes out, but each such pair is connected
    by the links that do.

    Every segment of the fingerprints has a table of buckets.  A fingerprint looks into
    the buckets at one flipped bit of its segment's value if these come later than its
    own, so a pair of buckets meets once.  Buckets travel as rows of up to ``CHUNK``
    fingerprints: a bucket that near copies fill is several rows, each pair of which is
    compared in one step that returns a forest, never the pairs.
    """
    listed = []
    for at, width, radius in segments(max_bits):
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        listed.append(F.struct(F.lit(at).alias("seg"), F.lit(width).alias("width"), F.lit(radius).alias("radius"), value.alias("val")))
    rows = nodes.select("fp", F.inline(F.array(*listed)))
    sizes = rows.groupBy("seg", "val").count().where(F.col("count") > CHUNK)
    sizes = sizes.select("seg", "val", F.ceil(F.col("count") / (CHUNK / 2)).cast("int").alias("parts"))
    rows = rows.join(sizes, ["seg", "val"], "left")
    part = F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")), F.lit(0)).cast("int").alias("part")
    buckets = stored(
        rows.groupBy("seg", "width", "radius", "val", part).agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    # Within a bucket: a row with itself, and with the later rows of the same bucket.
    alone = buckets.where(F.size("fps") > 1).select("fps", F.lit(None).cast("array<bigint>").alias("others"))
    many = buckets.join(sizes.select("seg", "val"), ["seg", "val"], "left_semi")
    one, two = many.alias("one"), many.alias("two")
    meet = [F.col("one.seg") == F.col("two.seg"), F.col("one.val") == F.col("two.val"), F.col("one.part") < F.col("two.part")]
    same = one.join(two, meet).select(F.col("one.fps").alias("fps"), F.col("two.fps").alias("others"))
    flipped = F.expr("filter(transform(sequence(0, width - 1), b -> val ^ shiftleft(1L, b)), v -> v > val)")
    probes = buckets.where("radius = 1").select("seg", F.explode(flipped).alias("val"), F.col("fps").alias("others"))
    linked = F.exists("fps", lambda x: F.exists("others", lambda y: F.bit_count(x.bitwiseXOR(y)) <= max_bits))
    target = buckets.where("radius = 1").select("seg", "val", "fps")
    across = probes.join(target, (probes.seg == target.seg) & (probes.val == target.val) & linked).select("fps", "others")
    pairs = alone.union(same).union(across)
    return pairs.mapInArrow(lambda rows: _forest(rows, max_bits), "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    One row per row of ``docs``.  Fingerprints at most ``max_bits`` bits apart link their
    rows.  Rows without a word have fingerprint zero and are linked like any other; rows
    with equal ids stay apart rows; a null id counts as larger than any other and is the
    component's only if all are null.  An empty table gives an empty result.
    """
    prints, placed = _placed(docs, id, text, shingle, max_bits)
    return prints.join(placed, "fp").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _placed(docs: DataFrame, id: str, text: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """id, fp of every row; fp, root, component_id of every fingerprint.  Two components can share a component_id, not a root."""
    prints = stored(fingerprints(docs, id, text, shingle))
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(near_fingerprints(nodes, max_bits))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    # Stored, as it is read three times and its plan has a join for each round.
    placed = stored(placed.select("fp", "least", F.coalesce("root", "fp").alias("root")))
    joined = placed.where("root <> fp").select("root").distinct()
    small = placed.join(joined, "root").groupBy("root").agg(F.min("least").alias("component"))
    of = placed.join(small, "root", "left").select("fp", "root", F.coalesce("component", "least").alias("component_id"))
    return prints, of


def _with_fingerprints(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``__fp``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            bits = np.array([fingerprint(t) for t in texts(one)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], [*batch.schema.names, "__fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest id.

    Rows that repeat an id are documents of their own by their texts: of those in one
    group the first by fingerprint and hash of the text is taken.  Rows with a null id
    are documents of their own and stay.
    """
    prints, placed = _placed(docs, id, text, SHINGLE, MAX_BITS)
    found = prints.where("id IS NOT NULL").join(placed, "fp").select(F.col("id").alias("__id"), "fp", "root", "component_id")
    marks = found.groupBy("__id").agg(F.min("component_id").alias("__least"), F.count(F.lit(1)).alias("__rows"))
    # Only ids of rows that go or that are repeated; all other rows stay as they are.
    marks = stored(marks.where("__least < __id OR __rows > 1"))
    left = docs.join(marks, column(id) == marks["__id"], "left")
    own = [column(c) for c in docs.columns]
    repeated = _with_fingerprints(left.where("__rows > 1").select(*own), text)
    # A group's fingerprint tells its root; the row is the first of its id there.
    of = placed.withColumnRenamed("fp", "__fp").withColumnsRenamed({"root": "__root", "component_id": "__component"})
    repeated = repeated.join(of, "__fp").where(column(id) == F.col("__component"))
    order = F.struct("__fp", F.xxhash64(column(text)))
    taken = repeated.groupBy("__root").agg(F.min_by(F.struct(*own), order).alias("__row")).select("__row.*")
    return left.where("__id IS NULL").select(*own).unionByName(taken)
