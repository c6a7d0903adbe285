"""Repeated passages, byte by byte, by a depth-limited radix sort of suffixes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprism.llm.shared import narrowed, stored, text_bytes

THRESHOLD = 200
#: Different contexts of one anchor that are sorted in one task; larger groups are dealt out by window.
GROUP = 1 << 16
#: Contexts of a group that are compared in pairs.
FEW = 48
_BLOCK = 1 << 17
_PLACE = np.dtype([("rid", "<i8"), ("rid2", "<i4"), ("pos", "<i4")])


class Digits:
    """The first radix digit of suffixes: a 64-bit hash of their first ``width`` bytes."""

    def __init__(self, width: int):
        self.width = width
        draw = np.random.Generator(np.random.PCG64(width))
        self.of_byte = draw.integers(1, 1 << 63, 256, np.uint64)
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            steps = _BLOCK + 64 * width
            self.up = np.cumprod(np.full(steps, base, np.uint64))
            self.down = np.cumprod(np.full(steps, inverse, np.uint64))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """One for each place where ``width`` bytes start; ``data`` of a block and its margin."""
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self.of_byte[data] * self.up[: len(data)], out=sums[1:])
            n = len(data) - self.width + 1
            out = (sums[self.width :] - sums[:n]) * self.down[:n]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out | np.uint64(1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, cuts: np.ndarray, digits: Digits, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and first digits of the suffixes that are sorted.

    Of all suffixes that start in a window, as far as their first digit lies in it, those
    of the smallest digit are taken.  Equal windows thus have an anchor at equal places,
    and about one suffix in ``threshold`` / 4 is sorted instead of all.
    """
    span = threshold - digits.width + 1
    places, found = [], []
    for start in range(0, len(data) - threshold + 1, _BLOCK):
        block = data[start : start + _BLOCK + threshold - 1]
        h = digits(block)
        least = _sliding(h, span, np.minimum)
        n = len(least)
        # Windows that cross the end of a row are none.
        lo, hi = np.searchsorted(cuts, [start + 1, start + n + threshold])
        for end in cuts[lo:hi].tolist():
            least[max(0, end - threshold + 1 - start) : max(0, min(n, end - start))] = 0
        padded = np.zeros(n + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + n] = least
        most = _sliding(padded, span, np.maximum)
        at = np.flatnonzero(h == most)
        places.append(at + start)
        found.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(found)[first]


def _first_pass(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    """h, ck, sides, n, places: the anchors of a batch, by digit and context.

    The context is all that windows around the anchor can reach, ck a hash of it, sides
    its lengths on the left and right.  What a batch has of one context is one row.
    """
    import xxhash

    digits, left_most, digest = Digits(digit), threshold - digit, xxhash.xxh64_intdigest
    for batch in batches:
        data, cuts = text_bytes(batch)
        at, h = anchors(data, cuts, digits, threshold)
        # The later of rows that start at one place is the one with bytes.
        row = np.searchsorted(cuts, at, side="right") - 1
        left = np.minimum(at - cuts[row], left_most)
        right = np.minimum(cuts[row + 1] - at, threshold)
        sides = (left << 16 | right).astype(np.int32)
        raw = data.tobytes()
        ends = zip((at - left).tolist(), (at + right).tolist(), sides.tolist())
        ck = np.array([digest(raw[a:b], s) for a, b, s in ends], np.uint64).view(np.int64)
        order = np.lexsort((ck, h))
        at, h, ck, sides, row = at[order], h[order], ck[order], sides[order], row[order]
        packed = np.empty(len(at), _PLACE)
        packed["rid"] = batch.column(1).to_numpy(zero_copy_only=False)[row]
        packed["rid2"] = batch.column(2).to_numpy(zero_copy_only=False)[row]
        packed["pos"] = at - cuts[row]
        new = np.flatnonzero(np.append(True, (np.diff(h) != 0) | (np.diff(ck) != 0))) if len(at) else at
        edges = np.append(new, len(at)).astype(np.int64)
        for lo in range(0, len(new), 1 << 16):
            hi = min(lo + (1 << 16), len(new))
            body = np.ascontiguousarray(packed[edges[lo] : edges[hi]]).view(np.uint8)
            cut = ((edges[lo : hi + 1] - edges[lo]) * _PLACE.itemsize).astype(np.int32)
            some = new[lo:hi]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[some].view(np.int64)),
                    pa.array(ck[some]),
                    pa.array(sides[some]),
                    pa.array(np.diff(edges[lo : hi + 1])),
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut), pa.py_buffer(body)]),
                ],
                ["h", "ck", "sides", "n", "places"],
            )


def _unpacked(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """The other columns once for each place, with rid, rid2 and pos; with ``first`` only for the first."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            parts = [np.frombuffer(p.as_buffer(), _PLACE, 1 if first else -1) for p in batch.column(0)]
            packed = np.concatenate(parts)
            at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(packed[c])) for c in _PLACE.names] + [c.take(at) for c in batch.columns[1:]],
                [*_PLACE.names, *batch.schema.names[1:]],
            )


def _contexts(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    """h, ck, sides, n, context: the bytes of the contexts asked of each row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            data, cuts = text_bytes(part)
            raw = data.tobytes()
            out = defaultdict(list)
            for i, asked in enumerate(part.column(part.schema.get_field_index("at"))):
                for place in asked.as_py():
                    p = int(cuts[i]) + place["pos"]
                    for name in ("h", "ck", "sides", "n"):
                        out[name].append(place[name])
                    out["context"].append(raw[p - (place["sides"] >> 16) : p + (place["sides"] & 0xFFFF)])
            if out:
                kinds = {"h": pa.int64(), "ck": pa.int64(), "sides": pa.int32(), "n": pa.int64(), "context": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in kinds.items()], list(kinds))


def window_starts(sides: int, threshold: int) -> range:
    """How many bytes before its anchor a window can start, from its context's sides."""
    left, right = sides >> 16, sides & 0xFFFF
    return range(max(0, threshold - right), left + 1)


def _by_pairs(group: list[tuple[int, int, bytes]], threshold: int) -> list[set[int]]:
    """As ``repeated_windows``, by comparing the few contexts of a group with each other.

    Two contexts share the windows that reach no further to the left and the right of
    the anchor than they agree.
    """
    most = max(sides >> 16 for sides, _, _ in group)
    left = [int.from_bytes(c[: s >> 16][::-1].ljust(most, b"\0"), "big") for s, _, c in group]
    right = [int.from_bytes(c[s >> 16 :].ljust(threshold, b"\0"), "big") for s, _, c in group]
    found = [set(window_starts(s, threshold)) if n > 1 else set() for s, n, _ in group]
    for i, (a, n, _) in enumerate(group):
        for j in range(i):
            b, k, _ = group[j]
            if n > 1 and k > 1:
                continue
            near = min(threshold - ((right[i] ^ right[j]).bit_length() + 7) // 8, a & 0xFFFF, b & 0xFFFF)
            far = min(most - ((left[i] ^ left[j]).bit_length() + 7) // 8, a >> 16, b >> 16)
            if near + far >= threshold:
                shared = range(threshold - near, far + 1)
                found[i].update(shared)
                found[j].update(shared)
    return found


def repeated_windows(group: list[tuple[int, int, bytes]], threshold: int, digit: int) -> list[list[int]]:
    """For each (sides, n, context) the starts before the anchor of windows that occur again.

    The suffixes that start at one distance from the anchor are sorted by digits, the
    most significant first; a class of one suffix is done, and classes that are left
    after ``threshold`` bytes are the repeated windows.
    """
    if len(group) <= FEW:
        return [sorted(f) for f in _by_pairs(group, threshold)]
    found: list[list[int]] = [[] for _ in group]
    by_start = defaultdict(list)
    for i, (sides, _, _) in enumerate(group):
        for d in window_starts(sides, threshold):
            by_start[d].append(i)
    for d, members in sorted(by_start.items()):
        classes = [members]
        for depth in range(0, threshold, digit):
            finer = []
            for one in classes:
                split = defaultdict(list)
                for i in one:
                    sides, _, context = group[i]
                    at = (sides >> 16) - d
                    split[context[at + depth : at + min(depth + digit, threshold)]].append(i)
                finer += [c for c in split.values() if len(c) > 1 or group[c[0]][1] > 1]
            classes = finer
        for one in classes:
            for i in one:
                found[i].append(d)
    return found


def runs(numbers: list[int]) -> list[tuple[int, int]]:
    """Ascending numbers as runs (first, last)."""
    out: list[tuple[int, int]] = []
    for x in numbers:
        if out and out[-1][1] == x - 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def _sorted_groups(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    """h, ck, ranges of the contexts of each group."""
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    for batch in batches:
        h, ck, ranges = [], [], []
        for key, members in zip(batch.column(0).to_pylist(), batch.column(1)):
            members = members.as_py()
            group = [(m["sides"], m["n"], m["context"]) for m in members]
            for m, starts in zip(members, repeated_windows(group, threshold, digit)):
                if starts:
                    h.append(key)
                    ck.append(m["ck"])
                    ranges.append([{"lo": a, "hi": b} for a, b in runs(starts)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(ck, pa.int64()), pa.array(ranges, kind)], ["h", "ck", "ranges"]
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_bytes, spans, kept: the removed runs and the bytes left of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            data, cuts = text_bytes(part)
            raw = data.tobytes()
            sizes, spans, kept = [], [], []
            for i, removed in enumerate(part.column(part.schema.get_field_index("removed"))):
                own = raw[int(cuts[i]) : int(cuts[i + 1])]
                merged: list[dict] = []
                if removed.is_valid:
                    both = np.sort(removed.values.to_numpy(zero_copy_only=False))
                    starts, ends = both >> 32, np.maximum.accumulate(both & 0xFFFFFFFF)
                    first = np.flatnonzero(np.append(True, starts[1:] > ends[:-1]))
                    last = np.append(first[1:] - 1, len(starts) - 1)
                    merged = [{"start": a, "end": b} for a, b in zip(starts[first].tolist(), ends[last].tolist())]
                at, pieces = 0, []
                for m in merged:
                    pieces.append(own[at : m["start"]])
                    at = m["end"]
                pieces.append(own[at:])
                sizes.append(len(own))
                spans.append(merged)
                kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )


def remove_repeats(
    docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, group: int = GROUP
) -> DataFrame:
    """id, n_bytes, spans (removed runs: start, end in bytes), kept (bytes left).

    One row per row of ``docs``.  A byte goes if a string of ``threshold`` bytes that
    covers it also starts anywhere else, in the same row or another; rows are judged as
    they came.  Strings do not cross rows.  A null text is empty; rows that repeat others
    repeat their strings; a text shorter than ``threshold`` keeps all its bytes.

    1. The first radix pass: anchors (see there) by their first digit, with a hash of all
       that windows around them can reach, their context.  What one batch of rows has of
       a context travels as one row.  Digits that occur once are done.
    2. A digit with one context repeats all its windows.
    3. Of a digit with several, the bytes of each context are fetched once and its windows
       are sorted on, in groups of bounded size; larger groups are dealt out by window.
    4. The ranges found go back to the places of each context.

    The texts are shuffled once, by row; the plan reuses that shuffle.
    """
    digit = max(1, threshold // 4)
    rows = narrowed(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    key = [F.xxhash64("id", "text").alias("rid"), (F.crc32(F.encode("text", "UTF-8")) % (1 << 31)).cast("int").alias("rid2")]
    dealt = rows.select("id", "text", *key).repartition("rid", "rid2")
    of_row, place = ["rid", "rid2"], "rid bigint, rid2 int, pos int"

    first = rows.where(F.octet_length("text") >= threshold).select("text", *key)
    first = first.mapInArrow(
        lambda b: _first_pass(b, threshold, digit), "h bigint, ck bigint, sides int, n bigint, places binary"
    )
    by_digit, by_context = Window.partitionBy("h"), Window.partitionBy("h", "ck")
    ranked = first.withColumn("rank", F.dense_rank().over(by_digit.orderBy("ck")))
    ranked = ranked.withColumn("all", F.sum("n").over(by_digit)).withColumn("m", F.max("rank").over(by_digit))
    ranked = ranked.withColumn("own", F.sum("n").over(by_context)).withColumn("nth", F.row_number().over(by_context.orderBy("ck")))
    # Contexts that all occur again repeat all their windows, as if each were the only one.
    ranked = ranked.withColumn("lone", F.min("own").over(by_digit))
    m = F.when(F.col("lone") > 1, F.lit(1)).otherwise(F.col("m")).alias("m")
    left = stored(ranked.where("all > 1").select("h", "ck", "sides", F.col("own").alias("n"), m, "nth", "places"))

    lo, hi = F.greatest(threshold - F.col("sides").bitwiseAND(0xFFFF), F.lit(0)), F.shiftright("sides", 16)
    whole = F.array(F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    alone = left.where((F.col("m") == 1) & (lo <= hi)).select("places", whole.alias("ranges"))
    reps = left.where("m > 1 AND nth = 1").select("places", "h", "ck", "sides", "n", "m")
    contexts = reps.mapInArrow(lambda b: _unpacked(b, True), f"{place}, h bigint, ck bigint, sides int, n bigint, m int")

    def with_bytes(some: DataFrame) -> DataFrame:
        """Each context once, with its bytes.  Equal rows share their key and repeat them."""
        asked = some.groupBy(*of_row).agg(F.collect_set(F.struct("pos", "h", "ck", "sides", "n")).alias("at"))
        # All columns of the shuffled rows, so that the shuffle is the same in each use.
        return dealt.join(asked, of_row).select("text", "id", *of_row, "at").mapInArrow(
            lambda b: _contexts(b, threshold, digit), "h bigint, ck bigint, sides int, n bigint, context binary"
        )

    small = with_bytes(contexts.where(F.col("m") <= group)).groupBy("h").agg(F.collect_set(F.struct("ck", "sides", "n", "context")).alias("members"))
    sorted_on = small.mapInArrow(
        lambda b: _sorted_groups(b, threshold, digit), "h bigint, ck bigint, ranges array<struct<lo:int,hi:int>>"
    )
    large = with_bytes(contexts.where(F.col("m") > group)).dropDuplicates(["h", "ck"]).where(lo <= hi)
    windows = large.select("h", "ck", "n", "sides", "context", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("d"))
    start = F.shiftright("sides", 16) - F.col("d") + 1
    windows = windows.select("h", "ck", "n", "d", F.unhex(F.md5(F.substring("context", start, F.lit(threshold)))).alias("w"))
    counted = windows.groupBy("h", "d", "w").agg(F.sum("n").alias("all")).where("all > 1").select("h", "d", "w")
    dealt_out = windows.join(counted, ["h", "d", "w"]).groupBy("h", "ck").agg(F.sort_array(F.collect_set("d")).alias("ds"))
    # Starts next to each other are one range.
    ends = lambda step: F.filter("ds", lambda d: ~F.array_contains("ds", d + step))
    dealt_out = dealt_out.select("h", "ck", F.arrays_zip(ends(-1).alias("lo"), ends(1).alias("hi")).alias("ranges"))
    ranges = sorted_on.union(dealt_out)

    several = left.where("m > 1").select("h", "ck", "places").join(ranges, ["h", "ck"])
    found = alone.union(several.select("places", "ranges")).mapInArrow(
        lambda b: _unpacked(b, False), f"{place}, ranges array<struct<lo:int,hi:int>>"
    )
    found = found.select(*of_row, "pos", F.explode("ranges").alias("r"))
    # Start and end in one number; rows are shorter than 2^31 bytes.
    start, end = F.col("pos") - F.col("r.hi"), F.col("pos") - F.col("r.lo") + threshold
    span = F.shiftleft(start.cast("bigint"), 32) + end
    removed = found.groupBy(*of_row).agg(F.collect_set(span).alias("removed"))
    kind = rows.schema["id"].dataType.simpleString()
    return (
        dealt.join(removed, of_row, "left")
        .select("id", "text", "removed")
        .mapInArrow(_cut, f"id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
        .withColumnRenamed("id", id)
    )


def summary(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Sizes and digest of what ``remove_repeats`` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        id,
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
