"""The trie of conversation prefixes, by ROLLUP over positional columns of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.llm.shared import WORD, narrowed, stored

#: Conversations are rebuilt on the head of the one whose id is the next lower multiple of ``FAMILY``.
FAMILY = 20
#: The head has fewer turns than this.
HEADS = 4
#: Turn-id columns of a block.
WIDTH = 8
#: Most turns of a conversation that are held in one row; whole blocks.
SEGMENT = 4096
#: Ids are joined to text in ranges of so many before they are hashed.
IDS = 1024
ROOT = bytes(16)
_EMPTY = hashlib.sha256().hexdigest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _joined(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda all_, x: F.concat(all_, x))


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("int")


def numbered(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, pos (from 0), tid of every turn; ``tid`` holds an MD5 of role and text, and the text's words.

    Turns come by ``turn``, null first, turns that share one by their digest; a null role
    or text is empty; repeated rows are turns of their own; rows without an id belong to
    no conversation and go.  Rows are dealt out by ranges of the order itself, so a
    conversation of any length is numbered by many tasks: each counts its own rows and
    adds those of earlier ranges.  Only a conversation that goes over a range's end has
    earlier rows, so there are fewer such counts than ranges.
    """
    rows = narrowed(conversations, conv_id=conv, turn=turn, role=role, text=text).where("conv_id IS NOT NULL")
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    same = F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_).cast("binary")
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text_, F.lit(WORD))), 8, "0"))
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.concat(_digest(same), words).alias("tid"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("tid"), F.col("row")]
    rows = stored(rows.repartitionByRange(F.col("conv_id"), *order).withColumn("range", F.spark_partition_id()))
    sizes = rows.groupBy("conv_id", "range").count()
    earlier = F.sum("count").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("conv_id", "range", earlier.alias("before")).where("before > 0")
    rank = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order)) - 1
    rows = rows.withColumn("rank", rank).join(F.broadcast(before), ["conv_id", "range"], "left")
    return rows.select("conv_id", (F.col("rank") + F.coalesce("before", F.lit(0))).cast("bigint").alias("pos"), "tid")


def _chained(ids: Column, prior: Column, depth: Column, width: int) -> Column:
    """array<struct<prior, depth, ids>>: the blocks of ``ids``, each with the node that the one before ends at."""
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ids) / width).cast("int") - 1, F.lit(0))), lambda i: F.slice(ids, i * width + 1, width))
    keys = F.aggregate(cuts, F.array(prior), lambda ks, cut: F.concat(ks, F.array(_digest(F.element_at(ks, -1), _joined(cut)))))
    # One key more than blocks: that of the last block's end.
    blocks = F.transform(cuts, lambda cut, i: F.struct(F.get(keys, i).alias("prior"), (depth + i * width).alias("depth"), cut.alias("ids")))
    return F.struct(blocks.alias("blocks"), F.element_at(keys, -1).alias("end"))


def rebuilt_paths(turns: DataFrame, width: int = WIDTH, segment: int = SEGMENT) -> DataFrame:
    """conv_id, blocks, end: the rebuilt conversations of ``turns`` (conv_id, pos, tid), in blocks of turn ids.

    Conversation c has the first h turns of the one at c - c % ``FAMILY`` (all, if it has
    fewer; none, if there is no such one), then its own after its first h; h is the CRC32
    of its id, modulo ``HEADS``.  ``blocks`` is an array of (prior, depth, ids): up to
    ``width`` turn ids, and the key and depth of the node they continue.  ``end`` is the
    key of the conversation's last node, on its last row; the others have null.  A
    conversation without turns has one block without ids.

    A row holds up to ``segment`` turns; those of a longer conversation are rows of their
    own, a round each, which begin with the key where the round before ended.
    """
    if segment % width or segment < HEADS:
        raise ValueError("a segment must hold whole blocks, and a head")
    conv = F.col("conv_id")
    heads = turns.where((conv % FAMILY == 0) & (F.col("pos") < HEADS - 1)).groupBy("conv_id")
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("head"))
    heads = heads.select(conv.alias("source"), F.col("head.tid").alias("head"))
    own = turns.where(F.col("pos") >= head_length(conv)).withColumn("seg", F.floor(F.col("pos") / segment))
    # Where the head is shorter than what it replaces, turns move up: the first of a segment may belong to the one before.
    early = (F.col("pos") % segment < HEADS - 1) & (F.col("seg") > 0)
    own = own.withColumn("seg", F.explode(F.when(early, F.array(F.col("seg"), F.col("seg") - 1)).otherwise(F.array("seg"))))
    own = stored(own.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "tid"))).alias("own")))
    convs = turns.select("conv_id").distinct().select("conv_id", head_length(conv).alias("h"), (conv - conv % FAMILY).alias("source"))
    first = convs.join(heads, "source", "left").join(own.where("seg = 0").select("conv_id", "own"), "conv_id", "left")
    none = F.array().cast("array<binary>")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest("h", F.lit(1)))).otherwise(none)
    first = first.withColumn("head", head).withColumn("up", F.col("h") - F.size("head")).withColumn("prior", F.lit(ROOT))
    found, turn = [], 0
    state = first
    while True:
        low = F.col("up") + turn * segment
        own_ids = F.filter(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), lambda x: (x["pos"] >= low) & (x["pos"] < low + segment))
        ids = F.transform(own_ids, lambda x: x["tid"])
        rows = state.withColumn("ids", ids if turn else F.concat("head", ids))
        rows = rows.withColumn("chain", _chained(F.col("ids"), F.col("prior"), F.lit(turn * segment).cast("bigint"), width))
        size = F.size("ids")
        blocks = F.col("chain.blocks") if turn == 0 else F.when(size > 0, F.col("chain.blocks")).otherwise(F.slice("chain.blocks", 1, 0))
        last = F.when(size == 0, F.col("prior")).otherwise(F.col("chain.end"))
        rows = stored(rows.select("conv_id", "up", blocks.alias("blocks"), last.alias("last"), (size == segment).alias("goes_on")))
        found.append(rows.select("conv_id", "blocks", F.expr("if(goes_on, NULL, last)").alias("end")))
        going = rows.where("goes_on").select("conv_id", "up", F.col("last").alias("prior"))
        if going.isEmpty():
            break
        turn += 1
        state = going.join(own.where(F.col("seg") == turn).select("conv_id", "own"), "conv_id", "left")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def rolled_up(paths: DataFrame, aggregates: str, width: int = WIDTH) -> DataFrame:
    """key, parent, depth, words and ``aggregates`` (SQL) over the conversations of each node of ``paths``.

    One ROLLUP over the turn-id columns of all blocks: its grouping sets are the prefixes
    of a block, its grouping id tells how long the prefix is.  A set that ends in a column
    a conversation does not reach is no node, and the set without columns is one at the
    root alone; elsewhere it is the node at which the block before ends.
    """
    names = [f"t{i + 1}" for i in range(width)]
    others = [c for c in paths.columns if c not in ("blocks", "end")]
    blocks = paths.select(*others, F.inline("blocks")).select(*others, "prior", "depth", *[F.get("ids", F.lit(i)).alias(t) for i, t in enumerate(names)])
    columns = ", ".join(names)
    found = paths.sparkSession.sql(
        f"""SELECT prior, depth AS above, array({columns}) AS ids, {width} - bit_count(grouping_id()) AS d, {aggregates}
            FROM {{blocks}} GROUP BY prior, depth, ROLLUP ({columns})""",
        blocks=blocks,
    )
    found = found.where(F.when(F.col("d") == 0, F.col("above") == 0).otherwise(F.get("ids", F.col("d") - 1).isNotNull()))
    key = lambda n: F.when(n <= 0, F.col("prior")).otherwise(_digest(F.col("prior"), _joined(F.slice("ids", 1, n))))
    words = F.conv(F.hex(F.substring(F.get("ids", F.col("d") - 1), 17, 4)), 16, 10).cast("bigint")
    others = [c for c in found.columns if c not in ("prior", "above", "ids", "d")]
    return found.select(
        key(F.col("d")).alias("key"),
        F.when(F.col("d") > 0, key(F.col("d") - 1)).alias("parent"),
        (F.col("above") + F.col("d")).alias("depth"),
        F.coalesce(words, F.lit(0)).alias("words"),
        *others,
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, sha of comma-joined texts that come sorted by key; one hash state at a time."""
    key, state = None, None
    for batch in batches:
        keys, shas = [], []
        for now, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if now == key:
                state.update(b",")
            else:
                if state:
                    keys.append(key)
                    shas.append(state.hexdigest())
                key, state = now, hashlib.sha256()
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], ["key", "sha"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])


def id_digests(ends: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of the ascending, comma-joined ids (key, conv_id) of each key.

    A hash reads its text in order, so one task hashes a key, but the ids reach it as
    texts of up to ``IDS`` of them, sorted and joined by many tasks, and it holds one
    text at a time.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("key", F.floor(F.col("conv_id") / IDS).alias("range")).agg(text.alias("text"))
    return texts.repartition("key").sortWithinPartitions("key", "range").mapInArrow(_hashed, "key binary, sha string")


def trie(paths: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of ``paths``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Sums over subtrees need no walk through the levels.  Every node belongs to its
    smallest member.  On the path of a conversation its own nodes are the last ones, and
    a node whose subtree holds one of them lies on that path: so the sum over a subtree
    is the sum, over its members, of what their own nodes hold, which a second ROLLUP
    gives.  Only the smallest member can have own nodes above the top; these are taken
    off again, as a running sum along that member's own nodes.
    """
    nodes = stored(rolled_up(paths, "count(*) AS n_convs, min(conv_id) AS conv_id", width))
    children = stored(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")))
    nodes = nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("words"))
    full = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    own = full.groupBy("conv_id").agg(F.sum("saves").alias("saves"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"))
    weighed = paths.select("conv_id", "blocks").join(own, "conv_id", "left")
    below = rolled_up(weighed, "coalesce(sum(saves), 0) AS saves_below, coalesce(sum(leaves), 0) AS n_leaves", width)
    below = below.select("key", "saves_below", "n_leaves")
    # What the smallest member's own nodes above this one save, summed by stretches of its path.
    stretch = F.floor(F.col("depth") / SEGMENT)
    full = full.withColumn("stretch", stretch)
    of = full.groupBy("conv_id", "stretch").agg(F.sum("saves").alias("s"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    of = of.select("conv_id", "stretch", F.sum("s").over(earlier).alias("far")).where("far IS NOT NULL")
    above = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("near", F.sum("saves").over(above)).join(of, ["conv_id", "stretch"], "left")
    zero = F.lit(0).cast("bigint")
    shas = id_digests(paths.where("end IS NOT NULL").select(F.col("end").alias("key"), "conv_id"))
    full = full.join(below, "key").join(shas, "key", "left")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, "parent", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("saves_below") - F.coalesce("near", zero) - F.coalesce("far", zero)).alias("saved_tokens"),
        F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    width: int = WIDTH,
    segment: int = SEGMENT,
) -> DataFrame:
    """The trie of the rebuilt conversations, a row per node.

    The root is there as soon as there is a conversation; a table without rows, or with
    null ids alone, gives none.  A null role or text is empty, a very long text counts
    whole and travels as its digest; turns that share a number come in the order of that
    digest, repeated rows are repeated turns.
    """
    return trie(rebuilt_paths(stored(numbered(conversations, conv, turn, role, text)), width, segment), width)
