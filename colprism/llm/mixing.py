"""Sources mixed to target weights in fixed-length blocks.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprism.llm.shared import WORD, column, narrowed, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block.
BLOCK = 2048
#: Blocks in an output shard, on average.
SHARD = 1024
SEED = 20_240
#: Parts of a source's word stream that are summed on their own.
PARTS = 1 << 16
#: Parts next to each other that are summed up together first.
_NEAR = 1 << 8
_WALK = 33
_STRETCH = 4096


def source_key(source: Column) -> Column:
    # "s..." sorts after "null": the sort key below puts null last.
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def sized(docs: DataFrame, id: str, text: str, source: str, seed: int) -> DataFrame:
    """src, id, size, key, part of every row; stored, so the texts are read once."""
    rows = narrowed(docs, id=id, text=text, source=source)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.xxhash64(F.lit(seed), "id", "text")
    return stored(rows.select(source_key(F.col("source")).alias("src"), "id", words.alias("size"), key.alias("key"), F.pmod(key, F.lit(PARTS)).alias("part")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """src, source_size, target: one row per source.

    Sources by code point, null last, take the weights in turn.  ``share`` of all words
    is dealt out by weight; a source that would get over ``most`` times its size gets
    just that, and the others share the rest.  In the order of size to weight the
    capped sources come first: a source is capped if an even deal of what the earlier
    ones leave is more than it can take.
    """
    totals = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src") == "null", "src")
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_need), F.lit(0.0))
    level = totals.withColumn("level", left / F.sum("weight").over(after))
    level = level.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    even = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", even * F.col("weight")))
    return level.select("src", "source_size", target.alias("target"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``: how many words of its source come before a row.

    The rows of a source are in a pseudorandom order.  Sums run within parts of the
    source, over parts next to each other, and over these groups of parts, so no source
    is in one task.
    """
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("near", F.floor(F.col("part") / _NEAR))
    far = parts.groupBy("src", "near").agg(F.sum("words").alias("words"))
    far = far.select("src", "near", F.coalesce(F.sum("words").over(earlier("near", "src")), F.lit(0)).alias("far"))
    parts = parts.withColumn("base", F.coalesce(F.sum("words").over(earlier("part", "src", "near")), F.lit(0)))
    parts = parts.join(far, ["src", "near"]).select("src", "part", (F.col("far") + F.col("base")).alias("base"))
    inside = Window.partitionBy("src", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("before", before).join(parts, ["src", "part"]).withColumn(
        "start", F.col("base") + F.col("before")
    ).drop("base", "before", "part", "key")


def permuted(index: Column, n: Column, *salt: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1, without a table.

    Two rounds of a Feistel network on a grid of about sqrt(n) by sqrt(n) permute all
    its places; those beyond n walk on until they are below.  The grid has fewer than
    sqrt(n) + 1 places too many, so up to n = 1024 the walk always ends in time, and
    above the chance that it does not is below 32 to the power of -33.
    """
    high = F.ceil(F.sqrt(n)).cast("bigint")
    low = F.ceil(n / high).cast("bigint")

    def once(x: Column) -> Column:
        a, b = F.floor(x / low), F.pmod(x, low)
        for turn in range(2):
            a = F.pmod(a + F.pmod(F.xxhash64(*salt, F.lit(2 * turn), b), high), high)
            b = F.pmod(b + F.pmod(F.xxhash64(*salt, F.lit(2 * turn + 1), a), low), low)
        return a * low + b

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)), once(index), lambda x, _: F.when(x < n, x).otherwise(once(x))
    )


def slots(wanted: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, src, epoch, slot, block, take: which words of which block the output has.

    A source gives all its blocks once before any comes again.  Each of the slots that
    a source fills in an epoch falls on a shard at random, which draws the counts of a
    multinomial; the slots of a source then run through the shards in order, and a keyed
    permutation says which block each takes.  The rest that fills no block comes last;
    the last slot takes as many words as are still wanted.
    """
    full = F.floor(F.col("source_size") / block)
    words = F.least(F.floor("target").cast("bigint"), F.col("source_size") * MOST)
    per = wanted.select("src", "source_size", full.alias("full"), F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))).alias("epoch"), words.alias("words"))
    asked = F.least(F.greatest(F.col("words") - F.col("epoch") * F.col("source_size"), F.lit(0)), F.col("source_size"))
    per = per.select("src", "source_size", "full", "epoch", asked.alias("asked")).where("asked > 0")
    per = per.withColumn("n", F.ceil(F.col("asked") / block))
    # A large source is dealt out before its slots are listed.
    stretch = per.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _STRETCH))).alias("stretch"))
    shards = F.greatest(F.ceil(F.sum("n").over(Window.partitionBy()) / shard), F.lit(1))
    counted = per.select("src", "epoch", shards.alias("shards"))
    stretch = stretch.join(counted, ["src", "epoch"]).repartition("src", "epoch", "stretch")
    listed = F.sequence(F.col("stretch") * _STRETCH, F.least(F.col("n"), (F.col("stretch") + 1) * _STRETCH) - 1)
    draws = stretch.select("src", "epoch", "shards", F.explode(listed).alias("draw"))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "src", "epoch", "draw"), F.col("shards"))
    counts = draws.groupBy("src", "epoch", drawn.alias("shard")).agg(F.count("*").alias("count"))
    earlier = Window.partitionBy("src", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot")
    out = counts.select("src", "epoch", "shard", slot).join(per, ["src", "epoch"])
    index = F.when(
        F.col("slot") < F.col("full"), permuted(F.col("slot"), F.greatest("full", F.lit(1)), F.lit(seed), F.col("src"), F.col("epoch"))
    ).otherwise(F.col("slot"))
    take = F.least(F.lit(block), F.col("asked") - F.col("slot") * block)
    return out.select("shard", "src", "epoch", "slot", index.cast("bigint").alias("block"), take.cast("bigint").alias("take"))


def segments(rows: DataFrame, used: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, start, shard, epoch, slot, from, to: the words of a row that each slot takes."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = rows.where("size > 0").select(
        "src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), last)).alias("block")
    )
    both = pieces.join(used, ["src", "block"])
    begin = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    end = F.least(F.col("size"), F.col("block") * block + F.col("take") - F.col("start"))
    return both.select("src", "start", "shard", "epoch", "slot", begin.alias("from"), end.alias("to")).where("to > from")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken of every row of ``docs``.

    ``size`` is the row's words (null text: 0), ``source_size`` and ``target`` those of
    its source, ``taken`` the words that the mix has of it, repeats counted.  The words
    taken of a source are its target, rounded down.  A row is taken whole at most
    ``MOST`` times.  Rows that repeat others are rows of their own; a null source is a
    source.  The same rows give the same mix, however they are partitioned.
    """
    rows = sized(docs, id, text, source, seed)
    wanted = stored(targets(rows))
    at = placed(rows)
    parts = segments(at, slots(wanted, seed=seed))
    taken = parts.groupBy("src", "start").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    # A row without words shares its start with the next one.
    spot = at.withColumn("spot", F.when(F.col("size") > 0, F.col("start")))
    taken = taken.withColumnRenamed("start", "spot")
    whole = spot.join(taken, ["src", "spot"], "left").join(wanted, "src")
    return whole.select(
        F.col("id").alias(id), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` as the mix has them: columns as before, ``text`` of the words taken, and ``taken``.

    A row of which nothing is taken goes; one that is taken just once and whole keeps its
    text as it is; otherwise the text is the words taken, in the order of the slots, with
    single spaces.  Rows with equal id, text and source are told apart by a hash of all
    their columns; rows of other sources are never taken for them.
    """
    rows = sized(docs, id, text, source, seed)
    wanted = stored(targets(rows))
    at = placed(rows.withColumn("copy", F.xxhash64("key", "src")))
    same = Window.partitionBy("copy").orderBy("start")
    at = stored(at.withColumn("nth", F.row_number().over(same)))
    parts = segments(at, slots(wanted, seed=seed))
    parts = parts.groupBy("src", "start").agg(
        F.sort_array(F.collect_list(F.struct("epoch", "slot", "from", "to"))).alias("segments")
    )
    own = at.where("size > 0").join(parts, ["src", "start"]).select("copy", "nth", "size", "segments")
    key = F.xxhash64(F.xxhash64(F.lit(seed), column(id), column(text)), source_key(column(source)))
    hashable = [column(f.name) for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    numbered = docs.withColumn("__copy", key).withColumn(
        "__nth", F.row_number().over(Window.partitionBy("__copy").orderBy(F.xxhash64(*hashable)))
    )
    own = own.withColumnsRenamed({c: f"__{c}" for c in own.columns})
    joined = numbered.join(own, ["__copy", "__nth"])
    words = F.regexp_extract_all(column(text), F.lit(WORD), F.lit(0))
    joined = joined.withColumn("taken", F.aggregate("__segments", F.lit(0).cast("bigint"), lambda acc, s: acc + s["to"] - s["from"]))
    once = (F.col("taken") == F.col("__size")) & F.forall("__segments", lambda s: s["epoch"] == 0)
    joined = joined.withColumn("__words", F.when(~once, words))
    cut = F.flatten(F.transform("__segments", lambda s: F.slice("__words", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))))
    new = F.when(once, column(text)).otherwise(F.array_join(cut, " "))
    return joined.withColumn(text, new).select(*[column(c) for c in docs.columns], "taken")
