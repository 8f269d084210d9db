"""Mixing sources to target weights, with DataFrame expressions only.

1. Each text's size is its number of words. A source's words stand in one line (documents in a fixed order) that is
   cut into blocks of `block` words; a document is in the blocks that its words touch.
2. Sources by code point, null last, weigh 5, 2, 1 and so on again. They share 150 % of all words; a target stops at
   twice its source's words and the excess is shared again by weight, in closed form (the water level).
3. The mix is a row of output shards of `slots` block slots. Each slot draws its source with probability in proportion
   to the targets, so a shard's counts are a multinomial draw. Draws beyond the blocks due to a source are handed, in
   slot order, to sources that drew too few: totals are exact.
4. The k-th slot of a source takes block permute(k mod n) of its n blocks in pass k div n. Each pass has its own
   pseudorandom permutation. At most two passes run, so no word is taken more than twice.
5. Slots and documents meet by an equi-join on (source, block).

Prefix sums are two-level, buckets first and then rows in a bucket, so no task holds a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import common

#: Weights of the sources, in turn.
WEIGHTS = (5, 2, 1)
#: Cells of the lookup that finds the owner of a position on a line of intervals.
CELLS = 4096


@dataclass
class Mix:
    """slots: shard, slot, sid, pass, block. documents: doc_id, source, sid, size, source_size, target, taken."""

    slots: DataFrame
    documents: DataFrame


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of each row; null text has size 0."""
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(common.WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def targets(counted: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, sid (rank), source_size and target: one row for each source."""
    total = counted.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1
    rows = total.withColumn("sid", sid)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    # In order of cap per weight, the first source whose cap is not below the level of those from it on sets the level; later levels are lower.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - full) / open_weight)
    water = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    rows = rows.withColumn("water", water)
    return rows.select("source", "sid", "source_size", F.least("cap", F.coalesce(F.col("weight") * F.col("water"), F.col("cap"))).alias("target"))


def permute(index: Column, n: Column, key: Column, walk: int = 24) -> Column:
    """A pseudorandom permutation of 0..n-1, by Feistel steps on a grid of ceil(sqrt(n)) by ceil(n / that) cells.

    An image outside 0..n-1 is mapped again. Fewer than sqrt(n) cells lie outside, so for n up to 484 at most 22 more
    steps are needed, and above that each step ends with a probability over 95 %: 24 leave one in 10^31.
    """
    high = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")
    low = F.ceil(n / high).cast("long")

    def step(x: Column) -> Column:
        a, b = F.floor(x / low).cast("long"), F.pmod(x, low)
        for r in range(0, 4, 2):
            a = F.pmod(a + F.pmod(F.xxhash64(b, key, F.lit(r)), high), high)
            b = F.pmod(b + F.pmod(F.xxhash64(a, key, F.lit(r + 1)), low), low)
        return a * low + b

    first = step(index)
    return F.when(first < n, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(walk)), first, lambda x, _: F.when(x < n, x).otherwise(step(x))))


def running(df: DataFrame, group: str, bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Add `out`, the exclusive prefix sum of `value` in each group, by bucket and then by `order`."""
    df = df.withColumn("_value", value)
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, bucket).agg(F.sum("_value").alias("_total"))
    base = base.select(group, bucket, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_base"))
    own = df.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return own.join(base, [group, bucket]).withColumn(out, (F.col("_base") + F.col("_own")).cast("long")).drop("_value", "_own", "_base")


def owners(df: DataFrame, at: str, intervals: DataFrame, length: int) -> DataFrame:
    """Join each row to the interval (lo <= at < hi) of 0..length that holds it, by an equi-join on one of CELLS cells."""
    cell = max(1, -(-length // CELLS))
    spread = intervals.where("lo < hi").withColumn("_cell", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))))
    rows = df.withColumn("_cell", F.expr(f"{at} div {cell}"))
    return rows.join(common.small(spread), "_cell").where((F.col("lo") <= F.col(at)) & (F.col(at) < F.col("hi"))).drop("_cell")


def line(table: DataFrame, length: str) -> DataFrame:
    """Add lo and hi: the intervals of the given lengths, one after the other by sid. For tables by source."""
    w = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("hi", F.sum(length).over(w).cast("long")).withColumn("lo", F.col("hi") - F.col(length))


def mix(docs: DataFrame, block: int = 64, slots: int = 4096, share: float = 1.5, most: float = 2.0, seed: int = 17) -> Mix:
    """The mix of docs (doc_id, text, source). Reruns agree: every draw is a hash of seed, shard and slot.

    Null text has size 0 and is never taken; a null source is a source of its own, the last. Null ids and repeated rows
    stay rows of their own. An empty table, or one without words, gives no slots. Other columns are not read.
    """
    spark = docs.sparkSession
    counted = common.staged(sizes(docs), "mix-sizes")
    by_source = common.staged(targets(counted, share, most).withColumn("blocks", F.ceil(F.col("source_size") / block)), "mix-targets")
    due = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), most * F.col("blocks"))).otherwise(0)
    by_source = by_source.withColumn("due", due.cast("long"))
    n, length = counted.count(), by_source.agg(F.coalesce(F.sum("due"), F.lit(0))).first()[0]

    # Documents on their source's line, and the blocks they touch.
    buckets = math.isqrt(n) + 1
    rows = counted.join(common.small(by_source.select(F.col("source").alias("_source"), "sid", "source_size", "target")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, size), {buckets})"))
    laid = common.staged(running(rows, "sid", "bucket", ["doc_id", "size"], F.col("size"), "at").drop("bucket"), "mix-layout")
    touched = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    touched = touched.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block))

    # Multinomial draws by slot.
    n_shards = -(-length // slots)
    group = math.isqrt(n_shards) + 1
    slot_rows = spark.range(length).select(F.expr(f"id div {slots}").alias("shard"), F.expr(f"id % {slots}").alias("slot"))
    spot = F.pmod(F.xxhash64(F.lit(seed), "shard", "slot"), F.lit(max(1, length)))
    drawn = owners(slot_rows.withColumn("spot", spot), "spot", line(by_source.select("sid", "due"), "due"), length)
    drawn = running(drawn.select("shard", "slot", "sid", F.expr(f"shard div {group}").alias("part")), "sid", "part", ["shard", "slot"], F.lit(1), "rank")
    drawn = common.staged(drawn.drop("part"), "mix-draws")

    # Hand surplus draws to sources in need.
    count = drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    balance = by_source.select("sid", "due", "blocks").join(count, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    balance = balance.withColumn("over", F.greatest(F.col("got") - F.col("due"), F.lit(0))).withColumn("under", F.greatest(F.col("due") - F.col("got"), F.lit(0)))
    balance = common.staged(balance, "mix-balance")
    surplus = balance.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]
    keyed = common.small(balance.select("sid", "due", "blocks"))
    good = drawn.join(keyed, "sid").where("rank < due").select("shard", "slot", "sid", "rank", "blocks")
    extra = drawn.join(common.small(line(balance.select("sid", "due", "over"), "over").select("sid", "due", F.col("lo").alias("first"))), "sid").where("rank >= due")
    extra = extra.select("shard", "slot", (F.col("first") + F.col("rank") - F.col("due")).alias("spot"))
    moved = owners(extra, "spot", line(balance.select("sid", "got", "blocks", "under"), "under"), surplus)
    moved = moved.select("shard", "slot", "sid", (F.col("got") + F.col("spot") - F.col("lo")).alias("rank"), "blocks")
    passes = F.expr("rank div blocks")
    placed = good.unionByName(moved).withColumn("pass", passes)
    placed = placed.withColumn("block", permute(F.expr("rank % blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), "sid", "pass"))).drop("rank", "blocks")

    # Join blocks by index; words of a block are taken once for each slot that holds it.
    times = placed.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    kept = ["sid", "at", "doc_id", "source", "size", "source_size", "target"]
    taken = touched.join(times, ["sid", "block"], "left").groupBy(*kept).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    bare = laid.where("size = 0").select(*kept).withColumn("taken", F.lit(0).cast("long"))
    return Mix(placed, taken.unionByName(bare).drop("at"))


def copies(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs with each row as often as the mix takes it: taken / size, rounded up or down by a hash of its id.

    The mean over documents is taken / size, so sources come near their targets in whole documents; 0 to 2 copies.
    Rows with equal ids and sizes share the mean of their parts of the mix. A document without words stays once. Null ids, texts
    and sources are values like others; other columns stay as they are (names with a leading underscore are for the operator);
    an empty table gives no rows.
    """
    rows = mix(docs, seed=seed).documents.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"))
    ratio = rows.agg((F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).alias("_ratio"))
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(common.WORD)).cast("long")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size"))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2**40)) / F.lit(float(2**40))
    times = F.when(F.col("_words") == 0, F.lit(1)).otherwise(F.floor(F.col("_ratio") + u).cast("int"))
    return docs.withColumn("_words", words).join(ratio, key).withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select(*docs.columns)
