"""Mixing sources to target weights: exact block quotas, split over output shards by hypergeometric draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import WORD, written

#: Weights of the sources in order, repeating; and how often a source may be taken in all.
WEIGHTS, MOST = (5, 2, 1), 3
#: A block has this many times the fourth root of its source's documents (a document's block is a hash).
BLOCK_ROOTS = 4
#: Bytes of text aimed at in a shard, and shards at least.
SHARD_BYTES, LEAST_SHARDS = 128 << 20, 64
SEED = 17


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the total of sizes by weight, none above most * size; the excess goes to the others by weight."""
    out, free, total = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if total * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = total * weights[i] / w
            break
        for i in over:
            out[i] = float(most * sizes[i])
        total -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def blocks_of(docs: int) -> int:
    """Blocks of a source: their number and their size both grow with it (100,000 documents: 71 a block; 10 thousand million: 1,264)."""
    return max(1, int(docs**0.75 / BLOCK_ROOTS))


def splitting_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Deals quotas[i] blocks of each source i to the shards: an array (shards, sources) with those column sums.

    Each node splits its blocks between its two halves: how many go left is in proportion to the shards
    there, and of which sources is a multivariate hypergeometric draw without replacement.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1 or not have.sum():
            out[lo] += have
            continue
        mid = (lo + hi) // 2
        many = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, many, method="marginals")
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, shards: int | None = None, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, block, shards, places, and the column `carry`.

    Size is the number of words (null text: 0). Sources in code point order, null last, weigh as `weights`
    repeats, and share the total size; no target is over `most` times its source. A source's documents fall
    into hash blocks in a random but fixed order; whole passes take every block, the last pass takes blocks
    from the front and, in the block where the target ends, documents in hash order until less than half of
    one is wanted (rows that repeat id and text go together). The blocks drawn are dealt to output shards by splitting_tree(),
    to as many shards as the texts' bytes ask for if no number is given; `shards` lists the
    shard of each copy. A source without words has target 0 and is not taken. Rows that repeat a doc_id count
    each. What reaches the driver is one row per source, what leaves it one per source and shard. Texts are read twice where a
    column is carried; they move only if the plan, a row for each block, is too large for Spark to send to all tasks.
    """
    whole_rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"),
        *([carry] if carry else []),
    )
    rows = written(whole_rows.drop(carry) if carry else whole_rows, "sizes")
    stats = sorted(rows.groupBy("source").agg(F.sum("size"), F.count("*"), F.sum("bytes")).collect(), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    spark = docs.sparkSession
    shards = shards or max(LEAST_SHARDS, math.ceil(sum(r[3] for r in stats) / SHARD_BYTES))
    goal = targets([r[1] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], most)
    table = [
        (r[0], i, r[1], t, int(t // r[1]) if r[1] else 0, t - r[1] * int(t // r[1]) if r[1] else 0.0, blocks_of(r[2]))
        for i, (r, t) in enumerate(zip(stats, goal))
    ]
    sources = spark.createDataFrame(table, "own_source string, source_no int, source_size bigint, target double, passes int, wanted double, blocks int")
    sources = written(sources.coalesce(1), "sources")  # its size is then known, so that Spark need not move documents to it

    def in_blocks(df: DataFrame) -> DataFrame:
        return df.join(sources, F.col("source").eqNullSafe(F.col("own_source")), "left").withColumn("block", F.pmod("draw", F.col("blocks")).cast("int"))

    placed = in_blocks(rows)

    # blocks in random order; where in that order the last, partial pass ends. The order is one of ranges, and within each of them
    turn = F.xxhash64(F.lit(seed + 1), "source_no", "block")
    block = placed.groupBy("source_no", "block", "passes", "wanted", "blocks").agg(F.sum("size").alias("words"))
    block = written(block.withColumn("range", F.pmod(turn, F.ceil(F.sqrt("blocks"))).cast("int")), "block_words")
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = block.groupBy("source_no", "range").agg(F.count("*").alias("in_range"), F.sum("words").alias("range_words"))
    ranges = ranges.select("source_no", "range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("in_range", "places_before"), ("range_words", "words_before"))))
    shuffled = Window.partitionBy("source_no", "range").orderBy(turn, "block")
    block = block.join(ranges, ["source_no", "range"]).withColumn("place", F.col("places_before") + F.row_number().over(shuffled) - 1)
    block = block.withColumn("upto", F.col("words_before") + F.sum("words").over(shuffled.rowsBetween(Window.unboundedPreceding, 0)))
    block = block.withColumn("rest", F.col("wanted") - (F.col("upto") - F.col("words")))
    block = written(block.drop("range", "places_before", "words_before", "wanted"), "blocks")

    # how many blocks each source gives, counted over its passes, and which shard each of them goes to
    given = block.groupBy("source_no").agg(F.max("passes").alias("passes"), F.count("*").alias("n"), F.count_if(F.col("rest") > 0).alias("last"))
    quotas = [0] * len(stats)
    many = [0] * len(stats)
    for r in given.collect():
        many[r.source_no], quotas[r.source_no] = r.n, r.passes * r.n + r.last
    tree = splitting_tree(quotas, shards, seed)
    ends = np.cumsum(tree, 0)
    runs = [(i, s, int(ends[s, i] - tree[s, i]), int(ends[s, i]) - 1) for i in range(len(stats)) for s in range(shards) if tree[s, i]]
    dealt = spark.createDataFrame(runs, "source_no int, shard int, first bigint, last bigint").select("source_no", "shard", F.explode(F.sequence("first", "last")).alias("draw_no"))
    draws = (
        block.join(given.select("source_no", "n"), "source_no")
        .withColumn("n_draws", F.col("passes") + (F.col("rest") > 0).cast("int"))
        .where("n_draws > 0")
        .select("source_no", "block", F.explode(F.sequence(F.lit(0), F.col("n_draws") - 1)).alias("pass"), "place", "n")
        .withColumn("draw_no", F.col("pass") * F.col("n") + F.col("place"))
    )
    homes = (
        draws.join(dealt, ["source_no", "draw_no"])
        .groupBy("source_no", "block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("homes"))
    )
    # in the block where the target ends, documents are taken in hash order until less than half of one is wanted
    order = F.xxhash64(F.lit(seed + 2), F.col("draw"))
    last = placed.join(block.where("rest > 0 and rest < words").select("source_no", "block", "rest"), ["source_no", "block"])
    last = last.groupBy("source_no", "block", "rest", order.alias("turn")).agg(F.sum("size").alias("turn_words"))
    before = F.coalesce(F.sum("turn_words").over(Window.partitionBy("source_no", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends_at = last.withColumn("before", before).where(F.col("before") + F.col("turn_words") / 2 > F.col("rest")).groupBy("source_no", "block").agg(F.min("turn").alias("turn"))
    plan = block.select("source_no", "block", "rest").join(homes, ["source_no", "block"], "left").join(ends_at, ["source_no", "block"], "left")
    plan = written(plan, "plan")

    placed = in_blocks(whole_rows) if carry else placed
    full = placed.join(plan, ["source_no", "block"])
    extra = ((F.col("rest") > 0) & F.coalesce(order < F.col("turn"), F.lit(True))).cast("int")
    copies = F.when(F.col("size") > 0, F.col("passes") + extra).when(F.col("source_size") > 0, F.lit(1)).otherwise(F.lit(0))
    homes = F.slice(F.coalesce("homes", F.array().cast("array<int>")), F.lit(1), copies)
    alone = F.pmod(F.col("draw"), F.lit(shards)).cast("int")  # of texts without words, whose block may not be drawn
    homes = F.concat(homes, F.array_repeat(alone, F.greatest(copies - F.size(homes), F.lit(0))))
    return full.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "block", homes.alias("shards"),
        F.transform(homes, lambda shard, i: F.xxhash64(F.lit(seed + 3), shard, i, "draw")).alias("places"),
        *([carry] if carry else []),
    )


def in_shards(rows: DataFrame, shards: str, places: str, keep: list[str], slices: int = 16) -> DataFrame:
    """One row per copy, a shard's copies in up to `slices` runs, each in the shuffled order of its places."""
    each = rows.select(*keep, F.explode(F.arrays_zip(F.col(shards).alias("s"), F.col(places).alias("p"))).alias("barloom_home"))
    slice_ = F.pmod(F.col("barloom_home.p"), F.lit(slices))
    each = each.repartition(F.col("barloom_home.s"), slice_).sortWithinPartitions("barloom_home.s", slice_, "barloom_home.p")
    return each.select(*keep)
